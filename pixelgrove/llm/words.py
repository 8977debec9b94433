"""Hashes of words, remembered for the next time."""

from __future__ import annotations


class WordHashes(dict):
    """64-bit hashes of words; forgets them all at a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 500_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got
