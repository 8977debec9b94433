"""Document quality from a linear-chain conditional random field over lines.

Each line of a document is good or bad. Its features are indicators of its own
look (length, shares of symbols, capitals, digits and bars, word lengths,
repeated words and lines, ends) and of the lines before and after it. Forward-backward gives
each line's marginal; weighted by line lengths they make the bad share of the
document, and a logistic curve over it the score.

Training reads a bounded sample of labelled rows (see ``training``, whole
texts) in one task. A good document has only good lines. A bad one starts with
all lines bad; then, in some rounds, those lines that the field itself takes
for good are taken as good, but for the worst one. The model is some hundred
numbers. Scoring is one pass over all rows without a shuffle.

Cases: null or empty text is one empty line; a null doc_id is carried as null;
repeated rows are scored each; an empty table gives no rows; labels that are
null or belong to no row are ignored; without labels of both kinds every score
is the share of good labels, or 1 without any. Other columns are ignored.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SAMPLE_ROWS, ROUNDS, STEPS, L2 = 10_000, 3, 60, 1e-4
#: Bytes of text that are looked at together.
CHUNK = 1 << 20

_KIND = np.zeros(256, "i8")  # 0: other punctuation
for _c in range(256):
    _KIND[_c] = 1 if 65 <= _c <= 90 else 2 if 97 <= _c <= 122 else 3 if 48 <= _c <= 57 else 4 if _c in b" \t\r\x0b\x0c" else 5 if _c in b"%$#&*^~=<>{}[]\\+@_`" else 6 if _c in b"!?" else 7 if _c == 124 else 9 if 128 <= _c < 192 else 8 if _c >= 192 else 0
#: Bounds of the buckets that shares and lengths fall into.
SHARES, LENGTHS, WORD, REPEATS = (1e-9, 0.03, 0.1, 0.3, 0.6), (0, 15, 40, 120, 400, 1500), (2.5, 4, 5.5, 7, 9, 14), (0.3, 0.6, 0.8, 0.95)
OWN = 5 * (len(SHARES) + 1) + (len(LENGTHS) + 1) + (len(WORD) + 1) + (len(REPEATS) + 1) + 3


def lines_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of the set indicators of each line, length of each line in characters, lines of each document)."""
    split = [t.split("\n") for t in texts]
    counts = np.array([len(x) for x in split], "i8")
    raw = np.frombuffer(("\n".join(texts)).encode(), "u1")
    breaks = raw == 10
    n = int(counts.sum())
    tally = np.bincount((np.cumsum(breaks) - breaks) * 10 + _KIND[raw], minlength=n * 10)[: n * 10].reshape(n, 10).astype("f8")
    tally[:, 0][: n - 1] -= 1  # line breaks
    if raw.size == 0:
        tally[:] = 0
    chars = tally.sum(1) - tally[:, 9]
    letters = tally[:, 1] + tally[:, 2] + tally[:, 8]
    solid = np.maximum(chars - tally[:, 4], 1)
    distinct, twice, words, again, ends = [], [], [], [], []
    for doc in split:
        seen = Counter(doc)
        for line in doc:
            w = line.split()
            words.append(len(w))
            distinct.append(len(set(w)) / len(w) if w else 1.0)
            twice.append(sum(map(eq, w, w[1:])) / len(w) if w else 0.0)
            again.append(len(line) > 0 and seen[line] > 1)
            last = line[-1:] if line else ""
            ends.append(0 if last in ".!?:;" and last else 1)
    word_count = np.array(words)
    shares = [tally[:, 5] / solid, tally[:, 1] / np.maximum(letters, 1), (tally[:, 6] + tally[:, 7] * 3) / solid, tally[:, 3] / solid, np.array(twice)]
    cols, at = [], 0
    for values, bounds in [*((s, SHARES) for s in shares), (chars, LENGTHS), (solid / np.maximum(word_count, 1), WORD), (np.array(distinct), REPEATS)]:
        cols.append(at + np.searchsorted(bounds, values, side="left"))
        at += len(bounds) + 1
    cols += [np.where(np.array(again, bool), at, OWN), np.where(np.array(ends, bool), at + 1, OWN), np.where(tally[:, 7] > 0, at + 2, OWN)]
    return np.stack(cols, 1), chars, counts


def design(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indicator numbers of each line with those of its neighbours; number 3 * (OWN + 1) stands for no neighbour before, the next for none after."""
    ends = np.cumsum(counts)
    first, last = np.zeros(len(own), bool), np.zeros(len(own), bool)
    first[ends - counts] = last[ends - 1] = True
    none = 3 * (OWN + 1)
    before, after = np.roll(own, 1, 0) + OWN + 1, np.roll(own, -1, 0) + 2 * (OWN + 1)
    before[first], after[last] = none, none + 1
    return np.concatenate([own, before, after], 1)


DIM = 3 * (OWN + 1) + 2


def marginals(emit: np.ndarray, trans: np.ndarray, counts: np.ndarray, pairs: bool = False):
    """P(bad) of each line by forward-backward, and with ``pairs`` the expected transitions [from, to].

    emit: log-potential of bad against good; trans: log-potentials [from, to]. All documents advance together, line by line.
    """
    order = np.argsort(-counts, kind="stable")
    start, n = (np.cumsum(counts) - counts)[order], counts[order]
    longest = int(n[0]) if len(n) else 0
    alive = [int(np.searchsorted(-n, -t, side="left")) for t in range(longest)]  # documents with more than t lines
    fwd, bwd = np.zeros((len(emit), 2)), np.zeros((len(emit), 2))
    for t in range(longest):
        at = start[: alive[t]] + t
        here = np.stack([np.zeros(len(at)), emit[at]], 1)
        if t:
            p = fwd[at - 1]
            here = here + np.stack([np.logaddexp(p[:, 0] + trans[0, j], p[:, 1] + trans[1, j]) for j in (0, 1)], 1)
        fwd[at] = here - here.max(1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        at = start[: alive[t + 1]] + t
        nxt = bwd[at + 1] + np.stack([np.zeros(len(at)), emit[at + 1]], 1)
        here = np.stack([np.logaddexp(nxt[:, 0] + trans[i, 0], nxt[:, 1] + trans[i, 1]) for i in (0, 1)], 1)
        bwd[at] = here - here.max(1, keepdims=True)
    both = fwd + bwd
    bad = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))
    if not pairs:
        return bad
    inner = np.ones(len(emit), bool)
    inner[(np.cumsum(counts) - counts)[counts > 0]] = False
    i = np.flatnonzero(inner)
    joint = fwd[i - 1][:, :, None] + trans[None] + (bwd[i] + np.stack([np.zeros(len(i)), emit[i]], 1))[:, None, :]
    joint = np.exp(joint - joint.max((1, 2), keepdims=True))
    return bad, (joint / joint.sum((1, 2), keepdims=True)).sum(0)


def _fit_field(x: np.ndarray, y: np.ndarray, counts: np.ndarray, w: np.ndarray, trans: np.ndarray, steps: int):
    """Adam on the mean conditional log-likelihood."""
    inner = np.ones(len(y), bool)
    inner[np.cumsum(counts) - counts] = False
    i = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[i - 1], y[i]), 1)
    theta, m, v = np.concatenate([w, trans.ravel()]), 0.0, 0.0
    for step in range(1, steps + 1):
        w, trans = theta[:DIM], theta[DIM:].reshape(2, 2)
        p, expected = marginals(w[x].sum(1), trans, counts, True)
        g = np.bincount(x.ravel(), weights=np.repeat(y - p, x.shape[1]), minlength=DIM)
        g = np.concatenate([g, (seen - expected).ravel()]) / len(y) - L2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:DIM], theta[DIM:].reshape(2, 2)


def bad_shares(bad: np.ndarray, chars: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the marginals; an empty line counts as one character."""
    weight, first = np.maximum(chars, 1), np.cumsum(counts) - counts
    return np.add.reduceat(bad * weight, first) / np.add.reduceat(weight, first)


def _curve(share: np.ndarray) -> np.ndarray:
    s = np.clip(share, 1e-4, 1 - 1e-4)
    return np.stack([np.ones_like(s), np.log(s / (1 - s))], 1)


def fit(texts: list[str], good: np.ndarray, rounds: int = ROUNDS, steps: int = STEPS) -> dict:
    """The model as plain lists."""
    rate = float(np.mean(good)) if len(good) else 1.0
    model = {"rate": rate, "w": None}
    if len(set(good.tolist())) < 2:
        return model
    own, chars, counts = lines_of(texts)
    x, first = design(own, counts), np.cumsum(counts) - counts
    of_bad = np.repeat(good == 0, counts)
    y, w, trans = of_bad.astype("i8"), np.zeros(DIM), np.zeros((2, 2))
    for turn in range(rounds):
        w, trans = _fit_field(x, y, counts, w, trans, steps)
        if turn < rounds - 1:
            p = marginals(w[x].sum(1), trans, counts)
            worst = np.maximum.reduceat(p, first)
            y = (of_bad & ((p >= 0.5) | (p >= np.repeat(worst, counts)))).astype("i8")
    z = _curve(bad_shares(marginals(w[x].sum(1), trans, counts), chars, counts))
    c = np.zeros(2)
    for _ in range(25):  # Newton steps of a ridge logistic regression
        q = 1 / (1 + np.exp(-np.clip(z @ c, -35, 35)))
        h = (z * (q * (1 - q))[:, None]).T @ z + 0.5 * np.eye(2)
        c = c + np.linalg.solve(h, z.T @ (good - q) - 0.5 * c)
    return model | {"w": w.tolist(), "trans": trans.tolist(), "curve": c.tolist()}


def line_marginals(texts: list[str], model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P(bad) of each line, its length, lines of each document)."""
    own, chars, counts = lines_of(texts)
    w = np.array(model["w"])
    return marginals(w[design(own, counts)].sum(1), np.array(model["trans"]), counts), chars, counts


def scores(texts: list[str], model: dict) -> np.ndarray:
    if not texts or model["w"] is None:
        return np.full(len(texts), model["rate"])
    return 1 / (1 + np.exp(-np.clip(_curve(bad_shares(*line_marginals(texts, model))) @ np.array(model["curve"]), -35, 35)))


def train(sample: DataFrame, **settings: int) -> dict:
    """Fit on (doc_id, text, label), label 1 for good, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, good = [], []
        for batch in batches:
            texts += [t or "" for t in batch.column("text").to_pylist()]
            good += batch.column("label").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(fit(texts, np.array(good, "f8"), **settings))])], ["model"])

    one = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit(29)), "doc_id", "text")
    found = one.mapInArrow(run, "model string").collect()
    return json.loads(found[0].model) if found else {"rate": 1.0, "w": None}


def score(docs: DataFrame, model: dict, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """The rows with a further, or replaced, column: the probability that the document is good."""
    keep = [c for c in docs.columns if c != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, part, size = [], [], 0
            for text in batch.column(text_col):
                part.append(text.as_py() or "")
                size += len(part[-1])
                if size >= CHUNK:
                    out.append(scores(part, model))
                    part, size = [], 0
            out.append(scores(part, model))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(np.concatenate(out))], [*keep, out_col])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep] + [f"`{out_col}` double"])
    return docs.mapInArrow(run, schema)
