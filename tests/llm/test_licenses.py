from pixelgrove.llm.licenses import TEMPLATES, Scanner, scan, words

SCHEMA = "doc_id long, text string, findings string, start string"


def names(text):
    return [x[2] for x in Scanner().scan(text)]


def test_notices_and_near_misses():
    assert names("Licensed under the Apache License, Version 2.0.") == ["Apache-2.0"]
    assert names("licensed under  cc by-nc 4.0") == ["CC-BY-NC-4.0"]
    assert names("Licensed under CC BY 4.0.") == ["CC-BY-4.0"]
    assert names("This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0"]
    assert names("This work is licensed under the GNU General Public License, version 7.") == []
    assert names("Her driver's license was lost in the public domain of the town.") == []
    gpl = "This program is free software: you can redistribute it\nand/or modify it under the terms of the GNU General Public License as\npublished by the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    assert names(f"Intro.\n\n{gpl}\n\nAfter.") == ["GPL-3.0"]


def test_spans_are_code_points_of_the_words_that_agree():
    text = "😀 İ é\nReleased under the MIT License.\nAll rights reserved by us."
    found = Scanner().scan(text)
    assert [(text[a:b], name) for a, b, name, _ in found] == [("Released under the MIT License", "MIT"), ("All rights reserved", "Proprietary")]


def test_own_template_ranks_first():
    s = Scanner()
    for i, (name, _, ours) in enumerate(s.templates):
        assert s.templates[-s.rank(ours)[0][1]][0] == name, i
    assert s.differences(0, words("nothing alike")) is None


def test_rows_nulls_and_empty_table(spark):
    rows = [(1, "Released under the MIT License.", "x", "y"), (None, "All rights reserved.", None, None), (2, None, "x", "y"), (3, "", "x", "y"), (4, "word " * 50_000 + "\nAll rights reserved.", "x", "y"), (4, "All rights reserved.", "x", "y"), (4, "All rights reserved.", "x", "y")]
    found = scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted([(r.doc_id, len(r.findings)) for r in found], key=str) == sorted([(1, 1), (None, 1), (2, 0), (3, 0), (4, 1), (4, 1), (4, 1)], key=str)
    assert scan(spark.createDataFrame([], SCHEMA)).count() == 0


def wrapped(name, must="", width=60):
    import textwrap

    return "\n".join(" * " + x for x in textwrap.wrap(next(t for n, m, t in TEMPLATES if n == name and must in m), width))


def test_a_winning_line_hides_no_wrapped_notice():
    for name, must in (("BSD", "redistribution"), ("MIT", "free"), ("GPL-3.0", "gnu"), ("ISC", "fee"), ("LGPL-2.1", "lesser")):
        longest = wrapped(name, must) if name != "GPL-3.0" else "This program is free software: you can redistribute it\nand/or modify it under the terms of the GNU General Public License as\npublished by the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
        assert names(f"Copyright (c) 2015, Jane Roe. All rights reserved.\n{longest}") == ["Proprietary", name]


def test_length_of_a_paragraph_changes_nothing():
    for n in (10, 5000):
        text = "some line of prose\n" * n + wrapped("BSD", "redistribution") + "\nmore of it" * n
        assert [(name, d) for *_, name, d in Scanner().scan(text)] == [("BSD", 0)]


def test_all_notices_of_a_block_are_found():
    assert names("Code: Licensed under the MIT License. Docs: Licensed under CC BY 4.0.") == ["MIT", "CC-BY-4.0"]
    assert names("code licensed under the mit license, docs licensed\nunder cc by 4.0, and both licensed under the mit license") == ["MIT", "CC-BY-4.0", "MIT"]
    assert names("All rights reserved. " * 500) == ["Proprietary"] * 500


def test_short_notices_amid_many_words():
    import random

    r = random.Random(4)
    common = sorted({w for _, _, t in TEMPLATES for w in words(t)} - {"reserved", "bsd", "mit", "apache", "2.0"})
    for notice, name in (("All rights reserved.", "Proprietary"), ("Licensed under the BSD License.", "BSD")):
        for _ in range(20):
            before, after = (" ".join(r.choices(common, k=1000)) for _ in range(2))
            assert name in names(f"{before} {notice} {after}")
    assert names("Licensed under the MIT License. Licensed under the Apache License, Version 2.0.") == ["MIT", "Apache-2.0"]


def test_like_all_templates_on_all_blocks():
    """Neither the ranking nor the search for must words loses a notice."""
    import random
    from difflib import SequenceMatcher

    from pixelgrove.llm.licenses import AGREE, BETWEEN

    def confirmed(template, block):
        """Whether a run of agreeing words in any window confirms it, by the wording alone."""
        _, must, ours = template
        more = int(BETWEEN * len(ours))
        for low in range(0, max(1, len(block) - len(ours) + 1)):
            part = block[low : low + len(ours) + more]
            if not must <= set(part) or len(set(ours) & set(part)) < AGREE * len(set(ours)) / 2:
                continue
            same = [m for m in SequenceMatcher(None, ours, part, autojunk=False).get_matching_blocks() if m.size]
            agreed = {w for m in same for w in ours[m.a : m.a + m.size]}
            between = sum(b.b - a.b - a.size for a, b in zip(same, same[1:], strict=False))
            if sum(m.size for m in same) >= AGREE * len(ours) and between <= BETWEEN * len(ours) and must <= agreed:
                return True
        return False

    r, scanner = random.Random(6), Scanner()
    for k in range(60):
        name, _, ours = scanner.templates[k % len(scanner.templates)]
        notice = [w for w in ours if r.random() > 0.06]
        text = r.choices("the of and a to in is that we it was for on as with".split(), k=r.randint(0, 80)) + notice + r.choices("the of and a to in is that we".split(), k=r.randint(0, 80))
        block, found = words(" ".join(text)), {x[2] for x in scanner.scan(" ".join(text))}
        want = {t[0] for t in scanner.templates if confirmed(t, block)}
        assert found <= want and (name in found or name not in want), (name, found, want)
