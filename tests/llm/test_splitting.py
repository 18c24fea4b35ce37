import random

import pytest

from convolake.llm import splitting as S


def walk(text, limit, overlap):
    """The same cuts, found by walking from piece to piece."""
    at, kind = S.boundaries(text, min(S.STRIDE, limit))
    end, after = S.successors(at, kind, limit, overlap)
    out, i = [], 0
    while i < len(at) - 1:
        out.append((int(at[i]), int(at[end[i]])))
        if end[i] == len(at) - 1:
            break
        i = int(after[i])
    return out


def check(text, limit, overlap):
    cuts = S.pieces(text, limit, overlap)
    if not text:
        assert cuts == []
        return cuts
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b in cuts)
    for (a, b), (c, d) in zip(cuts, cuts[1:]):
        assert a < c <= b < d and b - c <= overlap
    return cuts


def test_cuts_hold_and_equal_a_walk():
    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice(["word ", "a", "é", ". ", "\n", "\n\n", "漢。", "ไทย", "x" * 90]) for _ in range(rng.randint(0, 400)))
        for limit, overlap in ((200, 40), (1600, 200), (10, 3), (1, 0)):
            cuts = check(text, limit, overlap)
            assert cuts == walk(text, limit, overlap)


def test_marks_and_commas_never_exceed_the_limit():
    for text in ("a" + "\u0301" * 5000, "、" * 5000, "ก" + "\u0e34" * 5000, "\u200d" * 5000, "，。" * 3000, "🏽" * 4000, "x" + "\ufe0f" * 4321 + " y"):
        for limit, overlap in ((1600, 200), (79, 20), (41, 3), (7, 0)):
            assert check(text, limit, overlap) == walk(text, limit, overlap)
    rng = random.Random(8)
    for _ in range(40):
        text = "".join(rng.choice(["\u0301", "、", "，", "\u200d", "e", " ", "\u0e34"]) * rng.randint(1, 900) for _ in range(rng.randint(1, 9)))
        for limit, overlap in ((1600, 200), (120, 50), (5, 4)):
            check(text, limit, overlap)
    assert not any(S.pieces("e\u0301" * 3000)[i][0] % 2 for i in range(3))  # a mark stays with its letter where it can


def test_natural_boundaries_come_first():
    text = ("A sentence of some words stands here. " * 20).strip()
    for a, b in S.pieces(text, 200, 40)[:-1]:
        assert text[:b].endswith(". ") or text[:b].endswith(".")
    paragraphs = "\n\n".join(["word " * 30] * 10)
    assert all(paragraphs[b - 2 : b] == "\n\n" for _, b in S.pieces(paragraphs, 400, 50)[:-1])
    assert len(check("x" * 100_000, 1600, 200)) >= 63
    with pytest.raises(ValueError):
        S.pieces("abc", 10, 10)


def test_over_a_table(spark):
    rows = [(1, " " * 10 + "a b" * 533 + " \n", "k"), (2, " " * 10 + "a b" * 534 + "\t\r\n", "k"), (2, " " * 10 + "a b" * 534 + "\t\r\n", "k"), (3, None, "k"), (4, "", "k"), (5, " \n" * 2000, "k"), (None, "word " * 1000, "k"), (6, "🧪" * 1601, "k"), (7, "🧪" * 1600, "k"), (8, "long " * 200_000, "k")]
    df = spark.createDataFrame(rows, "id bigint, text string, piece string")
    found = S.split_oversized(df, "id", "text").collect()
    assert {r.id for r in found} == {2, None, 6, 8}
    assert S.split_oversized(df.limit(0), "id", "text").count() == 0
    mine = sorted((r for r in found if r.id == 8), key=lambda r: r.piece_no)
    text = ("long " * 200_000).strip(" ")
    assert [r.piece_no for r in mine] == list(range(len(mine))) and all(text[r.start_pos - 1 :].startswith(r.piece) for r in mine[:50])
