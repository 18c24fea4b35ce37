import importlib
import os

import pytest

from convolake.llm import encoding as E
from convolake.llm import mixing as X

pytestmark = pytest.mark.skipif(not os.path.exists(E.BYTE_BPE), reason="no tokenizer files here")
TEXTS = ["", None, " ", "Hello  world!\n\n\tx", "naïve café 漢字 ไทย 🧪👩‍🔧", "<|endoftext|> is text", "don't we'll I'M", "a" * 5000, "\x00\x85\xa0　 .", "1234567 ½ Ⅷ", "\r\n \r\n", "é​", "𝔘𝔫𝔦 x" * 50]


def test_ids_are_the_librarys():
    e = E.Encoder(E.BYTE_BPE)
    mine = list(e.ids(TEXTS))
    assert mine == [e.lib.encode(t, add_special_tokens=False).ids if t else [] for t in TEXTS]
    assert list(e.ids(TEXTS)) == mine and list(e.sizes(TEXTS)) == [len(i) for i in mine]
    assert [e.decode(i) for i in mine] == [t or "" for t in TEXTS]
    for t, ids in zip(TEXTS, mine):
        starts, ends = e.offsets(t or "", ids)
        assert len(starts) == len(ids) and (not ids or (starts[0] == 0 and ends[-1] == len(t)))
        assert all(a < b and c <= b for a, b, c in zip(starts, ends, starts[1:] + ends[-1:]))
    assert "�" in e.decode(e.lib.encode("漢🧪", add_special_tokens=False).ids[:1])


def test_other_files_follow_their_own_rules():
    from tokenizers import Tokenizer

    path = f"{E.FOLDER}/word_bpe_49k.json"
    lib, e = Tokenizer.from_file(path), E.Encoder(path)
    lib.encode_special_tokens = True
    for t in ("IT'S DON'T we'll", "café naïve Ünder", "a  b\n\nc", *filter(None, TEXTS)):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert list(e.ids([t])) == [ids] and list(e.sizes([t, None])) == [len(ids), 0]
        assert len(e.offsets(t, ids)[0]) == len(ids) and isinstance(e.decode(ids), str)


def test_over_tables(spark):
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "c"), (None, "x", "c")], "doc_id bigint, text string, ids string")
    ids = E.encode(df, "doc_id", "text")
    assert ids.count() == len(TEXTS) + 2 and {tuple(r.ids) for r in ids.where("doc_id in (0, 1)").collect()} == {()}
    assert {r.doc_id: r.text for r in E.decode(ids, "doc_id", "ids").collect()}[4] == TEXTS[4]
    wide = E.encode_with_offsets(df, "doc_id", "text").where("doc_id = 3").first()
    assert "".join(TEXTS[3][a:b] for a, b in zip(wide.starts, wide.ends)) == TEXTS[3]
    assert E.encode(df.limit(0), "doc_id", "text").count() == 0


def test_mix_reaches_its_shares(spark):
    docs = [(i, "some words of text " * (1 + i % 17), f" Web{' ' * (i % 2)}" if i % 3 else "BOOKS") for i in range(3000)] + [(9000 + i, "tiny note", "notes") for i in range(4)] + [(9100, None, "web"), (9101, "x", None), (9102, "y", "unlisted")]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("web", 0.3, 2), ("Books", 0.65, 3), ("notes", 0.04, 3), ("none", 0.01, 5)], "source string, target_share double, max_repeats int")
    copies, report = X.mix(documents, targets)
    rows, by = copies.collect(), {r.source: r for r in report.collect()}
    assert {s: r.feasible for s, r in by.items()} == {"web": True, "Books": True, "notes": False, "none": False}
    assert abs(by["web"].share_of_total - 0.3) < 0.001 and abs(by["Books"].share_of_total - 0.65) < 0.001
    assert by["notes"].most_copies == 3 and by["notes"].mixed_tokens == 3 * by["notes"].tokens and by["none"].mixed_tokens == 0
    caps = {"web": 2, "books": 3, "notes": 3}
    assert all(0 <= r.copies <= caps[r.key] and abs(r.copies - r.rate) < 1 for r in rows) and len(rows) == 3005
    assert abs(sum(r.actual_share for r in by.values()) - 1) < 1e-9
    again = {r.doc_id: r.copies for r in X.mix(documents.repartition(7), targets)[0].collect()}
    assert again == {r.doc_id: r.copies for r in rows}
    assert X.mix(documents.limit(0), targets)[0].count() == 0 and X.mix(documents, targets.limit(0))[1].count() == 0


def test_rates_are_tilted_by_length(spark):
    docs = [(i, "word " * (1 + i % 40), s) for s, shift in (("more", 0), ("less", 10_000)) for i in range(shift, shift + 800)]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("more", 0.8, 3), ("less", 0.2, 3)], "source string, target_share double, max_repeats int")
    copies, report = X.mix(documents, targets)
    rates = {k: sorted({(r.tokens, r.rate) for r in copies.collect() if r.key == k}) for k in ("more", "less")}
    assert rates["more"][0][1] < rates["more"][-1][1] <= 3 and rates["less"][0][1] > rates["less"][-1][1] > 0
    assert all(abs(r.share_of_total - r.target_share) < 0.005 for r in report.collect())


def test_tilts_meet_the_tokens_under_the_bound(spark):
    import math

    counts = [(0, 5.0), (1, 40.0), (3, 10.0), (50, 2.0), (9, 7.0), (4000, 1.0)]
    total, n = sum(t * c for t, c in counts), sum(c for _, c in counts)
    goals = {"a": (total / n, 2.7, 3.0), "b": (total / n, 0.01, 5.0), "c": (total / n, 1.0, 2.0), "d": (total / n, 2.999, 3.0)}
    found = X._tilts(spark.createDataFrame([(k, t, c) for k in goals for t, c in counts], "key string, tokens bigint, n double"), goals)
    for k, (mean, r, most) in goals.items():
        got = sum(c * t * math.exp(min(found[k] * t / mean, math.log(most))) for t, c in counts)
        assert abs(got / (r * total) - 1) < 1e-6, k


def test_unsolved_duals_are_errors(spark, monkeypatch):
    monkeypatch.setattr(X, "STEPS", 2)
    with pytest.raises(RuntimeError, match="no tilt"):
        X._tilts(spark.createDataFrame([("a", 1, 5.0), ("a", 900, 2.0)], "key string, tokens bigint, n double"), {"a": (250.0, 2.5, 3.0)})


def test_shares_end_within_one_document(spark):
    """Few and long documents: what stays open is less than the shortest document that could still have had a copy."""
    docs = [(i, "word " * n, s) for s, shift in (("few", 0), ("many", 1000), ("zero", 5000)) for i, n in ((shift + j, 1 + (j * 7919) % (400 if s == "few" else 60)) for j in range(30 if s == "few" else 900))]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("few", 0.11, 2), ("many", 0.89, 3), ("zero", 0.0, 4)], "source string, target_share double, max_repeats int")
    copies, report = X.mix(documents, targets)
    rows, by = copies.collect(), {r.source: r for r in report.collect()}
    total = sum(r.tokens for r in by.values())
    assert by["zero"].mixed_tokens == 0 and all(r.feasible for r in by.values())
    for s in ("few", "many"):
        left = by[s].target_share * total - by[s].mixed_tokens
        open_ = [r.tokens for r in rows if r.key == s and r.copies < r.rate]
        assert 0 <= left < min(open_), s
        tilted = sorted({(r.tokens, r.rate) for r in rows if r.key == s})
        assert len({round(w, 9) for _, w in tilted}) > 1


def test_p7_found_comes_from_the_mix(spark, tmp_path, monkeypatch):
    queries = importlib.import_module("convolake.llm.queries")
    spark.createDataFrame([(1, "x", "s")], "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    report = spark.createDataFrame([("short", False), ("s", True)], "source string, feasible boolean")
    monkeypatch.setattr(queries.mixing, "mix", lambda *_: (None, report))
    assert [r.source for r in queries.p7_found(spark, str(tmp_path)).collect()] == ["short"]
