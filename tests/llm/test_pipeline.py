"""The pipeline's stages, each on its own input, against brute force or the laws of its operator."""

from __future__ import annotations

import collections
from pathlib import Path

import pytest
from test_dedup import WORD, expected_components, shingles
from test_text_ops import expected_targets

import corpus_pipeline as P
from siftwarden.llm import neardup, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables aren't here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before, after = {r.doc_id for r in docs.collect()}, {r.doc_id for r in out.collect()}
        assert after and after <= before
        if name == "toxicity":
            scores = toxicity.scored(docs, toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet").where(P.id_bucket(P.F.col("doc_id"), 5) != 0)))
            assert after == {r.doc_id for r in scores.where("score < 0.5").collect()}
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        if name == "near_copies":
            comps = expected_components(rows)
            assert after == {c for _, c in comps.values()} and out.count() == len(after)
        if name == "decontamination":
            items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            sets = {i: shingles(t) for i, t in rows}
            assert after == {i for i, d in sets.items() if not any(x and 4 * len(x & d) >= 3 * len(x) for x in items)}
        if name == "mixing":
            size, most, got = collections.Counter(), collections.Counter(), collections.Counter()
            for r in docs.collect():
                size[r.source] += len(WORD.findall(r.text or ""))
                most[r.source] = max(most[r.source], len(WORD.findall(r.text or "")))
            for r in out.collect():
                got[r.source] += len(WORD.findall(r.text or ""))
            assert all(abs(got[k] - v) < most[k] for k, v in expected_targets(size).items())
            assert max(r["count"] for r in out.groupBy("doc_id").count().collect()) <= 3
        if name == "sharding":
            assert out.count() == docs.count() and set(docs.columns) < set(out.columns)
            slots = collections.defaultdict(list)
            for r in out.collect():
                slots[r.shard].append(r.slot)
            assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        else:
            assert out.columns == docs.columns
        docs = out


def test_odd_rows(spark):
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (None, "a b c d e f", None, None, None), (2, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # the null row is a copy of the named one, which stays
    assert sorted(str(r.doc_id) for r in P.drop_near_copies(spark, docs, SF).collect()) == ["1", "2"]
    assert P.drop_benchmark(spark, docs, SF).count() == 4
    assert P.drop_toxic(spark, docs, SF).count() == 4
    # 18 words: the null source weighs 2 and wants 12 of its 6, so its one document with words is taken twice
    assert sum(r.doc_id is None for r in P.mix_sources(spark, docs, SF).collect()) == 2
    assert P.shard(spark, docs, SF).count() == 4
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_null_ids_in_bulk(spark):
    text = lambda c, n=12: " ".join(f"{c}{k}" for k in range(n))
    rows = [(None, text("a"), "en", "s", k % 2) for k in range(300)] + [(None, text(f"b{k}_"), "en", "t", 11) for k in range(30)] + [(5, text("a", 13), "en", "s", 1), (6, text("c"), "en", "s", 1), (None, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.drop_near_copies(spark, docs, SF).collect()
    # links: text a of 12 and of 13 words share 8 of 9 shingles; the one with an id stays
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("None", text(f"b{k}_")) for k in range(30)] + [("5", text("a", 13)), ("6", text("c")), ("None", "")])
    got = collections.Counter()
    for r in P.mix_sources(spark, docs, SF).collect():
        got[r.source] += len(WORD.findall(r.text))
    want = expected_targets({"s": 300 * 12 + 13 + 12, "t": 30 * 12})
    assert all(abs(got[k] - v) <= 13 for k, v in want.items())
    assert P.shard(spark, docs, SF).count() == len(rows)


def test_near_copies_of_repeated_ids(spark):
    text = lambda c, n=12: " ".join(f"{c}{k}" for k in range(n))
    rows = [(1, text("a")), (1, text("b")), (2, text("b")), (2, text("c")), (2, text("c")), (3, text("c")), (3, text("d")), (4, text("e", 60)), (4, text("f")), (5, text("e", 59)), (5, text("f").upper()), (6, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 11) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in P.drop_near_copies(spark, docs, SF).collect()), key=str)
    assert got == sorted([(1, text("a")), (1, text("b")), (2, text("c")), (3, text("d")), (4, text("e", 60)), (4, text("f")), (6, None), (6, "")], key=str)
    comps = {(r.doc_id, r.component_id) for r in neardup.components(docs).collect()}
    assert comps == {(1, 1), (2, 1), (2, 2), (3, 2), (3, 3), (4, 4), (5, 4), (6, 6)}


def test_mixing_of_repeated_ids(spark):
    # a has two thirds of the words and wants one: one or none of each text, whether or not another text has the id
    rows = [(k % 40, f"{k} " + "w " * 9, "en", "abb"[k % 3 == 0], 11) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = P.mix_sources(spark, docs, SF).collect()
    assert abs(len(got) - 600) <= 2 and abs(sum(r.source == "a" for r in got) - 200) <= 1


def test_columns_of_any_name_come_out_as_they_went_in(spark):
    """Names that stages make, result columns' names but for sharding's own, and a dot; very long and empty texts beside them."""
    names = ["_toxic", "_hits", "_copies", "_id", "_text", "_key", "row", "key", "id", "mark", "copies", "copy", "hits", "score", "kept", "all", "least", "taken", "target", "nth", "a.b"]
    rows = [(k, f"word{k} " * (60_000 if k == 3 else 9), "en", "s" if k % 3 else "t", k, *([f"v{k}"] * len(names))) for k in range(12)] + [(50, "", "en", "s", 0, *(["e"] * len(names))), (51, None, None, None, None, *([None] * len(names)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        got = {tuple(r)[: len(docs.columns)] for r in out.collect()}
        assert out.columns[: len(docs.columns)] == docs.columns and got <= {tuple(r) for r in rows}, name
        if name not in ("mixing", "toxicity", "near_copies"):
            assert len(got) == len(rows), name
        assert stage(spark, docs.limit(0), SF).count() == 0
