"""Advisory records of folders, readable and not."""

from __future__ import annotations

import json

import pytest

from siftwarden.sources import imports


def record(id_, name="Foo_Bar", fixed="2.0", **more):
    return {"id": id_, "affected": [{"package": {"ecosystem": "PyPI", "name": name}, "ranges": [{"type": "ECOSYSTEM", "events": [{"introduced": "0"}, {"fixed": fixed}]}]}]} | more


def test_import_tells_what_it_read_and_what_not(spark, tmp_path):
    first, second = tmp_path / "a", tmp_path / "b"
    (first / "deep").mkdir(parents=True)
    second.mkdir()
    (first / "deep/one.json").write_text(json.dumps(record("G-1", aliases=["CVE-1"])))
    (first / "many.json").write_text(json.dumps([record("G-2"), 7, record("G-3", withdrawn="2024"), {"id": "no"}]))
    (first / "batch.JSON").write_text(json.dumps({"vulns": [record("G-4", "other"), record("G-2")]}))
    (first / "cut.json").write_text('{"id": ')
    (first / "bytes.json").write_bytes(b"\xff\xfe{")
    (first / "deep.json").write_text("[" * 200_000)
    (first / "note.txt").write_text("{")
    (second / "again.json").write_text(json.dumps(record("PY-1", aliases=["CVE-1"], fixed="9")))
    (second / "flow.yml").write_text(json.dumps(record("PY-2", "last")))
    (second / "nothing.json").write_text('{"python": {}}')
    read = imports.decoded(imports.texts(spark, [str(first), str(second)])).persist()
    bad = {r.file.rpartition("/")[2]: r.error for r in read.where("error is not null").collect()}
    assert set(bad) == {"cut.json", "bytes.json", "deep.json"} and all(bad.values())
    rows = imports.entries(read)
    kept = imports.merged(rows)
    assert sorted((r.package, r.id, r.cve, r.affected) for r in kept.collect()) == [("foo-bar", "G-1", "CVE-1", "<2.0"), ("foo-bar", "G-2", None, "<2.0"), ("last", "PY-2", None, "<2.0"), ("other", "G-4", None, "<2.0")]
    assert imports.sums(read, rows, kept).first().asDict() == {"records": 8, "unreadable": 3, "duplicates": 2, "packages": 3, "advisories": 4}
    assert imports.merged(rows, ("npm",)).count() == 0 and imports.merged(rows, limit=1).count() == 3
    with pytest.raises(ValueError):
        imports.texts(spark, [])


def test_import_of_block_style(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "x.yaml").write_text("id: PYSEC-1\npublished: 2024-01-02\naliases:\n- CVE-9\naffected:\n- package: {ecosystem: PyPI, name: Foo}\n  ranges:\n  - type: ECOSYSTEM\n    events:\n    - introduced: '0'\n    - fixed: 1.10\n")
    (tmp_path / "bad.yaml").write_text("a: [1\nb")
    read = imports.decoded(imports.texts(spark, [str(tmp_path)]))
    assert [(r.id, r.cve, r.affected) for r in imports.entries(read).collect()] == [("PYSEC-1", "CVE-9", "<1.10")]
    assert read.where("error is not null").count() == 1


def test_import_of_odd_tables(spark):
    schema = "source_no int, file string, text string"
    assert imports.decoded(spark.createDataFrame([], schema)).count() == 0
    odd = imports.decoded(spark.createDataFrame([(0, None, None), (0, "a.json", "null"), (0, "b.json", '"text"')], schema))
    assert [r.error is None for r in odd.collect()] == [False]
