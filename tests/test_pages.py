import hashlib
import json

import pytest

from corpuscope.sources import files as FS
from corpuscope.sources import pages as PG


def page(folder, number, results=None, **more):
    body = {"query": {"pages": {str(k): {"title": f"t{k}", "extract": v} for k, v in results.items()}}} if results is not None else {}
    (folder / f"page-{number}.json").write_text(json.dumps(body | more))


def test_saved_pages_stop_at_the_first_error(spark, tmp_path):
    page(tmp_path, 1, {3: "a" * 200, 20: "b" * 199, 100: "é" * 200})
    page(tmp_path, 2, {7: None, 8: "c" * 300})
    page(tmp_path, 10, error={"code": "ratelimited", "info": "later"})
    page(tmp_path, 11, {9: "d" * 300})
    got = [(r["page"], r["key"], r["title"]) for r in PG.saved_extracts(spark, str(tmp_path)).orderBy("page", "key").collect()]
    assert got == [("page-1.json", "100", "t100"), ("page-1.json", "3", "t3"), ("page-2.json", "8", "t8")]
    assert [r["key"] for r in PG.saved_extracts(spark, str(tmp_path), articles=2).collect()] == ["3", "100"]
    assert {(r["page"], r["usable"], r["kept"], r["short"]) for r in PG.skipped(spark, str(tmp_path)).collect()} == {("page-1.json", True, 2, 1), ("page-2.json", True, 1, 1), ("page-10.json", False, 0, 0), ("page-11.json", True, 1, 0)}
    (tmp_path / "page-2.json").write_text("{not json")
    assert [r["key"] for r in PG.saved_extracts(spark, str(tmp_path), articles=9).collect()] == ["3", "100"]
    page(tmp_path, 1, {})
    assert PG.saved_extracts(spark, str(tmp_path)).count() == 0


def test_changed_archives_are_refused(spark, tmp_path):
    for name in ("a.zip", "b.zip"):
        (tmp_path / name).write_bytes(name.encode())
    told = [(n, hashlib.sha256(n.encode()).hexdigest().upper()) for n in ("a.zip", "b.zip", "c.zip")]
    manifest = spark.createDataFrame([*told, told[0]], "name string, sha256 string")
    files = FS.binary_files(spark, str(tmp_path), "*.zip")
    assert sorted(bytes(r["content"]) for r in FS.verified(files, manifest).collect()) == [b"a.zip", b"b.zip"]
    (tmp_path / "b.zip").write_bytes(b"B.zip")
    with pytest.raises(Exception, match="b.zip"):
        FS.verified(FS.binary_files(spark, str(tmp_path), "*.zip"), manifest).collect()
    (tmp_path / "b.zip").unlink()
    (tmp_path / "d.zip").write_bytes(b"d")
    with pytest.raises(Exception, match="d.zip"):
        FS.verified(FS.binary_files(spark, str(tmp_path), "*.zip"), manifest).collect()
