import bz2
import io
import json
import tarfile
import zipfile

import pytest

from corpuscope.sources import files as SF
from corpuscope.sources import sinks
from corpuscope.sources.guard import Guard, SequestrationError
from corpuscope.sources.html import between_markers, text_of


def test_leipzig(spark, tmp_path):
    body = "1\tEin Boot liegt im Hafen.\n2\tLe port dort encore!\n3\t17 %%\n".encode()
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as tar:
        info = tarfile.TarInfo("x/x-sentences.txt")
        info.size = len(body)
        tar.addfile(info, io.BytesIO(body))
    got = SF.leipzig(spark, str(tmp_path)).orderBy("part").collect()
    assert [r["tokens"] for r in got] == [["ein", "boot", "liegt", "im", "hafen"], ["le", "port", "dort", "encore"]]
    assert SF.leipzig(spark, str(tmp_path), 1).count() == 1


def test_tatoeba(spark, tmp_path):
    (tmp_path / "a.tsv.bz2").write_bytes(bz2.compress("1\ttlh\tHol vIjatlh\n2\ttlh\tqo'\n".encode()))
    got = SF.tatoeba(spark, str(tmp_path / "a.tsv.bz2"), "tlh", "klingon_latin_case_sensitive").orderBy("id").collect()
    assert [r["tokens"] for r in got] == [["Hol", "vIjatlh"], ["qo'"]]
    with pytest.raises(Exception, match="not a fra row"):
        SF.tatoeba(spark, str(tmp_path / "a.tsv.bz2"), "fra").collect()


def test_tei_and_atf_and_oracc():
    tei = b"<TEI xmlns='http://www.tei-c.org/ns/1.0'><teiHeader><p>no</p></teiHeader><text><p>one <l>two</l></p><ab>three</ab></text></TEI>"
    assert SF.tei_texts(tei) == ["one two", "three"] and SF.tei_texts(b"<broken") == []
    atf = "&P1 = x\n#atf: lang sux\n1. {d}en-lil2 <lugal> [x] ... kur # c\n&P2\n#atf: lang akk\n1. no\n&P3\n#atf: lang sux\n2'. e2\n"
    assert SF.atf_sequences(atf.encode()) == [["den-lil2", "lugal", "kur"], ["e2"]]
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("dcclt/catalogue.json", json.dumps({"members": {"P1": {"language": "Sumerian"}, "P2": {"language": "Akkadian"}}}))
        leaf = lambda f, lang="sux": {"node": "l", "f": {"lang": lang, "form": f}}
        z.writestr("dcclt/corpusjson/P1.json", json.dumps({"cdl": [{"node": "c", "cdl": [leaf("lugal"), leaf("x"), leaf("e", "akk")]}, leaf("kur", "sux-x-emesal")]}))
    assert SF.oracc_sequences(box.getvalue()) == [["lugal", "kur"]]


def test_folders_manifests_and_json(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for name in ("a.txt", "README.md", "_b.txt", "c.csv"):
        (tmp_path / "t" / name).write_text("Aa bb.")
    assert SF.text_folder(spark, str(tmp_path / "t")).count() == 1
    (tmp_path / "m.csv").write_text("corpus_id,status,attested_only\n a ,active,true\nb,closed,true\n")
    bank = SF.csv_manifest(spark, str(tmp_path / "m.csv"), "corpus_id string, status string, attested_only string")
    assert [r["corpus_id"] for r in SF.active_bank(bank).collect()] == ["a"]
    (tmp_path / "la_tokens.json").write_text(json.dumps({"sequences": [["a", "b"], ["c"]], "n": 2}))
    assert [(r["corpus"], r["seq"], r["tokens"]) for r in SF.corpus_json(spark, str(tmp_path / "la_tokens.json")).collect()] == [("la", 0, ["a", "b"]), ("la", 1, ["c"])]
    specs = [spark.createDataFrame([("a", True)], "corpus_id string, required boolean"), spark.createDataFrame([("b", True, 1)], "corpus_id string, required boolean, extra int")]
    present = spark.createDataFrame([("a", False)], "corpus_id string, reviewed boolean")
    status = {r["corpus_id"]: (r["status"], r["blocker"]) for r in SF.bank_manifest(specs, present).collect()}
    assert status == {"a": ("ready_needs_review", "a: tokenization review still required"), "b": ("missing", "b: missing")}


def test_html():
    page = "<html><body>Bare<div>In a <b>div</b><div>inner</div></div><h2>Harbour</h2><p>Boats<sup>2</sup> &amp; nets [17]</p><table><tr><td>depth<table><tr><td>9</td></tr></table></td></tr></table>after"
    page += "<span class='x mw-editsection'>edit</span><figure>plan</figure><math>m</math><script>var a = '<p>no</p>';</script><br>Outils<hr>tide <section>low</section></body></html>"
    assert [x for x in text_of(page).split("\n") if x] == ["Bare", "In a div", "inner", "Harbour", "Boats & nets", "after", "tide", "low"] and text_of(None) == ""
    assert text_of("<p>a</p><p></p><p>b</p>") == "a\n\nb"
    assert between_markers("a START b END c", "START", "END") == "START b " and between_markers("abc", "x", "y") == "abc"


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "x.json")
    sinks.publish_json({"a": 1}, path, immutable=True)
    sinks.publish_json({"a": 1}, path, immutable=True)
    with pytest.raises(FileExistsError):
        sinks.publish_json({"a": 2}, path, immutable=True)
    m = spark.createDataFrame([("en", "a", "b", 0.5)], "corpus string, row_tok string, col_tok string, w double")
    sinks.write_matrix(m, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 1
    rec = sinks.fingerprint_records(spark.createDataFrame([("en", 0.5)], "corpus string, ttr double"))
    sinks.write_records(rec, str(tmp_path / "r"))
    assert sinks.read_records(spark, str(tmp_path / "r"), rec.schema).first()["features"]["ttr"] == 0.5
    rho = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 0.5), ("b", "a", 0.5), ("b", "b", 1.0)], "feature_a string, feature_b string, rho double")
    assert [tuple(r) for r in sinks.square(rho, ("a", "b")).collect()] == [("a", 1.0, 0.5), ("b", 0.5, 1.0)]


def test_guard(spark, sf_dir):
    guard = Guard({"target": f"{sf_dir}/benchmark.parquet"})
    with pytest.raises(SequestrationError):
        guard.read(spark, "target")
    with pytest.raises(ValueError):
        guard.unlocked("short").__enter__()
    with guard.unlocked("calibration of the fixed features"):
        assert guard.read(spark, "target").count() > 0
    assert guard.locked
