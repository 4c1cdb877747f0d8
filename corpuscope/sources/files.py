"""Readers of corpus files. Each returns rows for the tokenizer: sequences (corpus, doc_id, seq, tokens) or texts. Paths may be
anything that Spark reads; archives come in as whole binary files and are unpacked in the task that holds them."""

from __future__ import annotations

import io
import json
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions import text as X

IGNORED_NAMES = ("readme.md", "readme.txt", "source.txt", "sources.md", "notes.md")
LEAST_EXTRACT = 200


def corpus_json(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Corpus files {"sequences": [[token, ..], ..], ..}: corpus (the file's name), seq, tokens."""
    raw = spark.read.schema("sequences array<array<string>>").option("multiLine", True).json(paths)
    name = F.regexp_replace(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""), "_tokens$", "")
    return raw.select(name.alias("corpus"), F.posexplode("sequences").alias("seq", "tokens"))


def extracts(rows: DataFrame, text: str = "extract", least: int = LEAST_EXTRACT, most: int | None = None, order: str | None = None) -> DataFrame:
    """Article extracts long enough to use; with most, that many of them in an order."""
    kept = rows.filter(F.length(text) >= least)
    return kept if most is None else kept.orderBy(order or F.sha2(F.col(text), 256)).limit(most)


def unpacked(files: DataFrame, read: Callable[[bytes], list], element: str, name: str) -> DataFrame:
    """files: path, content of binary files. One row for each thing that read() finds: path, part, and name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                found = read(content)
                kind = pa.list_(pa.string()) if element.startswith("array") else pa.string()
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(found), pa.string()), "part": pa.array(range(len(found)), pa.int64()), name: pa.array(found, kind)})

    return files.select("path", "content").mapInArrow(run, f"path string, part bigint, {name} {element}")


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)


def digests(files: DataFrame) -> DataFrame:
    """path, size and SHA-256 of binary files."""
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def verified(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Binary files as they are, but reading one whose SHA-256 isn't that of the manifest (name, sha256), or which the manifest
    doesn't name, fails in the task that holds it, before anything is unpacked. Files of the manifest that aren't there are no error."""
    name = F.element_at(F.split("path", "/"), -1)
    told = manifest.select(F.col("name").alias("__name"), F.lower("sha256").alias("__sha"))
    whole = F.sha2("content", 256) == F.coalesce("__sha", F.lit(""))
    content = F.when(whole, F.col("content")).otherwise(F.raise_error(F.concat(name, F.lit(": its digest isn't that of the manifest"))).cast("binary"))
    # Each name once: a manifest that repeats one would repeat the file.
    return files.join(told.dropDuplicates(["__name"]), name == F.col("__name"), "left").withColumn("content", content).drop("__name", "__sha")


def tei_texts(content: bytes) -> list[str]:
    """Texts of the outermost <p>, <l> and <ab>, header left out; [] if the XML is broken."""
    try:
        root = ElementTree.fromstring(content)
    except ElementTree.ParseError:
        return []
    found: list[str] = []
    todo = [root]
    while todo:
        node = todo.pop()
        local = node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""
        if local == "teiHeader":
            continue
        if local in ("p", "l", "ab"):
            if whole := "".join(node.itertext()).strip():
                found.append(whole)
            continue
        todo += reversed(list(node))
    return found


def tei(spark: SparkSession, path: str) -> DataFrame:
    return unpacked(binary_files(spark, path, "*.xml"), tei_texts, "string", "text")


def leipzig_lines(content: bytes) -> list[str]:
    """Lines of the sentence file in a gzipped tar."""
    with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as tar:
        names = sorted(m.name for m in tar.getmembers() if m.isfile() and m.name.endswith("sentences.txt"))
        if not names:
            raise ValueError("the archive holds no sentence file")
        best = next((n for n in names if n.endswith("-sentences.txt")), names[0])
        return tar.extractfile(best).read().decode("utf-8", "replace").splitlines()


def leipzig_sentence(line: Column) -> Column:
    """The text behind a line number and a tab; a line without one stays."""
    numbered = F.regexp_extract(line, r"^\s*\d+\s*\t(.*)$", 1)
    return F.trim(F.when(line.rlike(r"^\s*\d+\s*\t"), numbered).otherwise(line))


def leipzig(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """path, part, tokens; most: of the non-empty sentences of each archive, those that come first."""
    lines = unpacked(binary_files(spark, path, "*.tar.gz"), leipzig_lines, "string", "line")
    kept = lines.select("path", "part", leipzig_sentence(F.col("line")).alias("sentence")).filter("sentence <> ''")
    if most is not None:
        from pyspark.sql import Window as W

        kept = kept.withColumn("n", F.row_number().over(W.partitionBy("path").orderBy("part"))).filter(F.col("n") <= most)
    return kept.select("path", "part", X.words(F.col("sentence")).alias("tokens")).filter(F.size("tokens") > 0)


def tatoeba(spark: SparkSession, path: str, language: str, mode: str = "unicode_word") -> DataFrame:
    """Tab-separated id, language, text (plain or bz2); another language or a missing column is an error."""
    words = {"unicode_word": X.words, "klingon_latin_case_sensitive": X.klingon_words}
    if mode not in words:
        raise ValueError(f"unknown tokenization mode {mode}")
    parts = F.split(F.col("value"), "\t", 3)
    bad = (F.size(parts) != 3) | (F.get(parts, F.lit(1)) != language)
    checked = F.when(bad, F.raise_error(F.concat(F.lit(f"not a {language} row: "), F.substring("value", 1, 80))).cast("string")).otherwise(F.trim(F.get(parts, F.lit(2))))
    rows = spark.read.text(path).select(F.get(parts, F.lit(0)).alias("id"), checked.alias("sentence")).filter("sentence <> ''")
    return rows.select("id", words[mode](F.col("sentence")).alias("tokens")).filter(F.size("tokens") > 0)


_LINE = re.compile(r"^\d[\d']*\.\s+")
_ATF_CLEAN = ((re.compile(r"#.*$"), ""), (re.compile(r"\[.*?\]|\.\.\."), ""), (re.compile(r"\{([^}]+)\}"), r"\1"), (re.compile(r"<([^>]+)>"), r"\1"))


def atf_sequences(content: bytes) -> list[list[str]]:
    """Token sequences of the Sumerian texts of an ATF file (or of those in a zip): a text starts at &P, counts once its
    language line says sux, and numbered lines add tokens: comments and breaks go, braces and brackets open."""
    if content[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return [s for n in z.namelist() if n.endswith(".atf") for s in atf_sequences(z.read(n))]
    out: list[list[str]] = []
    current: list[str] | None = None
    for line in [*content.decode("utf-8", "replace").splitlines(), "&P"]:
        if line.startswith("&P"):
            if current:
                out.append(current)
            current = None
        elif re.match(r"#atf:\s+lang\s+sux", line, re.IGNORECASE):
            current = current or []
        elif current is not None and _LINE.match(line):
            body = _LINE.sub("", line)
            for pattern, to in _ATF_CLEAN:
                body = pattern.sub(to, body)
            current += [t for t in (x.strip("-") for x in body.split()) if t]
    return out


def atf(spark: SparkSession, path: str) -> DataFrame:
    return unpacked(binary_files(spark, path), atf_sequences, "array<string>", "tokens")


def oracc_sequences(content: bytes) -> list[list[str]]:
    """Sumerian forms of each catalogued text of an ORACC zip, by a walk over its chunk tree."""
    out: list[list[str]] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        listing = next((n for n in sorted(names) if n.endswith("catalogue.json")), None)
        members = json.loads(z.read(listing).decode("utf-8", "replace")).get("members", {}) if listing else {}
        for key in (k for k, m in members.items() if "sumerian" in (m.get("language") or "").lower()):
            name = f"{listing.rpartition('/')[0]}/corpusjson/{key}.json"
            if name not in names:
                continue
            try:
                todo = [json.loads(z.read(name).decode("utf-8", "replace"))]
            except ValueError:
                continue
            forms: list[str] = []
            while todo:
                node = todo.pop()
                if not isinstance(node, dict):
                    continue
                f = node.get("f", {}) if node.get("node") == "l" else {}
                if f.get("lang", "").startswith("sux") and f.get("form") not in (None, "", "x"):
                    forms.append(f["form"])
                todo += reversed(node.get("cdl", []))
            if forms:
                out.append(forms)
    return out


def oracc(spark: SparkSession, path: str) -> DataFrame:
    return unpacked(binary_files(spark, path, "*.zip"), oracc_sequences, "array<string>", "tokens")


def text_folder(spark: SparkSession, path: str, ignored: tuple[str, ...] = IGNORED_NAMES) -> DataFrame:
    """path, text of .txt and .md files, without notes and names that start with an underscore."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md,TXT,MD}").text(path)
    name = F.col("_metadata.file_name")
    return raw.filter(~F.lower(name).isin(*ignored) & ~name.startswith("_")).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def csv_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, texts trimmed."""
    rows = spark.read.option("header", True).schema(schema).csv(path)
    return rows.select(*(F.trim(c).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes))


def active_bank(manifest: DataFrame, ids: tuple[str, ...] | None = None) -> DataFrame:
    """Active, attested rows of a bank, those named if any are."""
    kept = manifest.filter((F.lower("status") == "active") & F.lower(F.col("attested_only").cast("string")).isin("true", "1", "yes"))
    return kept.filter(F.col("corpus_id").isin(*ids)) if ids else kept


def bank_manifest(specs: list[DataFrame], present: DataFrame) -> DataFrame:
    """Specs of any columns (corpus_id, required among them) beside the corpora that are present (corpus_id, reviewed):
    status ready, ready_needs_review or missing, and what blocks a run."""
    whole = specs[0]
    for s in specs[1:]:
        whole = whole.unionByName(s, allowMissingColumns=True)
    joined = whole.join(present.select("corpus_id", "reviewed"), "corpus_id", "left")
    status = F.when(F.col("reviewed"), "ready").when(~F.col("reviewed"), "ready_needs_review").otherwise("missing")
    blocker = F.when(F.col("required") & (F.col("status") == "ready_needs_review"), F.concat("corpus_id", F.lit(": tokenization review still required"))).when(F.col("required") & (F.col("status") != "ready"), F.concat_ws(": ", "corpus_id", "status"))
    return joined.withColumn("status", status).withColumn("blocker", blocker).drop("reviewed")
