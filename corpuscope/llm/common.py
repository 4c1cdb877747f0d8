"""What the operators of this subpackage share: inputs, tables in the shared folder, row keys and salting."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these (ASCII white space).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in a single process that names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    held = spark.conf.get("corpuscope.shared.dir", None)
    if not held:
        held = "file://" + tempfile.mkdtemp(prefix="corpuscope-")
        spark.conf.set("corpuscope.shared.dir", held)
    return held


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: cuts the lineage, survives lost
    executors, and each row is computed once. The table stays until clear_tables()."""
    path = f"{_tables(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._kept_at = path
    return table


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables of saved() that nothing reads any more, and lets Spark drop the shuffle files of finished steps,
    which it does when the driver collects garbage."""
    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(table._kept_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    spark._jvm.System.gc()


def clear_tables(spark: SparkSession) -> None:
    """Deletes what this application's operators have written on their way. Results that weren't written elsewhere can't
    be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows and bytes of text that a Python worker holds at once; Spark's own defaults suit narrow rows.
ARROW_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def modest_batches(df: DataFrame) -> DataFrame:
    """Makes Arrow batches small enough for whole texts, unless the session has set its own sizes."""
    conf = df.sparkSession.conf
    for key, (default, own) in ARROW_LIMITS.items():
        if conf.get(key, default) == default:
            conf.set(key, own)
    return df


def deal(df: DataFrame) -> int:
    """Partitions that a shuffle of this session has."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


#: A key is common if it has more than its share of this many shares a partition, and at least COMMON_ROWS rows.
COMMON_SHARES, COMMON_ROWS = 4, 1000


def spread_join(rows: DataFrame, groups: DataFrame, on: list[str], size: str, how: str = "inner") -> DataFrame:
    """rows joined to groups, which holds each key once with the number of rows (or more) that have it in `size`.

    Rows of common keys stay where they are and their groups are broadcast: since the sizes add up to the number of rows,
    there are at most COMMON_SHARES such keys a partition, and the driver may hold their hashes. The others meet by a
    shuffle, none of them with many rows. Both sides are parted by the same hash of the key, so a key whose hash is that of
    a common one goes with it. Both should be tables, as they are read twice.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    most = max(COMMON_ROWS, total // (COMMON_SHARES * deal(rows)))
    hashes = [x[0] for x in groups.filter(F.col(size) > most).select(F.xxhash64(*on)).distinct().collect()]
    if not hashes:
        return rows.join(groups, on, how)
    common = F.xxhash64(*on).isin(hashes)
    light = rows.filter(~common).join(groups.filter(~common), on, how)
    return light.unionByName(rows.filter(common).join(F.broadcast(groups.filter(common)), on, how))


@lru_cache(maxsize=4)
def _first_powers(base: int) -> np.ndarray:
    held = np.cumprod(np.full(1 << 21, base, np.uint64))
    held.flags.writeable = False
    return held


def powers(n: int, base: int) -> np.ndarray:
    """base ** 1 .. base ** n, of 64 bits. Those that texts of usual slices need are kept."""
    return _first_powers(base)[:n] if n <= 1 << 21 else np.cumprod(np.full(n, base, np.uint64))


def salt_of(*cols: str | Column, n: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def in_slices(texts: list[bytes] | list[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `most` bytes (of strings: characters) each (one long text makes a range of its own)."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t)
    if len(texts) > first:
        yield first, len(texts)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least `rows` (but for the last), for narrow columns that work better together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def utf8_column(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as bytes; null becomes empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def data_path(name: str) -> str:
    """Place of a public vocabulary file; CORPUSCOPE_VOCABULARIES names another folder."""
    folder = os.environ.get("CORPUSCOPE_VOCABULARIES")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
