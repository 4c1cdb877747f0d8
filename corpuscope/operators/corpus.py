"""Corpora as DataFrames. One row a document: corpus, doc_id, seqs (array of token sequences). Everything else is a
group-by, window or join on it, with the corpus as a key, so any number of corpora take one job."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscope.functions import text as X

#: Documents whose running totals one task works out.
BUCKET = 4096


#: Inputs up to this many bytes are dealt to all cores before they are tokenized: one small file is often one row group, which one
#: task would read and tokenize alone. Larger inputs come in many row groups and aren't shuffled.
SMALL_INPUT = 1 << 30


def dealt(df: DataFrame) -> DataFrame:
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL_INPUT else df


def corpus_documents(docs: DataFrame, corpus: str = "lang", doc_id: str = "doc_id", text: str = "text", normalise: bool = True) -> DataFrame:
    """Tokenizes whole texts. Null texts have no sequences."""
    src = dealt(docs.select(F.col(corpus).alias("corpus"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    src = X.nfc(src, "text") if normalise else src
    return src.select("corpus", "doc_id", X.sequences(F.col("text")).alias("seqs"))


def taken_apart(df: DataFrame, array: Column, *keep: str | Column, name: str, place: str | None = None) -> DataFrame:
    """A row for each element of an array (no element is null) beside the kept columns, with its place if that is named. An inner
    explode() would have Spark test the array's size first, below what made it, and so make it twice."""
    each = F.posexplode_outer(array).alias(place, name) if place else F.explode_outer(array).alias(name)
    return df.select(*keep, each).filter(F.col(name).isNotNull())


def sequences(corpora: DataFrame) -> DataFrame:
    """corpus, doc_id, seq, tokens."""
    return taken_apart(corpora, F.col("seqs"), "corpus", "doc_id", name="tokens", place="seq")


def tokens(corpora: DataFrame) -> DataFrame:
    """corpus, doc_id, seq, pos, n, token."""
    seqs = sequences(corpora)
    return taken_apart(seqs, F.col("tokens"), "corpus", "doc_id", "seq", F.size("tokens").alias("n"), name="token", place="pos").select("corpus", "doc_id", "seq", "pos", "n", "token")


def running_before(df: DataFrame, by: str, order: str, value: str, name: str, width: int = BUCKET, then: tuple[str, ...] = ()) -> DataFrame:
    """Adds the sum of value over the rows before, in the order of a whole-number column: buckets of numbers first, then
    the rows of each bucket, so no task holds a whole corpus. Rows with equal numbers come in the order of `then`, else in any."""
    df = df.withColumn("__bucket", F.floor(F.col(order) / width))
    sums = df.groupBy(by, "__bucket").agg(F.sum(value).alias("__sum"))
    before = sums.select(F.col(by).alias("__by"), F.col("__bucket").alias("__b"), (F.sum("__sum").over(W.partitionBy(by).orderBy("__bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("__sum")).alias("__before"))
    inner = df.withColumn("__run", F.sum(value).over(W.partitionBy(by, "__bucket").orderBy(order, *then).rowsBetween(W.unboundedPreceding, 0)) - F.col(value))
    joined = inner.join(before, inner[by].eqNullSafe(before["__by"]) & inner["__bucket"].eqNullSafe(before["__b"]))
    return joined.withColumn(name, F.col("__before") + F.col("__run")).drop("__bucket", "__before", "__run", "__by", "__b")


def types(corpora: DataFrame) -> DataFrame:
    """corpus, token, cnt."""
    return taken_apart(corpora, F.flatten("seqs"), "corpus", name="token").groupBy("corpus", "token").agg(F.count(F.lit(1)).alias("cnt"))


def settled(small: DataFrame) -> DataFrame:
    """A small table that several steps read, worked out once: its lineage is cut, so joins of it with itself don't repeat it."""
    return small.checkpoint() if small.sparkSession.sparkContext.getCheckpointDir() else small.localCheckpoint()


def stored(df: DataFrame) -> DataFrame:
    """A table of any size that several steps read, written once as Parquet beside the checkpoints (without a folder for these, a local
    checkpoint). Plans that read it hold its files; those that read a cached table hold all that made it, once a reader."""
    folder = df.sparkSession.sparkContext.getCheckpointDir()
    if not folder:
        return df.localCheckpoint()
    path = f"{folder}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    df.sparkSession._jvm.System.gc()  # Spark deletes shuffle files of finished steps when the driver collects garbage
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of stored() that nothing reads any more."""
    for table in tables:
        if path := getattr(table, "_stored_at", None):
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Spark cuts each task's rows to the first of each group before the shuffle of a ranking only up to this many.
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def limited(df: DataFrame, top: int) -> DataFrame:
    """Lets rankings to `top` cut each task's rows before they are shuffled, whatever the session's bound."""
    conf = df.sparkSession.conf
    if 0 <= int(conf.get(GROUP_LIMIT, "1000")) < top:
        conf.set(GROUP_LIMIT, str(top))
    return df


#: Rows and bytes of a batch that a Python worker gets.
ARROW_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16m")}


def arrow_limits(spark) -> None:
    """Smaller batches for rows that hold whole texts, unless the session has its own."""
    for name, (default, own) in ARROW_LIMITS.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, own)


def ranked(counts: DataFrame, key: str, top: int, by: str | list[str] = "corpus", count: str = "cnt") -> DataFrame:
    """The top rows of each corpus by count, equal counts by key, with rnk. The limit reaches the sort of each task, so the
    last one gets `top` rows a task and corpus, not a whole corpus."""
    order = W.partitionBy(by).orderBy(F.col(count).desc(), F.col(key).asc())
    return limited(counts, top).withColumn("rnk", F.row_number().over(order)).filter(F.col("rnk") <= top)


def entropy(p: Column) -> Column:
    """Nats of a column of shares."""
    return F.coalesce(-F.sum(F.when(p > 0, p * F.log(p))), F.lit(0.0))
