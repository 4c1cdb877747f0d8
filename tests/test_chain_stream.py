"""The chained log as a stream, against the batch chain."""

from pyspark.sql import functions as F

from corpuscope.operators import schedule as SC
from corpuscope.streaming import chain as CH

SCHEMA = "run int, i long, p string"


def test_a_stream_links_each_record_once(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = [(r, i, None if i == 4 else f"p{r}-{i}") for r in (1, 2, 3) for i in range(1, 8)]
    put = lambda part: spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(source)

    def step():
        events = spark.readStream.schema(SCHEMA).json(source)
        query = CH.run_chain(spark, events, out, checkpoint, "run", "i", ("p",))
        query.awaitTermination()
        assert query.exception() is None
        return sorted((tuple(r) for r in spark.read.parquet(out).select("run", "position", "sha256", "previous_sha256", "outcome").collect()), key=lambda x: (x[0], x[1], x[4]))

    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    put([x for x in rows if x[1] in (1, 3, 6)])
    first = step()
    assert [x[:2] for x in first] == [("1", 1), ("2", 1), ("3", 1)]  # the others wait for their turn
    assert step() == first  # nothing new, nothing twice
    put([x for x in rows if x[1] in (2, 3, 4, 5) and x[0] < 3] + [(2, 1, "forged"), (None, 1, "nobody"), (3, 0, "early")])
    second = step()
    assert [x[:2] for x in second if x[4] == CH.CHANGED] == [("2", 1)] and sum(x[4] == CH.LINKED for x in second) == 13
    put([x for x in rows if x[0] == 3 or x[1] == 7])
    third = step()
    want = sorted((str(r["run"]), r["i"], r["sha256"], r["previous_sha256"]) for r in SC.chained(spark.createDataFrame(rows, SCHEMA), "run", "i", ("p",)).collect())
    assert [x[:4] for x in third if x[4] == CH.LINKED] == want
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider
    log = spark.read.parquet(out)
    assert CH.broken_chain(log).count() == 0
    forged = log.withColumn("payload", F.when((F.col("run") == "2") & (F.col("position") == 3), "x").otherwise(F.col("payload")))
    assert list(map(tuple, CH.broken_chain(forged).collect())) == [("2", 3)]
    lost = log.filter("NOT (run = '1' AND position = 5 AND outcome = 'linked')")
    assert list(map(tuple, CH.broken_chain(lost).collect())) == [("1", 6)]
