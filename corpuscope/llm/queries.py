"""The query of each operator over its whole table, and the SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm import align, bpe, divergence, lattice, media, mixing, packing, pii, quality, repeats, secrets, sharding, simhash
from corpuscope.llm.common import documents


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir))


def op2_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "linked")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir), passages=True)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pii.pseudonymise(docs, pii.session_key(docs))


def op5_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select("doc_id", *quality.COUNTS, "base_failed", "kept", "distance")


def op6_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(documents(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies", "shards", "places")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return secrets.scan(docs, secrets.train(secrets.labelled_samples(docs, labels)))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.aligned(documents(spark, sf_dir))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_label_propagation": op2_label_propagation,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_pii": op4_pii,
    "op5_quality_outliers": op5_quality_outliers,
    "op6_lattice_likelihood": op6_lattice_likelihood,
    "op7_simhash": op7_simhash,
    "op8_mixing": op8_mixing,
    "op9_media_columns": op9_media_columns,
    "op10_secrets": op10_secrets,
    "op11_source_divergence": op11_source_divergence,
    "op12_alignment": op12_alignment,
    "op13_packing": op13_packing,
}

#: Every number is exact in both; products are formed in 128 bits.
OP11_SQL = r"""
with d as (select coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as i from documents),
words as (select lang, source, i, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term from words group by lang, term having count(distinct i) >= 10),
groups as (select distinct lang, source from d),
counted as (select lang, source, term, count(*) as c from words join kept using (lang, term) group by lang, source, term),
v as (select lang, count(*) as v from kept group by lang),
n as (select lang, source, sum(c) as n from counted group by lang, source),
p as (select g.lang, g.source, k.term, coalesce(c.c, 0) as c, 1 + (1000000000::hugeint * (coalesce(c.c, 0) + 2)) // (coalesce(n.n, 0) + 2 * v.v) as p
  from groups g join kept k on k.lang = g.lang join v on v.lang = g.lang left join counted c on c.lang = g.lang and c.source = g.source and c.term = k.term left join n on n.lang = g.lang and n.source = g.source),
q as (select lang, term, 1 + (1000000000::hugeint * (c + 2)) // (sum(c) over (partition by lang) + 2 * count(*) over (partition by lang)) as q from (select lang, term, sum(c) as c from counted group by lang, term)),
sums as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select p.lang, p.source, 'term' as part, p.term as item, ((p.p - q.q) * (p.p - q.q)) // (p.p + q.q) as value from p join q using (lang, term) where p.c > 0 and p.p > q.q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 10
"""

ORACLES: dict[str, str] = {"op11_source_divergence": OP11_SQL}
