"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (operator 8), DataFrame functions only.

Every source is cut into the same number of blocks by a keyed hash of the id. Its target in words becomes an exact quota of
block draws: whole epochs of all blocks, then blocks in permuted order as long as they fit, blocks that don't passed over, then
documents of the first blocks that were. The quotas of all sources form the root of a binary tree over the output shards. At each node half of
the draws, taken without replacement, go left: the counts by source that result are multivariate hypergeometric and
add up exactly. A leaf's quota takes the next draws of the source's permuted list, so shards get disjoint draws; inside
a shard the copies are ordered by a keyed hash, their place; the mix is laid out by shard and place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscope.llm.common import WORD_PATTERN, saved

WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
BLOCKS = 1024
#: Blocks of all sources together at most (fewer blocks a source where there are very many sources).
ALL_BLOCKS = 1 << 22
SHARDS = 16
#: Documents of a source that may fill the gap between its whole blocks and its target.
FILL_ROWS = 2000
FILL_ROUNDS = 4
#: Runs of places, as a power of two, that a shard is laid out in; each is sorted by one task.
PIECE_BITS = 6


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _key(source: str) -> Column:
    """A source's name without null: null sorts last and differs from every string."""
    s = F.col(source).cast("string")
    return F.when(s.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), s))


def _last(key: str = "__key") -> list[Column]:
    return [(F.col(key) == "n").asc(), F.col(key).asc()]


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sizes: __key, source_size. Adds target. The weights share the total; a target stops at MOST_EPOCHS times its
    source, and the excess is shared again by weight: the sources in order of what they hold for each unit of weight
    are filled up until the next one holds more than its share."""
    alone = F.lit(0)
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(W.partitionBy(alone).orderBy(*_last())) - 1, F.lit(len(weights))) + 1).cast("int")))
    by_room = W.partitionBy(alone).orderBy((F.col("cap") / F.col("w")).asc(), *_last())
    whole, before = W.partitionBy(alone), by_room.rowsBetween(W.unboundedPreceding, -1)
    level = (
        ranked.withColumn("cap", MOST_EPOCHS * F.col("source_size"))
        .withColumn("left_words", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("open", F.col("cap") * F.col("left_weight") >= F.col("left_words") * F.col("w"))
        .withColumn("first_open", F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("w")).alias("room"), "left_words", "left_weight"))).over(whole))
    )
    share = F.col("first_open.left_words") * F.col("w") / F.col("first_open.left_weight")
    return level.select("__key", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), share), F.col("cap").cast("double")).alias("target"))


def splitting_tree(quotas: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """quotas: __key, k (block draws of the source). Returns __key, ends: for each shard the end of its range in the
    source's list of draws. shards must be a power of two."""
    nodes = quotas.select(F.lit(0).alias("node"), "__key", "k")
    depth = shards.bit_length() - 1
    if 1 << depth != shards:
        raise ValueError("the number of shards must be a power of two")
    for level in range(depth):
        units = nodes.filter("k > 0").select("node", "__key", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))).alias("i"))
        draw = F.xxhash64(F.lit(seed), F.lit(level), "node", "__key", "i")
        ranked = units.withColumn("rank", F.row_number().over(W.partitionBy("node").orderBy(draw, "__key", "i"))).withColumn("all", F.count(F.lit(1)).over(W.partitionBy("node")))
        # An odd number of draws leaves one more on either side by turns.
        goes = F.when(F.col("rank") <= F.floor((F.col("all") + F.pmod(F.col("node"), F.lit(2))) / 2), 0).otherwise(1)
        nodes = ranked.groupBy((F.col("node") * 2 + goes).alias("node"), "__key").agg(F.count(F.lit(1)).alias("k"))
    held = nodes.groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct("node", "k"))).alias("by"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.coalesce(F.element_at(F.col("by"), s), F.lit(0)))
    ends = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda s: F.aggregate(F.slice(F.col("c"), 1, s), F.lit(0).cast("long"), lambda a, x: a + x))
    return held.select("__key", counts.alias("c")).select("__key", ends.alias("ends"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", shards: int = SHARDS, seed: int = 0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """docs with size, source_size, target, copies, taken (copies times size, at most MOST_EPOCHS times size),
    shards, the output shard of each copy, and places, the keys that order the copies in their shards.

    Size: words of the text, 0 for null. Sources in order of code points, null last, have the weights by turns. Only
    whole documents are taken; a source's sum stays below its target by less than the smallest document that the last blocks leave out, as a rule. Everything follows from the seed, the ids and the table, so reruns agree. Equal rows
    count each; which of them gets an extra copy doesn't show. Input columns named like the new ones are replaced.
    An empty table gives an empty result.
    """
    new = ("size", "source_size", "target", "copies", "taken", "shards", "places")
    docs = docs.drop(*[c for c in new if c in docs.columns])
    base = docs.withColumn("__key", _key(source)).withColumn("size", words_in(text))
    n_sources = base.select("__key").distinct().count()
    blocks = max(1, min(BLOCKS, ALL_BLOCKS // max(1, n_sources)))
    in_block = F.pmod(F.xxhash64(F.lit("block"), F.lit(seed), F.col(id_col)), F.lit(blocks)).cast("int")
    base = base.withColumn("__block", in_block)
    rows = saved(base.select("__key", "__block", F.col(id_col).alias("__id"), "size"), "mix-rows")  # all decisions are made on these
    held = saved(rows.groupBy("__key", "__block").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")), "mix-blocks")
    goals = targets(held.groupBy("__key").agg(F.sum("words").alias("source_size")), weights)
    source_size = F.col("source_size")
    epochs = F.when(source_size > 0, F.floor(F.col("target") / source_size)).otherwise(0)
    permuted = (F.xxhash64(F.lit(seed), "__key", "__block"), F.col("__block"))
    rest = held.join(goals, "__key").withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * source_size)
    taken = _fitting(rest, "rest", "words", "whole", permuted).withColumn("whole", F.col("whole") & (F.col("rest") > 0))
    # The first blocks left over, FILL_ROWS documents or one block, fill the gap.
    left_rows = F.when(~F.col("whole"), F.col("rows")).otherwise(0)
    planned = (
        taken.withColumn("behind", F.sum(left_rows).over(W.partitionBy("__key").orderBy(*permuted)))
        .withColumn("gap", F.when(~F.col("whole") & (F.col("rest") > 0) & ((F.col("behind") <= FILL_ROWS) | (F.col("behind") == F.col("rows"))), F.col("room")))
        .withColumn("draws", (F.col("epochs") + F.when(F.col("whole") | F.col("gap").isNotNull(), 1).otherwise(0)).cast("int"))
    )
    planned = saved(planned.select("__key", "__block", "source_size", "target", "epochs", "whole", "gap", "draws"), "mix-plan")
    ends = splitting_tree(planned.groupBy("__key").agg(F.sum("draws").alias("k")).filter("k > 0"), shards, seed)
    draws = planned.filter("draws > 0").select("__key", "__block", F.explode(F.sequence(F.lit(1), F.col("draws"))).alias("e"))
    listed = draws.withColumn("place", F.row_number().over(W.partitionBy("__key").orderBy(F.xxhash64(F.lit(seed + 1), "__key", "__block", "e"), "__block", "e")) - 1).join(ends, "__key")
    to = F.size(F.filter("ends", lambda x: x <= F.col("place")))
    dealt = listed.groupBy("__key", "__block").agg(F.transform(F.array_sort(F.collect_list(F.struct("e", to.alias("shard")))), lambda x: x["shard"]).alias("__to"))
    table = saved(planned.join(dealt, ["__key", "__block"], "left"), "mix-dealt")
    # How many of a block's equal rows (id and size) fill the gap; no text passes this window.
    gaps = planned.filter("gap IS NOT NULL").select("__key", "__block", "gap")
    by_order = (F.xxhash64(F.lit(seed), "__id"), F.col("__id"), F.col("size"))
    filled = _fitting(rows.join(gaps, ["__key", "__block"]), "gap", "size", "in", by_order).filter("in")
    extra = saved(filled.groupBy("__key", "__id", "size").agg(F.count(F.lit(1)).alias("__extra")), "mix-fill")
    named = table.drop("draws").withColumnsRenamed({c: f"__{c}" for c in ("epochs", "whole", "gap")})
    joined = base.join(named, ["__key", "__block"])
    copies = (F.col("__epochs") + F.when(F.col("__whole"), 1).otherwise(0)).cast("int")
    plain = joined.filter(F.col("__gap").isNull()).withColumn("copies", copies)
    cut = joined.filter(F.col("__gap").isNotNull()).withColumn("__nth", F.row_number().over(W.partitionBy("__key", id_col, "size").orderBy(F.lit(0))))
    same = extra.select(F.col("__key").alias("__k"), F.col("__id"), F.col("size").alias("__s"), "__extra")
    cut = cut.join(same, (F.col("__key") == F.col("__k")) & F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("size") == F.col("__s")), "left").drop("__k", "__id", "__s")
    cut = cut.withColumn("copies", (F.col("__epochs") + F.when(F.col("__nth") <= F.col("__extra"), 1).otherwise(0)).cast("int"))
    both = plain.unionByName(cut.drop("__nth", "__extra"))
    own = [c for c in docs.columns]
    shard_list = F.coalesce(F.slice("__to", F.lit(1), F.col("copies")), F.array().cast("array<int>"))
    place_list = F.transform(shard_list, lambda shard, copy: F.xxhash64(F.lit(seed), shard, F.col(id_col), copy))
    return both.select(*own, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), shard_list.alias("shards"), place_list.alias("places"))


def _fitting(rows: DataFrame, room: str, size: str, name: str, order: tuple[Column, ...]) -> DataFrame:
    """Adds `name`, whether a row of a source (__key) is among those that fill its room, and room, what is left of it. Rows are taken in
    order while they fit; in FILL_ROUNDS rounds those behind one that doesn't fit have their turn."""
    of_source = W.partitionBy("__key")
    so_far = of_source.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    left = F.col(room) - F.sum(F.when(F.col(name), F.col(size)).otherwise(0)).over(of_source)
    out = rows.withColumn(name, F.lit(False))
    for _ in range(FILL_ROUNDS):
        out = out.withColumn("__left", left)
        out = out.withColumn("__fits", ~F.col(name) & (F.col(size) <= F.col("__left")))
        out = out.withColumn("__run", F.sum(F.when(F.col("__fits"), F.col(size)).otherwise(0)).over(so_far))
        out = out.withColumn(name, F.col(name) | (F.col("__fits") & (F.col("__run") <= F.col("__left"))))
    return out.withColumn("room", left).drop("__left", "__fits", "__run")


def mixed(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """The mix itself: a row for each copy taken, with docs' columns, shard and place. All columns of docs keep their names and
    values but for shard and place. Rows are laid out by shard and run of places (2 to the power of PIECE_BITS runs a shard, each within one
    partition) and sorted by place there, so whoever reads a shard's runs in turn has it shuffled."""
    used = {text, source, id_col}
    columns = [c for c in docs.columns if c not in ("shard", "place")]
    others = [c for c in columns if c not in used]
    packed = docs.select(*used, F.struct(F.lit(0).alias("__none"), *others).alias("__others"))
    each = mix(packed, text, source, id_col, shards, seed).select(*used, "__others", F.explode(F.arrays_zip("shards", "places")).alias("__to"))
    out = each.select(*(F.col(c) if c in used else F.col("__others").getField(c).alias(c) for c in columns), F.col("__to.shards").alias("shard"), F.col("__to.places").alias("place"))
    return out.repartition("shard", F.shiftright("place", 64 - PIECE_BITS)).sortWithinPartitions("shard", "place")
