"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources share all tokens by weight, no source above `max_repeats` times what it has. The targets, in equal-token blocks,
are apportioned to sources by highest quotients target / (2k + 1), and each source's blocks go down a tree of its shards
the same way, so every shard knows an integer quota. Within a shard the documents stand in seeded order, their tokens are cut into
blocks, and a seeded permutation says which blocks are taken (all of them as often as the quota allows, then some once more).
All sources are apportioned in blocks of one size: `block_tokens`, or less if the smallest target has not UNITS of them. Blocks
that are that small are selected in groups, so that texts are not scattered word by word.

Bounds. The sources, a small row each, are apportioned in one task.

Cases. A null text has size 0 and nothing is taken of it; a source without tokens gets target 0. A null source is a
source of its own, last in order. Rows that repeat whole are documents of their own: they are counted, numbered and dealt to
shards by a hash with their number. An empty table gives no rows. Columns of the input that bear one of the output's
names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from risklake.llm.common import copies, copy_hash, row_key, settle, table, whole_rows, words

BLOCK_TOKENS = 64
SHARD_TOKENS = 65_536
MAX_REPEATS = 3
SEED = 20
#: A prime beyond any shard's number of blocks: i -> i * STEP + offset permutes the blocks.
STEP = 2_147_483_647
#: Children of a node in the tree that deals a source's blocks to its shards.
FAN_OUT = 64
#: Blocks that the smallest target has at least, and groups of blocks that a shard has at least if its blocks are grouped.
UNITS = 64
GROUPS = 256

NAMES = ("size", "source_size", "target", "taken")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def source_targets(sized: DataFrame, weights: Column, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """sized(source, size) -> source, source_size, source_no, target.

    weights: by source_no, the source's place from 0 (code-point order, null last). Targets that would pass their limit
    stop there, and the excess goes to the others by weight: with sources sorted by limit per weight, those that stop
    are the first ones, and one window over the sources (one row each) finds them."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = sources.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    limit = F.col("source_size") * max_repeats
    by_need = Window.partitionBy(F.lit(1)).orderBy(limit / F.col("weight"), "source_no")
    everything = Window.partitionBy(F.lit(1))
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    leveled = numbered.withColumn("weight", weights).withColumn("level", level).withColumn("stops", limit / F.col("weight") <= F.col("level"))
    open_level = F.first(F.when(~F.col("stops"), F.col("level")), ignorenulls=True).over(by_need.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(F.col("stops"), limit.cast("double")).otherwise(open_level * F.col("weight"))
    return leveled.select("source", "source_size", "source_no", target.alias("target"))


def sainte_lague(claims: DataFrame, group: list[str], share: str, seats: Column, order: str) -> DataFrame:
    """Add quota: `seats` of each group dealt to its rows by the highest quotients share / (2k + 1). A group's shares add up to
    its seats (to within one seat).

    Rounding every share deals out at most n / 2 + 1 seats too few or too many for n rows, and making up for them moves a
    row by no more than its part of 1.5 n + 1 seats, plus one. So each row surely has its share less that slack, only the
    quotients within the slack compete for the rest, and there are about 9 n of them however uneven the shares are."""
    part = Window.partitionBy(F.lit(1), *group)
    part_of = F.coalesce(F.try_divide(F.col(share), F.sum(share).over(part)), F.lit(0.0))
    slack = (F.ceil((1.5 * F.count("*").over(part) + 1) * part_of) + 2).cast("long")
    rivals = claims.withColumn("_slack", slack).withColumn("_sure", F.greatest(F.floor(F.col(share)) - F.col("_slack"), F.lit(0)))
    rivals = rivals.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), 2 * F.col("_slack") + 1)))
    rank = F.row_number().over(part.orderBy((F.col(share) / (2 * (F.col("_sure") + F.col("_k")) + 1)).desc(), order, "_k"))
    spare = seats - F.sum(F.when(F.col("_k") == 0, F.col("_sure"))).over(part)
    won = rivals.withColumn("_won", F.when((rank <= spare) & (F.col(share) > 0), 1).otherwise(0))
    return won.groupBy(*claims.columns).agg((F.first("_sure") + F.sum("_won")).cast("long").alias("quota"))


def shard_quotas(pools: DataFrame, quotas: DataFrame, n_shards: int, fan_out: int = FAN_OUT) -> DataFrame:
    """pools(source_no, _shard, _pool), quotas(source_no, source_size, quota) -> source_no, _shard, _pool, quota.

    A source's seats go down a tree of its shards, `fan_out` to a node, by the same apportionment at every node, so a task
    holds a node's children and never all shards of a source. n_shards: the largest source's, which gives the depth."""
    depth = 1
    while fan_out**depth < n_shards:
        depth += 1
    pools = settle(pools) if depth > 1 else pools
    dealt = quotas.select("source_no", F.lit(0).cast("long").alias("_node"), F.col("source_size").alias("_pool"), "quota")
    for level in reversed(range(depth)):
        above = dealt.select("source_no", F.col("_node").alias("_up"), F.col("_pool").alias("_whole"), F.col("quota").alias("_seats"))
        node = F.floor(F.col("_shard") / fan_out**level).alias("_node")
        nodes = pools.groupBy("source_no", node).agg(F.sum("_pool").alias("_pool")).withColumn("_up", F.floor(F.col("_node") / fan_out))
        share = F.col("_seats") * (F.col("_pool") / F.col("_whole"))
        claims = nodes.join(above, ["source_no", "_up"]).withColumn("_share", share)
        dealt = sainte_lague(claims, ["source_no", "_up"], "_share", F.col("_seats"), "_node")
    return dealt.select("source_no", F.col("_node").cast("int").alias("_shard"), "_pool", "quota")


def _mixed(light: DataFrame, weights: Column, block_tokens: int, shard_tokens: int, seed: int) -> DataFrame:
    """light(doc_id, source, size, ...) -> a row for each row of light: its columns, _lot, _copy, source_size, target, taken, _passes and _spans."""
    counted = light.groupBy(*light.columns).agg(F.count("*").alias("_rows"))
    keyed = settle(copies(counted).withColumn("_key", copy_hash(F.xxhash64(F.lit(seed), "doc_id", "source", "size"))))
    sources = settle(source_targets(keyed, weights))
    n_shards = F.greatest(F.ceil(F.col("source_size") / shard_tokens), F.lit(1))
    shard = F.pmod(F.shiftright("_key", 20), n_shards).cast("int")
    widest, least = sources.agg(F.coalesce(F.max(n_shards), F.lit(1)), F.min(F.when(F.col("target") > 0, F.col("target")))).first()
    unit = max(1, min(block_tokens, int((least or 0) // UNITS)))

    total = F.round(F.sum(F.col("target")).over(Window.partitionBy(F.lit(1))) / unit)
    shares = sources.withColumn("_share", F.col("target") / unit).withColumn("_total", total)
    quotas = sainte_lague(shares, [], "_share", F.col("_total"), "source_no").select("source", "source_no", "source_size", "target", "quota")

    named = sources.withColumnRenamed("source", "_source")
    stream = keyed.join(named, keyed["source"].eqNullSafe(named["_source"])).drop("_source").withColumn("_shard", shard)
    pools = stream.groupBy("source_no", "_shard").agg(F.sum("size").alias("_pool")).filter(F.col("_pool") > 0)
    dealt = shard_quotas(pools, quotas, int(widest))
    blocks = F.ceil(F.col("_pool") / unit).cast("long")
    quota = F.least(F.col("quota"), blocks * MAX_REPEATS)
    group = F.greatest(F.lit(1).cast("long"), F.least(F.lit(block_tokens // unit).cast("long"), F.floor(blocks / GROUPS)))
    extra, groups = quota % blocks, F.ceil(blocks / group).cast("long")
    dealt = dealt.select(
        F.col("source_no").alias("_no"),
        F.col("_shard").alias("_at"),
        F.floor(quota / blocks).cast("int").alias("_passes"),
        group.alias("_group"),
        groups.alias("_groups"),
        F.floor(extra / group).alias("_full"),
        (extra % group).alias("_rest"),
        F.pmod(F.xxhash64(F.lit(seed), "source_no", "_shard"), groups).alias("_offset"),
    )

    upto = F.sum("size").over(Window.partitionBy("source_no", "_shard").orderBy("_key", "doc_id", "size", "_copy").rowsBetween(Window.unboundedPreceding, 0))
    stream = stream.withColumn("_end", upto).withColumn("_start", upto - F.col("size"))
    met = stream.join(dealt, (F.col("source_no") == F.col("_no")) & (F.col("_shard") == F.col("_at")), "left")
    wide = F.col("_group") * unit
    place = lambda g: F.pmod(g * STEP + F.col("_offset"), F.col("_groups"))
    held = lambda g: F.when(place(g) < F.col("_full"), wide).when(place(g) == F.col("_full"), F.col("_rest") * unit).otherwise(F.lit(0))
    first = lambda g: F.greatest(g * wide, F.col("_start"))
    span = lambda g: F.struct(
        (first(g) - F.col("_start")).alias("start"), (F.least(g * wide + held(g), F.col("_end")) - first(g)).alias("length")
    )
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    number = F.sequence(F.floor(F.col("_start") / wide), F.floor((F.col("_end") - 1) / wide))
    some = (F.col("size") > 0) & (F.col("_full") + F.col("_rest") > 0)
    spans = F.when(some, F.filter(F.transform(number, span), lambda x: x["length"] > 0)).otherwise(none)
    once_more = F.aggregate("_spans", F.lit(0).cast("long"), lambda total, x: total + x["length"])
    met = met.withColumn("_passes", F.coalesce("_passes", F.lit(0))).withColumn("_spans", F.coalesce(spans, none))
    met = met.withColumn("taken", F.col("size") * F.col("_passes") + once_more)
    return met.select(*light.columns, "_lot", "_copy", "source_size", "target", "taken", "_passes", "_spans")


def _whole(docs: DataFrame, size: Column, weights: Column, block_tokens: int, shard_tokens: int, seed: int) -> DataFrame:
    """The mix of docs, with each row's columns as the struct _doc: light rows are mixed and meet the whole ones by a hash of all columns."""
    light = docs.select(*row_key(docs), "doc_id", "source", size.alias("size"))
    mixed = _mixed(light, weights, block_tokens, shard_tokens, seed)
    return mixed.join(whole_rows(docs, docs.columns), ["_a", "_b", "_lot"])


def mix(docs: DataFrame, weights: Column, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, seed: int = SEED) -> DataFrame:
    """docs(doc_id, source, size, ...) -> docs with source_size, target, taken (tokens, repeats counted), _passes (times all of
    the document is taken) and _spans (structs of start and length, in tokens: what is taken once more)."""
    added = ("source_size", "target", "taken", "_passes", "_spans")
    columns = [c for c in docs.columns if c not in added]
    found = _whole(docs, F.col("size"), weights, block_tokens, shard_tokens, seed)
    return found.select(*[F.col("_doc")[c].alias(c) for c in columns], *added)


def cyclic_weights() -> Column:
    """1, 2, 3 and again, in the sources' order."""
    return F.col("source_no") % 3 + 1


def mixed_documents(docs: DataFrame, weights: Column | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The mix itself, in the columns of docs: a row for each time that a document is taken whole, its text unchanged, and a
    row with the words of its remaining blocks, if any; n_chars follows the text. Documents of which nothing is taken, and
    so those without words, are left out."""
    columns = docs.columns
    mixed = _whole(docs, word_count(F.col("text")), cyclic_weights() if weights is None else weights, block_tokens, SHARD_TOKENS, SEED)
    covered = F.aggregate("_spans", F.lit(0).cast("long"), lambda total, x: total + x["length"])
    part = F.array_join(F.flatten(F.transform("_spans", lambda x: F.slice(F.col("_words"), (x["start"] + 1).cast("int"), x["length"].cast("int")))), " ")
    times = F.col("_passes") + F.when(covered > 0, 1).otherwise(0)
    rows = mixed.filter(F.col("taken") > 0).withColumn("_words", words(F.col("_doc")["text"])).withColumn("_turn", F.explode(F.sequence(F.lit(1), times)))
    whole = (F.col("_turn") <= F.col("_passes")) | (covered == F.col("size"))
    rows = rows.withColumn("_text", F.when(whole, F.col("_doc")["text"]).otherwise(part))
    made = {"text": F.col("_text"), "n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType if "n_chars" in columns else "long")}
    return rows.select(*[made.get(c, F.col("_doc")[c]).alias(c) for c in columns])


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = _mixed(docs, cyclic_weights(), BLOCK_TOKENS, SHARD_TOKENS, SEED)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
