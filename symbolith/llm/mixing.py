"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, with DataFrame functions only.

Sizes are words. Sources by code point, null last, weigh WEIGHTS in turn and share all words; a target stops at
MOST times its source's words and the excess is shared anew by weight: the targets are min(cap, level * weight)
at the one level that spends everything. Each source is dealt into LEAST_BLOCKS blocks, or more of about BLOCK_WORDS words, by a
hash of the document id. Its quota is an exact number of block draws: whole passes over all its blocks and a last one over as
many blocks, in permuted order, as the rest of the target wants. A binary tree then deals all quotas out to the output shards: at
each node the left half gets a multivariate-hypergeometric draw from the node's quotas, the right half the rest. The draws of a
source are permuted, and each shard takes as many of them as the tree gave it, so shards are disjoint. What the draws have
in excess of the target is taken off from the last ones of the last shards that hold the source. A shard orders its draws and the
documents inside them by hash; the mix is written by shard in that order.

Windows run over one row per source, over the blocks of a source, and over the documents of a block; no task gets the
documents of a source. The tree holds one row per node with one number per source: sources are thousands at most. All random
choices are hashes of the seed, so reruns agree, on any number of executors.

Cases: a null text has no words and is never taken; a null source is a source of its own; a null id is an id like
any other; equal rows share their group's words in an arbitrary order that shows in no result; an empty table
gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW_KEY, WORD, keyed, stash

WEIGHTS, MOST, SEED = (5, 2, 1), 3, 17
LEAST_BLOCKS, BLOCK_WORDS, LEAST_LEVELS, SHARD_WORDS = 1024, 2_000_000, 4, 16_000_000


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """Per row: ROW_KEY, doc_id, source, size, and the document's hash."""
    return keyed(docs).select(
        *ROW_KEY, F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"),
    )


def blocked(rows: DataFrame, least: int, words: int, seed: int) -> DataFrame:
    """sizes() with each row's block; larger sources have more blocks."""
    n = rows.groupBy(F.col("source").alias("s")).agg(F.greatest(F.lit(least), F.ceil(F.sum("size") / words)).cast("long").alias("n"))
    return rows.join(n, rows["source"].eqNullSafe(n["s"])).withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "h"), F.col("n"))).drop("s", "n")


def targets(block_sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source: rank, source_size, target. Windows here run over one row per source."""
    total = block_sizes.groupBy("source").agg(F.sum("block_size").alias("source_size"), F.count("*").alias("n_blocks"))
    ranked = total.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int")).cast("double")
    ranked = ranked.withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double"))
    full = F.col("cap") / F.col("weight")
    w = Window.orderBy(full, "rank")
    capped = F.coalesce(F.sum("cap").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_ = F.sum("weight").over(w.rowsBetween(0, Window.unboundedFollowing))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - capped) / open_
    found = ranked.withColumn("level", level).withColumn("fits", F.when(F.col("level") <= full, F.col("level")))
    return found.select(
        "source", "rank", "source_size", "n_blocks",
        F.coalesce(F.least("cap", F.max("fits").over(every) * F.col("weight")), F.col("cap")).alias("target"),
    )


def quotas(block_sizes: DataFrame, target: DataFrame, seed: int) -> DataFrame:
    """Per block: the whole passes over its source, whether it is drawn once more, and the source's words to take off then."""
    goal = F.floor(F.col("target") + 0.5).cast("long")
    w = Window.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed + 2), "rank", "block"), "block")
    joined = block_sizes.join(target, block_sizes["source"].eqNullSafe(target["source"])).select(
        target["source"], "rank", "block", "block_size", "source_size", "n_blocks", "target"
    )
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    rest = goal - F.col("passes") * F.col("source_size")
    more = F.when(F.col("more"), F.col("block_size")).otherwise(0)
    return (
        joined.withColumn("passes", F.least(passes, F.lit(MOST).cast("long")))
        .withColumn("before", F.coalesce(F.sum("block_size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("more", (F.col("before") < rest) & (F.col("block_size") > 0))
        .withColumn("excess", F.sum(more).over(Window.partitionBy("rank")) - rest)
        .select("source", "rank", "block", "block_size", "passes", "more", "excess")
    )


#: One hypergeometric draw: successes among n of N, K of them good, at uniform u. The distribution is summed
#: over twelve deviations and twelve more around its mean; what lies beyond is less than a double can tell from
#: nothing. aggregate(array(x), 0, (_, name) -> ...) names a value.
_DRAW = """
aggregate(array(named_struct('pool', {N}, 'good', {K}, 'want', {n}, 'u', {u}, 'mean', {n} * {K} / greatest({N}, 1L),
    'far', 12 + 12 * sqrt({n} * {K} / greatest({N}, 1L) * ({N} - {K}) / greatest({N}, 1L) * ({N} - {n}) / greatest({N} - 1, 1L)))), 0L, (_, a) ->
  aggregate(array(named_struct(
      'lo', greatest(0L, a.want - (a.pool - a.good), cast(floor(a.mean - a.far) as bigint)),
      'hi', least(a.want, a.good, cast(ceil(a.mean + a.far) as bigint)))), 0L, (_, b) ->
    aggregate(array(aggregate(sequence(b.lo, b.hi), named_struct('p', 1D, 's', 0D), (c, k) -> named_struct(
        'p', c.p * (a.good - k) * (a.want - k) / ((k + 1D) * (a.pool - a.good - a.want + k + 1D)), 's', c.s + c.p)).s), 0L, (_, total) ->
      aggregate(sequence(b.lo, b.hi), named_struct('p', 1D, 's', 0D, 'at', b.lo), (c, k) -> named_struct(
        'p', c.p * (a.good - k) * (a.want - k) / ((k + 1D) * (a.pool - a.good - a.want + k + 1D)),
        's', c.s + c.p,
        'at', if(c.s <= a.u * total, k, c.at))).at)))
"""


def _left(seed: int) -> Column:
    """Of the array `quota` of a node, what goes left, as an array of the same length."""
    u = f"((xxhash64({seed}L, node, size(acc.taken)) & 9007199254740991L) / 9007199254740992D)"
    draw = _DRAW.format(N="acc.rest", K="q", n="acc.want", u=u)
    return F.expr(
        "aggregate(quota, named_struct('rest', aggregate(quota, 0L, (a, q) -> a + q), 'want', aggregate(quota, 0L, (a, q) -> a + q) div 2, 'taken', cast(array() as array<bigint>)),"
        f" (acc, q) -> aggregate(array({draw}), acc, (o, x) -> named_struct('rest', o.rest - q, 'want', o.want - x, 'taken', array_append(o.taken, x))), acc -> acc.taken)"
    )


def shard_quotas(per_source: DataFrame, levels: int, seed: int) -> DataFrame:
    """per_source: rank, draws. Per source and shard: rank, shard, start and end of the shard's draw numbers."""
    node = per_source.agg(F.sort_array(F.collect_list(F.struct("rank", "draws"))).alias("q")).select(
        F.lit(0).cast("long").alias("node"), F.col("q.draws").alias("quota")
    )
    for _ in range(levels):
        split = node.withColumn("left", _left(seed + 3))
        sides = F.array(
            F.struct((2 * F.col("node")).alias("node"), F.col("left").alias("quota")),
            F.struct((2 * F.col("node") + 1).alias("node"), F.zip_with("quota", "left", lambda a, b: a - b).alias("quota")),
        )
        node = split.select(F.explode(sides).alias("s")).select("s.*")
    leaf = node.select("node", F.posexplode("quota").alias("rank", "share"))
    end = F.sum("share").over(Window.partitionBy("rank").orderBy("node"))
    return leaf.select("rank", F.col("node").alias("shard"), (end - F.col("share")).alias("start"), end.alias("end"))


def draws(quota: DataFrame, levels: int, seed: int) -> DataFrame:
    """One row per block draw: source, block, shard, place (a hash to order a shard by), words, partial."""
    times = F.col("passes") + F.col("more").cast("long")
    drawn = quota.filter(times > 0).withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    n = F.row_number().over(Window.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed + 4), "rank", "block", "pass"), "block", "pass")) - 1
    drawn = drawn.withColumn("n", n.cast("long"))
    share = shard_quotas(quota.groupBy("rank").agg(F.sum(times).alias("draws")), levels, seed)
    dealt = share.filter("end > start").select("rank", "shard", F.explode(F.sequence("start", F.col("end") - 1)).alias("n"))
    known = drawn.join(dealt, ["rank", "n"]).withColumn("place", F.xxhash64(F.lit(seed + 5), "rank", "n"))
    behind = Window.partitionBy("rank").orderBy(F.col("shard").desc(), F.col("place").desc(), F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    off = F.greatest(F.lit(0), F.least(F.col("excess") - F.coalesce(F.sum("block_size").over(behind), F.lit(0)), F.col("block_size")))
    return known.withColumn("off", off).select("source", "block", "shard", "place", (F.col("block_size") - F.col("off")).alias("words"), (F.col("off") > 0).alias("partial"))


def plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    blocks: int = LEAST_BLOCKS, block_words: int = BLOCK_WORDS, levels: int | None = None, seed: int = SEED,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sizes of all rows with their place in their block, the targets of the sources, and the block draws."""
    rows = blocked(stash(sizes(docs, id_col, text_col, source_col, seed), "sizes"), blocks, block_words, seed)
    block_sizes = stash(rows.groupBy("source", "block").agg(F.sum("size").alias("block_size")), "blocks")
    target = stash(targets(block_sizes), "targets")
    if levels is None:
        levels = max(LEAST_LEVELS, ((target.agg(F.sum("source_size")).first()[0] or 0) // SHARD_WORDS).bit_length())
    drawn = stash(draws(quotas(block_sizes, target, seed), levels, seed), "draws")
    w = Window.partitionBy("source", "block").orderBy("h", "doc_id", "size", *ROW_KEY)
    placed = rows.withColumn("offset", F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per_block = drawn.groupBy(F.col("source").alias("s"), F.col("block").alias("b")).agg(F.sort_array(F.collect_list(F.struct("shard", "place", "words", "partial"))).alias("draws"))
    placed = placed.join(per_block, placed["source"].eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left").drop("s", "b")
    # of each draw of its block the words that a document gives; a block has MOST draws at most
    own = F.transform(
        F.coalesce("draws", F.array()),
        lambda d: F.struct(
            d["shard"].alias("shard"), F.xxhash64(d["place"], "h").alias("place"),
            F.when(d["partial"], F.greatest(F.lit(0), F.least(d["words"] - F.col("offset"), F.col("size")))).otherwise(F.col("size")).alias("taken"),
        ),
    )
    return placed.withColumn("draws", F.filter(own, lambda d: d["taken"] > 0)), target, drawn


def _copies(docs: DataFrame, **how) -> DataFrame:
    """ROW_KEY, __size, __shard, __place and __taken of each draw of each row of docs that takes words."""
    placed, _, _ = plan(docs, **how)
    one = placed.select(*ROW_KEY, F.col("size").alias("__size"), F.explode("draws").alias("d"))
    return one.select(*ROW_KEY, "__size", F.col("d.shard").alias("__shard"), F.col("d.place").alias("__place"), F.col("d.taken").alias("__taken"))


def _shuffled(rows: DataFrame) -> DataFrame:
    """Rows by shard, each shard in the order of its places, a sixteenth of them together."""
    return rows.repartition("__shard", F.shiftright("__place", 60)).sortWithinPartitions("__shard", "__place")


def mixture(docs: DataFrame, **how) -> DataFrame:
    """The mix, by shard and place: a row for each draw of each document, with all columns of docs but such as are named shard,
    place or taken, and with shard, place (a hash that orders the shard) and taken words. Of a document in which a partial draw
    ends only the first words are taken."""
    docs = keyed(docs)
    added = {"__shard": "shard", "__place": "place", "__taken": "taken"}
    rest = [c for c in docs.columns if c not in (*ROW_KEY, *added.values())]
    return _shuffled(docs.join(_copies(docs, **how), ROW_KEY)).select(*rest, *(F.col(k).alias(v) for k, v in added.items()))


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as whole documents, by shard and place: of a document taken in part at least half of its words must be taken."""
    docs = keyed(docs)
    whole = _copies(docs, **how).filter("2 * __taken >= __size").drop("__size", "__taken")
    return _shuffled(docs.join(whole, ROW_KEY)).drop(*ROW_KEY, "__shard", "__place")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    placed, target, _ = plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    known = target.select(F.col("source").alias("t"), "source_size", "target")
    shards = F.array_join(F.transform("draws", lambda d: F.concat_ws(":", d["shard"].cast("string"), d["taken"].cast("string"))), ",")
    return placed.join(known, placed["source"].eqNullSafe(F.col("t"))).select(
        "doc_id", "size", "source_size", "target", F.expr("aggregate(draws, 0L, (a, d) -> a + d.taken)").alias("taken"), shards.alias("shards")
    )
