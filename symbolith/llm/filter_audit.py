"""Interaction audit of document filters with the subset-zeta transform, with DataFrame functions only.

Each document gets a mask, one bit for each filter that it fails. All that an audit of any set of filters needs is, per
part, the number of documents of each mask. The zeta transform sums these counts over all subsets of each mask, one bit
at a time; read at the complement of a set of filters it gives the documents that survive the set. What a step of an
order removes is then the difference between two sets that differ by one filter, and so are lost labels. A Shapley
value weighs these differences of all orders by their number.

The filter of copies asks whether a text's digest (SHA-256; equal digests count as equal texts) stands under a smaller
id. Rows are summed by digest, part and labels before they meet, with the smallest id and its rows, so a text that a
third of all rows share costs a few rows; parts are summed before the shuffle. The result has 600 rows a part.

Cases: a null text counts as empty and a null source as the part ''; copies are counted over the whole table, null texts
equal empty ones, of rows of the smallest id all pass, a null id sorts behind every other; a document is good (toxic) if
any row of labels with its id says so, labels without an id or of no document don't matter; an empty table gives an
empty result; other columns don't matter.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, read

FILTERS = "ABCDE"
COUNTS = ("n", "good", "toxic")


def failures(text: Column) -> list[Column]:
    """The failure conditions of the filters that need the text alone: few words, few distinct words, upper case, symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    sizes = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("k")))[0]
    return [
        sizes.n < 200,
        100 * sizes.k < 50 * sizes.n,
        100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.length(text),
        text.rlike("[#$%&*|]"),
    ]


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Per part and mask of failed filters (bit k for the k-th of FILTERS): part, mask, n, good, toxic."""
    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(part_col, F.lit("")).alias("part"), text.alias("text")).select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"),
        sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(failures(F.col("text")))), F.lit(0)).alias("mask"),
    )
    # rows without an id meet no label, but would all meet in one task of the join
    rows = rows.withColumn("spread", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest", "part"), F.lit(1024))).otherwise(0))
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(name) for name, c in (("good", "quality"), ("toxic", "toxic"))))
    rows = rows.join(marks.withColumn("spread", F.pmod("doc_id", F.lit(1)).cast("bigint")), ["doc_id", "spread"], "left").fillna(False, ["good", "toxic"])
    kind = ["digest", "part", "good", "toxic"]
    # by id first, as the join has dealt them already: the smallest id of a kind then brings the number of its rows
    ids = rows.groupBy("doc_id", "spread", *kind).agg(F.count("*").alias("n"), F.first("mask").alias("mask"))
    kinds = ids.groupBy(*kind).agg(F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("first_n"), F.first("mask").alias("mask"))
    kinds = kinds.withColumn("least", F.min("first").over(Window.partitionBy("digest")))
    passing = F.when(F.col("least").isNull(), F.col("n")).when(F.col("first") == F.col("least"), F.col("first_n")).otherwise(0)
    of = F.explode(F.array(F.struct("mask", passing.alias("n")), F.struct((F.col("mask") + (1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - passing).alias("n"))))
    kept_if = lambda c: F.sum(F.when(F.col(c), F.col("of.n")).otherwise(0)).alias(c)
    return kinds.select("part", "good", "toxic", of.alias("of")).groupBy("part", "of.mask").agg(F.sum("of.n").alias("n"), kept_if("good"), kept_if("toxic"))


def survivors(masked: DataFrame, n_filters: int) -> DataFrame:
    """masked: part, mask, n, good, toxic. Per part three arrays by mask, of the sums over its subsets: at the complement
    of a set of filters stands what survives the set."""
    by_mask = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*COUNTS))))  # one entry a mask
    every = F.sequence(F.lit(0), F.lit((1 << n_filters) - 1))
    out = masked.groupBy("part").agg(by_mask.alias("by_mask"))
    dense = lambda c: F.transform(every, lambda m: F.coalesce(F.col("by_mask")[m][c], F.lit(0)))
    out = out.select("part", *(dense(c).alias(c) for c in COUNTS))
    for bit in (1 << k for k in range(n_filters)):
        out = out.select("part", *(_with_bit(F.col(c), bit).alias(c) for c in COUNTS))
    return out


def _with_bit(sums: Column, bit: int) -> Column:
    """One step of the transform: masks that have the bit get what stands at the mask without it."""
    return F.transform(sums, lambda x, m: x + F.when(m.bitwiseAND(F.lit(bit)) > 0, F.get(sums, m - bit)).otherwise(0))


def audit(masked: DataFrame, filters: str = FILTERS) -> DataFrame:
    """masked: part, mask, n, good, toxic. One row per part, order of all filters and step: part, filter_order, step,
    kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    k = len(filters)
    whole = (1 << k) - 1
    bit = {f: 1 << i for i, f in enumerate(filters)}
    live = lambda c, gone: F.get(F.col(c), F.lit(whole) - gone)  # what survives the filters of the mask gone
    found = survivors(masked, k)

    def shapley(f: str) -> Column:
        terms = []
        for size in range(k):
            for others in combinations([g for g in filters if g != f], size):
                gone = sum(bit[g] for g in others)
                terms.append(factorial(size) * factorial(k - 1 - size) * (live("n", F.lit(gone)) - live("n", F.lit(gone + bit[f]))))
        return sum(terms[1:], terms[0])

    alone = {  # by filter, in their order
        "fails": [live("n", F.lit(0)) - live("n", F.lit(bit[f])) for f in filters],
        "unique": [live("n", F.lit(whole - bit[f])) - live("n", F.lit(whole)) for f in filters],
        "shapley": [shapley(f) for f in filters],
    }
    orders = F.explode(F.array(*(F.lit("".join(p)) for p in permutations(filters))))
    found = found.select("part", *COUNTS, *(F.array(*v).alias(name) for name, v in alone.items()), orders.alias("filter_order"))
    found = found.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    at = lambda step: F.instr(F.lit(filters), F.substring("filter_order", step, 1)) - 1
    before = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0), lambda gone, i: gone + F.when(i < F.col("step"), F.call_function("shiftleft", F.lit(1), at(i))).otherwise(0))
    found = found.withColumn("own", at(F.col("step"))).withColumn("before", before).withColumn("after", F.col("before") + F.call_function("shiftleft", F.lit(1), "own"))
    lost = lambda c: live(c, F.col("before")) - live(c, F.col("after"))
    return found.select(
        "part", "filter_order", "step", live("n", F.col("after")).alias("kept"), lost("n").alias("removed"), (F.get("fails", "own") - lost("n")).alias("redundant"),
        F.get("unique", "own").alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("shapley", "own").alias("shapley"),
    )


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(masks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


ORACLE = r"""
WITH d AS (
  SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w,
         coalesce(min(doc_id) OVER (PARTITION BY coalesce(text, '')) < coalesce(doc_id, 9223372036854775807), false) AS e
  FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), e] AS f
  FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, f),
x AS (SELECT unnest(range(1, 6)) AS i),
o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (
  SELECT part, o, k AS step,
         sum(n) FILTER (NOT list_bool_or(list_transform(o[:k], lambda i: f[i]))) AS kept,
         sum(n) FILTER (f[o[k]] AND NOT coalesce(list_bool_or(list_transform(o[:k - 1], lambda i: f[i])), false)) AS removed,
         sum(n) FILTER (f[o[k]]) AS fails,
         sum(n) FILTER (f[o[k]] AND len(list_filter(f, lambda v: v)) = 1) AS unique_fails,
         sum(good) FILTER (f[o[k]] AND NOT coalesce(list_bool_or(list_transform(o[:k - 1], lambda i: f[i])), false)) AS good_lost,
         sum(toxic) FILTER (f[o[k]] AND NOT coalesce(list_bool_or(list_transform(o[:k - 1], lambda i: f[i])), false)) AS toxic_lost
  FROM c, o, (SELECT unnest(range(1, 6)) AS k) GROUP BY part, o, k)
SELECT part, array_to_string(list_transform(o, lambda i: chr(64 + i::INT)), '') AS filter_order, step::INT AS step,
       coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, (coalesce(fails, 0) - coalesce(removed, 0))::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, o[step]))::BIGINT AS shapley
FROM s
"""
