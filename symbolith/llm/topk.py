"""Exact search for the highest inner products by pivot-table elimination.

Components become whole numbers, floor(1024 x). PIVOTS rows of a bounded sample, each as far as can be from those before,
are the pivots; every row's distances to all of them are written down once. Distances obey the triangle inequality: two
rows are at least max |d(q, p) - d(c, p)| apart, over all pivots p. As 2 q.c = |q|^2 + |c|^2 - d(q, c)^2, this lower
bound of the distance is an upper bound of the score.

Rows are dealt into bases, by the nearest pivot and the distance from it; a base has the least and largest distance of its
rows to each pivot, which bounds all its scores at once. A query first visits the base of the best bound for a score that
its last result has at least, then all bases whose bound reaches that score. In a base, pivots rule out candidates
a few at a time, and what is left is scored in the order of bounds, until the next bound is below the last result. Pivots, bases
and sample change only how much is ruled out: results are exact, ties included.

Bases have at most BASES rows of bounds whatever the input, so they travel with the tasks. A base meets the queries that
visit it in tiles of about ROWS rows by ROWS queries, so no task holds more, whatever repeats. Work grows with what the bounds leave:
vectors spread evenly in many dimensions are hardly ruled out, and each query then scores nearly all rows.

Cases: vectors that are null or hold a null or a number that isn't finite take no part; shorter vectors count as filled
up with zeros, an empty one too; a null id is no query and stands behind the others in ties; of rows with one id each is a row of
its own, and only the query's own row is left out; fewer than k candidates give fewer rows, none give none; an empty table gives an
empty result; other columns don't matter. Whole numbers whose squares sum up to 2^62 or more stop the query.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW_FILE, ROW_INDEX, keyed, read, ship, stash

PIVOTS, SAMPLE, BASES, BASE_ROWS, ROWS = 32, 1024, 512, 4096, 32768
_KEY = ["file", "row"]


def whole(vectors: DataFrame, query: Column, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows that take part: file, row, id, query, v (whole numbers), norm (the sum of their squares)."""
    finite = F.forall(vec_col, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    v = F.transform(vec_col, lambda x: F.floor(x.cast("double") * 1024).cast("double"))
    return (
        keyed(vectors.select(id_col, vec_col))
        .filter(F.col(vec_col).isNotNull() & finite)
        .select(F.xxhash64(ROW_FILE).alias("file"), F.col(ROW_INDEX).alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(query, F.lit(False)).alias("query"), v.alias("v"))
        .withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    )


def dense(column, width: int, kind) -> np.ndarray:
    """A list column as a matrix; short rows are filled up with zeros."""
    lists = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    values, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    if (sizes == width).all():
        return values.reshape(len(sizes), width).astype(kind)
    out = np.zeros((len(sizes), width), kind)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0).astype(np.float64))


def farthest(rows: np.ndarray, n: int) -> np.ndarray:
    """n of the rows, each as far as can be from those taken before; fewer if fewer differ."""
    taken = [0]
    near = distances(rows, rows[:1])[:, 0]
    while len(taken) < n and near.max() > 0:
        taken.append(int(near.argmax()))
        near = np.minimum(near, distances(rows, rows[taken[-1:]])[:, 0])
    return rows[taken]


def visit(query, candidates, k: int, floor: float, own: int) -> list[int]:
    """The places of the k best candidates. query: vector, norm, distances; candidates: matrix, norms, distances, ids (null ones
    the largest). floor: a score that the k-th result has at least. own: the place of the query's own row, or -1."""
    q, norm, d = query
    c, norms, table, ids = candidates
    slack = 1 + 1e-9 * (norm + norms)  # what rounding of distances can cost, many times over
    alive, low = np.arange(len(c)), np.zeros(len(c))
    for at in range(0, len(d), 4):
        low = np.maximum(low, np.abs(table[alive, at : at + 4] - d[at : at + 4]).max(1))
        bound = (norm + norms[alive] - low * low) / 2 + slack[alive]
        keep = bound >= floor
        if not keep.all():
            alive, low, bound = alive[keep], low[keep], bound[keep]
    if own >= 0:
        bound = bound[alive != own]
        alive = alive[alive != own]
    order = np.argsort(-bound, kind="stable")
    alive, bound = alive[order], bound[order]
    best, score, at, step = np.zeros(0, np.int64), np.zeros(0, c.dtype), 0, 4 * k
    while at < len(alive) and bound[at] >= floor:
        some = alive[at : at + step]
        best, score = np.r_[best, some], np.r_[score, c[some] @ q]
        first = np.lexsort((ids[best], -score))[:k]
        best, score = best[first], score[first]
        if len(best) == k:
            floor = max(floor, score[-1])
        at, step = at + step, step * 2
    return list(zip(best.tolist(), score.tolist(), strict=True))


def topk(vectors: DataFrame, query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Of each row that the condition query holds for, its k best of all other rows: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    ship(spark)
    rows = whole(vectors, query, id_col, vec_col)
    size, width, largest = rows.agg(F.count("*"), F.max(F.size("v")), F.max("norm")).first()
    if not size:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if largest >= 2**62:
        raise ValueError("inner products of these vectors leave 64 bits")
    kind = np.float64 if largest < 2**51 else np.int64  # sums of whole numbers are exact in either
    sample = [r.v for r in rows.orderBy(F.xxhash64(*_KEY), *_KEY).select("v").take(SAMPLE)]
    points = np.zeros((len(sample), width), kind)
    for at, v in enumerate(sample):
        points[at, : len(v)] = v
    pivots = farthest(points, PIVOTS)
    cells = max(1, min(len(pivots), size // BASE_ROWS))
    rings = max(1, min(BASES // cells, size // BASE_ROWS // cells))
    near = distances(points, pivots[:cells])
    rims = [np.quantile(own, np.arange(1, rings) / rings) if len(own := near[near.argmin(1) == x].min(1, initial=np.inf)) else np.zeros(rings - 1) for x in range(cells)]

    def measured(batches):
        import pyarrow as pa

        for batch in batches:
            d = distances(dense(batch.column("v"), width, kind), pivots)
            cell = d[:, :cells].argmin(1)
            ring = np.array([np.searchsorted(rims[x], y) for x, y in zip(cell, d[np.arange(len(d)), cell], strict=True)], np.int64)
            table = pa.ListArray.from_arrays(np.arange(0, d.size + 1, len(pivots), dtype=np.int32), d.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, table, pa.array(cell * rings + ring, pa.int64())], [*batch.schema.names, "d", "base"])

    table = stash(rows.mapInArrow(measured, "file long, row long, id long, query boolean, v array<double>, norm double, d array<double>, base long"), "pivot-table")
    edges = table.groupBy("base").agg(F.count("*").alias("n"), F.max("norm").alias("norm"), *(f(F.col("d")[i]).alias(f"{name}{i}") for name, f in (("lo", F.min), ("hi", F.max)) for i in range(len(pivots))))
    edges = edges.collect()  # BASES rows at most
    lo, hi = (np.array([[e[f"{name}{i}"] for i in range(len(pivots))] for e in edges]) for name in ("lo", "hi"))
    base, chunks, norms = np.array([e.base for e in edges]), np.array([-(-e.n // ROWS) for e in edges]), np.array([e.norm for e in edges])
    n_queries = table.filter("query").count()
    tiles = max(1, -(-n_queries // ROWS))

    def route(first: bool):
        """Queries to the base of their best bound, or to all bases whose bound reaches their floor."""

        def over(batches):
            import pyarrow as pa

            for whole_batch in batches:
                for start in range(0, whole_batch.num_rows, 256):
                    batch = whole_batch.slice(start, 256)
                    d, norm, floor = dense(batch.column("d"), len(pivots), np.float64), batch.column("norm").to_numpy(), batch.column("floor").to_numpy()
                    low = np.zeros((len(d), len(base)))
                    for i in range(len(pivots)):
                        np.maximum(low, np.maximum(lo[:, i] - d[:, i, None], d[:, i, None] - hi[:, i]), out=low)
                    bound = (norm[:, None] + norms - low * low) / 2 + 1 + 1e-9 * (norm[:, None] + norms)
                    goes = np.zeros(bound.shape, bool)
                    goes[np.arange(len(d)), bound.argmax(1)] = True
                    if not first:
                        goes = bound >= floor[:, None]
                    q, b = np.nonzero(goes)
                    n = np.ones(len(b), np.int64) if first else chunks[b]
                    q, b, chunk = np.repeat(q, n), np.repeat(b, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(q)).columns, pa.array(base[b]), pa.array(chunk)], [*batch.schema.names, "base", "chunk"])

        return over

    def compare(first: bool):
        """What a tile of queries finds in a chunk of a base: each query with its floor, or its results."""

        def over(left, right):
            import pyarrow as pa

            ids = right.column("id")
            names = np.where(ids.is_null(), np.iinfo(np.int64).max, ids.fill_null(0)), np.asarray(ids.is_null())
            rank = np.empty(len(ids), np.int64)  # ids in order, nulls behind
            rank[np.lexsort(names)] = np.arange(len(ids))
            candidates = dense(right.column("v"), width, kind), right.column("norm").to_numpy(), dense(right.column("d"), len(pivots), np.float64), rank
            place = {key: at for at, key in enumerate(zip(right.column("file").to_pylist(), right.column("row").to_pylist(), strict=True))}
            v, d = dense(left.column("v"), width, kind), dense(left.column("d"), len(pivots), np.float64)
            keys = list(zip(left.column("file").to_pylist(), left.column("row").to_pylist(), strict=True))
            norm, floor = left.column("norm").to_numpy(), left.column("floor").to_numpy()
            found = [visit((v[i], norm[i], d[i]), candidates, k, floor[i], place.get(keys[i], -1)) for i in range(len(keys))]
            if first:
                floor = [float(x[-1][1]) if len(x) == k else float("-inf") for x in found]
                return left.drop(["base", "chunk", "tile", "floor"]).append_column("floor", pa.array(floor, pa.float64()))
            at = np.repeat(np.arange(len(keys)), [len(x) for x in found])
            hits = [y for x in found for y in x]
            out = left.select(["file", "row", "id"]).take(pa.array(at))
            return pa.table([*out.columns, ids.take(pa.array([p for p, _ in hits], pa.int64())), pa.array([int(s) for _, s in hits], pa.int64())], names=["file", "row", "query_id", "vec_id", "score"])

        return over

    tile = F.pmod(F.xxhash64(*_KEY), F.lit(tiles))
    split = F.element_at(F.create_map(*(F.lit(int(x)) for e in edges for x in (e.base, -(-e.n // ROWS)))), F.col("base"))
    stored = table.select("file", "row", "id", "v", "norm", "d", "base").withColumn("chunk", F.pmod(F.xxhash64(*_KEY, F.lit(1)), split))
    asked = table.filter("query").select("file", "row", "id", "v", "norm", "d", F.lit(float("-inf")).alias("floor"))
    fields, where = "file long, row long, id long, v array<double>, norm double, d array<double>, floor double", ["base", "chunk", "tile"]

    def meet(queries: DataFrame, first: bool, schema: str) -> DataFrame:
        went = queries.mapInArrow(route(first), f"{fields}, base long, chunk long").withColumn("tile", tile)
        if tiles == 1:
            all_rows = stored.withColumn("tile", F.lit(0).cast("long"))
        else:  # a chunk goes to the tiles of which a query visits it
            wanted = went.select(*(F.col(c).alias(c) for c in where)).distinct()
            all_rows = stored.join(wanted, ["base", "chunk"])
        return went.groupBy(*where).cogroup(all_rows.groupBy(*where)).applyInArrow(compare(first), schema)

    floors = stash(meet(asked, True, fields), "floors")
    found = meet(floors, False, "file long, row long, query_id long, vec_id long, score long")
    order = Window.partitionBy(*_KEY).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_topk(spark, sf_dir: str) -> DataFrame:
    return topk(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE = r"""
WITH v AS (
  SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
s AS (
  SELECT q.k, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.k <> c.k WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
