"""Exact deduplication by content-defined chunk recipes, with DataFrame functions only.

Each text loses its ASCII white space and is cut into chunks where its content says so: after at least
MIN_CHUNK characters, behind three characters in a row of a fixed class, at MAX_CHUNK at the latest. A chunk's
identifier is its SHA-256; identifiers are verified by aggregating an independent hash and the length of all
chunks that bear one, and the run stops if two different chunks ever share one. A text is then its recipe, the
ordered list of identifiers, 32 bytes for some hundreds of characters. Recipes, not texts, are shuffled and
compared; the texts are read once and never move.

Cases: a null text counts as empty; empty texts equal one another; equal rows are told apart by the file and
position they were read from, so one row of a group stays even when ids repeat; a null id sorts behind every
other id; an empty table gives an empty result; other columns are ignored by the digest and kept by the filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW_FILE, ROW_INDEX, ROW_KEY, SPACE, keyed, stash

MIN_CHUNK, MAX_CHUNK = 256, 2048
#: Characters whose code leaves 5 when divided by 8, of ASCII and Latin-1: an arbitrary class of about an eighth.
_CLASS = "".join(f"\\x{c:02x}" for c in range(0x25, 0x100, 8))
CHUNK = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 3}}}?[{_CLASS}]{{3}}|.{{1,{MAX_CHUNK}}}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its key, id, code points, text_sha256 and chunks (id, n, x)."""
    text = normalised(F.col(text_col))
    return (
        keyed(docs)
        .select(*ROW_KEY, F.col(id_col).alias("doc_id"), F.coalesce(F.length(text_col), F.lit(0)).alias("n_points"), text.alias("t"))
        .select(
            *ROW_KEY, "doc_id", "n_points",
            F.sha2("t", 256).alias("text_sha256"),
            F.transform(
                F.regexp_extract_all("t", F.lit(CHUNK), F.lit(0)),
                lambda c: F.struct(F.unhex(F.sha2(c, 256)).alias("id"), F.length(c).alias("n"), F.xxhash64(c).alias("x")),
            ).alias("chunks"),
        )
    )


def verify(digest: DataFrame) -> None:
    """Stop if one identifier stands for two different chunks."""
    chunk = digest.select(F.explode("chunks").alias("c")).select("c.*")
    odd = (
        chunk.groupBy("id")
        .agg(F.min("n").alias("a"), F.max("n").alias("b"), F.min("x").alias("c"), F.max("x").alias("d"))
        .filter("a <> b or c <> d")
        .limit(1)
    )
    if not odd.isEmpty():
        raise ValueError("two different chunks share a SHA-256 identifier")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: ROW_KEY, doc_id, keep_id, group_size, kept, text_sha256."""
    digest = stash(digests(docs, id_col, text_col), "digests")
    verify(digest)
    rows = digest.withColumn("recipe", F.col("chunks.id")).drop("chunks")
    first = F.struct(
        (-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", *ROW_KEY
    )  # the smallest of these stays
    # written first: then a recipe that very many rows share is a skewed join of two tables, which Spark splits
    best = stash(rows.groupBy("recipe").agg(F.min(first).alias("best"), F.count("*").alias("group_size")), "groups")
    return rows.join(best, "recipe").select(
        *ROW_KEY, "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        ((F.col(ROW_FILE) == F.col(f"best.{ROW_FILE}")) & (F.col(ROW_INDEX) == F.col(f"best.{ROW_INDEX}"))).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text equals that of a row that stays; all columns are kept."""
    docs = keyed(docs)
    lost = groups(docs, id_col, text_col).filter(~F.col("kept")).select(*ROW_KEY)
    return docs.join(lost, ROW_KEY, "left_anti").drop(*ROW_KEY)


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(t) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)
"""
