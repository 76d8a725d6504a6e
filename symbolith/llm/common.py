"""What the operators share: row keys, tables in the shared folder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship  # noqa: F401  the operators take it from here

#: The six ASCII white-space characters, and a run of anything else, as regular expressions.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

ROW_FILE, ROW_INDEX = "__row_file", "__row_index"
ROW_KEY = [ROW_FILE, ROW_INDEX]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir. Where it is unset a local master gets a
    temporary folder; a cluster without it is an error, since executors could not read each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="symbolith-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back. This cuts the lineage: a lost executor
    costs only the tasks that were running."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(spark: SparkSession) -> None:
    """Let the driver find the shuffles that nothing refers to any more, so that executors delete their files now."""
    gc.collect()  # Python's handles of plans keep them alive in the JVM
    spark.sparkContext._jvm.System.gc()


def drop(*tables: DataFrame) -> None:
    """Delete tables that stash() wrote, once nothing that is still to run reads them. An empty table may name no file and stays."""
    for table in tables:
        spark = table.sparkSession
        for name in {os.path.dirname(f) for f in table.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def keyed(df: DataFrame) -> DataFrame:
    """df with ROW_KEY, the file and the position that each row was read from. Unlike a running number this
    stays the same when a task is repeated elsewhere. A frame that doesn't come from files is written first."""
    clash = [c for c in df.columns if c in ROW_KEY]
    df = df.drop(*clash)
    try:
        out = df.select("*", F.col("_metadata.file_path").alias(ROW_FILE), F.col("_metadata.row_index").alias(ROW_INDEX))
        out.schema  # noqa: B018  analysed here
        return out
    except Exception as error:
        if "UNRESOLVED_COLUMN" not in str(error) and "_metadata" not in str(error):
            raise
    return stash(df, "rows").select("*", F.col("_metadata.file_path").alias(ROW_FILE), F.col("_metadata.row_index").alias(ROW_INDEX))


def slices(batches, at: int, n_bytes: int = 4_000_000):
    """batches in slices of about n_bytes bytes of column `at` at most, one row at least."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > n_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def by_rows(rows_of, n_bytes: int = 4_000_000, at: int = 1):
    """A function for mapInArrow that hands rows_of the slices() of batches and yields what it returns."""

    def over(batches):
        for part in slices(batches, at, n_bytes):
            yield from rows_of(part)

    return over
