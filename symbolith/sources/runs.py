"""What a run over many projects leaves behind: tables by run and project, with a policy for what is there already; messages and tallies
from the pass that did the work; a training set to which a batch is appended once.

A run is a tool with the categories that were removed and inferred. Its rows lie in one folder a project, so that projects are skipped,
replaced or refused each by itself, in one write for all of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.select import check_inferable
from ..schemas import PREDICTIONS, TRAINING, assert_schema
from ..session import stored

RUN = ["tool", "removed", "inferred", "project"]
STATES = ("success", "failure", "warning", "skip")
SKIP, ERROR, REPLACE = "skip", "error", "replace"


def _path(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def run_name(tool: str, removed: list[str], inferred: list[str]) -> str:
    return f"{tool}@[{','.join(removed)}]+[{','.join(inferred)}]"


def of_run(df: DataFrame, tool: str, removed: list[str], inferred: list[str]) -> DataFrame:
    """df (with `project`) as the rows of a run. What is inferred must have been removed."""
    check_inferable(set(inferred), set(removed))
    return df.withColumns({"tool": F.lit(tool), "removed": F.lit(",".join(sorted(removed))), "inferred": F.lit(",".join(sorted(inferred)))})


def done(spark: SparkSession, root: str) -> DataFrame:
    """tool, removed, inferred and project of what lies below root: folder names, no rows are read."""
    if not exists(spark, root):
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in RUN))
    return stored(spark.read.schema(f"__none int, {', '.join(f'{c} string' for c in RUN)}").parquet(root).select(*RUN).distinct(), "done")


def pending(projects: DataFrame, root: str) -> DataFrame:
    """The rows of projects (with the columns of a run) that root has no results of: what is still to be worked on."""
    return projects.join(done(projects.sparkSession, root), RUN, "left_anti")


def write_run(df: DataFrame, root: str, policy: str = SKIP) -> None:
    """df: predictions with the columns of a run (of_run), of any number of projects, to a folder for each run and project, in one write.
    Projects that root has are skipped, are replaced, or fail the write, by name and before anything is published."""
    spark = df.sparkSession
    rows = df.select(*PREDICTIONS.names, *RUN)
    if policy == SKIP:
        rows = pending(rows, root)
    elif policy == ERROR:
        there = done(spark, root).withColumn("__there", F.lit(True))
        said = F.concat(F.lit("there are results already: "), F.concat_ws(" ", *RUN))
        rows = rows.join(there, RUN, "left").filter(F.when(F.col("__there"), F.raise_error(said).cast("boolean")).otherwise(True)).drop("__there")
    elif policy != REPLACE:
        raise ValueError(f"not a policy: {policy}")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*RUN).parquet(root)


def read_run(spark: SparkSession, root: str, tool: str | None = None, removed: list[str] | None = None) -> DataFrame:
    """Predictions below root with the columns of their runs, of one tool and set of removed categories if asked; other folders aren't listed for rows."""
    kinds = {f.name: f.dataType.simpleString() for f in PREDICTIONS.fields} | dict.fromkeys(RUN, "string")
    found = spark.read.schema(", ".join(f"{c} {t}" for c, t in kinds.items())).parquet(root)
    if tool is not None:
        found = found.filter(F.col("tool") == tool)
    return found if removed is None else found.filter(F.col("removed") == ",".join(sorted(removed)))


def state(error: str = "error", warning: str = "warning", skipped: Column | None = None) -> Column:
    """failure before warning before skip before success."""
    skip = F.lit(False) if skipped is None else F.coalesce(skipped, F.lit(False))
    return F.when(F.col(error).isNotNull(), "failure").when(F.col(warning).isNotNull(), "warning").when(skip, "skip").otherwise("success")


def tallied(df: DataFrame, column: str = "state") -> tuple[DataFrame, Observation]:
    """df, and the number of its rows in each state, which is there once df has been written: it is counted in that pass."""
    found = Observation(f"tally-{uuid.uuid4().hex}")
    return df.observe(found, *(F.count_if(F.col(column) == s).alias(s) for s in STATES)), found


def write_logged(df: DataFrame, path: str, columns: list[str], project: str = "project", mode: str = "errorifexists") -> dict[str, int]:
    """df: project, file, `columns`, error, warning. One pass writes results and messages side by side and counts states; results() and
    messages() then read their own columns alone. Returns the number of rows by state."""
    rows, tally = tallied(df.select(F.col(project).alias("project"), "file", *columns, "error", "warning").withColumn("state", state()))
    rows.write.mode(mode).parquet(path)
    return {s: int(tally.get[s]) for s in STATES}


def results(spark: SparkSession, path: str) -> DataFrame:
    """The rows of write_logged that aren't messages only."""
    return spark.read.parquet(path).filter("error is null and warning is null").drop("error", "warning", "state")


def messages(spark: SparkSession, path: str) -> DataFrame:
    """project, file, level (error or warning) and message, as write_logged wrote them."""
    rows = spark.read.parquet(path).select("project", "file", F.explode(F.array(*(F.struct(F.lit(c).alias("level"), F.col(c).alias("message")) for c in ("error", "warning")))).alias("m"))
    return rows.select("project", "file", "m.level", "m.message").filter("message is not null")


def summary(spark: SparkSession, path: str) -> DataFrame:
    """Per project the number of messages of each level."""
    return messages(spark, path).groupBy("project").agg(*(F.count_if(F.col("level") == x).alias(f"{x}s") for x in ("error", "warning")))


# training sets


def _entry(root: str, batch: str) -> str:
    return f"{root}/ledger/{batch}"


def append_once(df: DataFrame, root: str, batch: str) -> bool:
    """Append training rows as the batch of a name (of letters, digits, - and _), once whatever fails: its rows lie in a folder of
    their own, which a repeated attempt replaces, and count from when its entry stands in the ledger, which is made in one step.
    False if it stood there before."""
    spark = df.sparkSession
    if not batch.replace("-", "").replace("_", "").isalnum():
        raise ValueError(f"not a name for a batch: {batch}")
    if exists(spark, _entry(root, batch)):
        return False
    rows = assert_schema(df, TRAINING).select(*TRAINING.names)
    rows.write.mode("overwrite").parquet(f"{root}/batches/batch={batch}")
    publish(spark, root, batch)
    return True


def publish(spark: SparkSession, root: str, batch: str) -> None:
    """Make a batch's entry in the ledger."""
    path, fs = _path(spark, _entry(root, batch))
    fs.mkdirs(path.getParent())
    fs.create(path, False).close()


def ledger(spark: SparkSession, root: str) -> list[str]:
    """The names of the batches that count, one a batch."""
    path, fs = _path(spark, f"{root}/ledger")
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def training_set(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all batches that count; folders of others aren't read."""
    names = ledger(spark, root)
    if not names:
        return spark.createDataFrame([], TRAINING)
    return spark.read.schema(TRAINING).option("basePath", f"{root}/batches").parquet(*(f"{root}/batches/batch={n}" for n in names)).select(*TRAINING.names)
