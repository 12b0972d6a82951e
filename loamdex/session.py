"""A session with the defaults that the plans are written for."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(name: str = "loamdex", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive plans, UTC, Arrow transfer; sizes of partitions are left to adaptive execution unless given."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def visible(spark: SparkSession) -> SparkSession:
    """spark, with this package on the path of Python workers that share the driver's disk, wherever the driver was started. On a cluster, ship it with --py-files."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for what the driver and all executors share. Without one, a local session gets a folder of its own; a cluster's executors would share none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Setting: partitions that tables of texts are dealt into.
PARTITIONS = "spark.loamdex.partitions"


def dealt(texts: DataFrame) -> DataFrame:
    """texts in as many partitions as the session's PARTITIONS asks for, as they lie where it isn't set. For small tables in one split, whose rows are much work each; it shuffles them."""
    wanted = int(texts.sparkSession.conf.get(PARTITIONS, "0"))
    return texts.repartition(wanted) if wanted > 0 else texts


#: Rows in an Arrow batch of texts. The session's default suits narrow rows; texts are thousands of characters.
BATCH_ROWS = 1_000
_SETTING, _DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", 10_000


def small_batches(df: DataFrame) -> None:
    """Arrow batches that suit texts, from now on; a batch size that the session has set itself is kept."""
    conf = df.sparkSession.conf
    if int(conf.get(_SETTING, str(_DEFAULT))) == _DEFAULT:
        conf.set(_SETTING, str(BATCH_ROWS))


#: Rows of a table of short rows that one task gets, about, where each row is much work.
ROWS = 20_000


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by key into as many partitions as there are cores, more of ROWS rows each where there are many. A file of short rows is few splits, however much work each row is."""
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS))
    return rows.repartition(n, key)


def numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with n, their place from 1 on in the order of by. They are sorted over all tasks and stored; the driver gets one count a partition."""
    own = stored(rows.orderBy(*by)).withColumn("_i", F.monotonically_increasing_id())
    part = F.shiftright("_i", 33).cast("int")  # the id is the partition, and the place in it in the lower 33 bits
    sizes = {r["p"]: r["count"] for r in own.select(part.alias("p")).groupBy("p").count().collect()}
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    first = F.get(F.array(*map(F.lit, before)), part) if before else F.lit(0)
    return own.withColumn("n", (first + F.col("_i").bitwiseAND((1 << 33) - 1) + 1).cast("int")).drop("_i")
