"""Session helpers: table access, checkpoints in the shared folder, guarded broadcasts, salted joins."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Copies made of a hot key's row in a salted join.
SALTS = 32
#: A key is hot when it holds more than 1/HOT_SHARE of all rows, so there are never more than HOT_SHARE hot keys.
HOT_SHARE = 500


def get_spark(app: str = "citeloom", master: str = "local[8]", **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings a configured session."""
    b = SparkSession.builder.master(master).appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The parquet table `name` under sf_dir; only `cols` are read if given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the one in spark.checkpoint.dir. One of our own only on a local master (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="citeloom_ckpt_"))
    return sc.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for tables and files that a job writes and reads again."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written once to the folder in spark.checkpoint.dir and read from there: the loss of an executor loses nothing."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def salted_lookup(rows: DataFrame, reps: DataFrame, key: str, rows_id: str, reps_count: str) -> DataFrame:
    """Inner join of rows with reps (one row for each key), safe when one key holds a third of all rows.

    reps carries in `reps_count` how many rows have its key. Keys above 1/HOT_SHARE of the total are hot;
    there are at most HOT_SHARE of them, which bounds the broadcast list of hot keys. A hot key's rep is
    copied SALTS times and its rows spread over the copies by a hash of `rows_id`; every other key keeps one copy.
    """
    reps = checkpointed(reps)
    total = reps.agg(F.sum(reps_count)).first()[0] or 0
    hot = [r[0] for r in reps.where(F.col(reps_count) * HOT_SHARE > F.lit(total)).select(key).collect()]
    if not hot:
        return rows.join(reps.drop(reps_count), key)
    kind = reps.schema[key].dataType.simpleString()
    listed = F.broadcast(rows.sparkSession.createDataFrame([(h,) for h in hot], f"__hot {kind}"))
    is_hot = F.col("__hot").isNotNull()
    left = (
        rows.join(listed, F.col(key) == F.col("__hot"), "left")
        .withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(rows_id), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
        .drop("__hot")
    )
    right = (
        reps.join(listed, F.col(key) == F.col("__hot"), "left")
        .withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        .drop("__hot", reps_count)
    )
    return left.join(right, [key, "__salt"]).drop("__salt")


def blank_to_null(c: Column) -> Column:
    """Null for a string that is empty or holds only white space."""
    return F.when(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")) != "", c)


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, wherever the driver was started; once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_citeloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="citeloom_pkg_")) / "citeloom_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._citeloom_shipped = True
