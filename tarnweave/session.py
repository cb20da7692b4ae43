"""Session helpers: one place for the settings that plans here rely on."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import warnings
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows a side may have to be broadcast after it was counted.
BROADCAST_ROWS = 200_000
#: Largest size in bytes, as Parquet, that it may have.
BROADCAST_BYTES = 64_000_000


def build_session(app: str = "tarnweave", **conf: str) -> SparkSession:
    """A session with adaptive execution; `conf` overrides any setting (dots written as `__`)."""
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    base |= {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(app).config(map=base).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session.

    Only where it is unset (tests, one machine) a folder of this machine is taken and set; on a cluster that is warned of.
    """
    sc = spark.sparkContext
    set_already = sc._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return set_already.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured and not sc.master.startswith("local"):
        warnings.warn("spark.checkpoint.dir is unset: a folder of this machine is taken, which other machines don't see", stacklevel=2)
    target = configured or "file://" + os.path.join(tempfile.gettempdir(), "tarnweave-checkpoints")
    sc.setCheckpointDir(target)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder and read from there.

    Ends the lineage, survives the loss of any executor, and gives the planner true sizes.
    """
    target = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(target)
    kept = df.sparkSession.read.schema(df.schema).parquet(target)
    kept._tarnweave_folder = target
    return kept


def _folder(df: DataFrame):
    """File system and path of what `cut` or `cut_counted` returned."""
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._tarnweave_folder)
    return path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()), path


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that `cut` or `cut_counted` returned and nothing reads any more."""
    fs, path = _folder(df)
    fs.delete(path, True)


def cut_counted(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """`cut(df)` and the aggregates `metrics`, both from one job; `rows` is always among them."""
    seen = Observation(f"cut-{uuid.uuid4().hex}")
    kept = cut(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in metrics.items())))
    return kept, seen.get


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, written once and counted; marked for broadcast only if it has at most `rows` rows and BROADCAST_BYTES bytes.

    Beyond that the plan keeps an ordinary shuffle join, with AQE's skew handling.
    """
    kept, seen = cut_counted(df)
    if seen["rows"] > rows:
        return kept
    fs, path = _folder(kept)
    return F.broadcast(kept) if fs.getContentSummary(path).getLength() <= BROADCAST_BYTES else kept


def publish(spark: SparkSession, data: bytes, name: str) -> str:
    """Writes `data` to the shared folder; the file's URI."""
    target = f"{shared_dir(spark)}/{name}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    out.write(data)
    out.close()
    return target


def ship(spark: SparkSession) -> None:
    """Makes this package importable on every executor, those that join later included. Once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_tarnweave_shipped", False):
        return
    home, packed = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, f"{home.name}/{p.relative_to(home)}")
    sc.addPyFile(publish(spark, packed.getvalue(), f"tarnweave-{uuid.uuid4().hex}.zip"))
    sc._tarnweave_shipped = True
