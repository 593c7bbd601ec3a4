"""Session helpers: a local session for tests and the CLI, and lineage cutting."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from millrace.errors import CheckError


def local_session(app: str = "millrace", cores: str = "*", **conf: str) -> SparkSession:
    """A local session; an existing session is reused and never reconfigured by operators."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def stop(spark: SparkSession) -> None:
    """Release what is cached and stop the session."""
    spark.catalog.clearCache()
    spark.stop()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per Spark context.

    The driver serves the archive; executors need no copy of the repository.
    """
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="millrace-"), "millrace.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._millrace_shipped = True


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for what is written on the way: ``spark.checkpoint.dir``, or in local mode a temporary one.

    On a cluster a folder of this machine would be another one on each executor, so there an unset one is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise CheckError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="millrace-")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files.

    The result survives the loss of any executor. Where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on, as
    in ``local_session``, Spark removes the files when nothing refers to them any more.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(scratch_root(spark))
    return df.checkpoint(eager=True)
