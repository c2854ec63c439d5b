"""Session defaults shared by jobs, tests and the bench."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings every operator relies on.  Cluster sizing (executors, memory, shuffle
# partitions, checkpoint folder) stays with the cluster's own configuration.
SEMANTIC_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.compression.codec": "snappy",
}


def get_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    # streaming state processors are first loaded by a Python process of the driver, which takes this path
    root = str(Path(__file__).resolve().parent.parent)
    if root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [root, os.environ.get("PYTHONPATH")]))
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SEMANTIC_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Sends this package's sources to the executors, once per application, through Spark's own file server."""
    context, root = spark.sparkContext, Path(__file__).resolve().parent
    if not getattr(context, "tidemark_shipped", False):
        folder = tempfile.mkdtemp(prefix="tidemark-")  # on the driver; served from there until it ends
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with zipfile.ZipFile(f"{folder}/tidemark-sources.zip", "w", zipfile.ZIP_DEFLATED) as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, str(source.relative_to(root.parent)))
        context.addPyFile(f"{folder}/tidemark-sources.zip")
        context.tidemark_shipped = True
    return spark


def stage(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage: a reliable checkpoint in the shared folder.

    For tables that several branches of a plan read.  Without it each branch would recompute
    everything below; the copy also survives the loss of an executor.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster.  Where none is named, a temporary one for a local master (tests);
    on a cluster every executor would write to a disk of its own, so the folder must then be named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.conf.get("tidemark.checkpoint.set", None) != named:
        spark.sparkContext.setCheckpointDir(named)
        spark.conf.set("tidemark.checkpoint.set", named)
    return named
