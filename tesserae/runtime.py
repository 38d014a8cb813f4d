"""Session plumbing shared by the operators: code shipping, shared folders, lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, whatever folder they start in."""
    context = spark.sparkContext
    if getattr(context, "_tesserae_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(), f"{_PACKAGE.name}.zip")
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, str(path.relative_to(_PACKAGE.parent)))
    context.addPyFile(target)
    context._tesserae_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a private
    one in local mode (tests); on a cluster that raises, since executors share no folder then."""
    context = spark.sparkContext
    known = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not known:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = "file://" + tempfile.mkdtemp(prefix="tesserae-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(known)
    return known


def settle(df: DataFrame, name: str, scratch: list[DataFrame] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: cuts lineage, survives lost executors.

    With ``scratch`` the table is noted there, for ``discard`` once what is made of it is settled too."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tesserae/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held._settled_at = path
    if scratch is not None:
        scratch.append(held)
    return held


def discard(tables: list[DataFrame]) -> None:
    """Delete settled tables that no plan needs any more."""
    for held in tables:
        context = held.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(held._settled_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    tables.clear()


def sized_broadcast(small: DataFrame, most: int = 200_000) -> DataFrame:
    """``small``, settled before, with a broadcast hint if it has at most ``most`` rows; beyond that Spark shuffles it."""
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
