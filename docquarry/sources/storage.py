"""Where the engine keeps tables between jobs: below the folder that all machines share."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for place, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(place, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    place = os.path.join(tempfile.mkdtemp(), "docquarry_engine.zip")
    with open(place, "wb") as f:
        f.write(packed.getvalue())
    context.addPyFile(place)
    _shipped.add(context.applicationId)


def folder(spark: SparkSession, name: str = "") -> str:
    """A fresh folder below spark.checkpoint.dir. Where that is unset, a master in one process has a local one; a cluster
    is an error, as its machines don't share theirs. It goes when the session ends."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = f"file://{tempfile.gettempdir()}/docquarry-tables"
    path = f"{base.rstrip('/')}/{name}{'-' if name else ''}{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def move(spark: SparkSession, path: str, to: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)
    if not fs.rename(place, target):
        raise OSError(f"{path} couldn't be moved")
    fs.deleteOnExit(target)


def stamp(spark: SparkSession, path: str) -> str:
    """What tells a file or folder of files from its other states: names, sizes and times of all its files."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(place, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return "\n".join(sorted(found))


def written(df: DataFrame, name: str = "") -> DataFrame:
    """The same rows, read back from a table of their own: they are computed once, and again by no one."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that written() made and that nothing still to be computed reads."""
    for table in tables:
        place = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table._written_at)
        place.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
