"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where the master is one local process."""
    sc = spark.sparkContext
    if (set_ := sc.getCheckpointDir()) is not None:
        return set_
    if named := spark.conf.get("spark.checkpoint.dir", None):
        sc.setCheckpointDir(named)
        return named
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="emberfold-")
    atexit.register(shutil.rmtree, own, True)
    sc.setCheckpointDir(own)
    return own


def materialize(df: DataFrame) -> DataFrame:
    """Computes ``df`` once into the shared folder; survives the loss of executors and cuts its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, kind: str) -> str:
    """A new place in the shared folder, which is removed when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(conf).deleteOnExit(folder)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Like :func:`materialize`, as a compressed table of columns, for wide rows that are read more than once; it goes when the application ends."""
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python this package, once an application, through the shared folder; where that is no mounted folder, ``--py-files`` or
    PYTHONPATH must do it.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    folder = shared_dir(spark).removeprefix("file:")
    if "://" in folder:
        return
    folder = Path("/" + folder.lstrip("/"))
    folder.mkdir(parents=True, exist_ok=True)
    package, target = Path(__file__).parent, folder / "emberfold.zip"
    with zipfile.ZipFile(own := f"{target}.{os.getpid()}", "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    os.replace(own, target)
    sc.addPyFile(str(target))
