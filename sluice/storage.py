"""Places that all machines share: folders for what is written between steps, and logs whose places one writer takes."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def on_one_machine(spark: SparkSession) -> bool:
    return bool(re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, within one machine alone, one of our own
    where it is unset."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not path:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = current.get() if current.isDefined() else ""
    if not path:
        if not on_one_machine(spark):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        path = f"file://{tempfile.mkdtemp(prefix='spark-sluice-')}"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def files(spark: SparkSession, name: str):
    """The file system of a path, and the path, as Hadoop has them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of our own in the shared folder, with its file system's scheme."""
    store, path = files(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    full = store.makeQualified(path).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file:///") else full


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage in the shared folder, so that later jobs neither recompute it nor lose it with an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def take_place(spark: SparkSession, name: str, text: str) -> bool:
    """Makes a file that holds text, unless it is there; False if it is. Others see the whole text or no file.

    The text is written beside it first and then gets its name: by a hard link on a local disk, by a rename on other
    stores, which mustn't replace a file that is there. HDFS and what keeps its contract do that; object stores
    without a rename of their own need one such store for the log.
    """
    store, path = files(spark, name)
    store.mkdirs(path.getParent())
    folder = store.resolvePath(path.getParent())
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    path, draft = hadoop(folder, path.getName()), hadoop(folder, f".{uuid.uuid4().hex}.draft")
    if store.exists(path):
        return False
    out = store.create(draft, False)
    out.write(text.encode())
    out.close()
    try:
        if folder.toUri().getScheme() != "file":
            return bool(store.rename(draft, path))
        os.link(draft.toUri().getPath(), path.toUri().getPath())
        return True
    except FileExistsError:
        return False
    finally:
        store.delete(draft, False)


def places(spark: SparkSession, folder: str) -> list[str]:
    """The names of a log's files, in order."""
    store, path = files(spark, folder)
    found = [f.getPath().getName() for f in store.listStatus(path)] if store.exists(path) else []
    return sorted(n for n in found if n.endswith(".json"))
