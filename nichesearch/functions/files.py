"""Small files through Hadoop's file system, and folders that driver and executors share."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from typing import Any

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession


def at(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """Hadoop's file system and path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = at(spark, path)
    return fs.exists(place)


def save(spark: SparkSession, path: str, data: bytes) -> str:
    """Write a file of the driver's; it has its name once it is whole."""
    fs, place = at(spark, path)
    part = place.suffix(f".{uuid.uuid4().hex}.part")
    out = fs.create(part)
    out.write(bytearray(data))
    out.close()
    fs.delete(place, False)
    fs.rename(part, place)
    return path


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; on one machine a temporary folder serves where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="nichesearch-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _found(path: str) -> tuple[pa.fs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)
    return pa.fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def opened(path: str) -> pa.NativeFile:
    """A file for reading by ranges, on the driver or in a task: a path, or a URI of what ``pyarrow.fs`` knows (HDFS, S3, GCS)."""
    fs, place = _found(path)
    return fs.open_input_file(place)


def written_by_task(folder: str, suffix: str, data: bytes) -> str:
    """The name of a new file in ``folder``: it counts once a table names it, so that what a repeated task leaves is never read."""
    fs, place = _found(folder)
    fs.create_dir(place, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    with fs.open_output_stream(f"{place}/{name}", compression=None) as out:
        out.write(data)
    return name
