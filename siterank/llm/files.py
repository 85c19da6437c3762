"""Files that tasks write or read themselves, in the shared folder of the cluster."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyarrow import fs
from pyspark.sql import SparkSession

from siterank.sources.staging import stage_root


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name below spark.checkpoint.dir that no other run uses."""
    return f"{stage_root(spark)}/siterank/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for clusters where it is not installed."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(), "siterank.zip")  # Spark's file server hands it out, no task opens it
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, files in os.walk(os.path.join(top, "siterank")):
            for name in files:
                if name.endswith(".py"):
                    whole = os.path.join(folder, name)
                    out.write(whole, os.path.relpath(whole, top))
    spark.sparkContext.addPyFile(path)
    _shipped.add(application)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let no Arrow batch of whole texts take more than so many rows, unless the session asks for fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local, hdfs, s3, gs) and the path in it."""
    local = re.match(r"file:/*(/.*)", folder)
    if local or "://" not in folder:
        return fs.LocalFileSystem(), local[1] if local else folder
    return fs.FileSystem.from_uri(folder)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in batches whose texts have at most `most` bytes, or one row each if longer."""
    for batch in batches:
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0))
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if start < len(sizes):
            yield batch.slice(start)
