"""Files of a run, on the driver: which names mean one file, and which folder all executors share."""

from __future__ import annotations

import itertools
import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def target(path: str) -> str:
    """Where a path leads, with links followed as far as there is something to follow."""
    path = os.path.abspath(os.path.expanduser(path))
    if os.path.exists(path):
        return os.path.realpath(path)
    folder, name = os.path.split(path)
    return os.path.join(os.path.realpath(folder), name)


def same_file(a: str, b: str) -> bool:
    """One file by its identity, or, where one of them isn't there yet, by its place."""
    if os.path.exists(a) and os.path.exists(b):
        return os.path.samefile(a, b)
    return target(a) == target(b)


def spare_name(output: str, source: str) -> str:
    """A free name beside an output that couldn't be made, for the EPUB it was to be made of."""
    stem = os.path.splitext(output)[0]
    tries = itertools.chain([f"{stem}.translated.epub"], (f"{stem}.translated-{n}.epub" for n in itertools.count(2)))
    return next(t for t in tries if not os.path.exists(t) and not same_file(t, source))


def run_folder(spark: SparkSession) -> str:
    """A new folder that all executors share, for what one run keeps; raises where a cluster names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.gettempdir()
    return f"{shared.rstrip('/')}/folioflow-run-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store the path names; nothing happens if it isn't there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
