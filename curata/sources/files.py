"""Image files as DataFrames."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyarrow.fs import FileSystem
from pyarrow.lib import ArrowException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.functions.images import broken_dialect, repaired_or_error
from curata.plans.scratch import Scratch
from curata.sources.tree import list_tree

#: Suffixes of images.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "gif", "bmp", "webp", "tiff", "tif")


def is_image(path: Column, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> Column:
    """Whether a path ends in one of the suffixes, whatever their case."""
    return F.lower(path).rlike(r"\.(%s)$" % "|".join(suffixes))


def readable(images: DataFrame, value: Column) -> DataFrame:
    """(path, size, value) of scanned images: files that can't be read have a null value and stop nothing.

    The listing and the reading are joined by path, so that a file which Spark skips when it reads keeps its row. Files
    that are gone since they were listed are gone.
    """
    spark = images.sparkSession
    names = ("spark.sql.files.ignoreCorruptFiles", "spark.sql.files.ignoreMissingFiles")
    before = {n: spark.conf.get(n) for n in names}
    work = Scratch(spark, "read")
    try:
        for n in names:
            spark.conf.set(n, "true")
        listed = work.table(images.select("path", "size"), "listed")
        read = work.table(images.select("path", value.alias("value")), "values")
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    return listed.join(read, "path", "left")


def scan_images(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ("png",), hidden: bool = False) -> DataFrame:
    """(path, size, modificationTime, content) of the image files below a folder, or of one image file.

    The suffix is matched without case. Listing and reading are Spark's, so the store may be any that Hadoop knows, and an
    unselected content column is never read. Spark leaves out names that start with `_` or `.`; hidden=True lists such
    names too, in tasks, on stores that all machines have mounted.
    """
    if hidden:
        return _listed(spark, root, suffixes)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(root)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{%s}" % ",".join("".join(f"[{c}{c.upper()}]" for c in s) for s in suffixes)).load(root)
    return found.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("size"), "modificationTime", "content")


def _listed(spark: SparkSession, root: str, suffixes: tuple[str, ...]) -> DataFrame:
    if not os.path.exists(root):
        raise FileNotFoundError(root)
    # dealt out anew, as one folder may hold most of the files
    listed = list_tree(spark, root, suffixes).repartition("path")

    @F.pandas_udf("binary")
    def content(path: pd.Series) -> pd.Series:
        return path.map(read_bytes)

    return listed.withColumn("content", content("path"))


def read_bytes(path: str) -> bytes | None:
    """The contents of a file, or null if it can't be read; for use in tasks, where the contents are needed.

    A path without a scheme is opened as it is; a URI goes to Arrow's file systems (file, hdfs, s3, gs, abfss).
    """
    try:
        if "://" not in path:
            with open(path, "rb") as f:
                return f.read()
        store, name = FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))
        with store.open_input_stream(name) as f:
            return f.read()
    except (OSError, ArrowException):
        return None


def usable_bytes(path: str) -> bytes | None:
    """As `read_bytes`, with images of the broken dialect repaired where they can be."""
    data = read_bytes(path)
    if data and broken_dialect(data):
        return repaired_or_error(data)[0] or data
    return data


def repaired_files(paths: DataFrame) -> DataFrame:
    """(path, fixed, error) of those files of paths (path) that are in the broken dialect.

    Files are read, one at a time, in the tasks that repair them: only paths are shuffled. Files that can't be read and
    null paths have no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                data = read_bytes(path) if path else None
                if data and broken_dialect(data):
                    fixed, error = repaired_or_error(data)
                    yield pd.DataFrame({"path": [path], "fixed": [fixed], "error": [error]})

    return paths.select("path").mapInPandas(run, "path string, fixed binary, error string")
