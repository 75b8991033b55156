"""Exact deduplication of files by content hash, and the actions that follow from it.

Inputs have columns path (string), hash (string) and optionally size. "First" is always the smallest path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curata.functions.text import file_name, parent_name, sibling

ACTION = ["action", "src", "dst", "reason"]


def first_by_hash(files: DataFrame, key: str = "hash", order: str = "path") -> DataFrame:
    """All rows with `first`, the smallest order value of the row's hash; null hashes (unreadable files) have none.

    An aggregate joined back, not a window: copies are pre-aggregated before the shuffle, and a hot hash is a skewed join
    that adaptive execution splits.
    """
    firsts = files.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("first"))
    return files.join(firsts, key, "left")


def unique_and_duplicates(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path) of the first file of each hash, and (original_path, duplicate_path) of all others."""
    marked = first_by_hash(files)
    unique = marked.filter(F.col("path") == F.col("first")).drop("first")
    links = marked.filter(F.col("path") > F.col("first")).select(F.col("first").alias("original_path"), F.col("path").alias("duplicate_path"))
    return unique, links


def dedup_counts(files: DataFrame) -> DataFrame:
    """(total, unique, duplicates): unreadable files are no uniques, so they count as duplicates."""
    out = files.agg(F.count(F.lit(1)).alias("total"), F.count_distinct("hash").alias("unique"))
    return out.withColumn("duplicates", F.col("total") - F.col("unique"))


def hash_groups(files: DataFrame, least: int = 2) -> DataFrame:
    """(hash, paths, folder): the files of each hash with at least so many, and the sorted names of their folders joined by `_`."""
    names = F.array_join(F.array_sort(F.collect_set(parent_name(F.col("path")))), "_")
    grouped = files.filter(F.col("hash").isNotNull()).groupBy("hash").agg(F.array_sort(F.collect_list("path")).alias("paths"), names.alias("folder"))
    return grouped.filter(F.size("paths") >= least)


def duplicate_moves(links: DataFrame) -> DataFrame:
    """Move every duplicate to `<its folder>_duplicates/<original's name>_<its name>`."""
    dst = F.concat(sibling(F.col("duplicate_path"), "_duplicates"), F.lit("/"), F.concat_ws("_", file_name(F.col("original_path")), file_name(F.col("duplicate_path"))))
    return links.select(F.lit("move").alias("action"), F.col("duplicate_path").alias("src"), dst.alias("dst"), F.lit("duplicate").alias("reason"))


def free_names(rows: DataFrame, occupied: DataFrame, path: str = "dst", order: str = "src") -> DataFrame:
    """The rows with collision-free paths: `base.ext`, then `base_1.ext`, `base_2.ext` and so on, skipping occupied ones.

    occupied has one column, path. Rows that want one path are numbered in the order given; each takes the next free
    number, so the result doesn't depend on the order of execution.
    """
    want = F.col(path)
    name = file_name(want)
    dot = F.length(name) - F.locate(".", F.reverse(name)) + 1
    has_ext = (F.locate(".", name) > 0) & (dot > 1)
    ext = F.when(has_ext, F.substring(name, dot, F.length(name))).otherwise(F.lit(""))
    stem = F.substring(want, F.lit(1), F.length(want) - F.length(ext))
    ranked = rows.withColumn("__stem", stem).withColumn("__ext", ext).withColumn("__k", F.row_number().over(W.partitionBy(path).orderBy(order)) - 1)
    held = occupied.select(F.col("path").alias("__held"))
    wanted = ranked.groupBy(path, "__stem", "__ext").agg(F.max("__k").alias("__most"))
    # the number of a held path with this stem and extension: 0 for the path itself
    number = F.regexp_extract(F.col("__held"), r"_([0-9]{1,9})(\.[^./]*)?$", 1)
    parts = held.select("__held", F.regexp_replace("__held", r"(_[0-9]{1,9})?(\.[^./]*)?$", "").alias("__s"), F.regexp_extract("__held", r"(\.[^./]*)$", 1).alias("__e"), number.try_cast("int").alias("__n"))
    numbered = parts.select(F.col("__s").alias("__stem"), F.col("__e").alias("__ext"), F.col("__n")).filter("__n >= 1")
    itself = held.select(F.col("__held").alias(path)).join(wanted, path).select("__stem", "__ext", F.lit(0).alias("__n"))
    taken = numbered.unionByName(itself).groupBy("__stem", "__ext").agg(F.array_sort(F.collect_set("__n")).alias("__taken"))
    # k-th free number: k plus the held numbers below it, found by walking the sorted held ones
    free = F.aggregate(F.coalesce("__taken", F.array().cast("array<int>")), F.col("__k"), lambda acc, n: F.when(n <= acc, acc + 1).otherwise(acc))
    out = ranked.join(taken, ["__stem", "__ext"], "left").withColumn("__free", free)
    new = F.when(F.col("__free") == 0, want).otherwise(F.concat("__stem", F.lit("_"), F.col("__free").cast("string"), "__ext"))
    return out.withColumn(path, new).select(*rows.columns)


def consolidation_plan(files: DataFrame, root: str, occupied: DataFrame) -> DataFrame:
    """For each hash with copies: one copy of its first file to `<root>/<folders>/`, then a delete of every member.

    The dst of a delete is the copy that has to be there first.
    """
    groups = hash_groups(files)
    wanted = groups.select("hash", F.lit("copy").alias("action"), F.element_at("paths", 1).alias("src"), F.concat_ws("/", F.lit(root), "folder", file_name(F.element_at("paths", 1))).alias("dst"), F.lit("consolidate").alias("reason"))
    copies = free_names(wanted, occupied)
    members = groups.select("hash", F.explode("paths").alias("src"))
    deletes = members.join(copies.select("hash", "dst"), "hash").select(F.lit("delete").alias("action"), "src", "dst", F.lit("consolidated").alias("reason"))
    return copies.select(*ACTION).unionByName(deletes)


def rename_plan(files: DataFrame, new_name: Column, reason: str = "rename") -> DataFrame:
    """Moves within the folder of the files whose new name differs."""
    dst = F.concat(F.regexp_replace("path", "[^/]*$", ""), new_name)
    return files.select(F.lit("move").alias("action"), F.col("path").alias("src"), dst.alias("dst"), F.lit(reason).alias("reason")).filter("src != dst")
