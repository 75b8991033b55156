"""Similarity clusters of perceptual hashes, and their pruning, ranking and renaming.

Hashes are rows (path, phash bigint, size bigint); undecodable files have a null phash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curata.functions.text import delete_me_name, file_name, group_file_name
from curata.operators.components import connected_components
from curata.operators.hamming_index import links_within, pairs_within
from curata.plans.scratch import Scratch

#: Fixed value: the score of a cluster of one file.
SINGLE = 0.999


@dataclass(frozen=True)
class ClusterConfig:
    dry_run: bool = True
    exact_copy_threshold: float = 0.01
    similarity_threshold: float = 0.16


def similar_pairs(hashes: DataFrame, threshold: float) -> DataFrame:
    """(p1, p2, bits, score) of the pairs p1 < p2 of files that stand for their hashes, and the copies of each of them.

    The smallest path of a hash stands for it. Pairs of these have a normalised distance up to the threshold; every other
    file of a hash is a row of 0 bits with the one that stands for it. So the rows grow with the files and with the pairs
    of different hashes, never with the square of a group of copies, and every link between files follows from them.
    """
    known = hashes.filter(F.col("phash").isNotNull()).select("path", "phash")
    reps = known.groupBy("phash").agg(F.min("path").alias("p"))
    apart = _compared(reps, threshold).select("p1", "p2", "bits")
    copies = known.join(reps, "phash").filter("path != p").select(F.col("p").alias("p1"), F.col("path").alias("p2"), F.lit(0).alias("bits"))
    return apart.unionByName(copies).withColumn("score", F.col("bits") / F.lit(64.0))


def _compared(reps: DataFrame, threshold: float) -> DataFrame:
    return pairs_within(reps, _bits(threshold))


def _bits(threshold: float) -> int:
    return int(threshold * 64 + 1e-9)


def clusters(hashes: DataFrame, threshold: float) -> DataFrame:
    """(cluster_id, avg_score, paths): components of similar files, and every other file as a cluster of its own.

    cluster_id is the smallest path. avg_score is the mean distance over all similar pairs, pairs of equal hashes
    included, computed from counts: c files of one hash make c (c - 1) / 2 pairs of distance 0 among them, and c times d
    with a similar hash of d files.
    """
    known = hashes.filter(F.col("phash").isNotNull())
    reps = known.groupBy("phash").agg(F.min("path").alias("p"), F.count(F.lit(1)).alias("c"))
    links = Scratch(hashes.sparkSession, "links").table(links_within(reps.select("phash", "c"), _bits(threshold)), "links")
    part = connected_components(links.filter("phash != other").select("phash", "other"), "phash", "other").withColumnRenamed("node", "phash")
    joined = reps.join(part, "phash", "left").withColumn("component", F.coalesce("component", "phash"))
    labelled = joined.join(joined.groupBy("component").agg(F.min("p").alias("cluster_id")), "component")
    apart = links.join(labelled.select("phash", "cluster_id"), "phash").groupBy("cluster_id").agg(F.sum("bits").alias("bits"), F.sum("n").alias("n"))
    equal = labelled.groupBy("cluster_id").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("m"))
    score = equal.join(apart, "cluster_id", "left").select("cluster_id", (F.coalesce("bits", F.lit(0)) / F.nullif(F.lit(64) * (F.coalesce("n", F.lit(0)) + F.col("m")), F.lit(0.0))).alias("mean"))
    member = hashes.select("path", "phash").join(labelled.select("phash", "cluster_id"), "phash", "left").select("path", F.coalesce("cluster_id", "path").alias("cluster_id"))
    grouped = member.groupBy("cluster_id").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return grouped.join(score, "cluster_id", "left").select("cluster_id", F.coalesce("mean", F.lit(SINGLE)).alias("avg_score"), "paths")


def prune_full_matches(found: DataFrame, sizes: DataFrame, config: ClusterConfig) -> tuple[DataFrame, DataFrame]:
    """Clusters whose files are copies keep their smallest file (ties: smallest path), and the planned actions.

    sizes has path and size. orig_avg stays for the ranking; a pruned cluster's avg_score becomes that of a single file.
    A dry run plans marks (renames to `_DELETE-ME.png`), a real run deletes; neither touches a file here.
    """
    full = (F.col("avg_score") <= config.exact_copy_threshold) & (F.size("paths") > 1)
    files = found.filter(full).select("cluster_id", F.explode("paths").alias("path")).join(sizes.select("path", "size"), "path", "left")
    least = files.groupBy("cluster_id").agg(F.min_by("path", F.struct(F.coalesce("size", F.lit((1 << 63) - 1)), "path")).alias("keep"))
    out = found.join(least, "cluster_id", "left").select("cluster_id", F.when(F.col("keep").isNotNull(), F.lit(SINGLE)).otherwise(F.col("avg_score")).alias("avg_score"), F.col("avg_score").alias("orig_avg"), F.when(F.col("keep").isNotNull(), F.array("keep")).otherwise(F.col("paths")).alias("paths"))
    others = files.join(least, "cluster_id").filter(F.col("path") != F.col("keep"))
    mark = F.concat(F.regexp_replace("path", "[^/]*$", ""), delete_me_name(file_name(F.col("path"))))
    plan = others.select(F.lit("mark" if config.dry_run else "delete").alias("action"), F.col("path").alias("src"), (mark if config.dry_run else F.lit(None).cast("string")).alias("dst"), F.concat(F.lit("copy of "), F.col("keep")).alias("reason"))
    return out, plan


def rank_clusters(pruned: DataFrame) -> DataFrame:
    """With rank, from 0, and group_id, its five digits: larger clusters first, then the smaller original score, then path.

    A total rank without one task for all: rows are sorted by range, counted per partition, and numbered from the sums.
    """
    keyed = pruned.withColumn("n", F.size("paths"))
    order = [F.col("n").desc(), F.col("orig_avg").asc(), F.col("cluster_id").asc()]
    spread = keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    placed = Scratch(pruned.sparkSession, "rank").table(spread, "placed")
    sums = placed.groupBy("part").agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("first"))
    before = sums.withColumn("before", F.sum("c").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    out = placed.join(F.broadcast(before.select("part", "first", F.coalesce("before", F.lit(0)).alias("before"))), "part")
    rank = F.col("before") + F.col("at") - F.col("first")
    return out.withColumn("rank", rank).withColumn("group_id", F.format_string("%05d", F.col("rank"))).select("rank", "group_id", "cluster_id", "avg_score", "orig_avg", "n", "paths")


def group_rename_plan(ranked: DataFrame, occupied: DataFrame) -> DataFrame:
    """(group_id, path, new_path, collides) of all files; a name that another file holds keeps the old path."""
    files = ranked.select("group_id", F.explode("paths").alias("path"))
    new = F.concat(F.regexp_replace("path", "[^/]*$", ""), group_file_name(F.col("group_id"), file_name(F.col("path"))))
    named = files.withColumn("wanted", new)
    held = occupied.select(F.col("path").alias("wanted"), F.lit(True).alias("held")).distinct()
    clash = F.coalesce("held", F.lit(False)) & (F.col("wanted") != F.col("path"))
    return named.join(held, "wanted", "left").select("group_id", "path", F.when(clash, F.col("path")).otherwise(F.col("wanted")).alias("new_path"), clash.alias("collides"))


def groups_of(plan: DataFrame) -> DataFrame:
    """(group_id, paths) after the renames."""
    return plan.groupBy("group_id").agg(F.array_sort(F.collect_list("new_path")).alias("paths"))


def cluster_summary(ranked: DataFrame) -> DataFrame:
    """(clusters, files, largest)."""
    return ranked.agg(F.count(F.lit(1)).alias("clusters"), F.sum(F.size("paths")).alias("files"), F.max(F.size("paths")).alias("largest"))
