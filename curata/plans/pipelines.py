"""Whole flows: discovery, similarity clustering, consolidation, validation and classification."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.functions.images import content_hash, fixed_png, is_cgbi, phash
from curata.operators import classify, dedup, similarity
from curata.operators.sessions import SessionStore
from curata.plans.scratch import Scratch
from curata.sources.config import Config, Settings, resolve
from curata.sources.connectors import Connector
from curata.sources.files import IMAGE_SUFFIXES, readable, repaired_files, scan_images, usable_bytes


def hashed(images: DataFrame) -> DataFrame:
    """(path, hash, size, broken); contents are dropped before any shuffle. Unreadable files have a null hash.

    broken says whether the file is in the broken dialect.
    """
    seen = readable(images, F.struct(content_hash(F.col("content")).alias("hash"), is_cgbi(F.col("content")).alias("broken")))
    return seen.select("path", "value.hash", "size", F.coalesce("value.broken", F.lit(False)).alias("broken"))


@dataclass
class Discovery:
    unique: DataFrame
    duplicates: DataFrame
    counts: DataFrame
    actions: DataFrame
    repaired: DataFrame


def discover(spark: SparkSession, root: str, remove_duplicates: bool = True, hidden: bool = False) -> Discovery:
    """PNGs of a tree: unique files, links of duplicates, counts, planned moves, and repaired contents of broken ones.

    Contents are read twice at most, where they are: in the scan that hashes them, and of broken files where they are repaired.
    """
    images = scan_images(spark, root, ("png",), hidden)
    files = Scratch(spark, "discover").table(hashed(images), "files")
    unique, links = dedup.unique_and_duplicates(files)
    actions = dedup.duplicate_moves(links)
    return Discovery(unique.drop("broken"), links, dedup.dedup_counts(files), actions if remove_duplicates else actions.limit(0), repaired_files(unique.filter("broken").select("path")))


def validate(images: DataFrame) -> DataFrame:
    """(path, fixed, error) of the images in the broken dialect."""
    return images.filter(is_cgbi(F.col("content"))).select("path", fixed_png(F.col("content")).alias("r")).select("path", F.col("r.content").alias("fixed"), F.col("r.error").alias("error"))


def cluster_and_rank(spark: SparkSession, root: str, config: similarity.ClusterConfig = similarity.ClusterConfig(), hidden: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Similarity clusters of the PNGs of a tree: (ranked clusters, planned prunes, planned renames)."""
    images = scan_images(spark, root, ("png",), hidden)
    hashes = Scratch(spark, "cluster").table(readable(images, phash(F.col("content"))).select("path", F.col("value").alias("phash"), "size"), "hashes")
    pruned, prunes = similarity.prune_full_matches(similarity.clusters(hashes, config.similarity_threshold), hashes, config)
    ranked = similarity.rank_clusters(pruned)
    return ranked, prunes, similarity.group_rename_plan(ranked, hashes.select("path"))


def consolidate(spark: SparkSession, root: str, hidden: bool = False) -> DataFrame:
    """Planned copies and deletes that merge byte-identical images of a folder's tree."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        raise NotADirectoryError(root)
    files = hashed(scan_images(spark, root, IMAGE_SUFFIXES, hidden))
    return dedup.consolidation_plan(files, root, files.select("path"))


def classify_images(spark: SparkSession, config: Config, unique: DataFrame, connector: Connector, session_id: str, existing: DataFrame | None = None, remove_original: bool = True, images: DataFrame | None = None, workers: int | None = None, reader: classify.Reader | None = None) -> tuple[DataFrame, DataFrame]:
    """Requests for unique files, their results, and the planned copies, moves and quarantines.

    Connectors that send the bytes need reader, which reads an image by its path in the task that calls the connector, or,
    where images are rows of a table and no files, images (path, content), which are joined to the requests.
    """
    base, compound = resolve(config.table(spark))
    prompt = classify.build_prompt([(r["name"], r["description"]) for r in config.rows if not r["compoundCategory"]])
    requests = classify.image_requests(unique, prompt, session_id)
    results = classify.run_requests(requests if images is None else classify.with_contents(requests, images), connector, workers=workers, reader=reader)
    good = results.filter("status = 'classified'").select("image_path", "answer.*")
    named = good.join(classify.match_categories(good, base, compound), "image_path")
    held = existing if existing is not None else spark.createDataFrame([], "path string")
    plan = classify.fan_out_plan(named, config.output_directory or config.work_directory, held, remove_original)
    return results, plan.unionByName(classify.error_plan(results))


def run_session(spark: SparkSession, config: Config, connector: Connector, store: SessionStore, session_id: str, hidden: bool = False, settings: Settings = Settings()) -> DataFrame:
    """A whole session: discovery, requests with the images' bytes, and results, with the session's state; returns the planned actions.

    A connector that can warm up does so first; its failure is none of the session's. A failure sets FAILED and is raised
    again. The session is COMPLETED once every request has a result, and FAILED if there are requests and none was answered.
    Images are read, and broken ones repaired, in the tasks that call the connector; the files themselves are repaired by
    `write_repaired`.
    """
    base, compound = resolve(config.table(spark))
    store.create(session_id, config.work_directory, config.output_directory, base, compound)
    try:
        if hasattr(connector, "warm_up"):
            connector.warm_up()
        found = discover(spark, config.work_directory, settings.remove_duplicates, hidden)
        store.set_state(session_id, "CLASSIFYING")
        store.add_requests(session_id, classify.image_requests(found.unique, "", session_id))
        results, plan = classify_images(spark, config, found.unique, connector, session_id, remove_original=settings.remove_original, workers=settings.workers, reader=usable_bytes)
        store.add_results(session_id, results)
        counts = results.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status").isin("classified", "string")).alias("answered")).first()
        store.set_state(session_id, "FAILED" if counts.n and not counts.answered else "COMPLETED")
    except Exception:
        store.set_state(session_id, "FAILED")
        raise
    return found.actions.unionByName(plan)
