"""First-seen hashes across scans: an index that each scan reads once and adds its new hashes to.

The index is a table bucketed and sorted by hash, so a scan's join with it shuffles the scan's distinct hashes only, never the
index, which holds one row a hash, no contents and no paths of copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.plans.scratch import Scratch

COLUMNS = "hash string, scan bigint, first string"


class SeenIndex:
    """A table of the catalog, in the warehouse that all machines share. Scans are numbered, and added in that order.

    A hash's original is the smallest path of the first scan that has it: an original that was kept after one scan never
    turns into a copy of a later file, whatever its path. A scan that is added again, as after a crash, gives the rows that
    it gave, and adds nothing that the index has; one older than the newest is an error.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int = 64):
        self.spark, self.name, self.buckets = spark, name, buckets
        if not spark.catalog.tableExists(name) and spark.catalog.tableExists(f"{name}_merged"):  # a merge that ended midway
            spark.sql(f"ALTER TABLE {name}_merged RENAME TO {name}")
        if not spark.catalog.tableExists(name):
            self._append(spark.createDataFrame([], COLUMNS))

    def _append(self, rows: DataFrame) -> None:
        dealt = rows.repartition(self.buckets, "hash")  # one file a bucket and scan
        dealt.write.mode("append").format("parquet").bucketBy(self.buckets, "hash").sortBy("hash").saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def looked_up(self, files: DataFrame, scan: int) -> DataFrame:
        """(hash, first, first_scan) of the scan's distinct hashes. Copies are reduced to one row a hash before the join, and
        these rows are dealt out as the index is: as many partitions as it has buckets, whatever the session's number."""
        own = files.filter("hash is not null").groupBy("hash").agg(F.min("path").alias("own")).repartition(self.buckets, "hash")
        known = self.rows().filter(F.col("scan") < scan).select("hash", "scan", "first")
        return known.join(own, "hash", "right").select("hash", F.coalesce("first", "own").alias("first"), F.coalesce("scan", F.lit(scan)).cast("bigint").alias("first_scan"))

    def marked(self, files: DataFrame, scan: int) -> DataFrame:
        """The scan's rows (path, hash and others) with first, the path of the hash's original, and first_scan, its scan.

        Rows without a hash (unreadable files) have neither. What was looked up is written, so that it is looked up once and
        a hash that many files share is a skewed join of two shuffles, which adaptive execution splits.
        """
        return self._join(files, Scratch(self.spark, "seen").table(self.looked_up(files, scan), "firsts"))

    @staticmethod
    def _join(files: DataFrame, firsts: DataFrame) -> DataFrame:
        return files.join(firsts, "hash", "left").select(*files.columns, "first", "first_scan")

    def add(self, files: DataFrame, scan: int) -> DataFrame:
        """As `marked`; the scan's new hashes are in the index when it returns. files must give the same rows when read again."""
        newest = self.rows().agg(F.max("scan")).first()[0]
        if newest is not None and scan < newest:
            raise ValueError(f"scan {scan} is older than scan {newest}, which the index has")
        firsts = Scratch(self.spark, "seen").table(self.looked_up(files, scan), "firsts")
        there = self.rows().filter(F.col("scan") == scan).select("hash")  # of this scan, added before a crash
        new = firsts.filter(F.col("first_scan") == scan).join(there, "hash", "left_anti")
        self._append(new.select("hash", F.lit(scan).cast("bigint").alias("scan"), "first"))
        return self._join(files, firsts)

    def merge_files(self) -> None:
        """Rewrites the index as one file a bucket under a new name, which then takes the old one's place."""
        merged = f"{self.name}_merged"
        self.spark.sql(f"DROP TABLE IF EXISTS {merged}")
        rows = self.rows().repartition(self.buckets, "hash")
        rows.write.format("parquet").bucketBy(self.buckets, "hash").sortBy("hash").saveAsTable(merged)
        self.spark.sql(f"DROP TABLE {self.name}")
        self.spark.sql(f"ALTER TABLE {merged} RENAME TO {self.name}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
