"""Planned file actions and their execution."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.plans.scratch import Scratch
from curata.sources.sink import DONE, STATUS, ActionSink, put, same

PLAN = "action string, src string, dst string, reason string"
#: Copies come before the moves and deletes of their sources.
STEPS = [("copy",), ("move", "mark"), ("delete",)]


def _mounted(work: Scratch) -> str:
    """The scratch folder as a path; the files of actions and their journals lie on mounted stores."""
    if not work.root.startswith(("file:", "/")):
        raise ValueError("give apply_actions a journal folder that the driver and all executors have mounted")
    return work.root.removeprefix("file:")


def apply_actions(plan: DataFrame, dry_run: bool = True, journal: str | None = None) -> DataFrame:
    """(action, src, dst, status) of each action of a plan, carried out by tasks.

    A dry run touches nothing. Copies are one job, moves the next, deletes the last, and a job begins when the one before has
    committed; a job that fails raises after its own work is taken back, so no original is lost. One failing action has
    its own status and stops no other; a target that exists is left, and of several actions with one target the smallest
    src has it. A delete whose dst names the copy that replaces its file leaves the file unless that copy is there, byte
    for byte. journal is a folder for the status rows; the default lies in the shared folder.
    """
    if dry_run:
        return plan.select("action", "src", "dst", F.lit("planned").alias("status"))
    spark = plan.sparkSession
    spark.dataSource.register(ActionSink)
    work = Scratch(spark, "actions")
    folder = journal or f"{_mounted(work)}/journal"
    os.makedirs(folder, exist_ok=True)
    planned = work.table(plan.select("action", "src", "dst"), "plan")  # the plan may read what the actions change
    for k, kinds in enumerate(STEPS):
        step = planned.filter(F.col("action").isin(*kinds))
        # a target's actions meet in one task, in the order of their sources
        dealt = step.repartition(F.col("src") if kinds == ("delete",) else F.col("dst")).sortWithinPartitions("dst", "src")
        dealt.write.format("curata_actions").mode("append").save(f"{folder}/{k}")
    return spark.read.schema(STATUS).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)


def write_repaired(rows: DataFrame, dry_run: bool = True) -> DataFrame:
    """(path, status): repaired contents over their files, each backed up to `<grandparent>/broken_imgs/` first.

    rows has path and fixed. Tasks write the contents where they are. A backup of other bytes is that row's failure and
    stops no other; one of the same bytes is that of a task that was lost, and the row is done again.
    """
    if dry_run:
        return rows.select("path", F.lit("planned").alias("status"))

    def repair(path: str, fixed: bytes) -> str:
        backup = os.path.join(os.path.dirname(os.path.dirname(path)), "broken_imgs", os.path.basename(path))
        try:
            if not same(path, backup):
                put(path, backup)
            beside = f"{path}.curata"
            with open(beside, "wb") as f:
                f.write(fixed)
            os.replace(beside, path)
        except OSError as e:
            return f"failed: {e}"
        return DONE

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "status": [repair(p, c) for p, c in zip(pdf["path"], pdf["fixed"], strict=True)]})

    known = rows.filter("fixed is not null").select("path", "fixed")
    return Scratch(rows.sparkSession, "repaired").table(known.mapInPandas(run, "path string, status string"), "status")
