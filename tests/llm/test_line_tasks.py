"""Line removal does not run a full set of tasks for a few rows; tasks do not search imported modules for garbage."""

import gc

from papyra.llm.common import trimmed
from papyra.llm.line_dedup import dedup_lines


def test_few_rows_make_few_tasks(spark):
    run = " ".join(f"word{i}" for i in range(30)) + ".\n" + " ".join(f"more{i}" for i in range(30)) + "."
    docs = spark.createDataFrame([(0, run), (1, "Own words.\n" + run), (2, run + "\nLast words.")], "doc_id long, text string").coalesce(1)
    parts, status = spark.conf.get("spark.sql.shuffle.partitions"), spark.sparkContext.statusTracker()
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.sparkContext.setJobGroup("few-rows", "")
    try:
        got = {r.doc_id: r.text for r in dedup_lines(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {0: run, 1: "Own words.", 2: "Last words."}
    stages = {s for j in status.getJobIdsForGroup("few-rows") for s in status.getJobInfo(j).stageIds}
    assert sum(info.numCompletedTasks for s in stages if (info := status.getStageInfo(s))) < 250


def test_imports_are_no_garbage():
    gc.unfreeze()
    assert list(trimmed(iter([1, 2]))) == [1, 2] and gc.get_freeze_count() > 1000
    gc.unfreeze()
