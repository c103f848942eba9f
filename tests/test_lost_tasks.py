"""Repeated tasks: every task of the write fails once, half-way, in a session that retries."""

import os
import subprocess
import sys

SCRIPT = """
import os, sys
sys.path.insert(0, sys.argv[1])
from pyspark import TaskContext
from pyspark.sql import SparkSession
import tidyloom as tl

folder = sys.argv[2]
spark = (
    SparkSession.builder.master("local[4,3]")
    .config("spark.ui.enabled", "false")
    .config("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    .getOrCreate()
)

def fail_once(batches):
    context = TaskContext.get()
    for number, batch in enumerate(batches):
        if number == 5 and context.attemptNumber() == 0:
            raise RuntimeError("lost")
        yield batch

df = spark.range(0, 10_000, 1, 4).mapInArrow(fail_once, "id bigint")
catalog = {"t": {"file_path": folder + "/t", "file_format": "feather"}}
tl.save_data(df, catalog, "t")
back = tl.load_data(spark, catalog, "t")
split = {"t": {"file_path": folder + "/s", "file_format": "feather", "save": {"partitionBy": "k"}}}
tl.save_data(df.selectExpr("id", "id % 7 AS k"), split, "t")
there = tl.load_data(spark, split, "t")
assert there.count() == 10_000 and there.filter("k = id % 7").distinct().count() == 10_000
assert sum(len(names) for _, _, names in os.walk(folder + "/s")) == 4 * 7 + 1
files = [f for f in os.listdir(folder + "/t") if f.startswith("part")]
print("RESULT", back.count(), back.distinct().count(), len(files), sorted({f[:4] for f in os.listdir(folder + "/t")}))
"""


def test_repeated_tasks_double_nothing(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run(
        [sys.executable, "-c", SCRIPT, root, str(tmp_path)],
        capture_output=True,
        text=True,
        timeout=300,
        cwd=tmp_path,
    )
    assert "RESULT 10000 10000 4 ['_man', 'part']" in run.stdout, run.stdout + run.stderr[-2000:]
