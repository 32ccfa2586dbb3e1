"""The sink of files: commit, failure, attempts that were run twice, folders, names."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from corvina.sources import files, writers


def tree(path):
    return {os.path.relpath(os.path.join(d, f), path): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(path) for f in names}


def test_folders_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(40).select(F.format_string("f%d/x.png", F.col("id") % 20 + 20 * (F.col("id") / 20).cast("int")).alias("name"), F.col("id").cast("string").alias("content"))
    writers.write_files(rows.repartition(4), path)
    assert tree(path) == {f"f{i}/x.png": str(i).encode() for i in range(40)} and not os.path.exists(f"{path}/_staging")
    writers.write_files(spark.createDataFrame([("a/b/c", None)], "name string, content string"), path)
    assert len(tree(path)) == 41 and tree(path)["a/b/c"] == b""
    writers.write_files(rows.limit(2), path, overwrite=True)
    assert set(tree(path)) == {"f0/x.png", "f1/x.png"}
    writers.copy_assets(spark, path, str(tmp_path / "copy"))
    assert sorted(r.name for r in spark.read.parquet(str(tmp_path / "copy")).collect()) == ["f0/x.png", "f1/x.png"]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    writers.write_files(spark.createDataFrame([("old", "1")], "name string, content string"), path)
    bad = spark.createDataFrame([("a", "1"), ("b", "2"), ("../c", "3")], "name string, content string").repartition(3)
    for overwrite in (False, True):
        with pytest.raises(Exception, match="not a file name"):
            writers.write_files(bad, path, overwrite)
        assert tree(path) == {"old": b"1"} and not os.path.exists(f"{path}/_staging")


def test_a_task_run_twice(tmp_path):
    """A lost attempt's files, whole or half written, never move in, whichever attempt is committed."""
    writer = files.FileWriter(str(tmp_path / "out"), False)
    writer.write([Row(name="x", content=b"first"), Row(name="only-in-first", content=b"1")])
    with pytest.raises(ZeroDivisionError):
        writer.write(Row(name=f"n{1 // (2 - i)}", content=b"half") for i in range(3))
    second = writer.write([Row(name="x", content=b"second")])
    writer.commit([second, None])
    assert tree(tmp_path / "out") == {"x": b"second"} and os.listdir(tmp_path / "out") == ["x"]


@pytest.mark.parametrize("name", [None, "", "/etc/x", "a//b", "a/../b", ".", "_staging/x"])
def test_names_that_leave_the_folder(name):
    with pytest.raises(ValueError, match="not a file name"):
        files.checked(name)
