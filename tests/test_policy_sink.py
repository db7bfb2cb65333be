"""Policy files are written by tasks, all or none."""

import os

import pytest
from pyspark.sql import functions as F

from portcullis.sources import policy_sink as P


def listed(root):
    return {os.path.relpath(os.path.join(at, f), root) for at, _, files in os.walk(root) for f in files}


@pytest.fixture
def save(spark, tmp_path):
    P.register(spark)

    def run(df, root=tmp_path / "out"):
        df.write.format(P.FORMAT).mode("append").save(str(root))
        return root

    return run


def test_many_files_are_written_by_tasks(spark, save, tmp_path):
    root = tmp_path / "out"
    n = 100_000
    df = spark.range(n, numPartitions=16).select(F.concat(F.lit(f"{root}/d"), F.col("id") % 100, F.lit("/f"), F.col("id"), F.lit(".rego")).alias("output_path"), F.concat(F.lit("package p"), F.col("id"), F.lit("\r\né\n")).alias("content"))
    save(df)
    found = listed(root)
    assert len(found) == n and f"d7/f{n - 93}.rego" in found and not any(".policies" in f for f in found)
    assert (root / "d99/f99.rego").read_bytes() == "package p99\r\né\n".encode()
    save(df.limit(5).withColumn("content", F.lit("new")))  # what is there is replaced, the rest stays
    assert len(listed(root)) == n and sum((root / f"d{i % 100}/f{i}.rego").read_text() == "new" for i in range(n // 10)) <= 5


def test_a_task_that_fails_leaves_nothing(spark, save, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "out/old.rego").write_text("old")
    df = spark.range(40, numPartitions=4).select(F.concat(F.lit("f"), F.col("id"), F.lit(".rego")).alias("output_path"), F.when(F.col("id") == 35, F.raise_error(F.lit("broken"))).otherwise("text").alias("content"))
    with pytest.raises(Exception, match="broken"):
        save(df)
    assert listed(tmp_path / "out") == {"old.rego"} and os.listdir(tmp_path / "out") == ["old.rego"]


def test_a_path_outside_or_through_a_link_stops_all(spark, save, tmp_path):
    root = tmp_path / "out"
    root.mkdir()
    (tmp_path / "other").mkdir()
    (root / "link").symlink_to(tmp_path / "other")
    (root / "file.rego").symlink_to(tmp_path / "other/x")
    for bad in ("../up.rego", f"{tmp_path}/other/y.rego", "link/z.rego", "file.rego", "a/../../b.rego", str(root)):
        df = spark.createDataFrame([(f"ok{i}.rego", "x") for i in range(8)] + [(bad, "x")], P.SCHEMA).repartition(3)
        with pytest.raises(Exception, match="SinkError"):
            save(df)
        assert sorted(os.listdir(root)) == ["file.rego", "link"] and os.listdir(tmp_path / "other") == []
    assert P.inside(root, f"{root}/a/../c.rego") == root.resolve() / "c.rego"


def test_a_second_attempt_counts_once(tmp_path, monkeypatch):
    """Two attempts of one task: only the one whose message counts is moved."""
    w = P.Writer(str(tmp_path))
    w.staging.mkdir()
    import pyarrow as pa

    class Task:
        def __init__(self, attempt):
            self.attempt = attempt

        def partitionId(self):
            return 0

        def taskAttemptId(self):
            return self.attempt

    batch = lambda text: pa.RecordBatch.from_pydict({"output_path": ["a/b.rego"], "content": [text]})
    for attempt in (1, 2):
        monkeypatch.setattr(P.TaskContext, "get", lambda a=attempt: Task(a))
        message = w.write(iter([batch(f"text {attempt}")]))
    w.commit([message, None])
    assert listed(tmp_path) == {"a/b.rego"} and (tmp_path / "a/b.rego").read_text() == "text 2"
    with pytest.raises(FileNotFoundError):
        w.write(iter([]))


def test_modes_and_columns(spark, save, tmp_path):
    df = spark.createDataFrame([("a.rego", None)], P.SCHEMA)
    assert save(df).joinpath("a.rego").read_text() == ""
    with pytest.raises(Exception, match="added to"):
        df.write.format(P.FORMAT).mode("overwrite").save(str(tmp_path / "out"))
    with pytest.raises(Exception, match="output_path"):
        save(spark.range(1).withColumnRenamed("id", "output_path"))
