"""The source_tree format: partitions, filters, ignore files, remote stores, streams."""

import os

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from portcullis.sources import tree as T
from portcullis.sources.files import ignore_rules, source_files
from portcullis.sources.ignore import compiled


def write(root, files):
    for name, content in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)


@pytest.fixture
def ignored(tmp_path):
    """Ignore files at several levels, a folder that a rule of its own can't bring back, names that begin with an underscore."""
    files = ["a.ts", "x.ts", "x/in.ts", "b.gen.ts", "keep.gen.ts", "build/o.ts", "lib/build/o.ts", "lib/own.ts", "lib/deep/own.ts", "lib/_p.py", "_q/r.go", ".h/s.ts", "Rakefile", "lib/gone.ts", "lib/deep/gone.ts", "gone.ts", "lib/notes.txt", "out/a.ts", "out/z.ts"]
    write(tmp_path, {f: f"// {f}\n" for f in files})
    write(tmp_path, {".gitignore": "build/\n*.gen.ts\n!keep.gen.ts\n/x.ts\nout\n\n# c\n[z-\n", "lib/.gitignore": "/own.ts\ngone.ts\n", "out/.gitignore": "!a.ts\n"})
    (tmp_path / "bad.ts").write_bytes(b"\xff\xfe")
    os.symlink(tmp_path / "lib", tmp_path / "linked")
    os.symlink(tmp_path / "a.ts", tmp_path / "b.ts")
    return tmp_path


KEPT = {"a.ts", "gone.ts", "b.ts", "x/in.ts", "keep.gen.ts", "lib/deep/own.ts", "lib/_p.py", "_q/r.go", "Rakefile"}


def paths(df):
    found = [r["path"] for r in df.select("path").collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_local_and_remote_trees_have_the_same_files(spark, ignored):
    for root in (str(ignored), f"file://{ignored}"):
        df = source_files(spark, root, ignore=True)
        assert paths(df) == KEPT
        assert {r["content"] for r in df.collect()} == {f"// {f}\n" if f != "b.ts" else "// a.ts\n" for f in KEPT}
        assert paths(source_files(spark, root, ["lib/**", "x"], ignore=True)) == {"a.ts", "b.ts", "keep.gen.ts", "_q/r.go", "Rakefile", "gone.ts"}
    every = KEPT | {"x.ts", "b.gen.ts", "build/o.ts", "lib/build/o.ts", "lib/own.ts", "lib/gone.ts", "lib/deep/gone.ts", "out/a.ts", "out/z.ts"}
    assert paths(source_files(spark, str(ignored))) == every
    assert paths(source_files(spark, str(ignored), rules=ignore_rules(ignored))) == KEPT


def test_a_store_that_is_not_local(ignored, monkeypatch):
    """The same walk over Arrow's file systems."""
    monkeypatch.setattr(T.Store, "__init__", lambda self, root: self.__dict__.update(root=root, local=False, fs=fs.LocalFileSystem(), base=root))
    tree = T.Tree(str(ignored), rules=compiled([]))
    found = {p for pieces in tree.pieces() for b in tree.batches(T.Part(pieces)) for p in b.column("path").to_pylist()}
    assert found == KEPT | {"linked/deep/own.ts", "linked/_p.py"}  # Arrow doesn't tell links from folders
    with pytest.raises(FileNotFoundError):
        list(T.Tree(str(ignored / "none")).batches(T.Part([T.Piece("", (), True)])))


def test_a_store_that_only_spark_reads(spark, ignored):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.trees.link./in", f"file://{ignored}")
    (ignored / "linked").unlink()
    assert not T.Store.opens("nowhere://trees/in")
    found = paths(source_files(spark, "viewfs://trees/in", ignore=True))
    assert found == {p for p in KEPT if "/_" not in f"/{p}"} | {"out/a.ts"}  # a rule in an ignored folder counts there


def test_pieces_cover_a_tree_once(tmp_path):
    write(tmp_path, {f"d{i % 7}/e{i % 3}/f{i}.ts": "x" for i in range(60)} | {f"flat/g{i}.py": "y" for i in range(900)} | {"top.go": "z"})
    for n in (1, 2, 5, 16, 400):
        tree = T.Tree(str(tmp_path), partitions=n)
        parts = tree.pieces()
        found = [p for pieces in parts for p in tree.files(T.Part(pieces), T.Store(tree.root))]
        assert len(found) == len(set(found)) == 961
        if n == 16:
            assert max(sum(len(list(tree.files(T.Part([x]), T.Store(tree.root)))) for x in pieces) for pieces in parts) < 400  # the flat folder is shared out
    assert T.Tree(str(tmp_path / "d0/e0/none"), partitions=3).root


def test_filters_reach_the_listing(spark, tmp_path, monkeypatch):
    write(tmp_path, {f"s{i}/a{j}.ts": "x" for i in range(4) for j in range(3)})
    T.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    load = lambda **k: spark.read.format(T.FORMAT).options(push=True, **k).load(str(tmp_path))
    for condition, n in (("path LIKE 's1/%'", 3), ("path = 's2/a0.ts'", 1), ("path IN ('s2/a0.ts', 's3/a1.ts', 'none.ts')", 2), ("path LIKE '%a1.ts'", 4), ("path LIKE '%1/a%'", 3), ("path LIKE 's1/%' AND content = 'x'", 3), ("path LIKE 's1/%' OR path LIKE 's2/%'", 6)):
        assert load().where(condition).count() == n
    assert load(under="s1/\ns2/a0").count() == 4 and load(under="s1/\ns2/a0").where("path LIKE 's2%'").count() == 1
    plan = load().where("path LIKE 's1/%'")._jdf.queryExecution().executedPlan().toString()
    assert "StartsWith" not in plan and "BatchScan" in plan  # the source has taken it over
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert spark.read.format(T.FORMAT).load(str(tmp_path)).where("path LIKE 's1/%'").count() == 3
    reader = T.FilteredReader(T.Tree(str(tmp_path), partitions=1))
    assert list(reader.pushFilters([T.StringStartsWith(("path",), "s1/"), T.EqualTo(("content",), "x")])) == [T.EqualTo(("content",), "x")]
    listed = []
    monkeypatch.setattr(T.Store, "entries", lambda self, folder, inner=T.Store.entries: listed.append(folder) or inner(self, folder))
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 3
    assert set(listed) == {"", "s1"}


def test_a_tree_of_many_small_files(spark, tmp_path):
    """No path goes through the driver, and no task has a large share of the files."""
    for i in range(200):
        (tmp_path / f"p{i % 10}/q{i}").mkdir(parents=True)
        for j in range(300):
            (tmp_path / f"p{i % 10}/q{i}/f{j}.ts").write_text(f"{i} {j}")
    (tmp_path / "flat").mkdir()
    for j in range(40_000):
        (tmp_path / f"flat/g{j}.py").write_text(str(j))
    df = source_files(spark, str(tmp_path), ignore=True).withColumn("part", F.spark_partition_id())
    shares = [r["count"] for r in df.groupBy("part").count().collect()]
    assert sum(shares) == 100_000 and max(shares) < 10_000
    assert df.select("path").distinct().count() == 100_000


def test_empty_trees_and_odd_paths(spark, tmp_path):
    assert source_files(spark, str(tmp_path), ignore=True).collect() == []
    write(tmp_path, {"a b/ü'[x].ts": "1", "only.txt": "2"})
    assert paths(source_files(spark, str(tmp_path), ignore=True)) == {"a b/ü'[x].ts"}
    T.register(spark)
    with pytest.raises(Exception, match="no path"):
        spark.read.format(T.FORMAT).load().collect()


def test_a_stream_has_each_file_once(spark, tmp_path, monkeypatch):
    root, out = tmp_path / "tree", tmp_path / "out"
    root.mkdir()
    T.register(spark)

    def run():
        q = spark.readStream.format(T.FORMAT).load(str(root)).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
        q.awaitTermination(60)
        assert q.exception() is None

    def add(name, content, age):
        write(root, {name: content})
        at = T.time.time_ns() - int(age * 1e9)
        os.utime(root / name, ns=(at, at))

    add("a.ts", "1", 100)
    add("d/b.ts", "2", 90)
    run()
    add("d/c.ts", "3", 2.5)  # written after the first batch, at rest by now
    run()
    run()
    found = sorted((r["path"], r["content"]) for r in spark.read.schema(T.SCHEMA).parquet(str(out)).collect())
    assert found[:2] == [("a.ts", "1"), ("d/b.ts", "2")] and len(found) <= 3
    part = lambda lo, hi: [p for x in T.Tree(str(root)).pieces() for b in T.Tree(str(root)).batches(T.Part(x, lo, hi)) for p in b.column("path").to_pylist()]
    now = T.time.time_ns()
    assert part(0, now - int(50e9)) == ["a.ts", "d/b.ts"] and part(now - int(50e9), now) == ["d/c.ts"]
