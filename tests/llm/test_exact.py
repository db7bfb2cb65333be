import hashlib
import re
from collections import Counter

from portcullis.llm import exact_dedup as X

from .conftest import ODD


def brute(rows):
    groups = {}
    for i, (key, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), key is None, key or 0, i))
    out = Counter()
    for norm, members in groups.items():
        best = min(members)
        for m in members:
            out[(None if m[1] else m[2], None if best[1] else best[2], len(members), m == best, hashlib.sha256(norm.encode()).hexdigest())] += 1
    return out


ROWS = [*ODD, (10, "a b c"), (11, "abc"), (12, "a\tb\r\nc  "), (13, "abc "), (9, "a b  c"), (9, "a b  c"), *((100 + i, "hot text") for i in range(300))]


def test_groups_match_brute_force(spark, documents):
    found = X.exact_dedup(documents(ROWS)).collect()
    assert Counter(tuple(r) for r in found) == brute(ROWS)


def test_hot_digests_take_the_broadcast_way(spark, documents):
    from portcullis.llm.common import checkpointed, with_row

    d = checkpointed(X.digests(with_row(documents(ROWS))))
    top = d.selectExpr(f"approx_top_k(xxhash64(digest), {X.HEAVY}, {X.TRACKED}) AS t").first()["t"]
    assert max(x["count"] for x in top) == 300


def test_drop_copies_keeps_one_row_of_each_group_and_all_columns(spark, documents):
    docs = documents(ROWS)
    kept = X.drop_copies(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(k for (k, _, _, stays, _), n in brute(ROWS).items() if stays for _ in range(n))


def test_empty_table(spark, documents):
    assert X.exact_dedup(documents([])).collect() == []
    assert X.drop_copies(documents([])).collect() == []


def test_row_numbers_hold_whatever_the_splits(spark, documents, tmp_path):
    from portcullis.llm.common import ROW, with_row

    docs = documents([(i, f"text {i} " + "x" * 500) for i in range(3000)])
    docs.repartition(3).write.parquet(str(tmp_path / "d"))
    read = spark.read.parquet(str(tmp_path / "d")).drop("__row").where("doc_id % 7 <> 0")
    rows = with_row(read)
    first = {r["doc_id"]: r[ROW] for r in rows.select("doc_id", ROW).collect()}
    assert len(set(first.values())) == len(first) == 2571
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        assert {r["doc_id"]: r[ROW] for r in rows.select("doc_id", ROW, "text").collect()} == first
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    kept = X.drop_copies(spark.read.parquet(str(tmp_path / "d")))
    assert kept.count() == 3000 and kept.columns == docs.columns
