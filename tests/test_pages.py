"""Results in pages: every row once and in order, and no call holds more than a page."""

import json

import pytest
from pyspark.sql import functions as F

from portcullis import pages
from portcullis.server import Server


def test_pages_of_a_table(spark):
    df = spark.range(2_345).select((F.col("id") * 7919 % 2_345).alias("k"), F.concat(F.lit("v"), F.col("id")).alias("v")).repartition(5)
    cursor, found, sizes = pages.write(df, ["k"], 100), [], []
    while cursor:
        rows, after = pages.read(spark, cursor)
        assert rows.columns == ["k", "v"]
        files = rows.inputFiles()
        assert files and all("__page=" + cursor.split(":")[1] + "/" in f for f in files)  # only its own range is read
        part = [r["k"] for r in rows.collect()]
        sizes.append(len(part))
        found += part
        cursor = after
    assert found == list(range(2_345)) and sizes == [100] * 23 + [45]
    assert pages.write(df.limit(0), ["k"]) is None
    for bad in ("", "x", "../../etc:0", "0" * 32 + ":0", "0" * 32 + ":x"):
        with pytest.raises(pages.CursorError):
            pages.read(spark, bad)


def test_a_scan_is_listed_in_pages(spark, tmp_path):
    for i in range(7):
        (tmp_path / f"f{i}.ts").write_text("".join(f'hasRole("r{i}{j}");\n' for j in range(5)))
    s = Server(spark, str(tmp_path))
    call = lambda **a: s.line(json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "scan_authz", "arguments": a}}))["result"]
    whole = call()["structuredContent"]
    assert len(whole["findings"]) == 35 and "next_cursor" not in whole and whole["enforcement_points"] == 0
    page, found = call(page_size=8)["structuredContent"], []
    while True:
        assert len(page["findings"]) <= 8
        found += page["findings"]
        if "next_cursor" not in page:
            break
        page = call(cursor=page["next_cursor"])["structuredContent"]
    assert found == whole["findings"] == sorted(found, key=lambda f: (f["file"], f["line_start"]))
    assert call(cursor="nope")["isError"]
    (tmp_path / "none").mkdir()
    assert call(path="none")["structuredContent"] == {"findings": [], "enforcement_points": 0}
