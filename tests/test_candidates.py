"""Candidates of a second look against a brute-force version."""

import re

from pyspark.sql import functions as F

from portcullis import registry
from portcullis.operators import candidates
from portcullis.plans import catalog
from portcullis.plans.scans import _scan, code

catalog.load()
SF = "/root/testdata/sf0.001"


def test_select_candidates(spark):
    got = [tuple(r) for r in registry.QUERIES["select_candidates"](spark, SF).select("kind", "file", "language", "line_start", "line_end").collect()]
    found = _scan(spark, SF, "ts").findings.collect()
    texts = {r["path"]: r["content"].split("\n") for r in code(spark, SF, "ts").collect()}
    order = lambda f: f.split("/")
    low = [r for r in found if r["confidence"] == "low" or r["confidence"] == "medium" and r["category"] in ("business_rule", "custom", "ownership")]
    chosen = sorted(low, key=lambda r: (order(r["file"]), r["line_start"], r["id"]))[:50]
    around = lambda f, a, b: (max(1, min(a, len(texts[f])) - 5), min(len(texts[f]), max(min(b, len(texts[f])), min(a, len(texts[f]))) + 15))
    want = [("escalation", r["file"], "typescript", *around(r["file"], r["line_start"], r["line_end"])) for r in chosen]
    pattern = re.compile(re.sub(r"^\(\?\w+\)", "(?i)", candidates.AUTH_NAME))
    regions = []
    for f, lines in texts.items():
        covered = sorted({x for i, line in enumerate(lines, 1) if pattern.search(line) for x in range(max(1, i - 5), i + 16)})
        for i in covered:
            if regions and regions[-1][0] == f and regions[-1][2] == i - 1:
                regions[-1][2] = i
            else:
                regions.append([f, i, i])
    free = [r for r in regions if not any(w[1] == r[0] and w[3] <= r[2] and r[1] <= w[4] for w in want)]
    budget = candidates.cold_budget(50, len(chosen))
    likely = {r["path"]: r["p"] for r in code(spark, SF, "ts").select("path", candidates.paths.priority(F.col("path")).alias("p")).collect()}
    cold = sorted(free, key=lambda r: (-int(likely[r[0]]), order(r[0]), r[1]))[:budget]
    want += [("cold_region", f, "typescript", *around(f, a, b)) for f, a, b in cold]
    assert sorted(got) == sorted(want)


def test_clear_of_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    regions = [(f"f{rng.randrange(3)}", a := rng.randrange(1, 200), a + rng.randrange(12)) for _ in range(120)]
    taken = [(f"f{rng.randrange(4)}", a := rng.randrange(1, 200), a + rng.randrange(-1, 6)) for _ in range(40)]
    schema = "file string, line_start bigint, line_end bigint"
    got = [tuple(r) for r in candidates.clear_of(spark.createDataFrame(regions, schema), spark.createDataFrame(taken, schema)).collect()]
    want = [r for r in regions if not any(t[0] == r[0] and t[1] <= t[2] and r[1] <= t[2] and t[1] <= r[2] for t in taken)]
    assert sorted(got) == sorted(want)
