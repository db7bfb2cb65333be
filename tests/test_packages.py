"""Files of one package in several batches of a stream give what a scan of all of them gives."""

import pytest

from portcullis import model, rules
from portcullis.operators.scan import Scan
from portcullis.streaming import scan_packages

USES = 'package p\n\nfunc f() {\n    if HasRole("admin") {\n        g()\n    }\n    ok := e.Enforce("edit", post)\n    %s\n}\n'
BINDS = 'package p\n\nimport gate "x/authz/client"\n\nvar e = gate.New()\n'
BATCHES = [
    [("m/p/a.go", USES % "use(ok)"), ("m/q/b.go", USES % ""), ("web/x.ts", 'hasRole("a");\n')],
    [("m/p/binds.go", BINDS), ("web/y.ts", 'import { can } from "../authz/c";\ncan("x:y");\nhasRole("b");\n')],
    [("notes.txt", "none")],
    [("m/p/more.go", USES % "e2 := e"), ("web/x.ts", 'hasRole("changed");\nhasRole("twice");\n')],
    [("m/q/binds.go", BINDS.replace("package p", "package q"))],
]


@pytest.mark.parametrize("options", [{}, {"languages": ["go"]}])
def test_batches_of_a_package_equal_one_scan(spark, tmp_path, options):
    told, batches = {}, []

    def sink(found, points, about, n):
        files = {r["file"] for r in about.collect()}
        batches.append(files)
        for f in files:
            told[f] = set()
        for r in found.select("file", "line_start", "pattern_rule", "id").collect():
            told[r["file"]].add(("finding", *r[1:]))
        for r in points.collect():
            told[r["file"]].add(("point", r["line_start"]))

    def scanned(n):
        last = {p: c for b in BATCHES[:n] for p, c in b}
        s = Scan(spark.createDataFrame(list(last.items()), model.SOURCE_FILES), rules.builtin(), **options)
        out = {}
        for r in s.findings.select("file", "line_start", "pattern_rule", "id").collect():
            out.setdefault(r["file"], set()).add(("finding", *r[1:]))
        for r in s.enforcement_points.collect():
            out.setdefault(r["file"], set()).add(("point", r["line_start"]))
        return out

    source = tmp_path / "in"
    for n, files in enumerate(BATCHES, 1):
        spark.createDataFrame(files, model.SOURCE_FILES).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(model.SOURCE_FILES).parquet(str(source))
        q = scan_packages(stream, rules.builtin(), sink, str(tmp_path / "state"), str(tmp_path / "c"), **options)
        q.processAllAvailable()
        q.stop()
        assert q.exception() is None
        if n in (2, 5):
            assert {f: x for f, x in told.items() if x} == scanned(n)
    before, after = batches[0], batches[1]
    assert "m/p/a.go" in before & after and "m/q/b.go" not in after  # only scopes with new files are routed anew
    assert any(x[0] == "point" for x in told["m/p/a.go"]) and batches[2] == set()
