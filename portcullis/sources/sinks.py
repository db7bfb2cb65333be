"""Reports and policy files. Findings are ordered by Spark, policy files are written by its tasks; one-row summaries, and the lines of a report
or a log, come to the driver, one partition at a time."""

from __future__ import annotations

import json
import os
import re
from typing import TextIO

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portcullis import model
from portcullis.checkpoints import checkpointed
from portcullis.operators import findings as ops
from portcullis.operators import policies
from portcullis.sources import policy_sink
from portcullis.sources.policy_sink import SinkError

VERSION = "0.1.0"


def _plain(row) -> dict:
    d = row.asDict(recursive=True)
    return {k: v for k, v in d.items() if v is not None}


def report_json(findings: DataFrame, points: DataFrame, root: str, out: TextIO) -> None:
    """The report with all findings in order."""
    s = ops.summary(findings, points).first()
    head = {"externalized_pct": s["externalized_pct"], "externalized": s["enforcement_points"], "embedded_findings": s["findings"], "total_enforcement_points": s["findings"] + s["enforcement_points"]}
    tail = {
        "total_findings": s["findings"], "enforcement_points": s["enforcement_points"], "externalized_pct": s["externalized_pct"],
        "by_category": {c: s[f"n_{c}"] for c in model.CATEGORIES if s[f"n_{c}"]}, "by_confidence": {c: s[c] for c in model.CONFIDENCES if s[c]}, "files_with_findings": s["files"],
    }
    pad = lambda x, n: json.dumps(x, indent=2, ensure_ascii=False).replace("\n", "\n" + " " * n)
    out.write('{\n  "version": ' + json.dumps(VERSION) + ',\n  "scan_root": ' + json.dumps(root) + ',\n  "headline": ' + pad(head, 2) + ',\n  "findings": [')
    for i, row in enumerate(ops.in_order(findings, "id").toLocalIterator()):
        out.write(("," if i else "") + "\n    " + pad(_plain(row), 4))
    out.write(("\n  " if s["findings"] else "") + '],\n  "summary": ' + pad(tail, 2) + "\n}\n")


def report_text(findings: DataFrame, points: DataFrame, out: TextIO) -> None:
    s = ops.summary(findings, points).first()
    n, e = s["findings"], s["enforcement_points"]
    if n + e == 0:
        out.write("No authorization patterns found.\n")
        return
    out.write(f"Externalization: {s['externalized_pct']}% ({e} externalized / {n + e} enforcement points)\n\n")
    if not n:
        return
    for i, f in enumerate(ops.in_order(findings, "id").toLocalIterator()):
        if i:
            out.write("---\n\n")
        tag = "  [frontend]" if f["surface"] == "frontend" else ""
        out.write(f"  {f['file']}:{f['line_start']}  [{model.CATEGORIES[f['category']]}]  {f['confidence']}{tag}\n  {f['description']}\n")
        if f["pattern_rule"]:
            out.write(f"  Rule: {f['pattern_rule']}\n")
        out.write("\n" + "".join(f"    {f['line_start'] + k:>4} | {line}\n" for k, line in enumerate(f["code_snippet"].splitlines())) + "\n")
    parts = ", ".join(f"{s[c]} {c}" for c in reversed(model.CONFIDENCES) if s[c])
    out.write(f"Summary: {n} findings in {s['files']} files ({parts})\n")


def write_policies(findings: DataFrame, engine: str, output_dir: str, prefix: str, log: TextIO | None = None) -> int:
    """Policy files of all findings, written by tasks; how many. Files that fail the check are written all the same, with a warning. Of source
    files with the same policy file the last in order of their paths stays."""
    spark, root = findings.sparkSession, os.path.abspath(output_dir)
    policy_sink.register(spark)
    files = checkpointed(policies.policy_files(findings, engine, root, prefix))
    last = files.groupBy("output_path").agg(F.max_by("content", model.path_order(F.col("file"))).alias("content"))
    try:
        last.write.format(policy_sink.FORMAT).mode("append").save(root)
    except PySparkException as e:
        if "SinkError" in str(e):
            raise SinkError(re.search(r"SinkError: (.*)", str(e))[1]) from e
        raise
    s = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("finding_count"), F.lit(0)).alias("total")).first()
    if log:
        warned = 0
        for f in policies.reasons(files, engine).orderBy(model.path_order(F.col("file"))).toLocalIterator():
            warned += f["valid"] is False
            log.write(f"  [{'OK' if f['valid'] else 'WARN'}] {f['label']} ({f['finding_count']} findings) -> {f['output_path']}\n" + (f"       {f['why']}\n" if f["why"] else ""))
        log.write(f"\nGenerated {s['n']} {engine} files from {s['total']} findings.\n" + (f"{warned} of them need a look at their syntax.\n" if warned else ""))
    return s["n"]
