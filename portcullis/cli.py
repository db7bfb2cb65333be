"""Commands: scan (the default), extract, rules list|validate|test, init, mcp."""

from __future__ import annotations

import argparse
import os
import sys
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

from portcullis import model, rules
from portcullis.deep import run as deep
from portcullis.deep.settings import build
from portcullis.deep.transports import analyzer
from portcullis.functions.policy_check import validate_template
from portcullis.operators import findings as ops
from portcullis.operators import scan
from portcullis.sources import config as settings
from portcullis.sources import findings_json, sinks
from portcullis.sources.files import source_files

KEY = "PORTCULLIS_API_KEY"
PREFIX, OUTPUT = "app", "./policies/generated"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="portcullis", description=__doc__)
    top.add_argument("--config", default=settings.FILE)
    commands = top.add_subparsers(dest="command")
    s = commands.add_parser("scan")
    s.add_argument("path", nargs="?", default=".")
    s.add_argument("-l", "--language", action="append", default=[], choices=model.LANGUAGES)
    s.add_argument("-c", "--category", action="append", default=[], choices=list(model.CATEGORIES))
    s.add_argument("--confidence", choices=model.CONFIDENCES)
    s.add_argument("-e", "--exclude", action="append", default=[])
    s.add_argument("-f", "--format", default="text", choices=("text", "json"))
    s.add_argument("-o", "--output")
    s.add_argument("--rules-dir")
    s.add_argument("--deep", action="store_true")
    for name in ("--base-url", "--model", "--agent-cmd"):
        s.add_argument(name)
    s.add_argument("--max-cost", type=float)
    s.add_argument("--api-key", default=os.environ.get(KEY))
    x = commands.add_parser("extract")
    x.add_argument("-i", "--input")
    x.add_argument("--output-dir", default=OUTPUT)
    x.add_argument("--policy-prefix", "--package-prefix", default=PREFIX)
    x.add_argument("--engine", default="rego", choices=model.ENGINES)
    x.add_argument("--min-confidence", choices=model.CONFIDENCES)
    r = commands.add_parser("rules")
    r.add_argument("action", choices=("list", "validate", "test"))
    r.add_argument("--rules-dir")
    i = commands.add_parser("init")
    i.add_argument("path", nargs="?", default=".")
    m = commands.add_parser("mcp")
    m.add_argument("--scan-root", default=".")
    m.add_argument("--rules-dir")
    return top


def session() -> SparkSession:
    return SparkSession.builder.appName("portcullis").getOrCreate()


@contextmanager
def opened(path: str | None):
    if path is None:
        yield sys.stdout
    else:
        with open(path, "w", encoding="utf-8") as f:
            yield f


def do_scan(a: argparse.Namespace, c: settings.Config) -> int:
    if not a.deep and (given := [n for n in ("base_url", "model", "agent_cmd", "max_cost") if getattr(a, n) is not None]):
        raise settings.ConfigError(f"{', '.join(given)} go with --deep")
    root = str(Path(a.path).resolve())
    second = build(c, a.base_url, a.model, a.agent_cmd, a.api_key, a.max_cost, a.exclude, a.language) if a.deep else None
    files = source_files(session(), root, [*c.scan.exclude, *a.exclude], ignore=True)
    s = scan.Scan(files, rules.load(c.rules.additional, a.rules_dir), a.confidence or c.scan.min_confidence, a.category, a.language)
    found = s.findings
    if second is not None:
        found = deep.run(found, ops.in_languages(files, []), second, analyzer(second))
    with opened(a.output) as out:
        if a.format == "json":
            sinks.report_json(found, s.enforcement_points, root, out)
        else:
            sinks.report_text(found, s.enforcement_points, out)
    return 0


def do_extract(a: argparse.Namespace, c: settings.Config) -> int:
    prefix = c.extract.package_prefix if c.extract.package_prefix and a.policy_prefix == PREFIX else a.policy_prefix
    folder = c.extract.output_dir if c.extract.output_dir and a.output_dir == OUTPUT else a.output_dir
    spark = session()
    found = findings_json.read(spark, a.input) if a.input else findings_json.parse(spark.createDataFrame([(sys.stdin.read(),)], "value string"))
    found = ops.min_confidence(found, a.min_confidence)
    if found.isEmpty():
        print("No findings to extract.", file=sys.stderr)
        return 0
    sinks.write_policies(found, a.engine, folder, prefix, sys.stderr)
    return 0


def do_rules(a: argparse.Namespace, c: settings.Config) -> int:
    given = rules.load(c.rules.additional, a.rules_dir)
    if a.action == "list":
        for r in given:
            print(f"{r.id:<48} {','.join(r.languages):<24} {r.category:<14} {r.confidence}")
        return 0
    if a.action == "validate":
        bad = list(scan.validate_rules(given).values())
        bad += [f"{r.id}: {e}: {why}" for r in given for e, t in r.templates for ok, why in [validate_template(e, t)] if not ok]
        print("\n".join([*bad, f"{len(given)} rules, {len(bad)} errors"]))
        return int(bool(bad))
    failed = scan.test_rules(session(), given).where("not passed").orderBy("rule_id", "test").collect()
    print("\n".join([*(f"{r['rule_id']}, test {r['test']}: expected {r['expected']}" for r in failed), f"{sum(len(r.tests) for r in given)} tests, {len(failed)} failed"]))
    return int(bool(failed))


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    known = {"scan", "extract", "rules", "init", "mcp", "-h", "--help", "--config"}
    if not argv or argv[0] not in known and not argv[0].startswith("--config="):
        argv = ["scan", *argv]
    a = parser().parse_args(argv)
    try:
        if a.command == "init":
            print(f"Created {settings.write_default(a.path)}")
            return 0
        c = settings.load(a.config)
        if a.command == "mcp":
            from portcullis.server import Server

            Server(session(), a.scan_root, a.rules_dir, c).serve(sys.stdin, sys.stdout)
            return 0
        return {"scan": do_scan, "extract": do_extract, "rules": do_rules}[a.command](a, c)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
