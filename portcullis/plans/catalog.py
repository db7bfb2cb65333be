"""Imports every module that registers queries, and names the flagship one."""

from __future__ import annotations

import importlib

FLAGSHIP = "scan_summary"

MODULES = ("portcullis.plans.relational", "portcullis.plans.scans", "portcullis.plans.pipelines", "portcullis.plans.rule_scans")


def load() -> None:
    for name in MODULES:
        importlib.import_module(name)
