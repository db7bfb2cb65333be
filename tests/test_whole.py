"""Queries that give a row for every finding do so; test_oracles.py holds them against their SQL."""

import pytest

from portcullis import registry
from portcullis.plans import catalog

catalog.load()
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["context_window", "extract_lines", "overlap_fraction", "semantic_rule_id", "findings_in_order", "default_stub_rego", "default_stub_cedar"])
def test_every_finding_has_a_row(spark, name):
    seqs = [r["seq"] for r in registry.QUERIES[name](spark, SF).select("seq").collect()]
    assert sorted(seqs) == sorted(r["event_id"] for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id").collect())
