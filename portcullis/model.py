"""Schemas, enumerations and their orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Wire forms of the enumerations and display names of the categories.
LANGUAGES = ("java", "typescript", "javascript", "python", "go", "csharp", "kotlin", "ruby", "php")
CATEGORIES = {
    "rbac": "RBAC", "abac": "ABAC", "middleware": "Middleware", "business_rule": "Business Rule", "ownership": "Ownership",
    "feature_gate": "Feature Gate", "route": "Route", "custom": "Custom",
}
CONFIDENCES = ("low", "medium", "high")
ENGINES = ("rego", "cedar")

POLICY_OUTPUTS = "array<struct<engine:string,content:string>>"

SOURCE_FILES = "path string, content string"
FINDINGS = (
    "id string, file string, line_start bigint, line_end bigint, code_snippet string, language string, category string, confidence string, "
    f"description string, pattern_rule string, policy_outputs {POLICY_OUTPUTS}, pass string, surface string, provenance string"
)
MATCHES = (
    "file string, language string, rule_id string, rule_ord int, match_seq int, line_start bigint, line_end bigint, code_snippet string, captures map<string,string>"
)
BINDINGS = "scope string, name string"
EDGES = "scope string, lhs string, rhs string"
CANDIDATES = (
    "kind string, file string, language string, line_start bigint, line_end bigint, source_snippet string, imports array<string>, "
    "original_finding_id string, seed_category string"
)
SEMANTIC = (
    "line_start bigint, line_end bigint, category string, confidence string, description string, reasoning string, is_false_positive boolean"
)


def schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def rank(confidence: Column) -> Column:
    """low 0, medium 1, high 2; null for anything else."""
    return F.when(confidence == "low", 0).when(confidence == "medium", 1).when(confidence == "high", 2)


def display(category: Column) -> Column:
    """The display name of a category's wire form."""
    pairs = [F.lit(x) for pair in CATEGORIES.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[category], category)


def slug(name: Column) -> Column:
    """The wire form of a display name or of a wire form, in any case."""
    plain = F.regexp_replace(F.lower(F.trim(name)), r"[\s-]+", "_")
    return F.when(plain.isin(*CATEGORIES), plain)


def path_order(file: Column) -> Column:
    """Sorts paths by component: a/b.ts before a-b.ts."""
    return F.split(file, "/")
