"""Policy text from findings: default stubs, one file for each source file, Rego or Cedar."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portcullis import model
from portcullis.functions import paths, policy_check, text
from portcullis.operators.findings import put_output

GENERATOR = "portcullis"

# Policy texts by engine and category. {{...}} is filled from the snippet's literals.
_REGO = "default allow := false\n\nallow if {{\n    {}\n}}"
_CEDAR = "permit (\n    principal,\n    action,\n    resource\n)\nwhen {{\n    {}\n}};"
_NOTES = {
    "business_rule": "TODO: business rule — review and implement manually",
    "route": "TODO: route declaration with no inline auth check — add a policy or confirm intentionally public",
    "custom": "TODO: custom authorization pattern — review and implement manually",
}
_BODIES = {
    "rego": {
        "rbac": "input.user.role in {{roles}}", "abac": '# TODO: verify attribute check\n    input.user.{{attribute}} == "{{value}}"', "middleware": "input.request.authenticated == true",
        "ownership": "input.resource.owner == input.user.id", "feature_gate": "input.user.plan in {{plans}}",
    },
    "cedar": {
        "rbac": 'principal.role == "{{role_value}}"', "abac": '// TODO: verify attribute check\n    principal.{{attribute}} == "{{value}}"', "middleware": "context.authenticated == true",
        "ownership": "resource.owner == principal", "feature_gate": 'principal.plan == "{{plan_value}}"',
    },
}
_EMPTY = {"rego": ["default allow := false", "allow if {", "    ...", "}"], "cedar": ["permit (", "    principal,", "    action,", "    resource", ")", "when {", "    ...", "};"]}


def default_template(engine: str, category: str) -> str:
    if category in _NOTES:
        mark = text.COMMENT[engine]
        return "\n".join(f"{mark} {x}" for x in (_NOTES[category], *_EMPTY[engine]))
    return (_REGO if engine == "rego" else _CEDAR).format(_BODIES[engine][category])


def _quoted(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", ")


def default_stub(engine: str, category: Column, snippet: Column) -> Column:
    """The policy text of a finding that has none: the category's template, filled from the snippet's literals."""
    found = text.literals(snippet, engine)
    allowed = F.filter(found, lambda x: x.contains(":"))
    first, second = F.coalesce(F.get(found, F.lit(0)), F.lit("TODO")), F.coalesce(F.get(found, F.lit(1)), F.lit("TODO"))
    head, tail = (_REGO if engine == "rego" else _CEDAR).format("\0").split("    \0")
    body = lambda x: F.concat(F.lit(head), x, F.lit(tail))
    if engine == "rego":
        checks = F.array_join(F.transform(allowed, lambda x: F.concat(F.lit('    "'), x, F.lit('" in input.user.permissions'))), "\n")
        one_of = F.when(F.size(found) == 0, '{"TODO"}').otherwise(F.concat(F.lit("{"), _quoted(found), F.lit("}")))
        role = F.replace(F.lit(default_template(engine, "rbac")), F.lit("{{roles}}"), one_of)
        plan = F.replace(F.lit(default_template(engine, "feature_gate")), F.lit("{{plans}}"), one_of)
    else:
        checks = F.when(F.size(allowed) == 1, F.concat(F.lit('    "'), allowed[0], F.lit('" in principal.permissions'))).otherwise(F.concat(F.lit("    ["), _quoted(allowed), F.lit("].containsAny(principal.permissions)")))
        either = lambda attribute, name, category: F.when(
            F.size(found) <= 1, F.replace(F.lit(default_template(engine, category)), F.lit("{{" + name + "}}"), first)
        ).otherwise(body(F.concat(F.lit(f"    principal.{attribute} in ["), _quoted(found), F.lit("]"))))
        role, plan = either("role", "role_value", "rbac"), either("plan", "plan_value", "feature_gate")
    abac = F.replace(F.replace(F.lit(default_template(engine, "abac")), F.lit("{{attribute}}"), first), F.lit("{{value}}"), second)
    out = F.when(category == "rbac", F.when(F.size(allowed) > 0, body(checks)).otherwise(role)).when(category == "feature_gate", plan).when(category == "abac", abac)
    for c in ("middleware", "ownership", *_NOTES):
        out = out.when(category == c, F.lit(default_template(engine, c)))
    return out


def output_for(outputs: Column, engine: str) -> Column:
    return F.get(F.filter(outputs, lambda x: x["engine"] == engine), F.lit(0))["content"]


def fill_stubs(findings: DataFrame, engine: str) -> DataFrame:
    """Findings that each have a policy output for the engine."""
    stub = default_stub(engine, F.col("category"), F.col("code_snippet"))
    filled = put_output(F.col("policy_outputs"), F.lit(engine), stub)
    return findings.withColumn("policy_outputs", F.when(output_for(F.col("policy_outputs"), engine).isNotNull(), F.col("policy_outputs")).otherwise(filled))


def policy_files(findings: DataFrame, engine: str, output_dir: str, prefix: str = "") -> DataFrame:
    """label, output_path, content, finding_count of each source file's policies; findings in the order of lines and id.

    In a Rego file the first ``default allow`` stays, later ones go."""
    mark = text.COMMENT[engine]
    order = Window.partitionBy("file").orderBy("line_start", "line_end", "id")
    stub = text.by_confidence(output_for(F.col("policy_outputs"), engine), F.col("confidence"), engine)
    n = F.row_number().over(order)
    rows = fill_stubs(findings, engine).select("file", n.alias("n"), "line_start", "category", "confidence", "code_snippet", text.lines(stub).alias("body"))
    default = r"^default allow(?:$|[ \t]|:=|=)"
    if engine == "rego":
        has = F.exists("body", lambda x: F.trim(x).rlike(default))
        # the first finding of the file with a default line keeps its first; all others lose theirs
        seen = F.coalesce(F.max(has).over(Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
        at = F.array_position(F.transform("body", lambda x: F.trim(x).rlike(default)), True)
        rows = rows.withColumn("__seen", seen).withColumn("__at", at)
        rows = rows.withColumn("body", F.filter("body", lambda x, i: ~F.trim(x).rlike(default) | (~F.col("__seen") & (i + 1 == F.col("__at")))))
    title = F.concat(F.lit(f"{mark} ["), F.col("n"), F.lit("] "), F.col("file"), F.lit(":"), F.col("line_start"), F.lit(" | "), model.display(F.col("category")), F.lit(" | "), F.col("confidence"))
    block = F.array_join(F.concat(F.array(title, F.concat(F.lit(f"{mark} Original: "), text.header_line(F.col("code_snippet")))), F.col("body")), "\n")
    groups = rows.select("file", F.struct("n", block.alias("block")).alias("b")).groupBy("file").agg(F.array_sort(F.collect_list("b")).alias("blocks"), F.count("*").alias("finding_count"))
    package = paths.rego_package(F.col("file"), prefix)
    head = [F.concat(F.lit(f"{mark} Source: "), F.col("file")), F.concat(F.lit(f"{mark} Findings: "), F.col("finding_count")), F.lit("")]
    if engine == "rego":
        head += [F.concat(F.lit("package "), package), F.lit(""), F.lit("import rego.v1"), F.lit("")]
    content = F.concat(F.array_join(F.array(F.lit(f"{mark} Generated by {GENERATOR}"), *head), "\n"), F.lit("\n"), F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n"), F.lit("\n"))
    label = package if engine == "rego" else paths.cedar_label(F.col("file"), prefix)
    return groups.select("file", label.alias("label"), paths.policy_path(F.col("file"), engine, output_dir, prefix).alias("output_path"), content.alias("content"), "finding_count")


def checked(policies: DataFrame, engine: str, content: str = "content") -> DataFrame:
    """policies with ``valid``: whether their text can be read by the engine's grammar; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            valid = pa.array([policy_check.validate(engine, t.as_py() or "")[0] for t in b.column(content)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns, valid], names=[*b.schema.names, "valid"])

    schema = policies.schema
    return policies.mapInArrow(run, type(schema)([*schema.fields]).add("valid", "boolean"))


def reasons(policies: DataFrame, engine: str) -> DataFrame:
    """policies without their content, with ``valid`` and ``why`` not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [policy_check.validate(engine, t.as_py() or "") for t in b.column("content")]
            rest = b.drop_columns(["content"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array([x for x, _ in found], pa.bool_()), pa.array([x for _, x in found], pa.string())], names=[*rest.schema.names, "valid", "why"])

    kept = [f for f in policies.schema.fields if f.name != "content"]
    return policies.mapInArrow(run, type(policies.schema)(kept).add("valid", "boolean").add("why", "string"))
