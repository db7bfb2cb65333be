"""Queries over derived findings, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from portcullis import model
from portcullis.functions import paths, text
from portcullis.operators import bindings, candidates, findings, policies, prefix, semantic
from portcullis.plans import derived as D
from portcullis.plans.derived import frame
from portcullis.registry import query

W = lambda **t: "WITH " + ", ".join(f"{k} AS ({v})" for k, v in t.items()) + "\n"
IND = "authz|opa|policy|rego|cedar|verifiedpermissions|verified-permissions|enforce|open-policy-agent"
EXT = "lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+\\.([^.]*)$', 1))"


@query("surface_classify", W(p=D.PATHS) + f"SELECT path, CASE WHEN regexp_matches(path, '(?i)(^|/)(web|webapp|client|frontend|ui)/') AND {EXT} IN ('js','jsx','ts','tsx','mjs','cjs','html','htm','css','scss','sass','less','vue','svelte','astro') THEN 'frontend' ELSE 'backend' END AS surface FROM p")
def surface_classify(spark, sf):
    return frame(spark, sf, D.PATHS).select("path", paths.surface(F.col("path")).alias("surface"))


@query("policy_impl_path", W(p=D.PATHS) + f"SELECT path, regexp_matches(lower(regexp_replace(path, '[^/]*$', '')), '{IND}') AS inside FROM p")
def policy_impl_path(spark, sf):
    return frame(spark, sf, D.PATHS).select("path", paths.is_policy_implementation(F.col("path")).alias("inside"))


@query("policy_import_path", W(p=D.PATHS) + f"SELECT path, regexp_matches(lower(path), '{IND}') AS policy FROM p")
def policy_import_path(spark, sf):
    return frame(spark, sf, D.PATHS).select("path", paths.is_policy_path(F.col("path")).alias("policy"))


@query("detect_language", W(p=D.PATHS) + f"SELECT path, CASE WHEN regexp_extract(path, '[^/]*$') = 'Rakefile' THEN 'ruby' WHEN {EXT} IN ('ts','tsx') THEN 'typescript' WHEN {EXT} = 'go' THEN 'go' WHEN {EXT} = 'php' THEN 'php' WHEN {EXT} = 'kts' THEN 'kotlin' END AS language, {EXT} IN ('tsx', 'jsx') AS is_tsx_jsx FROM p")
def detect_language(spark, sf):
    return frame(spark, sf, D.PATHS).select("path", paths.language(F.col("path")).alias("language"), paths.is_tsx_jsx(F.col("path")).alias("is_tsx_jsx"))


_STEM = "regexp_replace(regexp_replace(path, '([^/])\\.[^./]*$', '\\1'), '^(src|lib)/(.)', '\\2')"


@query("rego_package", W(p=D.PATHS) + f"SELECT path, 'app.' || array_to_string(list_transform(string_split(regexp_replace(replace(replace({_STEM}, '/', '.'), '-', '_'), '[^A-Za-z0-9._]', '', 'g'), '.'), lambda s: CASE WHEN regexp_matches(s, '^[0-9]') THEN '_' || s ELSE s END), '.') AS package FROM p")
def rego_package(spark, sf):
    return frame(spark, sf, D.PATHS).select("path", paths.rego_package(F.col("path"), "app").alias("package"))


@query("policy_path", W(p=D.PATHS) + f"SELECT path, 'out/' || array_to_string(list_filter(string_split({_STEM}, '/'), lambda x: x NOT IN ('', '.', '..')), '/') || '.rego' AS rego_path, 'out/app/' || array_to_string(list_filter(string_split({_STEM}, '/'), lambda x: x NOT IN ('', '.', '..')), '/') || '.cedar' AS cedar_path, 'app.' || replace(replace({_STEM}, '/', '.'), '-', '_') AS cedar_label FROM p")
def policy_path(spark, sf):
    p = F.col("path")
    return frame(spark, sf, D.PATHS).select("path", paths.policy_path(p, "rego", "out", "app").alias("rego_path"), paths.policy_path(p, "cedar", "out", "app").alias("cedar_path"), paths.cedar_label(p, "app").alias("cedar_label"))


@query("path_component_order", W(p=D.PATHS) + "SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS place FROM p")
def path_component_order(spark, sf):
    """The place of each path in component order."""
    return prefix.places(frame(spark, sf, D.PATHS).withColumn("components", model.path_order(F.col("path"))), ["components"]).select("path", "place")


_LE = lambda n: "unhex(" + " || ".join(f"substr(printf('%016x', {n}), {15 - 2 * i}, 2)" for i in range(8)) + ")"


@query("finding_id", W(f=D.FINDINGS) + f"SELECT seq, sha256(encode(pattern_rule) || encode(file) || {_LE('line_start')} || {_LE('line_end')} || encode(code_snippet)) AS id FROM f")
def finding_id(spark, sf):
    f = frame(spark, sf, D.FINDINGS)
    return f.select("seq", text.finding_id(*(F.col(c) for c in ("pattern_rule", "file", "line_start", "line_end", "code_snippet"))).alias("id"))


@query("filter_min_confidence", W(f=D.FINDINGS) + "SELECT seq, confidence FROM f WHERE confidence IN ('medium', 'high')")
def filter_min_confidence(spark, sf):
    return findings.min_confidence(frame(spark, sf, D.FINDINGS), "medium").select("seq", "confidence")


@query("filter_category", W(f=D.FINDINGS) + "SELECT seq, category FROM f WHERE category IN ('rbac', 'route')")
def filter_category(spark, sf):
    return findings.in_categories(frame(spark, sf, D.FINDINGS), ["rbac", "route"]).select("seq", "category")


@query("filter_language", W(f=D.FINDINGS) + "SELECT seq, file FROM f WHERE file LIKE '%.go' OR file LIKE '%.py'")
def filter_language(spark, sf):
    f = frame(spark, sf, D.FINDINGS).withColumn("language", paths.language(F.col("file")))
    return findings.in_languages(f, ["go", "python"]).select("seq", "file")


@query("skip_policy_modules", W(f=D.FINDINGS) + f"SELECT seq, file FROM f WHERE NOT regexp_matches(lower(regexp_replace(file, '[^/]*$', '')), '{IND}')")
def skip_policy_modules(spark, sf):
    return findings.outside_policy_modules(frame(spark, sf, D.FINDINGS), "file").select("seq", "file")


@query("should_escalate", W(f=D.FINDINGS) + "SELECT seq, confidence = 'low' OR (confidence = 'medium' AND category IN ('business_rule', 'custom', 'ownership')) AS escalates FROM f")
def should_escalate(spark, sf):
    return frame(spark, sf, D.FINDINGS).select("seq", candidates.escalates(F.col("confidence"), F.col("category")).alias("escalates"))


_CAPS = "CASE WHEN seq % 5 = 0 THEN NULL ELSE category END AS a, confidence AS b"


@query("predicates_basic", W(f=f"SELECT seq, {_CAPS} FROM ({D.FINDINGS}) t") + "SELECT seq, coalesce(regexp_matches(a, '^(rbac|route)'), false) AS matches, coalesce(a = 'abac', false) AS equals, coalesce(NOT regexp_matches(a, 'o'), false) AS not_matches, coalesce(a <> 'abac', false) AS not_equals FROM f")
def predicates_basic(spark, sf):
    f = frame(spark, sf, f"SELECT seq, {_CAPS} FROM ({D.FINDINGS}) t")
    c = F.map_filter(F.create_map(F.lit("a"), F.col("a"), F.lit("b"), F.col("b")), lambda k, v: v.isNotNull())
    h = lambda kind, v: findings.holds(c, "a", kind, v)
    return f.select("seq", h("match", "^(rbac|route)").alias("matches"), h("eq", "abac").alias("equals"), h("not_match", "o").alias("not_matches"), h("not_eq", "abac").alias("not_equals"))


@query("predicates_cross", W(f=f"SELECT seq, {_CAPS} FROM ({D.FINDINGS}) t") + "SELECT seq, coalesce(regexp_matches(a, 'r'), false) OR regexp_matches(b, 'm') AS any_match, coalesce(regexp_matches(a, 'u'), false) AND regexp_matches(b, 'm') AS all_match FROM f")
def predicates_cross(spark, sf):
    f = frame(spark, sf, f"SELECT seq, {_CAPS} FROM ({D.FINDINGS}) t")
    c = F.map_filter(F.create_map(F.lit("a"), F.col("a"), F.lit("b"), F.col("b")), lambda k, v: v.isNotNull())
    return f.select("seq", (findings.holds_across(c, "any_match", ["a"], "r") | findings.holds_across(c, "any_match", ["b"], "m")).alias("any_match"), (findings.holds_across(c, "all_match", ["a"], "u") & findings.holds_across(c, "all_match", ["b"], "m")).alias("all_match"))


@query("dedup_first", W(f=D.REPEATED) + "SELECT id, seq, category FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rule_ord, seq) AS n FROM f) WHERE n = 1")
def dedup_first(spark, sf):
    return findings.first_of_each(frame(spark, sf, D.REPEATED), "id", ("rule_ord", "seq")).select("id", "seq", "category")


_ROUTED = W(f=D.FINDINGS, b=D.BINDINGS, r="SELECT f.*, externalized OR EXISTS (SELECT 1 FROM b WHERE b.scope = f.file AND regexp_matches(f.code_snippet, '\\b' || b.name || '\\b')) AS enforced FROM f")


def _routed(spark, sf):
    f = frame(spark, sf, D.FINDINGS).withColumn("scope", F.col("file"))
    return findings.route(f, frame(spark, sf, D.BINDINGS))


@query("route_enforcement", _ROUTED + "SELECT seq, file, enforced FROM r")
def route_enforcement(spark, sf):
    return _routed(spark, sf).select("seq", "file", "enforced")


@query("enforcement_distinct", _ROUTED + "SELECT DISTINCT file, line_start FROM r WHERE enforced")
def enforcement_distinct(spark, sf):
    return findings.enforcement_points(_routed(spark, sf))


@query("externalized_pct", _ROUTED + "SELECT e AS enforcement_points, n AS findings, CAST(CASE WHEN e + n = 0 THEN 0 ELSE round(e / (e + n) * 100) END AS INTEGER) AS externalized_pct FROM (SELECT count(*) AS n FROM r WHERE NOT enforced), (SELECT count(*) AS e FROM (SELECT DISTINCT file, line_start FROM r WHERE enforced))")
def externalized_pct(spark, sf):
    r = _routed(spark, sf)
    return findings.summary(r.where("not enforced"), findings.enforcement_points(r)).select("enforcement_points", "findings", "externalized_pct")


@query("count_by_category", W(f=D.FINDINGS) + "SELECT category, count(*) AS n FROM f GROUP BY 1")
def count_by_category(spark, sf):
    return findings.by_category(frame(spark, sf, D.FINDINGS))


@query("count_by_confidence", W(f=D.FINDINGS) + "SELECT confidence, count(*) AS n FROM f GROUP BY 1")
def count_by_confidence(spark, sf):
    return findings.by_confidence(frame(spark, sf, D.FINDINGS))


@query("files_with_findings", W(f=D.FINDINGS) + "SELECT count(DISTINCT file) AS files FROM f")
def files_with_findings(spark, sf):
    return findings.files_with_findings(frame(spark, sf, D.FINDINGS))


@query("finding_ordinals", W(f=D.FINDINGS) + "SELECT seq, file, row_number() OVER (PARTITION BY file ORDER BY line_start, seq) AS ordinal FROM f")
def finding_ordinals(spark, sf):
    return findings.numbered_in_file(frame(spark, sf, D.FINDINGS), "line_start", "seq").select("seq", "file", "ordinal")


_CLOSURE = W(s=D.SEEDS, e=D.EDGES).replace("WITH", "WITH RECURSIVE", 1)


@query("binding_fixpoint", _CLOSURE + ", k(scope, name) AS (SELECT scope, name FROM s UNION SELECT e.scope, e.lhs FROM k JOIN e ON e.scope = k.scope AND regexp_matches(e.rhs, '\\b' || k.name || '\\b')) SELECT DISTINCT scope, name FROM k")
def binding_fixpoint(spark, sf):
    return bindings.close(frame(spark, sf, D.SEEDS), frame(spark, sf, D.EDGES))


_GO_FILES = f"SELECT DISTINCT file, regexp_replace(file, '/[^/]*$', '') AS package_dir FROM ({D.FINDINGS}) t WHERE file LIKE '%.go'"


@query("go_package_bindings", W(g=_GO_FILES, b=D.BINDINGS) + "SELECT g.file, coalesce(p.names, '') AS names FROM g LEFT JOIN (SELECT g.package_dir, string_agg(DISTINCT b.name, ',' ORDER BY b.name) AS names FROM g JOIN b ON b.scope = g.file GROUP BY 1) p ON p.package_dir = g.package_dir")
def go_package_bindings(spark, sf):
    """The bindings of a Go file are those of all files of its directory."""
    g = frame(spark, sf, _GO_FILES).select("file", F.lit("go").alias("language"))
    g = g.select("file", findings.scope().alias("package"))
    own = frame(spark, sf, D.BINDINGS).join(g, F.col("scope") == F.col("file")).groupBy("package").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))
    return g.join(own, "package", "left").select("file", F.coalesce("names", F.lit("")).alias("names"))


#: A hit of every finding, and below a taken range of every finding, spread over the lines of long files.
_HITS = f"SELECT file, 1 + (seq * 7919) % 100000 AS line FROM ({D.FINDINGS}) t"
_WINDOWS = f"""hits AS (SELECT DISTINCT * FROM ({_HITS}) t), w AS (SELECT file, greatest(line - 5, 1) AS s, line + 15 AS e FROM hits),
m AS (SELECT *, max(e) OVER (PARTITION BY file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w),
i AS (SELECT *, sum(CASE WHEN before + 1 >= s THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
regions AS (SELECT file, min(s) AS line_start, max(e) AS line_end FROM i GROUP BY file, island)"""


@query("coalesce_windows", f"WITH {_WINDOWS} SELECT file, line_start, line_end FROM regions")
def coalesce_windows(spark, sf):
    return candidates.windows(frame(spark, sf, _HITS))


_TAKEN = f"SELECT file, 1 + (seq * 104729) % 100000 AS line_start, 1 + (seq * 104729) % 100000 + seq % 6 AS line_end FROM ({D.FINDINGS}) t"


@query("cold_anti_escalation", f"WITH {_WINDOWS}, taken AS ({_TAKEN}) SELECT file, line_start, line_end FROM regions r WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.file = r.file AND r.line_start <= t.line_end AND t.line_start <= r.line_end)")
def cold_anti_escalation(spark, sf):
    return candidates.clear_of(candidates.windows(frame(spark, sf, _HITS)), frame(spark, sf, _TAKEN))


_AUTHZ = "(?i)(^|[/\\\\_.-])(authz|authn|authori[sz]ation|authorit[a-z0-9_]*|authenticat[a-z0-9_]*|rbac|abac|acl|iam|permissions?|roles?|policy|policies|guards?|access[_-]?control)([/\\\\_.-]|$)"


@query("cold_priority_topk", f"WITH {_WINDOWS} SELECT file, line_start FROM regions ORDER BY regexp_matches(file, '{_AUTHZ}') DESC, string_split(file, '/'), line_start LIMIT 16")
def cold_priority_topk(spark, sf):
    budget = candidates.cold_budget(50, 10)
    return candidates.by_priority(candidates.windows(frame(spark, sf, _HITS)), budget).select("file", "line_start")


@query("escalations_topk", W(f=D.FINDINGS) + "SELECT seq FROM f WHERE confidence = 'low' OR (confidence = 'medium' AND category IN ('business_rule', 'custom', 'ownership')) ORDER BY string_split(file, '/'), line_start, seq LIMIT 50")
def escalations_topk(spark, sf):
    f = frame(spark, sf, D.FINDINGS).where(candidates.escalates(F.col("confidence"), F.col("category")))
    return f.orderBy(model.path_order(F.col("file")), "line_start", "seq").limit(50).select("seq")


@query("clamp_semantic", W(s=D.SEMANTIC) + "SELECT seq, greatest(line_start, window_start) AS line_start, least(line_end, window_end) AS line_end FROM s WHERE line_start > 0 AND line_end >= line_start AND line_start <= window_end AND line_end >= window_start")
def clamp_semantic(spark, sf):
    return semantic.clamp(frame(spark, sf, D.SEMANTIC)).select("seq", "line_start", "line_end")


@query("fp_anti", W(f=D.FINDINGS, s=D.SEMANTIC) + "SELECT seq FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE is_false_positive AND original_finding_id = CAST(f.seq AS STRING))")
def fp_anti(spark, sf):
    f = frame(spark, sf, D.FINDINGS).withColumn("id", F.col("seq").cast("string"))
    return semantic.without_rejected(f, frame(spark, sf, D.SEMANTIC)).select("seq")


@query("running_cost_cut", W(s=D.SEMANTIC) + ", c AS (SELECT seq, CAST(round((input_tokens / 1000.0 * 3.0 + output_tokens / 1000.0 * 15.0) * 1000000) AS BIGINT) AS micro_usd FROM s), r AS (SELECT *, coalesce(sum(micro_usd) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c) SELECT seq, micro_usd FROM r WHERE before <= 2000000000")
def running_cost_cut(spark, sf):
    return semantic.within_cost(frame(spark, sf, D.SEMANTIC), 3.0, 15.0, 2000.0, ("seq",)).select("seq", "micro_usd")


@query("semantic_rule_id", W(s=D.SEMANTIC) + "SELECT seq, CASE WHEN seq % 2 = 0 AND line_start <= window_end AND window_start <= line_end THEN seed_rule || '-semantic' ELSE 'semantic-' || category END AS pattern_rule FROM s")
def semantic_rule_id(spark, sf):
    s = frame(spark, sf, D.SEMANTIC)
    seed = F.when(F.col("seq") % 2 == 0, F.col("seed_rule"))
    touch = semantic.ranges_touch(*(F.col(c) for c in ("line_start", "line_end", "window_start", "window_end")))
    return s.select("seq", semantic.semantic_rule(seed, touch, F.col("category")).alias("pattern_rule"))


@query("overlap_fraction", W(s=D.SEMANTIC) + "SELECT seq, greatest(least(line_end, window_end) - greatest(line_start, window_start) + 1, 0)::DOUBLE / greatest(line_end - line_start + 1, window_end - window_start + 1) AS share FROM s")
def overlap_fraction(spark, sf):
    return frame(spark, sf, D.SEMANTIC).select("seq", semantic.overlap_share(*(F.col(c) for c in ("line_start", "line_end", "window_start", "window_end"))).alias("share"))


#: Each finding, and at most one second look at it, in a slot of 12 lines of its own, so the fold has one outcome in SQL too.
_S1 = f"SELECT file, CAST(seq AS STRING) AS id, 12 * seq + 1 AS line_start, 12 * seq + 1 + seq % 8 AS line_end, confidence, seq FROM ({D.FINDINGS}) t"
_LOOKS = f"SELECT file, line_start + seq % 3 AS line_start, concat('s', id) AS id, line_start + seq % 3 + (seq * 5) % 7 AS line_end, CASE (seq * 11) % 13 % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence FROM ({_S1}) t"
_RANK = lambda c: f"CASE {c} WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"


@query("merge_overlap", W(a=_S1, s=_LOOKS) + f", hit AS (SELECT a.id AS old, s.id AS new FROM a JOIN s ON a.file = s.file AND 2 * (least(a.line_end, s.line_end) - greatest(a.line_start, s.line_start) + 1) >= greatest(a.line_end - a.line_start, s.line_end - s.line_start) + 1 AND {_RANK('s.confidence')} >= {_RANK('a.confidence')}) SELECT file, id, line_start, line_end, confidence FROM a WHERE id NOT IN (SELECT old FROM hit) UNION ALL SELECT file, id, line_start, line_end, confidence FROM s")
def merge_overlap(spark, sf):
    order = ["file", "id", "line_start", "line_end", "confidence"]
    return semantic.merge(frame(spark, sf, _S1).select(*order), frame(spark, sf, _LOOKS).select(*order))


@query("string_literals", W(f=D.FINDINGS) + """SELECT seq, array_to_string(regexp_extract_all(code_snippet, '["'']([^"'']+)["'']', 1), '|') AS rego, array_to_string(list_transform(regexp_extract_all(code_snippet, '"[^"]+"|''[^'']+'''), lambda x: x[2:-2]), '|') AS cedar FROM f""")
def string_literals(spark, sf):
    c = F.col("code_snippet")
    return frame(spark, sf, D.FINDINGS).select("seq", F.array_join(text.literals(c, "rego"), "|").alias("rego"), F.array_join(text.literals(c, "cedar"), "|").alias("cedar"))


_ROLES = f"SELECT seq, concat('\"', category, ', ', confidence, ' , ,', 'x\"') AS roles FROM ({D.FINDINGS}) t"


@query("roles_set", W(f=_ROLES) + """SELECT seq, array_to_string(list_transform(list_filter(list_transform(string_split(trim(roles, '"'), ','), lambda x: trim(x)), lambda x: x <> ''), lambda x: '"' || x || '"'), ', ') AS roles_set FROM f""")
def roles_set(spark, sf):
    return frame(spark, sf, _ROLES).select("seq", text.quoted_items(F.col("roles")).alias("roles_set"))


@query("header_line", W(f=D.FINDINGS) + "SELECT seq, CASE WHEN length(s) > 80 THEN trim(substr(s, 1, 77) || '...') ELSE trim(s) END AS header FROM (SELECT seq, repeat(code_snippet || ' ', CAST(1 + seq % 4 AS INTEGER)) AS s FROM f)")
def header_line(spark, sf):
    s = F.expr("repeat(code_snippet || ' ', cast(1 + seq % 4 as int))")
    return frame(spark, sf, D.FINDINGS).select("seq", text.header_line(F.concat(s, F.lit("\nsecond"))).alias("header"))


@query("confidence_wrap", W(f=D.FINDINGS) + "SELECT seq, CASE confidence WHEN 'high' THEN code_snippet || chr(10) || '# kept' WHEN 'medium' THEN '# TODO: verify this policy' || chr(10) || code_snippet || chr(10) || '# kept' ELSE '# SUGGESTION: review and uncomment if correct' || chr(10) || '# ' || code_snippet || chr(10) || '# kept' END AS body FROM f")
def confidence_wrap(spark, sf):
    body = F.concat("code_snippet", F.lit("\n# kept"))
    return frame(spark, sf, D.FINDINGS).select("seq", text.by_confidence(body, F.col("confidence"), "rego").alias("body"))


@query("numbered_snippet", W(f=D.FINDINGS) + "SELECT seq, lpad(CAST(line_start + 9990 AS STRING), CAST(greatest(4, length(CAST(line_start + 9990 AS STRING))) AS INTEGER), ' ') || ': ' || code_snippet || chr(10) || lpad(CAST(line_start + 9991 AS STRING), CAST(greatest(4, length(CAST(line_start + 9991 AS STRING))) AS INTEGER), ' ') || ': }' || chr(10) AS numbered FROM (SELECT seq, code_snippet, line_start - 9990 * (seq % 2) AS line_start FROM f)")
def numbered_snippet(spark, sf):
    first = F.col("line_start") + 9990 - 9990 * (F.col("seq") % 2)
    return frame(spark, sf, D.FINDINGS).select("seq", text.numbered(F.concat("code_snippet", F.lit("\n}\n")), first).alias("numbered"))


@query("import_budget", W(f=D.FINDINGS) + ", n AS (SELECT file, code_snippet AS x, row_number() OVER (PARTITION BY file ORDER BY seq) AS i FROM f), c AS (SELECT *, sum(length(x) + 1) OVER (PARTITION BY file ORDER BY i) AS spent FROM n WHERE i <= 20) SELECT file, count_if(spent <= 250) AS n FROM c GROUP BY 1")
def import_budget(spark, sf):
    """How many of a file's lines fit into the imports budget of 1000 bytes."""
    f = frame(spark, sf, D.FINDINGS)
    files = f.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "code_snippet"))), lambda x: x["code_snippet"]).alias("x"))
    return files.select("file", F.size(text.bounded_imports(F.col("x"), 1000)).cast("bigint").alias("n"))


_CONTENT = f"SELECT seq, line_start, line_end, 300 AS n FROM ({D.FINDINGS}) t"


@query("context_window", W(f=_CONTENT) + ", c AS (SELECT seq, least(line_start, n) AS a, least(line_end, n) AS b, n FROM f) SELECT seq, greatest(a - 5, 1) AS line_start, least(greatest(b, a) + 15, n) AS line_end, 'l' || CAST(greatest(a - 5, 1) AS STRING) AS first, 'l' || CAST(least(greatest(b, a) + 15, n) AS STRING) AS last FROM c")
def context_window(spark, sf):
    """The window around each range of a file of 300 lines, and its first and last line."""
    lines = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.concat(F.lit("l"), i)), "\n")
    x = frame(spark, sf, _CONTENT).withColumn("content", lines).select("seq", text.context(F.col("content"), F.col("line_start"), F.col("line_end"), 16_000).alias("x"))
    s = F.split("x.snippet", "\n")
    return x.select("seq", F.col("x.line_start"), F.col("x.line_end"), s[0].alias("first"), F.element_at(s, -1).alias("last"))


@query("extract_lines", W(f=_CONTENT) + "SELECT seq, CASE WHEN line_start > n THEN NULL ELSE array_to_string(list_transform(range(line_start, greatest(least(line_end, n), line_start) + 1), lambda i: 'l' || i), chr(10)) END AS snippet FROM f")
def extract_lines(spark, sf):
    every = F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.concat(F.lit("l"), i))
    return frame(spark, sf, _CONTENT).select("seq", text.line_range(every, F.col("line_start"), F.col("line_end")).alias("snippet"))


_FENCED = f"SELECT seq, CASE seq % 4 WHEN 0 THEN concat('```json', chr(10), '{{', category, '}}', chr(10), '```  ') WHEN 1 THEN concat('  {{', category, '}} ') WHEN 2 THEN concat('```', chr(10), category) ELSE concat(category, ' ```') END AS s, category FROM ({D.FINDINGS}) t".replace("{{", "{").replace("}}", "}")


@query("fence_strip", W(f=_FENCED) + "SELECT seq, CASE seq % 4 WHEN 0 THEN '{' || category || '}' WHEN 1 THEN '{' || category || '}' ELSE category END AS body FROM f")
def fence_strip(spark, sf):
    return frame(spark, sf, _FENCED).select("seq", text.strip_fence(F.col("s")).alias("body"))


#: Every finding with a policy text of its own; a third of the texts set a default.
_POLICY = f"SELECT CAST(seq AS STRING) AS id, t.* FROM ({D.FINDINGS}) t"


def _policy_files(engine: str) -> str:
    mark, default = {"rego": "#", "cedar": "//"}[engine], "default allow := false"
    dropped = "has AND NOT first" if engine == "rego" else "false"
    name = "replace(replace(regexp_replace(regexp_replace(file, '\\.[a-z]+$', ''), '^(src|lib)/', ''), '/', '.'), '-', '_')"
    package = f" || 'package app.' || {name} || chr(10) || chr(10) || 'import rego.v1' || chr(10) || chr(10)" if engine == "rego" else ""
    shown = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in model.CATEGORIES.items())
    return (
        W(f=_POLICY)
        + f""", n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_start, line_end, id) AS n, seq % 3 = 0 AS d, seq % 3 = 0 AND confidence <> 'low' AS has FROM f),
g AS (SELECT *, has AND row_number() OVER (PARTITION BY file, has ORDER BY n) = 1 AS first FROM n),
t AS (SELECT *, CASE WHEN d AND NOT ({dropped}) THEN CASE WHEN confidence = 'low' THEN '{mark} ' ELSE '' END || '{default}' || chr(10) ELSE '' END || CASE WHEN confidence = 'low' THEN '{mark} ' ELSE '' END || 'allow if {{ input.x == "' || category || '" }}' AS body FROM g),
b AS (SELECT file, n, '{mark} [' || n || '] ' || file || ':' || line_start || ' | ' || CASE category {shown} END || ' | ' || confidence || chr(10) || '{mark} Original: ' || trim(code_snippet) || chr(10)
  || CASE confidence WHEN 'high' THEN '' WHEN 'medium' THEN '{mark} TODO: verify this policy' || chr(10) ELSE '{mark} SUGGESTION: review and uncomment if correct' || chr(10) END || body AS block FROM t)
SELECT file, count(*) AS finding_count, sha256('{mark} Generated by portcullis' || chr(10) || '{mark} Source: ' || file || chr(10) || '{mark} Findings: ' || count(*) || chr(10) || chr(10){package}
  || string_agg(block, chr(10) || chr(10) ORDER BY n) || chr(10)) AS content_sha256 FROM b GROUP BY file"""
    )


def _files(spark, sf, engine):
    content = F.concat(F.when(F.col("seq") % 3 == 0, "default allow := false\n").otherwise(""), F.lit('allow if { input.x == "'), F.col("category"), F.lit('" }'))
    f = frame(spark, sf, _POLICY).withColumn("policy_outputs", F.array(F.struct(F.lit(engine).alias("engine"), content.alias("content"))))
    return policies.policy_files(f, engine, "out", "app").select("file", "finding_count", F.sha2("content", 256).alias("content_sha256"))


@query("policy_files_by_path", _policy_files("rego"))
def policy_files_by_path(spark, sf):
    return _files(spark, sf, "rego")


@query("policy_files_cedar", _policy_files("cedar"))
def policy_files_cedar(spark, sf):
    return _files(spark, sf, "cedar")


_NOTE = lambda mark, lines: "CASE category WHEN 'business_rule' THEN '{m} TODO: business rule — review and implement manually' WHEN 'route' THEN '{m} TODO: route declaration with no inline auth check — add a policy or confirm intentionally public' ELSE '{m} TODO: custom authorization pattern — review and implement manually' END || ".replace("{m}", mark) + " || ".join(f"chr(10) || '{mark} {x}'" for x in lines)
_FIRST = "CASE seq % 7 WHEN 0 THEN 'admin' WHEN 1 THEN 'orders:read' WHEN 2 THEN 'edit' WHEN 4 THEN 'owner' ELSE 'TODO' END"
_ABAC = lambda mark, who: f"'{mark} TODO: verify attribute check' || chr(10) || '    {who}.' || {_FIRST} || ' == \"' || CASE seq % 7 WHEN 4 THEN 'staff' ELSE 'TODO' END || '\"'"


@query("default_stub_cedar", W(f=D.FINDINGS) + f"""SELECT seq, CASE WHEN category IN ('business_rule', 'route', 'custom') THEN {_NOTE('//', ['permit (', '    principal,', '    action,', '    resource', ')', 'when {', '    ...', '};'])} ELSE
 'permit (' || chr(10) || '    principal,' || chr(10) || '    action,' || chr(10) || '    resource' || chr(10) || ')' || chr(10) || 'when {{' || chr(10) || '    '
 || CASE WHEN category = 'ownership' THEN 'resource.owner == principal' WHEN category = 'middleware' THEN 'context.authenticated == true' WHEN category = 'abac' THEN {_ABAC('//', 'principal')}
  WHEN seq % 7 = 1 AND category = 'rbac' THEN '"orders:read" in principal.permissions' WHEN seq % 7 = 4 THEN CASE category WHEN 'rbac' THEN 'principal.role in ["owner", "staff"]' ELSE 'principal.plan in ["owner", "staff"]' END
  ELSE CASE category WHEN 'rbac' THEN 'principal.role == "' ELSE 'principal.plan == "' END || {_FIRST} || '"' END
 || chr(10) || '}};' END AS stub FROM f""")
def default_stub_cedar(spark, sf):
    return frame(spark, sf, D.FINDINGS).select("seq", policies.default_stub("cedar", F.col("category"), F.col("code_snippet")).alias("stub"))


@query("default_stub_rego", W(f=D.FINDINGS) + f"""SELECT seq, CASE WHEN category IN ('business_rule', 'route', 'custom') THEN {_NOTE('#', ['default allow := false', 'allow if {', '    ...', '}'])} ELSE
 'default allow := false' || chr(10) || chr(10) || 'allow if {{' || chr(10) || '    '
 || CASE WHEN category = 'ownership' THEN 'input.resource.owner == input.user.id' WHEN category = 'middleware' THEN 'input.request.authenticated == true' WHEN category = 'abac' THEN {_ABAC('#', 'input.user')}
  WHEN seq % 7 = 1 AND category = 'rbac' THEN '"orders:read" in input.user.permissions'
  ELSE CASE category WHEN 'rbac' THEN 'input.user.role in {{' ELSE 'input.user.plan in {{' END || CASE seq % 7 WHEN 4 THEN '"owner", "staff"' ELSE '"' || {_FIRST} || '"' END || '}}' END
 || chr(10) || '}}' END AS stub FROM f""")
def default_stub_rego(spark, sf):
    return frame(spark, sf, D.FINDINGS).select("seq", policies.default_stub("rego", F.col("category"), F.col("code_snippet")).alias("stub"))


@query("category_display", W(f=D.FINDINGS) + "SELECT seq, CASE category WHEN 'rbac' THEN 'RBAC' WHEN 'abac' THEN 'ABAC' WHEN 'middleware' THEN 'Middleware' WHEN 'business_rule' THEN 'Business Rule' WHEN 'ownership' THEN 'Ownership' WHEN 'feature_gate' THEN 'Feature Gate' WHEN 'route' THEN 'Route' ELSE 'Custom' END AS name, category AS slug FROM f")
def category_display(spark, sf):
    name = model.display(F.col("category"))
    return frame(spark, sf, D.FINDINGS).select("seq", name.alias("name"), model.slug(name).alias("slug"))


@query("put_policy_output", W(f=D.FINDINGS) + "SELECT seq, CASE WHEN seq % 2 = 0 THEN 'rego' ELSE 'cedar' END || ':' || category AS outputs FROM f")
def put_policy_output(spark, sf):
    engine = F.when(F.col("seq") % 2 == 0, "rego").otherwise("cedar")
    old = F.array(F.struct(engine.alias("engine"), F.lit("old").alias("content")))
    out = findings.put_output(old, engine, F.col("category"))
    return frame(spark, sf, D.FINDINGS).select("seq", F.array_join(F.transform(out, lambda x: F.concat(x["engine"], F.lit(":"), x["content"])), "|").alias("outputs"))


_LONG = f"SELECT seq, repeat(concat(code_snippet, ' '), CAST(1 + seq % 12 AS INT)) AS line FROM ({D.FINDINGS}) t"


@query("log_line", W(f=_LONG) + "SELECT seq, CASE WHEN length(line) <= 200 THEN line ELSE left(line, 200) || '...' END AS line FROM f")
def log_line(spark, sf):
    return frame(spark, sf, _LONG).select("seq", text.log_line(F.col("line")).alias("line"))
