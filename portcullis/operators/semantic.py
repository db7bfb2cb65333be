"""What comes back from a second look: clamped, cost-limited, merged with the findings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portcullis import model
from portcullis.checkpoints import checkpointed
from portcullis.functions import paths, text
from portcullis.operators import prefix
from portcullis.tiers import tiered


def clamp(semantic: DataFrame) -> DataFrame:
    """semantic: with the window (window_start, window_end) of its candidate. Ranges that are none, or outside it, go; others are cut to it."""
    inside = (F.col("line_start") > 0) & (F.col("line_end") >= F.col("line_start")) & (F.col("line_start") <= F.col("window_end")) & (F.col("line_end") >= F.col("window_start"))
    return semantic.where(inside).withColumns({"line_start": F.greatest("line_start", "window_start"), "line_end": F.least("line_end", "window_end")})


def without_rejected(findings: DataFrame, semantic: DataFrame) -> DataFrame:
    """Findings but for those that a false-positive verdict names as its seed."""
    rejected = semantic.where("is_false_positive").select(F.col("original_finding_id").alias("id"))
    return findings.join(rejected, "id", "left_anti")


def ranges_touch(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (a <= d) & (c <= b)


def overlap_share(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Common lines over the lines of the longer range."""
    common = F.greatest(F.least(b, d) - F.greatest(a, c) + 1, F.lit(0))
    return common / F.greatest(b - a + 1, d - c + 1)


def semantic_rule(seed_rule: Column, touches_seed: Column, category: Column) -> Column:
    return F.when(seed_rule.isNotNull() & touches_seed, F.concat(seed_rule, F.lit("-semantic"))).otherwise(F.concat(F.lit("semantic-"), category))


def micro_usd(tokens_in: Column, tokens_out: Column, rate_in: float, rate_out: float) -> Column:
    """Cost of a call in whole millionths of a dollar; rates are for 1000 tokens."""
    return F.round((tokens_in / 1000 * rate_in + tokens_out / 1000 * rate_out) * 1_000_000).cast("bigint")


def within_cost(calls: DataFrame, rate_in: float, rate_out: float, cap_usd: float | None, order: tuple[str, ...]) -> DataFrame:
    """Calls up to and with the first that goes beyond the cap. The order is total; sums are carried from one range of it to the next.
    Without a cap or rates all stay and nothing is sorted."""
    cost = calls.withColumn("micro_usd", micro_usd(F.col("input_tokens"), F.col("output_tokens"), rate_in, rate_out))
    if cap_usd is None or not (rate_in or rate_out):
        return cost
    spent = prefix.before(prefix.ranged(cost, [], list(order)), [], list(order), __before=("sum", F.col("micro_usd")))
    return spent.where(F.coalesce("__before", F.lit(0)) <= round(cap_usd * 1_000_000)).drop("__before", prefix.PART)


def as_findings(semantic: DataFrame, findings: DataFrame, files: DataFrame) -> DataFrame:
    """Verdicts (SEMANTIC with file, language, original_finding_id, window and source_snippet of their candidate) as FINDINGS."""
    seed = findings.select(F.col("id").alias("original_finding_id"), F.col("pattern_rule").alias("seed_rule"), F.col("line_start").alias("seed_start"), F.col("line_end").alias("seed_end"))
    src = files.select(F.col("path").alias("file"), text.lines(F.col("content")).alias("file_lines"))
    own = text.lines(F.col("source_snippet"))
    shift = F.col("window_start") - 1
    sliced = F.when((F.col("source_snippet") != "") & (F.col("line_start") >= F.col("window_start")) & (F.col("line_end") <= F.col("window_end")), text.line_range(own, F.col("line_start") - shift, F.col("line_end") - shift))
    snippet = F.coalesce(text.line_range(F.col("file_lines"), F.col("line_start"), F.col("line_end")), sliced, F.lit(""))
    touches = ranges_touch(F.col("seed_start"), F.col("seed_end"), F.col("line_start"), F.col("line_end"))
    out = semantic.where("not is_false_positive").join(seed, "original_finding_id", "left").join(src, "file", "left")
    out = out.withColumn("pattern_rule", semantic_rule(F.col("seed_rule"), F.coalesce(touches, F.lit(False)), F.col("category"))).withColumn("code_snippet", snippet)
    return out.select(
        text.finding_id(F.col("pattern_rule"), F.col("file"), F.col("line_start"), F.col("line_end"), F.col("code_snippet")).alias("id"),
        "file", "line_start", "line_end", "code_snippet", "language", "category", "confidence", "description", "pattern_rule",
        F.array().cast(model.POLICY_OUTPUTS).alias("policy_outputs"), F.lit("semantic").alias("pass"), paths.surface(F.col("file")).alias("surface"), F.lit(None).cast("string").alias("provenance"),
    )


def fold(entries: list[dict], arrivals: list[dict]) -> list[dict]:
    """Each arrival takes the place of the first entry that it covers by half or more with no less confidence, else it is added.

    Ranges of which one covers half of the other are at most twice as long, so entries are kept by the power of two of their length
    and by their place in steps of that; an arrival looks at three powers and the few steps around it."""
    out: list[dict] = []
    near: dict[tuple[int, int], set[int]] = {}

    def keys(e: dict) -> tuple[int, int]:
        power = (e["line_end"] - e["line_start"] + 1).bit_length()
        return power, e["line_start"] >> power

    def put(e: dict, i: int) -> None:
        near.setdefault(keys(e), set()).add(i)

    def covers(s: dict, e: dict) -> bool:
        common = min(e["line_end"], s["line_end"]) - max(e["line_start"], s["line_start"]) + 1
        longest = max(e["line_end"] - e["line_start"], s["line_end"] - s["line_start"]) + 1
        return common > 0 and 2 * common >= longest and model.CONFIDENCES.index(s["confidence"]) >= model.CONFIDENCES.index(e["confidence"])

    for e in entries:
        put(e, len(out))
        out.append(e)
    for s in arrivals:
        power = keys(s)[0]
        around = (i for p in (power - 1, power, power + 1) if p >= 0 for step in range((s["line_start"] >> p) - 1, (s["line_end"] >> p) + 1) for i in near.get((p, step), ()))
        at = min((i for i in around if covers(s, out[i])), default=None)
        if at is None:
            put(s, len(out))
            out.append(s)
        else:
            near[keys(out[at])].discard(at)
            out[at] = s
            put(s, at)
    return out


def takes_place(s: Column, e: Column) -> Column:
    """Whether an arrival covers an entry by half or more with no less confidence: the test of ``fold`` on columns."""
    common = F.least(e["line_end"], s["line_end"]) - F.greatest(e["line_start"], s["line_start"]) + 1
    longest = F.greatest(e["line_end"] - e["line_start"], s["line_end"] - s["line_start"]) + 1
    return (common > 0) & (2 * common >= longest) & (model.rank(s["confidence"]) >= model.rank(e["confidence"]))


def merge(structural: DataFrame, semantic: DataFrame) -> DataFrame:
    """The findings of both, folded: structural ones by lines and id, semantic ones by lines and id.

    Ranges that share no line, directly or through others, can't meet, so each run of ranges that do is folded on its own, wherever the
    file's other runs are. Runs without arrivals, or of one range, stay as they are; runs of two are decided by columns; only larger
    ones are sent to Python, and what a task holds is one run."""
    columns = structural.columns
    both = structural.withColumn("__new", F.lit(0)).unionByName(semantic.withColumn("__new", F.lit(1)))
    runs = checkpointed(prefix.islands(both, ["file"], "line_start", "line_end", 0, "id", "__new"))
    sizes = checkpointed(runs.groupBy("file", "island").agg(F.count("*").alias("__n"), F.sum("__new").alias("__arrivals")).where("__n > 1 AND __arrivals > 0").select("file", "island", "__n"))
    keys = ["file", "island"]
    alone = runs.join(sizes, keys, "left_anti").select(*columns)
    busy = tiered(runs, sizes, keys)
    entry = F.struct("__new", "line_start", "line_end", "id", *[c for c in columns if c not in ("line_start", "line_end", "id")])
    two = busy.where("__n = 2").groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("x"))
    old, new = F.col("x")[0], F.col("x")[1]
    pair = two.select(F.explode(F.when(takes_place(new, old), F.array(new)).otherwise(F.col("x"))).alias("y")).select(*[F.col(f"y.{c}").alias(c) for c in columns])

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by run; a run's rows are folded when the next one begins."""
        now: list[dict] = []

        def out() -> list[dict]:
            rows = fold([r for r in now if not r["__new"]], [r for r in now if r["__new"]])
            now.clear()
            return [{c: r[c] for c in columns} for r in rows]

        target = None
        for b in batches:
            target = target or pa.schema([f for f in b.schema if f.name not in ("__new", "island")])
            done = []
            for r in b.to_pylist():
                if now and (now[-1]["file"], now[-1]["island"]) != (r["file"], r["island"]):
                    done += out()
                now.append(r)
            yield pa.RecordBatch.from_pylist(done, target)
        if now:
            yield pa.RecordBatch.from_pylist(out(), target)

    dealt = busy.where("__n > 2").repartition(*keys).sortWithinPartitions(*keys, "line_start", "line_end", "id")
    more = dealt.select(*columns, "__new", "island").mapInArrow(folded, structural.schema)
    return alone.unionByName(pair).unionByName(more)
