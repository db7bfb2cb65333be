"""Relational operators on rule matches and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portcullis import model
from portcullis.checkpoints import checkpointed
from portcullis.functions import paths, text
from portcullis.tiers import BROADCAST, tiered

#: The order in which the first copy of a finding is kept and findings are listed.
MATCH_ORDER = ("rule_ord", "match_seq")


def holds(captures: Column, capture: str, kind: str, value: str) -> Column:
    """A predicate on a capture: match, eq, not_match or not_eq. A missing capture fails all four."""
    c = captures[capture]
    # (?U) and (?u): word characters and case as in Unicode
    pattern = "(?U)" + value.replace("(?i)", "(?iu)")
    test = {"match": lambda: c.rlike(pattern), "not_match": lambda: ~c.rlike(pattern), "eq": lambda: c == value, "not_eq": lambda: c != value}[kind]()
    return F.coalesce(test, F.lit(False))


def holds_across(captures: Column, kind: str, names: list[str], regex: str) -> Column:
    """any_match or all_match over several captures; a missing one doesn't match."""
    found = F.array(*[holds(captures, n, "match", regex) for n in names])
    return (F.exists if kind == "any_match" else F.forall)(found, lambda x: x)


def min_confidence(df: DataFrame, least: str | None) -> DataFrame:
    """At least this confidence; an unknown one is no filter."""
    if least not in model.CONFIDENCES:
        return df
    return df.where(model.rank(F.col("confidence")) >= model.CONFIDENCES.index(least))


def in_categories(df: DataFrame, categories: list[str]) -> DataFrame:
    return df.where(F.col("category").isin(*categories)) if categories else df


def in_languages(df: DataFrame, languages: list[str]) -> DataFrame:
    return df.where(F.col("language").isin(*languages)) if languages else df


def outside_policy_modules(files: DataFrame, path: str = "path") -> DataFrame:
    return files.where(~paths.is_policy_implementation(F.col(path)))


def scope(file: str = "file", language: str = "language") -> Column:
    """What policy bindings belong to: a Go package (directory), else the file."""
    return F.when(F.col(language) == "go", F.concat(F.lit("go:"), paths.package_dir(F.col(file)))).otherwise(F.col(file))


def route(matches: DataFrame, bindings: DataFrame) -> DataFrame:
    """Adds ``enforced``: the rule is externalized, or the snippet names a policy binding of its scope as a whole word.

    At a place where a name stands between word borders, every word within the name is a whole word of the snippet. So distinct snippets are
    cut into words, which meet the first words of their scope's names by equality; a name that is more than that word is then looked
    for itself. A scope may have any number of names, and any share of the matches. A name without a word character is never found."""
    first = F.regexp_extract("name", r"(?U)(\w+)", 1)
    named = checkpointed(bindings.select("scope", "name", first.alias("word")).where("word <> ''").distinct())
    texts = matches.where(~F.col("externalized")).select("scope", "code_snippet").distinct()
    words = F.array_distinct(F.regexp_extract_all("code_snippet", F.lit(r"(?U)\w+"), F.lit(0)))
    met = tiered(texts.withColumn("word", F.explode(words)), named, ["scope", "word"])
    quoted = F.concat(F.lit(r"(?U)\b"), F.regexp_replace("name", r"([\\.^$|?*+()\[\]{}\-])", r"\\$1"), F.lit(r"\b"))
    whole = (F.col("name") == F.col("word")) | F.rlike("code_snippet", quoted)
    digest = F.sha2(F.concat_ws("\0", "scope", "code_snippet"), 256)
    hits = checkpointed(met.where(whole).select(digest.alias("__digest")).distinct().withColumn("__hit", F.lit(True)))
    found = F.broadcast(hits) if hits.count() <= BROADCAST else hits
    routed = matches.withColumn("__digest", F.when(~F.col("externalized"), digest)).join(found, "__digest", "left")
    return routed.withColumn("enforced", F.col("externalized") | F.coalesce("__hit", F.lit(False))).drop("__digest", "__hit")


def first_of_each(df: DataFrame, key: str = "id", order: tuple[str, ...] = MATCH_ORDER) -> DataFrame:
    """The first row of each id in match order. Spark cuts each task's rows of an id to the first before they are shuffled."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")


def enforcement_points(routed: DataFrame) -> DataFrame:
    """Distinct file and first line of what is routed to policies, before any filter."""
    return routed.where("enforced").select("file", "line_start").distinct()


def in_order(df: DataFrame, *more: str) -> DataFrame:
    return df.orderBy(model.path_order(F.col("file")), "line_start", *more)


def numbered_in_file(df: DataFrame, *order: str) -> DataFrame:
    """Adds ``ordinal``, 1 for the first finding of a file."""
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy("file").orderBy(*order)))


def summary(found: DataFrame, points: DataFrame) -> DataFrame:
    """One row: totals, files, counts by confidence and category, share that is externalized. Both sides are aggregated where they lie."""
    count = lambda column, value: F.count_if(F.col(column) == value)
    totals = found.agg(
        F.count("*").alias("findings"), F.countDistinct("file").alias("files"),
        *[count("confidence", c).alias(c) for c in model.CONFIDENCES], *[count("category", c).alias(f"n_{c}") for c in model.CATEGORIES],
    )
    outside = points.agg(F.count("*").alias("enforcement_points"))
    return totals.join(outside).withColumn("externalized_pct", text.percent(F.col("enforcement_points"), F.col("findings")))


def by_category(found: DataFrame) -> DataFrame:
    return found.groupBy("category").agg(F.count("*").alias("n"))


def by_confidence(found: DataFrame) -> DataFrame:
    return found.groupBy("confidence").agg(F.count("*").alias("n"))


def files_with_findings(found: DataFrame) -> DataFrame:
    return found.agg(F.countDistinct("file").alias("files"))


def put_output(outputs: Column, engine: Column, content: Column) -> Column:
    """Policy outputs with one for an engine, in place of what was there."""
    return F.concat(F.filter(outputs, lambda x: x["engine"] != engine), F.array(F.struct(engine.alias("engine"), content.alias("content"))))
