"""Policy bindings, closed over assignments.

A name is bound if a policy module's import binds it, or if a right-hand side that names a bound name as a whole word
is assigned to it. Right-hand sides are split into words once, so names and their uses are the nodes and edges of a graph, and
bound is what can be reached. A shared name that begins or ends with a character that isn't of a word (as ``$`` in PHP) never stands between
word borders and is kept out of the words.

Scopes are many and mostly small: those of at most LOCAL edges are searched within a task, all in one pass. For larger ones the search is
relational. A name that only one other name is assigned to is bound if that one is. Such names form chains and trees, which are condensed
first: each points to the name before it, and pointers are doubled until they point to a first binding, to a name with several sources, or to
one with none, so a chain of a thousand assignments takes ten rounds. The names with several sources then take rounds of equality joins, in
which only what is new is joined; what is known is written again only when MERGE parts of it have gathered."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portcullis.checkpoints import checkpointed

_KEY = ["scope", "name"]
#: Edges of a scope that is searched within a task; parts of what is known, in the rounds for larger ones.
LOCAL, MERGE = 50_000, 4


def chains(single: DataFrame) -> DataFrame:
    """single: scope, name, source, one row for each name, written. scope, name and head: the source at the end of a name's chain. Names in or
    behind a closed circle of such names have none and are left out."""
    now, left = single.withColumnRenamed("source", "head"), None
    while True:
        onward = now.select("scope", F.col("name").alias("head"), F.col("head").alias("next"))
        jumped = now.join(onward, ["scope", "head"], "left")
        now = checkpointed(jumped.select("scope", "name", F.coalesce("next", "head").alias("head"), F.col("next").isNotNull().alias("on")))
        open_ = now.where("on").count()
        if not open_ or open_ == left:
            # a chain's names are met one distance after the other, so if a round settles none only circles are left
            return now.where("not on").drop("on")
        left, now = open_, now.drop("on")


def close(bindings: DataFrame, edges: DataFrame) -> DataFrame:
    """All bindings (scope, name) after the closure. Scopes without a first binding have none."""
    words = F.explode(F.array_distinct(F.regexp_extract_all("rhs", F.lit(r"(?U)\w+"), F.lit(0)))).alias("source")
    first = checkpointed(bindings.select(*_KEY).distinct())
    if first.isEmpty():
        return first
    of_bound = edges.join(first.select("scope").distinct(), "scope", "left_semi").select("scope", F.col("lhs").alias("name"), words).where("name <> source").distinct()
    uses = checkpointed(of_bound.join(first, _KEY, "left_anti"))
    large = checkpointed(uses.groupBy("scope").agg(F.count("*").alias("n")).where(F.col("n") > LOCAL).select("scope"))
    if large.isEmpty():
        return checkpointed(first.unionByName(searched(first, uses)))
    few = F.broadcast(large)  # a scope of LOCAL edges each
    in_tasks = searched(first.join(few, "scope", "left_anti"), uses.join(few, "scope", "left_anti"))
    by_rounds = closed_by_rounds(checkpointed(first.join(few, "scope", "left_semi")), checkpointed(uses.join(few, "scope", "left_semi")))
    return checkpointed(first.join(few, "scope", "left_anti").unionByName(in_tasks).unionByName(by_rounds))


def searched(first: DataFrame, uses: DataFrame) -> DataFrame:
    """The names of uses (scope, name, source) that can be reached from first, without those of first; a scope is one group of at most LOCAL edges
    and its first names."""
    rows = uses.unionByName(first.withColumn("source", F.lit(None).cast("string")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        onward: dict[str, list[str]] = defaultdict(list)
        begin: list[str] = []
        now = None

        def out() -> pa.RecordBatch:
            seen, todo = set(begin), list(begin)
            while todo:
                for name in onward.get(todo.pop(), ()):
                    if name not in seen:
                        seen.add(name)
                        todo.append(name)
            found = sorted(seen.difference(begin))
            onward.clear()
            begin.clear()
            return pa.RecordBatch.from_arrays([pa.array([now] * len(found), pa.string()), pa.array(found, pa.string())], names=_KEY)

        for b in batches:
            for scope, name, source in zip(*(b.column(c).to_pylist() for c in (*_KEY, "source")), strict=True):
                if scope != now:
                    if now is not None:
                        yield out()
                    now = scope
                if source is None:
                    begin.append(name)
                else:
                    onward[source].append(name)
        if now is not None:
            yield out()

    return rows.where("scope IS NOT NULL").repartition("scope").sortWithinPartitions("scope").mapInArrow(run, "scope string, name string")


def closed_by_rounds(first: DataFrame, uses: DataFrame) -> DataFrame:
    """first and the names of uses (scope, name, source) that can be reached from it; both are written, and uses has no name of first."""
    sources = uses.groupBy(*_KEY).agg(F.count("*").alias("n"), F.min("source").alias("source"))
    single = checkpointed(sources.where("n = 1").drop("n"))
    several = uses.join(single.select(*_KEY), _KEY, "left_anti")
    if single.isEmpty():
        return reached(first, checkpointed(several))
    heads = checkpointed(chains(single))
    via = several.join(heads.select("scope", F.col("name").alias("source"), "head"), ["scope", "source"], "left").select(*_KEY, F.coalesce("head", "source").alias("source")).distinct()
    known = reached(first, checkpointed(via))
    return known.unionByName(heads.join(known.select("scope", F.col("name").alias("head")), ["scope", "head"]).select(*_KEY))


def reached(first: DataFrame, uses: DataFrame) -> DataFrame:
    """first, written, and the names of uses (scope, name, source) that can be reached from it."""
    found = [first]
    while True:
        new = uses.join(found[-1].select("scope", F.col("name").alias("source")), ["scope", "source"]).select(*_KEY).distinct()
        new = checkpointed(new.join(reduce(DataFrame.unionByName, found), _KEY, "left_anti"))
        if new.isEmpty():
            return reduce(DataFrame.unionByName, found)
        if len(found) >= MERGE:
            found = [checkpointed(reduce(DataFrame.unionByName, found).repartition(*_KEY))]
        found.append(new)
