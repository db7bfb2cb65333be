"""Joins whose keys may be very unevenly filled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table of keys that is broadcast whole, at most.
BROADCAST = 250_000
#: Rows that a group may have, as a share of all rows and at least, to meet its rows by a shuffle.
TIER, LARGE = 100_000, 2_000


def tiered(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with facts, both written; facts are few of each key.

    Few facts are broadcast. Of more, those whose keys have more than a TIERth of all rows (and more than LARGE), so keys of fewer than TIER, are
    broadcast; only the rows of the other keys, few of each, are shuffled."""
    if facts.count() <= BROADCAST:
        return rows.join(F.broadcast(facts), keys)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    cut = max(LARGE, rows.count() // TIER)
    hot = sizes.where(F.col("__n") > cut).select(*keys)
    near = facts.join(F.broadcast(hot), keys, "left_semi")
    return rows.join(F.broadcast(near), keys).unionByName(rows.join(F.broadcast(hot), keys, "left_anti").join(facts, keys))
