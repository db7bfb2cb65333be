"""Exact de-duplication with a heavy-hitter split, in DataFrame operations only.

1. Each text is normalised and digested (SHA-256) in the JVM; only digest, length and key go on, checkpointed once.
2. A Misra-Gries summary over the digests (the mergeable frequent-items sketch behind ``approx_top_k``, which decrements
   all its counters when full) names at most HEAVY candidates. With TRACKED counters every digest that holds more
   than about 1 / TRACKED of the rows is among its counters.
3. Candidates are verified by an exact aggregation, combined on the map side, so a hot digest sends one row a task.
   The winners (at most HEAVY rows) are broadcast and their copies are settled without a shuffle.
4. All other digests are aggregated, combined on the map side, by an ordinary shuffle, and their groups meet their rows again:
   groups of more than a 100,000th of all rows by a broadcast (there are fewer than 100,000 of them), the rest by a shuffle. So
   no task has more of a digest's rows than that.

Defined cases: null text counts as empty; repeated rows are copies of each other and exactly one stays; of equal texts
the row with the most code points stays, then the smallest key, null keys last; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portcullis.llm.common import ROW, checkpointed, filtered, join_groups, with_row, without

#: Most digests that are broadcast, and counters of the sketch.
HEAVY, TRACKED = 512, 8192


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """ROW, key, code points of the original text and the digest of the normalised one."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(ROW, F.col(key).alias("key"), F.length(t).alias("n"), F.unhex(F.sha2(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "").cast("binary"), 256)).alias("digest"))


def decide(d: DataFrame) -> DataFrame:
    """d: ROW, key, n, digest, already written. Adds keep_id, group_size and kept."""
    best = F.struct((-F.col("n")).alias("a"), F.col("key").isNull().alias("b"), F.col("key").alias("key"), F.col(ROW).alias(ROW))
    found = d.agg(F.expr(f"approx_top_k(xxhash64(digest), {HEAVY}, {TRACKED})").alias("top"))
    heavy = found.select(F.explode("top").alias("x")).where("x.count > 1").select(F.col("x.item").alias("h"))
    winners = d.join(F.broadcast(heavy), F.xxhash64("digest") == F.col("h"), "left_semi").groupBy("digest").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("group_size"))
    winners = checkpointed(winners)  # at most HEAVY digests
    hot = d.join(F.broadcast(winners), "digest")
    rest = d.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = checkpointed(rest.groupBy("digest").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("group_size")))
    cold = join_groups(rest, groups, "digest", "group_size")
    return hot.unionByName(cold).select(ROW, "key", "digest", F.col("best.key").alias("keep_id"), "group_size", (F.col(ROW) == F.col(f"best.{ROW}")).alias("kept"))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: key, keep_id, group_size, kept, text_sha256."""
    out = decide(checkpointed(digests(with_row(docs), key, text)))
    return out.select(F.col("key").alias(key), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""

    def keep(rows: DataFrame) -> DataFrame:
        dropped = decide(checkpointed(digests(rows, key, text))).where("not kept").select(ROW)
        return without(rows, checkpointed(dropped))

    return filtered(docs, keep)
