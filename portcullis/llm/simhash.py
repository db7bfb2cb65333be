"""SimHash near-duplicate detection: deletion-variant signatures.

A text's words are cut at ASCII white space, A-Z lower-cased; its shingles of three words, repeats included, are hashed by
XXH64 (seed 42), and a bit of the fingerprint is 1 if more than half of the hashes have it. Two fingerprints are linked if
they differ in at most DISTANCE = 2 bits.

Search. Three exact segments would be the plain way for two bits; here there are two segments only, and each may differ by a bit:
of two linked fingerprints one half differs in at most one bit, so it gives the same value for both with that bit deleted.
Each distinct fingerprint is indexed by its 2 x 32 variants of a half with one bit as a wildcard, which leave 31 bits to
agree on instead of 21. Variants meet by equality, and what meets is verified:

1. Equal fingerprints are one node, by an aggregation.
2. A variant of two fingerprints is a pair; the aggregation that counts variants has both of them already (least and
   greatest), so nothing is joined.
3. Members of a variant of three to LIMIT fingerprints are sorted together and compared there; a spanning forest of their links
   is handed on, not their pairs.
4. A variant of more than LIMIT is cut again: its members agree in one half but for a bit, so the same step is made on
   the halves of what they don't agree on yet (16 bits, then 8). After the third cut a variant has 11 open bits, so at most
   2,048 fingerprints, however many rows there are. No group grows with the input, and no link is lost.
5. Links are closed to components; a component's id is the least key of all its rows.

Rows: a null text and a text without words have fingerprint 0 and are linked like any other; one of fewer than three words has a
single shingle of them all. Texts are hashed in pieces of about PIECE bytes. A null key is never a component's id unless
all of the component's keys are null. Repeated rows give repeated results; an empty table gives none. Other columns of the
table aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portcullis.llm.bag_minhash import classes
from portcullis.llm.common import checkpointed, join_groups, only

SHINGLE, SEED, BITS, DISTANCE = 3, 42, 64, 2
#: Fingerprints of a variant that are compared in one place; beyond it the variant is cut again.
LIMIT = 1024
PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + PIECE)
        end = space.start() if space else len(text)
        yield text[at:end].split()
        at = end


def fingerprint(text: bytes | None) -> int:
    """The unsigned fingerprint of a text in UTF-8."""
    ones, n, last = np.zeros(BITS, np.int64), 0, []
    for found in _pieces((text or b"").lower()):
        words = last + found
        if len(words) >= SHINGLE:
            k = len(words) - SHINGLE + 1
            shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
            ones += _ones(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, k))
            n += k
        last = words[-(SHINGLE - 1) :]
    if not n and last:
        ones, n = _ones(np.array([xxhash.xxh64_intdigest(b" ".join(last), SEED)], np.uint64)), 1
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the highest first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in b.column("text")), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(found.view(np.int64))], names=["key", "fp"])


def variants(left: DataFrame, width: int) -> DataFrame:
    """variant, fp and rest of (variant, fp, rest): rest's two halves, each with one bit deleted; the other half is what is left.

    A variant's name is a hash of what its members agree on; should two share a name, their members meet and aren't linked."""
    half = width // 2
    cut = left.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    own = f"(rest >>> (i div {half} * {half})) & {(1 << half) - 1} & ~(1L << (i % {half}))"
    other = f"(rest >>> ((1 - i div {half}) * {half})) & {(1 << half) - 1}"
    return cut.selectExpr(f"xxhash64(variant, i, {own}) AS variant", "fp", f"{other} AS rest")


def forest(members: np.ndarray) -> list[tuple[int, int]]:
    """Links that join whatever is linked, directly or not, of distinct fingerprints: fewer than there are fingerprints."""
    out, open_, bits = [], np.ones(len(members), bool), members.view(np.uint64)
    for first in range(len(members)):
        if not open_[first]:
            continue
        open_[first] = False
        todo = [first]
        while todo:
            i = todo.pop()
            near = np.flatnonzero(open_ & (np.bitwise_count(bits ^ bits[i]) <= DISTANCE))
            open_[near] = False
            todo += near.tolist()
            out += [(int(members[i]), int(members[j])) for j in near]
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (variant, fp) with the rows of a variant together."""
    name, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def links(upto: int) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(name[:upto])) + 1
        found = [x for group in np.split(fp[:upto], cuts) for x in forest(group)]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["u", "v"])

    for b in batches:
        name, fp = np.concatenate([name, b.column("variant").to_numpy()]), np.concatenate([fp, b.column("fp").to_numpy()])
        if len(name) and (whole := int(np.searchsorted(name, name[-1]))):  # the last variant may go on in the next batch
            yield links(whole)
            name, fp = name[whole:], fp[whole:]
    if len(name):
        yield links(len(name))


def near_links(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Links (u, v) that join all distinct fingerprints fp, written, that are linked."""
    left, width, out = prints.select(F.lit(0).cast("long").alias("variant"), "fp", F.col("fp").alias("rest")), BITS, []
    while True:
        last = width == 16
        keyed = variants(left, width)
        shared = checkpointed(keyed.groupBy("variant").agg(F.min("fp").alias("u"), F.max("fp").alias("v"), F.count("*").alias("n")).where("n > 1"))
        out.append(shared.where(f"n = 2 AND bit_count(u ^ v) <= {DISTANCE}").select("u", "v"))
        several = only(keyed, checkpointed(shared.where("n > 2" if last else f"n > 2 AND n <= {limit}").select("variant")), "variant")
        out.append(several.select("variant", "fp").repartition("variant").sortWithinPartitions("variant").mapInArrow(_compare, "u long, v long"))
        many = shared.where(f"n > 2 AND n > {limit}").select("variant")
        if last or many.isEmpty():
            break
        left, width = checkpointed(only(keyed, checkpointed(many), "variant")), width // 2
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def simhash(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row for each row of docs: key, fingerprint (16 hex digits), component_id."""
    kind = docs.schema[key].dataType.simpleString()
    signed = checkpointed(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("text")).mapInArrow(_sign, f"key {kind}, fp long"))
    prints = checkpointed(signed.groupBy("fp").agg(F.min("key").alias("first"), F.count("*").alias("n")))
    found = classes(near_links(prints, limit))
    of = checkpointed(prints.join(found, F.col("fp") == F.col("node"), "left").select("fp", "n", "first", F.coalesce("class", "fp").alias("class")))
    least = checkpointed(of.groupBy("class").agg(F.min("first").alias("component_id"), F.count("*").alias("prints")))
    groups = checkpointed(join_groups(of.select("fp", "n", "class"), least, "class", "prints").select("fp", "n", "component_id"))
    return join_groups(signed, groups, "fp", "n").select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
