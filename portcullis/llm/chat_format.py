"""Chat formatting by columnar byte assembly.

A turn becomes ``<s>[role]`` newline, text, ``</s>`` newline. Inside roles and texts a backslash is put after each of
``< [ ] \\``, so none of the control strings ``<s> </s> [INST] [/INST] [role]`` can stand in an escaped text, and
taking the byte after each of those four away again gives back the original.

A batch of turns is assembled at once: segment lengths and cumulative offsets are computed in numpy, one buffer is
allocated, and headers and contents are scattered into it; it becomes the data buffer of the Arrow column as it is.

Rows are dealt by conversation and sorted by turn. At most PART bytes are assembled at once, so offsets stay far from 32 bits, and
a conversation that is longer than that, or than an Arrow batch, is written as several parts, so no task holds a whole long one; ``read_back`` goes through the parts in order with running digests.

Defined cases: a null text or role is an empty one; turns with equal or null numbers are ordered by turn (nulls
first), role, text; null conversation ids form one conversation; a turn is never split, so one whose escaped text is 2 GiB or
more, which no string column can hold, is an error; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, MIDDLE, TAIL = b"<s>[", b"]\n", b"</s>\n"
TARGET_ROLE = "assistant"
#: Bytes of formatted text that are assembled at once, unless one turn alone is longer.
PART = 1 << 26
SPECIAL = np.zeros(256, bool)
SPECIAL[list(b"<[]\\")] = True
ESCAPED = re.compile(rb"([<\[\]\\])\\")

PARTS = "conv_id long, part int, n_turns int, formatted string, loss_from array<int>, loss_bytes array<int>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def unescape(b: bytes) -> bytes:
    return ESCAPED.sub(rb"\1", b)


def _column(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and its n + 1 offsets from 0."""
    x = pc.fill_null(x.cast(pa.large_string()), "")
    offsets = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1]
    data = np.frombuffer(x.buffers()[2], np.uint8) if x.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(x) else data[:0], offsets - offsets[0]


def _escaped(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, for each the number of backslashes put before it, and the lengths of the escaped values."""
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(SPECIAL[data], out=before[1:])
    return data, before, np.diff(offsets) + np.diff(before[offsets])


def _scatter(out: np.ndarray, data: np.ndarray, before: np.ndarray, offsets: np.ndarray, to: np.ndarray) -> None:
    """Puts value i of data at out[to[i]:]; the gaps that escapes leave hold backslashes already."""
    at = np.arange(len(data)) + before[:-1]
    at += np.repeat(to - (offsets[:-1] + before[offsets[:-1]]), np.diff(offsets))
    out[at] = data


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The formatted turns in one buffer, the n + 1 offsets of turns, and where the escaped contents start and how long they are."""
    r, r_before, r_len = _escaped(*(r_col := _column(roles)))
    t, t_before, t_len = _escaped(*(t_col := _column(texts)))
    length = len(HEAD) + r_len + len(MIDDLE) + t_len + len(TAIL)
    start = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=start[1:])
    out = np.full(start[-1], ord("\\"), np.uint8)
    role_at = start[:-1] + len(HEAD)
    middle_at = role_at + r_len
    text_at = middle_at + len(MIDDLE)
    tail_at = text_at + t_len
    for mark, at in ((HEAD, start[:-1]), (MIDDLE, middle_at), (TAIL, tail_at)):
        out[(at[:, None] + np.arange(len(mark))).ravel()] = np.tile(np.frombuffer(mark, np.uint8), len(at))
    _scatter(out, r, r_before, r_col[1], role_at)
    _scatter(out, t, t_before, t_col[1], text_at)
    return out, start, text_at, t_len


def _pieces(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose formatted text has at most PART bytes, were every byte escaped; rows alone where one has more."""
    size = sum(np.diff(_column(b.column(c))[1]) for c in ("role", "text")) * 2 + len(HEAD + MIDDLE + TAIL)
    ends = np.cumsum(size)
    at = 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, PART + (ends[at - 1] if at else 0), "right")))
        yield b.slice(at, to - at)
        at = to


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, part = object(), 0
    for b in (piece for whole in batches for piece in _pieces(whole)):
        conv, roles = b.column("conv_id"), b.column("role")
        out, start, text_at, text_len = assemble(roles, b.column("text"))
        ids = conv.to_pylist()
        first = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1])]
        bounds = np.array([*first, len(ids)])
        target = pc.fill_null(pc.equal(roles, TARGET_ROLE), False).to_numpy(zero_copy_only=False)
        group = np.repeat(np.arange(len(first)), np.diff(bounds))
        relative = (text_at - start[:-1][bounds[:-1]][group])[target].astype(np.int32)
        n_target = np.zeros(len(first) + 1, np.int64)
        np.cumsum(np.bincount(group[target], minlength=len(first)), out=n_target[1:])
        lists = n_target.astype(np.int32)
        parts = np.zeros(len(first), np.int32)
        parts[0] = part + 1 if ids[0] == last else 0
        last, part = ids[-1], int(parts[-1])
        text = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(start[bounds]), pa.py_buffer(out))
        yield pa.RecordBatch.from_arrays(
            [conv.take(pa.array(first)), pa.array(parts), pa.array(np.diff(bounds).astype(np.int32)), text.cast(pa.string()), pa.ListArray.from_arrays(lists, pa.array(relative)), pa.ListArray.from_arrays(lists, pa.array(text_len[target].astype(np.int32)))],
            names=["conv_id", "part", "n_turns", "formatted", "loss_from", "loss_bytes"],
        )


def format_chats(conversations: DataFrame) -> DataFrame:
    """PARTS: the formatted text of each conversation, in parts, with the byte ranges of the loss mask in it."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_format, PARTS)


class _Reading:
    """The digests of one conversation, fed with its parts."""

    def __init__(self) -> None:
        self.turns, self.loss, self.n_turns, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def feed(self, formatted: bytes, loss_from: list[int], loss_bytes: list[int]) -> None:
        self.chars += len(formatted.decode())
        for turn in formatted.split(TAIL)[:-1]:
            role, _, text = turn[len(HEAD) :].partition(MIDDLE)
            self.turns.update(unescape(role) + b"\n" + unescape(text) + b"\n")
            self.n_turns += 1
        for at, n in zip(loss_from, loss_bytes, strict=True):
            text = unescape(formatted[at : at + n])
            self.loss.update(text)
            self.loss_chars += len(text.decode())


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, now, done = None, None, []

    def out() -> pa.RecordBatch:
        rows = [[c, r.n_turns, r.turns.hexdigest(), r.loss_chars, r.loss.hexdigest(), r.chars] for c, r in done]
        done.clear()
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for b in batches:
        texts = b.column("formatted").cast(pa.binary()).to_pylist()
        for conv, text, at, n in zip(b.column("conv_id").to_pylist(), texts, b.column("loss_from").to_pylist(), b.column("loss_bytes").to_pylist(), strict=True):
            if now is None or conv != last:
                if now is not None:
                    done.append((last, now))
                last, now = conv, _Reading()
            now.feed(text, at, n)
        if done:
            yield out()
    if now is not None:
        done.append((last, now))
        yield out()


def read_back(parts: DataFrame) -> DataFrame:
    """DIGESTS of what format_chats gave, read from its formatted text alone; parts: as format_chats left them, not dealt anew."""
    return parts.mapInArrow(_read, DIGESTS)
