"""Byte-level BPE with a sentencepiece model that is serialised directly from a vocabulary of ranks.

Every byte has a printable stand-in character; a token becomes the piece of its bytes' characters, scored by its
negative rank, so that sentencepiece merges in the order of ranks. The normaliser is the identity: no charsmap, no
dummy prefix, no removal or escape of spaces. Pre-tokens of the splitting pattern are encoded one by one; a pre-token
that is itself a token is that token. Piece ids are ranks; the unknown piece comes last. Decoding maps ids back to
bytes.

Only the ranks file's bytes (under MAX_VOCABULARY) are broadcast; each Python worker builds its model once. Texts are
read whole, one at a time. Defined cases: null text counts as empty and gives no ids; repeated rows are encoded alike;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
MAX_VOCABULARY = 64 << 20
#: Pre-tokens whose ids are kept, and the longest that is.
KEPT, KEPT_LENGTH = 200_000, 64
#: Characters of texts that are encoded together.
GROUP = 300_000

DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Stand-ins: printable characters stand for themselves in Latin-1, others for U+0100 and on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHER = [b for b in range(256) if b not in set(_PLAIN)]
STAND_IN = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(_OTHER)}


def ranks(data: bytes) -> list[bytes]:
    """The tokens of a ranks file, by rank."""
    pairs = (line.split() for line in data.splitlines() if line)
    by_rank = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(by_rank) != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    return [by_rank[i] for i in range(len(by_rank))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: fields 1 pieces, 2 trainer spec, 3 normaliser spec."""
    if len(tokens) >= 1 << 24:
        raise ValueError("scores are 32-bit floats: at most 2**24 ranks are told apart")
    out = []
    for rank, token in enumerate(tokens):
        piece = "".join(STAND_IN[b] for b in token).encode()
        out.append(_field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, 1)))
    out.append(_field(1, _field(1, "⁇unknown".encode()) + _field(2, 0.0) + _field(3, 2)))  # last, so that ids are ranks
    absent = (1 << 64) - 1  # -1: no such piece
    out.append(_field(2, _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + b"".join(_field(i, absent) for i in (41, 42, 43))))
    out.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class Codec:
    """known: pre-token -> its ids as little-endian 32-bit integers."""

    def __init__(self, data: bytes, pattern: str) -> None:
        import regex
        import sentencepiece

        self.tokens = ranks(data)
        self.whole = {t.decode(): struct.pack("<I", i) for i, t in enumerate(self.tokens) if _is_text(t)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.tokens))
        self.split = regex.compile(pattern).findall
        self.stand_in = {b: STAND_IN[b] for b in range(256)}
        self.known = dict(self.whole)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; pre-tokens that are new to all of them are put to the model at once."""
        split = [self.split(t) for t in texts]
        met = set().union(*split)
        known, new = self.known, list(met.difference(self.known))
        if new:
            pieces = [w.encode().decode("latin-1").translate(self.stand_in) for w in new]
            found = self.model.encode(pieces, out_type=int, num_threads=1)
            if len(known) + len(new) > KEPT + len(self.whole):  # begin anew with what these texts need
                self.known = known = self.whole | {w: known[w] for w in met.difference(new)}
            known.update(zip(new, (_PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes() for ids in found), strict=True))
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > KEPT_LENGTH:
                del known[w]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_PACK = [struct.Struct(f"<{n}I").pack for n in range(24)]


def groups(texts: pa.Array) -> Iterator[list[str]]:
    """Texts in runs of up to GROUP characters or so, null as empty."""
    run, size = [], 0
    for t in texts:
        run.append(t.as_py() or "")
        size += len(run[-1])
        if size >= GROUP:
            yield run
            run, size = [], 0
    if run:
        yield run


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(data: bytes, pattern: str) -> Codec:
    """One for each vocabulary and pattern in a worker process."""
    key = (hashlib.sha256(data).hexdigest(), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(data, pattern)
    return _CODECS[key]


def _vocabulary(df: DataFrame, path: str | None):
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        data = f.read(MAX_VOCABULARY + 1)
    if len(data) > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary of over {MAX_VOCABULARY} bytes isn't broadcast")
    return df.sparkSession.sparkContext.broadcast(data)


def encode(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """All columns of docs but text, and ids array<int>."""
    shared = _vocabulary(docs, path)
    others = [c for c in docs.columns if c != text and c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value, pattern)
        for b in batches:
            ids = [np.frombuffer(x, "<i4") for run_ in groups(b.column(text)) for x in c.encode_all(run_)]
            lists = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(o) for o in others), lists], names=[*others, "ids"])

    kept = docs.select(*[F.col(f"`{c}`") for c in others])
    return docs.select(*[F.col(f"`{c}`") for c in [*others, text]]).mapInArrow(run, kept.withColumn("ids", F.lit(None).cast("array<int>")).schema)


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """key and DIGESTS: of the ids of each text, and of the bytes that they decode to."""
    shared = _vocabulary(docs, path)
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"{key} {source.schema['key'].dataType.simpleString()}, {DIGESTS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value, pattern)
        for b in batches:
            n, ids_hash, decoded_hash = [], [], []
            for texts in groups(b.column("text")):
                for ids in c.encode_all(texts):
                    n.append(len(ids) // 4)
                    ids_hash.append(hashlib.sha256(ids).hexdigest())
                    decoded_hash.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(decoded_hash, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return source.mapInArrow(run, schema)
