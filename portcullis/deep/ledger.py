"""Calls to a model from tasks, each made once.

Requests go out in waves of at most ``max_concurrent``, a task for each. An answer is written to the ledger, a folder that driver and workers
share, under a hash of its request before it counts; a task that is repeated finds it there and doesn't ask again. (Only a task that is lost
between the request and the write asks twice: no one but the model could tell.) A wave holds no more requests than the cost cap lets through
whatever they cost, so a run in waves asks exactly what one call after the other would have asked."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

from portcullis.deep.prompt import SCHEMA, SYSTEM
from portcullis.deep.settings import Settings
from portcullis.deep.transports import Analyzer, Answer, Skip
from portcullis.sources.config import ConfigError


class Ledger:
    def __init__(self, folder: str) -> None:
        self.folder = Path(folder)

    def place(self, request: str) -> Path:
        return self.folder / f"{hashlib.sha256(request.encode()).hexdigest()}.json"

    def get(self, request: str) -> dict | None:
        try:
            return json.loads(self.place(request).read_text(encoding="utf-8"))
        except FileNotFoundError:
            return None

    def put(self, request: str, entry: dict) -> dict:
        """Writes an entry whole, unless there is one already; the one that is there."""
        own = self.folder / f".{uuid.uuid4().hex}"
        own.write_text(json.dumps(entry), encoding="utf-8")
        try:
            os.link(own, self.place(request))  # fails if another attempt was first
        except FileExistsError:
            pass
        finally:
            own.unlink()
        return self.get(request) or entry

    def asked(self, ask: Analyzer, request: str) -> dict:
        """What the ledger has for a request, asked for if it has nothing. Trouble with the settings isn't kept, so it can be mended."""
        if (found := self.get(request)) is not None:
            return found
        try:
            a = ask(request)
        except Skip as e:
            return self.put(request, {"skip": str(e)})
        except ConfigError as e:
            return {"error": str(e)}
        return self.put(request, {"findings": a.findings, "input_tokens": a.input_tokens, "output_tokens": a.output_tokens})


def micro_usd(settings: Settings, input_tokens: int, output_tokens: int) -> int:
    return round((input_tokens / 1000 * settings.rate_in + output_tokens / 1000 * settings.rate_out) * 1_000_000)


def wave(settings: Settings, spent: int, requests: list[str]) -> int:
    """How many of the next requests may go out together: each must be one that would be sent though all before it cost the most they can.

    A token has at least one byte, so a request's bytes bound what it costs; what an answer costs has no bound."""
    most = max(1, settings.max_concurrent)
    if settings.max_cost is None or not (settings.rate_in or settings.rate_out):
        return min(most, len(requests))
    if settings.rate_out:
        return min(1, len(requests))
    fixed = len((SYSTEM + json.dumps(SCHEMA)).encode()) + 1000
    n = 0
    for r in requests[:most]:
        if n and spent > settings.max_cost * 1_000_000:
            break
        n += 1
        spent += micro_usd(settings, fixed + len(r.encode()), 0)
    return n


def ask_all(spark: SparkSession, requests: list[tuple[int, str]], settings: Settings, ask: Analyzer, folder: str) -> Iterator[tuple[int, dict]]:
    """(number, entry) of requests (number, text), in order, up to and with the one that goes beyond the cost cap."""
    os.makedirs(folder, exist_ok=True)
    call, spent, at = _caller(ask, folder), 0, 0
    while at < len(requests):
        n = wave(settings, spent, [r for _, r in requests[at:]])
        now = requests[at : at + n]
        df = spark.createDataFrame([(i, r) for (i, r) in now], "i int, request string").repartition(n, "i")
        found = {r["i"]: json.loads(r["entry"]) for r in df.mapInArrow(call, "i int, entry string").collect()}  # at most max_concurrent answers
        for i, _ in now:
            if "error" in found[i]:
                raise ConfigError(found[i]["error"])
            yield i, found[i]
            spent += micro_usd(settings, found[i].get("input_tokens", 0), found[i].get("output_tokens", 0))
            if settings.max_cost is not None and (settings.rate_in or settings.rate_out) and spent > settings.max_cost * 1_000_000:
                return
        at += n


def _caller(ask: Analyzer, folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ledger = Ledger(folder)
        if not ledger.folder.is_dir():
            raise FileNotFoundError(f"No such file or directory on this machine: {folder}")
        for b in batches:
            entries = [json.dumps(ledger.asked(ask, r)) for r in b.column("request").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("i"), pa.array(entries, pa.string())], names=["i", "entry"])

    return run


def one_by_one(requests: list[tuple[int, str]], settings: Settings, ask: Analyzer) -> Iterator[tuple[int, dict]]:
    """The same from the driver, one call after the other."""
    spent = 0
    for i, r in requests:
        try:
            a: Answer = ask(r)
        except Skip as e:
            yield i, {"skip": str(e)}
            continue
        yield i, {"findings": a.findings, "input_tokens": a.input_tokens, "output_tokens": a.output_tokens}
        if settings.rate_in or settings.rate_out:
            spent += micro_usd(settings, a.input_tokens, a.output_tokens)
            if settings.max_cost is not None and spent > settings.max_cost * 1_000_000:
                return
