"""Source trees as a data source: ``spark.read.format("source_tree").load(root)`` gives path and content of source files.

Folders are dealt to partitions and listed by the tasks that read them. The driver only looks at as many folders, from the root down, as it
takes to have work for all tasks, and keeps no path of a file. A task walks its folders, reads the ignore files on its way, and
opens a file only after its name has passed every filter.

Options: ``excludes`` (globs, one a line), ``ignore`` (true: ignore files count, those above a local tree too), ``rules`` (JSON list of
[pattern, keeps] that come first), ``partitions`` (about how many; 64). Any file system that Arrow opens can be read (local, s3,
hdfs, gs, abfs). ``under``: prefixes of paths, one a line. ``push`` (false): filters on path (equality, lists, prefixes, suffixes, parts) are
pushed down, which needs spark.sql.python.filterPushdown.enabled; prefixes and equality also decide which folders are listed.
Spark 4.1 keeps what was pushed down with the loaded table, and a later query on the same DataFrame that pushes nothing would
see those files alone: load anew for each query with ``push``. source_files doesn't use it.

As a stream, a batch has the files that were written after the last one, by their times; an offset is a time, SETTLE behind the clock, so a
batch has the same files when it is run again unless they have been written anew. A file that is moved in with an old time isn't seen."""

from __future__ import annotations

import json
import os
import re
import time
import zlib
from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from portcullis.functions.paths import EXTENSIONS
from portcullis.sources.ignore import Rule, above, compiled, exclusion_patterns, from_lines

FORMAT = "source_tree"
SCHEMA = "path string, content string"
#: Files that a partition should have at least; characters and rows of a batch; nanoseconds that a file must have rested.
FEW, BATCH_CHARS, BATCH_ROWS, SETTLE = 256, 4_000_000, 1000, 2_000_000_000


@dataclass(frozen=True)
class Entry:
    name: str
    folder: bool
    changed: int  # nanoseconds


class Store:
    """Folders and files below a root, by paths relative to it."""

    def __init__(self, root: str) -> None:
        self.root = root
        self.local = "://" not in root or root.startswith("file://")
        if self.local:
            self.base = re.sub("^file://[^/]*", "", root).rstrip("/") or "/"
        else:
            self.fs, self.base = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", root))

    @staticmethod
    def opens(root: str) -> bool:
        try:
            Store(root)
        except (pa.ArrowException, OSError, ValueError):
            return False
        return True

    def at(self, path: str) -> str:
        return f"{self.base}/{path}" if path else self.base

    def entries(self, folder: str) -> list[Entry]:
        """In order of their names. A folder that has gone is empty, but the root must be there."""
        try:
            if self.local:
                with os.scandir(self.at(folder)) as found:
                    out = []
                    for e in found:
                        if e.is_dir(follow_symlinks=False):
                            out.append(Entry(e.name, True, 0))
                        elif e.is_file():  # a link to a file is read, one to a folder isn't entered
                            out.append(Entry(e.name, False, e.stat().st_mtime_ns))
            else:
                out = [Entry(i.base_name, i.type == fs.FileType.Directory, i.mtime_ns or 0) for i in self.fs.get_file_info(fs.FileSelector(self.at(folder))) if i.type in (fs.FileType.Directory, fs.FileType.File)]
        except (FileNotFoundError, NotADirectoryError):
            if not self.seen():
                raise
            return []
        except PermissionError:
            if not folder:
                raise
            return []
        return sorted(out, key=lambda e: e.name)

    def seen(self) -> bool:
        """Whether this machine sees the tree at all: a scan of nothing would look like one without findings."""
        return os.path.isdir(self.base) if self.local else self.fs.get_file_info(self.base).type == fs.FileType.Directory

    def read(self, path: str) -> bytes | None:
        """None if it may not be read or has gone since it was listed."""
        try:
            if self.local:
                return Path(self.at(path)).read_bytes()
            with self.fs.open_input_stream(self.at(path)) as f:
                return f.read()
        except PermissionError:
            return None
        except FileNotFoundError:
            if not self.seen():
                raise
            return None


@dataclass(frozen=True)
class Names:
    """What may be read: excludes, and filters on path that were pushed down."""

    excludes: tuple[str, ...] = ()
    under: tuple[str, ...] = ()  # one of these, if any
    prefixes: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()
    parts: tuple[str, ...] = ()
    among: tuple[frozenset[str], ...] = ()

    def folder(self, path: str) -> bool:
        """Whether a folder below the root can hold anything."""
        d = path + "/"
        if any(re.search(p, d) for p in self.excludes):  # matched with nothing after it, so with anything
            return False
        meets = lambda p: d.startswith(p) or p.startswith(d)
        return (not self.under or any(map(meets, self.under))) and all(map(meets, self.prefixes)) and all(any(x.startswith(d) for x in a) for a in self.among)

    def file(self, path: str) -> bool:
        return (
            (not self.under or path.startswith(self.under)) and all(map(path.startswith, self.prefixes)) and all(map(path.endswith, self.suffixes)) and all(p in path for p in self.parts)
            and all(path in a for a in self.among) and not any(re.search(p, path) for p in self.excludes)
        )


def known(name: str) -> bool:
    stem, dot, ext = name.rpartition(".")
    return name == "Rakefile" or bool(stem and dot) and ext.lower() in EXTENSIONS


@dataclass(frozen=True)
class Piece:
    """A folder with the ignore rules that hold in it: all that is below it, or only its own files, of which a share may be meant."""

    folder: str
    rules: tuple[Rule, ...]
    deep: bool
    share: int = 0
    shares: int = 1


class Part(InputPartition):
    def __init__(self, pieces: list[Piece], start: int = 0, end: int = 1 << 62) -> None:
        super().__init__(None)
        self.pieces, self.start, self.end = pieces, start, end


@dataclass
class Tree:
    root: str
    names: Names = field(default_factory=Names)
    ignore: bool = True
    rules: tuple[Rule, ...] = ()
    partitions: int = 64

    @classmethod
    def of(cls, options: dict[str, str]) -> Tree:
        root = options.get("path") or ""
        if not root:
            raise ValueError("no path of a tree was given")
        ignore = options.get("ignore", "true").lower() == "true"
        given = compiled([(p, bool(k)) for p, k in json.loads(options.get("rules", "[]"))])
        if ignore and Store(root).local:
            given = (*compiled(above(Store(root).base)), *given)
        excludes = tuple(exclusion_patterns([g for g in options.get("excludes", "").split("\n") if g]))
        under = tuple(x for x in options.get("under", "").split("\n") if x)
        return cls(root, Names(excludes, under), ignore, given, int(options.get("partitions", 64)))

    def listed(self, store: Store, folder: str, rules: tuple[Rule, ...]) -> tuple[tuple[Rule, ...], list[str], list[Entry]]:
        """The rules in a folder, its folders to enter and its files to read."""
        entries = store.entries(folder)
        prefix = folder + "/" if folder else ""
        if self.ignore and any(e.name == ".gitignore" and not e.folder for e in entries):
            found = store.read(prefix + ".gitignore") or b""
            rules = (*rules, *compiled(from_lines(found.decode(errors="replace").splitlines(), prefix)))

        def dropped(path: str, is_folder: bool) -> bool:
            ignored = False
            for r in rules:
                if (r.folder if is_folder else r.file).search(path):
                    ignored = not r.keeps
            return ignored

        seen = [e for e in entries if not e.name.startswith(".")]
        folders = [prefix + e.name for e in seen if e.folder and self.names.folder(prefix + e.name) and not dropped(prefix + e.name, True)]
        files = [e for e in seen if not e.folder and known(e.name) and self.names.file(prefix + e.name) and not dropped(prefix + e.name, False)]
        return rules, folders, files

    def pieces(self) -> list[list[Piece]]:
        """Work for about so many partitions: folders are opened from the root down until there is enough."""
        store = Store(self.root)
        todo, own, listed, level = deque([("", self.rules)]), [], 0, 1
        while todo and listed < 4 * self.partitions and (level or len(todo) < self.partitions):
            level = level or len(todo)  # a level is finished, so that a large folder beside small ones is seen
            folder, rules = todo.popleft()
            level, listed = level - 1, listed + 1
            rules, folders, files = self.listed(store, folder, rules)
            todo += [(f, rules) for f in folders]
            if files:
                own.append((folder, rules, len(files)))
        out = [[Piece(f, rules, True)] for f, rules in todo]
        wanted = max(FEW, sum(n for *_, n in own) // self.partitions + 1)
        now: list[Piece] = []
        held = 0
        for folder, rules, n in own:
            if n > wanted:
                shares = -(-n // wanted)
                out += [[Piece(folder, rules, False, i, shares)] for i in range(shares)]
                continue
            now.append(Piece(folder, rules, False))
            held += n
            if held >= wanted:
                out.append(now)
                now, held = [], 0
        return [*out, now] if now else out

    def files(self, part: Part, store: Store) -> Iterator[str]:
        """Paths of a partition's files, in order."""
        for piece in part.pieces:
            todo = [(piece.folder, piece.rules)]
            while todo:
                folder, rules = todo.pop()
                rules, folders, files = self.listed(store, folder, rules)
                for e in files:
                    path = f"{folder}/{e.name}" if folder else e.name
                    if part.start < e.changed <= part.end and (piece.shares == 1 or zlib.crc32(e.name.encode()) % piece.shares == piece.share):
                        yield path
                if piece.deep:
                    todo += [(f, rules) for f in reversed(folders)]

    def batches(self, part: Part) -> Iterator[pa.RecordBatch]:
        """path and content of the files that are valid UTF-8."""
        store, paths, contents, held = Store(self.root), [], [], 0
        if not store.seen():
            raise FileNotFoundError(f"No such file or directory on this machine: {self.root}")

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.string())], names=["path", "content"])

        for path in self.files(part, store):
            found = store.read(path)
            if found is None:
                continue
            try:
                contents.append(found.decode())
            except UnicodeDecodeError:
                continue
            paths.append(path)
            held += len(found)
            if held >= BATCH_CHARS or len(paths) >= BATCH_ROWS:
                yield out()
                paths, contents, held = [], [], 0
        if paths:
            yield out()


class Reader(DataSourceReader):
    def __init__(self, tree: Tree) -> None:
        self.tree = tree

    def partitions(self) -> Sequence[InputPartition]:
        return [Part(p) for p in self.tree.pieces()] or [Part([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self.tree.batches(partition)


class FilteredReader(Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        n = self.tree.names
        more: dict[str, list] = {"prefixes": [], "suffixes": [], "parts": [], "among": []}
        for f in filters:
            on_path = getattr(f, "attribute", None) == ("path",)
            if on_path and isinstance(f, EqualTo):
                more["among"].append(frozenset([f.value]))
            elif on_path and isinstance(f, In):
                more["among"].append(frozenset(f.value))
            elif on_path and isinstance(f, StringStartsWith):
                more["prefixes"].append(f.value)
            elif on_path and isinstance(f, StringEndsWith):
                more["suffixes"].append(f.value)
            elif on_path and isinstance(f, StringContains):
                more["parts"].append(f.value)
            else:
                yield f
        self.tree.names = Names(n.excludes, n.under, *((*getattr(n, k), *v) for k, v in more.items()))


class StreamReader(DataSourceStreamReader):
    def __init__(self, tree: Tree) -> None:
        self.tree = tree

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() - SETTLE}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [Part(p, start["until"], end["until"]) for p in self.tree.pieces()] or [Part([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self.tree.batches(partition)


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return (FilteredReader if self.options.get("push", "false").lower() == "true" else Reader)(Tree.of(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return StreamReader(Tree.of(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(SourceTree)
