"""A tail of growing log files as a streaming source: offsets are bytes of each file.

``path`` names the live files: a file, a folder (all files below it) or a pattern of either. A file
is known by its inode and its first bytes, so it is followed when it is renamed, and a
new file at its path, or the same one cut and written again, is a new one. What a
renamed file still gets is read first. Compressed files and hidden ones are passed over.

A batch ends at the last line feed of each file; what follows is read once it is
complete. The bytes of a batch are cut into blocks of ``blockBytes``, one a task, and each
line is read by the block it begins in, so one large file spreads over many tasks and
no line is too long. Tasks open a file by its inode, so a rotation between planning
and reading does no harm. A file that is gone or cut before it was read fails the query,
or with ``failOnDataLoss`` set to ``false`` gives what is left.

A query's checkpoint holds how far each file was read, and when that was written. ``state`` names a folder, kept by the
driver alone, with what a checkpoint cannot hold: which file a number stands for, and in
which order files came. It is replaced as a whole before an offset that needs it is
returned, so a run after a crash finds the same files. The first start (no state yet)
begins at the end of the files that are there, or with ``fromBegin`` at their beginning.

``order`` numbers the files of a folder as they came, so ``(order, offset)`` orders the lines
of a log over rotations. All machines must see the files under one path; on stores with
a scheme (``s3://``, ``hdfs://``) files are known by their paths.
"""

from __future__ import annotations

import glob
import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "value string, path string, file_order long, offset long, modified_ms long"
PASSED_OVER = (".gz", ".xz", ".bz2", ".zst", ".lz4", ".crc")
HEAD = 256
CHUNK = 4 << 20
BLOCK = 64 << 20


class Posix:
    """Files of a mounted file system."""

    def listed(self, path: str) -> list[str]:
        out = []
        for root in [path] if os.path.exists(path) else glob.glob(path):
            if os.path.isdir(root):
                below = [os.path.join(where, f) for where, _, files in os.walk(root) for f in files]
                out += [p for p in below if os.path.isfile(p) and _wanted(p, root)]
            elif _wanted(root, os.path.dirname(root)):
                out.append(root)
        return sorted(out)

    def siblings(self, folder: str) -> dict[str, str]:
        """Path of each file of a folder by its identity."""
        try:
            return {str(e.stat().st_ino): e.path for e in os.scandir(folder) if e.is_file()}
        except FileNotFoundError:
            return {}

    def identity(self, path: str) -> str:
        return str(os.stat(path).st_ino)

    def size(self, path: str) -> int:
        return os.stat(path).st_size

    def changed(self, path: str) -> int:
        return os.stat(path).st_mtime_ns // 1_000_000

    def open(self, path: str):
        return open(path, "rb", buffering=0)


class Store:
    """Files of a store that pyarrow can read; they are known by their paths."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.files, self.root = fs.FileSystem.from_uri(uri)
        self.of = fs

    def listed(self, path: str) -> list[str]:
        found = self.files.get_file_info(self.of.FileSelector(self.root, recursive=True))
        return sorted(f.path for f in found if f.is_file and _wanted(f.path, self.root))

    def siblings(self, folder: str) -> dict[str, str]:
        return {f.path: f.path for f in self.files.get_file_info(self.of.FileSelector(folder, allow_not_found=True)) if f.is_file}

    def identity(self, path: str) -> str:
        return path

    def size(self, path: str) -> int:
        return self.files.get_file_info(path).size

    def changed(self, path: str) -> int:
        return self.files.get_file_info(path).mtime_ns // 1_000_000

    def open(self, path: str):
        return self.files.open_input_file(path)


def files_of(path: str):
    scheme = path.split("://")[0] if "://" in path else "file"
    return Posix() if scheme == "file" else Store(path)


def local(path: str) -> str:
    """``path`` without the scheme of mounted files."""
    return path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")


def _wanted(path: str, below: str) -> bool:
    parts = path[len(below) :].split("/") if path.startswith(below) else [os.path.basename(path)]
    return not path.endswith(PASSED_OVER) and not any(p.startswith((".", "_")) for p in parts)


def _head(files, path: str, n: int) -> int:
    with files.open(path) as f:
        return zlib.crc32(f.read(n))


def _complete(files, path: str, begin: int, size: int) -> int:
    """The byte behind the last line feed between ``begin`` and ``size``; ``begin`` for none."""
    with files.open(path) as f:
        upto = size
        while upto > begin:
            low = max(begin, upto - (64 << 10))
            f.seek(low)
            at = f.read(upto - low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            upto = low
    return begin


@dataclass
class Block(InputPartition):
    """Lines that begin in ``[start, end)`` of a file; ``begin`` and ``limit`` are those of the whole batch."""

    folder: str
    path: str
    identity: str
    order: int
    begin: int
    start: int
    end: int
    limit: int
    modified_ms: int


class State:
    """What is known of files, in one JSON file that is replaced as a whole."""

    def __init__(self, folder: str):
        self.path = os.path.join(folder, "tail.json")
        os.makedirs(folder, exist_ok=True)
        self.exists = os.path.exists(self.path)
        #: Files by number, how many numbers were given, and how many files came in each folder.
        self.files: dict[str, dict] = {}
        self.given = 0
        self.came: dict[str, int] = {}
        if self.exists:
            with open(self.path) as f:
                held = json.load(f)
            self.files, self.given, self.came = held["files"], held["given"], held["came"]

    def save(self) -> None:
        with open(f"{self.path}.new", "w") as f:
            json.dump({"files": self.files, "given": self.given, "came": self.came}, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{self.path}.new", self.path)
        self.exists = True

    def add(self, files, path: str, identity: str, size: int, start: int) -> None:
        folder = os.path.dirname(path)
        n = min(HEAD, size)
        self.files[str(self.given)] = {"folder": folder, "path": path, "identity": identity, "order": self.came.get(folder, 0), "start": start, "seen": start, "seen_ms": 0, "head": n, "head_crc": _head(files, path, n), "looked": [-1, -1]}
        self.given += 1
        self.came[folder] = self.came.get(folder, 0) + 1


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        get = {k.lower(): v for k, v in options.items()}
        self.path, self.folder = local(get["path"]), local(get["state"])
        self.from_begin = get.get("frombegin", "false").lower() == "true"
        self.block = int(get.get("blockbytes", BLOCK))
        self.strict = get.get("failondataloss", "true").lower() == "true"
        if self.block < 1:
            raise ValueError("blockBytes must be 1 at least")

    def _looked(self) -> State:
        """The state brought up to date: new files, renamed ones, those that were cut or are gone, and how far each is complete."""
        files, state = files_of(self.path), State(self.folder)
        first = not state.exists
        places = {folder: files.siblings(folder) for folder in {f["folder"] for f in state.files.values()}}
        for f in state.files.values():
            f["path"] = places[f["folder"]].get(f["identity"])
            if f["path"] is not None:
                self._advance(files, f)
        known = {(f["folder"], f["identity"]) for f in state.files.values()}
        fresh = []
        for path in files.listed(self.path):
            try:
                identity = files.identity(path)
                if (os.path.dirname(path), identity) not in known:
                    fresh.append((files.changed(path), _rolled_number(path), path, identity, files.size(path)))
            except FileNotFoundError:  # renamed just now; the next look finds it
                continue
        for _, _, path, identity, size in sorted(fresh):
            state.add(files, path, identity, size, _complete(files, path, 0, size) if first and not self.from_begin else 0)
            self._advance(files, state.files[str(state.given - 1)])
        state.save()  # before an offset that needs it
        return state

    def _advance(self, files, f: dict) -> None:
        try:
            size, changed = files.size(f["path"]), files.changed(f["path"])
            if [size, changed] == f["looked"]:
                return
            if size < f["seen"] or size < f["head"] or _head(files, f["path"], f["head"]) != f["head_crc"]:
                f["identity"], f["path"] = "", None  # other bytes are there now: a new file
                return
            if f["head"] < HEAD and size > f["head"]:
                f["head"] = min(HEAD, size)
                f["head_crc"] = _head(files, f["path"], f["head"])
            upto = _complete(files, f["path"], f["seen"], size)
            if upto > f["seen"]:
                f["seen"], f["seen_ms"] = upto, changed
            f["looked"] = [size, changed]
        except FileNotFoundError:
            f["path"] = None

    def initialOffset(self) -> dict:
        state = State(self.folder)
        if not state.exists:
            state = self._looked()
        return {"at": {n: {"to": f["start"], "ms": 0} for n, f in state.files.items()}}

    def latestOffset(self) -> dict:
        return {"at": {n: {"to": f["seen"], "ms": f["seen_ms"]} for n, f in self._looked().files.items()}}

    def partitions(self, start: dict, end: dict) -> list[Block]:
        state, out = State(self.folder), []
        for n, upto in end["at"].items():
            f = state.files.get(n)
            if f is None:  # read to its end, and forgotten since
                continue
            begin = start["at"][n]["to"] if n in start["at"] else f["start"]
            for low in range(begin, upto["to"], self.block):
                out.append(Block(f["folder"], f["path"] or "", f["identity"], f["order"], begin, low, min(low + self.block, upto["to"]), upto["to"], upto["ms"]))
        return out

    def commit(self, end: dict) -> None:
        """Forgets files that are gone, or were cut, and are read as far as they were seen."""
        state = State(self.folder)
        done = [n for n, f in state.files.items() if f["path"] is None and n in end["at"] and end["at"][n]["to"] >= f["seen"]]
        for n in done:
            del state.files[n]
        if done:
            state.save()

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        files = files_of(self.path)
        path = partition.path
        try:
            if not path or files.identity(path) != partition.identity:
                raise FileNotFoundError(path)
        except FileNotFoundError:
            path = files.siblings(partition.folder).get(partition.identity)
        if path is None:
            return self._lost(f"a file of {partition.folder} is gone before bytes {partition.start} to {partition.end} were read")
        for starts, lines in lines_of_block(files, path, partition):
            if lines is None:
                self._lost(f"{path} ends before byte {partition.limit}")
                return
            try:
                values = pa.array(lines, pa.binary()).cast(pa.string())
            except pa.ArrowInvalid:  # not UTF-8
                values = pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())
            n = len(lines)
            yield pa.RecordBatch.from_arrays(
                [values, pa.array([path] * n, pa.string()), pa.array([partition.order] * n, pa.int64()), pa.array(starts, pa.int64()), pa.array([partition.modified_ms] * n, pa.int64())], [f.split()[0] for f in SCHEMA.split(", ")]
            )

    def _lost(self, what: str) -> Iterator[pa.RecordBatch]:
        if self.strict:
            raise RuntimeError(f"{what}; set failOnDataLoss to false to go on without it")
        return iter(())


def lines_of_block(files, path: str, block: Block) -> Iterator[tuple[list[int], list[bytes] | None]]:
    """``(starts, lines)`` of the lines that begin in the block, in runs; ``lines`` is None where the file ends too early."""
    at = block.start
    with files.open(path) as f:
        if block.start > block.begin:  # the first line of the block begins behind the first line feed from the byte before it on
            at = block.start - 1
            f.seek(at)
            while True:
                chunk = f.read(min(CHUNK, block.limit - at))
                if not chunk:
                    if at < block.limit:
                        yield [], None
                    return
                cut = chunk.find(b"\n")
                if cut >= 0:
                    at += cut + 1
                    break
                at += len(chunk)
        f.seek(at)
        rest, first = [], at
        while first < block.end:
            chunk = f.read(min(CHUNK, block.limit - at)) if at < block.limit else b""
            if not chunk:
                yield [], None
                return
            at += len(chunk)
            cut = chunk.rfind(b"\n")
            if cut < 0:
                rest.append(chunk)
                continue
            lines = b"".join([*rest, chunk[:cut]]).split(b"\n")
            rest = [chunk[cut + 1 :]] if cut + 1 < len(chunk) else []
            starts = []
            for line in lines:
                starts.append(first)
                first += len(line) + 1
            inside = len(starts) if starts[-1] < block.end else next(i for i, s in enumerate(starts) if s >= block.end)
            if inside:
                yield starts[:inside], lines[:inside]


def _rolled_number(path: str) -> int:
    """Of files with one time the one with the greater number at its end is older."""
    tail = path.rsplit(".", 1)[-1]
    return -int(tail) if tail.isascii() and tail.isdigit() and len(tail) < 6 else 0


class LogTail(DataSource):
    """``spark.readStream.format("log_tail")``; options ``path``, ``state``, ``fromBegin``, ``blockBytes``, ``failOnDataLoss``."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))
