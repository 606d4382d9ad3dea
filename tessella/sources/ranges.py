"""Files by byte ranges: Python data sources that list a folder, plan ranges and open only those.

`byte_ranges` gives (path, length, offset, data) rows of `chunk` bytes at most, of files of any size, or of their first `head` bytes only. `line_ranges` gives the lines of text files whose first byte lies in a
range, with their place in the range. `image_sizes` walks the headers of image files with seeks. Files are opened by pyarrow's file systems; for stores that only Spark opens, `reachable` is
false and the readers that have one take Spark's whole-file source.

Defined results: a folder without a matching file gives no rows; an empty file has one range without bytes, and no line; a name that begins with `.` or `_` is passed over, as by Spark.
"""

from __future__ import annotations

import fnmatch
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK, TASK_BYTES, TASK_FILES, BATCH_BYTES = 8 << 20, 128 << 20, 64, 8 << 20
BROADCAST_ROWS = 200_000


def opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, what to put before such paths)."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system, inner, path[: -len(inner)] if path.endswith(inner) else ""


def reachable(path: str) -> bool:
    """Whether pyarrow has a file system for the path."""
    try:
        opened(path)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def listed(path: str, glob: str = "*", recursive: bool = False) -> tuple[fs.FileSystem, str, list[tuple[str, int]]]:
    """(file system, prefix, [(path, length)]) of the files of a folder whose names match, or of one file, by path."""
    system, inner, prefix = opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return system, prefix, [(inner, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(fs.FileSelector(inner, recursive=recursive))
    names = [(f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, glob) and f.base_name[:1] not in "._"]
    return system, prefix, sorted(names)


@dataclass
class Ranges(InputPartition):
    """Byte ranges for one task: (path, length of the file, begin, end)."""

    ranges: list[tuple[str, int, int, int]]


def planned(files: list[tuple[str, int]], size: int, whole: bool, most: int = TASK_BYTES, count: int = TASK_FILES) -> list[Ranges]:
    """Ranges of `size` bytes, dealt to tasks in order; with whole, a file's ranges all go to one task."""
    out, held, total = [], [], 0
    for path, length in files:
        own = [(path, length, lo, min(length, lo + size)) for lo in range(0, max(length, 1), size)]
        for part in [own] if whole else [[r] for r in own]:
            weight = part[-1][3] - part[0][2]
            if held and (total + weight > most or len(held) >= count):
                out.append(Ranges(held))
                held, total = [], 0
            held.extend(part)
            total += weight
    return [*out, Ranges(held)] if held else out


class _Source(DataSource):
    """Options: path, glob ('*'), recursive ('false'), chunk, head, whole ('false': whether a file's ranges stay in one task, in order), task_bytes."""

    kind: type[_Reader]
    columns: str

    def schema(self) -> str:
        return self.columns

    def reader(self, schema) -> DataSourceReader:
        return self.kind(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.path = options["path"]
        self.chunk = int(options.get("chunk", CHUNK))
        self.head = int(options["head"]) if "head" in options else None

    def partitions(self) -> list[Ranges]:
        _, _, files = listed(self.path, self.options.get("glob", "*"), self.options.get("recursive", "false").lower() == "true")
        most = int(self.options.get("task_bytes", TASK_BYTES))
        if self.head is not None:
            heads = [(p, length, 0, min(length, self.head)) for p, length in files]
            each = max(1, min(TASK_FILES, most // max(1, self.head)))
            return [Ranges(heads[k : k + each]) for k in range(0, len(heads), each)]
        return planned(files, self.chunk, self.options.get("whole", "false").lower() == "true", most)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, _, prefix = opened(self.path)
        last, handle = None, None
        held: list[pa.RecordBatch] = []
        size = 0
        for path, length, lo, hi in partition.ranges:
            if path != last:
                if handle:
                    handle.close()
                last, handle = path, system.open_input_file(path)
            for b in self.rows(prefix + path, handle, length, lo, hi):
                held.append(b)
                size += b.nbytes
                if size >= BATCH_BYTES or len(held) >= 500:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
        if handle:
            handle.close()

    def rows(self, path: str, handle: pa.NativeFile, length: int, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError


class _BytesReader(_Reader):
    def rows(self, path, handle, length, lo, hi):
        for at in range(lo, max(hi, lo + 1), self.chunk):
            data = handle.read_at(min(self.chunk, hi - at), at)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([length]), pa.array([at]), pa.array([data], pa.binary())], ["path", "length", "offset", "data"])


class ByteRanges(_Source):
    kind, columns = _BytesReader, "path string, length long, offset long, data binary"

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"


class _LinesReader(_Reader):
    def rows(self, path, handle, length, lo, hi):
        """The lines whose first byte lies in [lo, hi): the range's bytes, and what its last line has beyond."""
        data = handle.read_at(hi - lo, lo) if hi > lo else b""
        if lo and handle.read_at(1, lo - 1) != b"\n":
            cut = data.find(b"\n")
            data = data[cut + 1 :] if cut >= 0 else b""
        at = hi
        while data and data[-1:] != b"\n" and at < length:
            more = handle.read_at(min(1 << 16, length - at), at)
            cut = more.find(b"\n")
            data += more[: cut + 1] if cut >= 0 else more
            at += len(more)
            if cut >= 0:
                break
        if self.options.get("count", "false") == "true":
            n = data.count(b"\n") + (data[-1:] != b"\n" and bool(data))
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([lo], pa.int64()), pa.array([n], pa.int64()), pa.array([None], pa.string())], ["path", "offset", "k", "line"])
            return
        lines = data[:-1].split(b"\n") if data[-1:] == b"\n" else data.split(b"\n") if data else []
        for k in range(0, len(lines), 10_000):
            part = [x.decode(errors="ignore") for x in lines[k : k + 10_000]]
            n = len(part)
            yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([lo] * n, pa.int64()), pa.array(range(k, k + n), pa.int64()), pa.array(part, pa.string())], ["path", "offset", "k", "line"])


class LineRanges(_Source):
    """With the option count, one row a range instead, k being the number of its lines."""

    kind, columns = _LinesReader, "path string, offset long, k long, line string"

    @classmethod
    def name(cls) -> str:
        return "line_ranges"


class Header:
    """Bytes of a file by place, read in small blocks; `read` counts them."""

    def __init__(self, handle: pa.NativeFile, length: int, block: int = 512):
        self.handle, self.length, self.block = handle, length, block
        self.at, self.held, self.read = 0, b"", 0

    def get(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.at, self.held = at, self.handle.read_at(max(0, min(max(n, self.block), self.length - at)), at) if at < self.length else b""
            self.read += len(self.held)
        return self.held[at - self.at : at - self.at + n]


def header_size(h: Header) -> tuple[int, int] | None:
    """(height, width) of a PNG, GIF, JPEG or TIFF file; segments and directories on the way are stepped over."""
    head = h.get(0, 24)
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) == 24:
        w, height = struct.unpack(">II", head[16:])
        return height, w
    if head[:6] in (b"GIF87a", b"GIF89a") and len(head) >= 10:
        w, height = struct.unpack("<HH", head[6:10])
        return height, w
    if head[:4] in (b"II*\0", b"MM\0*") and len(head) >= 8:
        order = "<" if head[:1] == b"I" else ">"
        (at,) = struct.unpack(order + "I", head[4:8])
        count = h.get(at, 2)
        if len(count) < 2:
            return None
        found = {}
        for k in range(struct.unpack(order + "H", count)[0]):
            entry = h.get(at + 2 + 12 * k, 12)
            if len(entry) < 12:
                return None
            tag, kind = struct.unpack(order + "HH", entry[:4])
            if tag in (256, 257):
                found[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), entry[8 : 10 if kind == 3 else 12])[0]
            if tag >= 257:  # a directory's entries are in order
                break
        return (found[257], found[256]) if len(found) == 2 else None
    if head[:2] != b"\xff\xd8":
        return None
    at = 2
    while len(mark := h.get(at, 9)) == 9 and mark[0] == 0xFF:
        if mark[1] == 0xFF:
            at += 1
        elif 0xC0 <= mark[1] <= 0xCF and mark[1] not in (0xC4, 0xC8, 0xCC):
            height, w = struct.unpack(">HH", mark[5:])
            return height, w
        else:
            at += 2 + struct.unpack(">H", mark[2:4])[0]
    return None


class _SizesReader(_Reader):
    def rows(self, path, handle, length, lo, hi):
        header = Header(handle, length)
        h, w = header_size(header) or (None, None)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([length]), pa.array([h], pa.int32()), pa.array([w], pa.int32()), pa.array([header.read])], ["path", "length", "h", "w", "bytes_read"])


class ImageSizes(_Source):
    kind, columns = _SizesReader, "path string, length long, h int, w int, bytes_read long"

    @classmethod
    def name(cls) -> str:
        return "image_sizes"


def load(spark: SparkSession, source: type[DataSource], path: str, **options: object) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}).load(path)


def image_sizes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, h, w, bytes_read) of image files; h and w are null where a file is none."""
    return load(spark, ImageSizes, path, glob=glob, head=1)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over a file's ranges in order: its digest."""
    state = None
    for b in batches:
        out = []
        for path, length, at, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            state = hashlib.sha256() if at == 0 else state
            state.update(data)
            if at + len(data) >= length:
                out.append((path, length, state.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out]) for k in range(3)], ["path", "length", "sha256"])


def digests(spark: SparkSession, path: str, glob: str = "*", chunk: int = CHUNK) -> DataFrame:
    """(path, length, sha256) of files of any size; a task holds a chunk at a time."""
    return load(spark, ByteRanges, path, glob=glob, chunk=chunk, whole=True).mapInArrow(_hashed, "path string, length long, sha256 string")


def numbered_lines(spark: SparkSession, path: str, glob: str = "*", chunk: int = CHUNK, recursive: bool = False) -> DataFrame:
    """(path, pos, line), pos from 0: the lines before a range are counted range by range, so a file is never one task's."""
    counts = load(spark, LineRanges, path, glob=glob, chunk=chunk, recursive=recursive, count=True)
    before = Window.partitionBy("path").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("path", "offset", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))
    lines = load(spark, LineRanges, path, glob=glob, chunk=chunk, recursive=recursive)
    few = counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # a row a range
    return lines.join(F.broadcast(base) if few else base, ["path", "offset"]).select("path", (F.col("base") + F.col("k")).alias("pos"), "line")


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)
