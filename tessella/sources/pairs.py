"""Image pairs as files: a data source writer with a commit in two steps.

Each task writes its files into a folder of its own attempt below `_staging`. Only when all tasks are done, the driver moves the files of the attempts that Spark has accepted to `train/train{n}.{extension}` and
`mask/mask{n}.gif` and deletes the rest; so a failed, repeated or speculative attempt leaves nothing and nothing twice. A job that fails deletes its staging folder. Images are written byte for byte; masks
as GIF of one grey value a pixel (255 where the value is above zero, any channel of it), by LZW with growing codes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tessella.operators.pairing import guarded, numbered, string_key
from tessella.sources.coco import pairs as coco_pairs, read_coco
from tessella.sources.images import gif_indices
from tessella.sources.ranges import opened

# Fixed values of the GIF format.
HEADER, TRAILER, IMAGE, LARGEST = b"GIF87a", b"\x3b", b"\x2c", 1 << 12


def lzw(pixels: bytes, least: int = 8) -> bytes:
    """GIF's codes for pixels: strings seen before by number, numbers as wide as the largest needs, from the start again when 4,096 are used."""
    clear, stop = 1 << least, (1 << least) + 1
    known: dict[tuple[int, int], int] = {}
    held = width = bits = 0
    out = bytearray()

    def put(code: int) -> None:
        nonlocal held, bits
        held |= code << bits
        bits += width
        while bits >= 8:
            out.append(held & 255)
            held >>= 8
            bits -= 8

    width, free = least + 1, stop + 1
    put(clear)
    before = -1
    for p in pixels:
        if before < 0:
            before = p
        elif (longer := known.get((before, p))) is not None:
            before = longer
        else:
            put(before)
            if free < LARGEST:
                known[before, p] = free
                if free == 1 << width:
                    width += 1
                free += 1
            else:
                put(clear)
                known, width, free = {}, least + 1, stop + 1
            before = p
    if before >= 0:
        put(before)
        if free == 1 << width and width < 12:  # the reader adds an entry for this code too
            width += 1
    put(stop)
    if bits:
        out.append(held & 255)
    return bytes(out)


def grey_gif(values: np.ndarray) -> bytes:
    """A GIF of one frame with a palette of 256 greys; values: (height, width) of 0 to 255."""
    h, w = values.shape
    screen = w.to_bytes(2, "little") + h.to_bytes(2, "little")
    palette = bytes(g for v in range(256) for g in (v, v, v))
    code = lzw(np.ascontiguousarray(values, np.uint8).tobytes())
    blocks = b"".join(bytes([len(code[k : k + 255])]) + code[k : k + 255] for k in range(0, len(code), 255))
    return HEADER + screen + b"\xf7\0\0" + palette + IMAGE + bytes(4) + screen + b"\0\x08" + blocks + b"\0" + TRAILER


def binary_mask(data: np.ndarray, h: int, w: int) -> np.ndarray:
    """(h, w) of 0 and 255; data: h * w values, or several channels of a pixel after one another."""
    x = np.asarray(data).reshape(h, w, -1)
    return np.where((x > 0).any(axis=2), 255, 0).astype(np.uint8)


@dataclass
class Attempt(WriterCommitMessage):
    """The files of one attempt: (name in staging, name below the target)."""

    files: list[tuple[str, str]]


class PairWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.staging = f"_staging/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        system, root, _ = opened(self.path)
        own = f"{self.staging}/{uuid.uuid4().hex}"
        system.create_dir(f"{root}/{own}", recursive=True)
        files = []

        def put(name: str, target: str, data: bytes) -> None:
            with system.open_output_stream(f"{root}/{own}/{name}") as f:
                f.write(data)
            files.append((f"{own}/{name}", target))

        for b in iterator:
            for r in b.select(["n", "extension", "image", "h", "w", "mask"]).to_pylist():
                image, mask = f"train{r['n']}.{r['extension']}", f"mask{r['n']}.gif"
                put(image, f"train/{image}", r["image"])
                put(mask, f"mask/{mask}", grey_gif(binary_mask(r["mask"], r["h"], r["w"])))
        return Attempt(files)

    def commit(self, messages: list[Attempt | None]) -> None:
        system, root, _ = opened(self.path)
        for folder in ("train", "mask"):
            if self.overwrite and system.get_file_info(f"{root}/{folder}").type != fs.FileType.NotFound:
                system.delete_dir(f"{root}/{folder}")
            system.create_dir(f"{root}/{folder}", recursive=True)
        moves = [f for m in messages if m is not None for f in m.files]
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda f: system.move(f"{root}/{f[0]}", f"{root}/{f[1]}"), moves))
        self.abort(messages)

    def abort(self, messages: list[Attempt | None]) -> None:
        system, root, _ = opened(self.path)
        if system.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.staging}")
        top = f"{root}/_staging"
        if system.get_file_info(top).type != fs.FileType.NotFound and not system.get_file_info(fs.FileSelector(top)):
            system.delete_dir(top)


class ImagePairs(DataSource):
    """Option path; rows: (n, extension, image, h, w, mask array of h * w values, or of some channels a pixel)."""

    @classmethod
    def name(cls) -> str:
        return "image_pairs"

    def writer(self, schema, overwrite: bool) -> PairWriter:
        return PairWriter(self.options["path"], overwrite)


def write_pair_files(pairs: DataFrame, path: str, mode: str = "append") -> None:
    """pairs: (n, extension, image binary, h, w, mask); other columns are ignored."""
    pairs.sparkSession.dataSource.register(ImagePairs)
    pairs.select("n", "extension", "image", "h", "w", "mask").write.format("image_pairs").mode(mode).option("path", path).save()


def _contents(spark: SparkSession, path: str, prefix: str, extensions: Sequence[str]) -> DataFrame:
    """(key, name, extension, content) of the files prefix, key, one of the extensions (any case); of equal keys, the last name."""
    files = spark.read.format("binaryFile").load(path)
    name = F.substring_index("path", "/", -1)
    keys = files.select(string_key(name, prefix, extensions).alias("key"), name.alias("name"), "path").where("key is not null")
    last = keys.groupBy("key").agg(F.max_by("path", "name").alias("path"), F.max("name").alias("name"))
    return files.select("path", "content").join(last, "path").select("key", "name", F.lower(F.substring_index("name", ".", -1)).alias("extension"), "content")


def _first_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [gif_indices(raw) for raw in b.column(1).to_pylist()]
        masks = pa.array([np.frombuffer(f[2], np.uint8).astype(np.int32) for f in found], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()), masks], ["key", "h", "w", "mask"])


def build_dataset(spark: SparkSession, source: str, target: str, mode: str = "append") -> int:
    """Files source/train/train{key}.jpeg and source/mask/mask{key}.gif to numbered pairs under target; gives their number. Images go byte for byte; a mask's pixels are set where its colour index isn't zero."""
    images = _contents(spark, f"{source}/train", "train", ["jpeg", "jpg"])
    masks = _contents(spark, f"{source}/mask", "mask", ["gif"])
    keys = guarded(images.select("key").join(masks.select("key"), "key"), 1, "pairs")
    keys = numbered(keys, [F.col("key")], "n").select("n", "key")
    frames = masks.select("key", "content").mapInArrow(_first_frames, "key string, h int, w int, mask array<int>")
    rows = keys.join(images.select("key", F.col("content").alias("image")), "key").join(frames, "key").withColumn("extension", F.lit("jpeg"))
    write_pair_files(rows, target, mode)
    return keys.count()


def coco_dataset(spark: SparkSession, document: str, folder: str, target: str, limit: int | None = None, seed: int = 0, allow_empty: bool = False, mode: str = "append") -> int:
    """The images of an annotation document that are in the folder, `limit` of them by a seeded digest, and the masks of their polygons, as numbered pairs under target; gives their number.

    Images keep their bytes and their extension.
    """
    files = spark.read.format("binaryFile").load(folder).select(F.substring_index("path", "/", -1).alias("file_name"), F.col("content").alias("image"))
    rows = coco_pairs(read_coco(spark, document, allow_empty), files, limit, seed, "outline")
    rows = rows.withColumn("extension", F.lower(F.substring_index("file_name", ".", -1)))
    write_pair_files(rows, target, mode)
    return rows.count()
