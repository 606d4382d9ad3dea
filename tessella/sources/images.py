"""Image tiles and masks: Spark's image source behind a struct of height, width, channels and RGB rows; sizes without decoding."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.operators.augment import resize
from tessella.operators.pairing import numeric_key
from tessella.sources import ranges


def _rgb(size: int | None, mode: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            data, shapes = [], []
            for r in pdf.itertuples():
                px = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                px = px[..., 2::-1] if r.nChannels >= 3 else px
                if size is not None:
                    px = np.clip(np.rint(resize(px, size, size, mode)), 0, 255)
                data.append(px.ravel().astype(np.int32))
                shapes.append(px.shape)
            yield pd.DataFrame({"n": pdf["n"], "path": pdf["path"], **{k: [s[i] for s in shapes] for i, k in enumerate("hwc")}, "data": data})

    return run


def read_tiles(spark: SparkSession, path: str, prefix: str, extension: str, size: int | None = None, mode: str = "nearest") -> DataFrame:
    """(n, path, h, w, c, data): files named prefix, digits, extension; data is flat RGB from 0 to 255, alpha dropped.

    Tiles keep their own resolution unless a size is given. The image source keeps pixels as BGR(A) bytes; they are turned around in Arrow batches.
    """
    raw = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", f"{prefix}*.{extension}").load(path).select("image.*")
    n = numeric_key(F.substring_index("origin", "/", -1), prefix, extension)
    raw = raw.select(n.alias("n"), F.col("origin").alias("path"), "height", "width", "nChannels", "data").where("n is not null")
    return raw.mapInPandas(_rgb(size, mode), "n long, path string, h int, w int, c int, data array<int>")


def calibration(spark: SparkSession, folder: str, samples: int, size: int, extensions: Sequence[str] = ("jpeg", "jpg", "png", "tif", "tiff")) -> DataFrame:
    """(n, path, h, w, data): the first `samples` images by path of folder/train, or of folder where that isn't there, scaled bicubically, in [0, 1], channels first.

    The names are listed and cut off before anything is decoded. No image is an error.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(folder, "train")
    if not base.getFileSystem(spark._jsc.hadoopConfiguration()).exists(base):
        base = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{','.join(extensions)}}}").load(base.toString()).select("path")
    names = [r.path for r in files.orderBy("path").limit(samples).collect()]
    if not names:
        raise FileNotFoundError(f"no calibration images under {base.toString()}")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")  # noqa: E731  the two sources write the same path in two ways
    order = F.array_position(F.array(*[plain(F.lit(n)) for n in names]), plain(F.col("path")))
    raw = spark.read.format("image").option("dropInvalid", True).load(names).select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                px = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                px = px[..., 2::-1] if r.nChannels >= 3 else np.repeat(px[..., :1], 3, axis=2)
                out.append(resize(px.astype(np.float32) / 255, size, size, "bicubic").transpose(2, 0, 1).ravel())
            yield pd.DataFrame({"n": pdf["n"], "path": pdf["path"], "h": size, "w": size, "data": out})

    return raw.withColumn("n", order).mapInPandas(run, "n long, path string, h int, w int, data array<float>")


def luma(pixels: np.ndarray) -> np.ndarray:
    """One grey value from 0 to 255 a pixel (ITU-R 601 weights) of (pixels, channels)."""
    if pixels.shape[1] == 1:
        return pixels[:, 0]
    return np.floor(pixels[:, :3] @ np.array([0.299, 0.587, 0.114]) + 0.5).astype(np.int32)


def _masks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        grey = [luma(np.asarray(d).reshape(-1, c)) for d, c in zip(pdf["data"], pdf["c"], strict=True)]
        yield pdf[["n", "path", "h", "w"]].assign(data=[np.where(g / 255.0 >= 0.5, 1.0, 0.0) for g in grey])


def masks(tiles: DataFrame) -> DataFrame:
    """Tiles with one 0/1 value a pixel: grey / 255 >= 0.5."""
    return tiles.select("n", "path", "h", "w", "c", "data").mapInPandas(_masks, "n long, path string, h int, w int, data array<double>")


def image_size(head: bytes) -> tuple[int, int] | None:
    """(height, width) from the first bytes of a PNG, GIF, JPEG or TIFF file."""
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        w, h = struct.unpack(">II", head[16:24])
        return h, w
    if head[:6] in (b"GIF87a", b"GIF89a") and len(head) >= 10:
        w, h = struct.unpack("<HH", head[6:10])
        return h, w
    if head[:4] in (b"II*\0", b"MM\0*") and len(head) >= 8:
        return _tiff_size(head, "<" if head[:1] == b"I" else ">")
    at = 2
    while head[:2] == b"\xff\xd8" and at + 9 <= len(head):
        if head[at] != 0xFF:
            return None
        kind = head[at + 1]
        if kind == 0xFF:
            at += 1
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", head[at + 5 : at + 9])
            return h, w
        else:
            at += 2 + struct.unpack(">H", head[at + 2 : at + 4])[0]
    return None


def _tiff_size(head: bytes, order: str) -> tuple[int, int] | None:
    """From the first directory, where that lies in the bytes given; tags 256 and 257 are width and height, of 2 or 4 bytes."""
    (at,) = struct.unpack_from(order + "I", head, 4)
    if at + 2 > len(head):
        return None
    found = {}
    for k in range(struct.unpack_from(order + "H", head, at)[0]):
        if at + 14 + 12 * k > len(head):
            break
        tag, kind = struct.unpack_from(order + "HH", head, at + 2 + 12 * k)
        found[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), head, at + 10 + 12 * k)[0]
    return (found[257], found[256]) if {256, 257} <= found.keys() else None


def _sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [image_size(h) or (None, None) for h in pdf["head"]]
        yield pd.DataFrame({"path": pdf["path"], "h": pd.array([h for h, _ in found], "Int32"), "w": pd.array([w for _, w in found], "Int32")})


def read_sizes(spark: SparkSession, path: str, glob: str = "*", head: int = 1 << 16) -> DataFrame:
    """(path, h, w) of image files, from their headers alone.

    Where pyarrow has no file system for the path, Spark's whole-file source reads them, of which the first `head` bytes go to Python.
    """
    if ranges.reachable(path):
        return ranges.image_sizes(spark, path, glob).select("path", "h", "w")
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.expr(f"substring(content, 1, {head})").alias("head")).mapInPandas(_sizes, "path string, h int, w int")


def gif_indices(raw: bytes) -> tuple[int, int, bytes]:
    """(height, width, colour-table index of each pixel) of a GIF file's first frame.

    The image source gives colours, where an index other than zero may be black; masks that mean indices need this.
    """
    w, h, flags = struct.unpack("<HHB", raw[6:11])
    at = 13 + (3 * (2 << (flags & 7)) if flags & 0x80 else 0)
    canvas = bytearray(w * h)
    while raw[at] != 0x3B:
        if raw[at] == 0x21:  # an extension
            at += 2
            while raw[at]:
                at += raw[at] + 1
            at += 1
            continue
        left, top, fw, fh, local = struct.unpack("<HHHHB", raw[at + 1 : at + 10])
        at += 10 + (3 * (2 << (local & 7)) if local & 0x80 else 0)
        least, at, data = raw[at], at + 1, bytearray()
        while raw[at]:
            data += raw[at + 1 : at + 1 + raw[at]]
            at += raw[at] + 1
        pixels = _lzw(bytes(data), least, fw * fh)
        rows = [*range(0, fh, 8), *range(4, fh, 8), *range(2, fh, 4), *range(1, fh, 2)] if local & 0x40 else range(fh)
        for k, y in enumerate(rows):
            canvas[(top + y) * w + left : (top + y) * w + left + fw] = pixels[k * fw : (k + 1) * fw]
        break
    return h, w, bytes(canvas)


def _lzw(data: bytes, least: int, want: int) -> bytes:
    """Decodes GIF's variable-width codes."""
    clear, stop = 1 << least, (1 << least) + 1
    bits, held, at, width = 0, 0, 0, least + 1
    words: list[bytes] = []
    out, before = bytearray(), b""
    while len(out) < want:
        while held < width:
            if at == len(data):
                return bytes(out.ljust(want, b"\0"))
            bits |= data[at] << held
            held, at = held + 8, at + 1
        code, bits, held = bits & ((1 << width) - 1), bits >> width, held - width
        if code == clear:
            words, width, before = [bytes([i]) for i in range(clear)] + [b"", b""], least + 1, b""
            continue
        if code == stop:
            break
        word = words[code] if code < len(words) else before + before[:1]
        if before and len(words) < 4096:
            words.append(before + word[:1])
            if len(words) == 1 << width and width < 12:
                width += 1
        out += word
        before = word
    return bytes(out[:want].ljust(want, b"\0"))


def _palette(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [gif_indices(raw) for raw in pdf["content"]]
        yield pd.DataFrame({"path": pdf["path"], "h": [f[0] for f in found], "w": [f[1] for f in found], "data": [[255 if x else 0 for x in f[2]] for f in found]})


def read_palette_masks(spark: SparkSession, path: str, glob: str = "*.gif") -> DataFrame:
    """(path, h, w, data): 255 where a GIF's colour index isn't zero."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInPandas(_palette, "path string, h int, w int, data array<int>")
