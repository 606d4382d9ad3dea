"""Files by ranges and the pair sink."""

import hashlib
import os
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessella.sources import images, logs, pairs, ranges


def png(h, w, noise):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", noise) + chunk(b"IEND", b"")


def jpeg(h, w, noise):
    segment = lambda kind, data: bytes([0xFF, kind]) + struct.pack(">H", len(data) + 2) + data
    return b"\xff\xd8" + segment(0xE1, os.urandom(60_000)) + segment(0xE2, b"\xff\xc0" * 20_000) + b"\xff" + segment(0xC0, struct.pack(">BHHB", 8, h, w, 3) + b"\0" * 9) + segment(0xDA, b"") + noise


def tiff(h, w, noise, order="<"):
    at = 8 + len(noise)
    entries = [(254, 4, 0), (256, 4, w), (257, 3, h), (258, 3, 8)]
    pack = lambda tag, kind, v: struct.pack(order + "HHI", tag, kind, 1) + (struct.pack(order + "HH", v, 0) if kind == 3 else struct.pack(order + "I", v))
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", at) + noise + struct.pack(order + "H", len(entries)) + b"".join(pack(*e) for e in entries)


def test_sizes_read_a_small_part(spark, tmp_path):
    noise, want = os.urandom(1 << 20), {}
    for k, make in enumerate((png, jpeg, tiff, lambda h, w, n: tiff(h, w, n, ">"), lambda h, w, n: b"GIF89a" + struct.pack("<HH", w, h) + n)):
        name, h, w = f"im{k}.dat", 300 + k, 20 + 7 * k
        (tmp_path / name).write_bytes(make(h, w, noise))
        want[name] = (h, w)
    for name, raw in (("text.dat", b"no image at all"), ("empty.dat", b""), ("cut.dat", b"\xff\xd8\xff"), ("_hidden.dat", b"GIF89a")):
        (tmp_path / name).write_bytes(raw)
        want |= {} if name[0] == "_" else {name: (None, None)}
    (tmp_path / "other.txt").write_bytes(b"x")
    rows = ranges.image_sizes(spark, str(tmp_path), "*.dat").collect()
    assert {os.path.basename(r.path): (r.h, r.w) for r in rows} == want
    assert sum(r.bytes_read for r in rows) < 0.01 * sum(r.length for r in rows)
    assert {os.path.basename(r.path): (r.h, r.w) for r in images.read_sizes(spark, f"file:{tmp_path}", "im*").collect()} == {k: v for k, v in want.items() if k[:2] == "im"}


def test_digests_by_chunks(spark, tmp_path):
    rnd, want = random.Random(1), {}
    for k, n in enumerate([0, 1, 999, 1000, 1001, 70_000]):
        raw = rnd.randbytes(n)
        (tmp_path / f"f{k}").write_bytes(raw)
        want[f"f{k}"] = (n, hashlib.sha256(raw).hexdigest())
    rows = ranges.digests(spark, str(tmp_path), chunk=1000).collect()
    assert {os.path.basename(r.path): (r.length, r.sha256) for r in rows} == want


def test_files_beyond_two_gigabytes(spark, tmp_path):
    """A sparse file: nothing but zeros, and an end of its own."""
    size = (2 << 30) + 12345
    with open(tmp_path / "large", "wb") as f:
        f.truncate(size)
        f.seek(size - 3)
        f.write(b"end")
    state, block, left = hashlib.sha256(), bytes(1 << 24), size - 3
    while left:
        state.update(block[: min(left, len(block))])
        left -= min(left, len(block))
    state.update(b"end")
    row = ranges.digests(spark, str(tmp_path)).collect()[0]
    assert (row.length, row.sha256) == (size, state.hexdigest())


def test_ranges_cover_files_once(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"f{k}").write_bytes(bytes([k]) * (k * 37))
    rows = ranges.load(spark, ranges.ByteRanges, str(tmp_path), chunk=10, task_bytes=25).collect()
    for k in range(5):
        own = sorted((r.offset, r.data) for r in rows if r.path.endswith(f"f{k}"))
        assert b"".join(d for _, d in own) == bytes([k]) * (k * 37) and all(len(d) <= 10 for _, d in own)
    heads = ranges.load(spark, ranges.ByteRanges, str(tmp_path), head=3).collect()
    assert sorted(len(r.data) for r in heads) == [0, 3, 3, 3, 3]
    with pytest.raises(Exception, match="FileNotFound"):
        ranges.load(spark, ranges.ByteRanges, f"{tmp_path}/none").collect()


@pytest.mark.parametrize("parts", [1, 64])
def test_lines_have_the_same_numbers_whatever_the_ranges(spark, tmp_path, parts):
    rnd, want = random.Random(3), []
    for name, end in (("a.log", "\n"), ("b.log", ""), ("c.log", "\n\n\n")):
        lines = ["x" * rnd.choice([0, 0, 1, 5, 40, 700]) + f"é{k}" * rnd.randrange(2) for k in range(300)]
        raw = ("\n".join(lines) + end).encode()
        (tmp_path / name).write_bytes(raw)
        want += [(name, k, x) for k, x in enumerate(raw.decode().removesuffix("\n").split("\n"))]
    (tmp_path / "empty.log").write_bytes(b"")
    size = max(os.path.getsize(tmp_path / n) for n in os.listdir(tmp_path))
    rows = logs.read_lines(spark, str(tmp_path)).collect() if parts == 1 else ranges.numbered_lines(spark, str(tmp_path), chunk=size // parts).collect()
    assert sorted((os.path.basename(r[0]), r.pos, r.line) for r in rows) == sorted(want)


@pytest.mark.parametrize("shape", [(1, 1), (8, 8), (40, 33), (150, 90)])
def test_gifs_are_read_back(shape):
    rng = np.random.default_rng(shape)
    for values in (np.zeros(shape, np.uint8), rng.integers(0, 256, shape).astype(np.uint8), rng.integers(0, 2, shape).astype(np.uint8) * 255, np.tile(np.arange(shape[1]) % 7, (shape[0], 1)).astype(np.uint8)):
        h, w, data = images.gif_indices(pairs.grey_gif(values))
        assert (h, w) == shape and data == values.tobytes()


def test_gifs_are_read_by_another_decoder(spark, tmp_path):
    rng = np.random.default_rng(5)
    for k in range(4):
        (tmp_path / f"mask{k}.gif").write_bytes(pairs.grey_gif(pairs.binary_mask(rng.integers(0, 2, (70, 90, 1)), 70, 90)))
    for r in images.read_tiles(spark, str(tmp_path), "mask", "gif").collect():
        data = np.array(r.data).reshape(70, 90, -1)[..., 0]
        assert data.ravel().tolist() == list(images.gif_indices((tmp_path / f"mask{r.n}.gif").read_bytes())[2])


def pair_rows(n):
    return [(k, "jpeg", bytes([k] * k), 2, 3, [float(k % 2 and j % 2) for j in range(6)]) for k in range(1, n + 1)]


PAIRS = "n long, extension string, image binary, h int, w int, mask array<double>"


def test_pairs_as_files(spark, tmp_path):
    df = spark.createDataFrame(pair_rows(20), PAIRS).repartition(4)
    pairs.write_pair_files(df, str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == ["mask", "train"]
    assert set(os.listdir(tmp_path / "train")) == {f"train{k}.jpeg" for k in range(1, 21)}
    for n, _, image, h, w, mask in pair_rows(20):
        assert (tmp_path / "train" / f"train{n}.jpeg").read_bytes() == image
    got = {r.path.rsplit("/mask", 1)[1]: (r.h, r.w, list(r.data)) for r in images.read_palette_masks(spark, str(tmp_path / "mask")).collect()}
    assert got == {f"{n}.gif": (h, w, [255 if x else 0 for x in mask]) for n, _, _, h, w, mask in pair_rows(20)}
    pairs.write_pair_files(df.where("n <= 3"), str(tmp_path), "overwrite")
    assert len(os.listdir(tmp_path / "train")) == len(os.listdir(tmp_path / "mask")) == 3


def test_failed_attempts_leave_nothing(spark, tmp_path):
    columns = ["n", "extension", "image", "h", "w", "mask"]
    rows = pair_rows(6)
    batch = lambda part: pa.RecordBatch.from_pylist([dict(zip(columns, r)) for r in part])

    def failing():
        yield batch(rows[:3])
        raise OSError("lost")

    w = pairs.PairWriter(str(tmp_path), False)
    with pytest.raises(OSError, match="lost"):
        w.write(failing())
    first, second = w.write(iter([batch(rows[:3])])), w.write(iter([batch(rows[3:])]))
    w.write(iter([batch(rows[:3])]))  # a speculative copy, which Spark doesn't accept
    assert not (tmp_path / "train").exists()
    w.commit([first, second, None])
    assert sorted(os.listdir(tmp_path)) == ["mask", "train"] and len(os.listdir(tmp_path / "train")) == 6
    bad = spark.createDataFrame([(1, "jpeg", b"", 2, 2, [1.0])], PAIRS)  # a mask of the wrong size
    with pytest.raises(Exception, match="reshape"):
        pairs.write_pair_files(bad, str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == ["mask", "train"] and len(os.listdir(tmp_path / "mask")) == 6


def test_datasets_are_built(spark, tmp_path):
    """Keys that are no numbers, masks of colour indices, an image without a mask."""
    for folder in ("train", "mask"):
        os.makedirs(tmp_path / "src" / folder)
    left = np.zeros((20, 20), np.uint8)
    want = {}
    for n, (key, index, extension) in enumerate([("_1000_19644_SKY162.15", 5, "jpeg"), ("_42_7_SKY99.7", 9, "JPG")], 1):
        left[:, :10] = index
        want[n] = os.urandom(100)
        (tmp_path / "src" / "train" / f"train{key}.{extension}").write_bytes(want[n])
        (tmp_path / "src" / "mask" / f"mask{key}.gif").write_bytes(pairs.grey_gif(left))
    (tmp_path / "src" / "train" / "train_alone.jpeg").write_bytes(b"x")
    assert pairs.build_dataset(spark, str(tmp_path / "src"), str(tmp_path / "dst")) == 2
    assert {n: (tmp_path / "dst" / "train" / f"train{n}.jpeg").read_bytes() for n in (1, 2)} == want
    for r in images.read_palette_masks(spark, str(tmp_path / "dst" / "mask")).collect():
        assert np.array_equal(np.array(r.data).reshape(20, 20) > 0, left > 0)
    os.remove(tmp_path / "src" / "mask" / "mask_42_7_SKY99.7.gif")
    os.remove(tmp_path / "src" / "mask" / "mask_1000_19644_SKY162.15.gif")
    (tmp_path / "src" / "mask" / "mask_other.gif").write_bytes(pairs.grey_gif(left))
    with pytest.raises(ValueError, match="pairs"):
        pairs.build_dataset(spark, str(tmp_path / "src"), str(tmp_path / "none"))


def test_annotated_datasets_are_built(spark, tmp_path):
    import json

    os.makedirs(tmp_path / "images")
    names = {k: f"im{k}.tif" for k in range(1, 7)}
    doc = {
        "images": [{"id": k, "file_name": f, "width": 20, "height": 20} for k, f in names.items()],
        "annotations": [{"id": k, "image_id": k, "segmentation": [[2, 2, 15, 2, 2, 15]]} for k in range(1, 6)],
    }
    (tmp_path / "doc.json").write_text(json.dumps(doc))
    for k in (1, 3, 5, 6):  # two that are annotated were never shipped
        (tmp_path / "images" / names[k]).write_bytes(bytes([k]) * 50)
    args = (spark, str(tmp_path / "doc.json"), str(tmp_path / "images"))
    for target in ("a", "b"):
        assert pairs.coco_dataset(*args, str(tmp_path / target), limit=3, seed=1) == 3
    assert {(tmp_path / "a" / "train" / f"train{n}.tif").read_bytes()[0] for n in (1, 2, 3)} == {1, 3, 5}
    for n in (1, 2, 3):
        mask = (tmp_path / "a" / "mask" / f"mask{n}.gif").read_bytes()
        assert mask == (tmp_path / "b" / "mask" / f"mask{n}.gif").read_bytes() and any(images.gif_indices(mask)[2])
    with pytest.raises(ValueError, match="images on disk"):
        pairs.coco_dataset(*args, str(tmp_path / "c"), limit=4, seed=1)
