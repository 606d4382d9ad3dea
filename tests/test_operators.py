import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import config
from tessella.functions import text, tiles
from tessella.operators import augment, contract, harness, history, metrics, pairing, rasterize, reports, scoring, tiling
from tessella.sources import coco, images, logs, scalars, sinks


def test_metric_toy(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "p int, t int")
    r = metrics.prf(df.agg(*metrics.counts("p", "t"))).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall) == (1, 1, 0, 0.5, 1.0) and abs(r.f1 - 2 / 3) < 1e-12 and r.iou == 0.5
    none = metrics.prf(df.where("p > 5").agg(*metrics.counts("p", "t"))).first()
    assert (none.tp, none.precision, none.f1) == (0, 0.0, 0.0)


def test_threshold_of_nothing(spark):
    df = spark.createDataFrame([(0.5,), (0.4999,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in df.select(metrics.hit(F.col("x"))).collect()] == [1, 0, 0, 0]


def test_latency_toy(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 11)] + [("b", 3.0)], "k string, v double")
    a, b = metrics.latency_stats(df, ["k"], "v").orderBy("k").collect()
    assert (a.runs, a.min_ms, a.mean_ms, a.median_ms) == (10, 1.0, 5.5, 5.5) and abs(a.p90_ms - 9.1) < 1e-9
    assert (b.median_ms, b.p90_ms) == (3.0, 3.0)


@pytest.mark.parametrize(("dim", "starts"), [(1024, [0, 512]), (512, [0]), (400, [0]), (1000, [0, 488]), (1025, [0, 512, 513])])
def test_tile_starts(spark, dim, starts):
    assert spark.range(1).select(tiles.tile_starts(F.lit(dim), 512).alias("s")).first().s == starts


def test_pixels_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.random((6, 8))
    df = spark.createDataFrame([(x.ravel().tolist(),)], "x array<double>")
    one = lambda c: np.array(df.select(c.alias("y")).first().y)
    px = F.col("x")
    assert (one(tiles.flip_horizontal(px, 6, 8)) == x[:, ::-1].ravel()).all()
    assert (one(tiles.flip_vertical(px, 6, 8)) == x[::-1].ravel()).all()
    assert (one(tiles.transpose(px, 6, 8)) == x.T.ravel()).all()
    assert (one(tiles.channels_first(px, 6, 4, 2)) == x.reshape(6, 4, 2).transpose(2, 0, 1).ravel()).all()
    assert (one(tiles.crop(px, 6, 8, F.lit(3), F.lit(5), 4)) == x[3:7, 5:9].ravel()).all()
    assert np.allclose(one(tiles.resize_nearest(px, 6, 8, 3, 5)), augment.resize(x[..., None], 3, 5, "nearest").ravel())


def test_width_ladder(spark):
    df = spark.createDataFrame([(64, 0.3), (64, 0.0625), (40, 0.5)], "b int, m double")
    assert [r[0] for r in df.select(tiles.scale_width(F.col("b"), F.col("m"))).collect()] == [16, 8, 16]


def test_names_and_flags(spark):
    df = spark.createDataFrame([("train12.jpeg",), ("train01.jpeg",), ("trainx.jpeg",), ("atrain1.jpeg",), ("train1.jpg",)], "f string")
    assert [r[0] for r in df.select(pairing.numeric_key(F.col("f"), "train", "jpeg")).collect()] == [12, 1, None, None, None]
    assert [r[0] for r in df.select(pairing.string_key(F.col("f"), "train", ["JPEG", "jpg"])).collect()] == ["12", "01", "x", None, "1"]
    row = spark.range(1).select(text.truthy(F.lit(" Yes ")), text.truthy(F.lit(None).cast("string")), text.none_or(F.lit("NONE")), text.fixed4(F.lit(None).cast("double")), text.fixed4(F.lit(0.25)), text.without_time(F.lit("m_2024-01-02_7")), text.label_of(F.lit("a/b.onnx"))).first()
    assert tuple(row) == (True, False, None, "—", "0.2500", "m", "b.onnx")


def test_splits(spark):
    assert pairing.split_exact(list(range(1, 11)), 0.2, 1)[1] == [7, 9]
    df = spark.range(10).withColumnRenamed("id", "n")
    out = pairing.split_by_hash(df, "n", 0.2, 3)
    assert out.where("split = 'val'").count() == 2 and out.count() == 10
    assert {r.n for r in out.where("split = 'val'").collect()} == {r.n for r in pairing.split_by_hash(df.repartition(7), "n", 0.2, 3).where("split = 'val'").collect()}
    assert pairing.split_by_hash(df.limit(1), "n", 0.2, 3).first().split == "val"
    with pytest.raises(ValueError, match="images: 10 of 11"):
        pairing.guarded(df, 11, "images")


def test_numbering_over_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 37 % 5000).alias("x")).repartition(9)
    assert all(r.n == r.x + 1 for r in pairing.numbered(df, [F.col("x")], "n").collect())


def _plain_plateau(losses, patience=2):
    best, bad, lr, out = float("inf"), 0, 1e-3, []
    for x in losses:
        if x < best * (1 - 1e-4):
            best, bad = x, 0
        else:
            bad += 1
        if bad > patience:
            lr, bad = (lr * 0.1 if lr - lr * 0.1 > 1e-8 else lr), 0
        out.append(lr)
    return out


def test_histories_against_plain_loops(spark):
    rng = random.Random(4)
    runs = {f"r{k}": [round(rng.random(), 2) for _ in range(rng.randrange(1, 25))] for k in range(20)}
    df = spark.createDataFrame([(k, e, x) for k, v in runs.items() for e, x in enumerate(v, 1)], "run string, epoch long, loss double")
    rates, stops, best = {}, {}, {r.run: r.epoch for r in history.best_epoch(df, ["run"], "loss").collect()}
    for r in history.plateau(df, ["run"], "loss").orderBy("epoch").collect():
        rates.setdefault(r.run, []).append(r.lr)
    for r in history.early_stop(df, ["run"], "loss", 3).collect():
        stops[r.run] = max(stops.get(r.run, 0), r.epoch)
    for k, v in runs.items():
        assert np.allclose(rates[k], _plain_plateau(v))
        assert best[k] == v.index(max(v)) + 1
        low, since, end = float("inf"), 0, len(v)
        for e, x in enumerate(v, 1):
            since = 0 if x < low else since + 1
            low = min(low, x)
            if since >= 3:
                end = e
                break
        assert stops[k] == end


LOG = """starting
[stage1] go
8/8 - 3s - loss: 0.5 - Precision: 0.1 - Recall: 0.2 - F1Score: 0.3 - val_loss: 0.6 - val_Precision: 0.4 - val_Recall: 0.5 - val_F1Score: 0.61 - lr: 1e-04
val_F1Score: broken
8/8 - 3s - loss: 0.4 - Precision: 0.1 - Recall: 0.2 - F1Score: 0.3 - val_loss: 0.5 - val_Precision: 0.4 - val_Recall: 0.5 - val_F1Score: 0.62
[stage2]
8/8 - 3s - loss: 0.3 - Precision: 0.1 - Recall: 0.2 - F1Score: 0.3 - val_loss: 0.4 - val_Precision: 0.4 - val_Recall: 0.5 - val_F1Score: 0.63 - lr: 0.00001
Evaluation on Test:
     loss Precision    Recall
  F1Score
 0.2 0.7 0.8
 0.75
Evaluation on Other:
 loss Precision Recall F1Score
 9 9 9 9
"""


def test_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text(LOG)
    lines = logs.read_lines(spark, str(tmp_path))
    got = [(r.stage, r.epoch, r.loss, r.val_f1, r.lr) for r in logs.epochs(lines, ["run"], "pos").orderBy("stage", "epoch").collect()]
    assert got == [(1, 1, 0.5, 0.61, 1e-4), (1, 2, 0.4, 0.62, None), (2, 1, 0.3, 0.63, 1e-5)]
    assert tuple(logs.evaluation(lines, ["run"], "pos").first())[1:] == (0.2, 0.7, 0.8, 0.75)
    sinks.write_metrics_csv(logs.epochs(lines, ["run"], "pos"), f"{tmp_path}/csv")
    back = [p.read_text().splitlines() for p in (tmp_path / "csv").glob("*.csv")]
    assert back[0][0] == ",".join(sinks.METRIC_COLUMNS) and any(line.endswith(",0.62,") for part in back for line in part)


def test_coco(spark, tmp_path):
    doc = {
        "images": [{"id": 1, "file_name": "a.tiff", "width": 20, "height": 20}, {"id": 2, "file_name": "b.tiff", "width": 9, "height": 9}],
        "annotations": [{"id": 2, "image_id": 1, "segmentation": [[0, 0, 5, 0, 5, 5]]}, {"id": 1, "image_id": 1, "segmentation": [[1, 1, 2, 2], [0, 0, 9, 0, 9, 9, 0, 9]]}],
    }
    (tmp_path / "d.json").write_text(json.dumps(doc))
    got = {r.id: r.polygons for r in coco.read_coco(spark, f"{tmp_path}/d.json").collect()}
    assert got == {1: [[0.0, 0.0, 9.0, 0.0, 9.0, 9.0, 0.0, 9.0], [0.0, 0.0, 5.0, 0.0, 5.0, 5.0]], 2: []}
    assert coco.read_coco(spark, f"{tmp_path}/d.json", allow_empty=False).count() == 1
    doc["annotations"].append({"id": 3, "image_id": 2, "segmentation": {"counts": [1], "size": [9, 9]}})
    (tmp_path / "e.json").write_text(json.dumps(doc))
    with pytest.raises(Exception, match="annotation 3"):
        coco.read_coco(spark, f"{tmp_path}/e.json").collect()


def _png(pixels):
    h, w, _ = pixels.shape
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def _gif(indices, colours):
    """A GIF whose codes are never compressed: a clear code before the table would grow."""
    h, w = indices.shape
    bits, n, out = 0, 0, bytearray()
    for k, v in enumerate([x for i, p in enumerate(indices.ravel().tolist()) for x in ([256] if i % 100 == 0 else []) + [p]] + [257]):
        bits, n = bits | v << n, n + 9
        while n >= 8:
            out.append(bits & 255)
            bits, n = bits >> 8, n - 8
    out.append(bits & 255)
    blocks = b"".join(bytes([len(out[i : i + 255])]) + bytes(out[i : i + 255]) for i in range(0, len(out), 255))
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0xF7, 0, 0) + colours + b"," + struct.pack("<HHHHB", 0, 0, w, h, 0) + b"\x08" + blocks + b"\0;"


def test_images(spark, tmp_path):
    rng = np.random.default_rng(2)
    for n in (1, 10):
        (tmp_path / f"train{n}.png").write_bytes(_png(rng.integers(0, 256, (4 + n, 5, 3), dtype=np.uint8)))
    px = rng.integers(0, 256, (6, 7, 3), dtype=np.uint8)
    (tmp_path / "train2.png").write_bytes(_png(px))
    got = {r.n: r for r in images.read_tiles(spark, str(tmp_path), "train", "png").collect()}
    assert set(got) == {1, 2, 10} and (got[2].h, got[2].w, got[2].c) == (6, 7, 3) and got[2].data == px.ravel().tolist()
    mask = {r.n: r.data for r in images.masks(images.read_tiles(spark, str(tmp_path), "train", "png")).collect()}
    assert set(mask[2]) <= {0.0, 1.0} and len(mask[2]) == 42
    assert {(r.h, r.w) for r in images.read_sizes(spark, str(tmp_path), "*.png").collect()} == {(5, 5), (14, 5), (6, 7)}


def test_palette_masks(spark, tmp_path):
    idx = np.zeros((20, 30), int)
    idx[:, :15] = 5
    (tmp_path / "m.gif").write_bytes(_gif(idx, bytes(768)))  # every colour is black
    row = images.read_palette_masks(spark, str(tmp_path)).first()
    assert (row.h, row.w) == (20, 30) and row.data == (np.where(idx > 0, 255, 0)).ravel().tolist()
    assert images.image_size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x01\x02\x03\x04" + bytes(20)) == (258, 772)


def test_augmentation():
    rng = np.random.default_rng(3)
    image, mask = rng.random((16, 16, 3)).astype(np.float32), (rng.random((16, 16)) > 0.5).astype(np.float32)
    plan = augment.Plan(flip_p=1, rotate_p=0, brightness_p=0)
    i, m = augment.augmented(image, mask, plan, 3, 1)
    assert (i == image[::-1, ::-1]).all() and (m == mask[::-1, ::-1]).all()
    full = augment.Plan(flip_p=0.5, rotate_p=1, crop=(8, 12), brightness_p=1, hsv_p=1, seed=5)
    a, b, c = (augment.augmented(image, mask, full, 3, e) for e in (1, 1, 2))
    assert (a[0] == b[0]).all() and not (a[0] == c[0]).all()
    assert set(np.unique(a[1])) <= {0.0, 1.0} and a[0].shape == image.shape and 0 <= a[0].min() and a[0].max() <= 1
    assert np.allclose(augment.rotate(image, 0), image, atol=1e-6) and np.allclose(augment.shift_hsv(image, 0, 0, 0), image, atol=1e-5)
    assert np.allclose(augment.rotate(image, 90, 0), np.rot90(image, -1), atol=1e-6) or np.allclose(augment.rotate(image, 90, 0), np.rot90(image), atol=1e-6)
    flat = np.full((4, 5, 1), 0.3)
    assert all(np.allclose(augment.resize(flat, 7, 9, m), 0.3) for m in augment.MODES)
    assert np.allclose(augment.resize(image, 16, 16, "bicubic"), image, atol=1e-6)


def test_scoring(spark):
    pytest.importorskip("onnxruntime")
    rng = np.random.default_rng(4)
    x, k = rng.random((5, 6, 7)).astype(np.float32), rng.standard_normal((3, 3)).astype(np.float32)
    rows = [(i, 6, 7, 1, x[i].ravel().tolist()) for i in range(5)] + [(9, 2, 2, 1, [0.0, 1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "n long, h int, w int, c int, image array<float>")
    got = {r.n: np.array(r.prob) for r in scoring.score(df, scoring.small_model(k, 0.5), batch=2).collect()}
    pad = np.pad(x[2], 1)
    want = 1 / (1 + np.exp(-(sum(pad[a : a + 6, b : b + 7] * k[a, b] for a in range(3) for b in range(3)) + 0.5)))
    assert np.allclose(got[2], want.ravel(), atol=1e-5) and len(got[9]) == 4
    assert scoring.providers("A, B", "1") == ["A", "B"] and scoring.providers(None, "yes", ("CUDAExecutionProvider",)) == ["CPUExecutionProvider"]
    assert scoring.providers(None, None, ("CUDAExecutionProvider",))[0] == "CUDAExecutionProvider"

    class Full:
        def get_inputs(self):
            return [type("I", (), {"name": "x"})]

        def run(self, *_):
            raise RuntimeError("Failed to allocate: Out Of Memory")

    with pytest.raises(scoring.OutOfMemory):
        scoring.predict(Full(), np.zeros((1, 2, 2, 1), np.float32))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(3, "train"), (10, "val"), (7, "train")], "n long, split string")
    sinks.write_splits(df, f"{tmp_path}/s")
    assert {(r.split, r.n, r.key) for r in spark.read.parquet(f"{tmp_path}/s").collect()} == {("train", 1, 3), ("train", 2, 7), ("val", 1, 10)}
    row = lambda v: spark.createDataFrame([("r", 1, 3, "val/f1", v)], "run string, stage int, step int, tag string, value double")
    sinks.append_scalars(row(0.5), f"{tmp_path}/log")
    sinks.append_scalars(row(0.6), f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2
    result = lambda a, v: spark.createDataFrame([(a, v)], "arch string, f1 double")
    for a, v in (("x", 1.0), ("y", 2.0), ("x", 3.0)):
        sinks.write_results_json(result(a, v), f"{tmp_path}/json")
    assert {(r.arch, r.f1) for r in spark.read.json(f"{tmp_path}/json").collect()} == {("x", 3.0), ("y", 2.0)}


def test_stream_monitor(spark, tmp_path):
    from tessella.streaming.monitor import early_stop_stream

    losses = [0.5, 0.4, 0.45, 0.41, 0.6]
    spark.createDataFrame([("a", e, x) for e, x in enumerate(losses, 1)], "run string, epoch long, loss double").write.parquet(f"{tmp_path}/in")
    stream = early_stop_stream(spark.readStream.schema("run string, epoch long, loss double").parquet(f"{tmp_path}/in"), 3)
    q = stream.writeStream.format("memory").queryName("monitor").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.epoch, r.since, r.stop) for r in spark.sql("select * from monitor order by epoch").collect()] == [(1, 0, False), (2, 0, False), (3, 1, False), (4, 2, False), (5, 3, True)]


def test_percentiles_and_batches_against_numpy(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1.0, 2.0, round(rng.random(), 3)]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v double, i long").repartition(5)
    got = {r.k: (r.p, r.q) for r in metrics.percentiles(df, ["k"], "v", {"p": 0.5, "q": 0.9}).collect()}
    for k in ("a", "b", None):
        want = np.quantile([v for x, v, _ in rows if x == k], [0.5, 0.9])
        assert np.allclose(got[k], want)
    cut = {r.i: (r.k, r.batch) for r in pairing.batches(df, ["k"], [F.col("i")], 4).collect()}
    for k in ("a", "b", None):
        ids = [i for x, _, i in rows if x == k]
        assert all(cut[i] == (k, n // 4) for n, i in enumerate(ids))


def test_split_by_hash_takes_the_lowest_digests(spark):
    import hashlib

    df = spark.range(30_000).withColumnRenamed("id", "n")
    val = {r.n for r in pairing.split_by_hash(df, "n", 0.37, 9).where("split = 'val'").collect()}
    assert val == set(sorted(range(30_000), key=lambda n: hashlib.md5(f"9:{n}".encode()).hexdigest())[:11_100])
    assert pairing.split_by_hash(df.limit(0), "n", 0.2, 3).count() == 0


def test_tiles_put_the_image_together_again(spark):
    rng = np.random.default_rng(6)
    shapes = {1: (64, 64), 2: (40, 64), 3: (20, 33)}
    px = {n: rng.random((h, w, 3)).astype(np.float32) for n, (h, w) in shapes.items()}
    masks = {n: (x[..., 0] > 0.5).astype(np.float32) for n, x in px.items()}
    df = spark.createDataFrame([(n, h, w, 3, px[n].ravel().tolist(), masks[n].ravel().tolist()) for n, (h, w) in shapes.items()], "n long, h int, w int, c int, image array<float>, mask array<float>")
    out = tiling.tile_index(tiling.cut_tiles(df, 32)).orderBy("tile_idx").collect()
    assert [(r.n, r.r, r.c0) for r in out] == [(1, 0, 0), (1, 0, 32), (1, 32, 0), (1, 32, 32), (2, 0, 0), (2, 0, 32), (2, 8, 0), (2, 8, 32), (3, 0, 0), (3, 0, 1)]
    back = {n: np.zeros_like(x) for n, x in px.items()}
    for r in out:
        at = (slice(r.r, r.r + r.tile_h), slice(r.c0, r.c0 + r.tile_w))
        back[r.n][at] = np.array(r.image, np.float32).reshape(r.tile_h, r.tile_w, 3)
        assert (np.array(r.mask).reshape(r.tile_h, r.tile_w) == masks[r.n][at]).all()
    assert all((back[n] == px[n]).all() for n in px) and {(r.tile_h, r.tile_w) for r in out if r.n == 3} == {(20, 32)}


def test_polygons():
    assert rasterize.filled([[0, 0, 4, 0, 4, 3, 0, 3], [1, 1, 2, 2]], 5, 6).sum() == 12
    assert rasterize.filled([[-5, -5, 20, -5, 20, 20, -5, 20]], 5, 6).all() and not rasterize.filled([], 2, 2).any()
    rng = np.random.default_rng(9)
    rows = [([rng.uniform(-2, 12, 2 * int(rng.integers(1, 7))).round(1).tolist() for _ in range(int(rng.integers(0, 4)))], 9, 10) for _ in range(80)]
    assert all((a == rasterize.filled(*r)).all() for a, r in zip(rasterize.filled_all(rows, most=5000), rows, strict=True))
    triangle = rasterize.filled([[0, 0, 8, 0, 0, 8]], 8, 8)
    assert all(triangle[y, x] == ((x + 0.5) + (y + 0.5) < 8) for y in range(8) for x in range(8))


def _jpeg(spark, path, pixels, kind="jpg"):
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(pixels.shape[1], pixels.shape[0], 1)
    for y, row in enumerate(pixels.tolist()):
        for x, (r, g, b) in enumerate(row):
            image.setRGB(x, y, r << 16 | g << 8 | b)
    assert jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(str(path)))


def test_jpeg_and_gif_tiles(spark, tmp_path):
    flat = np.zeros((16, 24, 3), np.uint8)
    flat[..., 0], flat[:, 12:, 1] = 200, 180
    _jpeg(spark, tmp_path / "train7.jpeg", flat)
    _jpeg(spark, tmp_path / "mask7.gif", np.where(flat[..., 1:2] > 0, 255, 0).repeat(3, 2).astype(np.uint8), "gif")
    r = images.read_tiles(spark, str(tmp_path), "train", "jpeg").first()
    assert (r.n, r.h, r.w, r.c) == (7, 16, 24, 3) and np.abs(np.array(r.data).reshape(16, 24, 3)[2:-2, [3, 20]].astype(int) - flat[2:-2, [3, 20]]).max() < 12
    small = images.read_tiles(spark, str(tmp_path), "train", "jpeg", size=8).first()
    assert (small.h, small.w, len(small.data)) == (8, 8, 192)
    mask = images.masks(images.read_tiles(spark, str(tmp_path), "mask", "gif")).first()
    assert (np.array(mask.data).reshape(16, 24) == (flat[..., 1] > 0)).all()
    big = np.zeros((512, 512, 3), np.uint8)
    big[..., 2] = np.arange(512)[:, None] // 2
    (tmp_path / "big").mkdir()
    (tmp_path / "big" / "train1.png").write_bytes(_png(big))
    assert images.read_tiles(spark, f"{tmp_path}/big", "train", "png").first().data == big.ravel().tolist()


def test_sizes_of_tiff_headers():
    tags = [(256, 3, 20), (257, 4, 30)]
    head = b"II*\0" + struct.pack("<IH", 8, 2) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags)
    assert images.image_size(head) == (30, 20) and images.image_size(head[:20]) is None
    big = b"MM\0*" + struct.pack(">IH", 8, 2) + struct.pack(">HHIHH", 256, 3, 1, 20, 0) + struct.pack(">HHII", 257, 4, 1, 30)
    assert images.image_size(big) == (30, 20)


def test_calibration(spark, tmp_path):
    rng = np.random.default_rng(5)
    with pytest.raises(FileNotFoundError):
        images.calibration(spark, str(tmp_path), 2, 4)
    px = {f"{k}.png": rng.integers(0, 256, (6, 5, 3), dtype=np.uint8) for k in "cab"}
    for name, x in px.items():
        (tmp_path / name).write_bytes(_png(x))
    got = images.calibration(spark, str(tmp_path), 2, 4).orderBy("n").collect()
    assert [r.path.rpartition("/")[2] for r in got] == ["a.png", "b.png"]
    want = augment.resize(px["a.png"].astype(np.float32) / 255, 4, 4, "bicubic").transpose(2, 0, 1)
    assert np.allclose(got[0].data, want.ravel(), atol=1e-6)
    (tmp_path / "train").mkdir()
    (tmp_path / "train" / "z.png").write_bytes(_png(px["c.png"]))
    assert images.calibration(spark, str(tmp_path), 9, 4).count() == 1


def test_logs_with_several_evaluation_heads(spark):
    line = LOG.splitlines()[2]
    text = ["Evaluation on A", " loss Precision", "Evaluation on B", line, " Recall F1Score 1 2", " 3 4", line, "Evaluation on C", line, line, "Evaluation on D"]
    lines = spark.createDataFrame([("r", k, x) for k, x in enumerate(text)] + [("s", 0, "Evaluation on"), ("s", 1, line)], "run string, pos long, line string")

    def plain(lines):
        rows, done, inside, tokens = 0, None, False, []
        for x in lines:
            if "Evaluation on" in x:
                inside = True
            elif inside:
                tokens += x.split()
                numbers = [float(t) for t in tokens if t.replace(".", "", 1).isdigit()]
                if len(numbers) >= 4 and sum(t in logs.FIELDS[:4] for t in tokens) >= 4:
                    done, inside = numbers[:4], False
            elif "val_F1Score:" in x:
                rows += 1
        return rows, done

    assert logs.epochs(lines.where("run = 'r'"), ["run"], "pos").count() == plain(text)[0] == 2
    assert [list(r)[1:] for r in logs.evaluation(lines, ["run"], "pos").collect()] == [plain(text)[1]]
    assert logs.epochs(lines.where("run = 's'"), ["run"], "pos").count() == 0


def _record(data):
    return struct.pack("<Q", len(data)) + b"----" + data + b"----"


def test_event_files(spark, tmp_path):
    f = scoring._field
    value = lambda tag, x: f(1, f(1, tag) + b"\x15" + struct.pack("<f", x))
    tensor = lambda tag, x: f(1, f(1, tag) + f(8, f(1, 1) + f(5, struct.pack("<f", x))))
    event = lambda step, summary: b"\x09" + struct.pack("<d", 1.5) + f(2, step) + f(5, summary)
    old = _record(event(1, value("val/f1", 0.1)))
    new = _record(b"\x09" + struct.pack("<d", 0.0) + f(3, "brain.Event:2")) + _record(event(1, value("val/f1", 0.5) + value("loss", 2.0))) + _record(event(300, tensor("val/f1", 0.25)))
    (tmp_path / "run1").mkdir()
    (tmp_path / "run1" / "events.out.tfevents.1").write_bytes(old)
    (tmp_path / "run1" / "events.out.tfevents.2").write_bytes(new + new[:20])
    got = [(r.step, r.tag, r.value, r.seq) for r in scalars.read_events(spark, str(tmp_path)).orderBy("seq").collect()]
    assert got == [(1, "val/f1", 0.5, 0), (1, "loss", 2.0, 1), (300, "val/f1", 0.25, 2)]


def test_curves_and_results(spark, tmp_path):
    (tmp_path / "m.csv").write_text("stage,epoch,loss,precision,recall,f1,val_loss,val_precision,val_recall,val_f1,lr\n2,2,1,1,1,1,1,1,1,0.61237,\n2,1,1,1,1,1,1,1,1,0.5,\n2,3,1,1,1,1,1,1,1,,\n1,1,1,1,1,1,1,1,1,0.1,0.01\n")
    assert scalars.read_curve(spark, f"{tmp_path}/m.csv", 2).first().curve == [0.5, 0.6124]
    assert scalars.read_curve(spark, f"{tmp_path}/none.csv", 2).first().curve == []
    (tmp_path / "r.json").write_text(json.dumps({"unet": {"params": 5, "minutes": 1.5, "metrics": {"f1": 0.5}, "stage2_f1": [0.1, 0.7]}, "hrnet": {"params": 7}}))
    got = {r.arch: (r.params, r.metrics and r.metrics.f1, r.stage2_f1) for r in scalars.read_results(spark, f"{tmp_path}/r.json").collect()}
    assert got == {"unet": (5, 0.5, [0.1, 0.7]), "hrnet": (7, None, None)}
    assert scalars.read_results(spark, f"{tmp_path}/none.json").count() == 0


def test_pairs_and_coco_pairs(spark, tmp_path):
    images_ = spark.createDataFrame([("b", [1]), ("a", [2]), ("c", [3])], "key string, image array<int>")
    masks = spark.createDataFrame([("a", [0, 0, 5, 0]), ("b", [0, 9, 0, 0]), ("d", [1, 1, 1, 1])], "key string, mask array<int>")
    sinks.write_pairs(images_, masks, f"{tmp_path}/p", channels=2)
    assert {(r.n, r.key, tuple(r.mask)) for r in spark.read.parquet(f"{tmp_path}/p").collect()} == {(1, "a", (0, 255)), (2, "b", (255, 0))}
    with pytest.raises(ValueError, match="pairs: 0 of 1"):
        sinks.numbered_pairs(images_, masks.where("key = 'd'"))
    doc = {"images": [{"id": k, "file_name": f"{k}.tiff", "width": 6, "height": 5} for k in (3, 1, 2)], "annotations": [{"id": 1, "image_id": 3, "segmentation": [[0, 0, 2, 0, 2, 2, 0, 2], [4, 4, 6, 4, 6, 5, 4, 5]]}]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    files = spark.createDataFrame([("3.tiff", [7]), ("1.tiff", [8])], "file_name string, image array<int>")
    all_ = coco.read_coco(spark, f"{tmp_path}/d.json")
    got = {r.n: (r.file_name, sum(r.mask), len(r.mask)) for r in coco.pairs(all_, files).collect()}
    assert got == {1: ("1.tiff", 0.0, 30), 2: ("3.tiff", 6.0, 30)}
    assert coco.pairs(coco.read_coco(spark, f"{tmp_path}/d.json", allow_empty=False), files).count() == 1
    assert coco.pairs(all_, files, limit=1).count() == 1
    with pytest.raises(ValueError, match="images on disk: 2 of 3"):
        coco.pairs(all_, files, limit=3)


def test_contract(spark):
    good = (["n", "3", "512", "512"], ["n", "1", "h", "w"])
    rows = [("good", [good[0]], [good[1]]), ("fixed", [["1", "3", "512", "512"]], [good[1]]), ("two", [good[0], good[0]], [good[1]]), ("small", [["n", "3", "256", "512"]], [["n", "2", "512", "512"]]), ("flat", [["n", "3"]], [good[1]])]
    df = spark.createDataFrame(rows, "name string, inputs array<array<string>>, outputs array<array<string>>")
    got = {r[0]: r[1] for r in df.select("name", contract.broken_rules(F.col("inputs"), F.col("outputs"))).collect()}
    assert got == {"good": [], "fixed": ["input batch"], "two": ["one input and one output"], "small": ["input side", "output channels"], "flat": ["input rank"]}
    assert contract.validated(df.where("name = 'good'")).count() == 1
    with pytest.raises(Exception, match="fixed breaks the contract: input batch"):
        contract.validated(df.where("name = 'fixed'")).collect()


def test_harness(spark):
    df = spark.createDataFrame([(1, 4.0), (2, 0.0)], "id long, x double")
    ticks = iter(range(1000))
    one = {r.id: (r.result, r.error) for r in harness.attempted(df, "id", lambda r: 8 / r.x).collect()}
    assert one == {1: (2.0, None), 2: (None, "ZeroDivisionError: float division by zero")}
    out = harness.timed(df.coalesce(1), "id", lambda r: r.x, warmup=3, runs=5)
    assert metrics.latency_stats(out, ["id"], "ms").select("id", "runs").orderBy("id").collect() == [(1, 5), (2, 5)] and next(ticks) == 0


def test_reports(spark):
    df = spark.createDataFrame([(2, "b", None), (1, "a", 0.5)], "pos int, m string, x double")
    text_ = reports.markdown(df, {"m": F.col("m"), "x": reports.number(F.col("x"), 2)}, ["pos"], ["# T"]).first().report
    assert text_ == "# T\n| m | x |\n|---|---|\n| a | 0.50 |\n| b | — |"


def test_settings():
    c = config.from_args(["--data-dir", "d", "--arch", "hrnet", "--multiscale", "--batch-size", "8"])
    assert (c.arch, c.multiscale, c.batch_size, c.two_stage) == ("hrnet", True, 8, False)
    assert config.from_args(["--stage1-dir", "a", "--stage2-dir", "b"]).two_stage
    for bad, said in ((["--arch", "x", "--data-dir", "d"], "unknown arch"), (["--arch", "hrnet", "--width-mult", "0.5", "--data-dir", "d"], "width_mult"), (["--arch", "hrnet", "--export-second", "--data-dir", "d"], "export"), ([], "data_dir"), (["--stage1-dir", "a"], "data_dir")):
        with pytest.raises(ValueError, match=said):
            config.from_args(bad)
    assert config.with_env(c, {"TESSELLA_MULTISCALE": " no", "TESSELLA_SEED": "7", "TESSELLA_ARCH": "unet"}) == config.replace(c, multiscale=False, seed=7, arch="unet")
    assert [config.resolve_device(*a) for a in (("auto", ["cuda", "mps"]), ("auto", []), ("cuda", []))] == ["mps", "cpu", "cuda"]


def test_stage_rates_and_last_stage(spark):
    losses = [0.5, 0.5, 0.5, 0.5, 0.9, 0.9, 0.9, 0.9, 0.9]
    df = spark.createDataFrame([("r", 1 + (e > 4), e, x) for e, x in enumerate(losses, 1)], "run string, stage long, epoch long, loss double")
    rate = lambda carry: [r.lr for r in history.plateau(df, ["run"], "loss", stage="stage", carry=carry).orderBy("epoch").collect()]
    assert np.allclose(rate(False), [1e-3] * 3 + [1e-4] + [1e-3] * 3 + [1e-4] * 2)
    assert np.allclose(rate(True), [1e-3] * 3 + [1e-4] + [1e-4] * 3 + [1e-5] * 2)
    assert tuple(history.best_of_last_stage(df, ["run"], "loss").first()) == ("r", 2, 5, 0.9)


def test_augmented_frame_is_that_of_numpy(spark, sf):
    from tessella.plans import tiling as plans

    before = {r.n: r for r in plans.rgb_images(spark, sf).collect()}
    after = {r.tile: r for r in plans.augment_tiles(spark, sf).collect()}
    assert before.keys() == after.keys()
    changed = 0
    for n, r in before.items():
        image, mask = np.array(r.image, np.float32).reshape(4, 4, 3), np.array(r.mask, np.float32).reshape(4, 4)
        want, lit = augment.augmented(image, mask, plans.AUGMENTATION, n, 1)
        flat = want.ravel().astype(float)
        assert after[n].n == 48 and abs(after[n].head - flat[0]) < 1e-5 and abs(after[n].weighted - (flat * np.arange(1, 49)).sum()) < 1e-3 and after[n].lit == lit.sum()
        changed += not np.allclose(want, image)
    assert changed > 0.9 * len(before)


def test_repeated_tiles_and_names(spark):
    row = spark.range(1).select(tiles.repeated(F.array(F.lit(1), F.lit(2)), 2), F.size(tiles.zeros(2, 3, 4)), text.without_suffix(F.lit("a.hdf5"), ".hdf5"), text.asset_name(F.lit("a"), F.lit(""), "onnx"), text.asset_name(F.lit("a"), F.lit("fp16"), "onnx")).first()
    assert tuple(row) == ([1, 2, 1, 2], 24, "a", "a.onnx", "a_fp16.onnx")


def test_percentiles_of_crowded_and_odd_values(spark, monkeypatch):
    monkeypatch.setattr(metrics, "WITHIN", 5)
    rng = np.random.default_rng(8)
    groups = {
        "near": 1 + rng.random(300) * 1e-9,
        "ties": rng.choice([0.0, -0.0, 1.5, -7.0], 200),
        "wide": np.concatenate([10.0 ** rng.uniform(-300, 300, 80), -(10.0 ** rng.uniform(-300, 300, 80)), [5e-324, 1.7e308]]),
        "one": np.array([3.0]),
        None: np.arange(50.0) - 25,
    }
    df = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [("none", None)], "k string, v double").repartition(5)
    at = {"low": 0.0, "p": 0.37, "mid": 0.5, "high": 1.0}
    got = {r.k: [r[n] for n in at] for r in metrics.percentiles(df, ["k"], "v", at).collect()}
    assert got.keys() == groups.keys()
    for k, x in groups.items():
        assert np.allclose(got[k], np.quantile(x, list(at.values())), rtol=1e-12, atol=0)
    odd = spark.createDataFrame([(float("inf"),), (float("-inf"),), (1.0,), (float("nan"),)], "v double")
    assert [metrics.percentiles(odd.withColumn("k", F.lit(1)), ["k"], "v", {"p": q}).first().p for q in (0.0, 1 / 3, 2 / 3)] == [float("-inf"), 1.0, float("inf")]


def test_nothing_stays_persisted(spark, sf):
    from tessella.plans import catalog

    for name in ("latency_stats", "speedup_vs_base", "weighted_batch_loss", "tile_order", "renumber"):
        catalog.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_settings_of_augmentation():
    c = config.from_args(["--data-dir", "d", "--aug-hflip-p", "1", "--aug-vflip-p", "0", "--aug-rotate-p", "0", "--aug-bc-p", "0", "--aug-hsv-p", "0", "--multiscale", "--crop-min-px", "3", "--crop-max-px", "3", "--seed", "9", "--out-dir", "x/"]).checked()
    plan = c.augmentation
    assert plan == augment.Plan(flip_p=1.0, vflip_p=0.0, rotate_p=0.0, crop=(3, 3), brightness_p=0.0, contrast_limit=0.2, seed=9) and c.output("model.onnx") == "x/model.onnx"
    image, mask = np.arange(27.0).reshape(3, 3, 3) / 27, np.eye(3)
    got = augment.augmented(image, mask, plan, 1, 1)
    assert np.allclose(got[0], image[:, ::-1], atol=1e-6) and np.array_equal(got[1], mask[:, ::-1])
    assert config.Config(data_dir="d").augmentation.crop is None
    for bad in (["--crop-min-px", "9", "--crop-max-px", "3"], ["--aug-hsv-p", "1.5"]):
        with pytest.raises(ValueError):
            config.from_args(["--data-dir", "d", *bad]).checked()
