"""Batched model inference over tiles: one ONNX session a Python worker, bounded Arrow batches, errors by name."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessella.functions.text import TRUE, truthy
from tessella.operators.pairing import few
from tessella.session import stored

OOM = ("out of memory", "oom", "cudaerror")  # fixed values: what runtimes say when memory runs out


class OutOfMemory(RuntimeError):
    """The model runtime had too little memory for a batch."""


def providers(explicit: str | None = None, force_cpu: str | None = None, available: tuple[str, ...] = ("CPUExecutionProvider",)) -> list[str]:
    """An explicit comma list as it is; else CPU only where that is forced; else the best available with CPU behind it."""
    if explicit and explicit.strip():
        return [p.strip() for p in explicit.split(",") if p.strip()]
    if (force_cpu or "").strip().lower() not in TRUE:
        for p in ("CUDAExecutionProvider", "CoreMLExecutionProvider"):
            if p in available:
                return [p, "CPUExecutionProvider"]
    return ["CPUExecutionProvider"]


def provider_list(explicit: Column, force_cpu: Column, cuda: Column, coreml: Column) -> Column:
    """The same precedence as a column: array of providers."""
    cpu = F.lit("CPUExecutionProvider")
    asked = F.filter(F.transform(F.split(explicit, ","), lambda p: F.trim(p)), lambda p: p != "")
    best = F.when(truthy(force_cpu), F.array(cpu)).when(cuda, F.array(F.lit("CUDAExecutionProvider"), cpu)).when(coreml, F.array(F.lit("CoreMLExecutionProvider"), cpu)).otherwise(F.array(cpu))
    return F.when(F.size(asked) > 0, asked).otherwise(best)


def predict(session, batch: np.ndarray) -> np.ndarray:
    """NHWC in, NHWC out, float32; the graph itself is NCHW."""
    name = session.get_inputs()[0].name
    try:
        out = session.run(None, {name: np.ascontiguousarray(batch.transpose(0, 3, 1, 2), dtype=np.float32)})[0]
    except Exception as e:
        if any(w in str(e).lower() for w in OOM):
            raise OutOfMemory(str(e)) from e
        raise
    return out.transpose(0, 2, 3, 1)


def score(tiles: DataFrame, model: bytes, batch: int = 8) -> DataFrame:
    """tiles: (n, h, w, c, image array<float> HWC); adds prob array<float>. Tiles of one shape are scored `batch` at a time."""
    sent = tiles.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import onnxruntime as ort

        options = ort.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1  # Spark's tasks are the parallelism
        session = ort.InferenceSession(sent.value, options, providers=providers())
        for pdf in batches:
            prob: list = [None] * len(pdf)
            shapes = pdf.groupby(["h", "w", "c"], sort=False).indices
            for (h, w, c), rows in shapes.items():
                for at in range(0, len(rows), batch):
                    some = rows[at : at + batch]
                    x = np.stack([np.asarray(pdf["image"].iloc[i], np.float32) for i in some]).reshape(len(some), h, w, c)
                    for i, y in zip(some, predict(session, x), strict=True):
                        prob[i] = y.ravel()
            yield pd.DataFrame({"n": pdf["n"], "prob": prob})

    return tiles.select("n", "h", "w", "c", "image").mapInPandas(run, "n long, prob array<float>")


def newest(models: DataFrame, upto: int | None = None) -> DataFrame:
    """(name, version, model): the newest version of each name, not above `upto` where that is given; models: (name, version, model binary), rows without bytes don't count."""
    some = models.where(F.col("model").isNotNull() & F.col("name").isNotNull())
    some = some if upto is None else some.where(F.col("version") <= upto)
    return some.groupBy("name").agg(F.max("version").alias("version"), F.max_by("model", "version").alias("model"))


@lru_cache(maxsize=4)
def _session(model: bytes):
    """A worker's sessions: the four used last."""
    import onnxruntime as ort

    options = ort.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    return ort.InferenceSession(model, options, providers=providers())


SCORED = "name string, n long, version int, prob array<float>, error string"


def _many(batch: int):
    """Over rows sorted by (name, salt, kind): a model's bytes, then tiles for it."""

    def scored(name: str | None, version: int, model: bytes, rows: list[tuple]) -> list[tuple]:
        """rows: (n, (h, w, c), image)."""
        out, shapes = [], {}
        for r in rows:
            shapes.setdefault(r[1], []).append(r)
        for shape, own in shapes.items():
            for k in range(0, len(own), batch):
                some = own[k : k + batch]
                try:
                    x = np.stack([r[2] for r in some]).reshape(len(some), *shape)
                    out += [(name, r[0], version, y.ravel(), None) for r, y in zip(some, predict(_session(model), x), strict=True)]
                except Exception as e:  # noqa: BLE001  a model that fails doesn't stop the others
                    out += [(name, r[0], version, None, f"{type(e).__name__}: {e}") for r in some]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, model, version = None, None, None
        for b in batches:
            names, salts, kinds, ns, hs, ws, cs = (b.column(k).to_pylist() for k in range(7))
            out: list[tuple] = []
            held: list[tuple] = []
            for k, key in enumerate(zip(names, salts, strict=True)):
                if key != at:
                    if held:
                        out += scored(at[0], version, model, held)
                    held, at, model, version = [], key, None, None
                if kinds[k] == 0:
                    model, version = b.column(9)[k].as_py(), b.column(8)[k].as_py()
                elif model is None:
                    out.append((names[k], ns[k], None, None, "no model"))
                else:
                    held.append((ns[k], (hs[k], ws[k], cs[k]), b.column(7)[k].values.to_numpy(zero_copy_only=False)))
            if held:
                out += scored(at[0], version, model, held)
            kinds_ = (pa.string(), pa.int64(), pa.int32(), pa.list_(pa.float32()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds_)], ["name", "n", "version", "prob", "error"])

    return run


def score_many(tiles: DataFrame, models: DataFrame, batch: int = 8, per_task: int = 20_000) -> DataFrame:
    """(name, n, version, prob, error): tiles (name, n, h, w, c, image), each scored by the model of its name, all models in one pass.

    models: (name, version, model binary), a name once, as from `newest`. Tiles are dealt by name, `per_task` of a name a task, with the model's bytes before them, so bytes travel once a task and a worker holds few sessions. Tiles whose name has no
    model, or whose model fails on them, come out with an error.
    """
    spark = tiles.sparkSession
    sizes, _ = stored(tiles.groupBy("name").agg(F.ceil(F.count("*") / per_task).cast("int").alias("salts")), "sizes")
    salted = tiles.join(few(sizes), tiles["name"].eqNullSafe(sizes["name"])).drop(sizes["name"])
    rows = salted.select("name", F.pmod(F.xxhash64("n"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "n", "h", "w", "c", F.col("image").cast("array<float>").alias("image"), F.lit(None).cast("int").alias("version"), F.lit(None).cast("binary").alias("model"))
    null = lambda t: F.lit(None).cast(t)
    sent = models.join(sizes, "name").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    sent = sent.select("name", "salt", F.lit(0).alias("kind"), null("long").alias("n"), null("int").alias("h"), null("int").alias("w"), null("int").alias("c"), null("array<float>").alias("image"), F.col("version").cast("int").alias("version"), "model")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = sent.unionByName(rows).repartition(n, "name", "salt").sortWithinPartitions("name", "salt", "kind")
    return dealt.mapInArrow(_many(batch), SCORED)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | bytes | str) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def small_model(kernel: np.ndarray, bias: float = 0.0) -> bytes:
    """An ONNX model of one 3 x 3 convolution with a sigmoid behind it, for any size of one-channel tile; input `input`, output `output`."""
    tensor = lambda name, dims, data: b"".join(_field(1, d) for d in dims) + _field(2, 1) + _field(8, name) + _field(9, data)

    def value(name: str) -> bytes:
        dims = [_field(1, _field(2, "batch")), _field(1, _field(1, 1)), _field(1, _field(2, "h")), _field(1, _field(2, "w"))]
        return _field(1, name) + _field(2, _field(1, _field(1, 1) + _field(2, b"".join(dims))))

    pads = _field(1, "pads") + b"".join(_field(8, 1) for _ in range(4)) + _field(20, 7)
    conv = _field(1, "input") + _field(1, "w") + _field(1, "b") + _field(2, "logit") + _field(4, "Conv") + _field(5, pads)
    sig = _field(1, "logit") + _field(2, "output") + _field(4, "Sigmoid")
    weights = tensor("w", (1, 1, 3, 3), np.asarray(kernel, "<f4").tobytes())
    graph = _field(1, conv) + _field(1, sig) + _field(2, "small") + _field(5, weights) + _field(5, tensor("b", (1,), struct.pack("<f", bias))) + _field(11, value("input")) + _field(12, value("output"))
    return _field(1, 8) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 17))
