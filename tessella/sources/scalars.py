"""Scalars of earlier runs: event files, curves in CSV and results in JSON; what isn't there is empty."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

CURVE = "stage INT, epoch INT, loss DOUBLE, precision DOUBLE, recall DOUBLE, f1 DOUBLE, val_loss DOUBLE, val_precision DOUBLE, val_recall DOUBLE, val_f1 DOUBLE, lr DOUBLE"
RESULT = "params: BIGINT, minutes: DOUBLE, metrics: STRUCT<loss: DOUBLE, precision: DOUBLE, recall: DOUBLE, f1: DOUBLE>, test: STRUCT<f1: DOUBLE, precision: DOUBLE, recall: DOUBLE>, stage1_f1: ARRAY<DOUBLE>, stage2_f1: ARRAY<DOUBLE>"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_curve(spark: SparkSession, path: str, stage: int, digits: int = 4) -> DataFrame:
    """(curve): the values of val_f1 of one stage in the order of its epochs, empty cells left out; an empty list where there is no file."""
    rows = spark.read.schema(CURVE).option("header", True).csv(path) if exists(spark, path) else spark.createDataFrame([], CURVE)
    rows = rows.where((F.col("stage") == stage) & F.col("val_f1").isNotNull())
    pairs = F.array_sort(F.collect_list(F.struct("epoch", F.round("val_f1", digits).alias("v"))))
    return rows.agg(F.transform(pairs, lambda p: p["v"]).alias("curve"))


def results(json: DataFrame) -> DataFrame:
    """(arch, params, minutes, metrics, test, stage1_f1, stage2_f1) of each entry of documents (value) that map architectures to results."""
    return json.select(F.explode(F.from_json("value", f"MAP<STRING, STRUCT<{RESULT}>>")).alias("arch", "r")).select("arch", "r.*")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """results() of a file; no rows where there is none."""
    return results(spark.read.text(path, wholetext=True) if exists(spark, path) else spark.createDataFrame([], "value STRING"))


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (raw[at] & 127) << shift
        at += 1
        if raw[at - 1] < 128:
            return n, at
        shift += 7


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        if key & 7 == 0:
            value, at = _varint(raw, at)
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            if size is None:
                size, at = _varint(raw, at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


def scalar_events(raw: bytes) -> Iterator[tuple[int, str, float]]:
    """(step, tag, value) of an event file: records of length, checksum, message, checksum; a record that is cut off ends it.

    Fixed values: of a message, field 2 is the step and 5 the summary, whose fields 1 are values with tag 1 and number 2 or, in a tensor, 8.
    """
    at = 0
    while at + 12 <= len(raw):
        (size,) = struct.unpack_from("<Q", raw, at)
        if at + 16 + size > len(raw):
            return
        step, values = 0, []
        for k, v in _fields(raw[at + 12 : at + 12 + size]):
            if k == 2:
                step = v
            elif k == 5:
                values += [dict(_fields(x)) for n, x in _fields(v) if n == 1]
        for x in values:
            if 2 in x:
                yield step, x[1].decode(), struct.unpack("<f", x[2])[0]
            elif 8 in x:
                tensor = dict(_fields(x[8]))
                packed = tensor.get(5) or tensor.get(4)
                if packed and len(packed) >= 4:
                    yield step, x[1].decode(), struct.unpack("<f", packed[:4])[0]
        at += 16 + size


def read_events(spark: SparkSession, path: str, glob: str = "events.out.tfevents.*") -> DataFrame:
    """(run, step, tag, value, seq) of the last event file by name of each folder under path; seq is the order in the file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r.run, step, tag, value, k) for r in pdf.itertuples() for k, (step, tag, value) in enumerate(scalar_events(bytes(r.content)))]
            yield pd.DataFrame(rows, columns=["run", "step", "tag", "value", "seq"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    folder = F.regexp_replace("path", "/[^/]*$", "")
    last = files.select(folder.alias("run"), "path").groupBy("run").agg(F.max("path").alias("path"))  # names only are read for this
    return files.select("path", "content").join(last, "path").select("run", "content").mapInPandas(run, "run string, step long, tag string, value double, seq long")
