"""Model graphs from their bytes: what a model declares, its tensors' shapes, and names changed in place.

A model file is nested messages of (key, value) fields, whose lengths allow what isn't wanted to be stepped over; weights are never read or copied. `signatures` takes models from a binary column,
`read_graphs` from files of any size, of which it reads the parts on the way only. `renamed` changes the names of tensors and repairs the lengths of all messages around them; every other byte, unknown fields too, stays.

Defined results: bytes that are no model, or are cut off, give empty lists and an error text; a null model is such a model; a dimension is its number or its name, and empty where it has neither.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessella.sources.ranges import Header, _Reader, _Source, load

# Fixed values of the format: field numbers by message, and kinds of values.
GRAPH = 7  # of a model
NODE, TENSOR, INPUT, OUTPUT, VALUE = 1, 5, 11, 12, 13  # of a graph
NODE_INPUT, NODE_OUTPUT, NODE_ATTRIBUTE = 1, 2, 5
ATTRIBUTE_GRAPH, ATTRIBUTE_GRAPHS = 6, 11
VALUE_NAME, VALUE_TYPE, TYPE_TENSOR, TENSOR_SHAPE, SHAPE_DIM, DIM_VALUE, DIM_NAME = 1, 2, 1, 2, 1, 1, 2
TENSOR_DIMS, TENSOR_KIND, TENSOR_NAME, TENSOR_RAW = 1, 2, 8, 9
VARINT, EIGHT, LENGTH, FOUR = 0, 1, 2, 5


class Whole:
    """Bytes in memory, by place."""

    def __init__(self, data: bytes):
        self.data, self.length = memoryview(data), len(data)

    def get(self, at: int, n: int) -> memoryview:
        return self.data[at : at + n]


class Field(NamedTuple):
    number: int
    kind: int
    at: int  # of the key
    start: int  # of the value
    end: int
    value: int  # of a varint


def varint(source: Whole | Header, at: int) -> tuple[int, int]:
    """(value, place behind it)."""
    value = 0
    for k, b in enumerate(bytes(source.get(at, 10))):
        value |= (b & 127) << 7 * k
        if b < 128:
            return value & (1 << 64) - 1, at + k + 1
    raise ValueError(f"no number at byte {at}")


def fields(source: Whole | Header, lo: int, hi: int) -> Iterator[Field]:
    """The fields of the message in [lo, hi)."""
    at = lo
    while at < hi:
        key, start = varint(source, at)
        kind, value = key & 7, 0
        if kind == VARINT:
            value, end = varint(source, start)
        elif kind == LENGTH:
            value, start = varint(source, start)
            end = start + value
        elif kind in (EIGHT, FOUR):
            end = start + (8 if kind == EIGHT else 4)
        else:
            raise ValueError(f"unknown kind of field at byte {at}")
        if end > hi or not key >> 3:
            raise ValueError(f"a field at byte {at} goes beyond its message")
        yield Field(key >> 3, kind, at, start, end, value)
        at = end


def _text(source: Whole | Header, f: Field) -> str:
    return bytes(source.get(f.start, f.end - f.start)).decode("utf-8", "replace")


def _inner(source: Whole | Header, lo: int, hi: int, number: int) -> Iterator[tuple[int, int]]:
    return ((f.start, f.end) for f in fields(source, lo, hi) if f.number == number and f.kind == LENGTH)


def _value(source: Whole | Header, lo: int, hi: int) -> tuple[str, list[str]]:
    """(name, dimensions) of a declared input or output."""
    name, dims = "", []
    for f in fields(source, lo, hi):
        if f.number == VALUE_NAME and f.kind == LENGTH:
            name = _text(source, f)
        elif f.number == VALUE_TYPE and f.kind == LENGTH:
            for tensor in _inner(source, f.start, f.end, TYPE_TENSOR):
                for shape in _inner(source, *tensor, TENSOR_SHAPE):
                    for dim in _inner(source, *shape, SHAPE_DIM):
                        own = {d.number: _text(source, d) if d.number == DIM_NAME and d.kind == LENGTH else str(d.value - (1 << 64) if d.value >> 63 else d.value) for d in fields(source, *dim)}
                        dims.append(own.get(DIM_NAME) or own.get(DIM_VALUE, ""))
    return name, dims


def _tensor(source: Whole | Header, lo: int, hi: int) -> tuple[str, list[int], int]:
    """(name, dimensions, kind of its elements) of an initialiser; its data is stepped over."""
    name, dims, kind = "", [], 0
    for f in fields(source, lo, hi):
        if f.number == TENSOR_DIMS and f.kind == VARINT:
            dims.append(f.value)
        elif f.number == TENSOR_DIMS and f.kind == LENGTH:  # all in one field
            at = f.start
            while at < f.end:
                d, at = varint(source, at)
                dims.append(d)
        elif f.number == TENSOR_KIND:
            kind = f.value
        elif f.number == TENSOR_NAME:
            name = _text(source, f)
    return name, dims, kind


def signature(source: Whole | Header) -> tuple[list[tuple[str, list[str]]], list[tuple[str, list[str]]], list[tuple[str, list[int], int]]]:
    """(inputs, outputs, tensors) of a model's graph."""
    inputs, outputs, tensors = [], [], []
    graphs = list(_inner(source, 0, source.length, GRAPH))
    if len(graphs) != 1:
        raise ValueError(f"{len(graphs)} graphs")
    for f in fields(source, *graphs[0]):
        if f.kind == LENGTH and f.number in (INPUT, OUTPUT):
            (inputs if f.number == INPUT else outputs).append(_value(source, f.start, f.end))
        elif f.kind == LENGTH and f.number == TENSOR:
            tensors.append(_tensor(source, f.start, f.end))
    return inputs, outputs, tensors


VALUES = pa.list_(pa.struct([("name", pa.string()), ("dims", pa.list_(pa.string()))]))
TENSORS = pa.list_(pa.struct([("name", pa.string()), ("dims", pa.list_(pa.int64())), ("kind", pa.int32())]))
SIGNATURE = "inputs array<struct<name: string, dims: array<string>>>, outputs array<struct<name: string, dims: array<string>>>, tensors array<struct<name: string, dims: array<long>, kind: int>>, error string"


def _signed(sources: list[Whole | Header]) -> list[pa.Array]:
    inputs, outputs, tensors, errors = [], [], [], []
    for s in sources:
        try:
            (i, o, t), error = signature(s), None
        except ValueError as e:
            (i, o, t), error = ([], [], []), str(e)
        inputs.append([{"name": n, "dims": d} for n, d in i])
        outputs.append([{"name": n, "dims": d} for n, d in o])
        tensors.append([{"name": n, "dims": d, "kind": k} for n, d, k in t])
        errors.append(error)
    return [pa.array(inputs, VALUES), pa.array(outputs, VALUES), pa.array(tensors, TENSORS), pa.array(errors, pa.string())]


def signatures(models: DataFrame, model: str = "model") -> DataFrame:
    """models with the column of bytes replaced by (inputs, outputs, tensors, error)."""
    rest = [c for c in models.columns if c != model]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _signed([Whole(m or b"") for m in b.column(len(rest)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *found], [*rest, "inputs", "outputs", "tensors", "error"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in models.schema.fields if f.name != model]
    return models.select(*rest, model).mapInArrow(run, ", ".join([*kept, SIGNATURE]))


class _GraphsReader(_Reader):
    def rows(self, path, handle, length, lo, hi):
        header = Header(handle, length, 4096)
        found = _signed([header])
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([length]), pa.array([header.read]), *found], ["path", "length", "bytes_read", "inputs", "outputs", "tensors", "error"])


class ModelGraphs(_Source):
    kind, columns = _GraphsReader, f"path string, length long, bytes_read long, {SIGNATURE}"

    @classmethod
    def name(cls) -> str:
        return "model_graphs"


def read_graphs(spark: SparkSession, path: str, glob: str = "*.onnx") -> DataFrame:
    """(path, length, bytes_read, inputs, outputs, tensors, error) of model files."""
    return load(spark, ModelGraphs, path, glob=glob, head=1)


def parameters(tensors: Column) -> Column:
    """How many numbers the tensors hold; one without dimensions holds one."""
    size = lambda t: F.aggregate(t["dims"], F.lit(1).cast("long"), lambda a, d: a * d)
    return F.aggregate(tensors, F.lit(0).cast("long"), lambda a, t: a + size(t))


# ---- writing ---------------------------------------------------------------------------------------------------------


def coded(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def field(number: int, value: int | bytes | str) -> bytes:
    if isinstance(value, int):
        return coded(number << 3 | VARINT) + coded(value & (1 << 64) - 1)
    value = value.encode() if isinstance(value, str) else value
    return coded(number << 3 | LENGTH) + coded(len(value)) + value


def _rewritten(source: Whole, lo: int, hi: int, change: Callable[[Field], bytes | None]) -> bytes:
    """The message in [lo, hi), with the values that `change` gives in place of theirs."""
    out = []
    for f in fields(source, lo, hi):
        new = change(f) if f.kind == LENGTH else None
        if new is None:
            out.append(bytes(source.get(f.at, f.end - f.at)))
        else:
            key = varint(source, f.at)[1] - f.at
            out.append(bytes(source.get(f.at, key)) + coded(len(new)) + new)
    return b"".join(out)


def renamed(model: bytes, names: dict[str, str]) -> bytes:
    """The model with tensors of these names called otherwise wherever its graphs mention them."""
    s = Whole(model)

    def name(f: Field) -> bytes | None:
        new = names.get(_text(s, f))
        return None if new is None else new.encode()

    def named(f: Field, number: int) -> bytes:
        return _rewritten(s, f.start, f.end, lambda x: name(x) if x.number == number else None)

    def attribute(f: Field) -> bytes:
        return _rewritten(s, f.start, f.end, lambda x: graph(x) if x.number in (ATTRIBUTE_GRAPH, ATTRIBUTE_GRAPHS) else None)

    def node(f: Field) -> bytes:
        return _rewritten(s, f.start, f.end, lambda x: name(x) if x.number in (NODE_INPUT, NODE_OUTPUT) else attribute(x) if x.number == NODE_ATTRIBUTE else None)

    def graph(f: Field) -> bytes:
        def change(x: Field) -> bytes | None:
            if x.number == NODE:
                return node(x)
            if x.number == TENSOR:
                return named(x, TENSOR_NAME)
            return named(x, VALUE_NAME) if x.number in (INPUT, OUTPUT, VALUE) else None

        return _rewritten(s, f.start, f.end, change)

    return _rewritten(s, 0, s.length, lambda f: graph(f) if f.number == GRAPH else None)


def rename_io(models: DataFrame, new_input: str = "input", new_output: str = "output", model: str = "model") -> DataFrame:
    """models with their first input and first output called so; models without either, or unreadable ones, become null."""
    at = models.columns.index(model)

    def changed(raw: bytes | None) -> bytes | None:
        try:
            inputs, outputs, _ = signature(Whole(raw or b""))
        except ValueError:
            return None
        return renamed(raw, {inputs[0][0]: new_input, outputs[0][0]: new_output}) if inputs and outputs else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.set_column(at, model, pa.array([changed(m) for m in b.column(at).to_pylist()], pa.binary()))

    return models.mapInArrow(run, models.schema)


def declared(name: str, dims: list[str]) -> bytes:
    """A declared input or output of 32-bit floats; dimensions that are no number are names."""
    shape = b"".join(field(SHAPE_DIM, field(DIM_VALUE, int(d)) if d.lstrip("-").isdigit() else field(DIM_NAME, d)) for d in dims)
    return field(VALUE_NAME, name) + field(VALUE_TYPE, field(TYPE_TENSOR, field(1, 1) + field(TENSOR_SHAPE, shape)))


def skeleton(inputs: list[tuple[str, list[str]]], outputs: list[tuple[str, list[str]]], tensors: list[tuple[str, list[int]]]) -> bytes:
    """A model without nodes, whose tensors' data would lie outside the file."""
    outside = field(13, field(1, "location") + field(2, "weights.bin")) + field(14, 1)
    parts = [field(2, "skeleton")]
    parts += [field(TENSOR, b"".join(field(TENSOR_DIMS, d) for d in dims) + field(TENSOR_KIND, 1) + field(TENSOR_NAME, name) + outside) for name, dims in tensors]
    parts += [field(INPUT, declared(*i)) for i in inputs] + [field(OUTPUT, declared(*o)) for o in outputs]
    return field(1, 8) + field(GRAPH, b"".join(parts)) + field(8, field(1, "") + field(2, 17))


def write_models(graphs: DataFrame, key: str) -> DataFrame:
    """graphs: (key, inputs, outputs, tensors) as in signatures; (key, model binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)
            out = [skeleton([(x["name"], x["dims"]) for x in i], [(x["name"], x["dims"]) for x in o], [(x["name"], x["dims"]) for x in t]) for i, o, t in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], [key, "model"])

    return graphs.select(key, "inputs", "outputs", "tensors").mapInArrow(run, f"`{key}` {dict(graphs.dtypes)[key]}, model binary")
