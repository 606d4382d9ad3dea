"""Models as bytes."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import contract, layers, quantize, scoring
from tessella.sources import graphs as G

ort = pytest.importorskip("onnxruntime")


def run(model, x):
    session = ort.InferenceSession(model, providers=["CPUExecutionProvider"])
    return session.run(None, {session.get_inputs()[0].name: x})[0]


def skeleton(i=("batch", "3", "512", "512"), o=("batch", "1", "h", "w"), **more):
    return G.skeleton([("input", list(i))], [("output", list(o))], more.get("tensors", []))


def test_signature_is_the_runtimes():
    model = scoring.small_model(np.ones((3, 3)))
    inputs, outputs, tensors = G.signature(G.Whole(model))
    session = ort.InferenceSession(model, providers=["CPUExecutionProvider"])
    assert inputs == [(session.get_inputs()[0].name, [str(d) for d in session.get_inputs()[0].shape])]
    assert outputs == [(session.get_outputs()[0].name, [str(d) for d in session.get_outputs()[0].shape])]
    assert tensors == [("w", [1, 1, 3, 3], 1), ("b", [1], 1)]


def test_contract_from_bytes(spark):
    good = skeleton()
    cases = {
        "good": (good, []),
        "fixed": (skeleton(o=("batch", "1", "512", "512")), []),
        "side": (skeleton(i=("batch", "3", "256", "256")), ["input side"]),
        "batch": (skeleton(i=("1", "3", "512", "512")), ["input batch"]),
        "channels": (skeleton(i=("batch", "2", "512", "512")), ["input channels"]),
        "rank": (skeleton(o=("batch", "1", "512")), ["output rank"]),
        "two": (G.skeleton([("a", ["n", "3", "h", "w"]), ("b", [])], [("output", ["n", "1", "h", "w"])], []), ["one input and one output"]),
        "cut": (good[:-9], ["readable"]),
        "text": (b"no model", ["readable"]),
        "empty": (b"", ["readable"]),
        "null": (None, ["readable"]),
    }
    df = spark.createDataFrame([(k, m) for k, (m, _) in cases.items()], "name string, model binary").withColumn("tensors_", F.lit(1))
    found = {r.name: r for r in contract.broken_graphs(G.signatures(df)).collect()}
    assert {k: r.broken for k, r in found.items()} == {k: b for k, (_, b) in cases.items()}
    assert all(bool(r.error) == (r.broken == ["readable"]) and r.tensors_ == 1 for r in found.values())


def test_files_are_read_in_part(spark, tmp_path):
    big = np.zeros((3, 3))
    model = scoring.small_model(big)
    weights = G.field(5, G.field(1, 1000) + G.field(1, 500) + G.field(2, 1) + G.field(8, "large") + G.field(9, os.urandom(2_000_000)))
    whole = G.Whole(model)
    graph = next(f for f in G.fields(whole, 0, len(model)) if f.number == G.GRAPH)
    body = model[graph.start : graph.end]
    (tmp_path / "large.onnx").write_bytes(model[: graph.at] + G.field(G.GRAPH, weights + body) + model[graph.end :])
    (tmp_path / "cut.onnx").write_bytes(model[:-30])
    rows = {os.path.basename(r.path): r for r in G.read_graphs(spark, str(tmp_path)).select("path", "length", "bytes_read", "inputs", "error", G.parameters(F.col("tensors")).alias("params")).collect()}
    r = rows["large.onnx"]
    assert r.params == 500_000 + 9 + 1 and r.error is None and r.inputs[0].name == "input" and r.bytes_read < 0.01 * r.length
    assert rows["cut.onnx"].error


def test_renamed_models_run_alike(spark):
    x = np.random.default_rng(1).standard_normal((2, 1, 6, 5)).astype(np.float32)
    model = scoring.small_model(np.arange(9.0).reshape(3, 3) / 10, 0.3)
    for new in ("i", "a name that is so long that the lengths of all messages around it take more bytes than before " * 3):
        other = G.renamed(model, {"input": new, "output": "out", "w": "weights", "logit": "z"})
        session = ort.InferenceSession(other, providers=["CPUExecutionProvider"])
        assert session.get_inputs()[0].name == new and session.get_outputs()[0].name == "out"
        assert np.array_equal(run(other, x), run(model, x))
        assert G.renamed(other, {new: "input", "out": "output", "weights": "w", "z": "logit"}) == model
    assert G.renamed(model, {}) == model
    df = spark.createDataFrame([(1, G.renamed(model, {"input": "x", "output": "y"})), (2, b"bad"), (3, None), (4, skeleton(tensors=[("t", [2])]))], "k int, model binary")
    back = {r.k: r.model for r in G.rename_io(df).collect()}
    assert back[1] == model and back[2] is None and back[3] is None and bytes(back[4]) == skeleton(tensors=[("t", [2])])


def test_renaming_keeps_what_it_does_not_know():
    """Unknown fields at every level, graphs inside nodes, keys and lengths in more bytes than they need."""
    inner = G.field(1, G.field(1, "x") + G.field(2, "z") + G.field(4, "Relu"))
    attribute = G.field(1, "body") + G.field(6, inner) + G.field(11, inner) + G.field(99, b"kept") + G.field(20, 5)
    node = G.field(1, "x") + G.field(2, "y") + G.field(77, 1 << 60) + G.field(5, attribute) + b"\x8d\x06" + b"abcd"  # field 97, four bytes
    graph = G.field(1, node) + G.field(2, "x") + G.field(11, G.declared("x", ["n"])) + G.field(12, G.declared("y", ["n"])) + G.field(13, G.declared("z", ["n"])) + G.field(98, b"x")
    model = G.field(1, 8) + b"\xba\x80\x00" + G.coded(len(graph)) + graph + G.field(500, b"x")
    got = G.renamed(model, {"x": "input", "z": "middle"})
    want = model.replace(G.field(1, "x"), G.field(1, "input")).replace(G.field(2, "z"), G.field(2, "middle"))
    expected = lambda i: G.field(1, G.field(1, "input") + G.field(2, "middle") + G.field(4, "Relu"))
    new_attribute = G.field(1, "body") + G.field(6, expected(0)) + G.field(11, expected(1)) + G.field(99, b"kept") + G.field(20, 5)
    new_node = G.field(1, "input") + G.field(2, "y") + G.field(77, 1 << 60) + G.field(5, new_attribute) + b"\x8d\x06" + b"abcd"
    new_graph = G.field(1, new_node) + G.field(2, "x") + G.field(11, G.declared("input", ["n"])) + G.field(12, G.declared("y", ["n"])) + G.field(13, G.declared("middle", ["n"])) + G.field(98, b"x")
    assert got == G.field(1, 8) + b"\xba\x80\x00" + G.coded(len(new_graph)) + new_graph + G.field(500, b"x") and got != want
    for bad in (b"\xff" * 12, b"\x0b\x00", model[:-1], b"\x00\x01"):
        with pytest.raises(ValueError):
            G.renamed(bad, {})


def test_permuted_tensors(spark):
    rng = np.random.default_rng(3)
    for shape, axes in (((2, 3, 4, 5), (2, 3, 1, 0)), ((3, 1, 2), (1, 2, 0)), ((4,), (0,)), ((2, 0, 3), (2, 1, 0))):
        x = rng.standard_normal(shape)
        df = spark.createDataFrame([(x.ravel().tolist(), list(shape))], "d array<double>, s array<int>")
        r = df.select(layers.permuted(F.col("d"), F.col("s"), axes).alias("d"), layers.permuted_shape(F.col("s"), axes).alias("s")).first()
        assert r.d == x.transpose(axes).ravel().tolist() and r.s == list(x.transpose(axes).shape)
    with pytest.raises(ValueError, match="order of axes"):
        layers.permuted(F.col("d"), F.col("s"), (0, 0))


def test_layers_are_zipped_by_place(spark):
    kind = "pos int, kind string, shape array<int>, data array<double>"
    left = spark.createDataFrame([(10, "conv", [1, 2], [1.0, 2.0]), (30, "norm", [1], [3.0]), (20, "conv", [2], [4.0, 5.0])], kind).repartition(3)
    other = [(1, "conv", [1, 2], "a"), (2, "conv", [2], "b"), (7, "norm", [1], "c")]
    make = lambda rows: spark.createDataFrame(rows, "pos int, kind string, shape array<int>, other string")
    got = layers.zipped(left, make(other), "pos").orderBy("n").collect()
    assert [(r.n, r.kind, r.data, r.other) for r in got] == [(1, "conv", [1.0, 2.0], "a"), (2, "conv", [4.0, 5.0], "b"), (3, "norm", [3.0], "c")]
    for wrong, message in ((other[:2], "layer 3 is on one side only"), ([*other, (9, "x", [1], "d")], "layer 4 is on one side only"), ([other[0], (2, "norm", [2], "b"), other[2]], "layer 2: conv and norm"), ([other[0], (2, "conv", [3], "b"), other[2]], r"layer 2: shapes \[2\] and \[3\]")):
        with pytest.raises(Exception, match=message):
            layers.zipped(left, make(wrong), "pos").select("kind").collect()


def test_quantisation_against_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(k, (rng.standard_normal(6) * 10 ** (k - 1) + (k == 2) * 50).tolist()) for k in range(3) for _ in range(20)]
    rows += [(3, [0.0, 0.0]), (4, [None, 1.0]), (5, []), (None, [2.0, -4.0])]
    df = spark.createDataFrame(rows, "k int, v array<double>")
    for kind, (least, most) in quantize.KINDS.items():
        got = {r.k: r for r in quantize.errors(quantize.quantise(df, ["k"], "v", kind), ["k"], "v").collect()}
        for k in (0, 1, 2, 3, 4, 5, None):
            x = np.array([v for i, row in rows if i == k for v in row if v is not None])
            low, high = min(x.min(initial=0), 0), max(x.max(initial=0), 0)
            scale = ((high - low) / 255 if kind == "uint8" else max(-low, high) / 127) or 1.0
            zero = np.clip(np.rint(-low / scale), 0, 255) if kind == "uint8" else 0
            back = (np.clip(np.rint(x / scale) + zero, least, most) - zero) * scale
            r = got[k]
            assert np.isclose(r.scale, scale) and r.zero == zero and r.n == len(x)
            if len(x):
                assert np.isclose(r.worst, np.abs(x - back).max(), atol=1e-12) and np.isclose(r.mean_square, ((x - back) ** 2).mean(), atol=1e-12)
                assert r.worst <= scale * 0.5 + 1e-9 or kind == "uint8"


def test_many_models_in_one_pass(spark):
    rng = np.random.default_rng(5)
    models = [("a", 1, 0.1), ("a", 2, 0.7), ("b", 5, -0.4), ("broken", 1, None), ("unused", 1, 0.2)]
    rows = [(n, v, scoring.small_model(np.full((3, 3), w)) if w is not None else b"bad") for n, v, w in models] + [("b", 9, None), (None, 1, b"")]
    registry = spark.createDataFrame(rows, "name string, version int, model binary")
    assert {r.name: r.version for r in scoring.newest(registry).collect()} == {"a": 2, "b": 5, "broken": 1, "unused": 1}
    assert {r.name: r.version for r in scoring.newest(registry, 1).collect()} == {"a": 1, "broken": 1, "unused": 1}
    tiles = [(name, (1 << 60) + n, h, 5, 1, rng.standard_normal(h * 5).astype(np.float32).tolist()) for n, (name, h) in enumerate([(name, h) for name in ("a", "b", "broken", "missing", None) for h in (4, 6, 4)])]
    df = spark.createDataFrame(tiles, "name string, n long, h int, w int, c int, image array<float>").repartition(3)
    got = {r.n: r for r in scoring.score_many(df, scoring.newest(registry), batch=2, per_task=2).collect()}
    assert len(got) == len(tiles)
    for name, n, h, w, _, image in tiles:
        r = got[n]
        assert r.name == name
        if name in ("missing", None):
            assert r.error == "no model" and r.prob is None and r.version is None
        elif name == "broken":
            assert r.error and r.error != "no model" and r.prob is None
        else:
            weight = {"a": 0.7, "b": -0.4}[name]
            want = run(scoring.small_model(np.full((3, 3), weight)), np.array(image, np.float32).reshape(1, 1, h, w))
            assert np.allclose(r.prob, want.ravel(), atol=1e-6) and r.error is None and r.version == {"a": 2, "b": 5}[name]
