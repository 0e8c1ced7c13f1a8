"""Streams over several batches and restarts, kernels in the JVM against numpy, and the scan of model files."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from glyphflow.functions import geometry as g
from glyphflow.operators import raster
from glyphflow.plans import pages
from glyphflow.plans import workflow as W
from glyphflow.sources import charset, derived, images
from glyphflow.streaming import sessions

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import tests

SF = "/root/testdata/sf0.001"


def test_state_over_many_batches(spark, tmp_path):
    log = derived.session_log(spark, SF).orderBy("ts", "event_id").toPandas()
    want = {(x.session_id, x.event_id): (x.found, x.value) for x in sessions.replay(derived.session_log(spark, SF)).collect()}
    cuts = np.linspace(0, len(log), 5).astype(int)
    before = spark.conf.get(sessions.STATE_STORE[0])
    spark.conf.set(*sessions.STATE_STORE)
    try:
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):  # each part arrives after the query has stopped, and is one more batch
            spark.createDataFrame(log[a:b]).repartition(1).write.mode("append").parquet(str(tmp_path / "log"))
            s = spark.readStream.schema("session_id long, ts timestamp, event_id long, op string, payload string").parquet(str(tmp_path / "log"))
            w = sessions.stateful(s).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
            w.outputMode("append").trigger(availableNow=True).start().awaitTermination(300)
            assert spark.read.parquet(str(tmp_path / "out")).count() == b
    finally:
        spark.conf.set(sessions.STATE_STORE[0], before)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == len(want) and {(x.session_id, x.event_id): (x.found, x.value) for x in got} == want


class Name:
    def recognise(self, image, quad):
        return f"grey {int(image.mean())}", 1.0


def test_arriving_files_once(spark, tmp_path):
    W.STAGES["name"] = Name
    W.workflow("naming", detect="whole", recognise="name")
    engine, folder = W.Engine(W.with_workflow("naming")), tmp_path / "in"
    folder.mkdir()
    run = lambda: sessions.run_arriving(spark, engine, str(folder), str(tmp_path / "out"), str(tmp_path / "cp"), "*.png").awaitTermination(300)
    seen = lambda: sorted((r.key.split("/")[-1], r.status, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    put = lambda name, v: (folder / name).write_bytes(images.encode_png(np.full((4, 4, 3), v, np.uint8)))
    put("a.png", 10)
    (folder / "b.png").write_bytes(b"junk")
    run()
    assert seen() == [("a.png", 200, "grey 10"), ("b.png", 400, None)]
    put("c.png", 30)
    run()  # started anew from its checkpoint
    assert seen() == [("a.png", 200, "grey 10"), ("b.png", 400, None), ("c.png", 200, "grey 30")]
    # The last batch was written but never committed: it runs again and replaces what it wrote.
    last = max((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (last, last.parent / f".{last.name}.crc"):
        p.unlink(missing_ok=True)
    run()
    assert seen() == [("a.png", 200, "grey 10"), ("b.png", 400, None), ("c.png", 200, "grey 30")]


def test_jvm_kernels_equal_numpy(spark):
    for r in pages.QUERIES["bilinear_resize"](spark, SF).join(pages._pictures(spark, SF), "vec_id").limit(200).collect():
        a = raster.resize(np.array(r["cells"], np.uint8).reshape(8, 8, 1).repeat(3, axis=2), 12, 5)[..., 0].astype(int).ravel()
        assert (r.total, r.placed) == (a.sum(), (a * np.arange(1, 61)).sum())
    for r in pages.QUERIES["perspective_warp"](spark, SF).join(pages._pictures(spark, SF), "vec_id").limit(200).collect():
        a = raster.warp(np.array(r["cells"], np.uint8).reshape(8, 8, 1).repeat(3, axis=2), np.array(pages.WARPED, float), 10, 6)[..., 0].astype(int).ravel()
        assert (r.total, r.placed) == (a.sum(), (a * np.arange(1, 61)).sum())
    flat = spark.createDataFrame([(0.0, 0.0, 4.0, 4.0, 8.0, 8.0, 2.0, 2.0)], ", ".join(f"{c}{k} double" for k in range(4) for c in "xy"))
    m = g.from_square([(F.col(f"x{k}"), F.col(f"y{k}")) for k in range(4)])
    assert flat.select(g.to_square(m, F.lit(1.0), F.lit(2.0))[0].alias("u")).first().u is None


def test_homography_equals_elimination(spark):
    q = pages._quads(spark, SF).select("image_id", "box_id", g.ordered_corners(F.col("quad")).alias("q")).limit(300).collect()
    want = {}
    for r in q:
        p = np.array([(c["x"], c["y"]) for c in r.q], float)
        v = raster.homography(p, np.array([(0, 0), (100, 0), (100, 50), (0, 50)], float)) @ [*p.mean(axis=0), 1]
        want[r.image_id, r.box_id] = v[:2] / v[2]
    got = {(r.image_id, r.box_id): (r.x, r.y) for r in pages.QUERIES["homography"](spark, SF).collect()}
    assert all(np.allclose(got[k], v, atol=1e-4) for k, v in want.items())


def varint(v):
    out = b""
    while v > 127:
        out, v = out + bytes([v & 127 | 128]), v >> 7
    return out + bytes([v])


def field(n, body):
    return varint(n << 3 | 2) + varint(len(body)) + body


def entry(k, v):
    return field(14, field(1, k.encode()) + field(2, v.encode()))


def test_model_metadata(spark, tmp_path):
    tensor = field(7, b"\xff" * 3_000_000)  # far larger than the buffer, and no message
    model = b"\x08\x07" + entry("first", "1") + tensor + b"\x15abcd" + b"\x11abcdefgh" + entry("character", "A\nB\nC") + entry("", "x")
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(5).collect()]
    files = {
        "good.onnx": model, "docs.onnx": b"".join(entry(f"d{k}", t[:2000]) + tensor for k, t in enumerate(texts)), "empty.onnx": b"", "cut.onnx": entry("a", "b") + tensor[:1000],
        "long.onnx": entry("a", "b") + b"\xff" * 11, "group.onnx": b"\x0b", "large.onnx": entry("a", "x" * 5000),
    }
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    spark.dataSource.register(charset.ModelMetadata)
    got = spark.read.format("model_metadata").option("buffer", 4096).load(",".join(str(tmp_path / n) for n in [*files, "none.onnx"]))
    rows = {}
    for r in got.collect():
        rows.setdefault(r.path.split("/")[-1], []).append((r.key, r.value, r.error))
    assert rows["good.onnx"] == [("first", "1", None), ("character", "A\nB\nC", None), ("", "x", None)]
    assert rows["docs.onnx"] == [(f"d{k}", t[:2000], None) for k, t in enumerate(texts)] and "empty.onnx" not in rows
    assert rows["cut.onnx"] == [("a", "b", None), (None, None, "cut off")] and rows["long.onnx"][-1][2] == "overflow"
    assert rows["group.onnx"] == [(None, None, "wire type 3")] and rows["large.onnx"][-1][2] == "an entry of 5006 bytes" and rows["none.onnx"][0][2]
    with open(tmp_path / "good.onnx", "rb") as f:
        s = charset.Scanner(f, len(model), 4096)
        assert dict(s.pairs())["character"] == "A\nB\nC" and s.most_held <= 4096
    assert charset.ensure(str(tmp_path / "dict.txt"), str(tmp_path / "good.onnx")) == ["", "A", "B", "C", " "]
    with pytest.raises(ValueError):
        charset.ensure(str(tmp_path / "other.txt"), str(tmp_path / "empty.onnx"))
