"""Sources, sinks, image functions, groups and streams against small brute-force versions."""

import json
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest

from cairn.functions import pixels as P
from cairn.operators import duplicates as D
from cairn.operators import sampling as S
from cairn.sources import manifests as M
from cairn.sources import sinks as K
from cairn.streaming import events as E


def png(path, a):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    h, w = a.shape[:2]
    rows = b"".join(b"\0" + a[i].tobytes() for i in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def test_duplicate_groups_equal_union_find(spark):
    draw = random.Random(5)
    rows = [(i, f"s{draw.randrange(40)}" if draw.random() < 0.4 else f"own{i}", draw.choice([0, None, draw.getrandbits(12)]), draw.choice(["", None, f"g{draw.randrange(15)}"])) for i in range(150)]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            near = a[2] and b[2] and (a[2] ^ b[2]).bit_count() <= 1
            if a[1] == b[1] or (a[3] and a[3] == b[3]) or near:
                parent[find(j)] = find(i)
    top = {}
    for i in range(len(rows)):
        top[find(i)] = max(i, top.get(find(i), 0))
    number = {r: k for k, r in enumerate(sorted(top.values()))}
    want = {i: f"duplicate_{number[top[find(i)]]:08d}" for i in range(len(rows))}
    df = spark.createDataFrame(rows, "id long, sha string, h long, src string")
    got = D.duplicate_groups(df, "id", "sha", "h", "src", 1, 12).collect()
    assert {r.id: r.duplicate_group for r in got} == want
    assert D.duplicate_groups(df.limit(0), "id", "sha", "h", "src").count() == 0


def test_long_chain_is_one_group(spark):
    edges = spark.range(300).selectExpr("id as a", "id + 1 as b")
    assert {(r.node, r.root) for r in D.components(edges).collect()} == {(i, 300) for i in range(301)}


def test_weighted_draws_follow_weights(spark):
    rows = spark.createDataFrame([(0, 1), (1, None), (2, 3), (3, 0), (4, -2)], "o long, w int")
    got = [r.o for r in S.weighted_draws(rows, "o", "w", 4000, 1, world=3).collect()]
    assert len(got) == 4002 and set(got) == {0, 2} and abs(got.count(2) / len(got) - 0.75) < 0.04
    assert S.weighted_draws(rows.where("o = 1"), "o", "w", 10, 1).count() == 0


def test_pixel_functions(spark, tmp_path):
    draw = np.random.default_rng(1)
    a = draw.integers(0, 256, (40, 60, 3), dtype=np.uint8)
    ramp = np.repeat(np.tile(np.arange(36, dtype=np.uint8)[None, ::-1, None] * 7, (32, 1, 1)), 3, axis=2)
    assert P.difference_hash(ramp) == (1 << 64) - 1 and P.difference_hash(ramp[:, ::-1]) == 0
    assert (P.resize(np.full((9, 11), 77, np.uint8), 5, 30, "lanczos") == 77).all()
    assert np.allclose(P.resize(a[:, :, 0], 4, 6, "box"), a[:, :, 0].reshape(4, 10, 6, 10).mean((1, 3)), atol=1)
    assert (P.residuals(np.full((5, 5, 3), 255, np.uint8))[:, 1:-1, 1:-1] == 0.5).all()
    g = P.grey(a)
    assert abs(int(g[0, 0]) - round(a[0, 0] @ np.array([0.299, 0.587, 0.114]))) <= 1
    flat = P.radial_energy(np.full((16, 16, 3), 255, np.uint8))
    assert flat[2] > 0 and flat[0] == 0 and np.allclose(np.delete(flat, 2), 0)  # an even height puts the zero frequency off the centre
    for family, severity in [("blur", 1.0), ("resize", 0.5), ("noise", 0.05), ("color", 0.2), ("crop", 0.8)]:
        out = P.transformed(a, family, severity, 9)
        assert out.shape == a.shape and out.dtype == np.uint8 and (out == P.transformed(a, family, severity, 9)).all()
    with pytest.raises(ValueError):
        P.transformed(a, "halftone", 0.1, 1)
    mask = np.zeros((40, 60), np.uint8)
    mask[:3, :3] = 255
    top, left, h, w = P._window(40, 60, 0.5, np.random.default_rng(0), mask > 0, 1.0)
    assert top == 0 and left == 0 and (h, w) == (20, 30)
    png(tmp_path / "a.png", a)
    png(tmp_path / "b.PNG", ramp)
    (tmp_path / "broken.png").write_bytes(b"no picture")
    got = {r.path.rsplit("/", 1)[1]: r.dhash for r in P.difference_hashes(M.images(spark, str(tmp_path))).collect()}
    assert got["a.png"] % (1 << 64) == P.difference_hash(a) and got["b.PNG"] == -1 and got["broken.png"] is None
    assert {r.path.rsplit("/", 1)[1] for r in M.files(spark, str(tmp_path)).collect()} == {"a.png", "b.PNG", "broken.png"}
    have = spark.createDataFrame([("a.png", ""), ("gone.png", "m.png"), ("b.PNG", None)], "image_path string, tamper_mask_path string")
    assert tuple(M.missing_files(have, M.files(spark, str(tmp_path)), root=str(tmp_path)).first()) == (3, 1, 1)


def test_sources(spark, tmp_path):
    rows = [{"image_path": "a.png", "label": "real", "dataset": "d", "split": "other"}, {"image_path": "../x.png", "label": "ai", "dataset": "d", "split": "train"}]
    (tmp_path / "train.jsonl").write_text("\n".join(map(json.dumps, rows)))
    spark.createDataFrame([("p.png", "real", "e", 5)], "image_path string, label string, dataset string, more int").write.parquet(str(tmp_path / "test.parquet"))
    (tmp_path / "m.csv").write_text('image_path,label,dataset\n"a, b.png",1,d\n')
    assert M.load_manifest(spark, str(tmp_path / "m.csv"), required=M.REQUIRED).first().image_path == "a, b.png"
    for bad in (lambda: M.load_manifest(spark, "x.xml"), lambda: M.load_manifest(spark, str(tmp_path / "m.csv"), required=["no"])):
        with pytest.raises(ValueError):
            bad()
    both, missing = M.load_splits(spark, str(tmp_path))
    assert sorted(str((r.split, r.more)) for r in both.collect()) == ["('test', 5)", "('train', None)", "('train', None)"]
    assert missing == ["validation", "test_unseen", "calibration"]
    good, bad = M.declared(both, "image_path", "dataset")
    assert good.count() == 2 and bad.first().reason == "unsafe_path"
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("b.txt", "two")
        z.writestr("a.txt", "one")
    (tmp_path / "y.zip").write_bytes(b"not an archive")
    got = M.zip_members(spark, str(tmp_path), ordinals=[0]).collect()
    assert sorted((r.member or "", bytes(r.content or b"")) for r in got) == [("", b""), ("a.txt", b"one")]
    assert both.select(M.first_field(both, ["no", "image_path"]).alias("x")).count() == 3
    with pytest.raises(KeyError):
        M.expand_environment({"a": ["${NOT_SET}"]}, {})
    assert M.expand_environment({"a": ["x ${B}"]}, {"B": "y"}) == {"a": ["x y"]}
    for start in (0, 2, 4):
        (tmp_path / f"page{start}.json").write_text(json.dumps({"rows": [{"row_idx": i, "row": {"v": i}} for i in range(start, start + 2)]}))
    spark.dataSource.register(M.PagedRows)
    read = spark.read.format("paged_rows").option("url", f"file://{tmp_path}/page{{offset}}.json").option("pagesize", 2)
    assert [r.row_idx for r in read.option("rows", "1,4").load().orderBy("row_idx").collect()] == [1, 4]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("d", "real", "train"), ("d", None, "test"), ("e", "ai", "train")], "dataset string, label string, split string")
    gone = spark.createDataFrame([("d", "unsafe_path")], "dataset string, reason string")
    K.write_package(rows, gone, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p/splits")).where("split = 'train'").count() == 2
    report = K.audit(rows, gone)
    assert report["rows"] == 3 and report["dataset"] == {"d": 2, "e": 1} and report["label"] == {"real": 1, "None": 1, "ai": 1} and report["reasons"] == {"unsafe_path": 1}
    K.write_report(str(tmp_path / "r/report.json"), report)
    assert json.loads((tmp_path / "r/report.json").read_text())["excluded"] == 1 and len(list((tmp_path / "r").iterdir())) == 1
    K.write_predictions(spark.createDataFrame([(1, 0.12345678)], "id int, score double"), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first().score == 0.123457
    old = spark.createDataFrame([("a", "float32", "x/a.onnx"), ("b", "int8", "x/b.onnx"), ("fam-1", "float32", "x/f.onnx")], "id string, quantization string, path string")
    new = spark.createDataFrame([("fam-2", "float32", "n/f2.onnx")], old.schema)
    got = K.upsert_catalogue(old, new, "fam-", "https://host/m/", 2).collect()
    assert [(r.id, r.path) for r in got] == [("a", "https://host/m/a.onnx"), ("fam-2", "n/f2.onnx")]
    with pytest.raises(Exception, match="expected 3 entries"):
        K.upsert_catalogue(old, new, "fam-", "https://host/m/", 3).collect()


def test_streams_equal_batches(spark, tmp_path):
    for i, part in enumerate([[(1, "2024-01-01 00:10:00", 7, 1.5), (2, "2024-01-01 00:20:00", 7, 2.5)], [(2, "2024-01-01 00:20:00", 7, 2.5), (3, "2024-01-01 01:00:00", 8, None), (4, "2024-01-01 00:30:00", 7, 3.0)]]):
        df = spark.createDataFrame([(e, t, u, "k", v) for e, t, u, v in part], "event_id long, t string, user_id long, event_type string, value double").selectExpr("event_id", "cast(t as timestamp) as ts", "user_id", "event_type", "value")
        df.coalesce(1).write.mode("append" if i else "error").parquet(str(tmp_path / "events.parquet"))
    stream = E.event_stream(spark, str(tmp_path), files_a_trigger=1)
    got = E.run_available(E.windowed_counts(stream), "test-windows", ["start", "event_type"]).collect()
    assert sorted((str(r.start), r.n, r.total) for r in got) == [("2024-01-01 00:00:00", 3, 7.0), ("2024-01-01 01:00:00", 1, None)]
    one = E.event_stream(spark, str(tmp_path), files_a_trigger=10).dropDuplicates(["event_id"])
    got = E.run_available(E.moving_average(one, decay=0.5), "test-average", ["user_id"]).collect()
    want = {7: (0.5 * (0.5 * 1.5 + 0.5 * 2.5) + 0.5 * 3.0, 3), 8: (None, 0)}
    assert {r.user_id: (r.average, r.n) for r in got} == want
