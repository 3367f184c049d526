"""Guards that must raise, selections on small tables, and sources and sinks added to them."""

import pytest
from pyspark.sql import functions as F

from cairn.functions import exprs as X
from cairn.functions import losses as L
from cairn.operators import curate as C
from cairn.operators import guards as G
from cairn.operators import select as S
from cairn.sources import manifests as M
from cairn.sources import sinks as K


def table(spark, rows, kind):
    return spark.createDataFrame(rows, kind)


def test_guards_raise(spark):
    rows = table(spark, [(1, "a", "train", "f1", "aigc", "x/y.png"), (2, "a", "test", "f2", "aigc", "x/z.png"), (3, None, "train", "f2", "real", "x"), (4, None, "test_unseen", "f1", "aigc", "organizer demo")], "id long, duplicate_group string, split string, generator_family string, label string, path string")
    synthetic = F.col("label") == "aigc"
    for bad in (
        lambda: G.no_group_leakage(rows), lambda: G.unseen_families_absent(rows, synthetic), lambda: G.splits_within(rows, ["train"]), lambda: G.exact_size(rows, 3), lambda: G.not_empty(rows.limit(0)),
        lambda: G.disjoint(rows, ["generator_family"], F.col("split") == "train", F.col("split") == "test"), lambda: G.validation_rows(rows), lambda: G.forbidden_absent(rows.withColumn("split", F.lit("train")), ["path"]),
        lambda: G.partitioned(rows, rows.limit(2), rows.limit(0), "id"), lambda: G.one_destination(rows, "duplicate_group", ["id"]), lambda: G.one_destination(rows, "id", ["path"], workers=33),
        lambda: G.looked_up(rows, table(spark, [("a", 1)], "duplicate_group string, n int"), "duplicate_group"), lambda: G.same_identity({"batch_size": 2}, {"batch_size": 4}), lambda: G.evaluation_contract({"x_sha256": "12"}),
        lambda: G.evaluation_contract({"threshold": 1.5}), lambda: G.promotion_claim({"promoted": True}), lambda: G.artifact_variant((3, 4), {(3, 5): "small"}, None), lambda: G.artifact_variant((3, 5), {(3, 5): "small"}, "base"), lambda: G.checkpoint_eligible("runs/bakeoff/a.pt"),
    ):
        with pytest.raises(G.Refused):
            bad()


def test_guards_pass(spark):
    rows = table(spark, [(1, "a", "train"), (2, "b", "validation")], "id long, duplicate_group string, split string")
    assert G.validation_rows(G.no_group_leakage(rows)).count() == 1
    assert G.one_destination(rows.unionAll(rows), "id", ["split"], 32).count() == 2
    G.partitioned(rows, rows.limit(1), rows.join(rows.limit(1), "id", "left_anti"), "id")
    assert G.teacher_report({"passed": True, "checkpoint_sha256": "s", "manifest_digest": "d", "metrics": {"clean": 1, "mean": 1, "worst": 1, "calibrated": {}}}, "s", "d") == ["missing_calibrated"]
    assert G.artifact_variant((3, 5), {(3, 5): "small"}, "small") == "small" and G.evaluation_contract({"a_sha256": "0" * 64, "threshold": 0})


def test_rows_without_a_group_stay(spark):
    rows = table(spark, [(1, "g", "train"), (2, "g", "test"), (3, None, "test_unseen"), (4, None, "train")], "id long, g string, split string")
    assert {r.id: r.split for r in C.unify_splits(rows, "g").collect()} == {1: "test", 2: "test", 3: "test_unseen", 4: "train"}
    marked = rows.withColumns({"f": F.lit("fam"), "syn": F.lit(True)})
    assert {r.id: r.split for r in C.relabel_unseen(marked, "g", "f", F.col("syn")).collect()} == {1: "train", 2: "test", 3: "test_seen", 4: "train"}
    assert {r.id for r in C.first_flags(rows, "g", "id").where("is_first").collect()} == {1, 3, 4}


def test_long_digits_and_the_forced_family(spark):
    row = table(spark, [("x_123456789012345678901234", "99999999999", "aigc", "adm", "DIRE")], "e string, number string, label string, family string, dataset string")
    c = F.col
    got = row.select(X.source_index_strict(c("e"), F.lit("")).alias("i"), X.provenance_code(c("number"), F.lit("")).alias("p"), X.first_split(F.lit("train"), c("label"), F.lit("dalle_2"), c("dataset")).alias("held"), X.first_split(F.lit("test"), c("label"), c("family"), c("dataset")).alias("forced")).first()
    assert tuple(got) == (None, None, "test_unseen", "test")
    with pytest.raises(Exception, match="unknown label"):
        row.select(X.provenance_code(c("number"), F.lit(""), strict=True)).collect()
    with pytest.raises(Exception, match="classes expected"):
        row.select(X.positive_probability(F.array(F.lit(0.1)))).collect()
    assert X.milestones(10, [0.0, 0.25, 1.0]) == [1, 3, 10]


def test_calibration_fills_and_fails(spark):
    kinds = ["authentic"] * 12 + ["tampered"] * 3 + ["fully_aigc"] * 4 + ["edited"] * 9
    rows = table(spark, [(str(i), f"d{i}", f"s{i}", "", k, int(k != "authentic")) for i, k in enumerate(kinds)] + [("90", "d0x", "same", "", "tampered", 1), ("91", "d1x", "same", "", "tampered", 1), ("92", "d2x", "s92", "src", "tampered", 1), ("93", "d3x", "s93", "src", "tampered", 1)], "row_id string, duplicate_group string, sha256 string, source_image_group string, provenance string, ai_positive int")
    got = S.calibration(rows, 20).collect()
    count = lambda k: sum(r.provenance == k for r in got)
    assert len(got) == 20 and count("authentic") == 10 and count("tampered") == 3 and count("fully_aigc") == 4 and count("edited") == 3
    assert not {r.row_id for r in got} & {"90", "91", "92", "93"} and {r.split for r in got} == {"calibration"}
    assert len(S.calibration(rows, 28).collect()) == 28
    with pytest.raises(G.Refused):
        S.calibration(rows, 29)


def test_coverage_of_few_rows(spark):
    few = spark.range(2).withColumnRenamed("id", "row")
    got = S.coverage_shards(few, "row", 5).collect()
    assert sorted(r["rank"] for r in got) == [0, 1, 2, 3, 4] and {r.row for r in got} == {0, 1}
    assert S.coverage_shards(few.limit(0), "row", 5).count() == 0


def test_records_have_defaults(spark):
    rows = table(spark, [("2", "a\\b.png", "sid_set", "", "train")], "label string, image_path string, dataset string, generator string, split string")
    got = S.records(rows, ["image_path"], "train", "data").first()
    assert (got.label, got.ai_positive, got.image_path, got.generator_family, got.duplicate_group) == (1, 1, "data/a/b.png", "sid_set_unknown", got.row_id) and len(got.row_id) == 32
    with pytest.raises(Exception, match="expected split"):
        S.records(rows, ["image_path"], "test").collect()


def test_sources(spark, tmp_path):
    for n in ("b.JPG", "a.jpg", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert [r.length for r in M.files(spark, str(tmp_path), ["jpg"]).collect()] == [1, 1]
    got = M.expand_globs(spark, [f"{tmp_path}/*.txt", f"{tmp_path}/*.none"])
    assert got == [f"{tmp_path}/c.txt", f"{tmp_path}/*.none"]
    rows = table(spark, [("a",), ("b",), ("c",)], "member string")
    one, two = table(spark, [("a", "1/a")], "member string, path string"), table(spark, [("a", "2/a"), ("b", "2/b")], "member string, path string")
    assert {tuple(r) for r in M.probed(rows, [one, two], remote="http://x/").collect()} == {("a", "1/a", 0), ("b", "2/b", 1), ("c", "http://x/c", None)}
    kinds = table(spark, [(" ", None, [("p0", None), ("p1", b"z")], b"q"), ("u", None, None, None), (None, None, None, b"q")], "url string, image struct<bytes:binary,path:string>, pair array<struct<path:string,bytes:binary>>, data binary")
    assert [(r.image_path, r.image_bytes, r.image_from) for r in M.image_field(kinds, url_field="url", pair=("pair", 1)).collect()] == [(None, b"z", "pair"), ("u", None, "url"), (None, b"q", "data")]
    tasks = table(spark, [("a", 1), ("b", 2), ("c", 3)], "dataset string, id int")
    registry = table(spark, [("a", "zip"), ("b", "other")], "dataset string, source_type string")
    done = M.dispatched(tasks, registry, {"zip": lambda t: t.withColumn("status", F.lit("saved"))})
    assert {r.dataset: r.status for r in done.collect()} == {"a": "saved", "b": "error", "c": "error"}
    cache = table(spark, [("a", [1.0])], "dataset string, features array<double>")
    assert M.cached_features(tasks.where("id = 1"), cache, "dataset").first().features == [1.0]
    with pytest.raises(Exception, match="no single cached"):
        M.cached_features(tasks, cache, "dataset").collect()
    (tmp_path / ".env").write_text("# no\nexport A='1'\nB=2\n")
    (tmp_path / "deep").mkdir()
    assert M.find_environment(str(tmp_path / "deep")) == {"A": "1", "B": "2"}


def test_sinks(spark, tmp_path):
    path, me = str(tmp_path / "state.jsonl"), {"manifest": "m"}
    K.append_state(path, me, [{"id": 1}])
    K.append_state(path, me, [{"id": 2}])
    assert K.resume_state(path, me) == [{"id": 1}, {"id": 2}] and K.resume_state(path, {"manifest": "n"}) == []
    good = {"model_id": "m", "sha256": "0" * 64, "size_bytes": 1, "quantization": "int8", "input_size": 2, "calibrated_threshold": 0.5, "evaluation_status": "promoted"}
    assert K.contract("artifact", good) == good
    for change in ({"sha256": "1"}, {"size_bytes": 0}, {"input_size": True}, {"more": 1}, {"calibrated_threshold": 2.0}):
        with pytest.raises(G.Refused):
            K.contract("artifact", good | change)
    items = spark.range(3000).withColumn("n", F.lit(10))
    shards = {r.shard: r["count"] for r in K.in_shards(items, "id", "n", 1000).groupBy("shard").count().collect()}
    assert shards == {i: 100 for i in range(30)}
    rows = table(spark, [("a",), ("b",)], "dataset string")
    got = K.source_revisions(rows, table(spark, [("a", "r")], "dataset string, repository string"), table(spark, [("r", "v1")], "repository string, revision string"))
    assert {tuple(r) for r in got.collect()} == {("a", "r", "v1"), ("b", "local", "local_or_non_hf")}


def test_vector_pooling(spark):
    row = table(spark, [([[1.0, 2.0], [3.0, 6.0]], [0.0, 0.0])], "t array<array<double>>, s array<double>")
    p = L.pooled_vectors(F.col("t"), F.col("s"))
    got = row.select(*[v.alias(k) for k, v in p.items()]).first()
    assert got["mean"] == [2.0, 4.0] and got.deviation == [1.0, 2.0] and got.softmax_mean == [2.0, 4.0] and got.top_mean == [3.0, 6.0]
    assert row.select(L.consistency(F.col("t")[0], F.col("t")[1], "mse").alias("x")).first().x == 10.0
