"""Facts that the metrics and weights must reproduce."""

from cairn.operators import metrics as M


def frame(spark, y, s):
    return spark.createDataFrame(list(zip(y, s, strict=True)), "y int, score double")


def test_perfect_and_tied_scores(spark):
    for s, roc, pr in (([0.1, 0.2, 0.8, 0.9], 1.0, 1.0), ([1.0] * 4, 0.5, 0.5)):
        rows = frame(spark, [0, 0, 1, 1], s)
        assert M.auroc(rows, []).first().auroc == roc
        assert M.auprc(rows, []).first().auprc == pr


def test_single_class_is_undefined(spark):
    assert M.auroc(frame(spark, [1, 1], [0.1, 0.2]), []).first().auroc is None


def test_macro_f1(spark):
    rows = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (2, 2)], "y int, hit int")
    got = M.macro_f1(M.confusion(rows, [], "y", "hit"), 3).first()
    assert abs(got.macro_f1 - (1 + 2 / 3 + 2 / 3) / 3) < 1e-12


def test_weights_keep_class_mass(spark):
    data = [(0, "a")] * 4 + [(0, "b")] * 2 + [(1, "t")] * 2 + [(2, "g")] + [(2, "h")] * 3
    rows = spark.createDataFrame(data, "y int, g string")
    got = M.balanced_weights(rows, "y", "g", masses={0: 0.5, 1: 0.25, 2: 0.25}).groupBy("y").agg({"weight": "sum"}).collect()
    assert {r.y: round(r[1], 9) for r in got} == {0: 0.5, 1: 0.25, 2: 0.25}
