from pyspark.sql import functions as F

from marlgate.functions import geometry as G

BOX = "x0 double, y0 double, x1 double, y1 double"


def _pair(spark, a, b, make):
    names = [f"{p}{c}" for p in ("a_", "b_") for c in ("x0", "y0", "x1", "y1")]
    return spark.createDataFrame([(*a, *b)], ", ".join(f"{n} double" for n in names)).select(make().alias("v")).first()["v"]


def test_containment_margin_and_nulls(spark):
    inner, outer = (97.0, 10.0, 200.0, 20.0), (100.0, 10.0, 200.0, 20.0)
    assert _pair(spark, inner, outer, lambda: G.inside("a_", "b_", 5))
    assert not _pair(spark, inner, outer, lambda: G.inside("a_", "b_"))
    assert not _pair(spark, (None, 0.0, 1.0, 1.0), outer, lambda: G.inside("a_", "b_", 5))


def test_caption_score(spark):
    figure = (100.0, 100.0, 500.0, 300.0)
    assert _pair(spark, figure, (100.0, 300.0, 500.0, 330.0), lambda: G.caption_score("a_", "b_")) == 0
    assert abs(_pair(spark, figure, (100.0, 310.0, 500.0, 330.0), lambda: G.caption_score("a_", "b_")) - 0.97) < 1e-9
    assert _pair(spark, (5.0, 5.0, 5.0, 9.0), (5.0, 300.0, 9.0, 330.0), lambda: G.caption_score("a_", "b_")) == 0


def test_overlap(spark):
    assert _pair(spark, (0.0, 0.0, 10.0, 1.0), (5.0, 2.0, 9.0, 3.0), lambda: G.horizontal_overlap("a_", "b_")) == 1.0
    assert _pair(spark, (0.0, 0.0, 1.0, 1.0), (5.0, 2.0, 9.0, 3.0), lambda: G.horizontal_overlap("a_", "b_")) == 0.0


def test_word_box_and_dimensions(spark):
    df = spark.createDataFrame([("abcdefghij", 0.0, 0.0, 100.0, 20.0), ("", 0.0, 0.0, 0.0, 20.0), ("x", None, 0.0, 1.0, 1.0)], f"t string, {BOX}")
    rows = df.select(G.word_box(F.col("t"), F.lit(2), F.lit(4)).alias("b"), G.dimensions().alias("d")).collect()
    assert [round(v, 6) for v in rows[0]["b"]] == [19.0, -1.0, 41.0, 21.0]
    assert list(rows[1]["b"]) == [0.0, 0.0, 0.0, 20.0] and rows[1]["d"] is None and rows[2]["b"] is None
    assert tuple(rows[0]["d"]) == (100.0, 20.0, 2000.0)


def test_normalized_boxes(spark):
    rows = [([1.0, 2.0, 3.0, 4.0], None), (None, [[5.0, 1.0], [9.0, 2.0], [8.0, 7.0], [4.0, 6.0]]), ([1.0], None), (None, None)]
    df = spark.createDataFrame(rows, "b array<double>, p array<array<double>>").select(G.normalize_box(F.col("b"), F.col("p")).alias("v"))
    assert [list(r["v"]) for r in df.collect()] == [[1.0, 2.0, 3.0, 4.0], [4.0, 1.0, 9.0, 7.0], [], []]
