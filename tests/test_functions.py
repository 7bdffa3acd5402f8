import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cartolith.functions import arrays as A
from cartolith.functions import geometry as G
from cartolith.functions import text as X
from cartolith.functions import time as Tm


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def lits(*v):
    return tuple(F.lit(float(x)) for x in v)


@pytest.mark.parametrize("label,folded", [("Office  Chairs", "office chair"), ("shelves", "shelf"), ("boxes", "box"), ("glass", "glass"), ("bus", "bus"), (None, "")])
def test_label_fold(spark, label, folded):
    assert one(spark, X.label_fold(F.lit(label).cast("string")))[0] == folded


@pytest.mark.parametrize("word,stem", [("couches", "couch"), ("Glass", "glass"), ("berries", "berry"), ("running", "runn"), ("red", "red"), ("used", "used"), ("plants", "plant")])
def test_stem(spark, word, stem):
    assert one(spark, X.stem(F.lit(word)))[0] == stem


def test_relevance_takes_the_first_tier(spark):
    q = X.terms(F.lit("chair by the whiteboard chair"))
    score = one(spark, X.relevance(q, F.array(F.lit("chair")), F.array(F.lit("board"))))[0]
    assert score == 3.0 + 0.5  # chair counts once; 'whiteboard' holds the context's 'board'


def test_text_rules(spark):
    r = one(
        spark, X.display_label(F.lit(" "), F.lit("desk")), X.without_measures(F.lit("about 2 m wide")), X.without_measures(F.lit(" by the door ")), X.extent_label(F.array(*lits(1, 3, 2))),
        X.first_number(F.lit("a/frame_12.50.png")), X.first_number(F.lit("a/none")), X.query_list(F.array(F.lit(" a"), F.lit("b"), F.lit("a"), F.lit("")), 2), X.caption(F.lit(""), F.lit("b"), F.lit(None).cast("string"), F.lit("c"), F.lit("q")),
        X.args_digest(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))), X.args_digest(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))),
    )
    assert list(r)[:8] == ["desk", None, "by the door", "3.00 × 2.00 × 1.00", 12.5, None, ["a", "b"], "b"] and r[8] == r[9] and len(r[8]) == 32


def test_geometry(spark):
    r = one(spark, G.angle(lits(1, 0, 0), lits(0, 0, 0), lits(0, 2, 0)), G.angle(lits(0, 0, 0), lits(0, 0, 0), lits(0, 2, 0)), G.wrapped(F.lit(3 * math.pi)), G.wrapped(F.lit(-math.pi)), G.distance(lits(1, 2, 3), lits(1, 2, 5)))
    assert r[0] == pytest.approx(90) and r[1] is None and r[2] == pytest.approx(math.pi) and r[3] == pytest.approx(math.pi) and r[4] == 2.0


@pytest.mark.parametrize("q", [(0.0, 0.0, 0.0, 1.0), (1.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0), (0.1, -0.7, 0.2, 0.3)])
def test_quaternion_round_trip(spark, q):
    n = math.sqrt(sum(x * x for x in q))
    m = G.matrix_of(*lits(*q))
    back, det = one(spark, G.quaternion_of(m), G.determinant(m))
    sign = 1 if sum(a * b for a, b in zip(back, q, strict=True)) > 0 else -1
    assert [sign * x * n for x in back] == pytest.approx(list(q), abs=1e-9) and det == pytest.approx(1)


def test_units_need_an_anchor(spark):
    ok = one(spark, G.metric_state(F.lit("anchor"), F.lit(0.5), F.lit("key")))[0]
    assert (ok.units, ok.scale, ok.metric_state) == ("m", 0.5, "metric")
    for args in (("edit", 0.5, "key"), ("anchor", -1.0, "key"), ("anchor", float("nan"), "key"), ("anchor", 0.5, " "), (None, None, None)):
        bad = one(spark, G.metric_state(F.lit(args[0]).cast("string"), F.lit(args[1]).cast("double"), F.lit(args[2]).cast("string")))[0]
        assert (bad.units, bad.scale, bad.scale_source, bad.metric_state) == ("scene units", 1.0, None, "up_to_scale")


def test_boxes_and_projection(spark):
    r = one(spark, G.corners(F.array(*lits(0, 0, 0)), F.array(*lits(2, 4, 6))), G.clipped_box(F.array(*lits(-5, 1, 3, 9)), F.lit(4.0), F.lit(4.0)), G.clipped_box(F.array(*lits(5, 1, 9, 9)), F.lit(4.0), F.lit(4.0)), *G.projected(lits(1, 2, 2), 10, 10, 5, 5), G.projected(lits(1, 2, -2), 10, 10, 5, 5)[0])
    assert len(r[0]) == 8 and r[0][0] == [-1.0, -2.0, -3.0] and r[0][7] == [1.0, 2.0, 3.0] and r[1] == [0.0, 1.0, 3.0, 4.0] and r[2] is None and list(r)[3:] == [10.0, 15.0, 2.0, None]


def test_voxel_key_is_clipped(spark):
    low, high = one(spark, G.voxel_key(lits(-9, 0, 0), (0, 0, 0), 1.0), G.voxel_key(lits(1e12, 0, 0), (0, 0, 0), 1.0))
    assert low == 0 and high == ((1 << 21) - 1) << 42


def test_run_lengths(spark):
    mask = [False, True, True, False, False, True]
    r = one(spark, A.rle_encode(F.array(*[F.lit(x) for x in mask])), A.rle_encode(F.array(F.lit(True), F.lit(True))), A.rle_area(F.array(*[F.lit(x) for x in (1, 2, 2, 1)])), A.rle_decode(F.array(F.lit(2), F.lit(3)), F.array(*[F.lit(x) for x in (1, 2, 2, 1)])), A.rle_decode(F.array(F.lit(2), F.lit(2)), F.array(F.lit(1))))
    assert list(r) == [[1, 2, 2, 1], [0, 2], 3, mask, None]


def test_vectors_and_maps(spark):
    z, v = F.array(*lits(0, 0)), F.array(*lits(3, 4))
    r = one(spark, A.cosine(z, v), A.cosine(v, v), A.euclid(z, v), A.percentile_of(F.array(*lits(1, 2, 3, 4, 10)), 0.25), A.merged(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))))
    assert list(r)[:4] == [0.0, pytest.approx(1.0), 5.0, 2.0] and r[4] == {"a": 1, "b": 3}


def test_time_rules(spark):
    now = F.lit("2024-01-02 00:00:01").cast("timestamp")
    r = one(spark, Tm.stale(F.lit("a"), F.lit("a"), F.lit("2024-01-01 00:00:00").cast("timestamp"), now), Tm.stale(F.lit("a"), F.lit("b"), now, now), Tm.stale(F.lit("a"), F.lit("a"), now, now), Tm.clamped_delay(F.lit(float("nan"))), Tm.clamped_delay(F.lit(9.0)), G.minutes_billed(F.lit(61.0)))
    assert list(r) == ["too old", "source changed", None, 0.12, 2.5, 50]


def test_row_type_is_kept(spark):
    assert isinstance(one(spark, F.lit(1)), Row)
