import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeloom.functions import text as t
from citeloom.operators import metrics


def test_confusion_is_dense_and_accuracy_counts_all_pairs(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (9, 1), (2, None)], "a int, b int")
    m = {(r[0], r[1]): r[2] for r in metrics.confusion(df, "a", "b").collect()}
    assert len(m) == 16 and sum(m.values()) == 3 and m[0, 1] == 1
    one = metrics.macro_metrics(df, "a", "b").first()
    assert one["accuracy"] == pytest.approx(2 / 5) and one["macro_precision"] == pytest.approx((1 + 0.5) / 4)
    empty = metrics.macro_metrics(df.limit(0), "a", "b").first()
    assert empty["accuracy"] == 0 and empty["macro_f1"] == 0


def test_two_reference_demo(spark):
    """Two references of which the second's title and venue differ: the golden figures of soft matching."""
    rows = [
        ("Attention is all you need", "Attention Is All You Need.", ["A Vaswani", "N Shazeer", "N Parmar"], ["A Vaswani", "N Shazeer", "N Parmar"], "2017", "2017", "NIPS", "nips"),
        ("Deep residual learning", "Deep learning", ["K He", "X Zhang", "S Ren"], ["K He", "X Zhang"], "2016", "June 2016", "CVPR", "Proceedings of CVPR"),
    ]
    df = spark.createDataFrame(rows, "ta string, tb string, aa array<string>, ab array<string>, ya string, yb string, va string, vb string")
    yes = F.lit(True)
    f = {"title": (yes, yes, t.soft_match(F.col("ta"), F.col("tb"))), "authors": (yes, yes, t.author_match(F.col("aa"), F.col("ab"))), "year": (yes, yes, t.year_match(F.col("ya"), F.col("yb"))), "venue": (yes, yes, t.soft_match(F.col("va"), F.col("vb")))}
    got = {r["field"]: (r["precision"], r["recall"], round(r["f1"], 4), r["accuracy"]) for r in metrics.field_scores(metrics.field_counts(df, f)).collect()}
    assert got["title"] == got["authors"] == got["venue"] == (0.5, 1.0, 0.6667, 0.5) and got["year"] == (1.0, 1.0, 1.0, 1.0)
    macro = [sum(v[i] for v in got.values()) / 4 for i in range(4)]
    assert [round(x, 3) for x in macro] == [0.625, 1.0, 0.75, 0.625]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10), st.booleans()), min_size=2, max_size=30))
def test_auc_equals_pair_counting(spark, pairs):
    df = spark.createDataFrame([(s / 10, p) for s, p in pairs], "s double, p boolean")
    pos, neg = [s for s, p in pairs if p], [s for s, p in pairs if not p]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else 0.0
    assert metrics.auc(df, "s", F.col("p")).first()["auc"] == pytest.approx(want)


def test_perfect_and_chance_kappa(spark):
    same = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "a int, b int")
    assert metrics.kappa(same, "a", "b").first()["kappa"] == pytest.approx(1.0)
    chance = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1)], "a int, b int")
    assert metrics.kappa(chance, "a", "b").first()["kappa"] == pytest.approx(0.0)
