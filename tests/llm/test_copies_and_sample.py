import itertools
import random

import pytest
from pyspark.sql import functions as F

from citeloom.llm import format_copies, quota_sample


def found(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, a string, b string, x map<string,string>")
    return {(r["first_id"], r["copy_id"], r["n_copies"]) for r in format_copies.copies(df, "id", ["a", "b"], ("x",), ("a",)).collect()}


def test_copies(spark):
    rows = [
        (5, "Deep-Learning!", None, {"p": "1--2"}), (2, "deep learning", "", {"p": "1 2", "q": "--"}), (9, "DEEP  LEARNING", "?", {"p": "12"}), (1, "deep learnings", None, {"p": "12"}),
        (3, "learning deep", None, {"p": "12"}), (4, "deep learning", None, {"r": "12"}), (6, None, None, None), (7, "", " ", {}), (None, "deep learning", None, {"p": "12"}), (8, "Éa", "1", None), (10, "éA", "1", {"k": None}),
    ]
    assert found(spark, rows) == {(2, 5, 3), (2, 9, 3), (6, 7, 2), (8, 10, 2)}
    assert found(spark, []) == set()


def test_copies_of_a_hot_record_and_long_text(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 2000, F.concat(F.lit("Hot "), F.repeat(F.lit("-"), (F.col("id") % 5).cast("int")))).otherwise(F.repeat(F.col("id").cast("string"), 500)).alias("a"))
    got = format_copies.copies(df, "id", ["a"])
    assert got.count() == 1999 and got.where("first_id <> 0 or n_copies <> 2000").count() == 0


def targets(*rows):
    return [{"id": i, "labels": lab, "share": s, "sample_size": n, "min_rows": m} for i, lab, s, n, m in rows]


def test_flow_meets_targets_and_exposes_shortfalls():
    cells = {("1", "A"): 100, ("1", None): 5, ("0", "A"): 30, ("0", "B"): 2}
    t = targets((1, ("1", None), 0.5, 100, 0), (2, ("0", "A"), 0.4, 100, 0), (3, ("0", "B"), 0.1, 100, 12))
    quota, short = quota_sample.quotas(cells, t, seed=3)
    assert short == {1: 0, 2: 10, 3: 10}
    assert sum(q for (k, _), q in quota.items() if k == 1) == 50 and quota[2, ("0", "A")] == 30
    assert quota[1, ("1", "A")] in (47, 48) and all(q <= cells[c] for (_, c), q in quota.items())
    assert quota_sample.shortfalls({}, t) == {1: 50, 2: 40, 3: 12}
    assert quota_sample.needs(targets((1, (None,), 0.1, 10, 0), (2, (None,), 0.30000001, 10, 0), (3, (None,), None, None, None))) == {1: 1, 2: 3, 3: 0}


@pytest.mark.parametrize("sizes, need", [((890, 110), 10), ((500, 495, 5), 100), ((400, 590, 10), 10), ((1, 1, 1), 2), ((7,), 3), ((0, 5), 5)])
def test_rounding_is_unbiased(sizes, need):
    """Over many seeds the mean quota of every cell is its share; a whole share never changes; no quota is a row off."""
    cells = {(str(i),): n for i, n in enumerate(sizes)}
    seeds = 600
    mean = dict.fromkeys(cells, 0.0)
    for seed in range(seeds):
        quota, short = quota_sample.quotas(cells, targets((1, (None,), 1, need, 0)), seed)
        assert sum(quota.values()) == need and short == {1: 0}
        for c, n in cells.items():
            share = need * n / sum(sizes)
            assert abs(quota.get((1, c), 0) - share) < 1
            mean[c] += quota.get((1, c), 0) / seeds
    for c, n in cells.items():
        assert abs(mean[c] - need * n / sum(sizes)) < 0.1


def test_flow_is_optimal_on_shared_cells():
    """Two targets share a cell: the total shortfall is the least that any assignment leaves."""
    rnd = random.Random(2)
    for _ in range(20):
        cells = {(a, b): rnd.randint(0, 6) for a in "01" for b in "AB"}
        t = targets((1, ("0", None), 1, rnd.randint(0, 9), 0), (2, (None, "A"), 1, rnd.randint(0, 9), 0))
        _, short = quota_sample.quotas(cells, t)
        need = quota_sample.needs(t)
        best = min(max(need[1] - x - cells["0", "B"], 0) + max(need[2] - (cells["0", "A"] - x) - cells["1", "A"], 0) for x in range(cells["0", "A"] + 1))
        assert sum(short.values()) == best


def test_drawn_rows(spark):
    rows = [(f"i{i}", "x" if i % 3 else " X ", 1) for i in range(300)] + [("i0", "x", 2), (None, "x", 1), ("n", None, 1)]
    t = targets((1, ("X",), 0.5, 200, 0))
    cells = quota_sample.cell_rows(spark.createDataFrame(rows, "id string, lab string, at int"), "id", ["lab"], t, "at")
    counts = quota_sample.cell_counts(cells, 1)
    assert counts == {("X",): 300, (None,): 1}
    q = {("s", k, c): n for (k, c), n in quota_sample.quotas(counts, t)[0].items()}
    one = [r["id"] for r in quota_sample.draw(cells, 1, q, 1).collect()]
    assert len(one) == len(set(one)) == 100 and set(one) == {r["id"] for r in quota_sample.draw(cells, 1, q, 1).collect()}
    assert set(one) != {r["id"] for r in quota_sample.draw(cells, 1, q, 2).collect()}
    assert quota_sample.draw(cells, 1, {}, 1).count() == 0


@pytest.mark.parametrize("a, b", itertools.combinations(["META_ERROR_DOI", " meta error doi", "Meta-Error-Doi "], 2))
def test_labels_agree(a, b):
    assert quota_sample.plain_label(a) == quota_sample.plain_label(b)
