import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeloom.operators import curate, ranking


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 5000))
def test_folded_equals_the_loop(n, j):
    x = 0.0
    for _ in range(j):
        x += 1.0 / n
    assert ranking.folded(1.0 / n, j) == x


def test_ranks_of_hot_and_null_groups(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"), F.lit(1).alias("n"))
    rows = ranking.rank_within(df, ["g"], [F.desc("id")], "rk").collect()
    by = {}
    for r in rows:
        by.setdefault(r["g"], []).append((r["rk"], -r["id"]))
    assert len(rows) == 3000 and all([k for k, _ in sorted(v)] == list(range(1, len(v) + 1)) and sorted(v) == sorted(v, key=lambda x: x[1]) for v in by.values())
    assert sorted((r["pos"], r["id"]) for r in ranking.global_rank(df, ["id"], "pos").collect()) == [(i + 1, i) for i in range(3000)]
    assert all(r["before"] == r["id"] for r in ranking.running_sum(df, ["id"], "n", "before").collect())
    assert ranking.rank_within(df.limit(0), ["g"], ["id"], "rk").count() == 0


def test_interleave_like_the_loop(spark):
    rnd = random.Random(9)
    for _ in range(4):
        rows = [(i, rnd.choice(["x", "y", "z", None])) for i in range(rnd.randint(1, 60))]
        groups, order = {}, []
        for i, g in rows:
            if g not in groups:
                order.append(g)
            groups.setdefault(g, []).append(i)
        time = {g: 1.0 / len(v) for g, v in groups.items()}
        at, want = {g: 0 for g in groups}, []
        while len(want) < len(rows):
            g = min((g for g in order if at[g] < len(groups[g])), key=lambda g: (time[g], order.index(g)))
            want.append(groups[g][at[g]])
            at[g] += 1
            time[g] += 1.0 / len(groups[g])
        df = spark.createDataFrame(rows, "pos int, g string")
        assert [r["pos"] for r in curate.interleave(df, "g", ["pos"]).orderBy("slot").collect()] == want
