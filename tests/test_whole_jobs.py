"""Queries that must take in all rows, on small tables of their own."""

from datetime import datetime

from citeloom.operators import curate
from citeloom.plans import QUERIES

AT = datetime(2024, 1, 1)

INSTANCE = "instance_id string, original_paper string, claim_text string, surrounding_context string, loaded_at timestamp_ntz, true_outputs struct<true_alignment:int>, citation_metadata struct<authors:array<string>>"


def write(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")


def test_smp05_combines_every_row_of_every_label_in_proportion(spark, tmp_path):
    rows = [(f"i{k:03}", "p", "c", None, AT, (0 if k % 3 else 1,), None) for k in range(150)] + [("z", "p", "c", None, AT, (None,), None)]
    write(spark, tmp_path, "instances", rows, INSTANCE)
    out = QUERIES["smp05_combined"](spark, str(tmp_path)).orderBy("slot").collect()
    assert [r["slot"] for r in out] == list(range(1, 152)) and {r["instance_id"] for r in out} == {r[0] for r in rows}
    labels = [r["label"] for r in out]
    assert labels[:75].count(1) in (24, 25, 26)


def test_smp04_repeats_the_pool_until_the_target_is_reached(spark, tmp_path):
    papers = ["a"] * 5 + ["b", "c", "d"]
    write(spark, tmp_path, "instances", [(f"i{k}", p, "c", None, AT, None, None) for k, p in enumerate(papers)], INSTANCE)
    out = QUERIES["smp04_cycled"](spark, str(tmp_path)).orderBy("position").collect()
    order = [r["original_paper"] for r in out]
    assert [r["position"] for r in out] == list(range(1, 25)) and sorted(order[:4]) == list("abcd") and order == order[:4] * 6
    small = spark.createDataFrame([(k,) for k in range(4)], "k int")
    for n in (0, 3, 4, 6):
        got = curate.cycle(small, ["k"], spark.createDataFrame([(n,)], "n bigint")).orderBy("position").collect()
        assert [(r["k"], r["position"]) for r in got] == [(j % 4, j + 1) for j in range(n)]


def test_ret05_searches_with_both_queries_and_dedups(spark, tmp_path):
    import hashlib

    key = next(f"i{k}" for k in range(999) if int(hashlib.md5(f"i{k}".encode()).hexdigest()[:6], 16) % 20 == 0)
    write(spark, tmp_path, "instances", [(key, "p", "plasma waves", "plasma storms", AT, None, None)], INSTANCE)
    refs = [(1, "p", "storms at sea"), (2, "p", "waves on plasma"), (3, "p", "plasma lamps"), (4, "p", "plasma lamps"), (5, "q", "plasma waves"), (6, "p", "tides")]
    write(spark, tmp_path, "bib_references", refs, "ref_id bigint, paper_id string, title string")
    out = QUERIES["ret05_searched"](spark, str(tmp_path)).orderBy("place").collect()
    assert [(r["cid"], r["query_no"], r["place"]) for r in out] == [(2, 0, 1), (3, 0, 2), (1, 1, 3)]


def test_j09_aligns_by_position_and_keeps_the_truth(spark, tmp_path):
    rows = [("a", "p", "c", None, AT, None, (["x", "y", "z"],)), ("b", "p", "c", None, AT, None, (["u"],))]
    write(spark, tmp_path, "instances", rows, INSTANCE)
    states = [("a", AT, AT, (["old"],)), ("a", AT.replace(year=2025), AT, (["x", "q"],)), ("c", AT, AT, (["v"],))]
    write(spark, tmp_path, "verification_instances", states, "instance_id string, event_ts timestamp_ntz, loaded_at timestamp_ntz, extracted_citation struct<authors:array<string>>")
    out = {tuple(r) for r in QUERIES["j09_aligned"](spark, str(tmp_path)).collect()}
    assert out == {("a", 1, "x", "x"), ("a", 2, "y", "q"), ("a", 3, "z", None), ("b", 1, "u", None)}


def test_smp02_places_every_paper_once(spark, tmp_path):
    write(spark, tmp_path, "papers", [(k,) for k in range(40)], "crawl_no bigint")
    out = QUERIES["smp02_placed"](spark, str(tmp_path)).orderBy("place").collect()
    assert [r["place"] for r in out] == list(range(1, 41)) and sorted(r["crawl_no"] for r in out) == list(range(40)) != [r["crawl_no"] for r in out]
