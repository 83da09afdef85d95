import json

from citeloom.operators import drift

SCHEMA = "exporter string, file_seq int, record string"


def log(spark, files):
    rows = [("e", seq, json.dumps(r) if isinstance(r, dict) else r) for seq, recs in files.items() for r in recs]
    return {tuple(r)[1:] for r in drift.changes(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_rename_needs_equal_values_of_shared_records(spark):
    files = {1: [{"ID": "a", "x": "1", "z": 1}, {"ID": "b", "x": "2"}], 2: [{"ID": "a", "y": "1", "z": "1"}, {"ID": "b", "y": "2"}]}
    assert log(spark, files) == {(2, "renamed", "x", "y"), (2, "retyped", "z", "z")}
    files[2][1]["y"] = "3"
    assert log(spark, files) == {(2, "removed", "x", ""), (2, "added", "", "y"), (2, "retyped", "z", "z")}


def test_no_shared_record_no_rename_and_gaps_bring_no_changes(spark):
    assert log(spark, {1: [{"ID": "a", "x": 1}], 2: [{"ID": "b", "y": 1}]}) == {(2, "removed", "x", ""), (2, "added", "", "y")}
    assert log(spark, {1: [{"ID": "a", "x": 1}], 3: [{"ID": "a", "y": 1}]}) == set()


def test_repeats_count_once_and_ties_go_to_string(spark):
    files = {1: [{"ID": "a", "x": "s"}], 2: [{"ID": "a", "x": 1}, '{"x": 1, "ID": "a"}', {"ID": "b", "x": "s"}, {"ID": "c", "x": None}]}
    assert log(spark, files) == set()


def test_broken_null_and_empty(spark):
    assert log(spark, {1: ["{bad", "[1]", "", None], 2: [{"ID": "a", "X": 1}], 3: [{"ID": "a", "x": 1}]}) == {
        (2, "added", "", "ID"), (2, "added", "", "X"), (3, "renamed", "X", "x"),
    }
    assert drift.changes(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, 1, '{"a":1}'), ("e", None, '{"a":1}')]
    assert drift.changes(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_unify_routes_chained_renames_and_casts(spark):
    assert drift.compose([("abstractNote", "summary", 3), ("summary", "abstract", 2), ("url", "doi", 1)], list(drift.TARGET)) | {} == {
        **drift.compose([], list(drift.TARGET)), "summary": "abstractnote", "abstract": "abstractnote",
    }
    recs = [("e", 1, '{"ID":"a","howPublished":{"url":"http://u"},"year":"2020","odd":[1,2]}'), ("e", 2, '{"ID":"a","channel":"http://u","year":2020,"open_access":"yes"}'), ("e", 2, "{bad")]
    df = spark.createDataFrame(recs, SCHEMA)
    renames = spark.createDataFrame([("e", 2, "renamed", "howPublished", "channel")], "exporter string, file_seq int, change_type string, old_field string, new_field string")
    rows = {(r["file_seq"], r["howpublished"], r["year"], r["open_access"]) for r in drift.unify(df, renames, ["file_seq"]).collect()}
    assert rows == {(1, "http://u", 2020, None), (2, "http://u", 2020, True), (2, None, None, None)}
    assert drift.unify(df, renames, ["file_seq"]).where("file_seq = 1").first()["other_fields"] == {"odd": "[1,2]"}


def unified(spark, rows, steps, keep=("exporter", "file_seq")):
    df = spark.createDataFrame([(e, s, json.dumps(r)) for e, s, r in rows], SCHEMA)
    renames = spark.createDataFrame([(e, s, k, o, n) for e, s, k, o, n in steps], "exporter string, file_seq int, change_type string, old_field string, new_field string")
    return {tuple(r[k] for k in keep): r for r in drift.unify(df, renames, list(keep)).collect()}


def test_unify_lets_a_detected_rename_join_two_target_columns(spark):
    rows = [("e", 1, {"ID": "a", "eprinttype": "arxiv"}), ("e", 2, {"ID": "a", "archiveprefix": "arxiv"}), ("f", 1, {"ID": "b", "archivePrefix": "hal"})]
    out = unified(spark, rows, [("e", 2, "renamed", "eprinttype", "archiveprefix")])
    assert {k: (r["eprinttype"], r["archiveprefix"]) for k, r in out.items()} == {("e", 1): ("arxiv", None), ("e", 2): ("arxiv", None), ("f", 1): ("hal", None)}
    # columns that some record fills both stay two, but for the exporter whose log joins them
    out = unified(spark, [*rows, ("f", 2, {"eprinttype": "x", "archiveprefix": "y"})], [("e", 2, "renamed", "eprinttype", "archiveprefix")])
    assert {k: (r["eprinttype"], r["archiveprefix"]) for k, r in out.items()} == {("e", 1): ("arxiv", None), ("e", 2): ("arxiv", None), ("f", 1): (None, "hal"), ("f", 2): ("x", "y")}


def test_unify_routes_a_name_by_the_steps_of_its_own_exporter_and_file(spark):
    rows = [("e", 1, {"note": "n"}), ("e", 2, {"info": "n"}), ("f", 1, {"journal": "j"}), ("f", 2, {"info": "j"}), ("f", 4, {"info": "s"}), ("f", 5, {"series": "s"})]
    steps = [("e", 2, "renamed", "note", "info"), ("f", 2, "renamed", "journal", "info"), ("f", 3, "removed", "info", ""), ("f", 4, "added", "", "info"), ("f", 5, "renamed", "info", "series")]
    out = unified(spark, rows, steps)
    assert {k: (r["note"], r["journal"], r["series"]) for k, r in out.items()} == {
        ("e", 1): ("n", None, None), ("e", 2): ("n", None, None), ("f", 1): (None, "j", None), ("f", 2): (None, "j", None), ("f", 4): (None, None, "s"), ("f", 5): (None, None, "s"),
    }


def test_unify_loses_no_value(spark):
    rows = [("e", 1, {"note": "n", "remark": "m", "year": "n.d.", "volume": None}), ("e", 2, {"remark": "m", "open_access": "maybe"})]
    out = unified(spark, rows, [("e", 2, "renamed", "note", "remark")])
    assert out["e", 1]["note"] == "n" and out["e", 1]["other_fields"] == {"remark": "m", "year": "n.d."}
    assert out["e", 2]["note"] == "m" and out["e", 2]["other_fields"] == {"open_access": "maybe"}
