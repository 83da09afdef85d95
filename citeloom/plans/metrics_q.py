"""Queries: counts, confusion, field matching, error analysis and calibration of verdicts against instances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.functions import text as t
from citeloom.operators import metrics
from citeloom.operators.ranking import rank_within
from citeloom.plans.p_core import delivered
from citeloom.session import table


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each instance with a verdict: truth and the prediction of its latest state."""
    v = table(spark, sf_dir, "verification_instances", "instance_id", "event_ts", "loaded_at", "system_prediction", "extracted_citation")
    best = F.max(F.struct("event_ts", "loaded_at", F.struct("system_prediction", "extracted_citation").alias("p"))).alias("b")
    latest = v.groupBy("instance_id").agg(best).select("instance_id", F.col("b.p.system_prediction").alias("p"), F.col("b.p.extracted_citation").alias("x"))
    i = delivered(spark, sf_dir, "true_outputs", "citation_metadata")
    return i.join(latest, "instance_id").select(
        "instance_id",
        F.col("true_outputs.true_alignment").alias("truth"), F.col("true_outputs.true_existence").alias("exists_true"),
        F.col("p.alignment.label").alias("pred"), F.col("p.existence.label").alias("exists_pred"),
        F.col("p.alignment.confidence_score").alias("confidence"),
        F.col("citation_metadata").alias("m"), F.col("x"),
    )


VERDICTS = """WITH d AS (SELECT instance_id, true_outputs, citation_metadata FROM instances WHERE instance_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY loaded_at DESC) = 1),
l AS (SELECT instance_id, system_prediction AS p, extracted_citation AS x FROM verification_instances
  QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY event_ts DESC NULLS LAST, loaded_at DESC NULLS LAST) = 1),
v AS (SELECT d.instance_id, true_outputs.true_alignment AS truth, true_outputs.true_existence AS exists_true,
  p.alignment.label AS pred, p.existence.label AS exists_pred, p.alignment.confidence_score AS confidence, citation_metadata AS m, x
  FROM d JOIN l USING (instance_id))
"""


def agg01_label_counts(spark, d):
    return delivered(spark, d, "true_outputs").groupBy(F.col("true_outputs.true_alignment").alias("label")).agg(F.count("*").alias("n"))


def agg02_field_summary(spark, d):
    p = table(spark, d, "papers", "field", "arxiv_id")
    return p.groupBy("field").agg(F.count("*").alias("total"), F.count_if(~t.is_missing(F.col("arxiv_id"))).alias("with_arxiv"))


def agg03_confusion_dense(spark, d):
    return metrics.confusion(verdicts(spark, d).select("truth", "pred"), "truth", "pred")


def agg04_class_metrics(spark, d):
    m = metrics.class_metrics(agg03_confusion_dense(spark, d))
    return m.select("label", "tp", "fp", "fn", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def agg05_macro_metrics(spark, d):
    m = metrics.macro_metrics(verdicts(spark, d).select("truth", "pred"), "truth", "pred")
    return m.select(*[F.round(c, 6).alias(c) for c in ("macro_precision", "macro_recall", "macro_f1", "accuracy")], "pairs")


def _field_pairs():
    title = (F.col("m.title"), F.col("x.title"))
    venue = (F.col("m.venue"), F.col("x.venue"))
    year = (F.col("m.year").cast("string"), F.col("x.year").cast("string"))
    there = lambda c: ~t.is_missing(c)
    names = (F.col("m.authors"), F.col("x.authors"))
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    out = {}
    for method, match in (("strict", t.strict_match), ("soft", t.soft_match)):
        for name, (a, b) in (("title", title), ("venue", venue)):
            out[f"{name}|{method}"] = (there(a), there(b), match(a, b))
        out[f"year|{method}"] = (there(year[0]), there(year[1]), t.year_match(*year))
        same = F.coalesce(F.array_join(names[0], "|") == F.array_join(names[1], "|"), F.lit(False)) if method == "strict" else t.author_match(*names)
        out[f"authors|{method}"] = (has(names[0]), has(names[1]), same)
    return out


def _field_scores(spark, d):
    c = metrics.field_scores(metrics.field_counts(verdicts(spark, d).select("m", "x"), _field_pairs()))
    return c.withColumn("method", F.split_part("field", F.lit("|"), F.lit(2))).withColumn("field", F.split_part("field", F.lit("|"), F.lit(1)))


def agg06_field_report(spark, d):
    """Field matching with derived scores (AGG06 to AGG07), strict and soft."""
    return _field_scores(spark, d).select("method", "field", "matched", "mismatched", "missing", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


def agg08_field_macro(spark, d):
    return _field_scores(spark, d).groupBy("method").agg(*[F.round(F.avg(c), 6).alias(f"macro_{c}") for c in ("precision", "recall", "f1", "accuracy")])


def agg09_method_matrix(spark, d):
    """F1 by field and method, and the best method; the first of the list wins a tie."""
    p = _field_scores(spark, d).groupBy("field").pivot("method", ["strict", "soft"]).agg(F.first("f1"))
    return p.select("field", F.round("strict", 6).alias("strict_f1"), F.round("soft", 6).alias("soft_f1"), F.when(F.col("soft") > F.col("strict"), "soft").otherwise("strict").alias("best"))


#: Three rule-made "models", so that error overlap can be counted.
MODELS = ["system", "cautious", "by_length"]


def predictions(spark, d):
    """(instance_id, truth, model, pred): the predictions of three rule models on each verdict."""
    v = verdicts(spark, d).select("instance_id", "truth", "pred", "confidence", F.length("instance_id").alias("len"), F.coalesce(F.length("m.title"), F.lit(0)).alias("tl"))
    each = F.array(
        F.struct(F.lit("system").alias("model"), F.col("pred").alias("pred")),
        F.struct(F.lit("cautious").alias("model"), F.when(F.col("confidence") >= 0.5, F.col("pred")).otherwise(3).alias("pred")),
        F.struct(F.lit("by_length").alias("model"), (F.col("tl") % 4).cast("int").alias("pred")),
    )
    return v.select("instance_id", "truth", F.explode(each).alias("e")).select("instance_id", "truth", "e.model", "e.pred")


_PRED = VERDICTS + """, pr AS (
  SELECT instance_id, truth, 'system' AS model, pred FROM v
  UNION ALL SELECT instance_id, truth, 'cautious', CASE WHEN confidence >= 0.5 THEN pred ELSE 3 END FROM v
  UNION ALL SELECT instance_id, truth, 'by_length', CAST(coalesce(length(m.title), 0) % 4 AS INTEGER) FROM v),
miss AS (SELECT * FROM pr WHERE pred IS DISTINCT FROM truth)
"""


def misses(spark, d):
    """Misclassified rows; a missing prediction differs from any label (FLT14)."""
    return predictions(spark, d).where(~F.col("pred").eqNullSafe(F.col("truth")))


def j16_error_overlap(spark, d):
    return misses(spark, d).groupBy("instance_id").agg(F.array_join(F.array_sort(F.collect_list("model")), ",").alias("missed_by"), F.count("*").alias("n_models"))


def agg15_count_of_counts(spark, d):
    return j16_error_overlap(spark, d).groupBy("n_models").agg(F.count("*").alias("instances"))


def top07_multi_model_errors(spark, d):
    """The 15 instances missed by most models; ties by id."""
    return j16_error_overlap(spark, d).orderBy(F.desc("n_models"), "instance_id").limit(15)


def error_type(pred, truth):
    return F.when(pred.isNull(), "no_prediction").when(pred == 3, "undecided").when(pred < truth, "too_lenient").when(pred > truth, "too_strict").otherwise("other")


_ETYPE = "CASE WHEN pred IS NULL THEN 'no_prediction' WHEN pred = 3 THEN 'undecided' WHEN pred < truth THEN 'too_lenient' WHEN pred > truth THEN 'too_strict' ELSE 'other' END"


def agg13_error_share(spark, d):
    """Error types by model with their share, and all models together: one rollup."""
    m = misses(spark, d).withColumn("error_type", error_type(F.col("pred"), F.col("truth")))
    r = m.groupingSets([[F.col("model"), F.col("error_type")], [F.col("error_type")]], F.col("model"), F.col("error_type")).agg(F.count("*").alias("n")).withColumn("model", F.coalesce("model", F.lit("all models")))
    return r.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("model")), 6)).select("model", "error_type", "n", "share")


def agg14_label_breakdown(spark, d):
    """Error types by model and true label, a column for each; anything else goes to `other`."""
    m = misses(spark, d).withColumn("error_type", error_type(F.col("pred"), F.col("truth")))
    kinds = ["no_prediction", "undecided", "too_lenient", "too_strict", "other"]
    return m.groupBy("model", "truth").pivot("error_type", kinds).agg(F.count(F.lit(1))).na.fill(0, kinds)


def agg19_dominant_error(spark, d):
    m = misses(spark, d).withColumn("error_type", error_type(F.col("pred"), F.col("truth")))
    return m.groupBy("model", "error_type").agg(F.count("*").alias("n")).groupBy("model").agg(F.min_by("error_type", F.struct((-F.col("n")).alias("a"), "error_type")).alias("dominant"), F.max("n").alias("n"))


def top08_error_examples(spark, d):
    """The first two examples of each model and error type."""
    m = misses(spark, d).withColumn("error_type", error_type(F.col("pred"), F.col("truth")))
    w = Window.partitionBy("model", "error_type").orderBy("instance_id")
    return m.withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("model", "error_type", "instance_id", "rn")


def agg10_agent_metrics(spark, d):
    """Calls, total and average latency of each agent, from the flat table of traces."""
    from citeloom.plans.p_core import p6_traces

    return p6_traces(spark, d).groupBy("agent_type").agg(
        F.count("*").alias("calls"), F.sum("execution_time_ms").alias("total_ms"), F.round(F.avg("execution_time_ms"), 4).alias("avg_ms"),
        F.count("confidence_score").alias("scored"), F.round(F.avg("confidence_score"), 6).alias("avg_score"),
    )


def agg11_average_where_known(spark, d):
    v = verdicts(spark, d)
    return v.groupBy("exists_true").agg(F.round(F.avg(F.when(F.col("pred").isNotNull() & (F.col("pred") != 3), F.col("confidence"))), 6).alias("avg_confidence"), F.count("*").alias("n"))


def agg12_instances_by_paper(spark, d):
    """The instances of each paper in order of creation, kept flat: a hot paper's rows are never gathered into one list."""
    i = table(spark, d, "instances", "instance_id", "original_paper", "created_at").distinct()
    return rank_within(i, ["original_paper"], ["created_at", "instance_id"], "place").select("original_paper", "place", "instance_id")


def agg16_author_pool(spark, d):
    a = table(spark, d, "instances", "citation_metadata").select(F.explode("citation_metadata.authors").alias("author"))
    return a.where("trim(author) <> ''").select(F.trim("author").alias("author")).distinct()


def agg17_term_frequency(spark, d):
    c = table(spark, d, "instances", "claim_text").select(F.explode(F.split(F.lower("claim_text"), "[^a-z0-9]+")).alias("term")).where("term <> ''")
    return c.groupBy("term").agg(F.count("*").alias("n"))


def agg18_score_stats(spark, d):
    e = table(spark, d, "instances", "instance_id", "retrieved_evidences").select(F.explode("retrieved_evidences.extractive_chunks").alias("c"))
    return e.agg(F.min("c.relevance_score").alias("lo"), F.max("c.relevance_score").alias("hi"), F.round(F.avg("c.relevance_score"), 6).alias("mean"), F.count("*").alias("n"))


def agg20_status_totals(spark, d):
    v = table(spark, d, "verification_instances", "status")
    return v.agg(F.count("*").alias("n"), F.count_if(F.expr("status = 'COMPLETED'")).alias("completed"), F.count_if(F.expr("status = 'FAILED'")).alias("failed"), F.count_if(F.expr("status is null")).alias("unknown"))


def spc15_hierarchical(spark, d):
    """Hierarchical counts: existence first, alignment only where both exist."""
    v = verdicts(spark, d)
    et, ep, lt, lp = F.col("exists_true") == 1, F.col("exists_pred") == 1, F.col("truth"), F.col("pred")
    a = v.agg(
        F.count_if(et & ep & (lt == lp)).alias("tp"), F.count_if(ep & (~et | (lp < lt))).alias("fp"),
        F.count_if(et & (~ep | (lp > lt))).alias("fn"), F.count_if(~et & ~ep).alias("tn"), F.count("*").alias("n"),
    )
    p, r = metrics.ratio(F.col("tp"), F.col("tp") + F.col("fp")), metrics.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return a.select("tp", "fp", "fn", "tn", "n", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(metrics.ratio(2 * p * r, p + r), 6).alias("f1"))


def spc16_reliability(spark, d):
    v = verdicts(spark, d).where("pred is not null")
    c = metrics.calibration(v, "confidence", F.coalesce(F.col("pred") == F.col("truth"), F.lit(False)))
    return c.select("bin", "n", F.round(F.col("avg_confidence") * F.col("n"), 2).alias("sum_confidence"), F.round(F.col("accuracy") * F.col("n")).cast("bigint").alias("correct"))


def spc16_ece_brier(spark, d):
    v = verdicts(spark, d).where("pred is not null and confidence is not null").withColumn("ok", F.coalesce(F.col("pred") == F.col("truth"), F.lit(False)))
    e = metrics.expected_calibration_error(metrics.calibration(v, "confidence", F.col("ok")))
    b = v.agg(F.avg(F.pow(F.col("confidence") - F.col("ok").cast("double"), 2)).alias("brier"))
    return e.join(F.broadcast(b)).select(F.round("ece", 6).alias("ece"), F.round("brier", 6).alias("brier"), "n")


def spc17_kappa(spark, d):
    v = verdicts(spark, d).where("pred is not null and truth is not null")
    return metrics.kappa(v, "truth", "pred").select(*[F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")])


def spc18_class_shares(spark, d):
    """Share of each class and whether it lies between 10 and 60 percent."""
    c = agg01_label_counts(spark, d).where("label is not null")
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))
    return c.select("label", "n", F.round(share, 6).alias("share"), share.between(0.1, 0.6).alias("balanced"))


def spc19_auc(spark, d):
    v = verdicts(spark, d).where("pred is not null")
    return metrics.auc(v, "confidence", F.coalesce(F.col("pred") == F.col("truth"), F.lit(False))).select(F.round("auc", 6).alias("auc"), "positives", "negatives")


def spc20_existence_rule(spark, d):
    """Existence is right if the title agrees but for format, the year agrees and a surname is shared."""
    v = verdicts(spark, d)
    shared = F.coalesce(F.size(F.array_intersect(t.last_names(F.col("m.authors")), t.last_names(F.col("x.authors")))) > 0, F.lit(False))
    ok = t.soft_match(F.col("m.title"), F.col("x.title")) & F.coalesce(F.col("m.year") == F.col("x.year"), F.lit(False)) & shared
    return v.groupBy(ok.alias("same_work")).agg(F.count("*").alias("n"))


_R = lambda a, b: f"coalesce({a} / nullif({b}, 0), 0)"
_CM = VERDICTS + """, g AS (SELECT a.range::INTEGER AS truth, b.range::INTEGER AS predicted FROM range(4) a, range(4) b),
cm AS (SELECT g.truth, g.predicted, count(v.instance_id) AS n FROM g LEFT JOIN v ON v.truth = g.truth AND v.pred = g.predicted GROUP BY ALL),
c0 AS (SELECT l.range::INTEGER AS label, sum(n) FILTER (truth = label AND predicted = label)::BIGINT AS tp, sum(n) FILTER (predicted = label AND truth <> label)::BIGINT AS fp,
  sum(n) FILTER (truth = label AND predicted <> label)::BIGINT AS fn FROM range(4) l, cm GROUP BY ALL),
c1 AS (SELECT *, tp + fn AS support, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM c0),
c2 AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM c1)
"""
_NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_LAST = "list_distinct(list_transform(list_filter({0}, lambda a: trim(a) <> ''), lambda a: lower(list_extract(string_split(trim(regexp_replace(a, '\\s+', ' ', 'g')), ' '), -1))))"
_INTER = "len(list_intersect(la, lb))"
_FIELDS = VERDICTS + f""", ab AS (SELECT *, {_LAST.format('m.authors')} AS la, {_LAST.format('x.authors')} AS lb FROM v),
pairs AS (
  SELECT 'title' AS field, 'strict' AS method, coalesce(m.title <> '', false) AS t, coalesce(x.title <> '', false) AS p, coalesce(m.title = x.title, false) AS ok FROM ab
  UNION ALL SELECT 'venue', 'strict', coalesce(m.venue <> '', false), coalesce(x.venue <> '', false), coalesce(m.venue = x.venue, false) FROM ab
  UNION ALL SELECT 'title', 'soft', coalesce(m.title <> '', false), coalesce(x.title <> '', false), coalesce({_NORM.format('m.title')} = {_NORM.format('x.title')}, false) FROM ab
  UNION ALL SELECT 'venue', 'soft', coalesce(m.venue <> '', false), coalesce(x.venue <> '', false), coalesce({_NORM.format('m.venue')} = {_NORM.format('x.venue')}, false) FROM ab
  UNION ALL SELECT 'year', k, m.year IS NOT NULL, x.year IS NOT NULL,
    coalesce(nullif(regexp_extract(m.year::VARCHAR, '\\b(19|20)\\d{{2}}\\b', 0), '') = nullif(regexp_extract(x.year::VARCHAR, '\\b(19|20)\\d{{2}}\\b', 0), ''), false) FROM ab, (VALUES ('strict'), ('soft')) s(k)
  UNION ALL SELECT 'authors', 'strict', coalesce(len(m.authors), 0) > 0, coalesce(len(x.authors), 0) > 0, coalesce(array_to_string(m.authors, '|') = array_to_string(x.authors, '|'), false) FROM ab
  UNION ALL SELECT 'authors', 'soft', coalesce(len(m.authors), 0) > 0, coalesce(len(x.authors), 0) > 0,
    coalesce(CASE WHEN len(la) + len(lb) > 0 THEN {_INTER} / (len(la) + len(lb) - {_INTER}) ELSE 0 END >= 0.75, false) FROM ab),
k AS (SELECT method, field, count(*) FILTER (p AND ok) AS matched, count(*) FILTER (p AND NOT ok) AS mismatched, count(*) FILTER (NOT p) AS missing FROM pairs WHERE t GROUP BY ALL),
s0 AS (SELECT *, coalesce(matched / nullif(matched + mismatched, 0), 0) AS pr, coalesce(matched / nullif(matched + missing, 0), 0) AS re, coalesce(matched / nullif(matched + mismatched + missing, 0), 0) AS ac FROM k),
s AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f1 FROM s0)
"""
_DELIV = """WITH d AS (SELECT * FROM instances WHERE instance_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY loaded_at DESC) = 1)"""
from citeloom.plans.p_core import SQL as _P  # noqa: E402

QUERIES = {f.__name__: f for f in [
    agg01_label_counts, agg02_field_summary, agg03_confusion_dense, agg04_class_metrics, agg05_macro_metrics, agg06_field_report, agg08_field_macro,
    agg09_method_matrix, j16_error_overlap, agg15_count_of_counts, top07_multi_model_errors, agg13_error_share, agg14_label_breakdown, agg19_dominant_error,
    top08_error_examples, agg10_agent_metrics, agg11_average_where_known, agg12_instances_by_paper, agg16_author_pool, agg17_term_frequency,
    agg18_score_stats, agg20_status_totals, spc15_hierarchical, spc16_reliability, spc16_ece_brier, spc17_kappa, spc18_class_shares, spc19_auc, spc20_existence_rule,
]}
SQL = {
    "agg01_label_counts": _DELIV + " SELECT true_outputs.true_alignment AS label, count(*) AS n FROM d GROUP BY 1",
    "agg02_field_summary": "SELECT field, count(*) AS total, count(*) FILTER (coalesce(arxiv_id, '') <> '') AS with_arxiv FROM papers GROUP BY 1",
    "agg03_confusion_dense": _CM + "SELECT * FROM cm",
    "agg04_class_metrics": _CM + "SELECT label, tp, fp, fn, support, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1 FROM c2",
    "agg05_macro_metrics": _CM + "SELECT round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f), 6) AS macro_f1, round(sum(tp) / (SELECT count(*) FROM v), 6) AS accuracy, (SELECT count(*) FROM v) AS pairs FROM c2",
    "agg06_field_report": _FIELDS + "SELECT method, field, matched, mismatched, missing, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, round(ac, 6) AS accuracy FROM s",
    "agg08_field_macro": _FIELDS + "SELECT method, round(avg(pr), 6) AS macro_precision, round(avg(re), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(avg(ac), 6) AS macro_accuracy FROM s GROUP BY 1",
    "agg09_method_matrix": _FIELDS + "SELECT field, round(max(f1) FILTER (method = 'strict'), 6) AS strict_f1, round(max(f1) FILTER (method = 'soft'), 6) AS soft_f1, CASE WHEN max(f1) FILTER (method = 'soft') > max(f1) FILTER (method = 'strict') THEN 'soft' ELSE 'strict' END AS best FROM s GROUP BY 1",
    "j16_error_overlap": _PRED + "SELECT instance_id, string_agg(model, ',' ORDER BY model) AS missed_by, count(*) AS n_models FROM miss GROUP BY 1",
    "agg15_count_of_counts": _PRED + "SELECT n_models, count(*) AS instances FROM (SELECT instance_id, count(*) AS n_models FROM miss GROUP BY 1) GROUP BY 1",
    "top07_multi_model_errors": _PRED + "SELECT instance_id, string_agg(model, ',' ORDER BY model) AS missed_by, count(*) AS n_models FROM miss GROUP BY 1 ORDER BY n_models DESC, instance_id LIMIT 15",
    "agg13_error_share": _PRED + f", e AS (SELECT model, {_ETYPE} AS error_type FROM miss), r AS (SELECT coalesce(model, 'all models') AS model, error_type, count(*) AS n FROM e GROUP BY GROUPING SETS ((model, error_type), (error_type))) SELECT model, error_type, n, round(n / sum(n) OVER (PARTITION BY model), 6) AS share FROM r",
    "agg14_label_breakdown": _PRED + f", e AS (SELECT model, truth, {_ETYPE} AS t FROM miss) SELECT model, truth, " + ", ".join(f"count(*) FILTER (t = '{k}') AS {k}" for k in ["no_prediction", "undecided", "too_lenient", "too_strict", "other"]) + " FROM e GROUP BY 1, 2",
    "agg19_dominant_error": _PRED + f", e AS (SELECT model, {_ETYPE} AS t, count(*) AS n FROM miss GROUP BY 1, 2) SELECT model, t AS dominant, n FROM e QUALIFY row_number() OVER (PARTITION BY model ORDER BY n DESC, t) = 1",
    "top08_error_examples": _PRED + f", e AS (SELECT model, {_ETYPE} AS error_type, instance_id FROM miss) SELECT model, error_type, instance_id, row_number() OVER (PARTITION BY model, error_type ORDER BY instance_id) AS rn FROM e QUALIFY rn <= 2",
    "agg10_agent_metrics": "SELECT agent_type, count(*) AS calls, sum(execution_time_ms)::BIGINT AS total_ms, round(avg(execution_time_ms), 4) AS avg_ms, count(confidence_score) AS scored, round(avg(confidence_score), 6) AS avg_score FROM (" + _P["p6_traces"] + ") GROUP BY 1",
    "agg11_average_where_known": VERDICTS + "SELECT exists_true, round(avg(CASE WHEN pred <> 3 THEN confidence END), 6) AS avg_confidence, count(*) AS n FROM v GROUP BY 1",
    "agg12_instances_by_paper": "SELECT original_paper, row_number() OVER (PARTITION BY original_paper ORDER BY created_at, instance_id) AS place, instance_id FROM (SELECT DISTINCT instance_id, original_paper, created_at FROM instances)",
    "agg16_author_pool": "SELECT DISTINCT trim(a) AS author FROM (SELECT unnest(citation_metadata.authors) AS a FROM instances) WHERE trim(a) <> ''",
    "agg17_term_frequency": "SELECT term, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(claim_text), '[^a-z0-9]+')) AS term FROM instances) WHERE term <> '' GROUP BY 1",
    "agg18_score_stats": "SELECT min(c.relevance_score) AS lo, max(c.relevance_score) AS hi, round(avg(c.relevance_score), 6) AS mean, count(*) AS n FROM (SELECT unnest(retrieved_evidences.extractive_chunks) AS c FROM instances)",
    "agg20_status_totals": "SELECT count(*) AS n, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status IS NULL) AS unknown FROM verification_instances",
    "spc15_hierarchical": VERDICTS + ", a AS (SELECT count(*) FILTER (exists_true = 1 AND exists_pred = 1 AND truth = pred) AS tp, count(*) FILTER (exists_pred = 1 AND (NOT exists_true = 1 OR pred < truth)) AS fp, count(*) FILTER (exists_true = 1 AND (NOT exists_pred = 1 OR pred > truth)) AS fn, count(*) FILTER (NOT exists_true = 1 AND NOT exists_pred = 1) AS tn, count(*) AS n FROM v), b AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM a) SELECT tp, fp, fn, tn, n, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM b",
    "spc16_reliability": VERDICTS + "SELECT least(floor(confidence * 10), 9)::INTEGER AS bin, count(*) AS n, round(sum(confidence), 2) AS sum_confidence, sum(coalesce(pred = truth, false)::INTEGER)::BIGINT AS correct FROM v WHERE pred IS NOT NULL AND confidence IS NOT NULL GROUP BY 1",
    "spc16_ece_brier": VERDICTS + ", o AS (SELECT confidence, coalesce(pred = truth, false)::INTEGER AS ok FROM v WHERE pred IS NOT NULL AND confidence IS NOT NULL), b AS (SELECT count(*) AS n, avg(confidence) AS c, avg(ok) AS a FROM o GROUP BY least(floor(confidence * 10), 9)) SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece, (SELECT round(avg((confidence - ok) ** 2), 6) FROM o) AS brier, sum(n)::BIGINT AS n FROM b",
    "spc17_kappa": VERDICTS + ", w AS (SELECT truth, pred FROM v WHERE pred IS NOT NULL AND truth IS NOT NULL), n AS (SELECT count(*) AS n, avg((truth = pred)::INTEGER) AS o FROM w), e AS (SELECT sum(a.c * b.c) / (SELECT n * n FROM n) AS e FROM (SELECT truth AS l, count(*) AS c FROM w GROUP BY 1) a JOIN (SELECT pred AS l, count(*) AS c FROM w GROUP BY 1) b USING (l)) SELECT round(o, 6) AS observed, round(e, 6) AS expected, round(coalesce((o - e) / nullif(1 - e, 0), 0), 6) AS kappa FROM n, e",
    "spc18_class_shares": _DELIV + ", c AS (SELECT true_outputs.true_alignment AS label, count(*) AS n FROM d WHERE true_outputs.true_alignment IS NOT NULL GROUP BY 1) SELECT label, n, round(n / sum(n) OVER (), 6) AS share, n / sum(n) OVER () BETWEEN 0.1 AND 0.6 AS balanced FROM c",
    "spc19_auc": VERDICTS + ", o AS (SELECT confidence AS s, coalesce(pred = truth, false) AS ok FROM v WHERE pred IS NOT NULL AND confidence IS NOT NULL), g AS (SELECT s, count(*) FILTER (ok) AS p, count(*) FILTER (NOT ok) AS q FROM o GROUP BY 1), w AS (SELECT p, q, coalesce(sum(q) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT round(sum(p * (below + q / 2)) / (sum(p) * sum(q)), 6) AS auc, sum(p)::BIGINT AS positives, sum(q)::BIGINT AS negatives FROM w",
    "spc20_existence_rule": VERDICTS + f", ab AS (SELECT *, {_LAST.format('m.authors')} AS la, {_LAST.format('x.authors')} AS lb FROM v) SELECT coalesce(m.title <> '' AND x.title <> '' AND {_NORM.format('m.title')} = {_NORM.format('x.title')}, false) AND coalesce(m.year = x.year, false) AND coalesce(len(list_intersect(la, lb)) > 0, false) AS same_work, count(*) AS n FROM ab GROUP BY 1",
}
