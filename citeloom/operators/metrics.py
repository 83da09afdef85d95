"""Classification, agreement, calibration and field-matching metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.operators import ranking


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(df: DataFrame, truth: str, predicted: str, k: int = 4) -> DataFrame:
    """(truth, predicted, n): the dense k x k matrix; pairs with a label outside 0..k-1 are ignored."""
    spark = df.sparkSession
    codes = spark.range(k).select(F.col("id").cast("int").alias("c"))
    grid = codes.select(F.col("c").alias("truth")).crossJoin(codes.select(F.col("c").alias("predicted")))  # k x k constants
    n = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return grid.join(n, ["truth", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, support, precision, recall, f1) of a confusion matrix."""
    cells = matrix.select(
        F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit("t").alias("side")), F.struct(F.col("predicted").alias("label"), F.lit("p").alias("side")))).alias("x"),
        (F.col("truth") == F.col("predicted")).alias("hit"), "n",
    )
    side, hit = F.col("x.side"), F.col("hit")
    agg = cells.groupBy("x.label").agg(
        F.sum(F.when((side == "t") & hit, F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when((side == "p") & ~hit, F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when((side == "t") & ~hit, F.col("n")).otherwise(0)).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return agg.select("label", "tp", "fp", "fn", (tp + fn).alias("support"), p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def macro_metrics(df: DataFrame, truth: str, predicted: str, k: int = 4) -> DataFrame:
    """One row: macro averages over all k classes; accuracy counts every pair, also those outside the classes."""
    total = df.agg(F.count("*").alias("pairs"))
    m = class_metrics(confusion(df, truth, predicted, k)).agg(
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), F.sum("tp").alias("hits")
    )
    return m.join(F.broadcast(total)).select("macro_precision", "macro_recall", "macro_f1", ratio(F.col("hits"), F.col("pairs")).alias("accuracy"), "pairs")


def field_counts(df: DataFrame, fields: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """(field, matched, mismatched, missing): for each field (truth is there, prediction is there, they match).

    A field counts only where the truth has it; without a prediction it is missing.
    """
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), a.alias("truth"), b.alias("pred"), m.alias("match")) for n, (a, b, m) in fields.items()]))
    d = df.select(each.alias("x")).where("x.truth")
    return d.groupBy("x.field").agg(
        F.count_if(F.expr("x.pred and x.match")).alias("matched"), F.count_if(F.expr("x.pred and not x.match")).alias("mismatched"), F.count_if(F.expr("not x.pred")).alias("missing")
    )


def field_scores(counts: DataFrame) -> DataFrame:
    """Precision m/(m+mismatched), recall m/(m+missing), F1 and accuracy m/all of field counts."""
    m, x, z = F.col("matched"), F.col("mismatched"), F.col("missing")
    p, r = ratio(m, m + x), ratio(m, m + z)
    return counts.select(*counts.columns, p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), ratio(m, m + x + z).alias("accuracy"))


def calibration(df: DataFrame, confidence: str, correct: Column, bins: int = 10) -> DataFrame:
    """(bin, n, avg_confidence, accuracy) of equal-width reliability bins; 1.0 belongs to the last bin."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    return df.where(F.col(confidence).isNotNull()).groupBy(b.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(confidence).alias("avg_confidence"), F.avg(correct.cast("double")).alias("accuracy")
    )


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    n = F.sum("n")
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("avg_confidence") - F.col("accuracy"))) / n).alias("ece"), n.alias("n"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two raters on one row each: (observed, expected, kappa); marginals come from one aggregation."""
    n = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    both = n.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("l")), F.struct(F.lit(1).alias("side"), F.col("b").alias("l")))).alias("x"), "n", (F.col("a") == F.col("b")).alias("hit"))
    m = both.groupBy("x.l").agg(F.sum(F.when(F.col("x.side") == 0, F.col("n")).otherwise(0)).alias("na"), F.sum(F.when(F.col("x.side") == 1, F.col("n")).otherwise(0)).alias("nb"), F.sum(F.when((F.col("x.side") == 0) & F.col("hit"), F.col("n")).otherwise(0)).alias("d"))
    s = m.agg(F.sum("d").alias("d"), F.sum("na").alias("n"), F.sum(F.col("na") * F.col("nb")).alias("e"))
    o, e = F.col("d") / F.col("n"), F.col("e") / (F.col("n") * F.col("n"))
    return s.select(o.alias("observed"), e.alias("expected"), ratio(o - e, 1 - e).alias("kappa"))


def auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Area under the ROC curve by rank sums on distinct scores: ties share their rank; no global sort of rows."""
    by = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    c = ranking.running_sum(by, ["s"], "q", "below").withColumn("won", F.col("p") * (F.col("below") + F.col("q") / 2.0))
    return c.agg(ratio(F.sum("won"), F.sum("p") * F.sum("q").cast("double")).alias("auc"), F.sum("p").alias("positives"), F.sum("q").alias("negatives"))
