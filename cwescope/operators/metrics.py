"""Multi-label evaluation over the long prediction table.

Input ``pred(sample_id, cls, y, p, yhat)``: one row per (sample, class).
Every metric is a composition of grouped aggregates: a per-class pass
(``groupBy(cls)``, partial aggregation map-side, output <= #classes rows)
and/or a per-sample pass (``groupBy(sample_id)``). Nothing is collected to
the driver; class-level windows only run on pre-aggregated tables whose
size is bounded by the number of classes times a fixed bucket count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cwescope.session import materialize

# Threshold grid of the tuner = 50 evenly spaced points in
# [0.1, 0.9]; point i is 0.1 + i * ((0.9 - 0.1) / 49).
GRID_LO, GRID_HI, GRID_N = 0.1, 0.9, 50
DEFAULT_THRESHOLD = 0.5
F_BETA = 1.5


def threshold_grid() -> list[float]:
    step = (GRID_HI - GRID_LO) / (GRID_N - 1)
    return [GRID_LO + i * step for i in range(GRID_N)]


def safe_div(num: Column, den: Column) -> Column:
    """x / y with 0.0 when y == 0 (the ``zero_division=0`` rule)."""
    return F.when(den != 0, num.cast("double") / den).otherwise(F.lit(0.0))


def fbeta_from_counts(tp: Column, fp: Column, fn: Column, beta: float = 1.0) -> Column:
    b2 = float(beta) ** 2
    return safe_div((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp)


def _counts(pred: DataFrame, yhat: Column | None = None) -> DataFrame:
    yh = yhat if yhat is not None else F.col("yhat")
    y = F.col("y")
    return pred.groupBy("cls").agg(
        F.sum(F.when((y == 1) & (yh == 1), 1).otherwise(0)).cast("bigint").alias("tp"),
        F.sum(F.when((y == 0) & (yh == 1), 1).otherwise(0)).cast("bigint").alias("fp"),
        F.sum(F.when((y == 1) & (yh == 0), 1).otherwise(0)).cast("bigint").alias("fn"),
        F.sum(F.when((y == 0) & (yh == 0), 1).otherwise(0)).cast("bigint").alias("tn"),
    )


def confusion_per_class(pred: DataFrame) -> DataFrame:
    """TP, FP, FN, precision, recall per class (TN is dropped, as published)."""
    c = _counts(pred)
    return c.select(
        "cls", "tp", "fp", "fn",
        safe_div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        safe_div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def class_f1(pred: DataFrame) -> DataFrame:
    c = _counts(pred)
    return c.select("cls", fbeta_from_counts(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))


def _degenerate(pred: DataFrame) -> DataFrame:
    """One row: 1 when truth or prediction holds a single value overall."""
    return pred.agg(
        ((F.min("y") == F.max("y")) | (F.min("yhat") == F.max("yhat"))).alias("degenerate"))


def _per_sample(pred: DataFrame) -> DataFrame:
    y, yh = F.col("y"), F.col("yhat")
    return pred.groupBy("sample_id").agg(
        F.sum(y * yh).alias("tp"),
        F.sum((1 - y) * yh).alias("fp"),
        F.sum(y * (1 - yh)).alias("fn"),
        F.max(y).alias("any_true"),
        F.max(yh).alias("any_pred"),
        F.bool_and(y == yh).alias("exact"),
    )


def prf_averaged(pred: DataFrame, beta: float = F_BETA) -> DataFrame:
    """Precision / recall / F1 / F-beta for micro, macro, weighted, samples.

    Zero division gives 0. When truth or prediction holds a single value,
    every score is 0 (the published guard; F-beta then is 0 too).
    """
    c = _counts(pred)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    per_cls = c.select(
        tp, fp, fn, (tp + fn).alias("support"),
        safe_div(tp, tp + fp).alias("p"), safe_div(tp, tp + fn).alias("r"),
        fbeta_from_counts(tp, fp, fn).alias("f"), fbeta_from_counts(tp, fp, fn, beta).alias("fb"))
    sup = F.col("support")
    cls_agg = per_cls.agg(
        F.sum("tp").alias("stp"), F.sum("fp").alias("sfp"), F.sum("fn").alias("sfn"),
        F.avg("p").alias("macro_p"), F.avg("r").alias("macro_r"),
        F.avg("f").alias("macro_f"), F.avg("fb").alias("macro_fb"),
        safe_div(F.sum(F.col("p") * sup), F.sum(sup)).alias("w_p"),
        safe_div(F.sum(F.col("r") * sup), F.sum(sup)).alias("w_r"),
        safe_div(F.sum(F.col("f") * sup), F.sum(sup)).alias("w_f"),
        safe_div(F.sum(F.col("fb") * sup), F.sum(sup)).alias("w_fb"),
    )
    s = _per_sample(pred)
    smp = s.agg(
        F.avg(safe_div(F.col("tp"), F.col("tp") + F.col("fp"))).alias("s_p"),
        F.avg(safe_div(F.col("tp"), F.col("tp") + F.col("fn"))).alias("s_r"),
        F.avg(fbeta_from_counts(F.col("tp"), F.col("fp"), F.col("fn"))).alias("s_f"),
        F.avg(fbeta_from_counts(F.col("tp"), F.col("fp"), F.col("fn"), beta)).alias("s_fb"),
    )
    one = (cls_agg.withColumn("_k", F.lit(1))
           .join(F.broadcast(smp.withColumn("_k", F.lit(1))), "_k")
           .join(F.broadcast(_degenerate(pred).withColumn("_k", F.lit(1))), "_k"))
    stp, sfp, sfn = F.col("stp"), F.col("sfp"), F.col("sfn")

    def row(name, p, r, f, fb):
        return F.struct(F.lit(name).alias("average"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1"), fb.alias("fbeta"))

    rows = F.array(
        row("micro", safe_div(stp, stp + sfp), safe_div(stp, stp + sfn),
            fbeta_from_counts(stp, sfp, sfn), fbeta_from_counts(stp, sfp, sfn, beta)),
        row("macro", F.col("macro_p"), F.col("macro_r"), F.col("macro_f"), F.col("macro_fb")),
        row("weighted", F.col("w_p"), F.col("w_r"), F.col("w_f"), F.col("w_fb")),
        row("samples", F.col("s_p"), F.col("s_r"), F.col("s_f"), F.col("s_fb")),
    )
    out = one.select("degenerate", F.explode(rows).alias("m"))
    zero = F.lit(0.0)
    deg = F.col("degenerate")
    return out.select(
        "m.average",
        *[F.when(deg, zero).otherwise(F.col(f"m.{k}")).alias(k)
          for k in ("precision", "recall", "f1", "fbeta")])


def prf_binary(pred: DataFrame, cls: int, beta: float = F_BETA) -> DataFrame:
    """One row: precision / recall / F1 / F-beta of label 1 of one class (the
    'binary' average); zero division gives 0."""
    one = pred.where(F.col("cls") == cls).agg(
        F.sum(F.col("y") * F.col("yhat")).alias("tp"), F.sum((1 - F.col("y")) * F.col("yhat")).alias("fp"),
        F.sum(F.col("y") * (1 - F.col("yhat"))).alias("fn"))
    tp, fp, fn = (F.coalesce(c, F.lit(0)) for c in ("tp", "fp", "fn"))
    return one.select(F.lit("binary").alias("average"), safe_div(tp, tp + fp).alias("precision"),
                      safe_div(tp, tp + fn).alias("recall"), fbeta_from_counts(tp, fp, fn).alias("f1"),
                      fbeta_from_counts(tp, fp, fn, beta).alias("fbeta"))


def sample_scores(pred: DataFrame) -> DataFrame:
    """Subset accuracy, binary accuracy and any-label-true (one row)."""
    s = _per_sample(pred)
    return s.agg(
        F.avg(F.col("exact").cast("int")).alias("subset_accuracy"),
        F.avg((F.col("any_true") == F.col("any_pred")).cast("int")).alias("binary_accuracy"),
        F.avg(((F.col("tp") > 0) | ((F.col("any_true") == 0) & (F.col("any_pred") == 0)))
              .cast("int")).alias("any_label_true"),
    )


#: Buckets per class; a power of two.
AUC_BUCKETS = 256


def _quantile_bucket(bounds: Column, p: Column, buckets: int) -> Column:
    """Number of ``bounds`` (buckets - 1 sorted numbers) that are <= p, by
    halving."""
    steps = F.array(*[F.lit(buckets >> (k + 1)) for k in range(buckets.bit_length() - 1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(
        F.get(bounds, at + step - 1) <= p, step).otherwise(F.lit(0)))


def roc_auc_per_class(pred: DataFrame, buckets: int = AUC_BUCKETS) -> DataFrame:
    """Exact ROC AUC per class (Mann-Whitney with ties counted half).

    Scores are first reduced to distinct (cls, p) with positive/negative
    counts. The cumulative count of negatives below each score is split in
    two levels so no window runs over a whole class: bucket totals (at most
    #classes x ``buckets`` rows) give the offset of each bucket, and a window
    over (cls, bucket) gives the rank inside it. Buckets end at approximate
    quantiles of the class's distinct scores, so scores that lie close together
    spread over all buckets; the AUC is exact for any bounds. A class with one
    label value has no AUC (null).
    """
    d = materialize(pred.groupBy("cls", "p").agg(
        F.sum("y").cast("bigint").alias("pos"),
        F.sum(1 - F.col("y")).cast("bigint").alias("neg")))
    d = d.join(F.broadcast(_score_bounds(d, buckets)), "cls")
    d = d.withColumn("b", _quantile_bucket(F.col("bounds"), F.col("p"), buckets)).drop("bounds")
    bt = d.groupBy("cls", "b").agg(F.sum("neg").alias("bneg"))
    wb = Window.partitionBy("cls").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    bt = bt.select("cls", "b", F.coalesce(F.sum("bneg").over(wb), F.lit(0)).alias("off"))
    wi = Window.partitionBy("cls", "b").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    d = (d.join(F.broadcast(bt), ["cls", "b"])
         .withColumn("below", F.col("off") + F.coalesce(F.sum("neg").over(wi), F.lit(0))))
    a = d.groupBy("cls").agg(
        F.sum(F.col("pos") * (F.col("below") + 0.5 * F.col("neg"))).alias("u"),
        F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    return a.select("cls", F.when((F.col("np") > 0) & (F.col("nn") > 0),
                                  F.col("u") / (F.col("np") * F.col("nn"))).alias("auc"))


def _score_bounds(scores: DataFrame, buckets: int) -> DataFrame:
    """cls, bounds: the scores at 1/buckets, 2/buckets, ... of a class's
    distinct ones (one row per class)."""
    shares = F.array(*[F.lit(k / buckets) for k in range(1, buckets)])
    return scores.groupBy("cls").agg(F.percentile_approx("p", shares, 10 * buckets).alias("bounds"))


def roc_auc_macro(pred: DataFrame) -> DataFrame:
    return roc_auc_per_class(pred).agg(F.avg("auc").alias("roc_auc"))


def evaluate_run(pred: DataFrame, beta: float = F_BETA) -> DataFrame:
    """One metric row: AUC, subset accuracy, macro P/R/F1/F-beta, binary
    accuracy, any-label-true. Degenerate input zeroes P/R/F/AUC. Three passes:
    per class, per sample, per distinct score."""
    counts = _counts(pred)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    one_value = [F.sum(x) == 0 for x in (tp + fn, fp + tn, tp + fp, fn + tn)]
    macro = counts.agg(
        F.avg(safe_div(tp, tp + fp)).alias("precision"), F.avg(safe_div(tp, tp + fn)).alias("recall"),
        F.avg(fbeta_from_counts(tp, fp, fn)).alias("f1"), F.avg(fbeta_from_counts(tp, fp, fn, beta)).alias("fbeta"),
        (one_value[0] | one_value[1] | one_value[2] | one_value[3]).alias("degenerate"))
    k = F.lit(1)
    j = (macro.withColumn("_k", k)
         .join(F.broadcast(roc_auc_macro(pred).withColumn("_k", k)), "_k")
         .join(F.broadcast(sample_scores(pred).withColumn("_k", k)), "_k"))

    def guarded(c: str) -> Column:
        return F.when(F.col("degenerate"), F.lit(0.0)).otherwise(F.col(c))

    return j.select(
        guarded("roc_auc").alias("roc_auc"), F.col("subset_accuracy").alias("accuracy"),
        guarded("precision").alias("precision"), guarded("recall").alias("recall"), guarded("f1").alias("f1_score"),
        guarded("fbeta").alias("fbeta_score"), "binary_accuracy", "any_label_true")


def tune_thresholds(pred: DataFrame) -> DataFrame:
    """Per class: the grid threshold with the best F1 of ``p >= t``.

    Each row is bucketed by how many grid points are <= p (0..50): by arithmetic,
    put right by a look at the grid points next to it. Then ``p >= t_i`` iff
    bucket > i. Per class the (bucket, pos, neg) table has at
    most 51 rows, so the 50 candidate F1 values are computed from that small
    array instead of joining every row with every grid point. First best
    wins; 0.5 when F1 is never > 0.
    """
    grid = threshold_grid()
    garr = F.array(*[F.lit(t) for t in grid])
    guess = F.floor((F.col("p") - GRID_LO) * ((GRID_N - 1) / (GRID_HI - GRID_LO))).cast("int") + 1
    guess = F.greatest(F.least(guess, F.lit(GRID_N)), F.lit(0))
    bucket = (F.when(F.get(garr, guess) <= F.col("p"), guess + 1)
              .when(F.get(garr, guess - 1) > F.col("p"), guess - 1).otherwise(guess))
    bc = pred.groupBy("cls", bucket.alias("j")).agg(
        F.sum("y").cast("bigint").alias("pos"), F.sum(1 - F.col("y")).cast("bigint").alias("neg"))
    per = bc.groupBy("cls").agg(
        F.collect_list(F.struct("j", "pos", "neg")).alias("bk"),
        F.sum("pos").alias("P"))
    cand = per.select("cls", "P", "bk", F.posexplode(garr).alias("i", "t"))
    above = F.filter(F.col("bk"), lambda x: x["j"] > F.col("i"))
    tp = F.aggregate(above, F.lit(0).cast("bigint"), lambda acc, x: acc + x["pos"])
    fp = F.aggregate(above, F.lit(0).cast("bigint"), lambda acc, x: acc + x["neg"])
    cand = cand.select("cls", "i", "t", fbeta_from_counts(tp, fp, F.col("P") - tp).alias("f1"))
    best = cand.groupBy("cls").agg(
        F.max_by(F.struct("t", "f1"), F.struct("f1", -F.col("i"))).alias("b"))
    return best.select(
        "cls",
        F.when(F.col("b.f1") > 0, F.col("b.t")).otherwise(F.lit(DEFAULT_THRESHOLD)).alias("threshold"),
        F.col("b.f1").alias("best_f1"))


def pos_weight(pred: DataFrame) -> DataFrame:
    """Per class neg/pos where pos > 0, else 1.0."""
    c = pred.groupBy("cls").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    return c.select("cls", F.when(F.col("pos") > 0, (F.col("n") - F.col("pos")) / F.col("pos"))
                    .otherwise(F.lit(1.0)).alias("pos_weight"))


def logit_of(p: Column) -> Column:
    """Fixed affine map score -> logit used by the loss operators (z = 8p - 4)."""
    return p * 8.0 - 4.0


def _bce(z: Column, y: Column, w: Column | None = None) -> Column:
    soft = F.log1p(F.exp(-F.abs(z))) + F.greatest(-z, F.lit(0.0))
    if w is None:
        return (1 - y) * z + soft
    return (1 - y) * z + (1 + (w - 1) * y) * soft


def loss_bce(pred: DataFrame, with_pos_weight: bool = False) -> DataFrame:
    """Mean binary cross-entropy on logits, optionally with per-class pos_weight."""
    z, y = logit_of(F.col("p")), F.col("y").cast("double")
    if not with_pos_weight:
        return pred.agg(F.avg(_bce(z, y)).alias("loss"))
    pw = pos_weight(pred)  # one row per class
    j = pred.join(F.broadcast(pw), "cls")
    return j.agg(F.avg(_bce(z, y, F.col("pos_weight"))).alias("loss"))


def loss_focal(pred: DataFrame, alpha: float = 1.0, gamma: float = 2.0) -> DataFrame:
    z, y = logit_of(F.col("p")), F.col("y").cast("double")
    bce = _bce(z, y)
    pt = F.exp(-bce)
    return pred.agg(F.avg(F.lit(alpha) * F.pow(1 - pt, gamma) * bce).alias("loss"))


def loss_weighted(pred: DataFrame, weight_for_positive: float = 2.0) -> DataFrame:
    """Weighted BCE mean: sum(w * l) / sum(w), w = weight for positives, 1 otherwise."""
    z, y = logit_of(F.col("p")), F.col("y").cast("double")
    w = F.when(F.col("y") == 1, F.lit(float(weight_for_positive))).otherwise(F.lit(1.0))
    return pred.agg((F.sum(w * _bce(z, y)) / F.sum(w)).alias("loss"))


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def softmax_per_sample(pred: DataFrame) -> DataFrame:
    """Softmax over the classes of each sample (max-shifted for stability)."""
    z = logit_of(F.col("p"))
    w = Window.partitionBy("sample_id")
    t = pred.select("sample_id", "cls", z.alias("z"))
    t = t.withColumn("e", F.exp(F.col("z") - F.max("z").over(w)))
    return t.select("sample_id", "cls", sigmoid(F.col("z")).alias("sigmoid"),
                    (F.col("e") / F.sum("e").over(w)).alias("softmax"))


def best_class(pred: DataFrame) -> DataFrame:
    """Argmax class and probability per sample; the lowest index wins ties."""
    b = pred.groupBy("sample_id").agg(
        F.max_by(F.struct("cls", "p"), F.struct("p", -F.col("cls"))).alias("b"))
    return b.select("sample_id", F.col("b.cls").alias("best_cls"), F.col("b.p").alias("best_p"))


def decode_labels(pred: DataFrame, thresholds: DataFrame, names: DataFrame,
                  op: str = ">") -> DataFrame:
    """Probability rows -> sorted list of label names per sample.

    ``thresholds(cls, threshold)`` and ``names(cls, name)`` are class-sized
    (broadcast). A class missing from ``names`` is called ``Unknown-{i}``.
    ``op`` is ``>`` (comparison script), ``>=`` (model decode).
    """
    classes = thresholds.select("cls", "threshold").join(names.select("cls", "name"), "cls", "full_outer")
    j = pred.join(F.broadcast(classes), "cls", "left")
    t = F.coalesce(F.col("threshold"), F.lit(DEFAULT_THRESHOLD))
    hit = F.col("p") > t if op == ">" else F.col("p") >= t
    nm = F.coalesce(F.col("name"), F.concat(F.lit("Unknown-"), F.col("cls").cast("string")))
    return j.groupBy("sample_id").agg(
        F.array_sort(F.collect_list(F.when(hit, nm))).alias("labels"))
