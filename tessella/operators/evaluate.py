"""Evaluation of prediction tables (J). Confusions are long tables ``(label, pred, n)``."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.operators.stats import avg_rank
from tessella.sources.scratch import running, written


def _safe(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def softmax(a: Column) -> Column:
    """Stable softmax of an array."""
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / _sum(e))


def argmax(a: Column) -> Column:
    """Position from 0 of the first maximum."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def confusion(df: DataFrame, classes: int, label: str = "label", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """Counts over all classes 1..k squared, zeros kept."""
    by = by or []
    n = df.groupBy(*by, label, pred).agg(F.count("*").alias("n")).withColumnsRenamed({label: "label", pred: "pred"})
    one = F.explode(F.sequence(F.lit(1), F.lit(classes)))
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    grid = groups.select(*by, one.alias("label")).select(*by, "label", one.alias("pred"))
    return grid.join(n, [*by, "label", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_metrics(cm: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per class precision, recall, F1 and support; 0 where undefined."""
    by = by or []
    hit = F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0))
    rows = cm.groupBy(*by, F.col("label").alias("class")).agg(hit.alias("hit"), F.sum("n").alias("support"))
    cols = cm.groupBy(*by, F.col("pred").alias("class")).agg(F.sum("n").alias("predicted"))
    m = rows.join(cols, [*by, "class"]).withColumns({"precision": _safe(F.col("hit"), F.col("predicted")), "recall": _safe(F.col("hit"), F.col("support"))})
    p, r = F.col("precision"), F.col("recall")
    return m.withColumn("f1", _safe(2 * p * r, p + r)).select(*by, "class", "precision", "recall", "f1", "support", "predicted")


def macro_metrics(cm: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy (which is micro F1) and the means over the fixed classes."""
    by = by or []
    acc = cm.groupBy(*by).agg(_safe(F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"))
    m = class_metrics(cm, by).groupBy(*by).agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))
    return acc.join(m, by) if by else acc.crossJoin(m)


def agreement_metrics(cm: DataFrame) -> DataFrame:
    """Macro and weighted F1 over the classes seen in labels or predictions, Cohen's kappa
    and the multi-class Matthews correlation."""
    m = class_metrics(cm).where("support > 0 or predicted > 0")
    s = m.agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"), F.sum("support").cast("double").alias("n"),
              F.sum(F.col("support") * F.col("predicted")).cast("double").alias("pt"), F.sum(F.col("support") * F.col("support")).cast("double").alias("tt"), F.sum(F.col("predicted") * F.col("predicted")).cast("double").alias("pp"),
              F.sum(F.col("recall") * F.col("support")).alias("c"))
    n, c, pt = F.col("n"), F.round("c"), F.col("pt")
    return s.select("macro_f1", "weighted_f1", _safe(c / n - pt / n / n, 1 - pt / n / n).alias("kappa"), _safe(c * n - pt, F.sqrt((n * n - F.col("pp")) * (n * n - F.col("tt")))).alias("mcc"))


def average_precision(df: DataFrame, hit: str, score: str, key: str, ties: str = "grouped", by: list[str] | None = None) -> DataFrame:
    """Average precision of a 0/1 column. ``positional``: rows of equal score in the
    order of ``key``; ``grouped``: they enter together. Counts run over range partitions."""
    by = by or []
    if ties == "grouped":
        g = df.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(hit).alias("h"))
        order = [F.col(score).desc()]
    else:
        g = df.select(*by, score, key, F.lit(1).alias("n"), F.col(hit).alias("h"))
        order = [F.col(score).desc(), F.col(key)]
    g = running(g, by, order, {"__n": F.col("n").cast("long"), "__h": F.col("h").cast("long")})
    g = g.select(*by, "h", ((F.col("__h") + F.col("h")) / (F.col("__n") + F.col("n"))).alias("precision"))
    return g.groupBy(*by).agg(_safe(F.sum(F.col("h") * F.col("precision")), F.sum("h")).alias("ap"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve by average ranks; null with one class only."""
    s = avg_rank(df.select(label, score), score).agg(F.sum(F.col(label)).alias("p"), F.sum(1 - F.col(label)).alias("q"), F.sum(F.when(F.col(label) == 1, F.col("rank")).otherwise(0)).alias("r"))
    p, q = F.col("p"), F.col("q")
    return s.select(F.when((p > 0) & (q > 0), (F.col("r") - p * (p + 1) / 2) / (p * q)).alias("auc"))


def ordinal_metrics(cm: DataFrame, classes: int = 5) -> DataFrame:
    """Mean absolute error and quadratic weighted kappa; a zero denominator gives kappa 0."""
    n = cm.agg(F.sum("n").alias("all"))
    a, b = cm.groupBy("label").agg(F.sum("n").alias("na")), cm.groupBy("pred").agg(F.sum("n").alias("nb"))
    w = F.pow(F.col("label") - F.col("pred"), F.lit(2)) / ((classes - 1) ** 2)
    s = cm.join(a, "label").join(b, "pred").crossJoin(n).agg(
        (F.sum(F.abs(F.col("label") - F.col("pred")) * F.col("n")) / F.first("all")).alias("mae"), F.sum(w * F.col("n")).alias("o"), F.sum(w * F.col("na") * F.col("nb") / F.col("all")).alias("e"))
    return s.select("mae", F.when(F.col("e") > 0, 1 - F.col("o") / F.col("e")).otherwise(0.0).alias("qwk"))


def ordinal_targets(y: Column, classes: int = 5) -> Column:
    """Indicators y > k for k in 1..classes-1."""
    return F.transform(F.sequence(F.lit(1), F.lit(classes - 1)), lambda k: (y > k).cast("int"))


def cumulative_to_class(q: Column) -> Column:
    """Class probabilities from q_k = P(y > k)."""
    return F.zip_with(F.concat(F.array(F.lit(1.0)), q), F.concat(q, F.array(F.lit(0.0))), lambda a, b: a - b)


def corn_targets(y: Column, classes: int = 5) -> Column:
    """(target, in use) of the conditional tasks: task k asks y > k of rows with y > k - 1."""
    return F.transform(F.sequence(F.lit(1), F.lit(classes - 1)), lambda k: F.struct((y > k).cast("int").alias("target"), (y >= k).alias("used")))


def corn_pos_weights(df: DataFrame, label: str = "label", classes: int = 5, cap: float = 10.0) -> DataFrame:
    """Negatives per positive of each conditional task, capped."""
    t = df.select(F.posexplode(corn_targets(F.col(label), classes)).alias("task", "t")).where("t.used")
    s = t.groupBy("task").agg(F.sum("t.target").alias("p"), F.sum(1 - F.col("t.target")).alias("q"))
    return s.select("task", F.when(F.col("p") > 0, F.least(F.lit(cap), F.col("q") / F.col("p"))).otherwise(F.lit(cap)).alias("weight"))


def corn_probs(conditional: Column) -> Column:
    """Cumulative probabilities as running products of the conditional ones."""
    return F.transform(conditional, lambda _, i: F.aggregate(F.slice(conditional, F.lit(1), i + 1), F.lit(1.0), lambda p, x: p * x))


def decode(probs: Column, cumulative: Column, method: str) -> Column:
    """Class 1..k by the likeliest class, the number of q over one half, or the expected
    class rounded half to even."""
    if method == "argmax":
        return argmax(probs) + 1
    if method == "threshold":
        return F.size(F.filter(cumulative, lambda q: q > 0.5)) + 1
    return (F.rint(F.aggregate(cumulative, F.lit(0.0), lambda s, q: s + q)) + 1).cast("int")


def prob_contract(probs: Column, cumulative: Column, tolerance: float = 1e-6) -> Column:
    """Finite, not negative, summing to 1, cumulative falling."""
    fine = F.forall(probs, lambda p: p.isNotNull() & ~F.isnan(p) & (p >= -tolerance)) & (F.abs(_sum(probs) - 1) <= tolerance)
    return fine & F.forall(F.zip_with(cumulative, F.concat(F.slice(cumulative, 2, 100), F.array(F.lit(0.0))), lambda a, b: a - b), lambda d: d >= -tolerance)


# Diagnoses of ordinal predictions, in the order of the list.
DIAGNOSES = ("LABEL_INDEX_MISMATCH", "TARGET_CONSTRUCTION_ERROR", "DECODING_ERROR", "CLASS_COLLAPSE", "THRESHOLD_DEGENERACY")
SOUND = "NO_IMPLEMENTATION_ERROR_FOUND"
#: A dramatic improvement, a collapsed share, and gaps or spreads of thresholds that are none.
DRAMATIC, COLLAPSED, DEGENERATE = 0.10, 0.80, 1e-3


def _accuracy_and_f1(df: DataFrame, preds: dict[str, Column], classes: int) -> DataFrame:
    """One row: ``{name}_accuracy, {name}_f1`` (macro over the fixed classes), and the largest share
    of one predicted class, of each way to predict."""
    y, sums = F.col("label"), []
    for name, p in preds.items():
        for k in range(1, classes + 1):
            sums += [F.count_if((p == k) & (y == k)).alias(f"{name}_tp{k}"), F.count_if(p == k).alias(f"{name}_p{k}")]
    c = df.agg(F.count("*").alias("n"), *[F.count_if(y == k).alias(f"y{k}") for k in range(1, classes + 1)], *sums)
    out = []
    for name in preds:
        tp, pk = [F.col(f"{name}_tp{k}") for k in range(1, classes + 1)], [F.col(f"{name}_p{k}") for k in range(1, classes + 1)]
        f1 = [F.coalesce(F.try_divide(2 * t, p + F.col(f"y{k}")), F.lit(0.0)) for k, (t, p) in enumerate(zip(tp, pk), 1)]
        out += [F.try_divide(sum(tp, F.lit(0)), F.col("n")).alias(f"{name}_accuracy"), (sum(f1, F.lit(0.0)) / classes).alias(f"{name}_f1"), F.try_divide(F.greatest(*pk), F.col("n")).alias(f"{name}_top")]
    return c.select(*out)


def prediction_audit(df: DataFrame, thresholds: list[float], classes: int = 5, label_base: int = 1, targets_ok: bool = True, probabilities_ok: bool = True) -> DataFrame:
    """One row: figures of the argmax (``pred``) as it is and shifted by one either way
    (clamped), of two other decoders (``threshold``, ``expected``), and the list of diagnoses.

    A shift that adds 0.10 of accuracy or macro F1, or labels that don't start at 1, are an
    index mismatch; another decoder that does, or probabilities that break their contract, a
    decoding error; a decoder with more than 0.80 of one class a collapse; ``thresholds`` that
    aren't finite or rise by 0.001 or less, or ``cumulative`` probabilities that don't vary over
    the rows, are degenerate. Shifts and decoders are counted in one pass.
    """
    p = F.col("pred")
    shifted = lambda d: F.least(F.lit(classes), F.greatest(F.lit(1), p + d))
    decoders = {"argmax": p, "threshold": F.col("threshold"), "expected": F.col("expected")}
    one = _accuracy_and_f1(df, decoders | {"up": shifted(1), "down": shifted(-1)}, classes)
    spread = df.agg(*[F.stddev_pop(F.get("cumulative", F.lit(i))).alias(f"s{i}") for i in range(classes - 1)])
    flat = any(not math.isfinite(t) for t in thresholds) or any(b - a <= DEGENERATE for a, b in zip(thresholds, thresholds[1:]))
    still = F.lit(True)
    for i in range(classes - 1):
        still = still & (F.col(f"s{i}") <= DEGENERATE)
    gain = lambda name: F.greatest(F.col(f"{name}_accuracy") - F.col("argmax_accuracy"), F.col(f"{name}_f1") - F.col("argmax_f1")) >= DRAMATIC
    found = (
        F.lit(label_base != 1) | gain("up") | gain("down"), F.lit(not targets_ok), gain("threshold") | gain("expected") | F.lit(not probabilities_ok),
        F.greatest(*[F.col(f"{d}_top") for d in decoders]) > COLLAPSED, F.lit(flat) | F.coalesce(still, F.lit(False)),
    )
    listed = F.concat_ws(";", *[F.when(f, d) for f, d in zip(found, DIAGNOSES)])
    return one.crossJoin(spread).select("argmax_accuracy", "argmax_f1", "up_accuracy", "up_f1", "down_accuracy", "down_f1", "argmax_top", F.when(listed == "", SOUND).otherwise(listed).alias("diagnoses"))


def subset_metrics(df: DataFrame, group: str, classes: int = 5) -> DataFrame:
    """Accuracy and macro figures by group, with the group's rows."""
    n = df.groupBy(group).agg(F.count("*").alias("rows"))
    return macro_metrics(confusion(df, classes, by=[group]), [group]).join(n, group)


def gate_statistics(df: DataFrame, gate: str, cls: str = "label") -> DataFrame:
    """Mean and population deviation of a gate value by class."""
    return df.groupBy(cls).agg(F.avg(gate).alias("mean"), F.stddev_pop(gate).alias("std"))


def compare_models(metrics: DataFrame, base: str, metric: str = "f1") -> DataFrame:
    """Each model's metric by class and its difference to the base model."""
    b = metrics.where(F.col("model") == base).select("class", F.col(metric).alias("base"))
    return metrics.where(F.col("model") != base).join(b, "class").select("model", "class", metric, "base", (F.col(metric) - F.col("base")).alias("delta"))


def multirun_summary(runs: DataFrame, metric: str, base: str) -> DataFrame:
    """Per model mean and sample deviation over the runs, mean paired difference to the
    base model and the runs that it wins. ``runs(model, run, metric)``."""
    b = runs.where(F.col("model") == base).select("run", F.col(metric).alias("__b"))
    j = runs.join(b, "run")
    d = F.col(metric) - F.col("__b")
    return j.groupBy("model").agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.avg(d).alias("delta"), F.count_if(d > 0).alias("wins"), F.count("*").alias("runs"))


def running_mean(folds: DataFrame, metric: str, by: str, order: str) -> DataFrame:
    """Mean of the folds so far, within each series."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return folds.withColumn("running_mean", F.avg(metric).over(w))


def best_epoch(history: DataFrame, by: str, patience: int) -> DataFrame:
    """Per series the first epoch of the best metric, and the epoch at which training
    would stop: the first with ``patience`` epochs since the last new best (else the last).
    The best is taken among the epochs up to the stop."""
    w = W.partitionBy(by).orderBy("epoch").rowsBetween(W.unboundedPreceding, -1)
    up = history.withColumn("__new", F.coalesce(F.col("metric") > F.max("metric").over(w), F.lit(True)))
    run = W.partitionBy(by).orderBy("epoch").rowsBetween(W.unboundedPreceding, W.currentRow)
    up = up.withColumn("__best", F.max(F.when(F.col("__new"), F.col("epoch"))).over(run)).withColumn("__stop", F.col("epoch") - F.col("__best") >= patience)
    s = up.groupBy(by).agg(F.coalesce(F.min(F.when(F.col("__stop"), F.col("epoch"))), F.max("epoch")).alias("stop_epoch"))
    seen = up.join(s, by).where(F.col("epoch") <= F.col("stop_epoch")).where("__new")
    return seen.groupBy(by, "stop_epoch").agg(F.max("epoch").alias("best_epoch"), F.max("metric").alias("best_metric"))


def compare_experiments(df: DataFrame, base: str, control: str | None = None) -> DataFrame:
    """Differences of experiments to the base one and to a control (the base, if not given):
    ``signal`` is POSITIVE where an experiment beats the control, else NEGATIVE, and
    ``improves`` YES where it beats the base, else NO; ``strength_rank`` orders them by metric,
    best first, ties by name."""
    b = df.where(F.col("model") == base).select(F.col("metric").alias("base"))
    c = df.where(F.col("model") == (control or base)).select(F.col("metric").alias("control"))
    out = df.where(F.col("model") != base).crossJoin(b).crossJoin(c)
    signal = F.when(F.col("metric") > F.col("control"), "POSITIVE").otherwise("NEGATIVE")
    improves = F.when(F.col("metric") > F.col("base"), "YES").otherwise("NO")
    rank = F.row_number().over(W.partitionBy().orderBy(F.col("metric").desc(), "model"))
    return out.select("model", "metric", (F.col("metric") - F.col("base")).alias("delta"), (F.col("metric") - F.col("control")).alias("control_delta"), signal.alias("signal"), improves.alias("improves"), rank.alias("strength_rank"))


def weight_summary(df: DataFrame, weights: str) -> DataFrame:
    """Per position of a weight vector its mean and population deviation; ``valid`` is
    the share of rows whose weights are not negative and sum to 1."""
    ok = F.forall(weights, lambda w: w >= 0) & (F.abs(_sum(F.col(weights)) - 1) <= 1e-6)
    at = df.select(ok.cast("int").alias("ok"), F.posexplode(weights).alias("pos", "w"))
    return at.groupBy("pos").agg(F.avg("w").alias("mean"), F.stddev_pop("w").alias("std"), F.avg("ok").alias("valid"))


def correction_ratio(base: Column, correction: Column) -> Column:
    """Norm of a correction over that of what it corrects and 1e-8 (a fixed value)."""
    n = lambda v: F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x)))
    return n(correction) / (n(base) + 1e-8)


def fit_frequency_model(train: DataFrame, test: DataFrame, features: list[str], label: str = "label", reg: float = 0.01) -> DataFrame:
    """Multinomial logistic regression on assembled features; ``test`` with ``pred``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    put = VectorAssembler(inputCols=features, outputCol="__x")
    model = LogisticRegression(featuresCol="__x", labelCol=label, family="multinomial", regParam=reg, maxIter=20).fit(put.transform(train))
    return model.transform(put.transform(test)).drop("__x", "rawPrediction", "probability").withColumn("pred", F.col("prediction").cast("int")).drop("prediction")


def prediction_distribution(df: DataFrame, classes: int = 5) -> DataFrame:
    """Counts and shares of each class among labels and predictions."""
    grid = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(classes))).alias("class"))
    a, b = df.groupBy(F.col("label").alias("class")).agg(F.count("*").alias("true_n")), df.groupBy(F.col("pred").alias("class")).agg(F.count("*").alias("pred_n"))
    j = grid.join(a, "class", "left").join(b, "class", "left").fillna(0).crossJoin(df.agg(F.count("*").alias("n")))
    return j.select("class", "true_n", "pred_n", _safe(F.col("true_n"), F.col("n")).alias("true_share"), _safe(F.col("pred_n"), F.col("n")).alias("pred_share"))


def rollup_checks(df: DataFrame, checks: str = "checks") -> DataFrame:
    """A JSON map of named checks per run -> per check PASS if every run passed."""
    e = df.select(F.explode(F.from_json(checks, "map<string,boolean>")).alias("name", "ok"))
    return e.groupBy("name").agg(F.when(F.bool_and("ok"), "PASS").otherwise("FAIL").alias("status"), F.count("*").alias("runs"), F.count_if(~F.col("ok")).alias("failed"))


def cross_validate(df: DataFrame, features: str, label: str = "label", fold: str = "fold", regs: tuple[float, ...] = (0.01, 0.1), classes: int = 5, by: str = "macro_f1") -> DataFrame:
    """One row per fold of a multinomial logistic regression on an array of features, fitted
    on the other folds and scored on this one: ``fold, rows, reg, accuracy, macro_precision,
    macro_recall, macro_f1, running_mean`` (of ``by``, over the folds so far).

    ``fold`` holds 1..k (``stratified_kfold``) and decides what each model sees; labels are
    1..``classes``. The strength in ``regs`` is the one with the best mean F1 over the folds.
    Rows without a label, a fold or features, or with a feature that isn't finite, take no part.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    real = F.col(features).cast("array<double>")
    known = F.forall(real, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(known & F.col(label).isNotNull() & F.col(fold).isNotNull())
    rows = rows.select((F.col(fold) - 1).cast("int").alias("fold"), F.col(label).cast("int").alias("label"), array_to_vector(real).alias("x"))
    rows = written(rows, "cv-rows")
    k = rows.agg(F.coalesce(F.max("fold") + 1, F.lit(0))).first()[0]
    if k < 2:
        raise ValueError("two folds at least")
    model = LogisticRegression(featuresCol="x", labelCol="label", family="multinomial", maxIter=20)
    grid = ParamGridBuilder().addGrid(model.regParam, list(regs)).build()
    f1 = MulticlassClassificationEvaluator(labelCol="label", metricName="f1")
    fitted = CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=f1, numFolds=k, foldCol="fold", collectSubModels=True).fit(rows)
    best = max(range(len(grid)), key=lambda i: fitted.avgMetrics[i])
    parts = [fitted.subModels[i][best].transform(rows.where(F.col("fold") == i)).select((F.col("fold") + 1).alias("fold"), "label", F.col("prediction").cast("int").alias("pred")) for i in range(k)]
    scored = written(reduce(DataFrame.unionByName, parts), "cv-scored")
    out = macro_metrics(confusion(scored, classes, by=["fold"]), ["fold"]).join(scored.groupBy("fold").agg(F.count("*").alias("rows")), "fold")
    out = running_mean(out.withColumn("__all", F.lit(1)), by, "__all", "fold").drop("__all")
    return out.select("fold", "rows", F.lit(float(regs[best])).alias("reg"), "accuracy", "macro_precision", "macro_recall", "macro_f1", "running_mean")
