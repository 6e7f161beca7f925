"""Queries over prediction tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import evaluate as J
from tessella.operators import sampling as P
from tessella.operators import similarity as S
from tessella.plans.analog import load, sql
from tessella.plans.registry import query
from tessella.plans.statistics_queries import rounded

SUM = "(w1 + w2 + w3 + w4 + w5)"
PRED = f"""pd AS (SELECT *, {SUM} AS t, CASE greatest(w1, w2, w3, w4, w5) WHEN w1 THEN 1 WHEN w2 THEN 2 WHEN w3 THEN 3 WHEN w4 THEN 4 ELSE 5 END AS pred FROM {{scored}}),
ks AS (SELECT CAST(i AS INT) AS k FROM range(1, 6) r(i)), cm AS (SELECT x.k AS label, y.k AS pred, (SELECT count(*) FROM pd WHERE pd.label = x.k AND pd.pred = y.k) AS n FROM ks x, ks y),
pc AS (SELECT k AS class, sum(n) FILTER (label = k AND cm.pred = k) AS hit, sum(n) FILTER (label = k) AS support, sum(n) FILTER (cm.pred = k) AS predicted FROM cm, ks GROUP BY 1),
pm AS (SELECT *, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall FROM pc),
pf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pm)"""


def predictions(spark, sf_dir):
    s = load(spark, sf_dir, "scored")
    w = F.array(*[F.col(f"w{k}") for k in range(1, 6)])
    total = sum((F.col(f"w{k}") for k in range(2, 6)), F.col("w1"))
    return s.withColumns({"w": w, "probs": F.transform(w, lambda x: x / total), "pred": J.argmax(w) + 1})


@query(sql(f"WITH {PRED} SELECT label, pred, n FROM cm"))
def confusion(spark, sf_dir):
    return J.confusion(predictions(spark, sf_dir), 5)


@query(sql(f"WITH {PRED} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM pf"))
def class_metrics(spark, sf_dir):
    return rounded(J.class_metrics(J.confusion(predictions(spark, sf_dir), 5)), "precision", "recall", "f1").drop("predicted")


@query(sql(f"""WITH {PRED} SELECT round((SELECT sum(n) FILTER (label = pred) / sum(n) FROM cm), 6) AS accuracy, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM pf"""))
def macro_metrics(spark, sf_dir):
    return rounded(J.macro_metrics(J.confusion(predictions(spark, sf_dir), 5)), "accuracy", "macro_precision", "macro_recall", "macro_f1")


@query(sql(f"""WITH {PRED}, s AS (SELECT avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1, CAST(sum(support) AS DOUBLE) AS n, CAST(sum(hit) AS DOUBLE) AS c, CAST(sum(support * predicted) AS DOUBLE) AS pt, CAST(sum(support * support) AS DOUBLE) AS tt, CAST(sum(predicted * predicted) AS DOUBLE) AS pp FROM pf WHERE support > 0 OR predicted > 0)
SELECT round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1, round((c / n - pt / n / n) / (1 - pt / n / n), 6) + 0.0 AS kappa, round((c * n - pt) / sqrt((n * n - pp) * (n * n - tt)), 6) + 0.0 AS mcc FROM s"""))
def kappa_mcc(spark, sf_dir):
    return rounded(J.agreement_metrics(J.confusion(predictions(spark, sf_dir), 5)), "macro_f1", "weighted_f1", "kappa", "mcc")


@query(sql(f"""WITH {PRED}, l AS (SELECT id, k AS class, CAST(label = k AS INT) AS hit, round(CASE k WHEN 1 THEN w1 WHEN 2 THEN w2 WHEN 3 THEN w3 WHEN 4 THEN w4 ELSE w5 END / t, 9) AS score FROM pd, ks),
p AS (SELECT class, hit, sum(hit) OVER (PARTITION BY class ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) / row_number() OVER (PARTITION BY class ORDER BY score DESC, id) AS prec FROM l),
g AS (SELECT class, hit, sum(hit) OVER (PARTITION BY class ORDER BY score DESC) / count(*) OVER (PARTITION BY class ORDER BY score DESC) AS prec FROM l)
SELECT 'positional' AS ties, class, round(sum(hit * prec) / sum(hit), 6) AS ap FROM p GROUP BY 2 UNION ALL SELECT 'grouped', class, round(sum(hit * prec) / sum(hit), 6) FROM g GROUP BY 2"""))
def macro_aupr(spark, sf_dir):
    """Average precision by class under both tie rules."""
    p = predictions(spark, sf_dir)
    long = p.select("id", "label", F.posexplode("probs").alias("pos", "p")).select("id", (F.col("pos") + 1).alias("class"), (F.col("label") == F.col("pos") + 1).cast("int").alias("hit"), F.round("p", 9).alias("score"))
    parts = [J.average_precision(long, "hit", "score", "id", t, ["class"]).withColumn("ties", F.lit(t)) for t in ("positional", "grouped")]
    return rounded(parts[0].unionByName(parts[1]), "ap").select("ties", "class", "ap")


@query(sql("""WITH r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM {labelled}),
g AS (SELECT label, sum(label) OVER (ORDER BY score DESC) / count(*) OVER (ORDER BY score DESC) AS prec FROM {labelled})
SELECT round((sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)), 6) AS auc, round((SELECT sum(label * prec) / sum(label) FROM g), 6) AS ap FROM r"""))
def roc_auc(spark, sf_dir):
    b = load(spark, sf_dir, "labelled")
    return rounded(J.roc_auc(b, "label", "score").crossJoin(J.average_precision(b, "label", "score", "id")), "auc", "ap")


@query(sql(f"""WITH {PRED}, a AS (SELECT label, sum(n) AS na FROM cm GROUP BY 1), b AS (SELECT pred, sum(n) AS nb FROM cm GROUP BY 1), s AS (SELECT sum(n) AS t FROM cm)
SELECT round(sum(abs(label - pred) * n) / any_value(t), 6) AS mae, round(1 - sum(power(label - pred, 2) * n) / sum(power(label - pred, 2) * na * nb / t), 6) + 0.0 AS qwk FROM cm JOIN a USING (label) JOIN b USING (pred), s"""))
def qwk_mae(spark, sf_dir):
    return rounded(J.ordinal_metrics(J.confusion(predictions(spark, sf_dir), 5)), "mae", "qwk")


@query(sql(f"""WITH {PRED}, c AS (SELECT id, label, w1 / t AS p1, w2 / t AS p2, w3 / t AS p3, w4 / t AS p4, w5 / t AS p5, pred FROM pd), q AS (SELECT *, 1 - p1 AS q1, p3 + p4 + p5 AS q2, p4 + p5 AS q3, p5 AS q4 FROM c)
SELECT id, concat(CAST(label > 1 AS INT), CAST(label > 2 AS INT), CAST(label > 3 AS INT), CAST(label > 4 AS INT)) AS targets, concat(CAST(label >= 1 AS INT), CAST(label >= 2 AS INT), CAST(label >= 3 AS INT), CAST(label >= 4 AS INT)) AS used,
pred AS argmax_class, CAST(round(q1, 9) > 0.5 AS INT) + CAST(round(q2, 9) > 0.5 AS INT) + CAST(round(q3, 9) > 0.5 AS INT) + CAST(round(q4, 9) > 0.5 AS INT) + 1 AS threshold_class,
CAST(round_even(round(q1 + q2 + q3 + q4, 6), 0) AS INT) + 1 AS expected_class, round(p1 * p2 * p3, 6) AS corn_third, true AS fine FROM q"""))
def decoders(spark, sf_dir):
    p = predictions(spark, sf_dir)
    tail = F.transform("probs", lambda _, i: F.round(F.aggregate(F.slice("probs", i + 2, F.lit(5)), F.lit(0.0), lambda s, x: s + x), 9))
    p = p.withColumn("q", F.slice(tail, 1, 4))
    back = J.cumulative_to_class(F.col("q"))
    bits = lambda a: F.array_join(F.transform(a, lambda x: x.cast("int").cast("string")), "")
    corn = J.corn_targets(F.col("label"))
    total = F.aggregate("q", F.lit(0.0), lambda s, x: s + x)
    return p.select(
        "id", bits(J.ordinal_targets(F.col("label"))).alias("targets"), bits(F.transform(corn, lambda t: t["used"])).alias("used"), J.decode(F.col("probs"), F.col("q"), "argmax").alias("argmax_class"),
        J.decode(back, F.col("q"), "threshold").alias("threshold_class"), J.decode(back, F.array(F.round(total, 6)), "expected").alias("expected_class"),
        F.round(J.corn_probs(F.col("probs"))[2], 6).alias("corn_third"), J.prob_contract(back, F.col("q")).alias("fine"),
    )


@query(sql(f"""WITH {PRED}, t AS (SELECT CAST(i - 1 AS INT) AS task, CAST(label > i AS INT) AS y FROM pd, range(1, 5) r(i) WHERE label >= i)
SELECT task, round(CASE WHEN sum(y) > 0 THEN least(10.0, sum(1 - y) / sum(y)) ELSE 10.0 END, 6) AS weight FROM t GROUP BY 1"""))
def corn_pos_weights(spark, sf_dir):
    return rounded(J.corn_pos_weights(predictions(spark, sf_dir)), "weight")


DECODED = """q AS (SELECT label, pred, [(w2 + w3 + w4 + w5) / t, (w3 + w4 + w5) / t, (w4 + w5) / t, w5 / t] AS q FROM pd),
dd AS (SELECT label, pred AS argmax, 1 + len(list_filter(q, lambda x: round(x, 9) > 0.5)) AS threshold, 1 + CAST(round_even(round(list_sum(q), 6), 0) AS INT) AS expected, least(5, pred + 1) AS up, greatest(1, pred - 1) AS down, q FROM q)"""
WAYS = ("argmax", "threshold", "expected", "up", "down")
FIGURES = ", ".join(f"(SELECT avg(CAST({w} = label AS INT)) FROM dd) AS {w}_accuracy, (SELECT avg(f) FROM (SELECT CASE WHEN y + p > 0 THEN 2 * h / (y + p) ELSE 0 END AS f FROM (SELECT k, (SELECT count(*) FROM dd WHERE label = k) AS y, (SELECT count(*) FROM dd WHERE {w} = k) AS p, (SELECT count(*) FROM dd WHERE label = k AND {w} = k) AS h FROM ks))) AS {w}_f1, (SELECT max(c) FROM (SELECT count(*) AS c FROM dd GROUP BY {w})) / (SELECT count(*) FROM dd) AS {w}_top" for w in WAYS)
GAIN = "greatest({0}_accuracy - argmax_accuracy, {0}_f1 - argmax_f1) >= 0.1"


@query(sql(f"""WITH {PRED}, {DECODED}, fg AS (SELECT {FIGURES}), sd AS (SELECT {' AND '.join(f'stddev_pop(q[{i}]) <= 0.001' for i in range(1, 5))} AS still FROM dd),
dg AS (SELECT *, list_filter([CASE WHEN {GAIN.format('up')} OR {GAIN.format('down')} THEN 'LABEL_INDEX_MISMATCH' END, CASE WHEN {GAIN.format('threshold')} OR {GAIN.format('expected')} THEN 'DECODING_ERROR' END, CASE WHEN greatest(argmax_top, threshold_top, expected_top) > 0.8 THEN 'CLASS_COLLAPSE' END, CASE WHEN still THEN 'THRESHOLD_DEGENERACY' END], lambda x: x IS NOT NULL) AS found FROM fg, sd)
SELECT {', '.join(f'round({c}, 6) AS {c}' for c in ('argmax_accuracy', 'argmax_f1', 'up_accuracy', 'up_f1', 'down_accuracy', 'down_f1', 'argmax_top'))}, CASE WHEN len(found) = 0 THEN 'NO_IMPLEMENTATION_ERROR_FOUND' ELSE array_to_string(found, ';') END AS diagnoses FROM dg"""))
def prediction_audit(spark, sf_dir):
    p = predictions(spark, sf_dir)
    total = sum((F.col(f"w{k}") for k in range(2, 6)), F.col("w1"))
    q = F.array(*[sum((F.col(f"w{k}") for k in range(j + 1, 6)), F.col(f"w{j}")) / total for j in range(2, 6)])
    p = p.withColumn("q", q)
    cut = F.transform("q", lambda x: F.round(x, 9))
    whole = F.round(F.aggregate("q", F.lit(0.0), lambda s, x: s + x), 6)
    p = p.withColumns({"threshold": J.decode(F.col("probs"), cut, "threshold"), "expected": J.decode(F.col("probs"), F.array(whole), "expected"), "cumulative": F.col("q")})
    out = J.prediction_audit(p.select("label", "pred", "threshold", "expected", "cumulative"), [-1.0, 0.0, 1.0, 2.0])
    return rounded(out, *[c for c in out.columns if c != "diagnoses"])



@query(sql(f"""WITH {PRED}, g AS (SELECT DISTINCT grp FROM pd), c AS (SELECT grp, k AS class, (SELECT count(*) FROM pd WHERE pd.grp = g.grp AND label = k AND pred = k) AS hit, (SELECT count(*) FROM pd WHERE pd.grp = g.grp AND label = k) AS support, (SELECT count(*) FROM pd WHERE pd.grp = g.grp AND pred = k) AS predicted FROM g, ks),
f AS (SELECT grp, hit, support, CASE WHEN hit > 0 THEN 2.0 * hit / (support + predicted) ELSE 0 END AS f1 FROM c)
SELECT grp, round(sum(hit) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, CAST(sum(support) AS BIGINT) AS rows FROM f GROUP BY 1"""))
def subset_metrics(spark, sf_dir):
    return rounded(J.subset_metrics(predictions(spark, sf_dir), "grp"), "accuracy", "macro_f1").select("grp", "accuracy", "macro_f1", "rows")


RUNS = f"""{PRED}, runs AS (SELECT concat('m', label % 3) AS model, run, round(avg(CAST(pred = label AS INT)), 6) AS acc FROM pd GROUP BY 1, 2)"""


def _runs(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return p.groupBy(F.concat(F.lit("m"), F.col("label") % 3).alias("model"), "run").agg(F.round(F.avg((F.col("pred") == F.col("label")).cast("int")), 6).alias("acc"))


@query(sql(f"WITH {RUNS} SELECT r.model, round(avg(r.acc), 6) AS mean, round(stddev_samp(r.acc), 6) AS std, round(avg(r.acc - b.acc), 6) + 0.0 AS delta, count(*) FILTER (r.acc - b.acc > 0) AS wins, count(*) AS runs FROM runs r JOIN runs b ON b.model = 'm0' AND b.run = r.run GROUP BY 1"))
def multirun_summary(spark, sf_dir):
    return rounded(J.multirun_summary(_runs(spark, sf_dir), "acc", "m0"), "mean", "std", "delta")


@query(sql(f"WITH {RUNS} SELECT model, run, acc, round(avg(acc) OVER (PARTITION BY model ORDER BY run ROWS UNBOUNDED PRECEDING), 8) AS running_mean FROM runs"))
def running_mean(spark, sf_dir):
    return rounded(J.running_mean(_runs(spark, sf_dir), "acc", "model", "run"), "running_mean", n=8)


@query(sql(f"""WITH {RUNS}, m AS (SELECT model, round(avg(acc), 6) AS metric FROM runs GROUP BY 1)
SELECT m.model, m.metric, round(m.metric - b.metric, 6) AS delta, round(m.metric - c.metric, 6) AS control_delta, CASE WHEN m.metric > c.metric THEN 'POSITIVE' ELSE 'NEGATIVE' END AS signal, CASE WHEN m.metric > b.metric THEN 'YES' ELSE 'NO' END AS improves,
row_number() OVER (ORDER BY m.metric DESC, m.model) AS strength_rank FROM m, m b, m c WHERE b.model = 'm0' AND c.model = 'm1' AND m.model <> 'm0'"""))
def compare_experiments(spark, sf_dir):
    m = _runs(spark, sf_dir).groupBy("model").agg(F.round(F.avg("acc"), 6).alias("metric"))
    return rounded(J.compare_experiments(m, "m0", "m1"), "delta", "control_delta")


@query(sql(f"""WITH {PRED}, g AS (SELECT run AS model, k AS class, (SELECT count(*) FROM pd WHERE pd.run = r.run AND label = k AND pred = k) AS hit, (SELECT count(*) FROM pd WHERE pd.run = r.run AND label = k) AS s, (SELECT count(*) FROM pd WHERE pd.run = r.run AND pred = k) AS p FROM (SELECT DISTINCT run FROM pd) r, ks),
f AS (SELECT model, class, round(CASE WHEN hit > 0 THEN 2.0 * hit / (s + p) ELSE 0 END, 6) AS f1 FROM g) SELECT x.model, x.class, x.f1, b.f1 AS base, round(x.f1 - b.f1, 6) AS delta FROM f x JOIN f b ON b.model = 0 AND b.class = x.class WHERE x.model <> 0"""))
def compare_models(spark, sf_dir):
    m = rounded(J.class_metrics(J.confusion(predictions(spark, sf_dir), 5, by=["run"]), ["run"]), "f1").withColumnRenamed("run", "model")
    return rounded(J.compare_models(m, 0), "delta")


@query(sql("""WITH h AS (SELECT model, epoch, metric, coalesce(metric > max(metric) OVER (PARTITION BY model ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM {history}),
b AS (SELECT *, max(CASE WHEN new THEN epoch END) OVER (PARTITION BY model ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS last FROM h), s AS (SELECT model, coalesce(min(epoch) FILTER (epoch - last >= 3), max(epoch)) AS stop_epoch FROM b GROUP BY 1)
SELECT model, stop_epoch, max(epoch) AS best_epoch, max(metric) AS best_metric FROM b JOIN s USING (model) WHERE epoch <= stop_epoch AND new GROUP BY 1, 2"""))
def best_epoch(spark, sf_dir):
    return J.best_epoch(load(spark, sf_dir, "history"), "model", 3)


@query(sql(f"""WITH {PRED}, l AS (SELECT CAST(k - 1 AS INT) AS pos, CASE k WHEN 1 THEN w1 WHEN 2 THEN w2 WHEN 3 THEN w3 WHEN 4 THEN w4 ELSE w5 END / t AS w FROM pd, ks) SELECT pos, round(avg(w), 6) AS mean, round(stddev_pop(w), 6) AS std, 1.0 AS valid FROM l GROUP BY 1"""))
def weight_summary(spark, sf_dir):
    return rounded(J.weight_summary(predictions(spark, sf_dir), "probs"), "mean", "std", "valid")


@query(sql(f"""WITH {PRED} SELECT label, round(avg(w1 / t), 6) AS mean, round(stddev_pop(w1 / t), 6) AS std, round(avg(sqrt(w1 * w1 + w2 * w2) / (sqrt(w1 * w1 + w2 * w2 + w3 * w3 + w4 * w4 + w5 * w5) + 1e-8)), 6) AS ratio,
round(avg(exp(w1 / t) / (exp(w1 / t) + exp(w2 / t) + exp(w3 / t) + exp(w4 / t) + exp(w5 / t))), 6) AS soft FROM pd GROUP BY 1"""))
def gate_statistics(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumns({"gate": F.col("probs")[0], "ratio": J.correction_ratio(F.col("w"), F.slice("w", 1, 2)), "soft": J.softmax(F.col("probs"))[0]})
    more = p.groupBy("label").agg(F.avg("ratio").alias("ratio"), F.avg("soft").alias("soft"))
    return rounded(J.gate_statistics(p, "gate").join(more, "label"), "mean", "std", "ratio", "soft")


@query(sql(f"""WITH {PRED}, n AS (SELECT count(*) AS n FROM pd) SELECT k AS class, (SELECT count(*) FROM pd WHERE label = k) AS true_n, (SELECT count(*) FROM pd WHERE pred = k) AS pred_n, round((SELECT count(*) FROM pd WHERE label = k) / n, 6) AS true_share, round((SELECT count(*) FROM pd WHERE pred = k) / n, 6) AS pred_share FROM ks, n"""))
def prediction_distribution(spark, sf_dir):
    return rounded(J.prediction_distribution(predictions(spark, sf_dir)), "true_share", "pred_share")


@query(sql("""WITH c AS (SELECT 'cheap' AS name, p_retailprice < 2000 AS ok FROM {part} UNION ALL SELECT 'small', p_size <= 25 FROM {part})
SELECT name, CASE WHEN bool_and(ok) THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS runs, count(*) FILTER (NOT ok) AS failed FROM c GROUP BY 1"""))
def rollup_checks(spark, sf_dir):
    runs = load(spark, sf_dir, "part").select(F.to_json(F.create_map(F.lit("cheap"), F.col("p_retailprice") < 2000, F.lit("small"), F.col("p_size") <= 25)).alias("checks"))
    return J.rollup_checks(runs)


@query()
def fit_frequency_model(spark, sf_dir):
    """Accuracy of a multinomial model of the class from the five scores, on a held-out fifth."""
    p = load(spark, sf_dir, "scored")
    fold = F.pmod(F.xxhash64("id"), F.lit(5))
    out = J.fit_frequency_model(p.where(fold != 0), p.where(fold == 0), [f"w{k}" for k in range(1, 6)])
    return rounded(J.macro_metrics(J.confusion(out.where("pred > 0"), 5)), "accuracy", "macro_precision", "macro_recall", "macro_f1", n=3)


@query()
def cross_validated_frequency(spark, sf_dir):
    """One row per fold of a multinomial model of the cells' values, on outer products of row and
    column views of the training cells; the folds are those of the held-out cells."""
    t = load(spark, sf_dir, "train")
    views = lambda key: t.groupBy(F.col(key).alias("id")).agg(F.array(*[F.avg((F.col("freq") == i).cast("double")) for i in range(1, 6)]).alias("vec"))
    pairs = S.pair_features_lookup(load(spark, sf_dir, "held"), views("row_id"), views("col_id"))
    folds = P.stratified_kfold(pairs.withColumn("x", S.outer_products("row_vec", "col_vec")), "freq", ["row_id", "col_id"], 5)
    return rounded(J.cross_validate(folds, "x", "freq"), "accuracy", "macro_precision", "macro_recall", "macro_f1", "running_mean", n=3)
