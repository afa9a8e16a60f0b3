"""Models, their calibration, and studies that train them again under other labels.

Each study keeps its input while it runs, bins its features once by rows that every fold may learn from, and gives a
table of a few rows. Trees are those of ``boosting``; scores differ from other libraries' where these draw rows otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scoring import adjust_for_prior, ratio, two_proportion_sample_size
from . import boosting
from .metrics import average_precision, brier, calibration_bin, count, fraud, legit, model_metrics, threshold_at_fpr, value
from .order import among, counted, joined, kept, quantile, quantiles

NOVEL = "novel_shared_device_microburst"


def balanced(df: DataFrame) -> DataFrame:
    """Adds the weight ``_w`` that gives both classes half of the total."""
    n, f = df.agg(F.count("*"), F.sum("is_fraud")).first()
    if not f or f == n:
        raise ValueError("both classes are required")
    return df.withColumn("_w", F.when(fraud(), n / (2 * f)).otherwise(n / (2 * (n - f))))


def _vector(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep")


def _scored(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, vector_to_array("_p")[1]).drop("_x", "_z", "_p", "_r", "_l", "_w")


_OUT = {"probabilityCol": "_p", "rawPredictionCol": "_r", "predictionCol": "_l", "labelCol": "is_fraud"}


def fit_logistic(df: DataFrame, features: list[str], c: float = 0.5) -> PipelineModel:
    """Balanced ridge logistic regression on standardised features; ``c`` is the inverse penalty of a sum of losses."""
    df = balanced(df)
    reg = LogisticRegression(featuresCol="_z", weightCol="_w", regParam=1 / (c * df.count()), standardization=False, maxIter=500, **_OUT)
    return Pipeline(stages=[_vector(features), StandardScaler(withMean=True, inputCol="_x", outputCol="_z"), reg]).fit(df)


def fit_trees(df: DataFrame, features: list[str], trees: int = 160, edges: list[list[float]] | None = None) -> boosting.Boosted:
    """Balanced boosted trees of at most 31 leaves."""
    return boosting.fit(balanced(df), features, trees, weight="_w", edges=edges)


def _logit(c: str) -> Column:
    p = F.least(F.greatest(F.col(c), F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def fit_sigmoid(scored: DataFrame, column: str = "raw") -> PipelineModel:
    """Logistic regression on the logit of a score, all but free of penalty."""
    return Pipeline(stages=[_vector(["_logit"]), LogisticRegression(featuresCol="_x", regParam=1e-9, maxIter=200, **_OUT)]).fit(scored.withColumn("_logit", _logit(column)))


def calibrate(calibrator: PipelineModel, scored: DataFrame, column: str = "raw") -> DataFrame:
    return _scored(calibrator.transform(scored.withColumn("_logit", _logit(column))), "score").drop("_logit")


@dataclass
class Detector:
    """A model, its calibration, and the threshold that flags ``fpr`` of the legitimate rows it was calibrated on."""

    model: boosting.Boosted
    calibrator: PipelineModel
    threshold: float

    def score(self, df: DataFrame) -> DataFrame:
        return calibrate(self.calibrator, self.model.score(df, "raw"))

    def save(self, spark: SparkSession, path: str) -> None:
        """Trees and threshold as one row of JSON, and the calibrator beside it, in any store that Spark writes to. What is there is replaced."""
        spark.createDataFrame([(self.model.to_json(), self.threshold)], "model string, threshold double").coalesce(1).write.mode("overwrite").json(f"{path}/trees")
        self.calibrator.write().overwrite().save(f"{path}/calibrator")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Detector:
        row = spark.read.schema("model string, threshold double").json(f"{path}/trees").first()
        return Detector(boosting.Boosted.from_json(row["model"]), PipelineModel.load(f"{path}/calibrator"), row["threshold"])


def fit_detector(train: DataFrame, validation: DataFrame, features: list[str], trees: int = 160, fpr: float = 0.01, edges: list[list[float]] | None = None) -> Detector:
    model = fit_trees(train, features, trees, edges)
    with kept(model.score(validation, "raw").select("is_fraud", "raw")) as raw:
        out = Detector(model, fit_sigmoid(raw), 0.0)
        out.threshold = threshold_at_fpr(calibrate(out.calibrator, raw), fpr)
    return out


def side_by_side(spark: SparkSession, fits: list[Callable[[], object]], most: int = 4) -> list:
    """Results of fits that don't depend on each other, in their order; ``most`` of them run at a time.

    What a tree waits for is short jobs of few tasks, so one model alone leaves most cores idle.
    """
    with ThreadPool(max(1, min(most, len(fits)))) as pool:
        return pool.map(lambda fit: fit(), list(map(inheritable_thread_target(spark), fits)), 1)


def tested(d: Detector, test: DataFrame):
    """The scored rows that metrics read, kept while in use: trees are walked once and not for each metric."""
    return kept(d.score(test).select("is_fraud", "fraud_type", "amount", "score"))


def evaluate(scored: DataFrame, threshold: float, types: tuple[str, ...] = ()) -> dict:
    """Metrics of scored rows at a threshold; undefined ratios are None."""
    flag, novel = F.col("score") >= threshold, F.col("fraud_type") == NOVEL
    share = lambda cond: ratio(count(flag & cond), count(cond))
    row = scored.agg(
        brier(), F.count("*").alias("test_n"), F.avg("is_fraud").alias("test_fraud_rate"), share(legit()).alias("legit_flag_rate"), share(fraud()).alias("fraud_recall"), share(fraud() & ~novel).alias("known_fraud_recall"),
        share(novel).alias("novel_fraud_recall"), ratio(value(flag & fraud()), value(fraud())).alias("fraud_value_recall"), *(share(F.col("fraud_type") == t).alias(f"recall_{t}") for t in types),
    )
    return row.first().asDict() | {"pr_auc": average_precision(scored).first()[0]}


def _table(df: DataFrame, rows: list[dict], columns: str) -> DataFrame:
    names = [c.split()[0] for c in columns.split(", ")]
    return df.sparkSession.createDataFrame([tuple(r.get(n) for n in names) for r in rows], columns)


METRICS = "pr_auc double, brier double, legit_flag_rate double, fraud_recall double, known_fraud_recall double, novel_fraud_recall double, fraud_value_recall double"


def rolling_backtest(df: DataFrame, features: list[str], first_end: int, step: int, folds: int = 5, trees: int = 160) -> DataFrame:
    """Folds of growing training days, ``step`` days to calibrate on and as many to test; folds that lack a class are left out."""
    with kept(df) as all_:
        edges = boosting.edges_of(all_.where(F.col("day") < first_end), features)

        def fold(end: int) -> dict | None:
            train, validation, test = (all_.where(F.col("day").between(a, b - 1)) for a, b in ((0, end), (end, end + step), (end + step, end + 2 * step)))
            if any(part.select("is_fraud").distinct().count() < 2 for part in (train, validation, test)):
                return None
            d = fit_detector(train, validation, features, trees, edges=edges)
            with tested(d, test) as scored:
                return {"train_end_day": end, "validation_days": f"{end}-{end + step - 1}", "test_days": f"{end + step}-{end + 2 * step - 1}", "threshold": d.threshold} | evaluate(scored, d.threshold)

        rows = side_by_side(df.sparkSession, [partial(fold, end) for end in range(first_end, first_end + folds * step, step)])
    return _table(df, [r for r in rows if r], f"train_end_day int, validation_days string, test_days string, test_n long, test_fraud_rate double, threshold double, {METRICS}")


def delayed_label_retraining(df: DataFrame, features: list[str], calibration: tuple[int, int] = (42, 48), start: int = 54, delay: int = 7, trees: int = 160) -> DataFrame:
    """Training on labels that have matured before the test days, against training on all labels before them."""
    with kept(df) as all_:
        validation, test = all_.where(F.col("day").between(calibration[0], calibration[1] - 1)), all_.where(F.col("day") >= start)
        edges = boosting.edges_of(all_.where(F.col("day") < start - delay), features)

        def view(name: str, end: int) -> dict:
            train = all_.where(F.col("day") < end)
            d = fit_detector(train, validation, features, trees, edges=edges)
            last = train.agg(F.max("day")).first()[0]
            with tested(d, test) as scored:
                return {"training_view": name, "available_training_end_day": last, "test_start_day": start} | evaluate(scored, d.threshold)

        rows = side_by_side(df.sparkSession, [partial(view, *v) for v in ((f"asof_{delay}d_delay", start - delay), ("oracle_instant_labels", start))])
    return _table(df, rows, f"training_view string, available_training_end_day int, test_start_day int, {METRICS}")


def fit_tail(df: DataFrame, features: list[str]) -> dict[str, float]:
    """99th percentile of log1p of each feature, 1e-6 at least; no labels are used but to leave frauds out beforehand."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.log1p(c).alias("v")) for c in features)))
    g = counted(df.select(each.alias("x")).select("x.*"), "v", ["feature"])
    q = {r["feature"]: r["q"][0] for r in quantiles(g, "v", [0.99], ["feature"]).collect()}  # a row for each feature
    return {c: max(q.get(c) or 0.0, 1e-6) for c in features}


def tail_score(scales: dict[str, float]) -> Column:
    """The largest of the features, each on the scale of its own tail."""
    parts = [F.log1p(c) / F.lit(s) for c, s in scales.items()]
    return F.greatest(*parts) if len(parts) > 1 else parts[0]


def feedback_curve(df: DataFrame, features: list[str], tails: list[str], days: tuple[int, int, int] = (42, 48, 54), budgets=(0, 10, 50, 100, 200, 500), trees: int = 160) -> DataFrame:
    """Later detection when the rows of the discovery days that rank highest by tail score are labelled at once. ``days`` begin calibration, discovery and future."""
    a, b, c = days
    with kept(df) as all_:
        base, validation, future = all_.where(F.col("day") < a), all_.where(F.col("day").between(a, b - 1)), all_.where(F.col("day") >= c)
        found = all_.where(F.col("day").between(b, c - 1)).withColumn("_tail", tail_score(fit_tail(base.where(legit()), tails)))
        edges = boosting.edges_of(base, features)

        def spent(budget: int) -> dict:
            reviewed = found.orderBy(F.desc("_tail"), "transaction_id").limit(budget).drop("_tail")
            n = reviewed.agg(count(fraud()).alias("f"), count(F.col("fraud_type") == NOVEL).alias("n")).first()
            d = fit_detector(base.unionByName(reviewed), validation, features, trees, edges=edges)
            with tested(d, future) as scored:
                return {"analyst_review_budget": budget, "feedback_fraud_n": n["f"] or 0, "feedback_novel_fraud_n": n["n"] or 0} | evaluate(scored, d.threshold)

        rows = side_by_side(df.sparkSession, [partial(spent, budget) for budget in budgets])
    return _table(df, rows, f"analyst_review_budget int, feedback_fraud_n int, feedback_novel_fraud_n int, {METRICS}")


def verification_bias(df: DataFrame, features: list[str], trigger: Column, days: tuple[int, int] = (36, 48), audits=(0.0, 0.01, 0.05, 0.1, 1.0), seeds=(11, 23), types: tuple[str, ...] = (), trees: int = 160) -> DataFrame:
    """Training on rows that were looked into: those of ``trigger``, of the largest 3 % of amounts, and a random share. Known kinds of fraud are tested."""
    with kept(df) as all_:
        train, validation, test = all_.where(F.col("day") < days[0]), all_.where(F.col("day").between(days[0], days[1] - 1)), all_.where(F.col("day") >= days[1])
        edges = boosting.edges_of(train, features)
        cut, total = quantile(train, "amount", 0.97), train.count()

        def audited(audit: float, seed: int) -> dict | None:
            draw = F.pmod(F.xxhash64(F.lit(seed), "transaction_id"), F.lit(1 << 30)) / float(1 << 30)  # the same rows whenever it is computed
            seen = train.where(trigger | (F.col("amount") >= cut) | (draw < audit))
            n, f, *kinds = seen.agg(F.count("*"), F.sum("is_fraud"), *(count(F.col("fraud_type") == t) for t in types)).first()
            if not f or f == n:
                return None
            d = fit_detector(seen, validation, features, trees, edges=edges)
            with tested(d, test) as scored:
                known = average_precision(scored.where(F.col("fraud_type") != NOVEL)).first()[0]
                return {"audit_rate": audit, "seed": seed, "labelled_train_n": n, "labelled_train_rate": n / total, "labelled_fraud_n": f, "labelled_fraud_rate": f / n, "known_test_pr_auc": known} | {f"labelled_{t}_n": k for t, k in zip(types, kinds, strict=True)} | evaluate(scored, d.threshold, types)

        rows = side_by_side(df.sparkSession, [partial(audited, audit, seed) for audit in audits for seed in seeds])
    rows = [r for r in rows if r]
    extra = "".join(f", labelled_{t}_n long, recall_{t} double" for t in types)
    return _table(df, rows, f"audit_rate double, seed int, labelled_train_n long, labelled_train_rate double, labelled_fraud_n long, labelled_fraud_rate double, known_test_pr_auc double, legit_flag_rate double{extra}")


def mean_and_sd(raw: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    return raw.groupBy(*by).agg(*(f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))))


def _hash_ends(each: DataFrame, repeats: int, sizes: list[tuple[int, int]], n: dict[int, int], spread: float = 8.0) -> DataFrame:
    """(repeat, _i, _end, _t): where the first rows by falling hash ``_h`` end, for each of ``sizes`` (class, rows), by id among equal hashes.

    Hashes are spread evenly, so the end is looked for in a narrow band about its expected place, and only the band's rows
    are ordered. Counts say whether the end is there; where it isn't, bands widen up to all hashes, so ends are exact.
    """
    spark, found = each.sparkSession, []
    todo = [(r, i) for r in range(repeats) for i in range(len(sizes))]
    while todo:
        bands = []
        for i in sorted({i for _, i in todo}):
            y, k = sizes[i]
            low, high = (1 - 2 * (k + s * spread * (math.sqrt(k) + 1)) / n[y] for s in (1, -1))
            low, high = (-(1 << 63) if low <= -1 else int(low * float(1 << 63))), ((1 << 63) - 1 if high >= 1 else int(high * float(1 << 63)))
            bands.append(F.struct(F.lit(i).alias("_i"), F.lit(y).alias("_y"), F.lit(k).cast("long").alias("_k"), F.lit(low).cast("long").alias("_low"), F.lit(min(high, (1 << 63) - 1)).cast("long").alias("_high")))
        rows = each.select("repeat", "is_fraud", "transaction_id", "_h", F.explode(F.array(*bands)).alias("x")).select("*", "x.*").where("is_fraud = _y AND _h >= _low")
        above = rows.groupBy("repeat", "_i").agg(count(F.col("_h") > F.col("_high")).alias("_above"))
        place = Window.partitionBy("repeat", "_i").orderBy(F.desc("_h"), "transaction_id")  # rows of a band, about the root of the rows drawn
        band = rows.where("_h <= _high").withColumn("_place", F.row_number().over(place))
        ends = band.join(F.broadcast(above), ["repeat", "_i"]).where("_above + _place = _k").select("repeat", "_i", "_h", "transaction_id")
        got = [tuple(r) for r in ends.collect()]  # a row for each repeat and size
        found += [r for r in got if (r[0], r[1]) in set(todo)]
        todo = [t for t in todo if t not in {(r[0], r[1]) for r in got}]
        spread *= 64
    return spark.createDataFrame(found, "repeat int, _i int, _end long, _t long")


def prior_shift(scored: DataFrame, source: float, targets=(0.001, 0.0025, 0.005, 0.01, 0.02), repeats: int = 20) -> DataFrame:
    """Errors of probabilities, plain and adjusted, on the largest subsets that have the target share of fraud: one class whole, the other drawn.

    The rows drawn are those of the highest hashes of each repeat and class; all subsets are one aggregation.
    """
    rows = scored.select("transaction_id", "is_fraud", "score")
    n0, n1 = rows.agg(count(legit()), count(fraud())).first()
    if not n0 or not n1:
        raise ValueError("both classes are required")
    plans, sizes = [], []
    for target in targets:
        want = max(1, round(n0 * target / (1 - target)))
        drawn, size = (1, want) if want <= n1 else (0, min(n0, max(1, round(n1 * (1 - target) / target))))
        plans.append(F.struct(F.lit(target).alias("target_prevalence"), F.lit(drawn).alias("_drawn")))
        sizes.append((drawn, size))
    each = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("_h", F.xxhash64("repeat", "transaction_id"))
    ends = _hash_ends(each, repeats, sizes, {0: n0, 1: n1})
    each = each.withColumn("_p", F.explode(F.array(*(F.struct(F.lit(i).alias("_i"), p["target_prevalence"].alias("target_prevalence"), p["_drawn"].alias("_drawn")) for i, p in enumerate(plans))))).select("repeat", "transaction_id", "is_fraud", "score", "_h", "_p.*")
    each = joined(each, F.broadcast(ends), ["repeat", "_i"], "left").where((F.col("is_fraud") != F.col("_drawn")) | F.coalesce(among("_h", "_end", "transaction_id", "_t"), F.lit(False)))
    both = F.array(F.struct(F.lit("unadjusted").alias("method"), F.col("score").alias("p")), F.struct(F.lit("prior_adjusted").alias("method"), adjust_for_prior(F.col("score"), source, F.col("target_prevalence")).alias("p")))
    each = each.withColumn("_m", F.explode(both)).select("repeat", "target_prevalence", "is_fraud", "_m.*")
    q = F.least(F.greatest("p", F.lit(1e-15)), F.lit(1 - 1e-15))
    keys = ["target_prevalence", "repeat", "method"]
    bins = each.groupBy(*keys, calibration_bin(F.col("p")).alias("_bin")).agg(
        F.count("*").alias("n"), F.sum("is_fraud").alias("y"), F.sum("p").alias("s"), F.sum(F.pow(F.col("p") - F.col("is_fraud"), 2)).alias("q"), F.sum(-F.when(fraud(), F.log(q)).otherwise(F.log(1 - q))).alias("l")
    )
    n = F.sum("n")
    return bins.groupBy(*keys).agg(n.alias("n"), (F.sum("y") / n).alias("observed_prevalence"), (F.sum("s") / n).alias("mean_predicted_risk"), (F.sum("q") / n).alias("brier"), (F.sum("l") / n).alias("log_loss"), (F.sum(F.abs(F.col("s") - F.col("y"))) / n).alias("ece_10bin"))


def feature_ablation(train: DataFrame, validation: DataFrame, test: DataFrame, sets: dict[str, list[str]], trees: int = 160) -> DataFrame:
    """Each set of features on all later rows and on those without the novel fraud, at the threshold of 1 % of legitimate validation rows."""

    def one(name: str, features: list[str]) -> list[tuple]:
        d = fit_detector(train, validation, features, trees)
        with tested(d, test) as scored:
            tables = [model_metrics(f"{name}__{label}", part, d.threshold) for label, part in (("all_test", scored), ("known_only", scored.where(F.col("fraud_type") != NOVEL)))]
            return [(row, table.schema) for table in tables for row in table.collect()]  # while the rows are kept

    rows = [r for of_set in side_by_side(train.sparkSession, [partial(one, *s) for s in sets.items()]) for r in of_set]
    return train.sparkSession.createDataFrame([row for row, _ in rows], rows[0][1])


def compare_detectors(test: DataFrame, detectors: dict[str, Column]) -> DataFrame:
    """Recall of known and novel fraud and the legitimate flag rate of each condition, from one pass over the rows."""
    novel = F.col("fraud_type") == NOVEL
    parts = {"known_fraud_recall": fraud() & ~novel, "novel_fraud_recall": novel, "legit_flag_rate": legit()}
    cell = lambda flag, cond: F.round(ratio(count(flag & cond), count(cond)), 9)
    each = [F.struct(F.lit(name).alias("detector"), *(cell(flag, cond).alias(c) for c, cond in parts.items())) for name, flag in detectors.items()]
    return test.agg(F.array(*each).alias("a")).select(F.explode("a").alias("d")).select("d.*")


def fraud_typology(df: DataFrame) -> DataFrame:
    """Number, value and mean of each kind of fraud, and its shares."""
    g = df.where(fraud()).groupBy("fraud_type").agg(F.count("*").alias("transactions"), F.sum("amount").alias("fraud_value"), F.avg("amount").alias("mean_amount"))
    total = g.agg(F.sum("transactions").alias("_n"), F.sum("fraud_value").alias("_v"))
    return g.crossJoin(F.broadcast(total)).select("fraud_type", "transactions", *(F.round(c, 4).alias(c) for c in ("fraud_value", "mean_amount")), F.round(F.col("transactions") / F.col("_n"), 9).alias("transaction_share"), F.round(F.col("fraud_value") / F.col("_v"), 9).alias("value_share"))  # one row of totals


def experiment_design(df: DataFrame, review: float, block: float, reduction: float = 0.25, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """Rows an arm needs to show that fraud in the review band falls by ``reduction``."""
    band = (F.col("score") >= review) & (F.col("score") < block)
    n, p, whole = df.agg(count(band), F.avg(F.when(band, F.col("is_fraud"))), F.avg("is_fraud")).first()
    p = whole if p is None else p
    target = max(1e-6, p * (1 - reduction))
    row = {"eligible_n": n, "baseline_fraud_rate": round(p, 9), "target_fraud_rate": round(target, 9), "required_n_per_arm": two_proportion_sample_size(p, target, alpha, power)}
    return _table(df, [row], "eligible_n long, baseline_fraud_rate double, target_fraud_rate double, required_n_per_arm long")
