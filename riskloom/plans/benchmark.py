"""The whole study of a payments table: audit, split, features, a model for each set of features, operating points and rules."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import rule_score
from ..operators import metrics, models, pit
from ..sources import sinks
from ..sources import transactions as src

_TYPES = [f"type_{t.lower()}" for t in src.TYPES]
TRANSACTION_ONLY = ["log_amount", *_TYPES]
HISTORY = [*TRANSACTION_ONLY, "sender_tx_1h", "sender_tx_24h", "sender_amount_24h", "recipient_fanin_24h", "amount_vs_7d_mean"]
RELATIONAL = [*HISTORY, "sender_tx_7d", "recipient_tx_7d", "recipient_amount_24h", "pair_tx_7d", "pair_amount_7d", "sender_recipient_share_7d", "sender_unique_recipients_7d", "recipient_unique_senders_7d"]
BALANCES = ["balance_fraction", "orig_balance_delta", "dest_balance_delta"]
FEATURE_SETS = {"transaction_only": TRANSACTION_ONLY, "transaction_plus_history": HISTORY, "transaction_plus_relational": RELATIONAL, "full_with_simulator_balances": [*RELATIONAL, *BALANCES]}
#: Sets a champion may come from: balances show the simulator's mechanics.
BALANCE_FREE = ["transaction_only", "transaction_plus_history", "transaction_plus_relational"]
POINTS = "roc_auc double, pr_auc double, brier double, threshold double, alerts long, precision double, recall double, legit_flag_rate double, fraud_value_recall double, target_validation_legit_flag_rate double, validation_actual_legit_flag_rate double"
ABLATION = f"model string, n_features int, validation_pr_auc double, {POINTS}"
TARGETS = (0.0002, 0.0005, 0.001, 0.002, 0.005)


def features(tx: DataFrame) -> DataFrame:
    return pit.step_features(tx).select("*", *pit.balance_features())


def select_balance_free_champion(ablation: list[dict]) -> str:
    """The balance-free set of highest average precision on validation, the first of equal ones."""
    rows = [r for r in ablation if r.get("model") in BALANCE_FREE]
    if not rows or any("validation_pr_auc" not in r for r in rows):
        raise ValueError("balance-free rows with their validation_pr_auc are needed")
    return max(rows, key=lambda r: r["validation_pr_auc"])["model"]


def _needed(scored: DataFrame) -> DataFrame:
    return scored.select("is_fraud", "amount", "score")


def _rows(scored: DataFrame, validation: DataFrame, targets: tuple[float, ...]) -> list[dict]:
    """Metrics of later rows at validation's hard cap of each target."""
    caps = models.side_by_side(scored.sparkSession, [partial(metrics.threshold_at_legit_rate, validation, t) for t in targets])
    flagged = validation.agg(*(F.avg(F.when(metrics.legit(), (F.col("score") >= t).cast("int"))) for t in caps)).first()
    return [row | {"target_validation_legit_flag_rate": t, "validation_actual_legit_flag_rate": share} for row, t, share in zip(metrics.at_thresholds(scored, caps), targets, flagged, strict=True)]


def run(spark: SparkSession, tx: DataFrame, out_dir: str | None = None, trees: int = 250, target: float = 0.001, canonical: bool = False) -> dict:
    """Tables and values of the study; with ``out_dir`` also its files. ``canonical`` demands the published shape of the full table.

    Features are written once to ``out_dir`` and read by all models, or kept by the executors without one.
    """
    if canonical:
        src.validate_canonical(tx)
    split = src.determine_split(tx)
    rows = features(tx)
    if out_dir:
        sinks.write_features(rows, f"{out_dir}/features.parquet")
        rows = spark.read.parquet(f"{out_dir}/features.parquet")
    with models.kept(rows) as f:
        train, validation, test = f.where(F.col("step") < split.validation_start), f.where((F.col("step") >= split.validation_start) & (F.col("step") < split.test_start)), f.where(F.col("step") >= split.test_start)
        f.count()  # once, before several models ask for the rows

        def one(name: str, names: list[str]) -> tuple[models.Detector, dict]:
            d = models.fit_detector(train, validation, names, trees)
            with models.kept(_needed(d.score(validation))) as past, models.kept(_needed(d.score(test))) as scored:
                return d, {"model": name, "n_features": len(names), "validation_pr_auc": metrics.average_precision(past).first()[0]} | _rows(scored, past, (target,))[0]

        fitted = models.side_by_side(spark, [partial(one, *s) for s in FEATURE_SETS.items()])
        ablation, detectors = [row for _, row in fitted], {name: d for name, (d, _) in zip(FEATURE_SETS, fitted, strict=True)}
        champion = select_balance_free_champion(ablation)
        with models.kept(_needed(detectors[champion].score(test))) as scored, models.kept(_needed(detectors[champion].score(validation))) as past:
            points = _rows(scored, past, TARGETS)
        rule = lambda df: df.withColumn("score", rule_score())
        cap = metrics.threshold_at_legit_rate(rule(validation), target)
        one = lambda cond: test.withColumn("score", rule_score()).agg(*metrics.alert_columns(cond)).first().asDict()
        out = {
            "audit": src.audit(tx).first().asDict(), "split": {"train_cut": split.validation_start, "validation_cut": split.test_start}, "source_rule": one(F.col("is_flagged_fraud") == 1),
            "simple_amount_type_rule": one(F.col("score") >= cap) | {"threshold_log_amount": cap, "target_validation_legit_flag_rate": target}, "fraud_value_concentration": metrics.value_concentration(test).first().asDict(), "feature_sets": FEATURE_SETS,
            "model_ablation": ablation, "balance_free_reference_model": champion, "operating_points": points, "split_summary": [r.asDict() for r in src.split_summary(tx, split).collect()],
        }
    if out_dir:
        for name, columns in (("model_ablation", ABLATION), ("operating_points", POINTS)):
            sinks.write_csv(models._table(tx, out[name], columns), f"{out_dir}/{name}")
        sinks.write_csv(src.split_summary(tx, split), f"{out_dir}/split_summary")
        sinks.write_summary(out, f"{out_dir}/summary.json")
    return out
