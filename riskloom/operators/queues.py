"""Investigation queues under limited review capacity."""

from __future__ import annotations

import math
from contextlib import ExitStack

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import ratio
from .metrics import count, fraud, legit, value
from .order import among, average_place, counted, firsts, joined, kept, quantiles

NOVEL = "novel_shared_device_microburst"


def novel() -> Column:
    return F.col("fraud_type") == NOVEL


def percentile_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the average rank over the number of rows."""
    return average_place(df, column, name)


RANKED = ("score", "anomaly", "amount")


def with_hybrid(df: DataFrame, of: dict[str, DataFrame] | None = None) -> DataFrame:
    """Adds the hybrid priority: the larger percentile rank of score and anomaly, then amount. ``of``: rows counted by each of RANKED, if the caller has them."""
    rows = df
    for c in RANKED:
        df = average_place(df, c, f"{c}_rank", rows, of and of[c])
    return df.withColumn("hybrid", F.greatest("score_rank", "anomaly_rank") + 1e-4 * F.col("amount_rank"))


def lanes_of(k: int, share: float) -> tuple[int, int]:
    """Places of both lanes: exploration gets its share by half-even rounding, one at least where there are two places; none at share 0."""
    explore = max(1, round(k * share)) if share > 0 and k > 1 else 0
    return k - explore, explore


def two_lane(df: DataFrame, k: int, share: float = 0.2, model: str = "score", anomaly: str = "anomaly") -> DataFrame:
    """The k rows of review: most by model score, a fixed share of the others by anomaly. Ties by id."""
    exploit, explore = lanes_of(k, share)
    taken = _first(df, model, exploit)
    rest = joined(df, taken[0], [], "left").where(~taken[1])
    lane = joined(df, taken[0], [], "left").where(taken[1]).select(*df.columns, F.lit("exploit").alias("lane"))
    if not explore:
        return lane
    rest = rest.select(*df.columns)
    more = _first(rest, anomaly, explore)
    return lane.unionByName(joined(rest, more[0], [], "left").where(more[1]).select(*df.columns, F.lit("explore").alias("lane")))


def _first(df: DataFrame, column: str, k: int) -> tuple[DataFrame, Column]:
    """One row that says where the first ``k`` rows end, and the condition to be among them; all are if there aren't so many."""
    wanted = df.sparkSession.createDataFrame([(0, k)], "_i int, _n long")
    ends = firsts(df, column, wanted).select(F.col("_v").alias("_end"), F.col("_t").alias("_last"))
    return ends, F.col("_end").isNull() | among(column, "_end", "transaction_id", "_last") if k > 0 else F.lit(False)


def _selections(df: DataFrame, plans: list[tuple[str, int, float, int, int]]) -> DataFrame:
    """Metrics of each plan (queue, capacity, share, places by the queue's priority, places of exploration).

    No row is ranked: the last row that each plan takes is looked up among the rows summed by priority. A row explores
    if it is among the first by anomaly once those that the model takes are left out; only rows within the whole capacity
    by anomaly can be. The rows, and their counts by value, are kept on the executors meanwhile, so that counts that turn
    out to be few are ordered at once and not digit by digit (``order.large``); a row for each plan is read.
    """
    spark, hybrid = df.sparkSession, any(q == "hybrid" for q, *_ in plans)
    number = lambda rows: spark.createDataFrame(rows, "_i int, _n long")
    with ExitStack() as held:

        def counts(rows: DataFrame, column: str) -> DataFrame:
            g = held.enter_context(kept(counted(rows, column)))
            g.count()  # its size is known from here on
            return g

        of = {c: counts(df, c) for c in (RANKED if hybrid else RANKED[:2])}
        rows = held.enter_context(kept((with_hybrid(df, of) if hybrid else df).select("transaction_id", "is_fraud", "fraud_type", "amount", "score", "anomaly", *["hybrid"] * hybrid)))
        n, ends = rows.count(), {}
        if hybrid:
            of["hybrid"] = counts(rows, "hybrid")
        for column in ("score", "hybrid"):
            wanted = [(i, min(e, n)) for i, (q, _, _, e, _) in enumerate(plans) if (q == "hybrid") == (column == "hybrid") and min(e, n)]
            if wanted:
                ends |= {r["_i"]: (column, r["_v"], r["_t"]) for r in firsts(rows, column, number(wanted), g=of[column]).collect()}
        taken = {i: among(ends[i][0], F.lit(ends[i][1]), "transaction_id", F.lit(ends[i][2])) if i in ends else F.lit(False) for i in range(len(plans))}
        exploring = [i for i, (*_, x) in enumerate(plans) if x and n]
        if exploring:
            last = firsts(rows, "anomaly", number([(0, min(n, max(plans[i][3] + plans[i][4] for i in exploring)))]), g=of["anomaly"]).first()
            near = rows.where(among("anomaly", F.lit(last["_v"]), "transaction_id", F.lit(last["_t"]))).select("transaction_id", "anomaly", F.explode(F.array_compact(F.array(*(F.when(~taken[i], F.lit(i)) for i in exploring)))).alias("_g"))
            sizes = F.create_map(*(F.lit(v) for i in exploring for v in (i, plans[i][4])))
            wanted = near.groupBy("_g").agg(F.count("*").alias("_c")).select("_g", F.lit(0).alias("_i"), F.least("_c", sizes[F.col("_g")]).cast("long").alias("_n"))
            for r in firsts(near, "anomaly", wanted, ["_g"]).collect():
                taken[r["_g"]] = taken[r["_g"]] | among("anomaly", F.lit(r["_v"]), "transaction_id", F.lit(r["_t"]))
        r9 = lambda a, b: F.round(ratio(a, b), 9)
        cells = []
        for i, (queue, capacity, share, *_) in enumerate(plans):
            of = lambda cond, i=i: count(taken[i] & cond)
            names = {"queue": F.lit(queue), "capacity_per_10k": F.lit(capacity), "exploration_share": F.lit(share), "review_n": count(taken[i]).cast("long"), "precision": r9(of(fraud()), count(taken[i])), "fraud_recall": r9(of(fraud()), count(fraud())), "fraud_value_recall": r9(value(fraud() & taken[i]), value(fraud())), "novel_fraud_recall": r9(of(novel()), count(novel()))}
            cells.append(F.struct(*(c.alias(name) for name, c in names.items())))
        out = rows.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("x")).select("x.*")
        return spark.createDataFrame(out.collect(), out.schema)


def _capacity(n: int, per_10k: float) -> int:
    return max(1, math.ceil(n * per_10k / 10_000))


def queue_metrics(df: DataFrame, capacities=(25, 50, 100, 200)) -> DataFrame:
    """Model, hybrid and two-lane queues at each capacity, ceil(n * per10k / 10000)."""
    n, plans = df.count(), []
    for c in capacities:
        k = _capacity(n, c)
        plans += [("model", c, 0.0, k, 0), ("hybrid", c, 0.0, k, 0), ("two_lane_80_20", c, 0.2, *lanes_of(k, 0.2))]
    return _selections(df, plans).drop("exploration_share")


def exploration_sensitivity(df: DataFrame, capacities=(100, 200), shares=(0.0, 0.1, 0.2, 0.3, 0.4)) -> DataFrame:
    """Two-lane queues for each capacity and share of exploration; share 0 is the model's queue."""
    n = df.count()
    plans = [("two_lane", c, float(s), *lanes_of(_capacity(n, c), s)) for c in capacities for s in shares]
    return _selections(df, plans).select("capacity_per_10k", "exploration_share", "fraud_value_recall", "novel_fraud_recall", "precision")


def lanes(df: DataFrame, review: float, block: float, anomaly: float) -> DataFrame:
    """All rows with their lane (null: no candidate), whether they are blocked, and their hour since the epoch."""
    p = F.col("score")
    exploit = (p >= review) & (p < block)
    explore = (F.col("anomaly") > anomaly) & (p < block) & ~exploit
    return df.withColumn("lane", F.when(exploit, "exploit").when(explore, "explore")).withColumn("blocked", p >= block).withColumn("hour", F.floor(F.col("us") / 3_600_000_000).cast("long"))


def hourly_arrivals(rows: DataFrame) -> DataFrame:
    """Arrivals of each lane for every hour between the first and the last row, candidates or not."""
    g = rows.groupBy("hour").agg(count(F.col("lane") == "exploit").cast("long").alias("exploit"), count(F.col("lane") == "explore").cast("long").alias("explore"))
    span = g.agg(F.min("hour").alias("a"), F.max("hour").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("hour"))
    return span.join(g, "hour", "left").select("hour", F.coalesce("exploit", F.lit(0)).alias("exploit"), F.coalesce("explore", F.lit(0)).alias("explore"))


def slots_by_hour(hours: int, capacity: float, share: float) -> list[tuple[int, int]]:
    """(slots, of them reserved for exploration) of each hour: fractions are carried over; an hour without slots credits no exploration."""
    out, token, reserve = [], 0.0, 0.0
    for _ in range(hours):
        token += capacity
        slots = math.floor(token + 1e-12)
        token -= slots
        explore = 0
        if slots > 0:
            reserve += slots * share
            explore = min(slots, math.floor(reserve + 1e-12))
            reserve -= explore
        out.append((slots, explore))
    return out


def admitted(rows: DataFrame, capacity: float = 6.0, multipliers=(1.0,), share: float = 0.2) -> DataFrame:
    """Candidates admitted for each traffic multiplier: each hour its slots, some kept for exploration, unused ones spilling to the other lane.

    Slots depend on the hour's place alone, counted from the first row's hour; more traffic means fewer slots for the same rows.
    """
    if capacity <= 0 or not 0 <= share <= 1 or any(m <= 0 for m in multipliers):
        raise ValueError("a positive capacity, positive multipliers and a share within 0 and 1 are needed")
    a, b = rows.agg(F.min("hour"), F.max("hour")).first()
    plan = [(m, a + i, s, x) for m in multipliers for i, (s, x) in enumerate(slots_by_hour(b - a + 1, capacity / m, share))] if a is not None else []
    slots = F.broadcast(rows.sparkSession.createDataFrame(plan, "traffic_multiplier double, hour long, slots int, x_slots int"))  # hours times multipliers
    candidates = rows.where("lane is not null")
    g = candidates.groupBy("hour").agg(count(F.col("lane") == "exploit").alias("E"), count(F.col("lane") == "explore").alias("X")).join(slots, "hour")
    g = g.withColumn("e0", F.least("E", F.col("slots") - F.col("x_slots"))).withColumn("x0", F.least("X", "x_slots")).withColumn("spare", F.col("slots") - F.col("e0") - F.col("x0"))
    g = g.withColumn("take_e", F.col("e0") + F.least(F.col("E") - F.col("e0"), F.col("spare")))
    g = g.withColumn("take_x", F.col("x0") + F.least(F.col("X") - F.col("x0"), F.col("spare") - (F.col("take_e") - F.col("e0"))))
    order = F.when(F.col("lane") == "exploit", F.col("score")).otherwise(F.col("anomaly"))
    r = candidates.withColumn("r", F.row_number().over(Window.partitionBy("hour", "lane").orderBy(order.desc(), "transaction_id")))
    taken = F.col("r") <= F.when(F.col("lane") == "exploit", F.col("take_e")).otherwise(F.col("take_x"))
    return r.join(g.select("traffic_multiplier", "hour", "take_e", "take_x"), "hour").where(taken).drop("r", "take_e", "take_x")


def adaptive_routing(rows: DataFrame, capacity: float = 6.0, multipliers=(1.0, 1.5, 2.0, 4.0), share: float = 0.2) -> DataFrame:
    """What admission under capacity does at each traffic multiplier."""
    chosen = admitted(rows, capacity, multipliers, share)
    hours = rows.groupBy("hour").agg(count(F.col("lane").isNotNull()).alias("n"))
    span = hours.agg((F.max("hour") - F.min("hour") + 1).alias("hours"), F.max("n").cast("long").alias("max_hourly_candidates_source_stream"))
    lane, blocked = F.col("lane").isNotNull(), F.col("blocked")
    total = rows.agg(
        count(lane).cast("long").alias("candidate_n"), value(fraud()).alias("v"), value(fraud() & lane).alias("cv"), count(novel()).alias("nv"), count(novel() & lane).alias("cnv"), count(legit()).alias("l"), value(fraud() & blocked).alias("bv"), count(novel() & blocked).alias("bn"),
    ).crossJoin(span)
    every = rows.sparkSession.createDataFrame([(float(m),) for m in multipliers], "traffic_multiplier double")
    by_hour = chosen.groupBy("traffic_multiplier", "hour").agg(
        F.count("*").alias("n"), value(fraud()).alias("sv"), count(novel()).alias("sn"), count(legit()).alias("sl"), F.min(F.when(F.col("lane") == "exploit", F.col("score"))).alias("ce"), F.min(F.when(F.col("lane") == "explore", F.col("anomaly"))).alias("cx")
    )
    for c in ("ce", "cx"):  # a row for each hour
        by_hour = by_hour.selectExpr("*", f"CASE WHEN {c} IS NOT NULL THEN row_number() OVER (PARTITION BY traffic_multiplier ORDER BY {c} NULLS LAST) END AS {c}_r", f"count({c}) OVER (PARTITION BY traffic_multiplier) AS {c}_n")
    middle = lambda c: F.expr(f"avg(CASE WHEN {c}_r IN (({c}_n + 1) DIV 2, ({c}_n + 2) DIV 2) THEN {c} END) AS {c}")
    got = by_hour.groupBy("traffic_multiplier").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("sv").alias("sv"), F.sum("sn").alias("sn"), F.sum("sl").alias("sl"), middle("ce"), middle("cx"))
    x = every.join(got, "traffic_multiplier", "left").crossJoin(total).withColumn("n", F.coalesce("n", F.lit(0))).na.fill(0, ["sv", "sn", "sl", "most"])  # one row a multiplier
    r9, least = lambda c: F.round(c, 9), lambda c: F.greatest(F.col(c).cast("double"), F.lit(1e-12))
    one = lambda c: F.greatest(F.col(c).cast("double"), F.lit(1.0))
    scaled = F.col("n") * F.col("traffic_multiplier") / one("hours")
    return x.select(
        "traffic_multiplier", F.lit(float(capacity)).alias("analyst_capacity_per_hour"), F.lit(float(share)).alias("exploration_share"), "candidate_n", F.col("n").cast("long").alias("admitted_n_source_stream"), r9(F.col("n") / one("candidate_n")).alias("candidate_acceptance_rate"),
        r9(scaled).alias("scaled_reviews_per_hour"), r9(scaled / capacity).alias("capacity_utilisation_after_admission"), r9(F.col("sv") / least("v")).alias("analyst_reviewed_fraud_value_share"), r9(F.col("sv") / least("cv")).alias("candidate_fraud_value_retention"),
        r9((F.col("sv") + F.col("bv")) / least("v")).alias("system_fraud_value_coverage_with_blocks"), r9(F.col("sn") / one("nv")).alias("analyst_reviewed_novel_recall"), r9(F.col("sn") / one("cnv")).alias("candidate_novel_retention"),
        r9(F.try_divide(F.col("sn") + F.col("bn"), F.col("nv"))).alias("system_novel_recall_with_blocks"), r9(F.try_divide(F.col("sl"), F.col("l"))).alias("legitimate_review_rate"), r9(F.col("candidate_n") / one("hours")).alias("mean_hourly_candidates_source_stream"),
        "max_hourly_candidates_source_stream", F.col("most").cast("long").alias("max_hourly_admitted_source_stream"), r9("ce").alias("median_dynamic_exploit_cutoff"), r9("cx").alias("median_dynamic_explore_cutoff"),
    )


SLA = "traffic_multiplier double, analyst_capacity_per_hour double, exploration_share double, hours long, observed_candidate_arrival_rate_per_hour double, scaled_arrival_rate_per_hour double, arrivals double, served double, capacity_utilisation double, max_backlog_cases double, final_backlog_cases double, hours_with_backlog_rate double, max_wait_proxy_hours double, stable_by_end boolean, meets_4h_sla_proxy boolean"


def sla_stress(rows: DataFrame, capacities=(4.0, 6.0, 8.0), multipliers=(0.5, 1.0, 1.5, 2.0, 4.0), share: float = 0.2) -> DataFrame:
    """Backlogs of both lanes hour by hour for each capacity and traffic multiple: a recurrence over hours, each scenario in one group of one row an hour.

    Capacity that a lane leaves goes to the longer backlog first, exploitation on a tie.
    """
    grid = rows.sparkSession.createDataFrame([(c, m) for c in capacities for m in multipliers], "capacity double, multiplier double")
    hours = hourly_arrivals(rows).crossJoin(F.broadcast(grid))  # 15 scenarios

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        capacity, multiple = key
        reserved = capacity * share
        backlog, most, served, arrived, behind = [0.0, 0.0], 0.0, 0.0, 0.0, 0
        for new in pdf.sort_values("hour")[["exploit", "explore"]].itertuples(index=False):
            arrived += (new[0] + new[1]) * multiple
            backlog = [b + n * multiple for b, n in zip(backlog, new, strict=True)]
            spare = capacity
            for lane, room in ((0, capacity - reserved), (1, reserved)):
                done = min(backlog[lane], room)
                backlog[lane] -= done
                spare -= done
            for lane in (0, 1) if backlog[0] >= backlog[1] else (1, 0):
                done = min(backlog[lane], spare)
                backlog[lane] -= done
                spare -= done
            served += capacity - spare
            most, behind = max(most, sum(backlog)), behind + (sum(backlog) > 1e-9)
        n, last = len(pdf), sum(backlog)
        rate, used, wait = arrived / multiple / n, arrived / max(capacity * n, 1e-9), most / max(capacity, 1e-9)
        row = (multiple, capacity, share, n, rate, rate * multiple, arrived, served, used, most, last, behind / n, wait, last < 1e-9, used < 1.0 and wait <= 4.0)
        return pd.DataFrame([row], columns=[c.split()[0] for c in SLA.split(", ")])

    return hours.groupBy("capacity", "multiplier").applyInPandas(run, SLA)


def investigation_queue(df: DataFrame, n: int = 100) -> DataFrame:
    """The n rows of highest priority, the larger of the percentile ranks of score and anomaly, with reasons; highest first, then larger amounts.

    Rows need the payment features that reasons name.
    """
    both = F.explode(F.array(*(F.struct(F.lit(i).alias("_of"), F.col(c).cast("double").alias("v")) for i, c in enumerate(("score", "anomaly")))))
    q = quantiles(counted(df.select(both.alias("x")).select("x.*"), "v", ("_of",)), "v", [0.99], ("_of",)).agg(*(F.max(F.when(F.col("_of") == i, F.col("q")[0])).alias(c) for i, c in enumerate(("_qs", "_qa"))))
    rows = df.select("score", "anomaly")
    for c in ("score", "anomaly"):
        df = average_place(df, c, f"{c}_rank", rows)
    top = df.withColumn("priority_percentile", F.greatest("score_rank", "anomaly_rank")).orderBy(F.desc("priority_percentile"), "transaction_id").limit(n).crossJoin(q)  # one row
    reasons = F.concat_ws(
        "|", F.when(F.col("score") >= F.col("_qs"), "HIGH_MODEL_RISK"), F.when(F.col("anomaly") >= F.col("_qa"), "BEHAVIOURAL_TAIL"), F.when(F.col("device_unique_senders_24h") >= 3, "SHARED_DEVICE"),
        F.when(F.col("sender_tx_1h") >= 3, "RAPID_SENDER_VELOCITY"), F.when(F.col("recipient_fanin_24h") >= 5, "RECIPIENT_CONCENTRATION"),
    )
    shown = ["transaction_id", "us", "sender", "recipient", "type", "amount", "sender_tx_1h", "sender_tx_24h", "recipient_fanin_24h", "device_activity_24h", "device_unique_senders_24h", "is_fraud", "fraud_type"]
    out = top.select(*shown, F.col("score").alias("model_score"), F.col("anomaly").alias("anomaly_score"), F.round("priority_percentile", 9).alias("priority_percentile"), F.when(reasons == "", "RISK_RANK").otherwise(reasons).alias("reason_codes"))
    return out.orderBy(F.desc("priority_percentile"), F.desc("amount"), "transaction_id")
