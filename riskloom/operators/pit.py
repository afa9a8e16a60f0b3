"""Strict point-in-time features: frames end just before the event, so rows of the same time never see each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import at_places, joined, kept, large, percent_places, running

HOUR = 3_600_000_000


#: A key with more distinct times than PIECE has its time line cut into PARTS ranges of like numbers of them.
PIECE, PARTS, COARSE, DRAWN = 1 << 16, 256, 16, 1 << 12
#: Amounts are summed as whole numbers and two rests of so many bits each, so that what leaves a frame takes away just what it brought.
REST = 1 << 26
BEGIN = -(1 << 62)
#: Rows whose lines a task orders in memory, some 100 MB with what is added to them.
TASK = 1 << 17


def _exact(rows: DataFrame, columns: list[str], kept: list[str]) -> DataFrame:
    """``kept`` and each finite amount i as presence _v, whole number _w and two rests _m and _l: long numbers whose sums are exact. Below 2^-52 it is cut; from 2^63 on it is an error."""
    each = range(len(columns))
    rows = rows.selectExpr(*kept, *(f"CASE WHEN NOT isnan(`{c}`) AND abs(`{c}`) < double('inf') THEN CAST(`{c}` AS DOUBLE) END AS _x{i}" for i, c in enumerate(columns)))
    rows = rows.selectExpr("*", *(f"floor(_x{i}) AS _w{i}" for i in each)).selectExpr("*", *(f"(_x{i} - _w{i}) * {REST}D AS _r{i}" for i in each)).selectExpr("*", *(f"floor(_r{i}) AS _m{i}" for i in each))
    return rows.selectExpr("*", *(f"floor((_r{i} - _m{i}) * {REST}D) AS _l{i}" for i in each), *(f"CASE WHEN _x{i} IS NOT NULL THEN 1 ELSE 0 END AS _v{i}" for i in each))


def crowded(tx: DataFrame, at: str) -> bool:
    """Whether a key may have more than PIECE distinct times: in a large table whose times span so many, of which one row is read to tell."""
    if not large(tx):
        return False
    low, high = tx.agg(F.min(F.col(at).cast("long")), F.max(F.col(at).cast("long"))).first()
    return low is not None and high - low >= PIECE


def _cut_points(times: DataFrame, key: list[str]) -> DataFrame:
    """(key, _cuts, _coarse) of the keys with more than PIECE distinct times: times that part them about evenly, all of them and every COARSE-th.

    They are the same whenever and wherever they are computed, since a plan may compute them for each of its uses: some
    DRAWN times of a key are drawn by hash and ordered, and every cut is one of these.
    """
    hot = times.groupBy(*key).agg(F.count("*").alias("_k")).where(F.col("_k") > PIECE)
    return _parted(times.select(*key, "_at"), hot, key)


def _parted(times: DataFrame, hot: DataFrame, key: list[str]) -> DataFrame:
    drawn = joined(times, hot, key).where(F.pmod(F.xxhash64("_at"), F.col("_k")) < DRAWN)
    cuts = drawn.groupBy(*key).agg(F.sort_array(F.collect_set("_at")).alias("_drawn"))  # about DRAWN times a key
    return cuts.select(*key, F.expr(f"transform(sequence(1, {PARTS - 1}), i -> _drawn[i * size(_drawn) DIV {PARTS}])").alias("_cuts")).withColumn("_coarse", F.expr(f"filter(_cuts, (x, i) -> (i + 1) % {COARSE} = 0)"))


def _piece(at: Column) -> Column:
    """Number of cuts at or before a time; 0 for keys without cuts."""
    k = F.size(F.filter("_coarse", lambda c: c <= at)) * COARSE
    return F.when(F.col("_cuts").isNull(), 0).otherwise(k + F.size(F.filter(F.slice("_cuts", k + 1, COARSE - 1), lambda c: c <= at)))


def _ranged(rows: DataFrame, cuts: DataFrame | None, key: list[str]) -> DataFrame:
    return rows if cuts is None else joined(rows, cuts, key, "left")


def _sightings(base: DataFrame, cuts: DataFrame | None, key: list[str], value: str, back: int, name: str) -> DataFrame:
    """Steps of a distinct count on the time line: up after a value's first sighting, down when none was within ``back``.

    Sightings are followed within ranges of time; where a value's last one in a range reaches its first one in the next
    range that has any, two more steps take back the gap between them.
    """
    seen = base.where(F.col(value).isNotNull()).select(*key, F.col(value).alias("_val"), "_at").distinct()
    seen, part = _ranged(seen, cuts, key), [] if cuts is None else ["_p"]
    if cuts is not None:
        seen = seen.withColumn("_p", _piece(F.col("_at")))
    line = Window.partitionBy(*key, "_val", *part).orderBy("_at")
    before, after = F.lag("_at").over(line), F.lead("_at").over(line)
    step = lambda at, d: F.struct(at.alias("_at"), F.lit(d).cast("long").alias(name))
    seen = seen.withColumn("_up", before.isNull() | (before + back < F.col("_at"))).withColumn("_down", after.isNull() | (after > F.col("_at") + back))
    held = [] if cuts is None else ["_cuts", "_coarse"]
    steps = seen.select(*key, *held, F.explode(F.array_compact(F.array(F.when(F.col("_up"), step(F.col("_at") + 1, 1)), F.when(F.col("_down"), step(F.col("_at") + back + 1, -1))))).alias("_s"))
    if cuts is None:
        # a key's line has no more rows for all its values than it has times
        return steps.select(*key, "_s._at", f"_s.{name}").groupBy(*key, "_at").agg(F.sum(name).alias(name)).select(*key, "_at", F.lit(False).alias("_asks"), name)
    ends = seen.where("_cuts is not null").groupBy(*key, "_val", "_p").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.first("_cuts").alias("_cuts"), F.first("_coarse").alias("_coarse"))
    ends = ends.withColumn("_next", F.lead("_first").over(Window.partitionBy(*key, "_val").orderBy("_p"))).where(F.col("_next") <= F.col("_last") + back)  # a row for each range
    bridges = ends.select(*key, *held, F.explode(F.array(step(F.col("_last") + back + 1, 1), step(F.col("_next") + 1, -1))).alias("_s"))
    return steps.unionByName(bridges).select(*key, F.col("_cuts").isNotNull().alias("_hot"), _piece(F.col("_s._at")).alias("_p"), "_s._at", F.lit(False).alias("_asks"), f"_s.{name}")


def history(tx: DataFrame, key: list[str], at: str, measures: dict[str, tuple[str, str | None, int]], of: DataFrame | None = None, split: bool | None = None) -> DataFrame:
    """Adds measures of the key's rows in [at - back, at): name -> (count, sum, mean or distinct; column; back).

    ``of``: the rows that are measured, where ``tx`` has other features by now. ``split``: whether lines of crowded keys
    are cut; without it the expected size of the rows and the span of their times say so (``crowded``).

    Rows are summed by key and time. Each time steps up on the key's line just after it and down ``back`` later, and so
    does each sighting of a distinct value; a row's measures are the sums of the steps before it, so cost doesn't grow with
    the frames and no set of values is held. The line of a key of very many times is cut into ranges of time: totals of
    the ranges, few rows, give what each one starts with, and every range is a task's work of its own. Rows get their
    measures by a join on key and time.

    Rows of one time never see each other; null keys are a key like any other and lose no rows, rows without a time see
    nothing. Sums and means are null without values; amounts that aren't finite count as missing. Sums are exact as long
    as the whole numbers of a frame stay below 2^63, beyond which they are an error.
    """
    backs = sorted({b for kind, _, b in measures.values() if kind != "distinct"})
    amounts = sorted({c for kind, c, _ in measures.values() if kind in ("sum", "mean")})
    distinct = {name: f"_d{i}" for i, (name, m) in enumerate(measures.items()) if m[0] == "distinct"}
    of = tx if of is None else of
    split = crowded(of, at) if split is None else split
    tx, base = (df.withColumn("_at", F.col(at).cast("long")) for df in (tx, of))
    base = base.where("_at is not null")
    parts = [f"_{p}{i}" for i in range(len(amounts)) for p in "vwml"]
    times = _exact(base, amounts, [*key, "_at"]).groupBy(*key, "_at").agg(F.expr("count(*) AS _n"), *(F.expr(f"coalesce(sum({p}), 0) AS {p}") for p in parts))
    cuts, part = (_cut_points(times, key), ["_p"]) if split else (None, [])
    steps = ", ".join(["struct(_at, 0 AS _b, true AS _asks)", *(f"struct(_at + {b + 1}L AS _at, {i + 1} AS _b, false AS _asks)" for i, b in enumerate(backs))])
    ranges = [F.col("_cuts").isNotNull().alias("_hot"), _piece(F.col("_s._at")).alias("_p")] if split else []
    line = _ranged(times, cuts, key).withColumn("_s", F.expr(f"explode(array({steps}))")).select(*key, *ranges, "_s.*", "_n", *parts)
    for name, d in distinct.items():
        line = line.unionByName(_sightings(base, cuts, key, measures[name][1], measures[name][2], d), allowMissingColumns=True)
    if split:
        sums = lambda p, b: F.sum(F.when(F.col("_b") == b, F.col(p)))
        values, every = ["_n", *parts], range(len(backs) + 1)
        totals = line.where("_hot").groupBy(*key, "_p").agg(*(sums(p, b).alias(f"{p}_{b}") for p in values for b in every), *(F.sum(d).alias(d) for d in distinct.values()))
        earlier = Window.partitionBy(*key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # PARTS rows a key
        starts = [F.struct(F.lit(b).alias("_b"), *(F.sum(f"{p}_{b}").over(earlier).alias(p) for p in values), *((F.sum(d).over(earlier) if b == 0 else F.lit(None).cast("long")).alias(d) for d in distinct.values())) for b in every]
        starts = totals.withColumn("_s", F.array(*starts)).select(*key, "_p", F.explode("_s").alias("_s")).select(*key, F.lit(True).alias("_hot"), "_p", F.lit(BEGIN).cast("long").alias("_at"), F.lit(False).alias("_asks"), "_s.*")
        line = line.unionByName(starts)
    before = f"OVER (PARTITION BY {', '.join([*key, *part])} ORDER BY _at, _asks ROWS UNBOUNDED PRECEDING)"
    frame = lambda p, b: f"(sum(CASE _b WHEN 0 THEN {p} WHEN {backs.index(b) + 1} THEN -{p} END) {before} - {p})"
    out = {}
    for name, (kind, column, back) in measures.items():
        if kind == "count":
            out[name] = frame("_n", back)
        elif kind == "distinct":
            out[name] = f"coalesce(sum({distinct[name]}) {before}, 0)"
        else:
            n, whole, high, low = (frame(f"_{p}{amounts.index(column)}", back) for p in "vwml")
            total = f"CASE WHEN {n} > 0 THEN {whole} + ({high} + {low} / {REST}D) / {REST}D END"
            out[name] = total if kind == "sum" else f"({total}) / {n}"
    found = line.selectExpr(*key, "_at", "_asks", *(f"{x} AS {n}" for n, x in out.items())).where("_asks").drop("_asks")
    rows = joined(tx, found, [*key, "_at"], "left")
    return rows.selectExpr(*(f"`{c}`" for c in tx.columns if c != "_at"), *(f"coalesce({n}, 0) AS {n}" if measures[n][0] in ("count", "distinct") else n for n in measures))


def crowds(rows: DataFrame, keys: list[list[str]]) -> list[DataFrame | None]:
    """(key, _cuts, _coarse) of the keys with more than PIECE rows, times in ``_at``, as a table that the driver holds: 2 KB for each PIECE rows at most. None where there are none.

    Rows are counted by hash first, which moves next to nothing, and by key only where a hash has more than PIECE rows.
    """
    spark, place = rows.sparkSession, lambda key: f"pmod(xxhash64({', '.join(key)}), {PIECE})"
    # 32 MB of keys; more of them, from a thousand million rows on, are joined as Spark sees fit
    held = lambda found, schema: (F.broadcast if len(found) <= 1 << 14 else lambda df: df)(spark.createDataFrame(found, schema))
    each = ", ".join(f"struct({i} AS _of, {place(k)} AS _h)" for i, k in enumerate(keys))
    full = rows.selectExpr(f"inline(array({each}))").groupBy("_of", "_h").count().where(F.col("count") > PIECE).select("_of", "_h").collect()
    out: list[DataFrame | None] = []
    for i, key in enumerate(keys):
        at = [r["_h"] for r in full if r["_of"] == i]
        some = rows.select(*key, "_at").where(F.expr(place(key)).isin(at) if len(at) <= 1000 else F.lit(True))
        hot = some.groupBy(*key).agg(F.count("*").alias("_k")).where(F.col("_k") > PIECE)
        hot = at and held(hot.collect(), hot.schema)
        cuts = hot and _parted(some.where("_at is not null"), hot, key)
        found = cuts.collect() if cuts else []
        out.append(held(found, cuts.schema) if found else None)
    return out


def followed(tx: DataFrame, key: list[str], at: str, measures: dict[str, tuple[str, str | None, int]], of: DataFrame, cuts: DataFrame | None = None, ranged: bool = False, tasks: int | None = None) -> DataFrame:
    """What ``history`` gives, where a key has about as many times as rows: the rows take part in the key's time line themselves.

    They are moved once and carry their columns along, so nothing is joined back; what they add to the line is made where
    the line is. Only keys in ``cuts`` (``crowds``) have lines that are cut into ranges: what their rows take off the line,
    which may lie in a later range, is moved beside the rows, in some bytes each. ``of``: the rows again, before features
    were added; ``at``: the time, in SQL over both; ``ranged``: whether a value may be crowded within such a key;
    ``tasks``: how many tasks share the lines, where adaptive execution would make them too few for what is added to the rows.
    """
    backs = sorted({b for kind, _, b in measures.values() if kind != "distinct"})
    amounts = sorted({c for kind, c, _ in measures.values() if kind in ("sum", "mean")})
    distinct = {name: (j, m[1], m[2]) for j, (name, m) in enumerate((n, m) for n, m in measures.items() if m[0] == "distinct")}
    parts, part = [f"_{p}{i}" for i in range(len(amounts)) for p in "vwml"], [] if cuts is None else ["_p"]
    ask, none, gone = -1, -2, lambda j: -3 - j  # noqa: E731  marks of a line's rows; 0 and 1.. are what a row adds and what leaves each frame
    carried = [c for c in tx.columns if c not in key]
    line = _ranged(tx.withColumn("_at", F.expr(f"CAST({at} AS BIGINT)")), cuts, key)
    line = line.select(*key, *([_piece(F.col("_at")).alias("_p"), F.col("_cuts").isNotNull().alias("_hot")] if part else []), "_at", F.struct(*carried).alias("_row"))
    if part:
        line = line.unionByName(_leaving(of, key, at, cuts, backs, amounts, distinct, ranged, gone), allowMissingColumns=True)
    value = lambda c: c if c in key else f"_row.`{c}`"
    # the amounts of the rows themselves; rows that were made for the line bring their sums along
    line = line.withColumns({f"_c{i}": F.expr(value(c)) for i, c in enumerate(amounts)} | {f"_z{j}": F.expr(value(c)) for j, c, _ in distinct.values()})
    made = [c for c in line.columns if not c.startswith("_c")]
    line = _exact(line.withColumnsRenamed({p: f"_own{p}" for p in parts if part}), [f"_c{i}" for i in range(len(amounts))], [f"_own{c}" if c in parts else c for c in made]) if amounts else line
    if part:
        line = line.withColumns({p: F.expr(f"CASE WHEN _row IS NULL THEN _own{p} ELSE {p} END") for p in parts} | {"_n": F.expr("CASE WHEN _row IS NULL THEN _n ELSE 1L END")})
    else:
        line = line.withColumn("_n", F.lit(1).cast("long"))
    if distinct:
        line = line.repartition(*([tasks] if tasks else []), *key, *part)  # as its windows need it, one of which is by value as well
    for j, _, _ in distinct.values():
        line = line.withColumn(f"_next{j}", F.lead("_at").over(Window.partitionBy(*key, *part, f"_z{j}").orderBy("_at")))
    step = lambda t, b: f"struct({t} AS _pos, {b} AS _b)"
    stay = [step("2 * _at", ask), step("2 * _at + 1", 0)]
    leave = [step(f"2 * (_at + {b}L) + 1", i + 1) for i, b in enumerate(backs)] + [step(f"2 * least(_at + {b}L, _next{j}) + 1", f"CASE WHEN _z{j} IS NULL THEN {none} ELSE {gone(j)} END") for j, _, b in distinct.values()]
    steps = f"CASE {'WHEN _row IS NULL THEN array(struct(_pos, _b)) ' if part else ''}WHEN _at IS NULL THEN array({step('CAST(NULL AS BIGINT)', ask)}) {f'WHEN _hot THEN array({chr(44).join(stay)}) ' if part else ''}ELSE array({', '.join(stay + leave)}) END"
    seen = [f"_z{j} IS NOT NULL AS _seen{j}" for j, _, _ in distinct.values()]
    line = line.selectExpr(*key, *part, "_n", *(f"coalesce({p}, 0L) AS {p}" for p in parts), *seen, "_row", f"explode({steps}) AS _s")
    line = line.selectExpr(*key, *part, "_n", *parts, *(f"_seen{j}" for j, _, _ in distinct.values()), "_s._pos", "_s._b", f"CASE WHEN _s._b = {ask} THEN _row END AS _row")
    before = f"OVER (PARTITION BY {', '.join([*key, *part])} ORDER BY _pos ROWS UNBOUNDED PRECEDING)"
    frame = lambda p, b: f"coalesce(sum(CASE _b WHEN 0 THEN {p} WHEN {backs.index(b) + 1} THEN -{p} END) {before}, 0L)"
    out = {}
    for name, (kind, column, back) in measures.items():
        if kind == "count":
            out[name] = frame("_n", back)
        elif kind == "distinct":
            j = distinct[name][0]
            out[name] = f"coalesce(sum(CASE WHEN _b = 0 AND _seen{j} THEN 1L WHEN _b = {gone(j)} THEN -_n END) {before}, 0L)"
        else:
            n, whole, high, low = (frame(f"_{p}{amounts.index(column)}", back) for p in "vwml")
            total = f"CASE WHEN {n} > 0 THEN {whole} + ({high} + {low} / {REST}D) / {REST}D END"
            out[name] = total if kind == "sum" else f"({total}) / {n}"
    found = line.selectExpr(*key, "_b", "_row", *(f"{x} AS {n}" for n, x in out.items())).where(f"_b = {ask}")
    return found.selectExpr(*(f"`{c}`" if c in key else f"_row.`{c}` AS `{c}`" for c in tx.columns), *measures)


def _leaving(of: DataFrame, key: list[str], at: str, cuts: DataFrame, backs: list[int], amounts: list[str], distinct: dict[str, tuple[int, str, int]], ranged: bool, gone) -> DataFrame:
    """What leaves the lines of the keys in ``cuts``, and what every range of them starts with: (key, _p, _pos, _b, _n, sums)."""
    parts = [f"_{p}{i}" for i in range(len(amounts)) for p in "vwml"]
    hot = joined(of.withColumn("_at", F.expr(f"CAST({at} AS BIGINT)")).where("_at IS NOT NULL"), cuts, key)
    placed = lambda df: df.select(*key, _piece(F.col("_t")).alias("_p"), (F.col("_t") * 2 + 1).alias("_pos"), "_b", "_n", *(c for c in parts if c in df.columns))
    rows = _exact(hot, amounts, [*key, "_at", "_cuts", "_coarse"]).select(*key, "_at", "_cuts", "_coarse", F.lit(1).cast("long").alias("_n"), *(F.coalesce(p, F.lit(0)).cast("long").alias(p) for p in parts))
    come = placed(rows.withColumns({"_t": F.col("_at"), "_b": F.lit(0)}))
    steps = [placed(rows.selectExpr("*", f"inline(array({', '.join(f'struct(_at + {b}L AS _t, {i + 1} AS _b)' for i, b in enumerate(backs))}))"))] if backs else []
    for j, c, back in distinct.values():
        seen = hot.where(F.col(c).isNotNull()).select(*key, F.col(c).alias("_val"), "_at", *([_piece(F.col("_at")).alias("_p")] if ranged else []))
        last = seen.withColumn("_next", F.lead("_at").over(Window.partitionBy(*key, "_val", *["_p"] * ranged).orderBy("_at")))
        if ranged:
            ends = seen.groupBy(*key, "_val", "_p").agg(F.min("_at").alias("_first"), F.max("_at").alias("_at"))
            ends = ends.withColumn("_next", F.lead("_first").over(Window.partitionBy(*key, "_val").orderBy("_p")))  # a row for each range
            last = last.where("_next IS NOT NULL").drop("_p").unionByName(ends.drop("_first", "_p"))
        # cuts are joined again where they are needed, and not moved with the rows
        last = joined(last.selectExpr(*key, f"least(_at + {back}L, _next) AS _t", f"{gone(j)} AS _b", "1L AS _n"), cuts, key)
        come = come.unionByName(placed(hot.where(F.col(c).isNotNull()).select(*key, "_cuts", "_coarse", F.col("_at").alias("_t"), F.lit(gone(j)).alias("_b"), F.lit(-1).cast("long").alias("_n"))), allowMissingColumns=True)
        steps.append(placed(last))
    left = steps[0]
    for s in steps[1:]:
        left = left.unionByName(s, allowMissingColumns=True)
    marks, values = [0, *range(1, len(backs) + 1), *(gone(j) for j, _, _ in distinct.values())], ["_n", *parts]
    name = lambda p, i: f"{p}_of{i}"
    totals = come.unionByName(left, allowMissingColumns=True).groupBy(*key, "_p").agg(*(F.sum(F.when(F.col("_b") == b, F.col(p))).alias(name(p, i)) for p in values for i, b in enumerate(marks)))
    earlier = Window.partitionBy(*key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # PARTS rows a key
    starts = [F.struct(F.lit(b).alias("_b"), *(F.coalesce(F.sum(name(p, i)).over(earlier), F.lit(0)).cast("long").alias(p) for p in values)) for i, b in enumerate(marks)]
    starts = totals.withColumn("_s", F.array(*starts)).select(*key, "_p", F.explode("_s").alias("_s")).select(*key, "_p", F.lit(BEGIN).cast("long").alias("_pos"), "_s.*")
    return left.unionByName(starts, allowMissingColumns=True)


def _zero(c) -> Column:
    return F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(0.0))


DAY, WEEK = 24, 168


def velocity(tx: DataFrame) -> DataFrame:
    f = history(tx, ["sender"], "us", {"sender_tx_1h": ("count", None, HOUR), "sender_tx_24h": ("count", None, DAY * HOUR), "sender_amount_24h": ("sum", "amount", DAY * HOUR)})
    return f.select("transaction_id", "sender_tx_1h", "sender_tx_24h", F.round("sender_amount_24h", 4).alias("sender_amount_24h"))


def fan_in(tx: DataFrame) -> DataFrame:
    f = history(tx, ["recipient"], "us", {"recipient_fanin_24h": ("count", None, DAY * HOUR), "recipient_value_24h": ("sum", "amount", DAY * HOUR)})
    return f.select("transaction_id", "recipient_fanin_24h", F.round("recipient_value_24h", 4).alias("recipient_value_24h"))


def device_activity(tx: DataFrame) -> DataFrame:
    return history(tx, ["device_id"], "us", {"device_activity_24h": ("count", None, DAY * HOUR)}).select("transaction_id", "device_activity_24h")


PAYMENT_FEATURES = ["sender_tx_1h", "sender_tx_24h", "sender_amount_24h", "sender_mean_amount_7d", "recipient_fanin_24h", "device_activity_24h", "pair_tx_24h", "sender_unique_recipients_24h", "recipient_unique_senders_24h", "device_unique_senders_24h"]


def payment_features(tx: DataFrame, resolution: str = "s") -> DataFrame:
    """Rolling features of payments by seconds (or microseconds), with exact distinct counterparties, senders and devices; hour of the day and night beside them."""
    unit = 1_000_000 if resolution == "s" else 1
    h, at = HOUR // unit, f"(us - pmod(us, {unit})) DIV {unit}"
    rows = tx.select("transaction_id", "us", "sender", "recipient", "device_id", "amount")
    timed = rows.withColumn("_at", F.expr(at))
    keys = [["sender"], ["sender", "recipient"], ["recipient"], ["device_id"], ["device_id", "sender"]]
    split = crowded(timed, "_at")
    of_sender, of_pair, of_recipient, of_device, both = crowds(timed, keys) if split else [None] * len(keys)
    tasks = max(int(tx.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // TASK) if split else None
    out = followed(rows, ["sender"], at, {"sender_tx_1h": ("count", None, h), "sender_tx_24h": ("count", None, DAY * h), "sender_amount_24h": ("sum", "amount", DAY * h), "sender_mean_amount_7d": ("mean", "amount", WEEK * h), "sender_unique_recipients_24h": ("distinct", "recipient", DAY * h)}, rows, of_sender, of_pair is not None, tasks)
    out = out.withColumn("sender_amount_24h", F.round(_zero("sender_amount_24h"), 4)).withColumn("sender_mean_amount_7d", F.round(F.coalesce("sender_mean_amount_7d", "amount"), 7)).drop("amount")
    out = followed(out, ["sender", "recipient"], at, {"pair_tx_24h": ("count", None, DAY * h)}, rows, of_pair, tasks=tasks)
    out = followed(out, ["recipient"], at, {"recipient_fanin_24h": ("count", None, DAY * h), "recipient_unique_senders_24h": ("distinct", "sender", DAY * h)}, rows, of_recipient, of_pair is not None, tasks).drop("recipient")
    out = followed(out, ["device_id"], at, {"device_activity_24h": ("count", None, DAY * h), "device_unique_senders_24h": ("distinct", "sender", DAY * h)}, rows, of_device, both is not None, tasks)
    hour = F.expr("CAST(pmod(us DIV 3600000000, 24) AS INT)")
    return out.select("transaction_id", *PAYMENT_FEATURES, hour.alias("hour"), (hour <= 5).cast("int").alias("is_night"))


def _clip(c: Column, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(high))


def recipient_features(tx: DataFrame, of: DataFrame | None = None, split: bool | None = None) -> DataFrame:
    """What is known of the recipient by hourly step."""
    out = history(tx, ["recipient"], "step", {"recipient_fanin_24h": ("count", None, DAY), "recipient_tx_7d": ("count", None, WEEK), "recipient_amount_24h": ("sum", "amount", DAY), "recipient_unique_senders_7d": ("distinct", "sender", WEEK)}, of, split)
    return out.withColumn("recipient_amount_24h", _zero("recipient_amount_24h"))


def step_features(tx: DataFrame, pairs: bool = True) -> DataFrame:
    """Features by hourly step: three keys, a time line each; scalar features beside them. Without ``pairs``, those of sender and recipient together are left out, and their time line with them."""
    s, r, n, split = ["sender"], ["recipient"], ("count", None), crowded(tx, "step")
    out = history(tx, s, "step", {
        "sender_tx_1h": (*n, 1), "sender_tx_24h": (*n, DAY), "sender_tx_7d": (*n, WEEK), "sender_amount_24h": ("sum", "amount", DAY), "sender_amount_7d": ("sum", "amount", WEEK), "sender_mean_amount_7d": ("mean", "amount", WEEK),
        "sender_unique_recipients_7d": ("distinct", "recipient", WEEK),
    }, tx, split)
    if pairs:
        out = history(out, [*s, *r], "step", {"pair_tx_7d": (*n, WEEK), "pair_amount_7d": ("sum", "amount", WEEK)}, tx, split)
    out = recipient_features(out, tx, split)
    out = out.withColumns({c: _zero(c) for c in ("sender_amount_24h", "sender_amount_7d", *["pair_amount_7d"] * pairs)}).withColumn("sender_mean_amount_7d", F.coalesce("sender_mean_amount_7d", "amount"))
    return out.select(
        "*", F.log1p(F.greatest("amount", F.lit(0.0))).alias("log_amount"), (F.col("amount") / F.greatest("sender_mean_amount_7d", F.lit(1.0))).alias("amount_vs_7d_mean"),
        *[_clip(F.col("pair_amount_7d") / F.greatest("sender_amount_7d", F.lit(1.0)), 1.0).alias("sender_recipient_share_7d")] * pairs, *((F.col("type") == t).cast("int").alias(f"type_{t.lower()}") for t in ("CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER")),
    )


def balance_features() -> list[Column]:
    """Share of the sender's balance that moves, within 0 and 20, and the changes of both balances."""
    share = _clip(F.col("amount") / F.greatest("old_balance_sender", F.lit(1.0)), 20.0)
    return [share.alias("balance_fraction"), (F.col("old_balance_sender") - F.col("new_balance_sender")).alias("orig_balance_delta"), (F.col("new_balance_recipient") - F.col("old_balance_recipient")).alias("dest_balance_delta")]


def _recipients(tx: DataFrame) -> DataFrame:
    split = crowded(tx, "step")
    f = history(tx, ["recipient"], "step", {"recipient_tx_24h": ("count", None, DAY), "recipient_amount_24h": ("sum", "amount", DAY), "recipient_tx_7d": ("count", None, WEEK), "unique_senders_7d": ("distinct", "sender", WEEK)}, tx, split)
    f = history(f, ["recipient", "sender"], "step", {"pair_tx_7d": ("count", None, WEEK)}, tx, split)
    return f.withColumn("recipient_amount_24h", _zero("recipient_amount_24h"))


def recipient_investigation(tx: DataFrame) -> DataFrame:
    """What an investigator asks of a recipient before each payment."""
    return _recipients(tx).drop("recipient_tx_7d")


def recipient_concentration(tx: DataFrame, n: int = 100, shown: int = 10) -> DataFrame:
    """Retrospective fraud in the first percentiles of the investigation order: amount, senders and payments, most first, then transaction_id.

    Rows are summed by the three numbers and placed by their running totals. Only where the end of a percentile falls among
    rows equal in all three are these ordered by id, up to the last such end. The features are computed once and kept
    meanwhile; the ``shown`` rows of the result are read.
    """
    order = ["recipient_amount_24h", "unique_senders_7d", "recipient_tx_24h"]
    sums = {"y": F.col("is_fraud"), "v": F.when(F.col("is_fraud") == 1, F.col("amount")).otherwise(0.0), "t": F.col("recipient_tx_24h"), "u": F.col("unique_senders_7d"), "p": F.col("pair_tx_7d")}
    add = lambda df: df.agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in sums))
    with kept(_recipients(tx).select("transaction_id", *order, F.lit(1).cast("long").alias("n"), *(x.alias(c) for c, x in sums.items()))) as rows, kept(add(rows.groupBy(*order))) as g:
        total = g.agg(F.sum("n")).first()[0] or 0
        ends = [total // n * j + min(j, total % n) for j in range(1, shown + 1)]
        amounts = running(g.groupBy(order[0]).agg(F.sum("n").alias("n")), order[0], {"_upto": "n"}).select(order[0], (F.col("_upto") - F.col("n")).alias("_more"))
        below = Window.partitionBy(order[0]).orderBy(F.desc(order[1]), F.desc(order[2])).rowsBetween(Window.unboundedPreceding, -1)  # pairs of counts that an amount has
        g = joined(g.withColumn("_start", F.coalesce(F.sum("n").over(below), F.lit(0))), amounts, order[:1]).withColumn("_start", F.col("_start") + F.col("_more")).where(F.col("_start") < ends[-1])
        place = lambda at: sum((at > F.lit(e)).cast("int") for e in ends) + 1
        g = g.withColumns({"_a": place(F.col("_start") + 1), "_z": place(F.col("_start") + F.col("n"))})
        whole = add(g.where("_a = _z").groupBy(F.col("_a").alias("percentile")))
        cut = g.where("_a < _z").select(*order, "_start", "_a")
        inner = F.filter(F.array(*(F.struct(F.lit(j).alias("_i"), (F.lit(e).cast("long") - F.col("_start") - 1).alias("_r")) for j, e in enumerate(ends))), lambda x: x["_r"] >= 0)
        wanted = cut.select(*order, F.explode(inner).alias("x")).select(*order, "x.*")
        tied = joined(rows, cut, order)
        places = at_places(tied, "transaction_id", wanted, order).groupBy(*order).agg(F.collect_list("_v").alias("_ends"))  # an id for each percentile's end
        split = joined(tied, places, order).withColumn("percentile", F.col("_a") + F.size(F.filter("_ends", lambda e: e < F.col("transaction_id"))))
        both = add(whole.unionByName(add(split.where(F.col("percentile") <= shown).groupBy("percentile"))).where(F.col("percentile") <= shown).groupBy("percentile"))
        mean = lambda c, digits: F.round(F.col(c) / F.col("n"), digits)
        out = both.select(F.col("percentile").cast("long").alias("investigation_percentile"), F.col("n").alias("transactions"), mean("y", 9).alias("fraud_rate"), F.round("v", 4).alias("fraud_value"), mean("t", 6).alias("avg_recipient_tx_24h"), mean("u", 6).alias("avg_unique_senders_7d"), mean("p", 6).alias("avg_pair_tx_7d"))
        return tx.sparkSession.createDataFrame(out.collect(), out.schema)


def candidate_queue(tx: DataFrame, high: float = 0.99) -> DataFrame:
    """Recipients scored by their percent ranks within the step, with reasons; highest score first, then larger amounts."""
    f = _recipients(tx).withColumnsRenamed({"recipient_tx_24h": "recipient_fanin_24h", "unique_senders_7d": "recipient_unique_senders_7d"}).withColumn("recipient_amount_24h", F.round("recipient_amount_24h", 4))
    f = percent_places(f, {"fanin_pct": "recipient_fanin_24h", "amount_pct": "recipient_amount_24h", "tx_pct": "recipient_tx_7d", "senders_pct": "recipient_unique_senders_7d"}, ["step"])
    reason = F.concat_ws("|", F.when(F.col("senders_pct") >= high, "MANY_PRIOR_SENDERS"), F.when(F.col("fanin_pct") >= high, "HIGH_PRIOR_FAN_IN"), F.when(F.col("amount_pct") >= high, "HIGH_PRIOR_RECIPIENT_VALUE"), F.when(F.col("pair_tx_7d") == 0, "NEW_SENDER_RECIPIENT_PAIR"))
    score = 0.25 * F.col("fanin_pct") + 0.25 * F.col("amount_pct") + 0.15 * F.col("tx_pct") + 0.35 * F.col("senders_pct")
    return f.select("transaction_id", "step", "sender", "recipient", "type", "amount", "recipient_fanin_24h", "recipient_amount_24h", "recipient_tx_7d", "recipient_unique_senders_7d", "pair_tx_7d", F.round(score, 6).alias("investigation_score"), reason.alias("reasons")).orderBy(F.desc("investigation_score"), F.desc("amount"), "transaction_id")
