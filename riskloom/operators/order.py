"""Exact order statistics, places and running totals of whole tables and of groups, digit by digit.

A value becomes a long number of the same order, and its bits are three digits. Rows are first summed by value, so ties
are one row and the caller's rows are shuffled once. Histograms of a digit say in which cell a place lies, or what comes
before a cell; only then is the next digit looked at, within that cell. A task orders at most the cells of one digit,
however many rows or equal values there are; no sample is drawn, nothing is counted beforehand, and all groups and places
go through the same passes. Where the optimizer expects no more than SMALL bytes of sums, they are ordered at once, by
a window over each group; results are the same.
"""

from __future__ import annotations

from contextlib import contextmanager
from threading import Lock

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of the second and third digit; the first has the other 20.
LOW, MASK = 22, (1 << 22) - 1
LARGEST = (1 << 63) - 1
#: So many bytes are one task's work.
SMALL = 64 << 20


def large(df: DataFrame) -> bool:
    """Whether the optimizer expects more than SMALL bytes of any table that ``df`` is made of; no job is run to tell."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return any(int(str(leaves.apply(i).stats().sizeInBytes())) > SMALL for i in range(leaves.size()))


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on equal columns where null equals null; the columns stay once. Without columns, ``right`` is one row for each of a few places."""
    if not on:
        return left.crossJoin(F.broadcast(right)) if how == "inner" else left.join(F.broadcast(right), F.lit(True), how)
    other = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    return left.join(other, F.expr(" AND ".join(f"`{c}` <=> `_on_{c}`" for c in on)), how).drop(*(f"_on_{c}" for c in on))


def sortable(df: DataFrame, column: str) -> Column:
    """A long number in the order of a numeric column: whole numbers themselves, doubles by exponent and mantissa. NaN is above all, null stays null."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, T.IntegralType):
        return c.cast("long")
    x = F.abs(c.cast("double"))
    guess = F.floor(F.log2(x)).cast("int")
    power = lambda e: F.pow(F.lit(2.0), e)
    e = guess - (power(guess) > x).cast("int") + (power(guess + 1) <= x).cast("int")
    mantissa = (F.floor((x / power(e) - 1) * float(1 << 52))).cast("long")
    size = F.when(x < 2.2250738585072014e-308, F.floor(x / 5e-324).cast("long")).otherwise((e + 1023).cast("long") * (1 << 52) + mantissa)
    size = F.when(F.isnan(x), LARGEST).when(x == float("inf"), F.lit(2047 << 52)).otherwise(size)
    return F.when(c.isNull(), None).when(c.cast("double") < 0, -size).otherwise(size)


def _digits(df: DataFrame, column: str, descending: bool) -> DataFrame:
    key = sortable(df, column)
    k = F.col("_k")
    out = df.withColumn("_k", F.bitwise_not(key) if descending else key)
    return out.withColumns({"_d1": F.shiftright(k, 2 * LOW).cast("int"), "_d2": F.shiftright(k, LOW).bitwiseAND(MASK).cast("int")})


def counted(df: DataFrame, column: str, keys: tuple[str, ...] | list[str] = (), **sums: str) -> DataFrame:
    """A row for each value of the groups: ``n`` rows, and the sums asked for, in SQL."""
    return df.groupBy(*keys, column).agg(F.expr("count(*) AS n"), *(F.expr(f"sum({x}) AS {name}") for name, x in sums.items()))


def running(g: DataFrame, column: str, totals: dict[str, str], keys: tuple[str, ...] | list[str] = (), descending: bool = True) -> DataFrame:
    """Adds, for each ``new: summed`` of totals, the sum over the rows of the group from its first value to this one; nulls are the least. ``g`` has a row for each value."""
    keys, own = list(keys), list(totals.values())
    if not large(g):
        over = f"({f'PARTITION BY {chr(44).join(keys)}' if keys else ''} ORDER BY `{column}` {'DESC NULLS LAST' if descending else 'ASC NULLS FIRST'} ROWS UNBOUNDED PRECEDING)"
        return g.selectExpr("*", *(f"sum(`{c}`) OVER {over} AS `{n}`" for n, c in totals.items()))
    rows = _digits(g, column, descending)
    so_far = lambda over: over.rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*keys, "_d1", "_d2").agg(*(F.sum(c).alias(c) for c in own))
    inner = cells.select(*keys, "_d1", "_d2", *(F.coalesce(F.sum(c).over(so_far(Window.partitionBy(*keys, "_d1").orderBy("_d2"))), F.lit(0)).alias(f"_{n}2") for n, c in totals.items()))
    outer = cells.groupBy(*keys, "_d1").agg(*(F.sum(c).alias(c) for c in own))  # a group has 2^20 cells at most
    end = F.asc_nulls_last("_d1") if descending else F.asc_nulls_first("_d1")
    outer = outer.select(*keys, "_d1", *(F.coalesce(F.sum(c).over(so_far(Window.partitionBy(*keys).orderBy(end))), F.lit(0)).alias(f"_{n}1") for n, c in totals.items()))
    last = Window.partitionBy(*keys, "_d1", "_d2").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_{n}3": F.sum(c).over(last) for n, c in totals.items()})
    rows = joined(joined(rows, inner, [*keys, "_d1", "_d2"]), outer, [*keys, "_d1"])
    return rows.select(*g.columns, *((F.col(f"_{n}1") + F.col(f"_{n}2") + F.col(f"_{n}3")).alias(n) for n in totals))


def at_places(g: DataFrame, column: str, wanted: DataFrame | None, keys: tuple[str, ...] | list[str] = (), descending: bool = False, weight: str = "n") -> DataFrame:
    """Values at places of the order: ``wanted`` has the keys, ``_i`` and a place ``_r`` from 0; the result these, the value ``_v``, and the rows before and at it, ``_before`` and ``_at``.

    ``g`` has ``weight`` rows of each value; nulls have no place, places beyond the last row are left out. Without
    ``wanted``, ``g`` has a column ``_r``, one place for each group.
    """
    keys = list(keys)
    if wanted is None:
        g, keys = g.withColumn("_i", F.lit(0)), [*keys, "_i", "_r"]
    names = list(dict.fromkeys([*keys, "_i", "_r"]))
    to = lambda df, on: df if wanted is None else joined(df, wanted.select(*names), on)
    rows = g.where(f"`{column}` IS NOT NULL").selectExpr(*keys, f"`{column}` AS _v", f"`{weight}` AS _w")
    if not large(g):
        over = f"PARTITION BY {', '.join(keys)}" if keys else ""
        rows = rows.selectExpr("*", f"sum(_w) OVER ({over} ORDER BY _v {'DESC' if descending else 'ASC'} ROWS UNBOUNDED PRECEDING) - _w AS _before")
        return to(rows, keys).where("_r >= _before AND _r < _before + _w").selectExpr(*names, "_v", "_before", "_w AS _at")
    rows = _digits(rows, "_v", descending)
    before = lambda on, digit: F.sum("_s").over(Window.partitionBy(*on).orderBy(digit).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")
    within = (F.col("_left") >= F.col("_b")) & (F.col("_left") < F.col("_b") + F.col("_s"))
    first = rows.groupBy(*keys, "_d1").agg(F.sum("_w").alias("_s")).withColumn("_b", before(keys, "_d1"))
    at = to(first, keys).withColumn("_left", F.col("_r")).where(within).select(*names, "_d1", (F.col("_left") - F.col("_b")).alias("_left"))
    group = list(dict.fromkeys([*keys, "_i"]))
    second = joined(rows, at, [*keys, "_d1"]).groupBy(*names, "_left", "_d1", "_d2").agg(F.sum("_w").alias("_s")).withColumn("_b", before(group, "_d2"))
    at = second.where(within).select(*names, "_d1", "_d2", (F.col("_left") - F.col("_b")).alias("_left"))
    third = joined(rows, at, [*keys, "_d1", "_d2"]).withColumn("_s", F.col("_w")).withColumn("_b", before(group, "_k"))
    return third.where(within).select(*names, "_v", (F.col("_r") - F.col("_left") + F.col("_b")).alias("_before"), F.col("_s").alias("_at"))


def quantiles(g: DataFrame, column: str, shares: list[float], keys: tuple[str, ...] | list[str] = (), weight: str = "n") -> DataFrame:
    """(keys, ``q``): the values at the shares of each group, between neighbours by linear interpolation. Groups without values have no row."""
    keys = list(keys)
    sizes = g.where(F.col(column).isNotNull()).groupBy(*keys).agg(F.sum(weight).alias("_all")).where("_all > 0")
    ends = F.array(*(F.struct(F.lit(2 * j + up).alias("_i"), f((F.col("_all") - 1) * F.lit(float(s))).cast("long").alias("_r")) for j, s in enumerate(shares) for up, f in enumerate((F.floor, F.ceil))))
    wanted = sizes.select(*keys, F.explode(ends).alias("x")).select(*keys, "x.*")
    found = at_places(g, column, wanted, keys, weight=weight).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_i", F.col("_v").cast("double")))).alias("_m"))  # two values a share
    value = lambda j, s: (lambda low, high, part: F.when(low == high, low).otherwise(low * (1 - part) + high * part))(F.col("_m")[2 * j], F.col("_m")[2 * j + 1], (F.col("_all") - 1) * F.lit(float(s)) - F.floor((F.col("_all") - 1) * F.lit(float(s))))
    return joined(found, sizes, keys).select(*keys, F.array(*(value(j, s) for j, s in enumerate(shares))).alias("q"))


def quantile(df: DataFrame, column: str | Column, share: float) -> float | None:
    """One quantile of a whole table, read at once."""
    row = quantiles(counted(df.select((F.col(column) if isinstance(column, str) else column).alias("v")), "v"), "v", [share]).first()
    return row["q"][0] if row else None


#: Lets adaptive execution size the partitions of a kept table; Spark leaves them at spark.sql.shuffle.partitions, however few the rows.
SIZED = "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"
#: Models are fitted by several threads of one session, which share its settings.
_SETTING = Lock()


@contextmanager
def kept(df: DataFrame):
    """The rows on the executors' disks while in use, in partitions by their size; lost parts are computed again."""
    conf = df.sparkSession.conf
    with _SETTING:
        before = conf.get(SIZED)
        conf.set(SIZED, "true")  # read when the plan is made, which persist does
        try:
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
        finally:
            conf.set(SIZED, before)
    try:
        yield df
    finally:
        df.unpersist()


def firsts(df: DataFrame, column: str, wanted: DataFrame, keys: tuple[str, ...] | list[str] = (), tie: str = "transaction_id", g: DataFrame | None = None) -> DataFrame:
    """Where the first rows of each group by falling ``column`` end: ``wanted`` has the keys, ``_i`` and a number of rows ``_n``, one at least.

    The result has the keys, ``_i``, ``_n``, the last value ``_v``, the rows ``_before`` it and ``_at`` it, and ``_t``: of
    the last value's rows those belong to the first whose whole-number ``tie`` is at most that. Only if not all of them
    do, they are looked at, and ordered by ``tie`` in the same way. ``g``: rows counted by value, if the caller has them.
    """
    keys = list(keys)
    if not large(df):
        of = f"PARTITION BY {', '.join(keys)}" if keys else ""
        alike = ", ".join([*keys, "_v"])
        rows = df.selectExpr(*keys, f"`{column}` AS _v", f"CAST(`{tie}` AS BIGINT) AS _t").where("_v IS NOT NULL")
        rows = rows.selectExpr("*", f"row_number() OVER ({of} ORDER BY _v DESC, _t) AS _place", f"rank() OVER ({of} ORDER BY _v DESC) - 1 AS _before", f"count(*) OVER (PARTITION BY {alike}) AS _at")
        return joined(rows, wanted.select(*keys, "_i", "_n"), keys).where("_place = _n").selectExpr(*keys, "_i", "_n", "_v", "_before", "_at", f"CASE WHEN _before + _at = _n THEN {LARGEST} ELSE _t END AS _t")
    g = counted(df, column, keys) if g is None else g
    ends = at_places(g, column, wanted.selectExpr(*keys, "_i", "_n - 1 AS _r"), keys, True).selectExpr(*keys, "_i", "_r + 1 AS _n", "_v", "_before", "_at")
    open_ = ends.where("_before + _at > _n").selectExpr(*keys, "_i AS _end_of", "_v", "_n - _before - 1 AS _r")
    rows = joined(df.selectExpr(*keys, f"`{column}` AS _v", f"CAST(`{tie}` AS BIGINT) AS _t"), open_, [*keys, "_v"])
    cut = at_places(counted(rows, "_t", [*keys, "_end_of", "_r"]), "_t", None, [*keys, "_end_of"]).selectExpr(*keys, "_end_of AS _i", "_v AS _t")
    return joined(ends, cut, [*keys, "_i"], "left").withColumn("_t", F.expr(f"coalesce(_t, {LARGEST})"))


def among(column: str | Column, value: str | Column, tie: str | Column, last: str | Column) -> Column:
    """Whether a row is among the first that ``firsts`` marked off."""
    c, v, t, u = (F.col(x) if isinstance(x, str) else x for x in (column, value, tie, last))
    return (c > v) | ((c == v) & (t <= u))


def average_place(df: DataFrame, column: str, name: str, of: DataFrame | None = None, g: DataFrame | None = None) -> DataFrame:
    """Adds the mean place, from the smallest value up, of all rows of a row's value, over the number of rows. ``of``: the rows that are placed, where ``df`` has other columns by now; ``g``: these counted by value, if the caller has them."""
    g = counted(df if of is None else of, column) if g is None else g
    up = running(g, column, {"_upto": "n"}, descending=False)
    share = joined(up, g.agg(F.expr("sum(n) AS _all")), []).selectExpr(f"`{column}`", f"(_upto - (n - 1) / 2) / _all AS `{name}`")
    return joined(df, share, [column])


def percent_places(df: DataFrame, columns: dict[str, str], keys: list[str]) -> DataFrame:
    """Adds, for each ``name: column``, the share of the other rows of a row's group that have a smaller value; 0 in a group of one row.

    Values of large tables are counted by group, all columns in one pass, and placed by running totals, so a group of
    very many rows isn't a task.
    """
    if not large(df):
        of = f"PARTITION BY {', '.join(keys)}"
        return df.selectExpr("*", *(f"percent_rank() OVER ({of} ORDER BY `{c}`) AS `{name}`" for name, c in columns.items()))
    each = ", ".join(f"struct({i} AS _of, CAST(`{c}` AS DOUBLE) AS _x)" for i, c in enumerate(columns.values()))
    g = counted(df.selectExpr(*keys, f"inline(array({each}))"), "_x", [*keys, "_of"])
    share = joined(running(g, "_x", {"_upto": "n"}, [*keys, "_of"], False), g.groupBy(*keys, "_of").agg(F.expr("sum(n) AS _all")), [*keys, "_of"])
    share = share.selectExpr(*keys, "_of", "_x", "CASE WHEN _all > 1 THEN (_upto - n) / (_all - 1) ELSE 0D END AS _share")
    types = dict(df.dtypes)
    for i, (name, c) in enumerate(columns.items()):
        df = joined(df, share.where(f"_of = {i}").selectExpr(*keys, f"CAST(_x AS {types[c]}) AS `{c}`", f"_share AS `{name}`"), [*keys, c], "left")
    return df
