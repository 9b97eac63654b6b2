"""Exact medians and median absolute deviations over rolling windows of time, for every row.

A window's median is found by bisection over the sorted distinct values, all windows of a stretch together: a round halves the
values and keeps, for each place in time, how many of the rows so far lie in the lower half. The difference of two such prefix
counts is what a window has there, so each window goes on in the half that holds its middle. The same prefix counts tell how
many of a window's values lie below any bound, and with that the radius around the median is bisected: the two quartile
values bound it from both sides, and every round counts the values within the radius.

Rows are dealt by series and slot of time; a row less than one window before a slot's end goes to the next slot too, as what
its windows look back on. Slots whose rows would be too many for a task (``most``) are cut into ever shorter ones, down to
a quarter of the window. What is still too dense then is bisected by rounds of Spark jobs (``by_rounds``): prefix counts are
summed within cells of time, a 3600th of a window, and over the cells' totals, so no task needs a window's rows at once.

Defined cases: a click_id that repeats counts once, with its earliest time, then smallest series and value (rows without a time
last); a null click_id is an id like any other; rows without a time go; a null series is a series; a value that is null, not
finite or beyond 2**56 cents has no cents; a window of fewer than two cents has no median; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrain.llm.common import Scratch

#: Cents beyond this are none, so that no sum of doubled distances leaves a long.
CENTS_MOST = float(1 << 56)
#: Rows of neighbouring stretches that are worked on together, and windows of one stretch at a time.
CHUNK = 1 << 16
#: Slots are not cut below this part of the window: most of what a task then holds is one window's rows.
LEAST_SLOT = 4
#: Cells of time in a window, and bits of a value that a level of the prefix counts tells apart.
CELLS, DIGIT = 3600, 4
RESULT = "click_id long, kind string, n long, median2 long, mad4 long, far boolean"


def micros(ts: Column) -> Column:
    """A time's microseconds since 1970 as its clock shows them; no zone is applied to a time without one."""
    day = F.unix_date(ts.cast("date")).cast("long")
    second = (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return ((day * 24 + F.hour(ts)) * 60 + F.minute(ts)) * 60_000_000 + second


def cents(value: Column) -> Column:
    """floor(100 * value + 0.5) of values in range."""
    x = value.cast("double")
    return F.floor(100 * F.when(~F.isnan(x) & (F.abs(x) <= CENTS_MOST / 100), x) + 0.5).cast("long")


class PrefixCounts:
    """Values in their order in time, halved round by round, with prefix counts of the lower halves."""

    def __init__(self, values: np.ndarray):
        self.values, at = np.unique(values, return_inverse=True)
        at = at.astype(np.int32)
        self.levels = []
        for bit in reversed(range(int(len(self.values) - 1).bit_length() if len(self.values) else 0)):
            low = (at >> bit) & 1 == 0
            before = np.zeros(len(at) + 1, np.int32)
            np.cumsum(low, out=before[1:])
            self.levels.append((bit, before, before[-1]))
            at = np.concatenate((at[low], at[~low]))

    def nth(self, start: np.ndarray, end: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Each window's n-th smallest value, from 0: all windows are bisected together."""
        a, b, n, got = start, end, n, np.zeros(len(start), np.int32)
        for bit, before, lows in self.levels:
            la, lb = before[a], before[b]
            has = lb - la
            up = n >= has
            n = np.where(up, n - has, n)
            a, b = np.where(up, lows + a - la, la), np.where(up, lows + b - lb, lb)
            got |= up.astype(np.int32) << bit
        return self.values[got]

    def below(self, start: np.ndarray, end: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many of each window's distinct values' ranks are below bound (a rank)."""
        a, b, n = start, end, np.zeros(len(start), np.int32)
        for bit, before, lows in self.levels:
            la, lb = before[a], before[b]
            up = (bound >> bit) & 1 == 1
            n += np.where(up, lb - la, 0)
            a, b = np.where(up, lows + a - la, la), np.where(up, lows + b - lb, lb)
        return np.where(bound >= len(self.values), end - start, n)

    def within(self, start: np.ndarray, end: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of each window's values are below least, and how many at most most."""
        i = np.searchsorted(self.values, least, "left").astype(np.int32)
        j = np.searchsorted(self.values, most, "right").astype(np.int32)
        return self.below(start, end, i), self.below(start, end, j)


def medians(counts: PrefixCounts, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubled median, and the doubled median of the doubled distances to it, of windows of one value and more."""
    m = end - start
    middle2 = counts.nth(start, end, (m - 1) // 2) + counts.nth(start, end, m // 2)
    # half of the values lie between these two, so the radius is no more than the farther is away, nor less than the nearer
    half = (m + 1) // 2
    first = (m - half) // 2
    a = middle2 - 2 * counts.nth(start, end, first)
    b = 2 * counts.nth(start, end, first + half - 1) - middle2
    low, high = np.maximum(np.minimum(a, b), 0), np.maximum(np.abs(a), np.abs(b))
    rest = np.flatnonzero(low < high)
    while len(rest):
        s, e, c = start[rest], end[rest], middle2[rest]
        r = low[rest] + (high[rest] - low[rest]) // 2
        less, upto = counts.within(s, e, -((r - c) // 2), (c + r) // 2)
        enough = upto - less >= half[rest]
        high[rest[enough]] = r[enough]
        low[rest[~enough]] = r[~enough] + 1
        rest = rest[low[rest] < high[rest]]
    mad4 = 2 * high
    # of an even number the next distance counts too
    even = np.flatnonzero(m % 2 == 0)
    if len(even):
        s, e, c, r = start[even], end[even], middle2[even], high[even]
        less, upto = counts.within(s, e, -((r - c) // 2), (c + r) // 2)
        far = np.iinfo(np.int64).max
        above = np.where(upto < m[even], 2 * counts.nth(s, e, np.minimum(upto, m[even] - 1)) - c, far)
        under = np.where(less > 0, c - 2 * counts.nth(s, e, np.maximum(less - 1, 0)), far)
        mad4[even] = r + np.where(upto - less > half[even], r, np.minimum(above, under))
    return middle2, mad4


def solve(group: np.ndarray, at: np.ndarray, value: np.ndarray, some: np.ndarray, own: np.ndarray, window: int, reach: int):
    """n, median2, mad4 and far of the rows that are a stretch's own.

    Rows lie by group (a stretch's number) and time; at: time from one window before the stretch's start, below reach; some:
    rows that have a value.
    """
    key = group * reach + at
    points = key[some]
    counts = PrefixCounts(value[some])
    key = key[own]
    end = np.searchsorted(points, key, "right").astype(np.int32)
    start = np.searchsorted(points, key - window, "right").astype(np.int32)
    n = end - start
    middle2, mad4 = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    full = np.flatnonzero(n >= 2)
    for i in range(0, len(full), CHUNK):
        w = full[i : i + CHUNK]
        middle2[w], mad4[w] = medians(counts, start[w], end[w])
    far = 2 * np.abs(2 * value[own] - middle2) > 3 * mad4
    return n, middle2, mad4, far


def begins(kind: pa.Array, slot: pa.Array) -> np.ndarray:
    """Places at which another stretch begins than that of the row before, without the first."""
    n = len(slot)
    if n < 2:
        return np.empty(0, int)
    lacks, name = kind.is_null(), kind.fill_null("")
    other = np.diff(slot.to_numpy(zero_copy_only=False)) != 0
    for x in (lacks, name):
        other |= pc.not_equal(x.slice(1), x.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(other) + 1


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole stretches of sorted rows, several small ones at a time."""
    held: list[pa.RecordBatch] = []
    rows, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        kind, slot = batch.column("kind"), batch.column("slot")
        at = begins(kind, slot)
        if held and last != (kind[0].as_py(), slot[0].as_py()):
            at = np.append(0, at)
        last = kind[-1].as_py(), slot[-1].as_py()
        if len(at) and rows + at[-1] >= CHUNK:  # enough is held: cut where the last stretch begins
            yield pa.Table.from_batches([*held, batch.slice(0, at[-1])])
            held, rows = [], 0
            batch = batch.slice(at[-1])
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def deal(rows: DataFrame, window: int, slot: int) -> DataFrame:
    """Each row in its slot and in those after it whose windows look back on it, within its span of slots (from, upto).

    rel: the row's time from one window before the slot's start.
    """
    own = F.expr(f"t div {slot} - CASE WHEN t % {slot} < 0 THEN 1 ELSE 0 END")
    after = F.transform(F.sequence(F.lit(0), F.lit(-(-window // slot))), lambda k: own + k)
    start = lambda s: s * slot
    within = F.filter(after, lambda s: (F.col("t") > start(s) - window) & (start(s) >= F.col("from")) & (start(s) < F.col("upto")))
    return rows.withColumn("slot", F.explode(within)).withColumn("rel", F.col("t") - F.col("slot") * slot + window)


def answer(rows: DataFrame, window: int, slot: int) -> DataFrame:
    """The result rows of whole slots, a task's slots one after another."""
    moved = rows.select("id", "kind", "c", "slot", "rel").repartition("kind", "slot").sortWithinPartitions("kind", "slot", "rel")

    def run(batches):
        for table in stretches(batches):
            kind, slots, c = (table.column(x).combine_chunks() for x in ("kind", "slot", "c"))
            rel = table.column("rel").to_numpy()
            group = np.zeros(len(rel), np.int64)
            group[begins(kind, slots)] = 1
            own = rel >= window
            some = c.is_valid().to_numpy(zero_copy_only=False)
            n, middle2, mad4, far = solve(np.cumsum(group), rel, c.fill_null(0).to_numpy(), some, own, window, slot + 2 * window)
            none, mine = n < 2, pa.array(own)
            told = [table.column("id").combine_chunks().filter(mine), kind.filter(mine), pa.array(n.astype(np.int64)), pa.array(middle2, mask=none), pa.array(mad4, mask=none), pa.array(far, mask=none | ~some[own])]
            yield pa.record_batch(told, ["click_id", "kind", "n", "median2", "mad4", "far"])

    return moved.mapInArrow(run, RESULT)


def counted(points: DataFrame, asks: DataFrame, key: list[str], bits: int, cell: int) -> DataFrame:
    """key, n: of asks (key, g, at, y, sign), the signed sum of how many points (g, t, v) have t up to at and v below y.

    Values of so many bits are read as digits. The points below y are those that share y's leading digits up to some level and have a
    smaller digit there; for each level, prefix counts of every digit by time tell how many there are.
    """
    levels = -(-bits // DIGIT)
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))

    def split(rows: DataFrame, value: str, time: str) -> DataFrame:
        rows = rows.withColumn("level", level)
        upper = F.expr(f"shiftright({value}, (level + 1) * {DIGIT})")
        own = F.expr(f"shiftright({value}, level * {DIGIT})").bitwiseAND(F.lit((1 << DIGIT) - 1)).cast("int")
        return rows.select("*", upper.alias("lead"), own.alias("digit"), F.expr(f"{time} div {cell} - CASE WHEN {time} % {cell} < 0 THEN 1 ELSE 0 END").alias("cell"), F.col(time).alias("time")).drop(value)

    none = [F.lit(None).cast(asks.schema[c].dataType).alias(c) for c in (*key, "sign")]
    node = ["node_g", "level", "lead"]
    rows = split(points.select(F.col("g").alias("node_g"), "t", "v"), "v", "t").select(*node, "digit", "cell", "time", *none)
    rows = rows.unionAll(split(asks.withColumn("node_g", F.col("g")), "y", "at").select(*node, "digit", "cell", "time", *key, "sign"))
    point = F.col("sign").isNull()
    ones = {f"d{i}": F.when(point & (F.col("digit") == i), 1).otherwise(0).cast("long") for i in range(1 << DIGIT)}
    totals = rows.groupBy(*node, "cell").agg(*[F.sum(x).alias(d) for d, x in ones.items()])
    before = Window.partitionBy(*node).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # a row for each cell that has any
    totals = totals.select(*node, "cell", *[F.coalesce(F.sum(d).over(before), F.lit(0)).alias(f"b{d}") for d in ones])
    within = Window.partitionBy(*node, "cell").orderBy("time", F.col("sign").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    less = lambda x: sum((F.when(F.col("digit") > i, F.col(f"{x}{i}")).otherwise(0) for i in range(1 << DIGIT)), F.lit(0).cast("long"))
    told = rows.select("*", *[F.sum(x).over(within).alias(f"w{d}") for d, x in ones.items()]).where(~point)
    told = told.select(*node, "cell", *key, "sign", less("wd").alias("here"), "digit").join(totals, [*node, "cell"])
    return told.groupBy(*key).agg(F.sum(F.col("sign") * (F.col("here") + less("bd"))).alias("n"))


def by_rounds(rows: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """The result rows of slots that are too dense for a task, all windows bisected together, a round a job."""
    cell = max(1, window // CELLS)
    g = F.concat(F.coalesce(F.concat(F.lit("k"), "kind"), F.lit("-")), F.lit("|"), F.col("slot").cast("string"))
    rows = scratch.save(rows.select("id", "kind", "t", "c", g.alias("g"), (F.col("rel") >= window).alias("own")), "dense")
    ends = rows.agg(F.min("c").alias("a"), F.max("c").alias("b")).first()
    least, span = ends.a or 0, (ends.b or 0) - (ends.a or 0)
    bits = (span + 2).bit_length()
    points = rows.where("c IS NOT NULL").select("g", "t", (F.col("c") - least).alias("v"))
    key = ["g", "t", "k"]

    def counts(state: DataFrame, below: list) -> DataFrame:
        """How many values of each window are below the first bound and, if there are two, not below the second."""
        bounds = F.explode(F.array(*[F.struct(F.least(F.greatest(y, F.lit(0)), F.lit(span + 1)).cast("long").alias("y"), (F.lit(1 - 2 * i) * s).cast("long").alias("sign"), (F.col("t") - back).alias("at")) for i, y in enumerate(below) for s, back in ((1, 0), (-1, window))]))
        return counted(points, state.select(*key, bounds.alias("x")).select(*key, "x.*"), key, bits, cell)

    def bisect(state: DataFrame, bounds, most: int, name: str) -> DataFrame:
        """g, t, k, x: the least x up to most at which enough values (k) are within the bounds."""
        state = state.withColumn("low", F.lit(0).cast("long")).withColumn("high", F.lit(most).cast("long"))
        for n in range(most.bit_length()):
            mid = F.expr("low + (high - low) div 2")
            found = counts(state.withColumn("r", mid), bounds(F.col("r")))
            enough = F.col("n") >= F.col("k")
            state = state.withColumn("r", mid).join(found, key).withColumn("high", F.when(enough, F.col("r")).otherwise(F.col("high"))).withColumn("low", F.when(enough, F.col("low")).otherwise(F.least(F.col("r") + 1, "high")))
            state = scratch.save(state.drop("r", "n"), f"{name}{n}")
        return state.withColumnRenamed("high", "x").drop("low")

    windows = rows.where("own").select("g", "t").distinct().withColumn("k", F.lit(0).cast("long"))
    sized = scratch.save(windows.join(counts(windows, [F.lit(span + 1)]), key).select("g", "t", "n"), "sized")
    both = F.explode(F.array(F.expr("(n + 1) div 2"), F.expr("n div 2 + 1"))).alias("k")  # the two middle ones, which may be the same
    middle = sized.where("n >= 2").select("g", "t", both).distinct()

    def doubled(found: DataFrame, name: str) -> DataFrame:
        return scratch.save(found.groupBy("g", "t").agg((F.min("x") + F.max("x")).alias(name)), name)

    medians = doubled(bisect(middle, lambda x: [x + 1], span, "median"), "m")
    spread = bisect(middle.join(medians, ["g", "t"]), lambda r: [F.expr("shiftright(m + r, 1)") + 1, F.expr("-shiftright(r - m, 1)")], 2 * span, "radius")
    radii = doubled(spread, "mad4")
    told = rows.where("own").join(sized, ["g", "t"], "left").join(medians, ["g", "t"], "left").join(radii, ["g", "t"], "left")
    median2 = F.col("m") + 2 * least
    return told.select(F.col("id").alias("click_id"), "kind", "n", median2.alias("median2"), "mad4", (2 * F.abs(2 * F.col("c") - median2) > 3 * F.col("mad4")).alias("far"))


def rolling_medians(
    clicks: DataFrame,
    id_col: str = "click_id",
    time_col: str = "ts",
    series_col: str = "kind",
    value_col: str = "value",
    window_s: int = 3600,
    slot_s: int = 4 * 3600,
    most: int = 1 << 21,
) -> DataFrame:
    """click_id, kind, n, median2, mad4 and far of each click.

    slot_s: a slot's seconds at first. most: rows of a slot and the window before it beyond which it is cut into shorter slots.
    """
    scratch = Scratch(clicks.sparkSession, "rolling")
    window, slot, ts = window_s * 1_000_000, slot_s * 1_000_000, F.col(time_col)
    row = F.struct(ts.isNull().alias("lacks"), micros(ts).alias("t"), F.col(series_col).cast("string").alias("kind"), cents(F.col(value_col)).alias("c"))
    once = clicks.select(F.col(id_col).cast("long").alias("id"), row.alias("x")).groupBy("id").agg(F.min("x").alias("x")).where(~F.col("x.lacks"))
    ends = np.iinfo(np.int64)
    rest = scratch.save(once.select("id", "x.t", "x.kind", "x.c"), "points").select("*", F.lit(ends.min).alias("from"), F.lit(ends.max).alias("upto"))
    result = None
    for level in itertools.count():
        rows = deal(rest, window, slot)
        dense = rows.groupBy("kind", "slot").agg(F.count("*").alias("size")).where(F.col("size") > most).select(F.col("kind").alias("dense_kind"), F.col("slot").alias("dense_slot"))
        dense = scratch.save(dense, f"dense{level}")
        if not dense.limit(1).count():
            found = answer(rows, window, slot)
            return found if result is None else result.unionAll(found)
        same = F.col("kind").eqNullSafe(F.col("dense_kind")) & (F.col("slot") == F.col("dense_slot"))
        found = answer(rows.join(dense, same, "left_anti"), window, slot)
        result = found if result is None else result.unionAll(found)
        if slot * LEAST_SLOT <= window:
            return result.unionAll(by_rounds(rows.join(dense, same, "left_semi"), window, scratch))
        span = (F.col("slot") * slot).alias("from"), ((F.col("slot") + 1) * slot).alias("upto")
        rest = scratch.save(rows.join(dense, same, "left_semi").select("id", "t", "kind", "c", *span), f"rest{level}")
        slot = max(1, slot // 4)


ORACLE = """
    WITH one AS (
        SELECT click_id, min(struct_pack(lacks := ts IS NULL, t := epoch_us(ts), kind := kind, value := value)) AS x FROM clicks GROUP BY click_id
    ), p AS (
        SELECT click_id, x.t AS t, x.kind AS kind,
               CASE WHEN isfinite(x.value) AND abs(x.value) <= 720575940379279.36 THEN CAST(floor(100 * x.value + 0.5) AS BIGINT) END AS c
        FROM one WHERE NOT x.lacks
    ), w AS (
        SELECT click_id, kind, c, list_sort(coalesce(list(c) FILTER (WHERE c IS NOT NULL) OVER (PARTITION BY kind ORDER BY t RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW), [])) AS s FROM p
    ), m AS (
        SELECT click_id, kind, c, len(s) AS n, s, CASE WHEN len(s) >= 2 THEN s[(len(s) + 1) // 2] + s[len(s) // 2 + 1] END AS median2 FROM w
    ), d AS (
        SELECT click_id, kind, c, n, median2, CASE WHEN n >= 2 THEN list_sort(list_transform(s, lambda x: abs(2 * x - median2))) END AS r FROM m
    ), f AS (
        SELECT *, r[(n + 1) // 2] + r[n // 2 + 1] AS mad4 FROM d
    )
    SELECT click_id, kind, CAST(n AS BIGINT) AS n, median2, mad4, 2 * abs(2 * c - median2) > 3 * mad4 AS far FROM f
"""
