"""Ordered computations over series of any length.

A plain window puts a whole series into one task. Here a series that holds many rows is cut
into blocks that follow its order; every block is scanned by its own task, one summary row
per block carries the running state, and the carried state is joined back. Series below the
block size keep the plain window, so ordinary data pays for nothing but one count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stationproof.functions.columns import lookup, micros, sized_broadcast
from stationproof.functions.state import cut

BLOCK_ROWS = 1_000_000
BLK = "_blk"
#: Blocks of one series; beyond so many times the block size its blocks grow.
MOST_BLOCKS = 10_000


def longest(sizes: DataFrame, col: str) -> int:
    return sizes.agg(F.max(col)).first()[0] or 0


def _long_series(df: DataFrame, keys: list[str], target: int, at_most: int | None) -> DataFrame | None:
    """Keys and number of blocks of the series over `target` rows, or None without any."""
    if at_most is not None and at_most <= target:
        return None
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > target)
    many = sizes.select(*keys, F.least(F.ceil(F.col("_n") / target), F.lit(MOST_BLOCKS)).cast("int").alias("_nb"))
    return None if many.isEmpty() else many


def _cuts(df: DataFrame, keys: list[str], many: DataFrame, value: Column) -> DataFrame:
    """Per series of `many`, ascending values that part it into about `_nb` blocks of equal rows.

    Quantiles come from a mergeable sketch; its error only makes blocks a little uneven. Every
    series draws on the longest one's fractions and keeps as many as it has blocks.
    """
    most = longest(many, "_nb")
    fractions = [i / most for i in range(1, most)] or [0.5]
    sketch = df.join(sized_broadcast(many), keys).groupBy(*keys).agg(F.max("_nb").alias("_nb"), F.percentile_approx(value, fractions, max(10_000, 20 * most)).alias("_all"))
    step = F.greatest(F.lit(1), F.floor(F.lit(most) / F.col("_nb")).cast("int"))
    return sketch.select(*keys, F.filter("_all", lambda _, i: (i + 1) % step == 0).alias("_cuts"))


def _place(value: Column, cuts: str) -> Column:
    """Number of cut points under a value; zero where there are none."""
    return F.coalesce(F.size(F.filter(cuts, lambda c: c < value)), F.lit(0)).cast("bigint")


def assign_blocks(
    df: DataFrame,
    keys: list[str],
    ts: str = "timestamp_utc",
    seq: str = "ingest_seq",
    target: int | None = None,
    at_most: int | None = None,
) -> DataFrame:
    """Add `_blk`, a struct that is monotone in (ts, seq) within `keys`, when a series is long.

    Blocks follow row positions: a long series is cut at quantiles of its instants, and an
    instant that alone fills blocks (equal neighbouring cuts) again at quantiles of its
    sequence numbers, however sparse. A series of n rows gets at most about 2 n / target blocks.
    Without long series the frame is returned unchanged; `at_most`, a known bound on the rows
    of any series, answers that without a job.
    """
    if not keys:
        return assign_blocks(df.withColumn("_one", F.lit(1)), ["_one"], ts, seq, target, at_most).drop("_one")
    target = target or BLOCK_ROWS
    many = _long_series(df, keys, target, at_most)
    if many is None:
        return df
    zero = F.lit(0).cast("bigint")
    cuts = cut(_cuts(df, keys, many, micros(ts)))
    out = df.join(sized_broadcast(cuts), keys, "left").withColumn("_b", _place(micros(ts), "_cuts"))
    chunk = zero
    if seq:
        at = [*keys, "_us"]
        repeated = cuts.select(*keys, F.explode("_cuts").alias("_us")).groupBy(*at).count().where("count > 1").select(*at)
        own = df.withColumn("_us", micros(ts))
        full = own.join(sized_broadcast(repeated), at, "left_semi")
        heavy = _long_series(full, at, target, None)
        if heavy is not None:
            parts = _cuts(full, at, heavy, F.col(seq).cast("bigint")).withColumnRenamed("_cuts", "_seqs")
            out = out.withColumn("_us", micros(ts)).join(sized_broadcast(cut(parts)), at, "left")
            chunk = F.when(F.col("_seqs").isNotNull(), 1 + _place(F.col(seq), "_seqs")).otherwise(zero)
    blk = F.struct(F.col("_b").alias("b"), chunk.cast("bigint").alias("c"))
    return out.withColumn(BLK, blk).drop("_b", "_us", "_cuts", "_seqs")


def assign_seq_blocks(
    df: DataFrame,
    keys: list[str],
    seq: str = "ingest_seq",
    target: int | None = None,
    at_most: int | None = None,
) -> DataFrame:
    """Like `assign_blocks` for scans in delivered order: cut at quantiles of the sequence numbers."""
    if not keys:
        return assign_seq_blocks(df.withColumn("_one", F.lit(1)), ["_one"], seq, target, at_most).drop("_one")
    target = target or BLOCK_ROWS
    many = _long_series(df, keys, target, at_most)
    if many is None:
        return df
    out = df.join(sized_broadcast(cut(_cuts(df, keys, many, F.col(seq).cast("bigint")))), keys, "left")
    return out.withColumn(BLK, F.struct(_place(F.col(seq), "_cuts").alias("b"), F.lit(0).cast("bigint").alias("c"))).drop("_cuts")


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    lags: dict[str, Column] | None = None,
    sums: dict[str, Column] | None = None,
    maxs: dict[str, Column] | None = None,
    mins: dict[str, Column] | None = None,
) -> DataFrame:
    """Add running columns over `keys` in `order`.

    lags: value on the previous row; sums: inclusive running sum; maxs: running maximum of the
    rows before this one; mins: inclusive running minimum.
    """
    lags, sums, maxs, mins = lags or {}, sums or {}, maxs or {}, mins or {}
    blocked = BLK in df.columns
    parts = [*keys, BLK] if blocked else keys
    w = W.partitionBy(*parts).orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    prior = w.rowsBetween(W.unboundedPreceding, -1)
    if not blocked:
        return df.select(
            "*",
            *[F.lag(e).over(w).alias(n) for n, e in lags.items()],
            *[F.sum(e).over(upto).alias(n) for n, e in sums.items()],
            *[F.max(e).over(prior).alias(n) for n, e in maxs.items()],
            *[F.min(e).over(upto).alias(n) for n, e in mins.items()],
        )
    base = df.repartition(*parts)
    last = F.struct(*order)
    summary = base.groupBy(*parts).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.max_by(e, last).alias(f"_l_{n}") for n, e in lags.items()],
        *[F.sum(e).alias(f"_s_{n}") for n, e in sums.items()],
        *[F.count(e).alias(f"_c_{n}") for n, e in sums.items()],
        *[F.max(e).alias(f"_x_{n}") for n, e in maxs.items()],
        *[F.min(e).alias(f"_m_{n}") for n, e in mins.items()],
    )
    ws = W.partitionBy(*keys).orderBy(BLK)
    wprior = ws.rowsBetween(W.unboundedPreceding, -1)
    carry = summary.select(
        *parts,
        *[F.lag(f"_l_{n}").over(ws).alias(f"_l_{n}") for n in lags],
        *[F.coalesce(F.sum(f"_s_{n}").over(wprior), F.lit(0)).alias(f"_s_{n}") for n in sums],
        *[F.coalesce(F.sum(f"_c_{n}").over(wprior), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_x_{n}").over(wprior).alias(f"_x_{n}") for n in maxs],
        *[F.min(f"_m_{n}").over(wprior).alias(f"_m_{n}") for n in mins],
    )
    names = df.columns
    local = base.select(
        "*",
        F.row_number().over(w).alias("_rn"),
        *[F.lag(e).over(w).alias(f"_ll_{n}") for n, e in lags.items()],
        *[F.sum(e).over(upto).alias(f"_ls_{n}") for n, e in sums.items()],
        *[F.max(e).over(prior).alias(f"_lx_{n}") for n, e in maxs.items()],
        *[F.min(e).over(upto).alias(f"_lm_{n}") for n, e in mins.items()],
    )
    return local.join(carry, parts).select(
        *names,
        *[
            F.when(F.col("_rn") == 1, F.col(f"_l_{n}")).otherwise(F.col(f"_ll_{n}")).alias(n)
            for n in lags
        ],
        *[
            F.when(F.col(f"_ls_{n}").isNull() & (F.col(f"_c_{n}") == 0), None)
            .otherwise(F.coalesce(f"_ls_{n}", F.lit(0)) + F.col(f"_s_{n}"))
            .alias(n)
            for n in sums
        ],
        *[F.greatest(f"_lx_{n}", f"_x_{n}").alias(n) for n in maxs],
        *[F.least(f"_lm_{n}", f"_m_{n}").alias(n) for n in mins],
    )


def assign_value_blocks(df: DataFrame, keys: list[str], value: str, target: int | None = None) -> DataFrame:
    """Like `assign_blocks` for scans in the order of a number: cut at quantiles of it."""
    many = _long_series(df, keys, target or BLOCK_ROWS, None)
    if many is None:
        return df
    out = df.join(sized_broadcast(cut(_cuts(df, keys, many, F.col(value)))), keys, "left")
    return out.withColumn(BLK, F.struct(_place(F.col(value), "_cuts").alias("b"), F.lit(0).cast("bigint").alias("c"))).drop("_cuts")


def drop_blocks(df: DataFrame) -> DataFrame:
    return df.drop(BLK) if BLK in df.columns else df


def islands(
    df: DataFrame, keys: list[str], order: list[str], breaks, lag_of: dict[str, Column]
) -> DataFrame:
    """Number maximal runs: `breaks(prev)` is true where a row does not continue the run.

    `lag_of` names the previous-row columns that `breaks` reads. Adds `_run`.
    """
    scanned = ordered_scan(df, keys, order, lags=lag_of)
    flagged = scanned.withColumn("_brk", F.when(breaks(), 1).otherwise(0).cast("bigint"))
    return ordered_scan(flagged, keys, order, sums={"_run": F.col("_brk")})


def rolling_frame(
    df: DataFrame, keys: list[str], rn: str, span: int, target: int | None = None
) -> tuple[DataFrame, list[str]]:
    """Split series by row position so that a rolling window of `span` rows stays local.

    Rows near the end of a block are repeated into the next one as `_halo` rows; drop them
    after the rolling expressions. Returns the frame and the window partition columns.
    """
    target = target or BLOCK_ROWS
    pos = F.col(rn) - 1
    blk = F.floor(pos / target).cast("bigint")
    near_end = pos - blk * target >= target - span
    copies = F.when(near_end, F.array(blk, blk + 1)).otherwise(F.array(blk))
    out = df.withColumn("_rblk", F.explode(copies)).withColumn("_halo", F.col("_rblk") > blk)
    return out, [*keys, "_rblk"]


#: Rows of one group that a single window may order; larger groups are narrowed by counting first.
HELD_ROWS = 200_000
#: Parts into which one round of counting cuts the values that may hold a rank.
PARTS = 4096
_MOST, _LEAST = 1.7976931348623157e308, 2.2250738585072014e-308


def value_part(v: Column, lo: Column, hi: Column, parts: int) -> Column:
    """Number of the part of [lo, hi] that holds v, never falling as v grows.

    Parts are equal on a scale of orders of magnitude where the ends are more than four times apart or differ in sign, else
    equal in value; so a few rounds tell any two numbers apart. Halves keep differences from overflowing.
    """
    finite = lambda c: F.least(F.greatest(c.cast("double"), F.lit(-_MOST)), F.lit(_MOST)) / 2.0
    order = lambda c: F.when(F.abs(c) > _LEAST, F.signum(c) * (F.ln(F.abs(c)) + 709.0)).otherwise(0.0)
    a, b, x = finite(lo), finite(hi), finite(v)
    near = ((a > 0) & (b / 4 <= a)) | ((b < 0) & (a / 4 >= b))
    at = F.when(near, F.try_divide(x - a, b - a)).otherwise(F.try_divide(order(x) - order(a), order(b) - order(a)))
    return F.when(at.isNull(), (v > lo).cast("bigint")).otherwise(F.floor(at * parts))


def _counted(cells: DataFrame, by: list[str], cell: str, *more: Column) -> DataFrame:
    """Rows of every cell and of all cells of its group up to it, from counts that combine before they are shuffled."""
    c = cells.groupBy(*by, cell).agg(F.count(F.lit(1)).alias("_c"), *more)
    w = W.partitionBy(*by).orderBy(cell)
    return c.withColumn("_cum", F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0)))


def _holds(rank: Column) -> Column:
    return (rank > F.col("_cum") - F.col("_c")) & (rank <= F.col("_cum"))


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], at_most: int | None = None) -> DataFrame:
    """Exact order statistics per group, and its rows as `_n`; `ranks` maps a name to a rank in terms of `_n`.

    Small groups count their distinct values and order them in one window. In a group of more than `HELD_ROWS` rows every rank
    keeps an interval of values that holds it. A round counts the rows of the interval in `PARTS` equal parts of it and goes
    on with the values of the part that holds the rank, all ranks of all groups at once. The rows are only counted, so a
    group of any size is spread over all tasks, and no rank depends on an estimate. Missing values (null or NaN) don't count;
    a rank outside 1 to `_n` is null. `at_most`, a known bound on the rows of a group, saves the count.
    """
    by = keys or ["_all"]
    v = F.col(value)
    source = df.where(v.isNotNull() & ~F.isnan(v.cast("double")))
    d = source.select(*keys, v.alias("_v")) if keys else source.select(F.lit(1).alias("_all"), v.alias("_v"))
    names = list(ranks)
    if at_most is None or at_most > HELD_ROWS:
        sizes = cut(d.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
        if longest(sizes, "_n") > HELD_ROWS:
            return _selected(d, by, sizes, ranks).select(*keys, "_n", *names)
    cum = _counted(d, by, "_v").withColumn("_n", F.sum("_c").over(W.partitionBy(*by)))
    return cum.groupBy(*by).agg(F.max("_n").alias("_n"), *[F.max(F.when(_holds(r), F.col("_v"))).alias(n) for n, r in ranks.items()]).select(*keys, "_n", *names)


def _selected(d: DataFrame, by: list[str], sizes: DataFrame, ranks: dict[str, Column]) -> DataFrame:
    """Order statistics by rounds of counting, see `order_statistics`."""
    wanted = F.array(*[F.struct(F.lit(n).alias("_name"), r.cast("bigint").alias("_rank")) for n, r in ranks.items()])
    t = sizes.select(*by, "_n", "_lo", "_hi", F.col("_n").alias("_in"), F.lit(0).cast("bigint").alias("_below"), F.inline(wanted))
    t = cut(t.where(F.col("_rank").between(1, F.col("_n"))))
    span = [*by, "_lo", "_hi"]
    open_ = (F.col("_in") > HELD_ROWS) & (F.col("_lo") < F.col("_hi"))

    def inside(targets: DataFrame) -> DataFrame:
        return d.join(sized_broadcast(targets.select(*span).distinct()), by).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))

    while not (todo := t.where(open_)).isEmpty():
        cells = inside(todo).withColumn("_part", value_part(F.col("_v"), F.col("_lo"), F.col("_hi"), PARTS))
        counted = _counted(cells, span, "_part", F.min("_v").alias("_min"), F.max("_v").alias("_max"))
        hit = todo.join(counted, span).where(_holds(F.col("_rank") - F.col("_below")))
        narrow = hit.select(*by, "_n", F.col("_min").alias("_lo"), F.col("_max").alias("_hi"), F.col("_c").alias("_in"), (F.col("_below") + F.col("_cum") - F.col("_c")).alias("_below"), "_name", "_rank")
        t = cut(t.where(~open_).unionByName(narrow))
    small = t.where("_lo < _hi")
    last = small.join(_counted(inside(small), span, "_v"), span).where(_holds(F.col("_rank") - F.col("_below")))
    found = t.where("_lo = _hi").select(*by, "_name", F.col("_lo").alias("_v")).unionByName(last.select(*by, "_name", "_v"))
    wide = found.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in ranks])
    return sizes.select(*by, "_n").join(wide, by, "left")


def exact_median(df: DataFrame, keys: list[str], value: str, name: str, at_most: int | None = None) -> DataFrame:
    """Exact median per group (mean of the two middle values), one row per group."""
    n = F.col("_n")
    out = order_statistics(
        df, keys, value, {"_a": F.floor((n + 1) / 2), "_b": F.floor(n / 2) + 1}, at_most
    )
    return out.select(*keys, ((F.col("_a") + F.col("_b")) / 2.0).alias(name))


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number all rows from 1 in `order` without a window over all of them.

    Rows are dealt to ranges of the order and numbered within their range; a range starts where the
    counts of those before it end. The driver holds one count a range, whatever the rows.
    """
    placed = cut(df.orderBy(*order).withColumn("_range", F.spark_partition_id()))
    starts, before = {}, 0
    for r in placed.groupBy("_range").count().orderBy("_range").collect():
        starts[r["_range"]] = before
        before += r["count"]
    first = lookup(starts, F.col("_range")) if starts else F.lit(0)
    within = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return placed.withColumn(name, (first + within).cast("bigint")).drop("_range")
