"""Exact medians of everything earlier than an instant, for many instants of long series.

Joining every request with the history before it grows with requests times history. Here the days of a series form a binary tree whose
nodes hold counts of values by part of the value range: a request adds up the at most one node a level that its
whole earlier days consist of, and the values of its own day. From the counts it takes the part that holds its rank and goes on inside that part, with
the values of the parts that any request needs, until one value is left. Rows met grow with requests times levels times parts; the values are read
once a round and only counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stationproof.functions.columns import sized_broadcast
from stationproof.functions.scan import value_part
from stationproof.functions.state import cut

DAY_S = 86_400
#: Parts of an interval in one round.
PARTS = 256
#: Levels of the tree: more days than lie between the years 1 and 9999.
LEVELS = 22


def _nodes(day: Column, of_prefix: bool) -> Column:
    """Tree nodes (level, index) of a day, or those that make up all days before it.

    A prefix only ever needs nodes of even index, so values go to no others.
    """
    levels = F.sequence(F.lit(0), F.lit(LEVELS - 1))
    index = F.transform(levels, lambda l: F.struct(l.alias("level"), F.call_function("shiftright", day, l).alias("index")))  # noqa: E741
    if of_prefix:
        return F.transform(F.filter(index, lambda n: n["index"] % 2 == 1), lambda n: F.struct(n["level"].alias("level"), (n["index"] - 1).alias("index")))
    return F.filter(index, lambda n: n["index"] % 2 == 0)


def earlier_medians(asked: DataFrame, keys: list[str], values: DataFrame, series: list[str], name: str) -> DataFrame:
    """keys and the exact median of the values (`_val`) of the request's series with `_s` before its `_t`.

    `asked` has keys, series and `_t`, `values` series, `_s` and `_val`, both in seconds. Requests with nothing before them give no row.
    """
    vals = values.join(sized_broadcast(asked.select(*series).distinct()), series, "left_semi").where(~F.isnan(F.col("_val").cast("double")))
    span = cut(vals.groupBy(*series).agg(F.min(F.expr(f"_s div {DAY_S}")).alias("_first"), F.max(F.expr(f"_s div {DAY_S}")).alias("_last"), F.min("_val").alias("_lo"), F.max("_val").alias("_hi")))
    day = lambda s: F.expr(f"{s} div {DAY_S}") - F.col("_first")
    after = F.expr(f"_t div {DAY_S}") > F.col("_last")
    req = asked.join(span, series).withColumn("_day", F.when(after, F.col("_last") - F.col("_first") + 1).otherwise(day("_t")))
    req = cut(req.where("_day >= 0").select(*keys, *series, "_t", "_day", "_lo", "_hi", F.lit(None).cast("bigint").alias("_rank"), F.lit(0).cast("bigint").alias("_below")))
    asked_nodes = cut(req.select(*series, F.inline(_nodes(F.col("_day"), True))).distinct())
    vals = cut(vals.join(sized_broadcast(span), series).select(*series, "_s", "_val", day("_s").alias("_day"), "_lo", "_hi"))
    done, cell = None, [*series, "_lo", "_hi", "_part"]
    w = W.partitionBy(*keys, "_rank").orderBy("_part").rowsBetween(W.unboundedPreceding, 0)
    while True:
        placed = vals.withColumn("_part", value_part(F.col("_val"), F.col("_lo"), F.col("_hi"), PARTS))
        bounds = cut(placed.groupBy(*cell).agg(F.min("_val").alias("_min"), F.max("_val").alias("_max")))
        tree = placed.select(*cell, F.inline(_nodes(F.col("_day"), False))).join(sized_broadcast(asked_nodes), [*series, "level", "index"], "left_semi")
        tree = tree.groupBy(*cell, "level", "index").agg(F.count(F.lit(1)).alias("_c"))
        here = [*series, "_lo", "_hi"]
        one = [*keys, *here, "_rank", "_below", "_t", "_day", "_part"]
        whole = req.select("*", F.inline(_nodes(F.col("_day"), True))).join(tree, [*here, "level", "index"]).select(*one, "_c")
        own = req.join(placed.select(*here, "_day", "_s", "_part"), [*here, "_day"]).where(F.col("_s") < F.col("_t")).select(*one, F.lit(1).alias("_c"))
        counts = whole.unionByName(own).groupBy(*one).agg(F.sum("_c").alias("_c"))
        if done is None:
            counts = counts.withColumn("_n", F.sum("_c").over(W.partitionBy(*keys)))
            both = F.array_distinct(F.array(F.expr("(_n + 1) div 2"), F.expr("_n div 2 + 1")))
            counts = counts.withColumn("_rank", F.explode(both)).drop("_n")
        hit = counts.withColumn("_cum", F.sum("_c").over(w) + F.col("_below"))
        hit = hit.where((F.col("_rank") > F.col("_cum") - F.col("_c")) & (F.col("_rank") <= F.col("_cum"))).withColumn("_below", F.col("_cum") - F.col("_c"))
        narrow = cut(hit.join(bounds, cell).select(*keys, *series, "_t", "_day", F.col("_min").alias("_lo"), F.col("_max").alias("_hi"), "_rank", "_below", F.struct("_lo", "_hi", "_part").alias("_from")))
        found = narrow.where("_lo = _hi").select(*keys, F.col("_lo").alias("_val"))
        done = found if done is None else done.unionByName(found)
        still = narrow.where("_lo < _hi")
        if still.isEmpty():
            return done.groupBy(*keys).agg(F.avg("_val").alias(name))
        req = cut(still.drop("_from"))
        need = still.select(*series, "_from.*", F.col("_lo").alias("_min"), F.col("_hi").alias("_max")).distinct()
        vals = cut(placed.join(sized_broadcast(need), cell).select(*series, "_s", "_val", "_day", F.col("_min").alias("_lo"), F.col("_max").alias("_hi")))
