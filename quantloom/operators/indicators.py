"""Anchored averages, running flows and rolling baselines over bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quantloom.functions.market import ratio


def _running(keys: list[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def anchored_vwap(df: DataFrame, keys: list[str], order: str, name: str, active: Column | None = None, price: Column | None = None, volume: Column | None = None) -> DataFrame:
    """Adds <name>, <name>_sd and <name>_up1.. _dn3: cumulative average price by volume and its bands.

    Cumulates over the active rows of each group and is null on the others and
    until there is volume. The variance is clipped at zero.
    """
    active = F.lit(True) if active is None else active
    price = (F.col("high") + F.col("low") + F.col("close")) / 3 if price is None else price
    volume = F.col("volume") if volume is None else volume
    w = _running(keys, order)
    v = F.when(active, volume).otherwise(0)
    total = F.sum(v).over(w)
    mean = ratio(F.sum(v * price).over(w), total)
    square = ratio(F.sum(v * price * price).over(w), total)
    out = df.withColumns({name: F.when(active, mean), f"{name}_sq": F.when(active, square)})
    out = out.withColumn(f"{name}_sd", F.sqrt(F.greatest(F.col(f"{name}_sq") - F.col(name) * F.col(name), F.lit(0.0)))).drop(f"{name}_sq")
    return out.withColumns({f"{name}_{'up' if s > 0 else 'dn'}{k}": F.col(name) + s * k * F.col(f"{name}_sd") for k in (1, 2, 3) for s in (1, -1)})


def level_moments(levels: Column) -> tuple[Column, Column, Column]:
    """Volume, price x volume and price² x volume of an array of (price, buy, sell) levels."""
    add = lambda f: F.aggregate(levels, F.lit(0.0), lambda a, x: a + f(x["price"], (x["buy"] + x["sell"]).cast("double")))
    return add(lambda p, v: v), add(lambda p, v: p * v), add(lambda p, v: p * p * v)


def cumulative_delta(df: DataFrame, keys: list[str], order: str, buy: str = "buy_volume", sell: str = "sell_volume") -> DataFrame:
    """Adds cvd: the running sum of bought less sold volume of each group."""
    return df.withColumn("cvd", F.sum(F.coalesce(buy, F.lit(0)) - F.coalesce(sell, F.lit(0))).over(_running(keys, order)))


def full_window(expr: Column, keys: list[str], order: str, n: int, func=F.avg) -> Column:
    """func over the last n rows, null until there are n values."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - n, 0)
    return F.when(F.count(expr).over(w) == n, func(expr).over(w))


def previous_extreme(expr: Column, keys: list[str], order: str, k: int, func=F.max) -> Column:
    """func over the k rows before the current one, null until there are k."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-k, -1)
    return F.when(F.count(expr).over(w) == k, func(expr).over(w))


def strided_mean(df: DataFrame, expr: Column, keys: list[str], order: str, pairs: int, name: str) -> DataFrame:
    """Adds name: mean of up to `pairs` values two rows apart, ending at the row."""
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    w = Window.partitionBy(*keys, "_odd").orderBy(order).rowsBetween(1 - pairs, 0)
    return df.withColumn("_odd", pos % 2).withColumn(name, F.avg(expr).over(w)).drop("_odd")


def ema(df: DataFrame, keys: list[str], order: str, value: str, span: int, name: str) -> DataFrame:
    """Adds name: the exponential average with weight 2 / (span + 1), the first value as it is.

    The recursion runs over the group's rows in order, in arrow batches of one
    group; groups are sessions.
    """
    import pandas as pd

    schema = StructType([*df.schema.fields, StructField(name, DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        pdf[name] = pdf[value].ewm(span=span, adjust=False).mean()
        return pdf

    return df.groupBy(*keys).applyInPandas(run, schema)
