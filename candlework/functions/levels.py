"""Instrument levels, position size, fills and trade results as expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.series import over_series
from .scalar import ratio

DEFAULT_POINT = 0.01


def point_size(override: Column, spec: Column) -> Column:
    """Configured size first, then the instrument's own, then the default."""
    return F.coalesce(override, spec, F.lit(DEFAULT_POINT))


def tick_value(tick: Column, contract: Column) -> Column:
    return F.when(tick > 0, tick).otherwise(F.coalesce(F.when(contract != 0, contract), F.lit(1.0)))


def with_levels(df: DataFrame, instruments: DataFrame, *, tp_points: float, sl_points: float, price: str = "close", key: str = "symbol") -> DataFrame:
    """Join the instrument dimension and add point size and exit prices.

    The dimension has one row per instrument; Spark broadcasts it when its size
    allows, so no hint is given.
    """
    point = point_size(F.col("point_override"), F.col("point_size"))
    tp = F.coalesce("tp_points", F.lit(tp_points)) * F.col("point")
    sl = F.coalesce("sl_points", F.lit(sl_points)) * F.col("point")
    return (
        df.join(instruments, key, "left")
        .withColumn("point", point)
        .withColumns({"tp_distance": tp, "sl_distance": sl})
        .withColumns({"tp_price": F.col(price) + F.col("tp_distance"), "sl_price": F.col(price) - F.col("sl_distance")})
    )


def position_size(
    portfolio: Column,
    entry: Column,
    *,
    point: Column,
    tick: Column,
    contract: Column,
    volume_min: Column,
    volume_step: Column,
    volume_max: Column,
    stop_points: float = 20.0,
    risk_per_trade: float = 0.01,
    max_position: float = 0.1,
) -> Column:
    """Lots such that the stop loses the risk share; floored to the lot step and capped."""
    stop = F.greatest(F.lit(stop_points) * point, F.lit(1e-9))
    loss = stop * F.when(tick > 0, tick).when(contract > 0, contract).otherwise(entry)
    size = ratio(portfolio * risk_per_trade, loss)
    size = F.when((volume_min > 0) & (size < volume_min), volume_min).otherwise(size)
    size = F.when(volume_step > 0, F.floor(size / volume_step + 1e-12) * volume_step).otherwise(size)
    cap = F.when(volume_max > 0, F.least(F.lit(max_position), volume_max)).otherwise(F.lit(max_position))
    sized = F.greatest(F.lit(0.0), F.least(size, cap))
    return F.when((portfolio <= 0) | (entry <= 0), F.lit(0.0)).otherwise(sized)


def share_size(portfolio: Column, entry: Column, atr: Column, *, risk_per_trade: float = 0.01, max_position: float = 0.1) -> Column:
    """Units without an instrument: two ATR of risk, or a flat share of capital."""
    flat = ratio(portfolio * max_position, entry)
    raw = F.when(atr > 0, portfolio * risk_per_trade / (atr * 2.0)).otherwise(flat)
    return F.when((portfolio <= 0) | (entry <= 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(raw, flat)))


def protective_prices(entry: Column, atr: Column, *, stop_loss: float = 0.02, take_profit: float = 0.04) -> dict[str, Column]:
    return {
        "stop_loss_price": F.when(atr > 0, entry - 2.0 * atr).otherwise(entry * (1.0 - stop_loss)),
        "take_profit_price": F.when(atr > 0, entry + 3.0 * atr).otherwise(entry * (1.0 + take_profit)),
    }


def exit_reason(price: Column, stop: Column, target: Column) -> Column:
    return F.when(price <= stop, "stop_loss").when(price >= target, "take_profit")


def fill_price(price: Column, direction: Column, slippage: float, *, entry: bool) -> Column:
    """A fill is always worse than the quoted price by the slippage share."""
    worse = (direction > 0) == F.lit(entry)
    return price * F.when(worse, 1.0 + slippage).otherwise(1.0 - slippage)


def trade_results(
    *,
    quantity: Column,
    direction: Column,
    entry: Column,
    exit: Column,
    point: Column,
    tick: Column,
    commission: float = 0.001,
    slippage: float = 0.0005,
    double_count: bool = False,
) -> dict[str, Column]:
    """Fills, costs and profit of a closed trade.

    Fills already contain slippage; ``double_count`` subtracts it once more, as
    some recorded ledgers did.  ``quantity`` is unsigned.
    """
    signed = quantity * direction
    entry_fill = fill_price(entry, direction, slippage, entry=True)
    exit_fill = fill_price(exit, direction, slippage, entry=False)
    unit = quantity / point * tick
    gross = signed * (exit_fill - entry_fill) / point * tick
    fee = unit * (entry_fill + exit_fill) * commission
    slip = unit * (F.abs(entry_fill - entry) + F.abs(exit_fill - exit))
    net = gross - fee - slip if double_count else gross - fee
    return {
        "entry_fill_price": entry_fill,
        "exit_fill_price": exit_fill,
        "gross_pnl": gross,
        "commission": fee,
        "slippage": slip,
        "net_pnl": net,
        "return_pct": F.coalesce(net / F.nullif(quantity * entry_fill, F.lit(0.0)), F.lit(0.0)),
    }


def endpoint_economics(bars: DataFrame, *, side: Column, horizon: int, cost: Column, keys: Sequence[str], by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Signed return at the end of the horizon, before and after a price cost."""

    def build(df, w):
        return df.withColumns({"_side": side, "_cost": cost, "_end": F.lead("close", horizon).over(w)})

    rows = over_series(bars, build, by=by, ahead=horizon).where(F.col("_end").isNotNull())
    signed = F.col("_side") * (ratio(F.col("_end"), F.col("close")) - 1.0)
    return rows.withColumns({"_s": signed, "_net": signed - ratio(F.col("_cost"), F.col("close"))}).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("_s").alias("mean_signed_return"),
        F.avg("_net").alias("mean_after_spread"),
        F.avg((F.col("_s") > 0).cast("double")).alias("win_rate"),
    )
