"""Exits, non-overlapping trades, ledgers, equity and strategy metrics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import trade_results
from ..functions.scalar import ratio
from .labels import SL_FIRST, TP_FIRST
from .series import INDEX, over_series, running_sum, with_row_index
from .staging import stage

FANOUT = 64
#: Copies of a group of bars at most.
SALTS = 4096
#: Corners that describe the extreme bars of a group at most.
FRONT_STEPS = 64
CHAIN_ROWS = 4096


# ------------------------------------------------------------------ unbounded exits


def extreme_levels(bars: DataFrame, by: Sequence[str] = ("symbol",)) -> list[DataFrame]:
    """Bars in groups of 64, those again in groups of 64, and so on; one stored table per level, a row per group.

    A group holds the extremes of its children, and two staircases: the children that set a new high (low) among those
    before them.  A search that may start at the first child needs the few steps of a staircase only.
    """
    top = bars.agg(F.max(INDEX)).first()[0] or 0
    child, levels = bars.select(*by, F.col(INDEX).alias("_at"), "high", "low"), []
    stairs = "aggregate(_kids, cast(array() AS array<struct<k: bigint, v: double>>), (s, x) -> CASE WHEN x.{0} IS NOT NULL AND (size(s) = 0 OR x.{0} {1} element_at(s, -1).v) THEN array_append(s, struct(x.k AS k, cast(x.{0} AS double) AS v)) ELSE s END)"
    while not levels or top >> (6 * len(levels)):
        node = child.withColumn("_node", F.shiftright("_at", 6)).groupBy(*by, "_node").agg(
            F.array_sort(F.collect_list(F.struct((F.col("_at") % FANOUT).alias("k"), "high", "low"))).alias("_kids"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
        )
        levels.append(stage(node.withColumns({"_highs": F.expr(stairs.format("high", ">")), "_lows": F.expr(stairs.format("low", "<"))})))
        child = levels[-1].select(*by, F.col("_node").alias("_at"), "high", "low")
    return levels


def _first_child(up: Column, down: Column, after: Column) -> Column:
    """Lowest child beyond ``after`` whose extremes reach a level."""
    hit = F.filter("_kids", lambda x: ((x["high"] >= up) | (x["low"] <= down)) & (x["k"] > after))
    return F.try_element_at(F.transform(hit, lambda x: x["k"]), F.lit(1))


def _first_step(up: Column, down: Column) -> Column:
    """Lowest child whose extremes reach a level, off the staircases."""
    rising = F.try_element_at(F.filter("_highs", lambda x: x["v"] >= up), F.lit(1))["k"]
    falling = F.try_element_at(F.filter("_lows", lambda x: x["v"] <= down), F.lit(1))["k"]
    return F.least(rising, falling)


def _climb(queries: DataFrame, levels: list[DataFrame], *, by: Sequence[str], start: str, salt_by: Sequence[str], child, step, step_columns: Sequence[str]) -> DataFrame:
    """Walk every query from bar ``start`` up the levels to the first group that holds a hit, then down to its bar.

    ``child(k, after)`` is the first hit among the children of a group of level ``k`` beyond ``after``, ``step(k)`` the
    first hit among all of them.  ``_cur`` is the bar met where ``_lvl`` is 0; nothing is met where it is -1.  Where a
    group's summary promised a hit that its children do not hold, ``_cur`` is NULL and ``_from`` the group's last bar.
    """
    # Negative keys match nothing and spread the rows that need no lookup.
    idle = -1 - F.col(INDEX)
    q = queries.withColumns({"_cur": F.col(start), "_lvl": F.lit(-1), "_from": F.lit(None).cast("long")})

    def looked_up(q: DataFrame, k: int, asks: Column, node: Column, columns: Sequence[str]) -> DataFrame:
        salts = min(FANOUT**k, SALTS)
        copies = levels[k].select(*by, "_node", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"), *columns)
        salt = F.when(asks, F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int")).otherwise(0)
        return q.withColumns({"_node": F.when(asks, node).otherwise(idle), "_salt": salt}).join(copies, [*by, "_node", "_salt"], "left")

    for k in range(len(levels)):
        searching = F.col("_lvl") < 0
        here = F.shiftright("_cur", 6)
        q = looked_up(q, k, searching, here, ["_kids"]).withColumn("_kid", child(k, F.col("_cur") % FANOUT))
        q = q.withColumns(
            {
                "_cur": F.when(searching & F.col("_kid").isNotNull(), here * FANOUT + F.col("_kid")).when(searching, here).otherwise(F.col("_cur")),
                "_lvl": F.when(searching & F.col("_kid").isNotNull(), F.lit(k)).otherwise(F.col("_lvl")),
            }
        ).drop("_kids", "_node", "_salt", "_kid")
    for k in range(len(levels) - 1, 0, -1):
        inside = (F.col("_lvl") == k) & F.col("_cur").isNotNull()
        q = looked_up(q, k - 1, inside, F.col("_cur"), step_columns).withColumn("_kid", step(k - 1))
        q = q.withColumns(
            {
                "_from": F.when(inside & F.col("_kid").isNull(), F.shiftleft(F.col("_cur") + 1, 6 * k) - 1).otherwise(F.col("_from")),
                "_cur": F.when(inside, F.col("_cur") * FANOUT + F.col("_kid")).otherwise(F.col("_cur")),
                "_lvl": F.when(inside, F.lit(k - 1)).otherwise(F.col("_lvl")),
            }
        ).drop(*step_columns, "_node", "_salt", "_kid")
    return q


def first_touch(queries: DataFrame, bars: DataFrame, *, by: Sequence[str] = ("symbol",), up: str = "up", down: str = "down", out: str = "touch_index") -> DataFrame:
    """Index of the first later bar with ``high >= up`` or ``low <= down``, however far away.

    A query climbs the levels of groups while its group holds no touch and then descends, so it meets one group per
    level; no pair of rows is ever enumerated.  A group of a higher level covers many bars and would get all their
    queries: each level above the first is dealt out in salted copies, one per 64 bars that a group covers (up to
    ``SALTS``), and a query takes one of them.  So no key has many more than 64 x 64 queries, also not in a single long series.
    """
    q = _climb(
        queries, extreme_levels(bars, by), by=by, start=INDEX, salt_by=[INDEX, up, down],
        child=lambda k, after: _first_child(F.col(up), F.col(down), after),
        step=lambda k: _first_step(F.col(up), F.col(down)),
        step_columns=["_highs", "_lows"],
    )
    return q.withColumn(out, F.when(F.col("_lvl") == 0, F.col("_cur"))).drop("_cur", "_lvl", "_from")


def _front(points: str, better: str) -> str:
    """Of points in order the ones whose ``y`` is better than all before; above ``FRONT_STEPS`` a cover of them by that many corners."""
    kept = f"aggregate({points}, cast(array() AS array<struct<x: double, y: double>>), (s, p) -> CASE WHEN size(s) = 0 OR p.y {better} element_at(s, -1).y THEN array_append(s, p) ELSE s END)"
    n, m = "size(f)", FRONT_STEPS
    corners = f"transform(sequence(0, {m - 1}), g -> struct(f[CAST(g * {n} DIV {m} AS INT)].x AS x, f[CAST((g + 1) * {n} DIV {m} - 1 AS INT)].y AS y))"
    return f"transform(array({kept}), f -> CASE WHEN {n} <= {m} THEN f ELSE {corners} END)[0]"


def one_sided_levels(bars: DataFrame, by: Sequence[str] = ("symbol",)) -> list[DataFrame]:
    """Groups of 64 bars, 64 groups, and so on, that tell whether a bar inside reaches exactly one of two levels.

    ``high >= up`` and ``low > down`` holds for a bar of a group if it holds for one of its bars that no other one exceeds
    in both prices (``rise``); ``low <= down`` and ``high < up`` likewise for the lowest ones (``fall``).
    A child is kept with both fronts.  A front is cut down to ``FRONT_STEPS`` corners that cover it: it may then promise a
    bar that is not there, but hides none.  Groups of 64 bars have whole fronts.
    """
    top = bars.agg(F.max(INDEX)).first()[0] or 0
    child, levels = bars.select(*by, F.col(INDEX).alias("_at"), F.col("high").cast("double"), F.col("low").cast("double")), []
    # An unknown price reaches no level.
    rise = "transform(filter(_kids, b -> b.high IS NOT NULL), b -> struct(b.high AS x, coalesce(b.low, double('NaN')) AS y))"
    fall = "transform(filter(_kids, b -> b.low IS NOT NULL), b -> struct(b.low AS x, coalesce(b.high, double('-Infinity')) AS y))"
    while not levels or top >> (6 * len(levels)):
        node = child.withColumn("_node", F.shiftright("_at", 6)).groupBy(*by, "_node").agg(
            F.array_sort(F.collect_list(F.struct((F.col("_at") % FANOUT).alias("k"), *child.columns[len(by) + 1 :]))).alias("_kids")
        )
        node = node.withColumns({"rise": F.expr(_front(f"sort_array({rise}, false)", ">")), "fall": F.expr(_front(f"sort_array({fall}, true)", "<"))})
        levels.append(stage(node))
        child = levels[-1].select(*by, F.col("_node").alias("_at"), "rise", "fall")
        rise, fall = "flatten(transform(_kids, b -> b.rise))", "flatten(transform(_kids, b -> b.fall))"
    return levels


def first_one_sided(queries: DataFrame, bars: DataFrame, *, by: Sequence[str] = ("symbol",), up: str = "up", down: str = "down", out: str = "touch_index") -> DataFrame:
    """Index of the first later bar that reaches exactly one of ``up`` (by its high) and ``down`` (by its low).

    Climbs ``one_sided_levels`` as ``first_touch`` does its groups, so bars that reach both levels cost nothing, however
    many follow each other.  A query that a cut-down front has misled goes on behind that group.
    """
    levels, columns, done = one_sided_levels(bars, by), [*queries.columns, out], []
    u, d = F.col(up), F.col(down)

    def first_kid(k: int, after: Column) -> Column:
        if k:
            hit = lambda x: F.exists(x["rise"], lambda p: (p["x"] >= u) & (p["y"] > d)) | F.exists(x["fall"], lambda p: (p["x"] <= d) & (p["y"] < u))
        else:
            hit = lambda x: F.coalesce(x["high"] >= u, F.lit(False)) != F.coalesce(x["low"] <= d, F.lit(False))
        return F.try_element_at(F.transform(F.filter("_kids", lambda x: (x["k"] > after) & hit(x)), lambda x: x["k"]), F.lit(1))

    asked = queries.withColumn("_start", F.col(INDEX))
    while True:
        met = _climb(
            asked, levels, by=by, start="_start", salt_by=[INDEX, up, down],
            child=first_kid, step=lambda k: first_kid(k, F.lit(-1)), step_columns=["_kids"],
        )
        met = stage(met.withColumn(out, F.when(F.col("_lvl") == 0, F.col("_cur"))).select(*columns, "_from"))
        done.append(met.where("_from IS NULL").select(*columns))
        misled = met.where("_from IS NOT NULL")
        if (len(levels) < 3 and FRONT_STEPS >= FANOUT) or misled.isEmpty():
            return reduce(DataFrame.unionByName, done)
        asked = misled.drop(out).withColumnRenamed("_from", "_start")


def candidate_exits(
    bars: DataFrame,
    *,
    tp: Column,
    sl: Column,
    same_bar_rule: str = "conservative_sl",
    signal: str = "signal",
    by: Sequence[str] = ("symbol",),
    ts: str = "ts",
) -> DataFrame:
    """Exit bar, price and reason of a trade opened at every signal's close.

    ``bars`` is an indexed, stored bar table.  A trade that never touches its
    levels ends at the close of the series' last bar.  A rule that names neither
    level keeps a trade open over bars that reach both: it ends at the first bar
    that reaches one of them only.
    """
    same_bar_rule = same_bar_rule.lower()
    long = F.col(signal) > 0
    opened = bars.where(F.col(signal) != 0).select(
        *by,
        INDEX,
        F.col(ts).alias("entry_ts"),
        F.col("close").alias("entry_price"),
        F.col(signal).cast("int").alias("direction"),
        F.when(long, F.col("close") + tp).otherwise(F.col("close") + sl).alias("up"),
        F.when(long, F.col("close") - sl).otherwise(F.col("close") - tp).alias("down"),
    )
    search = first_touch if same_bar_rule in (*TP_FIRST, *SL_FIRST) else first_one_sided
    touched = search(opened, bars, by=by)
    last = bars.groupBy(*by).agg(F.max(INDEX).alias("_last"), F.max_by("close", INDEX).alias("_last_close"), F.max(ts).alias("_last_ts"))
    hit = bars.select(*by, F.col(INDEX).alias("_hit"), F.col(ts).alias("_hit_ts"), "high", "low")
    # A trade without a touch looks up a negative bar: no match, and evenly spread.
    found = touched.withColumn("_hit", F.coalesce("touch_index", -1 - F.col(INDEX)))
    joined = found.join(hit, [*by, "_hit"], "left").join(last, list(by))
    open_end = F.col("touch_index").isNull()
    upper, lower = F.col("high") >= F.col("up"), F.col("low") <= F.col("down")
    rising = F.col("direction") > 0
    tp_hit = F.when(rising, upper).otherwise(lower)
    sl_hit = F.when(rising, lower).otherwise(upper)
    won = tp_hit if same_bar_rule in TP_FIRST else tp_hit & ~sl_hit
    target, stop = F.when(rising, F.col("up")).otherwise(F.col("down")), F.when(rising, F.col("down")).otherwise(F.col("up"))
    return joined.select(
        *by,
        F.col(INDEX).alias("entry_index"),
        "entry_ts",
        "entry_price",
        "direction",
        target.alias("take_profit_price"),
        stop.alias("stop_loss_price"),
        F.when(open_end, F.col("_last")).otherwise(F.col("touch_index")).alias("exit_index"),
        F.when(open_end, F.col("_last_ts")).otherwise(F.col("_hit_ts")).alias("exit_ts"),
        F.when(open_end, F.col("_last_close")).when(won, target).otherwise(stop).alias("exit_price"),
        F.when(open_end, "end_of_data").when(won, "take_profit").otherwise("stop_loss").alias("exit_reason"),
    )


# ------------------------------------------------------------------ non-overlapping trades


def _followed(links: DataFrame, keys: Sequence[str], block_rows: int) -> DataFrame:
    """Per block its first candidate and, for every candidate in order, where its links leave the block.

    ``_links`` and ``_jumps`` are places relative to the first candidate; a place
    behind the last one is outside.  Following doubles its reach at each step.
    """
    packed = links.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_c", "_next"))).alias("_rows"))
    out = packed.select(
        *keys,
        F.expr("_rows[0]._c").alias("_first"),
        F.expr("transform(_rows, x -> CAST(x._next - _rows[0]._c AS INT))").alias("_links"),
    ).withColumn("_jumps", F.col("_links"))
    for _ in range(max(1, (block_rows - 1).bit_length())):
        out = out.withColumn("_jumps", F.expr("transform(_jumps, x -> CASE WHEN x < size(_jumps) THEN _jumps[x] ELSE x END)"))
    return out


def non_overlapping(candidates: DataFrame, *, by: Sequence[str] = ("symbol",), block_rows: int = CHAIN_ROWS) -> DataFrame:
    """Add ``accepted``: trades taken when a new one may only start after the last one's exit bar.

    The rule is sequential.  Each candidate links to the first candidate after
    its exit; links are followed inside blocks of bounded size in parallel, and
    only the links between blocks are chained, by doubling their reach until
    nothing new is found.
    """
    numbered = stage(with_row_index(stage(candidates), by, ["entry_index"], [F.shiftright("entry_index", 12)], index="_c"))
    # First candidate behind an exit: number of candidates entered up to the exit bar.
    exits = numbered.select(*by, F.col("exit_index").alias("_bar"), F.lit(0).alias("_is"))
    marks = numbered.select(*by, F.col("entry_index").alias("_bar"), F.lit(1).alias("_is"))
    per_bar = exits.unionByName(marks).groupBy(*by, "_bar").agg(F.sum("_is").alias("_started"))
    placed = per_bar.withColumnRenamed("_bar", INDEX)
    upto = running_sum(placed, {"_next": "_started"}, by=by).select(*by, F.col(INDEX).alias("exit_index"), F.col("_next").cast("long").alias("_next"))
    linked = numbered.join(upto, [*by, "exit_index"]).withColumn("_block", F.floor(F.col("_c") / block_rows).cast("long"))
    linked = stage(linked)

    keys = [*by, "_block"]
    blocks = stage(_followed(linked.select(*by, "_block", "_c", "_next"), keys, block_rows))
    jumps = blocks.select(*keys, "_first", F.posexplode("_jumps").alias("_at", "_to")).select(
        *by, "_block", (F.col("_first") + F.col("_at")).cast("long").alias("_c"), (F.col("_first") + F.col("_to")).cast("long").alias("_jump")
    )
    jumps = stage(jumps)

    # Chain of block entries: starts at candidate 0, continues at jump targets.
    targets = jumps.select(*by, F.col("_jump").alias("_c")).distinct()
    nodes = stage(jumps.join(targets.unionByName(jumps.where("_c = 0").select(*by, "_c")).distinct(), [*by, "_c"]).select(*by, "_c", "_jump"))
    reached = nodes.where("_c = 0").select(*by, "_c")
    known, hop, everything = reached.count(), nodes, nodes.count()
    while known < everything:
        further = reached.join(hop, [*by, "_c"]).select(*by, F.col("_jump").alias("_c")).join(nodes.select(*by, "_c"), [*by, "_c"])
        grown = stage(reached.unionByName(further).distinct())
        size = grown.count()
        reached = grown
        if size == known:
            break
        known = size
        far = hop.select(*by, F.col("_c").alias("_jump"), F.col("_jump").alias("_to"))
        hop = stage(hop.join(far, [*by, "_jump"]).select(*by, "_c", F.col("_to").alias("_jump")))

    entries = reached.withColumn("_block", F.floor(F.col("_c") / block_rows).cast("long")).groupBy(*keys).agg(F.min("_c").alias("_entry"))
    path = (
        "aggregate(sequence(1, size(_links)), array(CAST(_entry - _first AS INT)), "
        "(p, z) -> CASE WHEN _links[element_at(p, -1)] < size(_links) THEN array_append(p, _links[element_at(p, -1)]) ELSE p END, "
        "p -> array_distinct(p))"
    )
    met = blocks.join(entries, keys).select(*by, "_first", F.explode(F.expr(path)).alias("_at"))
    met = met.select(*by, (F.col("_first") + F.col("_at")).cast("long").alias("_c"), F.lit(True).alias("_met"))
    return linked.join(met, [*by, "_c"], "left").withColumn("accepted", F.coalesce("_met", F.lit(False))).drop("_c", "_next", "_block", "_met")


# ------------------------------------------------------------------ ledger and equity


def ledger(trades: DataFrame, *, quantity: Column, point: Column, tick: Column, commission: float = 0.001, slippage: float = 0.0005, double_count: bool = False) -> DataFrame:
    """Fills, costs and profit of accepted trades."""
    made = trade_results(
        quantity=quantity, direction=F.col("direction"), entry=F.col("entry_price"), exit=F.col("exit_price"), point=point, tick=tick,
        commission=commission, slippage=slippage, double_count=double_count,
    )
    return trades.withColumn("quantity", quantity).withColumns(made)


def equity_curve(bars: DataFrame, trades: DataFrame, *, initial: float = 100_000.0, by: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    """Realised equity per bar with running peak, drawdown and bar returns."""
    booked = trades.groupBy(*by, F.col("exit_index").alias(INDEX)).agg(F.sum("net_pnl").alias("_pnl"))
    path = bars.select(*by, ts, INDEX).join(booked, [*by, INDEX], "left").withColumn("_pnl", F.coalesce("_pnl", F.lit(0.0)))
    valued = running_sum(path, {"_cum": "_pnl"}, by=by).withColumn("portfolio_value", F.lit(initial) + F.col("_cum"))
    return with_drawdown(valued.drop("_cum", "_pnl"), "portfolio_value", floor=initial, by=by)


def with_drawdown(path: DataFrame, value: str, *, floor: float, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Running peak (never below ``floor``), drawdown share and change of ``value``."""
    peaked = running_sum(path, {}, by=by, maximum={"peak": value})
    peaked = peaked.withColumn("peak", F.greatest("peak", F.lit(floor)))
    peaked = peaked.withColumn("drawdown", (F.col("peak") - F.col(value)) / F.greatest(F.col("peak"), F.lit(1e-12)))
    return over_series(
        peaked, lambda df, w: df.withColumn("returns", F.coalesce(ratio(F.col(value), F.lag(value).over(w)) - 1.0, F.lit(0.0))), by=by, back=1
    )


def drawdown_gate(equity: DataFrame, *, limit: float = 0.15) -> DataFrame:
    """Whether new trades are allowed at each point of an equity curve."""
    return equity.withColumn("can_trade", F.col("drawdown") < limit)


def performance(equity: DataFrame, trades: DataFrame, *, initial: float = 100_000.0, periods_per_year: float = 252.0, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Return, risk and trade statistics per series (percentages where named so)."""
    r = F.col("returns")
    curve = equity.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(r).alias("_mean"), F.stddev_samp(r).alias("_sd"),
        F.stddev_samp(F.when(r < 0, r)).alias("_neg"), F.max("drawdown").alias("_dd"),
    )
    p = F.col("net_pnl")
    book = trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_trades"), F.count_if(p > 0).alias("_wins"), F.sum(p).alias("_pnl"),
        F.sum(F.when(p > 0, p).otherwise(0.0)).alias("_profit"), F.sum(F.when(p < 0, -p).otherwise(0.0)).alias("_loss"),
        F.avg(F.when(p > 0, p)).alias("avg_win"), F.avg(F.when(p < 0, p)).alias("avg_loss"),
    )
    total = F.coalesce(F.col("_pnl"), F.lit(0.0)) / initial
    annual = F.pow(1.0 + total, F.lit(periods_per_year) / F.col("_n")) - 1.0
    year = F.sqrt(F.lit(periods_per_year))
    zero = F.lit(0.0)
    return curve.join(book, list(by), "left").select(
        *by,
        (100.0 * total).alias("total_return"),
        (100.0 * annual).alias("annual_return"),
        F.when(F.col("_sd") > 0, F.col("_mean") / F.col("_sd") * year).otherwise(zero).alias("sharpe_ratio"),
        F.when(F.col("_neg") > 0, F.col("_mean") * periods_per_year / (F.col("_neg") * year)).otherwise(zero).alias("sortino_ratio"),
        (100.0 * F.col("_dd")).alias("max_drawdown"),
        F.when(F.col("_dd") > 0, annual / F.col("_dd")).otherwise(zero).alias("calmar_ratio"),
        F.coalesce("total_trades", F.lit(0)).alias("total_trades"),
        F.coalesce(100.0 * F.col("_wins") / F.col("total_trades"), zero).alias("win_rate"),
        F.when(F.col("_loss") > 0, F.col("_profit") / F.col("_loss")).otherwise(F.lit(float("inf"))).alias("profit_factor"),
        F.coalesce("avg_win", zero).alias("avg_win"),
        F.coalesce("avg_loss", zero).alias("avg_loss"),
        (F.lit(initial) + F.coalesce("_pnl", zero)).alias("final_portfolio_value"),
    )


def reconcile(equity: DataFrame, trades: DataFrame, *, initial: float = 100_000.0, by: Sequence[str] = ("symbol",), tolerance: float = 1e-6) -> DataFrame:
    """Initial capital plus booked profit against the last equity value."""
    booked = trades.groupBy(*by).agg(F.sum("net_pnl").alias("_pnl"))
    final = equity.groupBy(*by).agg(F.max_by("portfolio_value", INDEX).alias("final_value"))
    expected = F.lit(initial) + F.coalesce("_pnl", F.lit(0.0))
    return final.join(booked, list(by), "left").select(*by, expected.alias("expected_value"), "final_value", (F.abs(expected - F.col("final_value")) <= tolerance).cast("int").alias("reconciled"))


def trade_counters(bars: DataFrame, marked: DataFrame, *, signal: str = "signal", by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Signals received, accepted and rejected entries, exits by reason."""
    received = bars.groupBy(*by).agg(F.count_if(F.col(signal) != 0).alias("signals_received"))
    ok = F.col("accepted")
    counted = marked.groupBy(*by).agg(
        F.count_if(ok).alias("entries_accepted"),
        F.count_if(~ok).alias("entries_rejected"),
        *[F.count_if(ok & (F.col("exit_reason") == r)).alias(f"{r}_exits") for r in ("take_profit", "stop_loss", "end_of_data")],
    )
    return received.join(counted, list(by), "left").na.fill(0)


# ------------------------------------------------------------------ strategy metrics

THRESHOLDS = (0.5, 0.6, 0.7, 0.8)


def threshold_grid(outcomes: DataFrame, *, score: str, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Each outcome once per threshold (NULL is the unfiltered control) with ``selected``."""
    grid = F.array(
        F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("selected")),
        *[F.struct(F.lit(float(t)).alias("threshold"), (F.col(score) >= t).alias("selected")) for t in thresholds],
    )
    return outcomes.withColumn("_g", F.explode(grid)).select("*", "_g.threshold", "_g.selected").drop("_g")


def strategy_metrics(grid: DataFrame, *, keys: Sequence[str], order: Sequence[str], cells: Sequence[Column]) -> DataFrame:
    """Trade statistics per key from rule outcomes with a ``selected`` flag.

    Drawdown runs over 1 + the cumulative return.  An unselected row adds nothing to it and is only counted: of the
    copies that a grid of thresholds makes, the unselected ones never leave the task that reads them.  ``grid`` is read twice
    and should be made of stored rows.  A key without trades has zeros, and no profit factor.
    """
    from .tables import medians

    # A NULL key (the control) must still match itself in joins.
    named = grid.withColumn("_series", F.to_json(F.struct(*keys)))
    signals = named.groupBy("_series", *keys).agg(F.count(F.lit(1)).alias("signals"))
    r = F.col("terminal_return")
    keyed = stage(with_row_index(named.where("selected").drop(*keys), ["_series"], list(order), cells))
    equity = running_sum(keyed, {"_cum": "terminal_return"}, by=["_series"]).withColumn("_eq", 1.0 + F.col("_cum"))
    peaked = running_sum(equity, {}, by=["_series"], maximum={"_peak": "_eq"})
    peak = F.greatest(F.col("_peak"), F.lit(1.0))
    draw = peaked.groupBy("_series").agg(F.max((peak - F.col("_eq")) / peak).alias("maximum_drawdown"))
    mids = medians(keyed, ["terminal_return"], ["_series"])
    share = lambda cond: 100.0 * F.avg(cond.cast("double"))
    sums = {
        "trades": F.count(F.lit(1)),
        "buy_trades": F.count_if(F.col("direction") == 1),
        "sell_trades": F.count_if(F.col("direction") == -1),
        "win_rate": F.avg((r > 0).cast("double")),
        "average_return": F.avg(r),
        "cumulative_gross_return": F.sum(r),
        "average_mfe": F.avg("mfe"),
        "average_mae": F.avg("mae"),
        "reached_plus_1atr_pct": share(F.col("reached_plus_1atr")),
        "reached_minus_1atr_pct": share(F.col("reached_minus_1atr")),
        **{f"first_passage_{n}_pct": share(F.col("first_passage") == v) for v, n in (("FAVORABLE", "favorable"), ("ADVERSE", "adverse"), ("SAME_BAR_TIE", "tie"))},
    }
    factor = F.sum(F.when(r > 0, r).otherwise(0.0)) / F.nullif(F.sum(F.when(r < 0, -r).otherwise(0.0)), F.lit(0.0))
    stats = keyed.groupBy("_series").agg(*[v.alias(k) for k, v in sums.items()], factor.alias("profit_factor"))
    joined = signals.join(stats, "_series", "left").join(draw, "_series", "left").join(mids.withColumnRenamed("terminal_return_median", "median_return"), "_series", "left")
    filled = joined.withColumns({k: F.coalesce(k, F.lit(0)) for k in (*sums, "maximum_drawdown", "median_return")})
    return filled.withColumn("trade_frequency", F.col("trades") / F.col("signals")).drop("_series")


def control_differences(metrics: DataFrame, names: Sequence[str], *, keys: Sequence[str]) -> DataFrame:
    """Treatment minus unfiltered control for every threshold; NULL stays NULL."""
    control = metrics.where(F.col("threshold").isNull()).select(*keys, *[F.col(n).alias(f"_{n}") for n in names])
    treated = metrics.where(F.col("threshold").isNotNull()).join(control, list(keys))
    return treated.select(*keys, "threshold", *[(F.col(n) - F.col(f"_{n}")).alias(f"{n}_difference") for n in names])


def filter_verdict(metrics: DataFrame, p_values: DataFrame, *, rules_key: str = "rule", split: str = "split") -> DataFrame:
    """Verdict on an activity filter from strategy metrics and permutation p-values.

    ``metrics`` has the unfiltered control (threshold NULL) and treatments;
    ``p_values`` is (split, rule, threshold, random_average_return,
    random_win_rate, one_sided_p_value).
    """
    keys = [split, rules_key]
    control = metrics.where(F.col("threshold").isNull()).select(
        *keys, F.col("average_return").alias("_avg"), F.col("win_rate").alias("_win"), F.col("profit_factor").alias("_pf")
    )
    treated = metrics.where(F.col("threshold").isNotNull()).join(control, keys).join(p_values, [*keys, "threshold"])
    better = (
        (F.col("average_return") > F.greatest("_avg", "random_average_return"))
        & (F.col("win_rate") > F.greatest("_win", "random_win_rate"))
        & (F.col("one_sided_p_value") <= 0.05)
    )
    support = treated.groupBy(rules_key).agg(
        F.count_if(better & (F.col(split) == "validation")).alias("validation_support"),
        F.count_if(better & (F.col(split) == "train")).alias("train_support"),
        F.max(F.when(F.col(split) == "validation", (F.col("_avg") > 0) & (F.col("_pf") > 1))).alias("unfiltered_edge"),
    )
    robust = (F.col("validation_support") >= 3) & (F.col("train_support") >= 2)
    found = support.agg(
        F.collect_set(F.when(robust, F.col(rules_key))).alias("robust_rules"),
        F.collect_set(F.when(F.col("validation_support") >= 1, F.col(rules_key))).alias("weak_rules"),
        F.collect_set(F.when(F.col("unfiltered_edge"), F.col(rules_key))).alias("edge_rules"),
    )
    return found.select(
        F.when(F.size("robust_rules") > 0, "ACTIVITY_FILTER_HAS_ECONOMIC_VALUE")
        .when(F.size("weak_rules") > 0, "ACTIVITY_FILTER_WEAK_EVIDENCE")
        .when(F.size("edge_rules") > 0, "DIRECTIONAL_RULE_DOMINATES")
        .otherwise("ACTIVITY_FILTER_NO_ECONOMIC_VALUE")
        .alias("verdict"),
        *[F.array_join(F.array_sort(c), ",").alias(c) for c in ("robust_rules", "weak_rules", "edge_rules")],
    )


def confirmation_verdict(metrics: DataFrame, p_values: DataFrame, *, minimum_trades: int = 1000) -> DataFrame:
    """Verdict on a frozen filter from confirmation rows (one control, some thresholds)."""
    control = metrics.where(F.col("threshold").isNull()).select(
        F.lit(1).alias("_one"), F.col("average_return").alias("_avg"), F.col("win_rate").alias("_win"), F.col("profit_factor").alias("_pf")
    )
    treated = metrics.where(F.col("threshold").isNotNull()).withColumn("_one", F.lit(1)).join(control, "_one").join(p_values, "threshold")
    ok = (
        (F.col("average_return") > F.col("_avg")) & (F.col("win_rate") > F.col("_win"))
        & (F.col("profit_factor") > F.col("_pf")) & (F.col("one_sided_p_value") <= 0.05)
    )
    found = treated.agg(
        F.count(F.lit(1)).alias("thresholds"), F.count_if(F.coalesce(ok, F.lit(False))).alias("supported"), F.min("trades").alias("fewest")
    )
    return found.select(
        F.when(F.col("fewest") < minimum_trades, "INCONCLUSIVE_CONFIRMATION")
        .when(F.col("supported") == F.col("thresholds"), "CONFIRMED_ACTIVITY_FILTER")
        .otherwise("FAILED_CONFIRMATION")
        .alias("verdict"),
        "thresholds",
        "supported",
    )
