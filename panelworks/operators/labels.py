"""Forward outcomes of bars: average true range and triple barriers under three entry rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Barriers:
    target: float = 1.5  # true ranges above the entry
    stop: float = 1.0
    horizon: int = 5
    atr: int = 14
    stretch: float = 2.0  # a second, wider target with the same stop


def true_range(df: DataFrame) -> DataFrame:
    """Adds ``tr``: the widest of high-low and both gaps to the previous close; NULL on a symbol's first bar."""
    previous = F.lag("close").over(Window.partitionBy("symbol").orderBy("ts"))
    wide = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - previous), F.abs(F.col("low") - previous))
    return df.withColumn("tr", F.when(previous.isNotNull(), wide))


def average_true_range(df: DataFrame, n: int = 14) -> DataFrame:
    """Adds ``atr``: the mean of the last n true ranges, NULL while fewer are known.

    Ranges are summed as decimals of twelve places, so that the order of the sum cannot matter.
    """
    frame = Window.partitionBy("symbol").orderBy("ts").rowsBetween(1 - n, 0)
    total = F.sum(F.col("tr").cast("decimal(28,12)")).over(frame).cast("double")
    return true_range(df).withColumn("atr", F.when(F.count("tr").over(frame) == n, total / n))


def _first(tests: list[tuple[Column, Column | float]], otherwise: Column | float) -> Column:
    out = F
    for test, value in tests:
        out = out.when(F.coalesce(test, F.lit(False)), value)
    return out.otherwise(otherwise)


def barrier_labels(df: DataFrame, cfg: Barriers = Barriers()) -> DataFrame:
    """(symbol, ts, open, high, low, close, atr, ft_a, xr_a, ft_b, xr_b, ft_c, xr_c, gap1, days_tp, days_sl, mfe, mae, xr_s) of bars.

    a: entry at the close; b: at the next open; c: at the next open, later sessions filled at an open
    beyond a barrier. A session that touches both barriers counts as a stop. NULL for a symbol's last
    ``horizon`` bars, before the first full true range, and for symbols with too few bars.

    Beside version a: sessions until target and stop are first reached (NULL if they are not), the best
    and the worst excursion from the entry, and the return under the wider target (``xr_s``). Columns
    that a query does not ask for are pruned from the plan.
    """
    h = cfg.horizon
    order = Window.partitionBy("symbol").orderBy("ts")
    enough = F.count("*").over(Window.partitionBy("symbol")) > h + cfg.atr
    d = average_true_range(df, cfg.atr)
    steps = range(1, h + 1)
    d = d.withColumns({f"_{c}{k}": F.lead(name, k).over(order) for k in steps for c, name in (("o", "open"), ("h", "high"), ("l", "low"))} | {"_last": F.lead("close", h).over(order), "_enough": enough})
    d = d.withColumns({"_tp": F.lit(cfg.target) * F.col("atr") / F.col("close"), "_sl": F.lit(cfg.stop) * F.col("atr") / F.col("close")})
    tp, sl, last, close = F.col("_tp"), F.col("_sl"), F.col("_last"), F.col("close")
    known = F.col("_enough") & last.isNotNull() & F.col("atr").isNotNull() & (close > 0)
    up = lambda k, entry: F.col(f"_h{k}") / entry - 1 >= tp
    down = lambda k, entry: F.col(f"_l{k}") / entry - 1 <= -sl
    gap = lambda k, entry: F.col(f"_o{k}") / entry - 1
    out = {}
    for name, entry in (("a", close), ("b", F.col("_o1"))):
        ok = known if name == "a" else known & (entry > 0)
        touch = _first([x for k in steps for x in ((down(k, entry), -1.0), (up(k, entry), 1.0))], 0.0)
        out[f"ft_{name}"] = F.when(ok, touch)
        out[f"xr_{name}"] = F.when(ok, F.when(touch == 1, tp).when(touch == -1, -sl).otherwise(last / entry - 1))
    entry = F.col("_o1")
    events = [(down(1, entry), -1.0, -sl), (up(1, entry), 1.0, tp)]
    for k in range(2, h + 1):
        events += [(gap(k, entry) <= -sl, -1.0, gap(k, entry)), (gap(k, entry) >= tp, 1.0, gap(k, entry)), (down(k, entry), -1.0, -sl), (up(k, entry), 1.0, tp)]
    ok = known & (entry > 0)
    out["ft_c"] = F.when(ok, _first([(t, e) for t, e, _ in events], 0.0))
    out["xr_c"] = F.when(ok, _first([(t, r) for t, _, r in events], last / entry - 1))
    out["gap1"] = F.when(ok, entry / close - 1)
    wide = F.lit(cfg.stretch) * F.col("atr") / close
    stretched = [x for k in steps for x in ((down(k, close), -sl), (F.col(f"_h{k}") / close - 1 >= wide, wide))]
    furthest = lambda pick, c: (pick(*[F.col(f"_{c}{k}") for k in steps]) if h > 1 else F.col(f"_{c}1")) / close - 1
    beside = {"days_tp": _first([(up(k, close), k) for k in steps], None), "days_sl": _first([(down(k, close), k) for k in steps], None), "mfe": furthest(F.greatest, "h"), "mae": furthest(F.least, "l"), "xr_s": _first(stretched, last / close - 1)}
    out |= {k: F.when(known, v) for k, v in beside.items()}
    return d.select("symbol", "ts", "open", "high", "low", "close", "atr", *[v.alias(k) for k, v in out.items()])


def labels_for(df: DataFrame, keys: DataFrame, cfg: Barriers = Barriers()) -> DataFrame:
    """Labels of the wanted (ts, symbol) rows only: bars of other symbols are left out before the windows.

    Keys may repeat; keys without a bar give no row.
    """
    wanted = keys.select("ts", "symbol").distinct()
    return barrier_labels(df.join(wanted.select("symbol").distinct(), "symbol", "left_semi"), cfg).join(wanted, ["ts", "symbol"], "left_semi")


def barrier_labels_folded(df: DataFrame, cfg: Barriers = Barriers()) -> DataFrame:
    """(symbol, ts, ft_a): version a by a fold over the forward frame as an array; a second way to the same labels."""
    order = Window.partitionBy("symbol").orderBy("ts")
    frame = F.collect_list(F.struct("high", "low")).over(order.rowsBetween(1, cfg.horizon))
    enough = F.count("*").over(Window.partitionBy("symbol")) > cfg.horizon + cfg.atr
    d = average_true_range(df, cfg.atr).withColumn("_next", frame).withColumn("_enough", enough)
    reach = F.col("atr") / F.col("close")
    step = lambda acc, x: F.when(acc != 0, acc).when(x["low"] / F.col("close") - 1 <= -cfg.stop * reach, -1.0).when(x["high"] / F.col("close") - 1 >= cfg.target * reach, 1.0).otherwise(0.0)
    touch = F.aggregate("_next", F.lit(0.0), step)
    return d.select("symbol", "ts", F.when(F.col("_enough") & (F.size("_next") == cfg.horizon) & F.col("atr").isNotNull(), touch).alias("ft_a"))
