"""Bar backtests over a grid of parameters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def simulate(high: np.ndarray, low: np.ndarray, close: np.ndarray, fast: int, slow: int, stop: float, target: float) -> np.ndarray:
    """Returns of trades on crossings of two means of the close, one position at a time.

    A trade opens at the close of the bar on which the fast mean crosses the slow one, in that direction,
    and ends at the stop or the target (shares of the entry; the stop comes first within a bar), or at
    the last close.
    """
    if len(close) <= slow:
        return np.zeros(0)
    total = np.concatenate([[0.0], np.cumsum(close)])
    mean = lambda n: (total[n:] - total[:-n]) / n
    gap = np.sign(mean(fast)[slow - fast :] - mean(slow))
    out, side, entry = [], 0, 0.0
    for k in range(1, len(gap)):
        i = k + slow - 1
        if side:
            worst, best = (low[i], high[i]) if side > 0 else (high[i], low[i])
            if side * (worst - entry) <= -stop * entry:
                out.append(-stop)
                side = 0
            elif side * (best - entry) >= target * entry:
                out.append(target)
                side = 0
        if not side and gap[k] and gap[k] != gap[k - 1]:
            side, entry = int(gap[k]), close[i]
    if side and entry:
        out.append(side * (close[-1] - entry) / entry)
    return np.array(out)


def grid_backtest(bars: DataFrame, grid: DataFrame, per_block: int = 256) -> DataFrame:
    """symbol, param, trades, wins, net, profit_factor (999 with no loss), max_drawdown, sharpe of every pair.

    grid: param, fast, slow, stop, target - a fixed table of the caller's, of thousands of rows at most. A
    symbol's bars move once for each block of per_block parameter sets, and each group runs its sets over
    them in time order.
    """
    sets = grid.orderBy("param").toPandas().to_dict("records")
    blocks = max(1, -(-len(sets) // per_block))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts")
        series = [rows[c].to_numpy(float) for c in ("high", "low", "close")]
        out = []
        for p in sets[key[1] * per_block : (key[1] + 1) * per_block]:
            r = simulate(*series, int(p["fast"]), int(p["slow"]), p["stop"], p["target"])
            curve = np.concatenate([[0.0], np.cumsum(r)])
            won, lost = r[r > 0].sum(), -r[r < 0].sum()
            factor = won / lost if lost > 0 else 999.0 if won > 0 else 0.0
            spread = r.std() if len(r) else 0.0
            drawdown, sharpe = (np.maximum.accumulate(curve) - curve).max(), r.mean() / spread if spread > 0 else 0.0
            out.append((key[0], p["param"], len(r), int((r > 0).sum()), r.sum(), factor, drawdown, sharpe))
        return pd.DataFrame(out, columns=["symbol", "param", "trades", "wins", "net", "profit_factor", "max_drawdown", "sharpe"])

    shape = "symbol string, param string, trades long, wins long, net double, profit_factor double, max_drawdown double, sharpe double"
    held = bars.select("symbol", "ts", "high", "low", "close", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    return held.groupBy("symbol", "block").applyInPandas(run, shape)


def best(results: DataFrame, least: int = 10, top: int = 3) -> DataFrame:
    """The best parameter sets of each symbol: those with enough trades and a gain first, by sharpe, then net."""
    from pyspark.sql import Window

    good = (F.col("trades") >= least) & (F.col("net") > 0)
    by = Window.partitionBy("symbol").orderBy(F.desc(good), F.desc("sharpe"), F.desc("net"), "param")
    return results.withColumn("place", F.row_number().over(by)).where(F.col("place") <= top)
