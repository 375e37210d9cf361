"""Scores of trades as column formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def omega(m5: Column, m15: Column, context: Column) -> Column:
    """Quality of a setup from three scores."""
    return sigmoid(0.90 * m5 + 0.85 * m15 + 0.80 * context)


def kelly(win_rate: Column, reward_risk: Column) -> Column:
    """Share of the capital for a win rate and a ratio of mean win to mean loss, from 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (win_rate * reward_risk - (1 - win_rate)) / reward_risk))


def certainty_equivalent(action: int, share: Column, mu: Column, cost: float, drawdown: float = 0.0, rho: float = 0.5) -> Column:
    """What an action (-1, 0, 1) is worth: its edge less friction and the penalty of the present drawdown."""
    return action * share * mu - abs(action) * share * cost - rho * drawdown


def actions(mu: Column, quality: Column, kelly: float, most: float, cost: float) -> dict[str, Column]:
    """buy, sell: values of the two actions; action: the best of sell, hold and buy, the first on a tie but hold before either."""
    share = min(most, kelly) * quality
    sell, buy = certainty_equivalent(-1, share, mu, cost), certainty_equivalent(1, share, mu, cost)
    action = F.when((sell > 0) & (sell >= buy), -1).when((buy > 0) & (buy > sell), 1).otherwise(0)
    return {"buy": buy, "sell": sell, "action": action}


def execution(side: Column, entry: Column, stop: Column, target: Column, bid: Column, ask: Column, spread: Column, atr: Column) -> dict[str, Column]:
    """filled, reward_risk, penalty, cost of a market order: half the spread, or 0.12 of the range, slips."""
    tiny = F.lit(1e-9)
    market = F.when(side == 1, ask).otherwise(bid)
    slip = F.greatest(spread * 0.5, atr * 0.12, F.lit(0.0))
    filled = market + side * slip
    planned, real = F.abs(entry - stop), F.abs(filled - stop)
    worse = F.greatest(F.lit(0.0), (real - planned) / F.greatest(planned, tiny))
    penalty = spread / F.greatest(planned, tiny) * 0.45 + slip / F.greatest(planned, tiny) * 0.35 + worse * 0.15
    return {
        "filled": filled,
        "reward_risk": F.abs(target - filled) / F.greatest(real, tiny),
        "penalty": penalty,
        "cost": (spread + slip) / F.greatest(F.abs(market), tiny),
    }
