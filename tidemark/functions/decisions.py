"""Trading decisions out of many judgements, as column expressions: order flow, both sides' scores, and their fusion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.candles import clamp
from tidemark.functions.text import let

# Weights of the parts of the order flow, bounds of its flags.
FLOW = {"delta_bias": 0.25, "cvd_slope": 0.25, "imbalance": 0.20, "profile_location": 0.10, "vwap_alignment": 0.15}
ABSORPTION, OBSTACLE, CLEAR = 0.10, 0.20, 0.35

# What a strategy that does not trade counts, by the step at which it failed.
FAILED = {"h1_direction": -0.80, "m30_setup": -0.65, "m15_setup": -0.50, "m15_trigger": -0.35, "m5_trigger": -0.20}
FAILED_ELSE = -0.55

# Weight of each judgement where it is there and where not, penalties, bounds.
WEIGHTS = {"edge": (0.22, 0.05), "quant": (0.20, 0.10), "flow": (0.12, 0.05), "regime": (0.10, 0.10), "alignment": (0.10, 0.10), "indicators": (0.16, 0.08), "strategy": (0.16, 0.16)}
CONFLUENCE, SPREAD, DRAWDOWN, RISK = 0.12, 0.07, 0.08, 0.07
LOWEST, HIGHEST = 0.52, 0.78


def flow_alignment(side: Column, flow: dict[str, Column], absorption: Column, obstacle: Column) -> Column:
    """struct(alignment, supports, conflicts) of an order flow for a side (1 long, -1 short); zero for a null side or flow."""
    leaning = sum((F.coalesce(flow[k], F.lit(0.0)) * w for k, w in FLOW.items()), F.lit(0.0)) * side
    there = side.isNotNull() & F.coalesce(*flow.values()).isNotNull()
    whole = F.when(there, clamp(leaning + F.coalesce(absorption, F.lit(0.0)) * ABSORPTION - F.coalesce(obstacle, F.lit(0.0)) * OBSTACLE)).otherwise(0.0)
    return let(whole, lambda a: F.struct(a.alias("alignment"), (a >= CLEAR).alias("supports"), (a <= -CLEAR).alias("conflicts")))


def side_scores(long: Column, short: Column, multiple: Column, preferred: Column, continuation: Column, reversion: Column, confidence: Column) -> Column:
    """struct(long, short, edge): sums of both sides' parts, weighed by the regime's bias for the preferred side (1 or -1) and against it."""
    sure = F.greatest(confidence, F.lit(0.1))
    own = lambda parts, side: parts * F.when(preferred == side, continuation).otherwise(reversion) * sure + multiple * 0.25
    both = F.struct(own(long, 1).alias("long"), own(short, -1).alias("short"))
    return let(both, lambda b: F.struct(b["long"].alias("long"), b["short"].alias("short"), (b["long"] - b["short"]).alias("edge")))


def tradeable(edge: Column, multiple: Column, doubt: Column, threshold: Column, least_multiple: float, most_doubt: float, regime: Column) -> Column:
    """Whether the edge is worth a trade: in a tradable regime, with enough room, not too much doubt, and beyond the threshold."""
    return regime & (multiple >= least_multiple) & (doubt <= most_doubt) & (F.abs(edge) >= threshold)


def quant_part(omega: Column, action: Column, side: Column, trades: Column) -> Column:
    agrees = F.when((F.coalesce(side, F.lit(0)) == 0) | (action == 0), 0.0).when(action == side, 1.0).otherwise(-1.0)
    return clamp(0.75 * clamp(omega, 0.0) + 0.35 * agrees + F.when(trades, 0.35).otherwise(-0.15))


def strategy_part(trades: Column, failed: Column) -> Column:
    lost = F.lit(FAILED_ELSE)
    for step, value in FAILED.items():
        lost = F.when(failed == step, value).otherwise(lost)
    return F.when(trades, 1.0).otherwise(lost)


def fused(
    side: Column, trades: Column, failed: Column, probability: Column, quant: Column, flow: Column, regime: Column, alignment: Column, indicators: Column,
    spread: Column, drawdown: Column, risk: Column, threshold: float = 0.62, edge_threshold: float = 0.55, least_probability: float = 0.45,
) -> Column:
    """struct(action, score, confidence, threshold, confluence, support, conflict, blocked) of judgements from -1 to 1, each null if it is not there.

    probability is that of the edge model; spread, drawdown and risk are penalties from 0 to 1. A judgement
    weighs more the surer it is; weights are made to sum to one. Confluence is how far the judgements
    agree, and moves the threshold. A trade whose probability is too low or whose drawdown is at its end is blocked.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    given = {"edge": probability, "quant": quant, "flow": flow, "regime": F.lit(0.0), "alignment": F.lit(0.0), "indicators": indicators, "strategy": F.lit(0.0)}
    values = {
        "edge": F.when(probability.isNotNull(), clamp((probability - 0.5) * 2)).otherwise(0.0), "quant": zero(quant), "flow": zero(flow), "regime": zero(regime),
        "alignment": zero(alignment), "indicators": zero(indicators), "strategy": strategy_part(trades, failed),
    }
    there = {k: F.when(given[k].isNotNull(), WEIGHTS[k][0]).otherwise(WEIGHTS[k][1]) for k in values}
    margin = F.when(probability.isNotNull(), clamp((probability - edge_threshold) / 0.20)).otherwise(0.0)
    listed = F.array(*[F.struct(values[k].alias("v"), (there[k] * (0.80 + 0.50 * F.abs(values[k]))).alias("w")) for k in values])
    signals = F.array(*[values[k] for k in values if k != "edge"], margin)
    add = lambda xs, of: F.aggregate(xs, F.lit(0.0), lambda a, x: a + of(x))

    def weighed(p: Column) -> Column:
        up, down = F.size(F.filter(p["signals"], lambda v: v >= 0.25)), F.size(F.filter(p["signals"], lambda v: v <= -0.25))
        balance = (up - down) * 4 / 10.0 / F.greatest(up + down, F.lit(1))  # four tenths of it, rounded once
        agree = clamp(0.60 * add(p["signals"], lambda v: clamp(v)) / len(values) + balance)
        mean = add(p["listed"], lambda x: x["v"] * x["w"]) / add(p["listed"], lambda x: x["w"])
        return F.struct(up.alias("support"), down.alias("conflict"), agree.alias("confluence"), mean.alias("mean"))

    def decided(p: Column) -> Column:
        lower = F.when((p["support"] >= 5) & (p["confluence"] >= 0.45), -0.04).when((p["support"] >= 4) & (p["confluence"] >= 0.30), -0.02).otherwise(0.0)
        higher = F.when(p["conflict"] >= 2, 0.05).otherwise(0.0) + F.when((p["conflict"] >= 3) | (p["confluence"] <= -0.40), 0.08).otherwise(0.0)
        bar = clamp(threshold + lower + higher, LOWEST, HIGHEST)
        score = clamp(p["mean"] + CONFLUENCE * p["confluence"] - SPREAD * zero(spread) - DRAWDOWN * zero(drawdown) - RISK * zero(risk))
        blocked = trades & (F.coalesce(probability < least_probability, F.lit(False)) | F.coalesce(drawdown >= 0.95, F.lit(False)))
        sure = clamp((score + 1) / 2, 0.0)
        action = F.when(blocked | ~trades | (sure < bar), "WAIT").when(side == 1, "BUY").when(side == -1, "SELL").otherwise("WAIT")
        return F.struct(action.alias("action"), score.alias("score"), sure.alias("confidence"), bar.alias("threshold"), p["confluence"].alias("confluence"), p["support"].alias("support"), p["conflict"].alias("conflict"), blocked.alias("blocked"))

    return let(let(F.struct(listed.alias("listed"), signals.alias("signals")), weighed), decided)
