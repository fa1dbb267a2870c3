"""Alert text, incident records and language fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.functions.rounding import fixed_text

# --- fixed values: voices per language ---------------------------------------
LANGUAGES = [
    ("en", "English", "en-IN-NeerjaNeural"),
    ("hi", "Hindi", "hi-IN-SwaraNeural"),
    ("ta", "Tamil", "ta-IN-PallaviNeural"),
    ("te", "Telugu", "te-IN-ShrutiNeural"),
    ("bn", "Bengali", "bn-IN-TanishaaNeural"),
    ("mr", "Marathi", "mr-IN-AarohiNeural"),
    ("gu", "Gujarati", "gu-IN-DhwaniNeural"),
    ("kn", "Kannada", "kn-IN-SapnaNeural"),
]

# wording of the alerts; %s: amount, receiver, reason
BLOCK_TEXT = "{brand}: we stopped a payment of %s to %s because of this finding: %s. Please call your bank if you made it yourself."
SOURCE_REASON = "Source=scored feed"  # first reason of every incident
FLAG_TEXT = "{brand}: a payment of %s to %s is on hold until your bank has looked at this finding: %s."


def alert_text(
    verdict: str, amount: str, merchant: str, reason: str, brand: str = "Payment"
) -> Column:
    """Narration of a verdict; missing fields fall back to neutral defaults."""
    parts = [
        F.coalesce(F.col(amount).cast("string"), F.lit("0")),
        F.coalesce(F.col(merchant), F.lit("an unnamed receiver")),
        F.coalesce(F.col(reason), F.lit("unusual activity")),
    ]
    blocked = F.upper(F.coalesce(F.col(verdict), F.lit("FLAG"))) == "BLOCK"
    return F.when(
        blocked, F.format_string(BLOCK_TEXT.format(brand=brand), *parts)
    ).otherwise(F.format_string(FLAG_TEXT.format(brand=brand), *parts))


def incidents(scored: DataFrame) -> DataFrame:
    """Rows that need attention, with their three standard reasons."""
    return scored.where(F.col("verdict").isin("FLAG", "BLOCK")).withColumn(
        "reasons",
        F.array(
            F.lit(SOURCE_REASON),
            F.concat(F.lit("Category="), F.col("merchant_category")),
            F.concat(F.lit("Risk="), fixed_text(F.col("risk_score"), 2, "up")),
        ),
    )


def ist_time(ts: str) -> Column:
    """dd/MM/yyyy HH:mm:ss in Indian Standard Time, N/A when unknown."""
    local = F.date_format(F.from_utc_timestamp(ts, "Asia/Kolkata"), "dd/MM/yyyy HH:mm:ss")
    return F.coalesce(local, F.lit("N/A"))


def evidence_record(df: DataFrame) -> DataFrame:
    """Case reference, classification, action, local time and signal list per incident."""
    blocked = F.col("verdict") == "BLOCK"
    reason = [F.get("reasons", F.lit(i)) for i in range(3)]
    risk = F.col("risk_score")
    p, a, d = (
        F.coalesce(F.col(c), F.lit(0.0)) for c in ("lgbm_score", "anomaly_score", "graph_delta")
    )
    signals = F.array(
        F.coalesce(reason[0], F.lit("no first reason recorded")),
        F.coalesce(reason[1], F.lit("no second reason recorded")),
        F.coalesce(reason[2], F.lit("no third reason recorded")),
        F.concat(F.lit("graph: "), F.coalesce(F.col("graph_reason"), F.lit("n/a"))),
        F.format_string(
            "risk %s from model %s, anomaly %s, graph %s",
            *[fixed_text(x, 2, "up") for x in (risk, p, a, d)],
        ),
        F.concat(
            F.lit("category: "),
            F.col("merchant_category"),
        ),
    )
    return df.select(
        F.concat_ws("-", "transaction_id", "verdict").alias("case_ref"),
        F.when(blocked, "blocked")
        .otherwise("held for review")
        .alias("classification"),
        F.when(blocked, "payment stopped")
        .otherwise(
            "ask the payer, then decide"
        )
        .alias("action"),
        ist_time("ts").alias("time_ist"),
        signals.alias("signals"),
    )


def language_fanout(alerts: DataFrame, key: str, prefix: str = "alert") -> DataFrame:
    """One row per alert and language with the voice and the output key."""
    voices = F.array(
        *[
            F.struct(F.lit(c).alias("lang"), F.lit(n).alias("language"), F.lit(v).alias("voice"))
            for c, n, v in LANGUAGES
        ]
    )
    fanned = alerts.withColumn("_v", F.explode(voices))
    return fanned.select(
        *alerts.columns,
        "_v.lang",
        "_v.language",
        "_v.voice",
        F.concat_ws("_", F.lit(prefix), F.col(key), F.col("_v.lang")).alias("output_key"),
    )
