"""From a transaction table to per-node risk deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.functions.identity import first_filled, hash_id
from tallyguard.operators.graph import WINDOW_EDGES, detections, last_edges, node_risk
from tallyguard.session import settle

# --- fixed values: endpoint columns in order of preference --------------------
SENDER_COLUMNS = ["sender_vpa", "sender_bank", "from_vpa"]
RECEIVER_COLUMNS = ["receiver_vpa", "receiver_bank", "to_vpa"]


def endpoint_edges(df: DataFrame) -> DataFrame:
    """Edge table from whichever endpoint columns are filled, ids hashed."""
    senders = [c for c in SENDER_COLUMNS if c in df.columns]
    receivers = [c for c in RECEIVER_COLUMNS if c in df.columns]
    return df.select(
        hash_id(first_filled(senders, "unknown_sender")).alias("src"),
        hash_id(first_filled(receivers, "unknown_receiver")).alias("dst"),
        F.coalesce(F.col("amount").cast("double"), F.lit(0.0)).alias("amount"),
        "us",
        "seq",
    )


def window_risk(edges: DataFrame, size: int = WINDOW_EDGES) -> DataFrame:
    """Node risk over the newest ``size`` edges.

    The window is written once: the detectors read it many times and it holds at
    most ``size`` rows.
    """
    window = settle(last_edges(edges, size).select("src", "dst", "us", "seq"), "edge-window")
    return node_risk(detections(window))
