"""Payment-graph topology risk over an edge table (src, dst, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.functions.rounding import fixed_text, round_exact
from tallyguard.operators.selection import order_statistics
from tallyguard.operators.skew import ROWS_PER_CHUNK, budget
from tallyguard.session import settle

# --- fixed values: detector thresholds and base contributions ---------------
WINDOW_EDGES = 5000
FAN_OUT_MIN = 3
FAN_IN_MIN = 5
CYCLE_MAX = 5
SCATTER_RATIO = 2.0
BASE_DELTA = {"fan_out": 0.35, "fan_in": 0.30, "cycle": 0.50, "scatter": 0.20}


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def scaled(base: float, severity: Column) -> Column:
    """60% of the base at no severity, all of it at full severity."""
    return clamp01(F.lit(base) * (F.lit(0.6) + F.lit(0.4) * clamp01(severity)))


def last_edges(
    edges: DataFrame, size: int = WINDOW_EDGES, us: str = "us", seq: str = "seq"
) -> DataFrame:
    """The newest ``size`` edges (the sliding window of the graph).

    Edges without a time are the oldest. On large tables the time of the oldest wanted
    edge is found first, so that only about ``size`` rows reach the final ordering
    instead of ``size`` from every partition.
    """
    n = edges.where(F.col(us).isNotNull()).count()
    if n > max(size, budget(edges.sparkSession, ROWS_PER_CHUNK)):
        oldest = order_statistics(edges, us, [n - size])[n - size][0]
        edges = edges.where(F.col(us) >= F.lit(oldest))
    return edges.orderBy(F.col(us).desc(), F.col(seq).desc()).limit(size)


def degrees(edges: DataFrame) -> DataFrame:
    """Per node: distinct receivers (``out_deg``) and senders (``in_deg``)."""
    pairs = edges.select("src", "dst").distinct()
    ends = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        ).alias("e")
    )
    return ends.groupBy("e.node").agg(
        F.sum("e.o").alias("out_deg"), F.sum("e.i").alias("in_deg")
    )


def _event(label: str, severity: Column, fmt: str, *parts: Column) -> list[Column]:
    return [
        F.col("node"),
        scaled(BASE_DELTA[label], severity).alias("delta"),
        F.lit(label).alias("label"),
        F.format_string(fmt, *parts, fixed_text(severity)).alias("evidence"),
    ]


def fan_out(degree: DataFrame, minimum: int = FAN_OUT_MIN) -> DataFrame:
    severity = clamp01((F.col("out_deg") - minimum + 1) / F.lit(max(1, minimum)))
    return degree.where(F.col("out_deg") >= minimum).select(
        *_event("fan_out", severity, "fan_out(n=%d,sev=%s)", F.col("out_deg"))
    )


def fan_in(degree: DataFrame, minimum: int = FAN_IN_MIN) -> DataFrame:
    severity = clamp01((F.col("in_deg") - minimum + 1) / F.lit(max(1, minimum)))
    return degree.where(F.col("in_deg") >= minimum).select(
        *_event("fan_in", severity, "fan_in(n=%d,sev=%s)", F.col("in_deg"))
    )


def scatter(degree: DataFrame, ratio: float = SCATTER_RATIO) -> DataFrame:
    spread = F.col("out_deg") / F.greatest(F.lit(1), F.col("in_deg"))
    severity = clamp01((spread / F.lit(max(ratio, 0.1)) - 1.0) / 2.0)
    return degree.where((F.col("in_deg") >= 1) & (F.col("out_deg") > ratio * F.col("in_deg"))).select(
        *_event(
            "scatter", severity, "scatter(out=%d,in=%d,sev=%s)", F.col("out_deg"), F.col("in_deg")
        )
    )


def simple_cycles(edges: DataFrame, max_length: int = CYCLE_MAX) -> DataFrame:
    """Each simple cycle of 2..max_length nodes once, as ``path`` from its smallest node.

    Edges whose end has no way on, or whose start has no way in, are trimmed
    first; a cycle cannot use them. The rest is written once, and each cycle is joined
    from a way out of its start and a shorter way back. The edge side comes from a
    bounded window.
    """
    pairs = edges.select("src", "dst").where("src <> dst").distinct()
    for _ in range(2):
        sources = pairs.select(F.col("src").alias("dst")).distinct()
        targets = pairs.select(F.col("dst").alias("src")).distinct()
        pairs = pairs.join(sources, "dst", "left_semi").join(targets, "src", "left_semi").select(
            "src", "dst"
        )
    pairs = settle(pairs, "cycle-pairs")
    step = pairs.select(F.col("src").alias("_from"), F.col("dst").alias("_to"))
    out = [pairs.where("src < dst").select(
        F.col("src").alias("start"), F.col("dst").alias("at"), F.array("src", "dst").alias("path")
    )]
    back = [pairs.where("src > dst").select(
        F.col("dst").alias("start"), F.col("src").alias("at"), F.slice(F.array("src"), 1, 0).alias("rest")
    )]
    while len(out) < (max_length + 1) // 2:
        out.append(
            out[-1].join(step, F.col("at") == F.col("_from"))
            .where((F.col("_to") > F.col("start")) & ~F.array_contains("path", F.col("_to")))
            .select("start", F.col("_to").alias("at"), F.concat("path", F.array("_to")).alias("path"))
        )
    while len(back) < max_length // 2:
        back.append(
            back[-1].join(step, F.col("at") == F.col("_to"))
            .where((F.col("_from") > F.col("start")) & ~F.array_contains("rest", F.col("_from")))
            .select("start", F.col("_from").alias("at"), F.concat(F.array("at"), "rest").alias("rest"))
        )
    found = []
    for length in range(2, max_length + 1):
        ahead, home = out[(length + 1) // 2 - 1], back[length // 2 - 1]
        both = ahead.join(home, ["start", "at"]).where(~F.arrays_overlap("path", "rest"))
        found.append(both.select(F.concat("path", "rest").alias("path")))
    return reduce(DataFrame.unionByName, found)


def cycle_events(cycles: DataFrame, max_length: int = CYCLE_MAX) -> DataFrame:
    per_node = (
        cycles.select(F.explode("path").alias("node"), F.size("path").alias("n"))
        .groupBy("node")
        .agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("min_len"))
    )
    short = clamp01((F.lit(max_length) - F.col("min_len") + 1) / F.lit(max(1, max_length)))
    severity = 0.5 * short + 0.5 * clamp01(F.col("k") / 3.0)
    return per_node.select(
        *_event("cycle", severity, "cycle(k=%d,min_len=%d,sev=%s)", F.col("k"), F.col("min_len"))
    )


def detections(edges: DataFrame, max_length: int = CYCLE_MAX) -> DataFrame:
    """All detector events of the graph as (node, delta, label, evidence)."""
    degree = degrees(edges)
    return (
        fan_out(degree)
        .unionByName(fan_in(degree))
        .unionByName(cycle_events(simple_cycles(edges, max_length), max_length))
        .unionByName(scatter(degree))
    )


def node_risk(events: DataFrame) -> DataFrame:
    """Capped sum of deltas per node with the sorted distinct evidence as reason."""
    return (
        events.groupBy(F.col("node").alias("vpa_hash"))
        .agg(
            F.sum("delta").alias("_delta"),
            F.array_join(F.array_sort(F.collect_set("evidence")), "+").alias("reason"),
        )
        .where("_delta > 0")
        .select(
            "vpa_hash",
            round_exact(F.least(F.col("_delta"), F.lit(1.0)), 4).alias("risk_delta"),
            "reason",
        )
    )


def graph_stats(edges: DataFrame, capacity: int = WINDOW_EDGES) -> DataFrame:
    """Nodes, edges and window fill, one row."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    nodes = ends.distinct().agg(F.count(F.lit(1)).alias("nodes"))
    counted = edges.agg(F.count(F.lit(1)).alias("edges"))
    return nodes.select(
        "nodes",
        F.coalesce(counted.scalar(), F.lit(0)).alias("edges"),
    ).select("nodes", "edges", F.col("edges").alias("window_used"), F.lit(capacity).cast("bigint").alias("window_capacity"))


def top_nodes(risk: DataFrame, size: int = 20) -> DataFrame:
    return risk.orderBy(F.col("risk_delta").desc(), "vpa_hash").limit(size)
