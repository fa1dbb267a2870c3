"""Payment-graph queries. Degrees run over all edges, cycles over the sliding edge window."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyguard.catalog.base import EDGES, PAY, edges, payments, query, r6, r9
from tallyguard.operators.graph import (
    WINDOW_EDGES,
    cycle_events,
    degrees,
    fan_in,
    fan_out,
    graph_stats,
    last_edges,
    node_risk,
    scatter,
    simple_cycles,
    top_nodes,
)
from tallyguard.functions.scoring import fuse_gateway
from tallyguard.operators.profile import union_all
from tallyguard.operators.selection import order_statistics
from tallyguard.plans.feedback import publish_window, read_log, with_feedback
from tallyguard.plans.graph_risk import window_risk
from tallyguard.session import scratch_path, settle
from tallyguard.sources.sinks import publish_deltas

WINDOW = WINDOW_EDGES

_DEG = """, deg AS (SELECT coalesce(o.node, i.node) AS node, coalesce(out_deg, 0) AS out_deg,
  coalesce(in_deg, 0) AS in_deg
  FROM (SELECT src AS node, count(DISTINCT dst) AS out_deg FROM {e} GROUP BY src) o
  FULL JOIN (SELECT dst AS node, count(DISTINCT src) AS in_deg FROM {e} GROUP BY dst) i ON o.node = i.node)"""
_WIN = f", win AS (SELECT * FROM edges ORDER BY us DESC, seq DESC LIMIT {WINDOW})"


def _clamp(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


_OUT_SEV = _clamp("(out_deg - 2) / 3.0::DOUBLE")
_IN_SEV = _clamp("(in_deg - 4) / 5.0::DOUBLE")
_SC_SEV = _clamp("(out_deg / greatest(1.0, in_deg)::DOUBLE / 2.0 - 1.0) / 2.0")
_FAN_OUT = f"""SELECT node, 0.35 * (0.6 + 0.4 * {_OUT_SEV}) AS delta,
  'fan_out(n=' || out_deg || ',sev=' || printf('%.2f', {_OUT_SEV}) || ')' AS evidence FROM deg WHERE out_deg >= 3"""
_FAN_IN = f"""SELECT node, 0.30 * (0.6 + 0.4 * {_IN_SEV}) AS delta,
  'fan_in(n=' || in_deg || ',sev=' || printf('%.2f', {_IN_SEV}) || ')' AS evidence FROM deg WHERE in_deg >= 5"""
_SCATTER = f"""SELECT node, 0.20 * (0.6 + 0.4 * {_SC_SEV}) AS delta,
  'scatter(out=' || out_deg || ',in=' || in_deg || ',sev=' || printf('%.2f', {_SC_SEV}) || ')' AS evidence
  FROM deg WHERE in_deg >= 1 AND out_deg > 2.0 * in_deg"""


def _cycles() -> str:
    parts = []
    for n in range(2, 6):
        tables = ", ".join(f"p e{i}" for i in range(n))
        links = [f"e{i}.dst = e{(i + 1) % n}.src" for i in range(n)]
        links += [f"e0.src < e{i}.src" for i in range(1, n)]
        links += [f"e{i}.src <> e{j}.src" for i in range(1, n) for j in range(i + 1, n)]
        nodes = ", ".join(f"e{i}.src" for i in range(n))
        parts.append(f"SELECT [{nodes}] AS path FROM {tables} WHERE {' AND '.join(links)}")
    return (
        ", p AS (SELECT DISTINCT src, dst FROM win WHERE src <> dst), cyc AS ("
        + " UNION ALL ".join(parts)
        + "), pern AS (SELECT node, count(*) AS k, min(n) AS min_len FROM "
        "(SELECT unnest(path) AS node, len(path) AS n FROM cyc) GROUP BY node)"
    )


_CY_SEV = f"(0.5 * {_clamp('(6 - min_len) / 5.0::DOUBLE')} + 0.5 * {_clamp('k / 3.0::DOUBLE')})"
_CYCLE = f"""SELECT node, 0.50 * (0.6 + 0.4 * {_CY_SEV}) AS delta,
  'cycle(k=' || k || ',min_len=' || min_len || ',sev=' || printf('%.2f', {_CY_SEV}) || ')' AS evidence FROM pern"""


def _rounded(sql: str) -> str:
    return f"SELECT node, round(delta, 6) AS delta, evidence FROM ({sql})"


def _events(df):
    return df.select("node", r6("delta").alias("delta"), "evidence")


def _window(spark, sf):
    return settle(last_edges(edges(spark, sf), WINDOW), "edge-window")


@query(
    "a10_neighbor_degree",
    "SELECT node, out_deg, in_deg FROM deg",
    EDGES + _DEG.format(e="edges"),
)
def a10(spark, sf):
    return degrees(edges(spark, sf))


@query("a10_payment_degree", "SELECT node, out_deg, in_deg FROM deg",
       PAY + _DEG.format(e="(SELECT sender_id AS src, receiver_id AS dst FROM pay)"))
def a10_pay(spark, sf):
    pay = payments(spark, sf)
    return degrees(pay.select(F.col("sender_id").alias("src"), F.col("receiver_id").alias("dst")))


@query("a11_fan_out", _rounded(_FAN_OUT), EDGES + _DEG.format(e="edges"))
def a11(spark, sf):
    return _events(fan_out(degrees(edges(spark, sf))))


@query("a12_fan_in", _rounded(_FAN_IN), EDGES + _DEG.format(e="edges"))
def a12(spark, sf):
    return _events(fan_in(degrees(edges(spark, sf))))


@query("a13_cycle", _rounded(_CYCLE), EDGES + _WIN + _cycles())
def a13(spark, sf):
    return _events(cycle_events(simple_cycles(_window(spark, sf))))


@query("a14_scatter", _rounded(_SCATTER), EDGES + _WIN + _DEG.format(e="win"))
def a14(spark, sf):
    return _events(scatter(degrees(_window(spark, sf))))


_UNION = " UNION ALL ".join([_FAN_OUT, _FAN_IN, _CYCLE, _SCATTER])


@query(
    "a15_node_risk_rollup",
    f"""SELECT node AS vpa_hash, cast(printf('%.4f', least(sum(delta), 1.0)) AS DOUBLE) AS risk_delta,
      string_agg(DISTINCT evidence, '+' ORDER BY evidence) AS reason FROM ({_UNION}) GROUP BY node""",
    EDGES + _WIN + _DEG.format(e="win") + _cycles(),
)
def a15(spark, sf):
    return window_risk(edges(spark, sf), WINDOW)


@query(
    "u02_union_detections",
    f"SELECT count(*) AS events, count(DISTINCT node) AS nodes, round(sum(delta), 4) AS total FROM ({_UNION})",
    EDGES + _WIN + _DEG.format(e="win") + _cycles(),
)
def u02(spark, sf):
    window = _window(spark, sf)
    degree = degrees(window)
    events = union_all(
        fan_out(degree), fan_in(degree), cycle_events(simple_cycles(window)), scatter(degree)
    )
    return events.agg(
        F.count(F.lit(1)).alias("events"),
        F.count_distinct("node").alias("nodes"),
        F.round(F.sum("delta"), 4).alias("total"),
    )


@query(
    "a16_graph_stats",
    """SELECT (SELECT count(*) FROM (SELECT src FROM w UNION SELECT dst FROM w)) AS nodes, count(*) AS edges,
      count(*) AS window_used, 5000 AS window_capacity FROM w""",
    EDGES + ", w AS (SELECT * FROM edges ORDER BY us DESC, seq DESC LIMIT 5000)",
)
def a16(spark, sf):
    return graph_stats(last_edges(edges(spark, sf)))


@query(
    "o04_last_n_edges",
    "SELECT src, dst, seq FROM edges ORDER BY us DESC, seq DESC LIMIT 5000",
    EDGES,
)
def o04(spark, sf):
    return last_edges(edges(spark, sf)).select("src", "dst", "seq")


@query(
    "o05_top_risk_nodes",
    f"""SELECT node AS vpa_hash, cast(printf('%.4f', delta) AS DOUBLE) AS risk_delta FROM ({_FAN_IN})
      ORDER BY risk_delta DESC, node LIMIT 20""",
    EDGES + _DEG.format(e="edges"),
)
def o05(spark, sf):
    risk = node_risk(fan_in(degrees(edges(spark, sf))))
    return top_nodes(risk).select("vpa_hash", "risk_delta")


@query(
    "u05_endpoint_union_distinct",
    "SELECT src AS node FROM edges UNION SELECT dst FROM edges",
    EDGES,
)
def u05(spark, sf):
    e = edges(spark, sf)
    return e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()


@query(
    "j06_edge_self_join",
    "SELECT len(path) AS n, count(*) AS cycles FROM cyc GROUP BY 1",
    EDGES + _WIN + _cycles(),
)
def j06(spark, sf):
    cycles = simple_cycles(_window(spark, sf))
    return cycles.groupBy(F.size("path").alias("n")).agg(F.count(F.lit(1)).alias("cycles"))


_HALF = "(SELECT us // 1000000 + 1 FROM edges ORDER BY us LIMIT 1 OFFSET (SELECT count(*) // 2 FROM edges))"
_KEEP = 60 * 86_400


@query(
    "s14_graph_feedback",
    f"""SELECT seq, round(coalesce(delta, 0.0), 4) AS graph_delta, coalesce(reason, 'cold') AS graph_reason,
      round(greatest(0.0, least(1.0, 0.6 * least(1.0, amount / 128.0) + 0.1 * coalesce(delta, 0.0))), 9) AS risk_score
    FROM edges e ASOF LEFT JOIN log ON e.src = log.node AND e.us >= log.at_us""",
    EDGES
    + """, win AS (SELECT * FROM (SELECT * FROM edges WHERE us < (SELECT us FROM edges ORDER BY us LIMIT 1 OFFSET
      (SELECT count(*) // 2 FROM edges))) ORDER BY us DESC, seq DESC LIMIT """
    + f"{WINDOW})"
    + _DEG.format(e="win")
    + _cycles()
    + f""", log AS (SELECT node, {_HALF} * 1000000 AS at_us, cast(printf('%.4f', least(sum(delta), 1.0)) AS DOUBLE) AS delta,
      string_agg(DISTINCT evidence, '+' ORDER BY evidence) AS reason FROM ({_UNION}) GROUP BY node
      UNION ALL SELECT DISTINCT src, ({_HALF} - 864000) * 1000000, 0.05::DOUBLE, 'earlier' FROM edges)""",
)
def s14_feedback(spark, sf):
    """Edges scored with the node risk known at their time: an earlier publication, then the window's."""
    rows = edges(spark, sf)
    log = scratch_path(spark, "change-log")
    half = order_statistics(rows, "us", lambda n: [n // 2] if n else [], near=[0.5])
    at = next(iter(half.values()))[0]
    at_s = publish_window(rows, at, log, WINDOW)
    earlier = rows.select(F.col("src").alias("vpa_hash"), F.lit(0.05).alias("risk_delta"), F.lit("earlier").alias("reason")).distinct()
    publish_deltas(earlier, log, at_s - 864_000)
    scored = with_feedback(rows, read_log(spark, log), "src", _KEEP)
    risk = fuse_gateway(F.least(F.lit(1.0), F.col("amount") / 128.0), F.lit(0.0), "graph_delta")
    return scored.select("seq", F.round("graph_delta", 4).alias("graph_delta"), "graph_reason", r9(risk).alias("risk_score"))
