"""Scans, alias resolution, typing, sinks and encoders."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tallyguard.operators.encode import corridor_fit, corridor_flag, ordinal_encode, ordinal_fit
from tallyguard.plans.compile import assemble
from tallyguard.session import scratch_path
from tallyguard.sources.canonical import canonicalise, coerce_types, detect_column, resolve_aliases
from tallyguard.sources.files import require_columns, scan_csv, scan_demo_csv
from tallyguard.sources.sinks import append_events, publish_deltas, read_events

DEMO = (
    "transaction id,timestamp,transaction type,merchant_category,amount (INR),transaction_status,"
    "sender_age_group,receiver_age_group,sender_state,sender_bank,receiver_bank,device_type,"
    "network_type,fraud_flag,hour_of_day,day_of_week,is_weekend,device_surrogate,corridor_surrogate"
)


def write_lines(tmp_path, lines):
    path = tmp_path / "in.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_demo_csv_aliases(spark, tmp_path):
    line = "T1,2024-01-10 13:35:29,P2P,Other,3500,SUCCESS,a,b,Gujarat,Kotak,PNB,Android,4G,1,13,Wed,0,dev1,cor1"
    path = write_lines(tmp_path, [DEMO, line, line.replace("2024-01-10 13:35:29", "soon")])
    rows = canonicalise(scan_csv(spark, path)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["sender_id"], r["receiver_id"], r["receiver_bank"]) == ("dev1", "PNB", "PNB")
    assert (r["amount"], r["fraud_flag"], r["network_type"]) == (3500.0, 1, "4G")
    assert r["txn_frequency"] == 0.0


def test_demo_csv_rows(spark, tmp_path):
    good = "T1,2024-01-10,P2P,Other,abc,S,a,b,G,K,P,Android,4G,1,13,Wed,0,dev1,cor1,extra"
    path = write_lines(tmp_path, [DEMO, good, "T2,too,short"])
    rows = scan_demo_csv(spark, path).collect()
    assert [(r["transaction_id"], r["amount"], r["hour_of_day"]) for r in rows] == [("T1", 0.0, 13.0)]


def test_alias_priority_and_errors(spark):
    assert detect_column(["Customer_ID", "Device_ID"], "sender_id") == "Device_ID"
    assert detect_column(["x"], "amount") is None
    with pytest.raises(ValueError, match="fraud_flag"):
        resolve_aliases(spark.createDataFrame([(1, 1.0, "a", "b")], "step int, amt double, nameOrig string, nameDest string"))
    with pytest.raises(ValueError, match="missing"):
        require_columns(spark.range(1), ["y"], "t")
    with pytest.raises(ValueError, match="missing features"):
        assemble(spark.range(1))


def test_step_dataset(spark):
    df = spark.createDataFrame(
        [(25, "PAYMENT", 9.5, "C1", "M1", 0)],
        "step int, type string, amount double, nameOrig string, nameDest string, isFraud int",
    )
    r = canonicalise(df).first()
    assert str(r["ts"]) == "2024-01-02 01:00:00"
    assert (r["sender_id"], r["receiver_id"], r["transaction_type"], r["sender_bank"]) == ("C1", "M1", "PAYMENT", "UNKNOWN")


def test_dropped_rows_are_counted(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", "1"), ("x", "2"), (None, "3")], "timestamp string, amount string")
    seen = Observation()
    out = coerce_types(df.withColumn("txn_frequency", F.lit(0.0)).withColumn("days_since_last_txn", F.lit("UNKNOWN")), dropped=seen)
    assert len(out.collect()) == 1
    assert seen.get["bad_timestamps"] == 2


@pytest.mark.parametrize("local_rows", [0, 100])
def test_ordinal_codes(spark, local_rows):
    train = spark.createDataFrame([("b",), ("a",), (None,), ("B",), ("abcde",), ("abcdf",)], "sender_bank string")
    maps = ordinal_fit(train, ["sender_bank"], local_rows)
    got = {r["category"]: r["code"] for r in maps.collect()}
    assert got == {c: i for i, c in enumerate(sorted(["b", "a", "nan", "B", "abcde", "abcdf"]))}
    rows = spark.createDataFrame([("a",), ("zzz",), (None,)], "sender_bank string")
    codes = [r["enc_sender_bank"] for r in ordinal_encode(rows, maps, ["sender_bank"]).collect()]
    assert codes == [float(got["a"]), -1.0, float(got["nan"])]


def test_corridors(spark):
    train = spark.createDataFrame(
        [("A", "B", 1), ("A", "B", 0), ("A", "C", 0), (None, "B", 1)],
        "sender_bank string, receiver_bank string, fraud_flag int",
    )
    risky = corridor_fit(train, 0.3)
    assert [r["corridor"] for r in risky.collect()] == ["A|B"]
    rows = spark.createDataFrame([("A", "B"), ("A", "C"), (None, "B")], "sender_bank string, receiver_bank string")
    flags = [r["is_high_risk_corridor"] for r in corridor_flag(rows, risky).collect()]
    assert flags == [1.0, 0.0, 0.0]


def test_event_and_delta_sinks(spark):
    path = scratch_path(spark, "events")
    df = spark.createDataFrame([("h", 1)], "vpa_hash string, ts bigint")
    append_events(df, path, "erasure")
    append_events(df, path, "erasure")
    rows = read_events(spark, path, "event string, vpa_hash string, ts bigint").collect()
    assert [tuple(r) for r in rows] == [("erasure", "h", 1)] * 2
    out = scratch_path(spark, "deltas")
    publish_deltas(spark.createDataFrame([("h", 1.7, "x")], "vpa_hash string, risk_delta double, reason string"), out, 5)
    r = spark.read.parquet(out).first()
    assert (r["risk_delta"], r["_timestamp"]) == (1.0, 5)


def test_pruned_scan_takes_the_newest_events(spark, tmp_path):
    """The window is the newest 5,000 edges of all events, whatever other tables there are."""
    events = spark.range(5_200).selectExpr(
        "id AS event_id", "timestamp_seconds(1700000000 + id * 7919 % 5200) AS ts", "id % 30 AS user_id",
        "'view' AS event_type", "id * 0.5D AS value", "concat('{\"k\": ', id % 9, '}') AS props",
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    rows = queries()["s05_pruned_parquet_scan"](spark, str(tmp_path)).collect()
    want = sorted(range(5_200), key=lambda i: i * 7919 % 5200)[200:]
    assert {r["seq"]: (r["src"], r["dst"], r["amount"]) for r in rows} == {i: (f"N{i % 30}", f"N{i % 9}", i * 0.5) for i in want}
    assert len(rows) == 5_000
