"""Canonical schemas, the feature contract and the fixed values of the domain."""

from __future__ import annotations

from pyspark.sql import types as T

MICROS = 1_000_000
MINUTE = 60 * MICROS
HOUR = 3600 * MICROS
DAY = 24 * HOUR

# --- fixed values: the ordered feature contract -----------------------------
FEATURE_ORDER = [
    "amount",
    "hour_of_day",
    "day_of_week",
    "is_weekend",
    "device_txn_count_10m",
    "device_txn_count_1h",
    "device_txn_count_6h",
    "device_txn_count_24h",
    "device_amount_zscore_24h",
    "receiver_unique_senders_10m",
    "receiver_txn_count_1h",
    "receiver_txn_count_24h",
    "receiver_unique_senders_1h",
    "amount_zscore_global",
    "is_new_device",
    "is_new_receiver",
    "enc_transaction_type",
    "enc_device_type",
    "enc_network_type",
    "enc_sender_bank",
    "enc_receiver_bank",
    "is_high_risk_corridor",
    "txn_frequency",
    "days_since_last_txn",
]
LABEL = "fraud_flag"

# --- fixed values: accepted source column names, in priority order ----------
ALIASES = {
    "timestamp": ["timestamp", "step", "time", "date", "datetime", "trans_date_trans_time"],
    "amount": ["amount", "amount (inr)", "amount(inr)", "amount_inr", "amt"],
    "sender_id": [
        "nameorig", "sender_id", "device_surrogate", "device_id", "from_account",
        "sender", "account_id", "nameorg", "customer_id",
    ],
    "receiver_id": [
        "namedest", "receiver_id", "receiver_bank", "to_account", "receiver",
        "merchant", "merchant_id",
    ],
    "fraud_flag": ["isfraud", "fraud_flag", "label", "is_fraud", "fraudulent", "class", "fraud"],
    "transaction_type": ["transaction type", "transaction_type", "type", "trans_type"],
    "device_type": ["device_type", "device type", "devicetype", "device_os"],
    "network_type": ["network_type", "network type", "networktype"],
    "sender_bank": ["sender_bank", "sender bank", "from_bank"],
    "receiver_bank": ["receiver_bank", "receiver bank", "to_bank"],
    "txn_frequency": ["txn_frequency", "transaction_frequency"],
    "days_since_last_txn": ["days_since_last_txn", "days_since_last_transaction"],
}
REQUIRED = ["timestamp", "amount", "sender_id", "receiver_id", "fraud_flag"]
CATEGORICALS = ["transaction_type", "device_type", "network_type", "sender_bank", "receiver_bank"]
NUMERIC_OPTIONALS = ["txn_frequency", "days_since_last_txn"]
OPTIONALS = CATEGORICALS + NUMERIC_OPTIONALS

# --- fixed values: scoring weights and bands --------------------------------
FUSION_WEIGHTS = {"supervised": 0.6, "anomaly": 0.3, "topology": 0.1}
DECISION_THRESHOLD = 0.46
BLOCK_FLOOR = 0.75
CONFIRM_FLOOR = 0.25
FAN_IN_10M = 10
VELOCITY_10M = 12
CORRIDOR_RATE = 0.003
EPSILON = 1e-9

# --- fixed values: deployment tiers (ttl s, requests per window, anomaly on) -
TIERS = [("cloud", 180, 100, True), ("on_prem", 300, 500, True), ("edge", 60, 20, False)]
RATE_WINDOW_S = 60

CANONICAL = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("seq", T.LongType()),
        T.StructField("sender_id", T.StringType()),
        T.StructField("receiver_id", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("transaction_type", T.StringType()),
        T.StructField("device_type", T.StringType()),
        T.StructField("network_type", T.StringType()),
        T.StructField("sender_bank", T.StringType()),
        T.StructField("receiver_bank", T.StringType()),
        T.StructField("txn_frequency", T.DoubleType()),
        T.StructField("days_since_last_txn", T.DoubleType()),
        T.StructField("fraud_flag", T.IntegerType()),
    ]
)

SETU_STATEMENT = T.StructType(
    [
        T.StructField(
            "accounts",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("maskedAccNumber", T.StringType()),
                        T.StructField(
                            "transactions",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("txnId", T.StringType()),
                                        T.StructField("amount", T.DoubleType()),
                                        T.StructField("narration", T.StringType()),
                                        T.StructField("type", T.StringType()),
                                        T.StructField("currentBalance", T.DoubleType()),
                                        T.StructField("date", T.StringType()),
                                    ]
                                )
                            ),
                        ),
                    ]
                )
            ),
        )
    ]
)

PLAID_PAGE = T.StructType(
    [
        T.StructField(
            "transactions",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("transaction_id", T.StringType()),
                        T.StructField("amount", T.DoubleType()),
                        T.StructField("merchant_name", T.StringType()),
                        T.StructField("name", T.StringType()),
                        T.StructField("category", T.ArrayType(T.StringType())),
                        T.StructField("date", T.StringType()),
                        T.StructField("payment_channel", T.StringType()),
                        T.StructField("account_id", T.StringType()),
                    ]
                )
            ),
        )
    ]
)
