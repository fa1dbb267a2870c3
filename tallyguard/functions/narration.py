"""Reading bank narrations and category lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: narration keywords per merchant category, tested in order -
NARRATION_CATEGORIES = [
    ("FOOD", "ZOMATO|SWIGGY|FOOD|RESTAU|CAFE|HOTEL|BHOJAN"),
    ("UTILITY", "ELECTRIC|WATER|GAS|BILL|BSNL|JIO|AIRTEL|DTH|RECHARGE"),
    ("ECOM", "AMAZON|FLIPKART|MYNTRA|AJIO|MEESHO|SHOP|STORE|MART"),
    ("TRAVEL", "TRAVEL|IRCTC|RAILWAY|REDBUS|MAKEMYTRIP|OLA|UBER|RAPIDO"),
    ("GAMBLING", "GAMEZ?|RUMMY|DREAM11|MPL|LOTTERY|CASINO|BET"),
]

# --- fixed values: bank keywords and handles, tested in order ----------------
BANK_KEYS = [
    ("AXIS", "axisbank"),
    ("HDFC", "okhdfc"),
    ("ICICI", "okicici"),
    ("SBI", "sbi"),
    ("KOTAK", "kotak"),
    ("YES", "yesbank"),
    ("PAYTM", "paytm"),
    ("GPAY", "okicici"),
]

# --- fixed values: card-feed categories --------------------------------------
PLAID_CATEGORIES = {
    "Food and Drink": "FOOD",
    "Restaurants": "FOOD",
    "Fast Food": "FOOD",
    "Travel": "TRAVEL",
    "Airlines and Aviation Services": "TRAVEL",
    "Taxi": "TRAVEL",
    "Utilities": "UTILITY",
    "Phone": "UTILITY",
    "Internet": "UTILITY",
    "Recreation": "GAMBLING",
    "Gambling": "GAMBLING",
    "Shops": "ECOM",
    "Digital Purchase": "ECOM",
    "Clothing and Accessories": "ECOM",
}


def narration_category(narration: str) -> Column:
    """First category whose keywords occur in the narration, else P2P."""
    upper = F.upper(narration)
    (name, words), *rest = NARRATION_CATEGORIES
    chain = F.when(upper.rlike(words), name)
    for name, words in rest:
        chain = chain.when(upper.rlike(words), name)
    return chain.otherwise("P2P")


def narration_vpa(narration: str, fallback: str = "merchant") -> Column:
    """Handle named after 'UPI/', lower-cased; else one made from the narration."""
    named = F.lower(F.regexp_extract(narration, r"UPI/([A-Za-z0-9._@-]+)/?", 1))
    made = F.substring(F.regexp_replace(F.lower(narration), "[^a-z0-9]", ""), 1, 12)
    made = F.coalesce(F.nullif(made, F.lit("")), F.lit(fallback))
    return F.coalesce(F.nullif(named, F.lit("")), F.concat(made, F.lit("@upi")))


def bank_of(text: str) -> Column:
    """Handle of the first bank keyword in the text, else UNKNOWN."""
    upper = F.upper(text)
    (key, bank), *rest = BANK_KEYS
    chain = F.when(upper.contains(key), bank)
    for key, bank in rest:
        chain = chain.when(upper.contains(key), bank)
    return chain.otherwise("UNKNOWN")


def plaid_category(categories: str) -> Column:
    """Category of the first list entry that has one, else ECOM."""
    table = F.create_map(*[F.lit(x) for pair in PLAID_CATEGORIES.items() for x in pair])
    known = F.filter(F.transform(categories, lambda c: table[c]), lambda x: x.isNotNull())
    return F.coalesce(F.get(known, F.lit(0)), F.lit("ECOM"))


def plaid_txn_type(channel: str, categories: str) -> Column:
    transfer = F.coalesce(F.array_contains(categories, "Transfer"), F.lit(False))
    return F.when(transfer | (F.col(channel) == "other"), "P2P").otherwise("P2M")


def category_txn_type(category: str | Column) -> Column:
    col = F.col(category) if isinstance(category, str) else category
    return F.when(col == "P2P", "P2P").otherwise("P2M")


def balance_drain(amount: str, balance: str) -> Column:
    """Share of the balance an outflow takes, at most 1; 0 without outflow."""
    share = F.least(F.lit(1.0), F.col(amount) / F.greatest(F.col(balance), F.lit(1.0)))
    return F.when(F.col(amount) > 0, share).otherwise(0.0)
