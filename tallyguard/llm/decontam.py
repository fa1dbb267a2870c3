"""Benchmark decontamination by template canonicalisation.

Words become tokens; numbers, units after numbers and capitalised words inside a
sentence (not words all in capitals) become typed placeholders. Windows of eight tokens of each document are
hash-joined with the windows of the benchmark items, so a question whose names and
numbers were changed still matches. Windows are joined by their plain lower-case tokens
too: a copy in other letter case has no names to tell. The slots behind the placeholders are compared:
along one alignment, an item's value must always stand for the same value of the
document. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyguard.session import settle

WINDOW = 8
LITERALS = 5  # literal tokens from which on an item's window is looked for with its slots open
COVERAGE = 0.5  # share of an item's windows that a document must hold
RUN = 13  # tokens of an item in one piece that are a match whatever their share
BROADCAST_WINDOWS = 1_000_000  # item windows joined in one pass (16 bytes each and their slots)
UNITS = (
    "kg|mg|g|km|cm|mm|m|mi|ft|ml|l|mph|kmh|s|ms|min|h|hz|khz|mhz|ghz|kb|mb|gb|tb|w|kw|v|usd|eur|gbp"
    "|percent|dollars|euros|meters|metres|miles|hours|minutes|seconds|days|weeks|months|years|pounds|degrees"
)
# applied in this order to the whole text; the second of each pair is the replacement
RULES = (
    (r"([0-9])[.,:/]([0-9])", r"$1p$2"),
    (r"([0-9]) *%", r"$1 _percent"),
    (rf"([0-9]) *\b((?i:{UNITS}))\b", r"$1 _$2"),
    (r"([\p{L}0-9,;] +)(\p{Lu}\p{Ll})", r"$1@$2"),
)
SPLIT = r"[^\p{L}\p{N}@_]+"


def tokens(text) -> Column:
    """Lower-case tokens: ``@`` opens a name, ``_`` a unit, a digit a number.

    A null text has no tokens.
    """
    t = F.translate(text, "@_", "  ")
    for pattern, new in RULES:
        t = F.regexp_replace(t, pattern, new)
    return F.filter(F.split(F.lower(t), SPLIT), lambda w: w != "")


def _token_codes(words) -> Column:
    """A 64-bit code per token; all numbers, units and names share one code each."""
    return F.transform(
        words,
        lambda w: F.when(w >= "a", F.xxhash64(w))
        .when(w < ":", F.lit(1).cast("bigint"))
        .when(w < "A", F.lit(2).cast("bigint"))
        .otherwise(F.lit(3).cast("bigint")),
    )


def _is_slot(code) -> Column:
    return code.isin(1, 2, 3)


def _coded(texts: DataFrame) -> DataFrame:
    """With ``words``, ``codes`` (slots by type) and ``plain`` (every token as it reads)."""
    plain = F.transform("words", lambda w: F.xxhash64(F.translate(w, "@_", "")))
    return texts.withColumn("codes", _token_codes("words")).withColumn("plain", plain)


def _code(codes: str, length: int = WINDOW) -> Column:
    """Code of the window at ``at``; tokens beyond the end of the text do not enter it."""
    return F.xxhash64(*[F.get(codes, F.col("at") + k) for k in range(length)])


def _slots() -> Column:
    """Values of the slots of the window at ``at``, in order."""
    own = F.slice("words", F.col("at") + 1, WINDOW)
    return F.filter(own, lambda w: w < "a")


def item_windows(items: DataFrame) -> DataFrame:
    """Windows of the benchmark, one row per code to look for.

    Columns: item_id, at, length, typed, code, slots, and ``of`` and ``of_typed``, the
    item's windows and those of them with ``typed``. An item of fewer than ``WINDOW``
    tokens has one window, all of it. Windows with at least ``LITERALS`` literal tokens
    are looked for with their slots open (``typed``); every window is also looked for by
    its exact tokens in any letter case, as names are told by their case. Items of equal item_id and rows without text are
    handled as they come: equal ids add their windows, null texts have none.
    """
    base = _coded(items.select("item_id", tokens("text").alias("words")))
    n = F.size("codes")
    at = F.explode(F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))))).alias("at")
    rows = base.select("item_id", "words", "codes", "plain", F.least(n, F.lit(WINDOW)).alias("length"), at)
    own = F.slice("codes", F.col("at") + 1, WINDOW)
    typed = F.size(F.filter(own, lambda c: ~_is_slot(c))) >= LITERALS
    none = F.array().cast("array<string>")
    keys = F.array(
        F.when(typed, F.struct(_code("codes").alias("code"), _slots().alias("slots"))),
        F.when(~typed | (F.size(_slots()) > 0), F.struct(_code("plain").alias("code"), none.alias("slots"))),
    )
    rows = rows.select("item_id", "at", "length", typed.alias("typed"), F.explode(keys).alias("k"))
    rows = rows.where("k IS NOT NULL").select("item_id", "at", "length", "typed", "k.code", "k.slots")
    rows = rows.dropDuplicates(["item_id", "at", "code", "slots"])
    n = rows.groupBy("item_id").agg(
        F.countDistinct("at").alias("of"), F.countDistinct(F.when(F.col("typed"), F.col("at"))).alias("of_typed")
    )
    return rows.alias("r").join(n.alias("n"), F.col("r.item_id").eqNullSafe(F.col("n.item_id"))).select("r.*", "of", "of_typed")


def _document_windows(docs: DataFrame, short: list[int]) -> DataFrame:
    """Codes of every window of eight tokens and of the lengths ``short``, typed and plain."""
    base = _coded(docs.select("doc_id", F.xxhash64("text").alias("doc_hash"), tokens("text").alias("words")))
    n = F.size("codes")
    at = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("at")
    rows = base.select("doc_id", "doc_hash", "words", "codes", "plain", at)
    codes = []
    for length in [*short, WINDOW]:
        whole, typed, plain = F.col("at") + length <= n, _code("codes", length), _code("plain", length)
        codes += [F.when(whole, typed), F.when(whole & (plain != typed), plain)]
    return rows.select("doc_id", "doc_hash", "words", "at", F.explode(F.array(*codes)).alias("code"))


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Matching windows: doc_id, doc_hash, item_id, of, of_typed, item_at, typed, diagonal, pairs.

    The item side is counted first and broadcast in blocks of at most
    ``BROADCAST_WINDOWS`` windows by code, so documents are read once per block and
    never shuffled, however large the benchmark is. ``pairs`` is null for windows
    without slots.
    """
    side = settle(item_windows(items), "decontam-items")
    blocks = -(-side.count() // BROADCAST_WINDOWS) or 1
    short = sorted(r.length for r in side.where(F.col("length") < WINDOW).select("length").distinct().collect())
    rows = _document_windows(docs, short)
    side = side.select(
        "item_id", "of", "of_typed", "typed", F.col("at").alias("item_at"), "code", F.col("slots").alias("item_slots")
    )
    found = None
    for b in range(blocks):
        part = side.where(F.pmod("code", F.lit(blocks)) == b) if blocks > 1 else side
        own = F.slice(_slots(), 1, F.size("item_slots"))
        hit = rows.join(F.broadcast(part), "code").select(
            "doc_id", "doc_hash", "item_id", "of", "of_typed", "item_at", "typed",
            (F.col("at") - F.col("item_at")).alias("diagonal"),
            F.when(F.size("item_slots") > 0, F.arrays_zip(F.col("item_slots").alias("was"), own.alias("now"))).alias("pairs"),
        )
        found = hit if found is None else found.unionByName(hit)
    return found


def _pairs(entries) -> Column:
    """Distinct pairs of slot values of matching windows."""
    return F.array_distinct(F.flatten(F.filter(F.transform(entries, lambda e: e["pairs"]), lambda p: p.isNotNull())))


def _consistent(entries) -> Column:
    """Whether each value of the item stands for one value of the document."""
    pairs = _pairs(entries)
    return F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["was"])))


def _changed(entries) -> Column:
    return F.size(F.filter(_pairs(entries), lambda p: p["was"] != p["now"]))


def _has_run(entries) -> Column:
    """Whether consecutive windows cover ``RUN`` tokens."""
    at = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["at"])))
    steps = RUN - WINDOW
    later = F.slice(at, steps + 1, F.size(at))
    return F.exists(F.zip_with(at, later, lambda x, y: F.coalesce(y == x + steps, F.lit(False))), lambda b: b)


def contaminated(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Documents that hold a benchmark item, one row per document and item.

    A document holds an item with ``coverage`` of all its windows, or of those looked
    for with open slots, or with ``RUN`` tokens in one piece. Slots must be consistent
    along the diagonal, for a piece along the whole of its run; windows without slots
    need no consistent alignment.

    Columns: doc_id, doc_hash (of the text, to tell rows of equal doc_id apart),
    item_id, windows (distinct windows of the item found with consistent slots),
    item_windows, coverage (the larger of the two shares), changed_slots (slots whose
    value differs from the item's). Null texts and texts without tokens never match.
    Repeated rows count once.
    """
    keys = ["doc_id", "doc_hash", "item_id", "of", "of_typed"]
    along = matches(docs, items).groupBy(*keys, "diagonal").agg(
        F.collect_set(F.struct(F.col("item_at").alias("at"), "typed", "pairs")).alias("entries")
    )
    along = along.select(
        *keys, "diagonal", _consistent("entries").alias("even"), _changed("entries").alias("changed"),
        F.explode("entries").alias("e"),
    )
    order = Window.partitionBy(*keys, "diagonal").orderBy("e.at")
    pieces = along.withColumn("piece", F.col("e.at") - F.dense_rank().over(order))
    pieces = pieces.groupBy(*keys, "diagonal", "even", "changed", "piece").agg(F.collect_set("e").alias("entries"))
    fixed = F.filter("entries", lambda e: e["pairs"].isNull())
    held = F.when(F.col("even") | _consistent("entries"), F.col("entries")).otherwise(fixed)
    pieces = pieces.withColumn("held", held).withColumn("run", _has_run("held"))
    counted = F.when(F.col("even") | F.col("run"), F.col("held")).otherwise(fixed)
    pieces = pieces.withColumn("counted", counted)
    changed = F.when(F.col("even"), F.col("changed")).otherwise(_changed("counted"))
    good = pieces.select(*keys, "run", F.explode("counted").alias("e"), changed.alias("changed"))
    by_item = good.groupBy(*keys).agg(
        F.countDistinct("e.at").alias("windows"),
        F.countDistinct(F.when(F.col("e.typed"), F.col("e.at"))).alias("windows_typed"),
        F.max("changed").alias("changed_slots"),
        F.max("run").alias("run"),
    )
    share = F.greatest(F.col("windows") / F.col("of"), F.try_divide("windows_typed", "of_typed"))
    return by_item.where((share >= coverage) | F.col("run")).select(
        "doc_id", "doc_hash", "item_id", "windows", F.col("of").alias("item_windows"), share.alias("coverage"), "changed_slots"
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Pipeline stage form: the documents that hold no benchmark item, all columns kept."""
    bad = contaminated(docs, items, coverage).select(F.col("doc_id").alias("__id"), F.col("doc_hash").alias("__hash"))
    bad = settle(bad.distinct(), "decontam-bad")
    same = docs["doc_id"].eqNullSafe(bad["__id"]) & (F.xxhash64(docs["text"]) == bad["__hash"])
    return docs.join(bad, same, "left_anti")
