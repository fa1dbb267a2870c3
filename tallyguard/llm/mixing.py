"""Mixing sources to target weights by the cube method of balanced sampling.

Each source gets a target share of the words. A document's expected number of copies
is its source's target over the source's size; the whole part is taken outright and
the fractional part is an inclusion probability. The cube method moves these
probabilities at random through the null space of two constraints, the number of
documents and the number of words, until all but two are 0 or 1: sums stay what they
were while every document keeps its probability. Sources are cut into chunks of
bounded size that run side by side; what a chunk leaves open moves on to the next round,
until one chunk per source is left, which lands. Landing goes by tiers of size, longest
documents first: a tier flies, its last two documents land with their own probabilities,
and what that changed in documents and words is taken back by tilting the probabilities
of all shorter ones. The change has mean zero, so the tilt has, too; what is left in the
end is the landing of the two shortest documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.llm.order import content_hash, located, positioned, rejoin
from tallyguard.session import settle

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)  # by the source's place in code point order, repeating; null last
SHARE = 1.5  # words of the mix over words of the corpus
MOST = 2.0  # a source gives at most this many times its words
CHUNK_ROWS = 20_000  # rows of one flight
_TIER = 4.0  # sizes in one tier of the landing differ by this factor at most
_EPS = 1e-9


def word_count(text) -> F.Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(
    sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS
) -> DataFrame:
    """Per source: ``source_size``, ``rows``, ``first`` (rows of earlier sources), ``target``.

    ``sizes`` has source, source_size, rows. The level that fills the unbounded sources
    by weight is found by repeated one-row sums, so any number of sources will do.
    A source without words gets a target of 0.
    """
    ranked, n = positioned(sizes, [F.col("source").asc_nulls_last()], "_rank", "mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    size, open_w = ranked.agg(F.sum("source_size"), F.sum("_w")).first()
    total, level = share * (size or 0), 0.0
    if n:
        level = total / open_w
    while n:
        full = F.col("_cap") <= F.col("_w") * F.lit(level)
        taken, rest = ranked.agg(
            F.sum(F.when(full, F.col("_cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("_w")))
        ).first()
        higher = (total - taken) / rest if rest else level
        if higher <= level:
            break
        level = higher
    return ranked.select("source", "source_size", "rows", F.least("_cap", F.col("_w") * F.lit(level)).alias("target"))


def _move(live: list[int], u: list[float], pi: list[float], rng) -> list[int]:
    """One random step along ``u``; at least one of ``live`` ends at 0 or 1."""
    up = down = float("inf")
    for k, x in zip(live, u):
        if x > 0:
            up, down = min(up, (1 - pi[k]) / x), min(down, pi[k] / x)
        elif x < 0:
            up, down = min(up, pi[k] / -x), min(down, (1 - pi[k]) / -x)
    step = up if rng.random() * (up + down) < down else -down
    for k, x in zip(live, u):
        value = pi[k] + step * x
        pi[k] = 0.0 if value < _EPS else 1.0 if value > 1 - _EPS else value
    return [k for k in live if 0.0 < pi[k] < 1.0]


def flight(pi: list[float], size: list[float], rng) -> list[float]:
    """Moves the probabilities to 0 or 1 but for two at most.

    The sums of ``pi`` and of ``pi * size`` hold, and so does every mean.
    """
    pi = [0.0 if p < _EPS else 1.0 if p > 1 - _EPS else p for p in pi]
    live: list[int] = []
    for i, p in enumerate(pi):
        if not 0.0 < p < 1.0:
            continue
        live.append(i)
        if len(live) == 3:
            a, b, c = (size[k] for k in live)
            u = [b - c, c - a, a - b] if (a != b or b != c) else [1.0, -1.0, 0.0]
            live = _move(live, u, pi, rng)
    return pi


def _landings(pi: list[float]) -> list[tuple[float, list[float]]]:
    """(probability, landed) for the ways to land the one or two open units.

    Each unit is 1 with its probability, and their number is as even as can be.
    """
    open_ = [k for k, p in enumerate(pi) if 0.0 < p < 1.0]
    if not open_:
        return [(1.0, pi)]
    if len(open_) == 1:
        p = pi[open_[0]]
        ways = [(p, (1.0,)), (1 - p, (0.0,))]
    else:
        p, q = (pi[k] for k in open_)
        both = max(0.0, p + q - 1)
        ways = [(both, (1.0, 1.0)), (p - both, (1.0, 0.0)), (q - both, (0.0, 1.0)), (1 - p - q + both, (0.0, 0.0))]
    out = []
    for chance, ends in ways:
        if chance > _EPS:
            landed = list(pi)
            for k, x in zip(open_, ends):
                landed[k] = x
            out.append((chance, landed))
    return out


def _tilts(pi: np.ndarray, size: np.ndarray, asked: list[tuple[float, float]]) -> list[np.ndarray]:
    """For every (count, words) asked for, what to add to ``pi`` to raise its sums by as much.

    A unit moves by a line in its size, times p (1 - p), so sure ones stay. Moves are linear
    in what is asked for, and where one of them would leave 0 to 1, all are shortened
    alike: if the asked-for changes have mean zero, so have the moves.
    """
    w = pi * (1 - pi)
    m = w.sum()
    if m < _EPS:
        return [np.zeros(len(pi)) for _ in asked]
    mean = (w * size).sum() / m
    spread = (w * (size - mean) ** 2).sum()
    sloped = spread > _EPS * m * max(mean, 1.0) ** 2
    moves, share = [], 1.0
    for count, words in asked:
        if sloped:
            move = w * (count / m + (words - mean * count) / spread * (size - mean))
        else:
            move = w * (words / (mean * m) if mean else count / m)
        up, down = move > 0, move < 0
        limit = min(((1 - pi[up]) / move[up]).min(initial=1.0), (pi[down] / -move[down]).min(initial=1.0))
        moves.append(move)
        share = min(share, limit)
    return [np.clip(move * share, -pi, 1 - pi) for move in moves]


def _repair(pi: np.ndarray, size: np.ndarray, count: float, words: float) -> np.ndarray:
    """``pi`` with words larger by what ``_tilts`` had to leave, or as it was if they cannot be.

    Units that reach 0 or 1 stop there and the others go on, so the moves' mean is not
    quite zero: this is the price of words that are met.
    """
    start, near = pi, 0.01 * abs(words) + _EPS
    for _ in range(20):
        w = pi * (1 - pi)
        m = w.sum()
        if abs(words) < near and abs(count) < 0.5:
            break
        if m < _EPS:
            return pi if abs(words) < near else start
        mean = (w * size).sum() / m
        spread = (w * (size - mean) ** 2).sum()
        if spread > _EPS * m * max(mean, 1.0) ** 2:
            move = w * (count / m + (words - mean * count) / spread * (size - mean))
        else:
            move = w * (words / (mean * m) if mean else count / m)
        new = np.clip(pi + move, 0.0, 1.0)
        count, words = count - (new - pi).sum(), words - ((new - pi) * size).sum()
        pi = new
    return pi if abs(words) < near else start


def decide(pi: list[float], size: list[float], rng, land: bool) -> list[float]:
    """Flight of a chunk, large units first; with ``land`` every unit ends at 0 or 1."""
    order = sorted(range(len(pi)), key=lambda k: -size[k])
    p, s = np.array([pi[k] for k in order]), np.array([size[k] for k in order], np.float64)
    if not land:
        p = np.array(flight(p.tolist(), s.tolist(), rng))
    lo = 0
    while land and lo < len(p):
        hi = lo + max(1, int(np.count_nonzero(s[lo:] * _TIER >= s[lo])))
        flown = flight(p[lo:hi].tolist(), s[lo:hi].tolist(), rng)
        ways = _landings(flown)
        changes = [np.array(flown) - np.array(landed) for _, landed in ways]
        moves = _tilts(p[hi:], s[hi:], [(c.sum(), (c * s[lo:hi]).sum()) for c in changes])
        way = int(np.searchsorted(np.cumsum([c for c, _ in ways])[:-1], rng.random(), side="right"))
        tilted = p[hi:] + moves[way]
        left = changes[way].sum() - moves[way].sum(), (changes[way] * s[lo:hi]).sum() - (moves[way] * s[hi:]).sum()
        p[lo:hi], p[hi:] = ways[way][1], _repair(tilted, s[hi:], *left)
        lo = hi
    out = [0.0] * len(pi)
    for k, x in zip(order, p.tolist()):
        out[k] = x
    return out


def _fly(table: pa.Table) -> pa.Table:
    table = table.sort_by([("size", "descending"), ("_p", "ascending")])
    seed = table.column("_draw")[0].as_py() if table.num_rows else 0
    rng = np.random.default_rng(seed & 0x7FFFFFFFFFFFFFFF)
    size = [float(x) for x in table.column("size").to_pylist()]
    moved = decide(table.column("_pi").to_pylist(), size, rng, bool(table.column("_land")[0].as_py()))
    return table.set_column(table.column_names.index("_pi"), "_pi", pa.array(moved, pa.float64()))


def cube_mix(
    rows: DataFrame,
    share: float = SHARE,
    most: float = MOST,
    weights: tuple[float, ...] = WEIGHTS,
    seed: int = 17,
    chunk_rows: int = CHUNK_ROWS,
    by: list[str] | None = None,
) -> DataFrame:
    """``rows`` (source, size and any others, read from files) with ``source_size``,
    ``target`` and ``copies``, the number of times the mix takes the row.

    Rows are ordered within their source by a seeded hash of the columns ``by`` (all
    columns where not given), so the outcome does not depend on how the input is
    partitioned. Columns of the three names are replaced. Null sources are one source; repeated rows are
    separate units; rows of a source without words are not taken.
    """
    rows = rows.drop("source_size", "target", "copies")
    kept = rows.columns
    h = F.xxhash64(F.lit(seed), *(by or kept))
    placed, _ = positioned(
        rows.withColumn("_h", h), [F.col("source").asc_nulls_last(), F.col("_h"), *[F.col(c) for c in kept]], "_p", "mix-rows"
    )
    by_source = placed.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"), F.min("_p").alias("_first")
    )
    by_source = settle(by_source, "mix-sizes")
    targets = source_targets(by_source.drop("_first"), share, most, weights)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    t = settle(targets.alias("t").join(by_source.alias("b"), same(targets, by_source)).select("t.*", "b._first").withColumnRenamed("rows", "_rows"), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    state = (
        placed.join(t, same(placed, t)).select(*[placed[c] for c in kept], "_p", "source_size", "target", "_rows", "_first", ratio.alias("_ratio"))
        .withColumn("_base", F.floor("_ratio"))
        .withColumn("_pi", F.col("_ratio") - F.col("_base"))
        .withColumn("_chunk", F.floor((F.col("_p") - F.col("_first")) / chunk_rows))
        .withColumn("_chunks", F.ceil(F.col("_rows") / chunk_rows))
        .drop("_h", "_first", "_rows", "_ratio")
    )
    most_rows = t.agg(F.max("_rows")).first()[0] or 0
    chunks, done, turn = -(-most_rows // chunk_rows), [], 0
    while chunks:
        flown = (
            state.withColumn("_land", F.col("_chunks") == 1)
            .withColumn("_draw", F.xxhash64(F.lit(seed), F.lit(turn), "source", "_chunk"))
        )
        flown = settle(flown.groupBy("source", "_chunk").applyInArrow(_fly, flown.schema), "mix-flight")
        set_ = (F.col("_pi") == 0) | (F.col("_pi") == 1)
        done.append(flown.where(set_).withColumn("copies", (F.col("_base") + F.col("_pi")).cast("int")))
        merge = max(2, chunk_rows // 2)  # a chunk leaves two rows at most
        state = (
            flown.where(~set_)
            .withColumn("_chunk", F.floor(F.col("_chunk") / merge))
            .withColumn("_chunks", F.ceil(F.col("_chunks") / merge))
            .drop("_land", "_draw")
        )
        chunks, turn = (-(-chunks // merge) if chunks > 1 else 0), turn + 1
    columns = [*kept, "source_size", "target", "copies"]
    if not done:
        return state.withColumn("copies", F.lit(0)).select(*columns)
    out = done[0].select(*columns)
    for d in done[1:]:
        out = out.unionByName(d.select(*columns))
    return out


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """Pipeline stage form: the documents of the mix, repeated as often as it takes them.

    Needs ``text`` and ``source``; other columns pass through. Documents without words
    follow the inclusion probability of their source like any other. Copies are decided
    on row names, sources and sizes alone; every text moves once, to its decision, and is
    repeated after that.
    """
    rows, keys = located(docs, "mix-docs")
    content = content_hash(docs).alias("__content")
    sizes = settle(rows.select(*keys, "source", content, word_count("text").alias("size")), "mix-words")
    mix = cube_mix(sizes, by=["__content"], **options).where("copies > 0").select(*keys, F.col("copies").alias("__copies"))
    taken = rejoin(rows, mix, keys).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return taken.select(*docs.columns)
