"""Chat formatting with spans located by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. It is rendered
for each prefix of a conversation; what a turn adds to the output is its span, and a
template whose output does not start with the output before has rewritten history.
Where a turn's text lies within its span is found by rendering it with a marker instead.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
_CONTROL = re.compile(r"\\|" + "|".join(re.escape(c) for c in CONTROLS))
_PROBE = "{}"  # stands for a turn's text while its place is looked for


def escape(text: str) -> str:
    """Doubles backslashes and puts one after the first character of a control string."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def inst_template(turns: list[Turn]) -> str:
    """``<s>[INST] role [/INST] text</s>`` per turn, with role and text escaped."""
    return "".join(f"<s>[INST] {escape(role)} [/INST] {escape(text)}</s>" for role, text in turns)


class Span:
    """Code point offsets of a turn and of its text in the formatted conversation."""

    __slots__ = ("start", "end", "text_start", "text_end")

    def __init__(self, start: int, end: int, text_start: int | None, text_end: int | None):
        self.start, self.end, self.text_start, self.text_end = start, end, text_start, text_end


def locate(turns: list[Turn], template: Template) -> tuple[str, list[Span], int | None]:
    """The formatted conversation, a span per turn, and the first turn that rewrote history.

    From a rewriting turn on, spans are those of the last output's common prefix: a turn
    whose span was changed later has text offsets of None, so it is never trained on.
    """
    before, spans, rewrote = "", [], None
    for k in range(len(turns)):
        out = template(turns[: k + 1])
        start = len(before)
        if not out.startswith(before):
            rewrote = k if rewrote is None else rewrote
            start = _common(before, out)
            for s in spans:
                if s.end > start:
                    s.start, s.end, s.text_start, s.text_end = min(s.start, start), min(s.end, start), None, None
        mark, n = _PROBE.format(""), 0
        while mark in out:
            mark, n = _PROBE.format(n), n + 1
        probe = template([*turns[:k], (turns[k][0], mark)])
        head = probe.find(mark, start)
        tail = len(probe) - head - len(mark)
        found = head >= start and out[:head] == probe[:head] and probe.count(mark, start) == 1
        found = found and head + tail <= len(out) and out[len(out) - tail :] == probe[len(probe) - tail :]
        spans.append(Span(start, len(out), head if found else None, len(out) - tail if found else None))
        before = out
    return before, spans, rewrote


def _common(a: str, b: str) -> int:
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


_SPAN = T.StructType(
    [
        T.StructField("role", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("text_start", T.LongType()),
        T.StructField("text_end", T.LongType()),
    ]
)
_OUT = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("formatted", T.StringType()),
        T.StructField("spans", T.ArrayType(_SPAN)),
        T.StructField("rewrote_at", T.IntegerType()),
    ]
)
_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("formatted", pa.string()),
        ("spans", pa.list_(pa.struct([("role", pa.string()), *[(n, pa.int64()) for n in ("start", "end", "text_start", "text_end")]]))),
        ("rewrote_at", pa.int32()),
    ]
)


def format_conversations(turns: DataFrame, template: Template = inst_template) -> DataFrame:
    """One row per conversation: conv_id, formatted, spans, rewrote_at.

    ``turns`` has conv_id, turn, role, text. Turns are ordered by ``turn`` (null first),
    equal ones by role and text; repeated rows are repeated turns. Null roles and texts
    are empty; rows without conv_id make one conversation without id. Rows are dealt out
    by conv_id and streamed in order: a task holds one conversation, which the template
    needs whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []

        def close():
            text, spans, rewrote = locate(held, template)
            rows = [
                {"role": r, "start": s.start, "end": s.end, "text_start": s.text_start, "text_end": s.text_end}
                for (r, _), s in zip(held, spans)
            ]
            out.append({"conv_id": now, "formatted": text, "spans": rows, "rewrote_at": rewrote})

        for batch in batches:
            for conv, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
                if held and conv != now:
                    close()
                    held = []
                    if len(out) >= 500:
                        yield pa.RecordBatch.from_pylist(out, _ARROW)
                        out = []
                now = conv
                held.append((role, text))
        if held:
            close()
        yield pa.RecordBatch.from_pylist(out, _ARROW)

    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.mapInArrow(run, _OUT)


_BLOCK = r"(?s)^<s>\[INST\] (.*?) \[/INST\] (.*)</s>$"


def _unescaped(c) -> F.Column:
    return F.regexp_replace(c, r"\\(\\?)", "$1")


def read_back(formatted: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Adds what the formatted text itself says: ``turns`` (role, text) and ``loss_text``.

    Turns are read from the marks of ``inst_template``; ``loss_text`` is the unescaped
    text under the loss mask, that is under the text spans of ``trained_role``.
    """
    blocks = F.regexp_extract_all("formatted", F.lit(r"(?s)<s>\[INST\] .*?</s>"), F.lit(0))
    turns = F.transform(
        blocks,
        lambda b: F.struct(
            _unescaped(F.regexp_extract(b, _BLOCK, 1)).alias("role"), _unescaped(F.regexp_extract(b, _BLOCK, 2)).alias("text")
        ),
    )
    masked = F.filter("spans", lambda s: (s["role"] == trained_role) & s["text_start"].isNotNull())
    cut = F.transform(
        masked,
        lambda s: _unescaped(
            F.col("formatted").substr((s["text_start"] + 1).cast("int"), (s["text_end"] - s["text_start"]).cast("int"))
        ),
    )
    return formatted.withColumn("turns", turns).withColumn("loss_text", F.array_join(cut, ""))
