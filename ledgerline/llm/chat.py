"""Chat formatting with incremental black-box rendering.

A template is any callable from a list of (role, text) to a string. `format_conversation` renders each prefix of the
turns and compares consecutive outputs: the part that turn k added is its span. A template that changes what it had
already written rewrites history; its spans can't be located, so the conversation is flagged and its loss mask is empty.
Inside a span the text's own place is found by rendering the same prefix with two probe texts and comparing the three
outputs from both ends, again without looking into the template.

The default template marks turns with control strings and escapes those inside texts: a backslash goes after the opening
bracket of anything that looks like a control string, with or without backslashes, and `unescape` takes one away.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import common as C

Template = Callable[[list[tuple[str, str]]], str]

CONTROL = re.compile(r"([\[<])(\\*)(/?(?:INST|ROLE|NAME|s)[\]>])")
ESCAPED = re.compile(r"([\[<])\\(\\*)(/?(?:INST|ROLE|NAME|s)[\]>])")
#: Turns as the default template writes them, texts and names escaped.
TURN = re.compile(r"\[INST\] (.*?) \[/INST\]|<s>(.*?)</s>|\[ROLE\](.*?)\[NAME\](.*?)\[/ROLE\]", re.S)


@lru_cache(4096)
def _escape_short(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def escape(text: str) -> str:
    """Short texts are remembered, as each is rendered once for every later turn; long ones aren't, to bound memory."""
    return _escape_short(text) if len(text) <= 4096 else CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def default_template(turns: list[tuple[str, str]]) -> str:
    """Users in [INST], assistants in <s>, any other role by name."""
    out = []
    for role, text in turns:
        if role == "user":
            out.append(f"[INST] {escape(text)} [/INST]")
        elif role == "assistant":
            out.append(f"<s>{escape(text)}</s>")
        else:
            out.append(f"[ROLE]{escape(role)}[NAME]{escape(text)}[/ROLE]")
    return "".join(out)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of an output of default_template. Anything that it can't have written raises."""
    turns, at = [], 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text between turns")
        at = m.end()
        if m[1] is not None:
            turns.append(("user", unescape(m[1])))
        elif m[2] is not None:
            turns.append(("assistant", unescape(m[2])))
        else:
            turns.append((unescape(m[3]), unescape(m[4])))
    if at != len(formatted):
        raise ValueError("text after the last turn")
    return turns


def _common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] agrees, a[:hi] doesn't
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _common_suffix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    k = 0
    while k < n and a[-1 - k] == b[-1 - k]:
        k += 1
    return k


#: Two probes that share no first and no last character, and that no template treats as markup or white space.
PROBES = ("\ue000", "\uf8ff")


def text_place(template: Template, before: list[tuple[str, str]], role: str, whole: str, start: int) -> tuple[int, int]:
    """Where the last turn's text is written in `whole`, the rendering of before and that turn; start: its span's start."""
    x, y = (template([*before, (role, p)])[start:] for p in PROBES)
    head, tail = _common_prefix(x, y), _common_suffix(x, y)
    return start + head, len(whole) - tail


def format_conversation(turns: list[tuple[str, str]], template: Template = default_template, learn: str = "assistant") -> dict:
    """formatted, spans [(start, end)] of turns, loss [(start, end)] of the texts of `learn` turns, rewrites.

    rewrites counts prefixes whose rendering doesn't begin with the one before; if any, spans and loss are empty. A
    template that drops or alters a text still has spans; its loss runs are what it wrote.
    """
    spans, loss, rewrites, last = [], [], 0, template([])
    for k, (role, text) in enumerate(turns):
        now = template(turns[: k + 1])
        if not now.startswith(last):
            rewrites += 1
        spans.append((len(last), len(now)))
        if role == learn and not rewrites:
            loss.append(text_place(template, turns[:k], role, now, len(last)))
        last = now
    return {"formatted": last, "spans": [] if rewrites else spans, "loss": [] if rewrites else loss, "rewrites": rewrites}


FORMATTED = "conv_id long, formatted string, spans array<struct<start:int,end:int>>, loss array<struct<start:int,end:int>>, rewrites int"


def format_chats(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: Template = default_template) -> DataFrame:
    """One row per conversation: conv_id, formatted, spans, loss, rewrites.

    Turns go by turn, then role and text, so ties and repeated rows have one order; a null turn comes first, null roles
    and texts are empty, null ids are one conversation. Extra columns don't matter. A conversation is one unit of work:
    it must fit a task, as it must fit a training example.
    """
    src = rows.select(F.col(f"`{id_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    # sorted rows, not gathered groups: a task holds one conversation at a time
    dealt = src.repartition(C.parts(rows.sparkSession, C.text_bytes(src, "text")), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    pair = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, out = [], (), []

        def flush() -> pa.RecordBatch:
            made = [(c, format_conversation(t, template)) for c, t in out]
            runs = lambda key: pa.array([[{"start": a, "end": b} for a, b in m[key]] for _, m in made], pair)
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in made], pa.int64()), pa.array([m["formatted"] for _, m in made], pa.string()), runs("spans"), runs("loss"), pa.array([m["rewrites"] for _, m in made], pa.int32())], names=["conv_id", "formatted", "spans", "loss", "rewrites"])

        size = 0
        for b in batches:
            for c, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if (c,) != last:
                    if last:
                        out.append((last[0], held))
                    held, last = [], (c,)
                    if size > 1 << 20 and out:
                        yield flush()
                        out, size = [], 0
                held.append((role, text))
                size += len(text)
        if last:
            out.append((last[0], held))
            yield flush()

    return dealt.mapInArrow(run, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites int"


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from format_chats with the default template: turns, and the text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                turns = read_back(r["formatted"])
                whole = "".join(f"{role}\n{text}\n" for role, text in turns)
                learnt = "".join(unescape(r["formatted"][x["start"] : x["end"]]) for x in r["loss"])
                out.append((r["conv_id"], len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(r["formatted"]), r["rewrites"]))
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"])

    return formatted.mapInArrow(run, DIGEST)
