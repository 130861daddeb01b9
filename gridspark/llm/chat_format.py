"""Chat formatting: a template is rendered on growing prefixes of a conversation, and outputs that follow one another
tell where each turn lies and whether the template rewrites what it said before."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import scratch, small_batches, staged
from .turns import grouped, in_order, runs

# Control strings of the template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[TURN:", "[/TURN]")
_ESCAPED = re.compile(r"\\|" + "|".join(map(re.escape, CONTROLS)))
_TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|\[TURN:(?P<role>(?:\\.|[^\\\]])*)\] (?P<other>.*?) \[/TURN\]|<s>(?P<assistant>.*?)</s>", re.S)


def escape(text: str) -> str:
    """text in which no control string is left: a backslash after the first character breaks it, and backslashes double."""
    return _ESCAPED.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    """escape undone."""
    return re.sub(r"\\(\\)|\\(?!\\)", lambda m: m[1] or "", text)


def render(turns: list[tuple[str, str]]) -> str:
    """The template of the registered query: users ask between [INST] and [/INST], assistants answer up to </s>."""
    out = []
    for role, text in turns:
        if role == "user":
            out.append(f"[INST] {escape(text)} [/INST]")
        elif role == "assistant":
            out.append(f"<s>{escape(text)}</s>")
        else:
            name = re.sub(r"([\\\]])", r"\\\1", role)
            out.append(f"[TURN:{name}] {escape(text)} [/TURN]")
    return "".join(out)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted conversation."""
    out = []
    for m in _TURN.finditer(formatted):
        if m["user"] is not None or m["assistant"] is not None:
            role = "user" if m["user"] is not None else "assistant"
            out.append((role, unescape(m[role])))
        else:
            out.append((re.sub(r"\\(.)", r"\1", m["role"], flags=re.S), unescape(m["other"])))
    return out


@dataclass(frozen=True)
class ChatTemplate:
    """A template as a black box: turns, as (role, text), to the formatted conversation.

    context says how many turns before a turn its own part of the output depends on; None: on all of them.  It bounds
    what has to be rendered again for one more turn; rendered checks it where turns begin a conversation.
    """

    render: Callable[[list[tuple[str, str]]], str] = render
    context: int | None = 1
    learned: tuple[str, ...] = ("assistant",)
    #: Two texts without control strings, equal in no character, that show where a turn's text begins and ends.
    probes: tuple[str, str] = field(default=("a", "b"))


def shared_prefix(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def located(before: str, after: str) -> tuple[int, int, bool]:
    """(start, end, rewritten): one more turn made `after` of `before`; its span is after[start:end].

    A template may close its output with text that moves behind each new turn, which is no turn's.  If the old output,
    without such an end, does not begin the new one, the template rewrote its history.
    """
    same = shared_prefix(before, after)
    end = before[same:]
    if not after.endswith(end) or len(after) - len(end) < same:
        return same, len(after), True
    return same, len(after) - len(end), False


def rendered(turns: list[tuple[str, str]], lead: list[tuple[str, str]], template: ChatTemplate) -> dict:
    """piece: the part of the output that turns make behind lead; spans: role, start, end, text_start, text_end in it;
    rewritten: whether any turn changed what was there before."""
    before, spans, rewritten, base = template.render(lead) if lead else "", [], False, 0
    for k, (role, text) in enumerate(turns):
        so_far = lead + turns[:k]
        after = template.render([*so_far, (role, text)])
        start, end, changed = located(before, after)
        base = start if k == 0 else base
        rewritten |= changed
        # The same turn with two texts that share nothing: what stands before and after them is not the text's.
        x, y = (template.render([*so_far, (role, probe)]) for probe in template.probes)
        head, tail = shared_prefix(x, y), shared_prefix(x[::-1], y[::-1])
        if lead and (end < len(after) or changed):
            raise ValueError("a template that closes its output or rewrites it has no bounded context: set context=None")
        spans.append((role, start, end, head, len(after) - tail))
        before = after
    if template.context and not lead and len(turns) > template.context + 1 and not rewritten:
        near = template.render(turns[-1 - template.context : -1])
        _, start, end, *_ = spans[-1]
        if near + before[start:end] != template.render(turns[-1 - template.context :]):
            raise ValueError(f"the template's context is longer than {template.context}")
    moved = [{"role": role, "start": s - base, "end": e - base, "text_start": a - base, "text_end": b - base, "learned": role in template.learned} for role, s, e, a, b in spans]
    return {"piece": before[base:], "spans": moved, "rewritten": rewritten}


def _with_leads(rows: DataFrame, depth: int) -> DataFrame:
    """rows of in_order with lead: false; and, for each part that goes on with a conversation, the conversation's last
    turns before it once more, with lead: true."""
    shared = rows.where("shared")
    back = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.col("at").desc()))
    tails = shared.withColumn("__back", back).where(F.col("__back") <= depth)
    # At most depth rows a part, and a shared conversation has fewer parts than there are ranges.
    tails = tails.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text"))).alias("tails"))
    begins = shared.groupBy(F.col("conv_id").alias("__conv"), "part").agg(F.min("at").alias("__from"))
    earlier = F.filter("tails", lambda x: x["at"] < F.col("__from"))
    leads = begins.join(tails, F.col("__conv").eqNullSafe(F.col("conv_id"))).select("conv_id", "part", F.explode(F.slice(F.reverse(earlier), 1, depth)).alias("l"))
    leads = leads.select("conv_id", "part", "l.at", "l.role", "l.text", F.lit(True).alias("lead"))
    return rows.select("conv_id", "part", "at", "role", "text", F.lit(False).alias("lead")).unionByName(leads)


_SPANS = "array<struct<role:string,start:long,end:long,text_start:long,text_end:long,learned:boolean>>"


def format_chats(conversations: DataFrame, template: ChatTemplate = ChatTemplate(), most: int = 32) -> DataFrame:
    """conv_id, run, piece, spans (role, start, end, text_start, text_end, learned), rewritten.

    The pieces of a conversation, in the order of run, make its formatted text; spans are code points in the piece, and
    the texts of learned ones make the loss mask.  If a template rewrites history, the piece is its last output, and the
    spans of turns before the change do not hold: rewritten says so.

    Rows are taken by turn, NULLs first, ties by role and then by a hash of the text.  A NULL role or text counts as empty;
    a NULL conv_id is a conversation of its own; an empty table gives an empty one; other columns are ignored.
    With a known context a conversation is rendered in runs of `most` turns, each behind the turns of its context, so a
    long one costs no more a turn than a short one and is dealt to several tasks; without, it is rendered as a whole.
    """
    spark = conversations.sparkSession
    ship_package(spark)
    plain = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    depth = template.context

    def work(batches):
        out, size, before = [], 0, []
        for pdf, begins, _ in runs(batches, most if depth else 1 << 60):
            turns = list(zip(pdf["role"], pdf["text"]))
            n = int(pdf["lead"].sum())
            before = [] if begins else before
            lead = (before + turns[:n])[-depth:] if depth else []
            if n < len(turns):
                out.append({"conv": pdf["conv"].iloc[0], "run": int(pdf["at"].iloc[n]), **rendered(turns[n:], lead, template)})
                size += len(out[-1]["piece"])
            before = (before + turns)[-depth:] if depth else []
            if len(out) >= 500 or size >= 4_000_000:
                yield pd.DataFrame(out)
                out, size = [], 0
        if out:
            yield pd.DataFrame(out)

    with small_batches(spark, 2000), scratch(spark):
        rows = in_order(plain)
        if depth:
            rows = _with_leads(rows, depth)
        else:
            whole = F.when(F.col("shared"), F.lit(-1).cast("long")).otherwise(F.col("part"))
            rows = rows.select("conv_id", whole.alias("part"), "at", "role", "text", F.lit(False).alias("lead"))
        named = grouped(rows).select(F.col("conv_id").cast("string").alias("conv"), "part", "at", "role", "text", "lead")
        made = staged(named.mapInPandas(work, f"conv string, run long, piece string, spans {_SPANS}, rewritten boolean"), "chats", keep=True)
    return made.select(F.col("conv").cast("long").alias("conv_id"), "run", "piece", "spans", "rewritten")


def chat_digest(pieces: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives, one row each: n_turns and turns_sha256 by the template's marks,
    loss_chars and loss_sha256 by the loss mask, formatted_chars.

    A digest of a conversation needs its whole text in order, so this, unlike format_chats, holds one conversation at a time.
    """

    def work(batches):
        for pdf in batches:
            rows = []
            for conv, parts in zip(pdf["conv"], pdf["pieces"]):
                formatted = "".join(p["piece"] for p in parts)
                turns = read_turns(formatted)
                loss = "".join(unescape(p["piece"][s["text_start"] : s["text_end"]]) for p in parts for s in p["spans"] if s["learned"])
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                digest = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((conv, len(turns), digest(said), len(loss), digest(loss), len(formatted)))
            yield pd.DataFrame(rows, columns=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    whole = pieces.groupBy(F.col("conv_id").cast("string").alias("conv")).agg(F.sort_array(F.collect_list(F.struct("run", "piece", "spans"))).alias("pieces"))
    out = whole.mapInPandas(work, "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.select(F.col("conv").cast("long").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
