"""Conversation structure repair: a depth-first branch-and-bound over edits of each run of turns."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import WORD, scratch, small_batches, staged
from .turns import grouped, in_order, runs

#: Where a repaired conversation may stand: at its start, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, DONE = range(4)
#: (state, initial of the next turn): the state after it.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): DONE, (DONE, "u"): USER}
#: Initials of the turns that lead from one state to another, without a row of the input; more never pay.
FILL = {(s, ""): s for s in range(4)} | {(START, "u"): USER, (SYSTEM, "u"): USER, (DONE, "u"): USER, (USER, "a"): DONE, (START, "ua"): DONE, (SYSTEM, "ua"): DONE, (USER, "au"): USER, (DONE, "ua"): DONE}


@dataclass(frozen=True)
class RepairConfig:
    """Costs of the edits, and the most rows that are searched at once; longer conversations are searched in runs."""

    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1
    run: int = 256


#: A row as the search sees it: its role's initial, whether it must go, and whether its text breaks off.
Row = tuple[str, bool, bool]


def suffix_bounds(rows: list[Row], config: RepairConfig) -> list[int]:
    """What rows i and later cost at least, whatever came before.

    Rows that must go cost a deletion, truncated ones what staying costs (a deletion costs more).  Beside that, every
    edit of another row mends two of the places at most where neighbours that could stay clash; a role that is
    neither s, u nor a needs an edit of its own row.
    """
    edit = min(config.rerole, config.insert, max(config.delete - config.truncated, 0))
    bounds, fixed, clashes, odd, after = [0], 0, 0, 0, None
    for initial, gone, broken in reversed(rows):
        if gone:
            fixed += config.delete
        else:
            fixed += min(config.truncated, config.delete) if broken else 0
            known = initial in ("s", "u", "a")
            odd += not known
            if after is not None and known and after in ("s", "u", "a"):
                clashes += initial + after not in ("su", "ua", "au")
            after = initial
        bounds.append(fixed + edit * max(odd, -(-clashes // 2)))
    return bounds[::-1]


def edits(row: Row, state: int, config: RepairConfig):
    """(cost, letters, state after) of every way to treat a row that is met in a state, insertions first."""
    initial, gone, broken = row
    for (begin, filled), middle in FILL.items():
        if begin != state:
            continue
        cost, letters = config.insert * len(filled), "I" * len(filled)
        yield cost + config.delete, letters + "D", middle
        if not gone:
            stay = cost + (config.truncated if broken else 0)
            if (middle, initial) in NEXT:
                yield stay, letters + "K", NEXT[middle, initial]
            for role in "ua":
                if (middle, role) in NEXT:
                    yield stay + config.rerole, letters + "R", NEXT[middle, role]


def search(rows: list[Row], begin: int, goals: dict[int, tuple[int, str]], config: RepairConfig = RepairConfig()) -> tuple[int, str] | None:
    """The least (cost, audit) that leads from a state through all rows to one of goals, which hold what ending there adds.

    A stack holds open nodes (row, state, cost, audit).  A node goes when its cost and the suffix's bound exceed the
    incumbent, when they equal its cost and its audit is already the larger, or when its row and state were reached by a
    better (cost, audit).  An empty stack proves the incumbent.
    """
    bounds, best, table, extra = suffix_bounds(rows, config), None, {(0, begin): (0, "")}, min(g[0] for g in goals.values())
    stack = [(0, begin, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if table[i, state] != (cost, audit):
            continue
        if best is not None and (cost + bounds[i] + extra > best[0] or (cost + bounds[i] + extra == best[0] and audit > best[1][: len(audit)])):
            continue
        if i == len(rows):
            if state in goals:
                found = (cost + goals[state][0], audit + goals[state][1])
                best = found if best is None or found < best else best
            continue
        children = []
        for more, letters, after in edits(rows[i], state, config):
            reached, node = (cost + more, audit + letters), (i + 1, after)
            if node not in table or reached < table[node]:
                table[node] = reached
                children.append((more, letters, after))
        stack += [(i + 1, after, cost + more, audit + letters) for more, letters, after in sorted(children, reverse=True)]
    return best


def goals(config: RepairConfig) -> dict[int, tuple[int, str]]:
    """The states in which a whole conversation may end, with what their last insertions cost."""
    return {START: (0, ""), SYSTEM: (2 * config.insert, "II"), USER: (config.insert, "I"), DONE: (0, "")}


def apply_audit(roles: list[str], texts: list[str], audit: str, begin: int = START) -> tuple[list[tuple[str, str, str]], int]:
    """(edit, role, text) of the turns that an audit makes of rows, and the state after them."""
    out, i, state = [], 0, begin
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        initial = roles[i][:1] if letter == "K" else "a" if state == USER else "u"
        role = roles[i] if letter == "K" else {"u": "user", "a": "assistant"}[initial]
        out.append((letter, role, "" if letter == "I" else texts[i]))
        i, state = i + (letter != "I"), NEXT[state, initial]
    return out, state


#: What a report counts.
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_SUMMARY = "conv string, run long, first_role string, last_role string, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, ways array<struct<a:int,z:int,cost:long,audit:string>>"


def _faults(rows: DataFrame) -> DataFrame:
    """rows of in_order with blank, truncated, digest (of conversation, role and text) and seen: whether an earlier part
    of the conversation has the digest."""
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    rows = rows.withColumns({
        "blank": ~F.col("text").rlike(WORD), "truncated": ~last.isin(".", "!", "?"),
        "digest": F.sha2(F.concat_ws("\n", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.hex("role"), "text"), 256)})
    shared = rows.where("shared")
    first = shared.groupBy("digest").agg(F.min("part").alias("__first"))
    late = shared.select("digest", "part").distinct().join(first, "digest").where("part > __first").select(F.col("digest").alias("__d"), F.col("part").alias("__p"))
    marked = shared.join(late, (F.col("digest") == F.col("__d")) & (F.col("part") == F.col("__p")), "left")
    marked = marked.select(*rows.columns, F.col("__d").isNotNull().alias("seen"))
    return rows.where("NOT shared").withColumn("seen", F.lit(False)).unionByName(marked)


def repair_runs(rows: DataFrame, config: RepairConfig = RepairConfig()) -> DataFrame:
    """Runs of conversations with their rows (roles, texts), what was found in them, and ways: the best (cost, audit)
    from each state a (START alone, if the run begins its conversation for sure) to each state z."""

    def work(batches):
        seen: set[str] = set()
        out, size = [], 0
        for pdf, begins, ends in runs(batches, config.run):
            if begins:
                seen = set()
            shared = bool(pdf["shared"].iloc[0])
            blank = duplicate = truncated = illegal = 0
            roles, texts, turns = list(pdf["role"]), list(pdf["text"]), [int(t) for t in pdf["turn"].dropna()]
            seen_rows: list[Row] = []
            for role, is_blank, cut, digest, earlier in zip(roles, pdf["blank"], pdf["truncated"], pdf["digest"], pdf["seen"]):
                again = not is_blank and (earlier or digest in seen)
                seen.add(digest)
                broken = not is_blank and not again and bool(cut)
                blank, duplicate, truncated = blank + bool(is_blank), duplicate + again, truncated + broken
                illegal += bool(seen_rows) and seen_rows[-1][0] + role[:1] not in ("su", "ua", "au")
                seen_rows.append((role[:1], bool(is_blank) or again, broken))
            ways = []
            for a in (START,) if begins and not shared else range(4):
                if begins and ends and not shared:
                    found = search(seen_rows, a, goals(config), config)
                    ways.append({"a": a, "z": -1, "cost": found[0], "audit": found[1]})
                    continue
                for z in range(4):
                    found = search(seen_rows, a, {z: (0, "")}, config)
                    if found is not None:
                        ways.append({"a": a, "z": z, "cost": found[0], "audit": found[1]})
            out.append({
                "conv": pdf["conv"].iloc[0], "run": int(pdf["at"].iloc[0]), "first_role": roles[0][:1], "last_role": roles[-1][:1],
                "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "turns": len(set(turns)),
                "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal, "ways": ways, "roles": roles, "texts": texts})
            size += sum(map(len, texts))
            if len(out) >= 500 or size >= 4_000_000:
                yield pd.DataFrame(out).astype({"first_turn": "Int64", "last_turn": "Int64"})
                out, size = [], 0
        if out:
            yield pd.DataFrame(out).astype({"first_turn": "Int64", "last_turn": "Int64"})

    wanted = ["part", "at", "shared", "role", "text", "blank", "truncated", "digest", "seen"]
    return grouped(_faults(rows)).select(*[F.col(f"{c}").cast("string").alias(n) for c, n in (("conv_id", "conv"), ("turn", "turn"))], *wanted).mapInPandas(work, f"{_SUMMARY}, roles array<string>, texts array<string>")


def _joined(pieces: list, config: RepairConfig) -> dict:
    """One conversation's result from the summaries of its runs, in order, and what the audit does with each run.

    On the way audits hold the state after each run.  Every audit of some runs has as many letters of rows as they have
    rows, and insertions come before the row's letter, so two audits never differ there first, and the least of a whole
    is made of least parts.
    """
    out = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    turns, first, last, role, ways = 0, None, None, None, {START: (0, "")}
    for p in pieces:
        for name in ("blank", "duplicate", "truncated", "illegal"):
            out[name] += p[name]
        out["illegal"] += role is not None and role + p["first_role"] not in ("su", "ua", "au")
        role = p["last_role"]
        if p["turns"]:
            turns += p["turns"] - (last is not None and last == p["first_turn"])
            first, last = p["first_turn"] if first is None else first, p["last_turn"]
        reached: dict[int, tuple[int, str]] = {}
        for w in p["ways"]:
            if w["a"] in ways:
                cost, audit = ways[w["a"]]
                found = (cost + w["cost"], f"{audit}{w['audit']}{max(w['z'], 0)}")
                reached[w["z"]] = min(found, reached.get(w["z"], found))
        ways = reached
    ends = {-1: (0, "")} | goals(config)
    cost, audit = min((c + ends[z][0], a + ends[z][1]) for z, (c, a) in ways.items())
    parts = re.findall(r"([DIKR]*)([0-3])", audit)
    letters = [x for x, _ in parts]
    letters[-1] += audit[audit.rindex(parts[-1][1]) + 1 :]
    steps = [{"run": int(p["run"]), "a": a, "letters": x} for p, a, x in zip(pieces, [START, *[int(z) for _, z in parts]], letters)]
    return out | {"gaps": int(last - first + 1 - turns) if turns else 0, "cost": cost, "audit": "".join(letters), "steps": steps}


def repair_conversations(conversations: DataFrame, config: RepairConfig = RepairConfig()) -> tuple[DataFrame, DataFrame]:
    """(reports, turns) of conversations (conv_id, turn, role, text), whose roles become s?(ua)+ at the least cost.

    reports, one row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit.  turns: conv_id, run, k, edit,
    role, text of the repaired conversations, in the order of run and k.

    Kept turns are free, a new role, a deletion and an inserted empty turn cost as configured; blank turns and repeated
    ones (role and text seen earlier in the conversation) must be deleted, and a truncated turn that stays costs 1.  Of
    equal costs the audit (K, R, D, I in order) that is least in ASCII wins.

    Rows are taken by turn, NULLs first, ties by role and then by a hash of the text.  A NULL role or text counts as one
    space; a NULL conv_id is a conversation of its own; an empty table gives two empty ones; other columns are ignored.
    No task holds more of a conversation than its run: longer ones are searched in runs, once for each state that a run
    can begin and end in, and their (cost, audit) pairs are added up along the conversation.
    """
    spark = conversations.sparkSession
    ship_package(spark)
    plain = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    with small_batches(spark, 2000), scratch(spark):
        found = staged(repair_runs(in_order(plain), config), "repair-runs", keep=True)
        piece = F.struct("run", *[F.col(c) for c in found.columns if c not in ("conv", "run", "roles", "texts")])
        whole = found.groupBy("conv").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))

        def fold(batches):
            for pdf in batches:
                out = pd.DataFrame([_joined(list(pieces), config) for pieces in pdf["pieces"]], columns=[*COUNTS, "audit", "steps"])
                out.insert(0, "conv", pdf["conv"].to_numpy())
                yield out

        folded = whole.mapInPandas(fold, f"conv string, {', '.join(f'{c} long' for c in COUNTS)}, audit string, steps array<struct<run:long,a:int,letters:string>>")
        folded = staged(folded, "repairs", keep=True)

    def turned(batches):
        for pdf in batches:
            rows = []
            for conv, run, roles, texts, a, letters in zip(pdf["conv"], pdf["run"], pdf["roles"], pdf["texts"], pdf["a"], pdf["letters"]):
                rows += [(conv, run, k, *turn) for k, turn in enumerate(apply_audit(list(roles), list(texts), letters, a)[0])]
            yield pd.DataFrame(rows, columns=["conv", "run", "k", "edit", "role", "text"])

    each = folded.select("conv", F.explode("steps").alias("e")).select("conv", "e.run", "e.a", "e.letters")
    made = found.select("run", "roles", "texts").join(each, "run").mapInPandas(turned, "conv string, run long, k long, edit string, role string, text string")
    named = lambda df, *columns: df.select(F.col("conv").cast("long").alias("conv_id"), *columns)
    return named(folded, *COUNTS, "audit"), named(made, "run", "k", "edit", "role", "text")


def damage(conversations: DataFrame) -> DataFrame:
    """conversations with faults that a hash of conv_id and turn picks: a turn is dropped, emptied, loses its ends of
    sentences, is repeated, or becomes the user's.  NULLs count as one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20).alias("fault"))
    rows = rows.where("fault <> 0").withColumns({
        "text": F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
        "role": F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))})
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def repaired_digest(originals: DataFrame, reports: DataFrame, turns: DataFrame) -> DataFrame:
    """reports, with zeros for the conversations of originals that have no rows left, and repaired_sha256."""
    said = turns.groupBy("conv_id", "run").agg(F.sort_array(F.collect_list(F.struct("k", F.concat("role", F.lit(":"), "text").alias("said")))).alias("lines"))
    said = said.select("conv_id", "run", F.array_join(F.transform("lines", lambda x: x["said"]), "\n").alias("said"))
    rows = originals.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select("conv_id", F.lit(None).cast("long").alias("run"), F.lit(None).cast("string").alias("said"))
    rows = rows.unionByName(said).unionByName(reports, allowMissingColumns=True)
    lines = F.transform(F.sort_array(F.collect_list(F.when(F.col("run").isNotNull(), F.struct("run", "said")))), lambda x: x["said"])
    out = rows.groupBy("conv_id").agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in COUNTS], F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.array_join(lines, "\n").alias("said"))
    return out.select("conv_id", *COUNTS, "audit", F.sha2("said", 256).alias("repaired_sha256"))
