"""Quality rules kept as a ledger of failure bits, on which versioned policies are applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, word_array

#: Words in a window that is looked for twice.
WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"

#: (rule, failing condition over the measurements). The place of a rule is its bit and never changes.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_text_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
]
BASE = ("few_words", "repeated_windows")
#: Versioned policies: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "repeated_lines", "short_words", "long_words"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_text_lines", "n_repeat_words")


def mask(policy: str | tuple[str, ...]) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    place = {name: 1 << k for k, (name, _) in enumerate(RULES)}
    return sum(place[n] for n in set(names))


def _window(words: Column, at: Column) -> list[Column]:
    return [F.get(words, at + k) for k in range(WINDOW)]


def _twins(items: Column, field: str) -> Column:
    """Of a sorted array of structs, those that share the field with a neighbour."""
    same = lambda x, y: F.coalesce(x[field] == y[field], F.lit(False))
    return F.filter(items, lambda x, k: same(x, F.get(items, k - 1)) | same(x, F.get(items, k + 1)))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to carry, and the measurements of each text, all inside the row: nothing is shuffled.

    Repeated windows are found by sorting hashes of the windows, and only windows whose hash occurs twice are
    compared by their words.
    """
    c = F.col
    text = F.coalesce(F.col(text_col), F.lit(""))
    has_word = lambda line: F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) != ""
    own = ["doc_id", *carry]
    a = docs.select(F.col(id_col).alias("doc_id"), *carry, text.alias("t")).select(
        *own, word_array(c("t")).alias("w"), F.regexp_count(c("t"), F.lit(SYMBOLS)).alias("s"),
        F.filter(F.split("t", "\n"), has_word).alias("l"),
    )
    n = F.size("w")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    b = a.select(*own, "w", "s", "l", F.transform(starts, lambda i: F.xxhash64(*_window(c("w"), i))).alias("h"))
    pairs = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    b = b.select(*own, "w", "s", "l", F.when(F.size(F.array_distinct("h")) < F.size("h"), pairs).alias("p"))
    exact = F.transform(_twins(c("p"), "h"), lambda p: F.struct(F.concat_ws(" ", *_window(c("w"), p["i"])).alias("s"), p["i"].alias("i")))
    b = b.select(*own, "w", "s", "l", F.sort_array(exact).alias("x"))
    b = b.select(*own, "w", "s", "l", F.sort_array(F.transform(_twins(c("x"), "s"), lambda x: x["i"])).alias("at"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda s, i: F.struct((i + WINDOW).alias("end"), (s["n"] + i + WINDOW - F.greatest(i, s["end"])).alias("n"))
    covered = F.coalesce(F.aggregate("at", zero, step, lambda s: s["n"]), F.lit(0))
    long = lambda x, name: x.cast("long").alias(name)
    return b.select(
        *own, long(n, "n_words"), long(F.char_length(F.array_join("w", "")), "word_chars"), long(c("s"), "n_symbols"),
        long(F.size("l") - F.size(F.array_distinct("l")), "n_dup_lines"), long(F.size("l"), "n_text_lines"),
        long(covered, "n_repeat_words"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to carry, the measurements and fail_bits, as a written table: every rule is evaluated once, however many
    policies and filters follow.

    NULL text has no words; a NULL id is kept; repeated rows have a row each; an empty table gives an empty
    ledger; other columns are ignored.
    """
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, rule) in enumerate(RULES)]
    total = bits[0]
    for x in bits[1:]:
        total = total.bitwiseOR(x)
    return staged(measure(docs, id_col, text_col, carry).withColumn("fail_bits", total.cast("long")), "ledger")


def passes(bits: Column, policy: str | tuple[str, ...] = "v1") -> Column:
    return bits.bitwiseAND(F.lit(mask(policy))) == 0


def ablation(book: DataFrame, policy: str | tuple[str, ...] = "v1") -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail only it, and that pass once it is left out."""
    m = mask(policy)
    counts = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m)).alias("b")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << k).alias("bit")) for k, (name, _) in enumerate(RULES) if m >> k & 1])
    each = counts.select("b", "n", F.explode(rules).alias("r")).select("b", "n", "r.rule", F.col("r.bit").cast("long").alias("bit"))
    hit = F.col("b").bitwiseAND(F.col("bit"))
    return each.groupBy("rule").agg(
        F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("b") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when((F.col("b") - hit) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def quality_rules(docs: DataFrame, policy: str = "v1", id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The ledger with base_failed and kept under a policy."""
    book = ledger(docs, id_col, text_col, carry)
    return book.select("*", (~passes(F.col("fail_bits"), BASE)).alias("base_failed"), passes(F.col("fail_bits"), (*BASE, *POLICIES[policy])).alias("kept"))
