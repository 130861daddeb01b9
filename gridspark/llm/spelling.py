"""Spelling variants: an index of variable-length grams finds all words at edit distance one, frequent forms absorb rare ones."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import ascii_lower, attach_group, scratch, small_batches, staged

#: Letters of words: runs of any of these.
LETTERS = r"A-Za-zÀ-ÿ"


@dataclass(frozen=True)
class SpellingConfig:
    """least: letters and occurrences that a word has at least; factor: how much more frequent a form is than its variant.

    A gram of `short` letters is in the dictionary; one letter more is, while the gram without it is frequent: at more
    than `frequent` places of the vocabulary, or a 65,536th of all places if that is more.  So fewer than 65,536 grams of
    each length are frequent, however large the vocabulary grows, and those are what tasks get to decompose words.
    """

    letters: int = 7
    least: int = 2
    factor: int = 10
    short: int = 2
    long: int = 5
    frequent: int = 2000
    share: int = 65_536


def damaged_words(docs: DataFrame, config: SpellingConfig = SpellingConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word: each run of letters of each text, A-Z lowered, with a letter lost in the runs that a hash of id and run picks.

    Runs that are too short to give a word of the least length are left out.  A NULL id counts as empty.
    """
    run = F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(f"([{LETTERS}]{{{config.letters},}})"), F.lit(1)))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), run.alias("run")).select("id", ascii_lower(F.col("run")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    lost = F.pmod(F.col("h"), F.length("run")).cast("int")
    less = F.concat(F.substr("run", F.lit(1), lost), F.substr("run", lost + 2))
    return rows.select("run", h.alias("h")).select(F.when(F.col("h") % 31 == 0, less).otherwise(F.col("run")).alias("word"))


def frequent_grams(words: DataFrame, config: SpellingConfig = SpellingConfig()) -> set[str]:
    """The grams of short to long - 1 letters that are frequent in the distinct words; their number is bounded by share."""
    places = words.agg(F.sum(F.length("word"))).first()[0] or 0
    limit = max(config.frequent, math.ceil(places / config.share))
    of = lambda q: F.transform(F.sequence(F.lit(1), F.length("word") - q + 1), lambda i: F.substr("word", i, F.lit(q)))
    every = words.where(F.length("word") >= config.long).select(F.explode(F.flatten(F.array(*map(of, range(config.short, config.long))))).alias("gram"))
    return {r["gram"] for r in every.groupBy("gram").count().where(F.col("count") > limit).select("gram").collect()}


def decompose(word: str, frequent: set[str] | frozenset[str], config: SpellingConfig = SpellingConfig()) -> list[tuple[int, str]]:
    """(place, gram) of the variable-length grams of a word: at each place the longest gram of the dictionary, unless an
    earlier one covers it."""
    out, covered, n = [], 0, len(word)
    for at in range(n - config.short + 1):
        end = at + config.short
        while end < n and end - at < config.long and word[at:end] in frequent:
            end += 1
        if end > covered:
            out.append((at, word[at:end]))
            covered = end
    return out


def affected(word: str, grams: list[tuple[int, str]], frequent: set[str] | frozenset[str], tails: set[str] | frozenset[str], config: SpellingConfig = SpellingConfig()) -> int:
    """The most grams of a word that one edit can take away.

    An edit of a letter, or in a gap between letters, takes the grams that hold its place.  It can also give rise to a
    longer gram that reaches across its place and covers whole grams beside it: grams on the left, if what stands between
    some place and the edit is frequent; grams on the right, if what follows the edit, but for a last letter, ends a
    frequent gram.  tails are the proper ends of frequent grams.
    """
    most, n = 0, len(word)
    for edit in range(2 * n + 1):
        left, right = edit // 2, (edit + 1) // 2  # an even edit is in a gap, an odd one takes a letter
        starts = range(max(0, left - config.long + 1), left - config.short + 1)
        reach = next((a for a in starts if word[a:left] in frequent), left)
        ends = range(min(n, right + config.long - 1), right + config.short - 1, -1)
        far = next((b for b in ends if word[right : b - 1] in tails), right)
        lost = 0
        for at, gram in grams:
            end = at + len(gram)
            lost += at >= reach if end <= left else end <= far if at >= right else 1
        most = max(most, lost)
    return most


def gram_lists(vocabulary: DataFrame, config: SpellingConfig) -> DataFrame:
    """word, n, length, letters (a bit for each), lost (its affected bound), n_grams, rare (the lost + 1 rarest grams: held
    by so many words, gram, place)."""
    frequent = frozenset(frequent_grams(vocabulary, config))
    tails = frozenset(g[k:] for g in frequent for k in range(1, len(g)))

    def split(batches):
        for pdf in batches:
            rows = []
            for word, n in zip(pdf["word"], pdf["n"]):
                grams = decompose(word, frequent, config)
                letters = 0
                for c in word:
                    letters |= 1 << ord(c) % 63
                rows.append((word, n, len(word), letters, affected(word, grams, frequent, tails, config), [{"at": a, "gram": g} for a, g in grams]))
            yield pd.DataFrame(rows, columns=["word", "n", "length", "letters", "lost", "grams"])

    words = staged(vocabulary.select("word", "n").mapInPandas(split, "word string, n long, length int, letters long, lost int, grams array<struct<at:int,gram:string>>"), "gram-lists")
    each = words.select("word", F.explode("grams").alias("g")).select("word", "g.at", "g.gram")
    held = each.groupBy("gram").agg(F.count("*").alias("held"))
    ranked = attach_group(each, held, "gram", "held", each.count()).groupBy("word").agg(F.sort_array(F.collect_list(F.struct("held", "gram", "at"))).alias("order"))
    return words.join(ranked, "word").select("word", "n", "length", "letters", "lost", F.size("grams").alias("n_grams"), F.slice("order", 1, F.col("lost") + 1).alias("rare"))


def near_words(vocabulary: DataFrame, config: SpellingConfig = SpellingConfig()) -> DataFrame:
    """(word, other, n): both directions of every pair of words of (word, n) at edit distance exactly one; n is other's.

    One edit takes at most `lost` grams of a word, so near words share all the others, at the same place or, behind a
    letter too many, one place on.  Lists of words by length, gram and place are merged only for the lost + 1 rarest grams
    of each word, of which near words share one if one of them has a gram that no edit takes.  A candidate is verified,
    first by its letters (an edit changes two at most), then by its distance.  Words of which one edit can take all grams
    have no bound among themselves: those are compared by what is left after the loss of one letter, in lists that the
    alphabet bounds.
    """
    words = staged(gram_lists(vocabulary, config), "gram-index")
    bounded = F.col("n_grams") > F.col("lost")
    rows = words.select("word", "length", "letters", bounded.alias("bounded"), F.explode("rare").alias("g"))
    place = lambda more, shift: F.xxhash64("g.gram", F.col("g.at") + shift, F.col("length") + more)
    index = rows.select(place(0, 0).alias("key"), "word", "length", "letters", "bounded")
    # A word meets words of its own length, and those with a letter more, before or behind the gram.
    steps = F.array(*[F.struct(place(a, b).alias("key"), F.lit(a).alias("more")) for a, b in ((0, 0), (1, 0), (1, 1))])
    probe = rows.select(F.explode(steps).alias("s"), F.col("word").alias("p_word"), F.col("length").alias("p_length"), F.col("letters").alias("p_letters"), F.col("bounded").alias("p_bounded"))
    probe = probe.select("s.key", "s.more", "p_word", "p_length", "p_letters", "p_bounded")
    merged = index.join(probe, "key").where("length = p_length + more AND (more = 1 OR p_word < word) AND (bounded OR p_bounded)")
    merged = merged.where(F.bit_count(F.col("letters").bitwiseXOR(F.col("p_letters"))) <= 2)
    found = merged.where(F.levenshtein("word", "p_word", 1) == 1).select("word", "p_word")
    # Words without a bound: by (place, what is left without its letter) or, for lengths that differ, by what is left.
    open_ = words.where(~bounded).select("word")
    places = F.sequence(F.lit(1), F.length("word"))
    less = F.transform(places, lambda i: F.struct(i.alias("at"), F.concat(F.substr("word", F.lit(1), i - 1), F.substr("word", i + 1)).alias("left")))
    cut = open_.select("word", F.explode(less).alias("c")).select("word", "c.at", "c.left")
    same = cut.join(cut.select(F.col("word").alias("p_word"), "at", "left"), ["at", "left"]).where("p_word < word")
    longer = cut.join(open_.select(F.col("word").alias("p_word"), F.col("word").alias("left")), "left")
    pairs = staged(found.unionByName(same.select("word", "p_word")).unionByName(longer.select("word", "p_word")).distinct(), "near-words")
    both = pairs.select("word", F.col("p_word").alias("other")).unionByName(pairs.select(F.col("p_word").alias("word"), F.col("word").alias("other")))
    return both.join(words.select(F.col("word").alias("other"), "n"), "other").select("word", "other", "n")


def roots(edges: DataFrame, steps: int) -> DataFrame:
    """(word, root): where following (word, form) edges ends, for chains of at most `steps` edges; pointers double a round."""
    now = edges.select("word", F.col("form").alias("root"))
    for _ in range(max(steps - 1, 0).bit_length()):
        onward = now.select(F.col("word").alias("__at"), F.col("root").alias("__root"))
        now = staged(now.join(onward, F.col("root") == F.col("__at"), "left").select("word", F.coalesce("__root", "root").alias("root")), "roots")
    return now


def group_spellings(docs: DataFrame, config: SpellingConfig = SpellingConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, n (occurrences), form, root, n_near (words at edit distance one), form_n.

    A word's form is its most frequent near word (of equals the least in code-point order) if that is factor times as
    frequent; root follows forms to the last one.  Counts grow along forms, so chains are short and never circular.

    NULL and empty texts have no words; a NULL id counts as empty; rows that repeat count each time; an empty table gives
    an empty result; other columns are ignored.
    """
    if config.factor < 2:
        raise ValueError("a form must be more frequent than its variants: factor is 2 at least")
    spark = docs.sparkSession
    ship_package(spark)
    with small_batches(spark, 10_000), scratch(spark):
        counted = damaged_words(docs, config, id_col, text_col).groupBy("word").agg(F.count("*").alias("n"))
        vocabulary = staged(counted.where((F.col("n") >= config.least) & (F.length("word") >= config.letters)), "vocabulary", keep=True)
        best = near_words(vocabulary, config).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("m"), "other")).alias("best"))
        most = vocabulary.agg(F.max("n")).first()[0] or 1
        placed = vocabulary.join(best, "word", "left")
        near_n = -F.col("best.m")
        is_form = near_n >= config.factor * F.col("n")
        placed = staged(placed.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, near_n).alias("form_n")), "forms", keep=True)
        # Each form is factor times as frequent as its variant, which occurs once at least.
        ends = staged(roots(placed.where("form IS NOT NULL"), math.ceil(math.log(most, config.factor)) + 1), "roots", keep=True)
        return placed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
