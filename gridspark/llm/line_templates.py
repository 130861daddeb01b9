"""Recurring lines dropped by templates: a fixed-depth tree over token counts and leading tokens, split further until
lines agree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACE, attach_group, in_groups, scratch, staged

ANY = "<*>"
#: A token with a digit in it, from its first character on.
VARIABLE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
#: Texts without any of this have only lines that masking leaves as they are.
MASKABLE = r"[0-9\x09\x0B-\x0D]|  |(?:^|\n) | (?:\n|$)"


@dataclass(frozen=True)
class TemplateConfig:
    """A leaf is a token count and the first depth tokens, with ANY for tokens that hold a digit.

    A node, at first a leaf, is a template if its lines have one token at `similar` of their places or more; it is
    recurring if min_docs documents share it.  Another node is split by the common tokens, which min_docs documents
    share at a place; only places count whose common tokens cover at least half as many lines as the best place's.
    Lines with the same common tokens there make a node, and lines without any make one more.  A masked line that
    min_docs documents share is recurring as well, and one of long_tokens tokens that long_docs share.
    """

    depth: int = 4
    similar: float = 0.7
    min_docs: int = 10
    long_tokens: int = 50
    long_docs: int = 2


def masked(line: Column) -> Column:
    """Tokens joined by single spaces, ANY for those with a digit; plain lines are left as they are."""
    bare = F.when(line.rlike(r"^ |[\x09-\x0D]|  | $"), F.regexp_replace(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), SPACE, " ")).otherwise(line)
    return F.when(line.rlike("[0-9]"), F.regexp_replace(bare, VARIABLE, ANY)).otherwise(bare)


def _key(line: Column) -> Column:
    """128 bits that stand for a masked line."""
    return F.struct(F.xxhash64(line).alias("x"), F.xxhash64(F.lit(1), line).alias("y"))


def _n_tokens(line: Column) -> Column:
    return F.char_length(line) - F.char_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def mask_lines(docs: DataFrame, config: TemplateConfig, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, lines, n_lines (with a word), masks (of the lines that masking changes, else NULL), and of all masked
    lines keys, leaves and numbers of tokens: what later steps need without reading the lines again."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.split(text, "\n").alias("lines"), text.rlike(MASKABLE).alias("odd"))
    rows = rows.select("row", "doc_id", "lines", F.when(F.col("odd"), F.transform("lines", masked)).alias("m"))
    rows = rows.select("row", "doc_id", "lines", F.zip_with("m", "lines", lambda m, x: F.nullif(m, x)).alias("masks"), F.coalesce("m", "lines").alias("all"))
    first = F.transform("all", lambda x: _leaf(x, config))
    return rows.select(
        "row", "doc_id", "lines", F.size(F.array_remove("all", "")).cast("long").alias("n_lines"), "masks",
        F.transform("all", _key).alias("keys"), first.alias("leaves"), F.transform("all", _n_tokens).alias("sizes"))


def _leaf(line: Column, config: TemplateConfig) -> Column:
    return F.xxhash64(_n_tokens(line), F.substring_index(line, " ", config.depth))


def tree_nodes(lines: DataFrame, config: TemplateConfig) -> DataFrame:
    """(node, key) of the lines (node, key, tokens, n: their documents) that end in a template.

    Every round splits all open nodes once.  Nodes that have too few documents, or too many places without a common
    token, can never become templates and are closed.  A round halves the documents that a node's best open place
    covers, so the number of rounds grows with the logarithm of the documents.
    """
    open_, done = lines, lines.select("node", "key").limit(0)
    while total := open_.count():
        each = open_.select("node", "key", "n", F.posexplode("tokens").alias("place", "token"))
        cells = staged(each.groupBy("node", "place", "token").agg(F.sum("n").alias("n"), F.count("*").alias("lines")), "template-cells")
        often = F.col("n") >= config.min_docs
        places = cells.groupBy("node", "place").agg(
            F.count("*").alias("kinds"), F.sum("n").alias("docs"), F.sum("lines").alias("lines"), F.coalesce(F.sum(F.when(often, F.col("n"))), F.lit(0)).alias("cover"))
        one, none = F.col("kinds") == 1, (F.col("kinds") > 1) & (F.col("cover") == 0)
        nodes = places.groupBy("node").agg(
            F.count("*").alias("size"), F.max("docs").alias("docs"), F.max("lines").alias("lines"), F.sum(one.cast("long")).alias("fixed"), F.sum(none.cast("long")).alias("loose"),
            F.max(F.when(~one & ~none, F.col("cover"))).alias("best"))
        whole = F.col("fixed") >= config.similar * F.col("size")
        alive = (F.col("docs") >= config.min_docs) & ((F.col("size") - F.col("loose")) >= config.similar * F.col("size"))
        nodes = staged(nodes.where(alive).select("node", "lines", whole.alias("whole"), "best").where("whole OR best IS NOT NULL"), "template-nodes")
        here = attach_group(open_, nodes, "node", "lines", total).where("whole IS NOT NULL").drop("lines", "best")
        done = done.unionByName(staged(here.where("whole").select("node", "key"), "template-lines"))
        here = staged(here.where("NOT whole"), "template-open")
        chosen = places.where((F.col("kinds") > 1) & (F.col("cover") > 0)).select("node", "place", "cover")
        chosen = chosen.join(nodes.where("NOT whole").select("node", "best"), "node").where(F.col("cover") * 2 >= F.col("best")).select("node", "place")
        cell = F.struct("node", "place", "token").alias("cell")
        wide = staged(cells.where(often).join(chosen, ["node", "place"]).select(cell, F.col("lines").alias("lines_")), "template-splits")
        apart = here.select("key", F.col("node").alias("of"), F.posexplode("tokens").alias("place", "token"))
        apart = apart.select("of", "key", F.struct(F.col("of").alias("node"), "place", "token").alias("cell"))
        n_tokens = cells.agg(F.sum("lines")).first()[0]
        apart = in_groups(apart, wide, "cell", "lines_", n_tokens).groupBy("of", "key")
        child = apart.agg(F.xxhash64("of", F.sort_array(F.collect_list(F.struct("cell.place", "cell.token")))).alias("child"))
        named = here.join(child.select(F.col("of").alias("node"), "key", "child"), ["node", "key"], "left")
        open_ = staged(named.select(F.coalesce("child", F.xxhash64("node")).alias("node"), "key", "tokens", "n"), "template-open")
    return done


def recurring(rows: DataFrame, config: TemplateConfig = TemplateConfig()) -> DataFrame:
    """(key, n_docs) of the masked lines to drop, of mask_lines' rows."""
    blank = F.col("key") == _key(F.lit(""))
    keys = rows.select("row", F.explode(F.array_distinct("keys")).alias("key")).where(~blank)
    shared = staged(keys.groupBy("key").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min(config.long_docs, config.min_docs)), "shared-lines")
    same = shared.where(F.col("n_docs") >= config.min_docs)
    sized = rows.select(F.explode(F.arrays_zip("keys", "sizes")).alias("x")).where(F.col("x.sizes") >= config.long_tokens).select(F.col("x.keys").alias("key"))
    some = shared.where(F.col("n_docs") >= config.long_docs).join(sized.distinct(), "key", "left_semi")
    same = staged(same.unionByName(some).distinct(), "same-lines")
    # A leaf no longer than the tree is deep has one line, so only longer ones are looked at further.
    each = rows.select("row", F.explode(F.array_distinct(F.arrays_zip("leaves", "keys", "sizes"))).alias("x")).where(F.col("x.sizes") > config.depth)
    leaves = each.groupBy(F.col("x.leaves").alias("node")).agg(F.count("*").alias("size")).where(F.col("size") >= config.min_docs)
    leaves = staged(leaves, "leaves")
    n_lines = keys.count()
    lines = F.when(F.col("masks").isNull(), F.col("lines")).otherwise(F.zip_with("masks", "lines", lambda m, x: F.coalesce(m, x)))
    deep = rows.select("row", F.explode(F.array_distinct(F.arrays_zip(lines.alias("line"), "keys", "leaves", "sizes"))).alias("x")).where(F.col("x.sizes") > config.depth)
    deep = deep.select("row", F.col("x.keys").alias("key"), F.col("x.line").alias("line"), F.col("x.leaves").alias("node"))
    few = leaves.count() <= BROADCAST_ROWS // 4
    here = deep.join(F.broadcast(leaves.select("node")), "node", "left_semi") if few else in_groups(deep, leaves, "node", "size", n_lines)
    here = staged(here, "leaf-lines")
    each = here.groupBy("node", "key").agg(F.first("line").alias("line"), F.count("*").alias("n"))
    each = staged(each.select("node", "key", F.split("line", " ").alias("tokens"), "n"), "distinct-lines")
    ended = staged(tree_nodes(each, config).select(F.col("node").alias("template"), "key"), "template-members")
    held = each.select("key", "n").join(ended, "key")
    member = attach_group(here.select("row", "key"), held, "key", "n", n_lines).where("template IS NOT NULL")
    support = member.groupBy("template", "row").agg(F.lit(1).alias("one")).groupBy("template").agg(F.count("*").alias("docs")).where(F.col("docs") >= config.min_docs)
    like = held.join(support, "template", "left_semi").select("key", F.col("n").alias("n_docs"))
    return same.unionByName(like).groupBy("key").agg(F.max("n_docs").alias("n_docs"))


def drop_recurring_lines(docs: DataFrame, config: TemplateConfig = TemplateConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines (with a word), n_dropped, text without the recurring lines.

    All lines of a recurring template go, in every document.  NULL text becomes the empty text; repeated rows
    count as documents each; NULL ids are kept; an empty table gives an empty result; other columns are ignored.
    Rows are numbered in a written table, so a lost executor cannot number them anew, and lines are masked once;
    later steps meet lines by their keys, and only places of dropped lines come back to the texts.
    """
    with scratch(docs.sparkSession):
        rows = staged(mask_lines(docs, config, id_col, text_col), "masked-lines", keep=True)
        drop = staged(recurring(rows, config), "dropped-lines")
        each = rows.select("row", F.posexplode("keys").alias("place", "key"))
        total = rows.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
        hits = in_groups(each, drop, "key", "n_docs", total).groupBy("row").agg(F.collect_list("place").alias("places"))
        hits = staged(hits, "dropped-places", keep=True)
    out = rows.select("row", "doc_id", "lines", "n_lines").join(hits.hint("merge"), "row", "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "places")
    none = F.col("places").isNull()
    text = F.array_join(F.when(none, F.col("lines")).otherwise(F.transform(kept, lambda i: F.get("lines", i))), "\n")
    return out.select("doc_id", "n_lines", F.when(none, F.lit(0)).otherwise(F.size("places")).cast("long").alias("n_dropped"), text.alias("text"))
