"""Language-model scores by prediction by partial matching over a trie of byte contexts, with a word baseline."""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import scratch, small_batches, staged, text_chunks

#: Ends a text; no UTF-8 text holds it.
END = 0xFF
#: Stands before a text, so that its first bytes have contexts as well.
BEFORE = 0x0A


@dataclass(frozen=True)
class PpmConfig:
    """Every context of the training texts counts; those that hold at least 1/hot of their bytes are broadcast.

    So an order has `hot` broadcast contexts at most, whatever the corpus; bytes after rarer contexts are scored by
    joins with the counts of all contexts, which grow with the corpus.  In the same way at most `words` words are
    common, and broadcast with their counts; all other words are counted by a join.  Only where `contexts` is set,
    the model itself is cut to contexts that hold 1/contexts of the bytes, and longer ones score by their suffix.
    """

    order: int = 4
    contexts: int | None = None
    words: int = 1 << 22
    hot: int = 1 << 15
    #: Bytes of text whose rare codes are made distinct together before they are joined.
    chunk: int = 1 << 24


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def _codes(texts: list[bytes], order: int) -> np.ndarray:
    """order context bytes and the byte that follows, for each byte and the end of each text."""
    pad = bytes([BEFORE]) * order
    a = np.frombuffer(b"".join(pad + t + b"\xff" for t in texts), np.uint8).astype(np.uint64)
    code = np.zeros(len(a) - order, np.uint64)
    for k in range(order + 1):
        code = (code << np.uint64(8)) | a[k : len(a) - order + k]
    real = np.ones(len(a), bool)
    at = np.concatenate([[0], np.cumsum([len(t) + order + 1 for t in texts])[:-1]])
    for k in range(order):
        real[at + k] = False
    return code[real[order:]]


def counts(docs: DataFrame, config: PpmConfig) -> DataFrame:
    """Partial counts over training texts: (word, NULL, n) and (NULL, code, n), summed within a task."""

    def flush(words, codes):
        if codes:
            u, n = np.unique(np.concatenate([c for c, _ in codes]), return_inverse=True)
            n = np.bincount(n, weights=np.concatenate([m for _, m in codes])).astype(np.int64)
            yield pd.DataFrame({"word": None, "code": u.astype(np.int64), "n": n})
        if words:
            frame = pd.DataFrame({"word": list(words), "code": None, "n": list(words.values())})
            frame["code"] = frame["code"].astype("Int64")
            yield frame

    def run(batches):
        words, codes, held = Counter(), [], 0
        for pdf in batches:
            for _, texts in text_chunks(pdf["text"], pdf["text"], 3_000_000):
                lower = [t.lower() for t in texts]
                for t in lower:
                    words.update(t.split())
                codes.append(np.unique(_codes(lower, config.order), return_counts=True))
                held += len(codes[-1][0])
                if held > 2_000_000 or len(words) > 400_000:
                    yield from flush(words, codes)
                    words, codes, held = Counter(), [], 0
        yield from flush(words, codes)

    return docs.select("text").mapInPandas(run, "word binary, code long, n long")


Order = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def context_counts(codes: DataFrame, total: int, config: PpmConfig) -> tuple[list[Order], list[DataFrame]]:
    """For each order its frequent contexts' (context, symbol, count), sorted, at most hot (or contexts) * 256 of
    them; and for each order the table (ctx, sym, n) of all its contexts."""
    least, out, tables = total / (config.contexts or config.hot), [], []
    for order in range(config.order, -1, -1):
        ctx = F.shiftrightunsigned("code", 8).bitwiseAND(F.lit((1 << 8 * order) - 1))
        codes = codes.select(ctx.alias("ctx"), F.col("code").bitwiseAND(F.lit(255)).alias("sym"), "n")
        codes = staged(codes.groupBy("ctx", "sym").agg(F.sum("n").alias("n")), "ppm-order")
        tables.append(codes)
        common = codes.groupBy("ctx").agg(F.sum("n").alias("t")).where(F.col("t") >= least) if order else codes.select("ctx").distinct()
        kept = codes.join(common.select("ctx"), "ctx").toPandas().sort_values(["ctx", "sym"])
        out.append((order, kept["ctx"].to_numpy(np.int64), kept["sym"].to_numpy(np.int64), kept["n"].to_numpy(np.float64)))
        codes = codes.select(F.shiftleft("ctx", 8).bitwiseOR(F.col("sym")).alias("code"), "n")
    return out[::-1], tables[::-1]


def context_totals(tables: list[DataFrame]) -> list[DataFrame]:
    """For each order (ctx, n, d, up): its contexts' counts, symbols, and what their symbols count after the suffix."""
    out = []
    for order, table in enumerate(tables):
        if order:
            above = tables[order - 1].select(F.col("ctx").alias("suffix"), F.col("sym").alias("s"), F.col("n").alias("up"))
            suffix = F.col("ctx").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1))
            table = table.join(above, (suffix == F.col("suffix")) & (F.col("sym") == F.col("s")))
        up = F.sum("up") if order else F.lit(0).cast("long")
        out.append(staged(table.groupBy("ctx").agg(F.sum("n").alias("n"), F.count("*").alias("d"), up.alias("up")), "ppm-totals"))
    return out


def code_scores(codes: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(code, logp) of distinct codes (context bytes and the byte after them), from the counts of all contexts.

    From the longest order on, each code takes its count or its escape; only codes that no context of an order
    has seen go on to the next.  mass is what escapes have left, up and seen what the longer context excludes.
    """
    totals, done = context_totals(tables), []
    none = F.lit(None).cast("long")
    open_ = codes.select("code", F.lit(1.0).alias("mass"), none.alias("up"), none.alias("seen"))
    for order in range(len(tables) - 1, -1, -1):
        ctx = F.shiftrightunsigned("code", 8).bitwiseAND(F.lit((1 << 8 * order) - 1))
        here = open_.select("code", "mass", "up", "seen", ctx.alias("ctx"), F.col("code").bitwiseAND(F.lit(255)).alias("sym"))
        total = totals[order].select("ctx", F.col("n").alias("all"), F.col("d").alias("types"), F.col("up").alias("own_up"))
        if order == 0:
            total = F.broadcast(total)
        here = here.join(total, "ctx", "left").join(tables[order], ["ctx", "sym"], "left")
        left, kinds = F.col("all") - F.coalesce("up", F.lit(0)), F.col("types") - F.coalesce("seen", F.lit(0))
        some = left + kinds > 0
        here = staged(here.select(
            "code", F.when(F.col("n").isNotNull(), F.col("mass") * F.col("n") / (left + kinds)).alias("p"),
            F.when(some, F.col("mass") * kinds / (left + kinds)).otherwise(F.col("mass")).alias("mass"),
            F.coalesce("own_up", "up").alias("up"), F.coalesce("types", "seen").alias("seen"),
        ), "ppm-codes")
        done.append(here.where("p IS NOT NULL").select("code", F.log10("p").alias("logp")))
        open_ = here.where("p IS NULL")
    rest = F.greatest(F.lit(256) - F.coalesce("seen", F.lit(0)), F.lit(1))
    out = open_.select("code", F.log10(F.col("mass") / rest).alias("logp"))
    for x in done:
        out = out.unionByName(x)
    return out


class Codebook:
    """Numbers for the distinct codes of a chunk of texts, in order of their first block."""

    def __init__(self):
        self.codes, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def number(self, codes: np.ndarray) -> np.ndarray:
        u, inverse = np.unique(codes, return_inverse=True)
        new = u[~np.isin(u, self.codes, assume_unique=True)]
        codes = np.concatenate([self.codes, new])
        order = np.argsort(codes)
        self.codes, self.ids = codes[order], np.concatenate([self.ids, len(self.codes) + np.arange(len(new))])[order]
        return self.ids[np.searchsorted(self.codes, u)][inverse]

    def listed(self) -> np.ndarray:
        """The codes by number."""
        return self.codes[np.argsort(self.ids)].astype(np.int64)


def packed(owner: np.ndarray, ids: np.ndarray, n: int) -> list[bytes]:
    """For each of n texts its ids, sorted, as differences in groups of seven bits, the last group first bit clear."""
    order = np.lexsort((ids, owner))
    owner, ids = owner[order], ids[order]
    step = np.diff(ids, prepend=0)
    first = np.diff(owner, prepend=-1) != 0
    step[first] = ids[first]
    size = 1 + sum((step >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for k in range(5):
        has = size > k
        out[end[has] - 1 - k] = ((step[has] >> 7 * k) & 127) | (128 if k else 0)
    cut = np.concatenate([[0], end])[np.searchsorted(owner, np.arange(n + 1))]
    return [out[a:b].tobytes() for a, b in zip(cut, cut[1:])]


def unpacked(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return np.zeros(0, np.int64)
    last = a < 128
    which = np.concatenate([[0], np.cumsum(last)[:-1]])
    back = np.flatnonzero(last)[which] - np.arange(len(a))
    step = np.zeros(int(last.sum()), np.int64)
    np.add.at(step, which, (a.astype(np.int64) & 127) << 7 * back)
    return np.cumsum(step)


class ContextTrie:
    """log10 of the probability of every byte after every kept context, and the trie's links.

    Escapes take the share d / (n + d), with d symbols seen n times; symbols that a longer context has seen are
    excluded from the shorter one's counts.  What no context has seen shares the rest evenly.
    """

    def __init__(self, orders: list[Order]):
        contexts = [np.unique(ctx) for _, ctx, _, _ in orders]
        first = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])
        self.size = int(first[-1])
        self.child = np.full((self.size + 1, 256), self.size, np.int32)
        self.logp = np.zeros((max(self.size, 1), 256), np.float32)
        counts_above = rest_above = None
        for k, (order, ctx, sym, n) in enumerate(orders):
            if not len(contexts[k]):
                break
            c = np.zeros((len(contexts[k]), 256))
            c[np.searchsorted(contexts[k], ctx), sym] = n
            d, total = (c > 0).sum(axis=1, keepdims=True), c.sum(axis=1, keepdims=True)
            if order == 0:
                rest = np.broadcast_to(1.0 / np.maximum(256 - d, 1), c.shape)
            else:
                suffix = np.searchsorted(contexts[k - 1], contexts[k] & ((1 << 8 * (order - 1)) - 1))
                self.child[first[k - 1] + suffix, contexts[k] >> 8 * (order - 1)] = np.arange(first[k], first[k + 1])
                up, rest_up = counts_above[suffix], rest_above[suffix]
                open_ = np.where(c > 0, 0.0, up)
                d_up, n_up = (open_ > 0).sum(axis=1, keepdims=True), open_.sum(axis=1, keepdims=True)
                whole = np.maximum(n_up + d_up, 1e-300)
                rest = np.where(n_up + d_up > 0, np.where(open_ > 0, open_ / whole, d_up / whole * rest_up), rest_up)
            p = np.where(c > 0, c / (total + d), d / (total + d) * rest)
            self.logp[first[k] : first[k + 1]] = np.log10(np.maximum(p, 1e-300))
            counts_above, rest_above = c, rest
        if not self.size:
            self.logp[:] = -np.log10(256)

    def score(self, texts: list[bytes], order: int, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of each text and its end; and if the model is whole, (text, code) of the bytes whose
        longest context is not in the trie, which the sums then leave out."""
        code = _codes(texts, order)
        node, best = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        for k in range(1, order + 1):
            node = self.child.ravel().take(node * 256 + ((code >> np.uint64(8 * k)) & np.uint64(255)).astype(np.int64)).astype(np.int64)
            best = np.where(node < self.size, node, best)
        each = self.logp.ravel().take(best * 256 + (code & np.uint64(255)).astype(np.int64)).astype(np.float64)
        size = np.array([len(t) + 1 for t in texts])
        rare = (node >= self.size) & whole
        sums = np.add.reduceat(np.where(rare, 0.0, each), np.concatenate([[0], np.cumsum(size)[:-1]]))
        return sums, np.repeat(np.arange(len(texts)), size)[rare], code[rare]


_tries: dict[str, ContextTrie] = {}


def _trie(shared) -> ContextTrie:
    key = shared.value[-1]
    if key not in _tries:
        _tries.clear()
        _tries[key] = ContextTrie(shared.value[0])
    return _tries[key]


def word_hash(word: bytes) -> int:
    """What Spark's xxhash64 gives for the string."""
    return xxhash.xxh64_intdigest(word, seed=42)


def _far_scores(rows: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
    """Sums of a chunk's texts over the bytes that its codebook numbers."""
    logp = np.zeros(len(values))
    logp[values["id"].to_numpy()] = values["logp"].to_numpy()
    return pd.DataFrame({"row": rows["row"], "far_score": [logp[unpacked(x)].sum() for x in rows["far"]]})


def score_ppm(docs: DataFrame, config: PpmConfig = PpmConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trains on rows whose crc32 of the id modulo 7 is not 2 (a NULL id counts as the empty string).  Texts are
    lower-cased in A-Z; NULL counts as empty and has one token, its end.  Repeated rows count and are scored each;
    an empty table gives an empty result; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    with small_batches(docs.sparkSession), scratch(docs.sparkSession):
        return _score_ppm(docs, config, id_col, text_col)


def _score_ppm(docs: DataFrame, config: PpmConfig, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    train = slim.where(~held_out(F.col("doc_id")))
    parts = staged(counts(train, config), "ppm-counts")
    words = parts.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("c"))
    words = staged(words, "word-counts", keep=True)
    n_words, n_distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    codes = parts.where("code IS NOT NULL").select("code", "n")
    n_bytes, n_ends = codes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("code").bitwiseAND(F.lit(255)) == END, F.col("n"))), F.lit(0))).first()
    trie, tables = context_counts(codes, n_bytes, config)
    whole = config.contexts is None
    n_tokens, n_types = n_words + n_ends, n_distinct + (n_ends > 0)
    floor = np.log10(float(n_tokens + n_types + 1))
    least = max(1, -(-n_words // config.words))
    common = words.where(F.col("c") >= least).select(F.xxhash64(F.col("word").cast("string")).alias("h"), "c").toPandas()
    h = common["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    shared = spark.sparkContext.broadcast((trie, h[order], np.log10(common["c"].to_numpy(np.float64)[order] + 1), uuid.uuid4().hex))
    end_value = float(np.log10(n_ends + 1))

    def run(batches):
        task, row = TaskContext.get().partitionId() << 40, 0
        chunk, book, held = task, Codebook(), 0
        model = _trie(shared)
        _, hashes, values, _ = shared.value
        for pdf in batches:
            for ids, texts in text_chunks(pdf["doc_id"], pdf["text"]):
                lower = [t.lower() for t in texts]
                lists = [t.split() for t in lower]
                code: dict[bytes, int] = {}
                flat = np.array([code.setdefault(w, len(code)) for ws in lists for w in ws], np.int64)
                distinct = list(code)
                q = np.fromiter(map(word_hash, distinct), np.uint64, len(distinct))
                at = np.minimum(np.searchsorted(hashes, q), max(len(hashes) - 1, 0))
                known = hashes[at] == q if len(hashes) else np.zeros(len(q), bool)
                value = np.where(known, values[at], 0.0) if len(hashes) else np.zeros(len(q))
                n = np.array([len(ws) for ws in lists], np.int64)
                owner = np.repeat(np.arange(len(lists)), n)
                head = np.bincount(owner, weights=value[flat], minlength=len(lists)) + end_value
                n_known = np.bincount(owner, weights=known[flat], minlength=len(lists)).astype(np.int64) + (n_ends > 0)
                rare = ~known[flat]
                pair, times = np.unique(owner[rare] * max(len(code), 1) + flat[rare], return_counts=True)
                of, which = np.divmod(pair, max(len(code), 1))
                cut = np.searchsorted(of, np.arange(len(lists) + 1))
                names = [distinct[w] for w in which]
                score, far_owner, far = model.score(lower, config.order, whole)
                if held > config.chunk:
                    yield listed(chunk, book)
                    chunk, book, held = chunk + 1, Codebook(), 0
                held += sum(map(len, lower))
                out = pd.DataFrame({
                    "row": task + row + np.arange(len(lists)), "doc_id": pd.array(ids, "Int64"), "n_tokens": n + 1, "n_known": n_known, "head": head,
                    "score": score, "rare": [names[a:b] for a, b in zip(cut, cut[1:])], "times": [times[a:b] for a, b in zip(cut, cut[1:])],
                    "chunk": chunk, "far": packed(far_owner, book.number(far), len(lists)), "codes": None,
                })
                row += len(lists)
                yield out
        if len(book.codes):
            yield listed(chunk, book)

    def listed(chunk, book):
        none = {"doc_id": pd.array([None], "Int64"), "n_tokens": 0, "n_known": 0, "head": 0.0, "score": 0.0, "rare": [None], "times": [None]}
        return pd.DataFrame({"row": [-1], **none, "chunk": chunk, "far": [None], "codes": [book.listed()]})

    first = staged(slim.mapInPandas(run, "row long, doc_id long, n_tokens long, n_known long, head double, score double, rare array<binary>, times array<long>, chunk long, far binary, codes array<long>"), "ppm-scores", keep=True)
    books, first = first.where("row < 0").select("chunk", F.posexplode("codes").alias("id", "code")), first.where("row >= 0").drop("codes")
    each = first.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    tail = each.join(words.where(F.col("c") < least), "word").groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"))
    out = first.drop("rare", "times", "chunk", "far").join(tail, "row", "left")
    if whole:
        known = code_scores(staged(books.select("code").distinct(), "ppm-rare"), tables)
        values = books.join(known, "code").select(F.col("chunk").alias("book"), "id", "logp")
        far = first.where(F.length("far") > 0).select("row", "chunk", "far")
        far = far.groupBy("chunk").cogroup(values.groupBy("book")).applyInPandas(_far_scores, "row long, far_score double")
        out = out.join(staged(far, "ppm-far", keep=True), "row", "left").withColumn("score", F.col("score") + F.coalesce("far_score", F.lit(0.0))).drop("far_score")
    zero = F.lit(0)
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more_known", zero)).alias("n_known"),
        F.lit(int(n_tokens)).cast("long").alias("train_tokens"),
        (F.col("head") + F.coalesce("more", zero) - F.col("n_tokens") * F.lit(float(floor))).alias("base_score"), "score",
    )
