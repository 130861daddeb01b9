"""The pipeline's stages: each against a plain version of its decisions, on its own input."""

import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from gridspark.llm import mixing
from gridspark.llm.queries import PIECE_MODEL
from test_operators import classes, measured, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, sf, tmp_path):
    import sentencepiece

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("kept", F.lit("clash"))
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        steps[name] = (docs, spark.read.parquet(f"{tmp_path}/{name}"))
        docs = steps[name][1]
    before, after = steps["quality"]
    m = {i: measured(t) for i, t in texts(before)}
    good = {i for i, (n, chars, symbols, dup, lines, rep) in m.items() if n >= 20 and 100 * rep <= 30 * n and 10 * symbols <= n and 100 * dup <= 30 * lines and 2 * n <= chars <= 20 * n}
    assert {i for i, _ in texts(after)} == good and after.columns == before.columns
    before, after = steps["exact_dedup"]
    bare = [re.sub(r"[\x20\x09-\x0D]", "", t) for _, t in texts(after)]
    assert len(set(bare)) == len(bare) and set(bare) == {re.sub(r"[\x20\x09-\x0D]", "", t) for _, t in texts(before)}
    before, after = steps["near_dedup"]
    assert {i for i, _ in texts(after)} == {i for i, _, c in classes(texts(before)) if i == c}
    before, after = steps["mix_sources"]
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(before).collect()}
    own, got = dict(texts(before)), Counter()
    for i, t in texts(after):
        got[i] += len(WORD.findall(t))
        assert not Counter(WORD.findall(t)) - Counter(WORD.findall(own[i]))
    assert got == Counter({i: n for i, n in taken.items() if n}) and after.columns == before.columns
    before, after = steps["pieces"]
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in after.collect()) == Counter((i, tuple(model.encode(t))) for i, t in texts(before))


def test_odd_rows(spark, tmp_path):
    p = " ".join(f"word{chr(97 + i)}x" for i in range(25))
    rows = [(1, p, "en", "a", 1), (1, p, "en", "a", 1), (2, p + "\n", None, None, None), (None, p.replace("x", "q"), "en", "a", 1), (3, None, "en", "b", 0), (4, "", None, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for empty in (False, True):
        df = docs.limit(0) if empty else docs
        for name, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, "")
            df.write.parquet(f"{tmp_path}/{empty}-{name}")
            df = spark.read.parquet(f"{tmp_path}/{empty}-{name}")
            if name == "near_dedup":
                assert Counter(r["doc_id"] for r in df.collect()) == (Counter() if empty else Counter([2, None]))


def test_rows_that_share_an_id(spark):
    """Decisions and words belong to rows, not to ids."""
    w = lambda n, k: " ".join(f"{k}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(n))
    a, b, c = w(300, "a"), w(900, "b"), w(400, "c")
    make = lambda rows: spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    short = "few words"
    assert Counter(texts(corpus_pipeline.quality(spark, make([(1, a, "s"), (1, short, "s"), (2, short, "s")]), ""))) == Counter([(1, a)])
    got = Counter(texts(corpus_pipeline.exact(spark, make([(1, "u v w", "s"), (1, "p q r", "s"), (0, "p q r", "s"), (1, "u  v w", "s"), (3, "x", "s"), (3, "x", "t")]), "")))
    assert got == Counter([(1, "u  v w"), (0, "p q r"), (3, "x")])
    rows = [(1, a, "s"), (1, b, "s"), (2, c, "t"), (2, c, "t"), (2, c, "t"), (4, w(700, "d"), None)]
    docs = make(rows)
    taken = Counter()
    for r in mixing.mix_sources(docs).collect():
        taken[r["doc_id"], r["source"], r["size"]] += r["taken"]
    size = {t: len(WORD.findall(t)) for _, t, _ in rows}
    got = Counter()
    for r in corpus_pipeline.mix(spark, docs, "").collect():
        words = WORD.findall(r["text"])
        whole = next(t for t in size if set(words) <= set(WORD.findall(t)))
        got[r["doc_id"], r["source"], size[whole]] += len(words)
    assert got == Counter({k: n for k, n in taken.items() if n})
    long = make([(1, "lang text " + "ü" * 200_000 + " " + w(4000, "q"), "s"), (2, a, "s")])
    for stage in (corpus_pipeline.quality, corpus_pipeline.exact, corpus_pipeline.near, corpus_pipeline.mix, corpus_pipeline.pieces):
        assert stage(spark, long, "").count() >= 1
