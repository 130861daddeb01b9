"""The registered queries of the operators, on the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import chat_digest, format_chats
from .exact_dedup import DigestIndex, exact_dedup
from .licenses import scan_licenses
from .line_templates import drop_recurring_lines
from .mixing import mix_sources
from .near_dedup import near_dedup
from .pieces import encode_pieces
from .ppm import score_ppm
from .quality import quality_rules
from .repair import damage, repair_conversations, repaired_digest
from .secrets import scan_secrets, secret_digest
from .spelling import group_spellings
from .url_rules import filter_urls

#: A public SentencePiece file on the driver.
PIECE_MODEL = os.environ.get("GRIDSPARK_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(scan_secrets(documents(spark, sf_dir)))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(documents(spark, sf_dir), PIECE_MODEL)


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_ppm(documents(spark, sf_dir))


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(documents(spark, sf_dir))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return scan_licenses(documents(spark, sf_dir).withColumn("path", path))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op10_exact_dedup_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two languages first, then all others against the index that the first batch left."""
    docs, first = documents(spark, sf_dir), F.coalesce(F.col("lang").isin("en", "de"), F.lit(False))
    index = DigestIndex(spark)
    out = exact_dedup(docs.where(first), index).unionByName(exact_dedup(docs.where(~first), index))
    index.close()
    return out


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(documents(spark, sf_dir))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations(spark, sf_dir)
    return repaired_digest(rows, *repair_conversations(damage(rows)))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = conversations(spark, sf_dir).select(*[F.col(f.name).cast(f.dataType) for f in extra.schema])
    return chat_digest(format_chats(rows.unionByName(extra)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_near_dedup, op2_quality_rules, op3_mix_sources, op4_secrets, op5_pieces, op6_ppm, op7_line_templates, op8_url_filter, op9_licenses, op10_exact_dedup, op10_exact_dedup_batches, op11_spelling_variants, op12_conversation_repair, op13_chat_format)
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: CRC-32 of a text's UTF-8 by its table of 256 entries, which the rule of the polynomial gives.
_CRC_TABLE = "list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n))"


def _crc(text: str) -> str:
    """SQL of the CRC-32 of a text, where crc.t is the table."""
    bytes_ = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce({bytes_}, lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


#: Ways of a conversation from a state (0: start, 1: after s, 2: after u, 3: after a) by insertions, and by a role.
_FILLS = "fill(x, y, ins) AS (VALUES (0, 0, ''), (1, 1, ''), (2, 2, ''), (3, 3, ''), (0, 2, 'I'), (1, 2, 'I'), (3, 2, 'I'), (2, 3, 'I'), (0, 3, 'II'), (1, 3, 'II'), (2, 2, 'II'), (3, 3, 'II')), nxt(x, r, y) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2))"
_CONTROLS = r"\\|<s>|</s>|\[INST\]|\[/INST\]|\[TURN:|\[/TURN\]"

ORACLES: dict[str, str] = {
    "op11_spelling_variants": rf"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS t),
r AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents),
c AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS k FROM r WHERE length(r) >= 7 GROUP BY ALL),
h AS (SELECT c.r, k, {_crc("coalesce(doc_id::VARCHAR, '') || ':' || c.r")} AS h FROM c, crc),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word, sum(k)::BIGINT AS n FROM h GROUP BY 1),
v AS (SELECT word, n FROM w WHERE length(word) >= 7 AND n >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS l FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.l = b.l AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.l = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN v b ON a.l = b.word
),
best AS (SELECT word, count(*) AS n_near, max(n) AS m FROM near GROUP BY word),
pick AS (SELECT near.word, min(other) AS other FROM near JOIN best ON near.word = best.word AND near.n = m GROUP BY near.word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * v.n THEN other END AS form, CASE WHEN m >= 10 * v.n THEN m END AS form_n FROM v LEFT JOIN best USING (word) LEFT JOIN pick USING (word)),
walk AS (SELECT word, word AS here, 0 AS step FROM f UNION ALL SELECT walk.word, f.form, step + 1 FROM walk JOIN f ON f.word = walk.here WHERE f.form IS NOT NULL),
root AS (SELECT word, arg_max(here, step) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN root USING (word)
""",
    "op12_conversation_repair": rf"""
WITH RECURSIVE {_FILLS}, crc AS (SELECT {_CRC_TABLE} AS t),
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS f FROM conversations, crc),
e AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE f <> 0),
o AS (SELECT *, row_number() OVER w AS i, lag(substr(role, 1, 1)) OVER w AS before FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
g AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM o),
t AS (SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS r, before, blank, NOT blank AND again AS dup, NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut FROM g),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM t GROUP BY conv_id),
way AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS x, 0 AS cost, '' AS audit FROM s
  UNION ALL
  SELECT conv_id, i, x, b.cost, b.audit FROM (
    SELECT conv_id, i, x, min({{'cost': cost, 'audit': audit}}) AS b FROM (
      SELECT way.conv_id, t.i, m.z AS x, way.cost + 2 * length(fill.ins) + m.cost AS cost, way.audit || fill.ins || m.op AS audit
      FROM way JOIN t ON t.conv_id IS NOT DISTINCT FROM way.conv_id AND t.i = way.i + 1 JOIN fill ON fill.x = way.x JOIN LATERAL (
        SELECT fill.y AS z, 3 AS cost, 'D' AS op
        UNION ALL SELECT nxt.y, t.cut::INT, 'K' FROM nxt WHERE nxt.x = fill.y AND nxt.r = t.r AND NOT t.blank AND NOT t.dup
        UNION ALL SELECT nxt.y, 2 + t.cut::INT, 'R' FROM nxt WHERE nxt.x = fill.y AND nxt.r <> 's' AND NOT t.blank AND NOT t.dup
      ) m ON true
    ) GROUP BY conv_id, i, x
  )
),
done AS (SELECT conv_id, min({{'cost': cost + CASE x WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END, 'audit': audit || CASE x WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END}}) AS b FROM way JOIN s USING (conv_id) WHERE i = n GROUP BY conv_id),
op AS (SELECT conv_id, p, substr(b.audit, p, 1) AS op, p - length(regexp_replace(substr(b.audit, 1, p), '[^I]', '', 'g')) AS i FROM (SELECT *, unnest(range(1, length(b.audit) + 1)) AS p FROM done)),
said AS (SELECT op.conv_id, p, op, t.role, t.text, row_number() OVER (PARTITION BY op.conv_id ORDER BY p) AS k, max(CASE WHEN op = 'K' AND r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY op.conv_id) AS sys
  FROM op LEFT JOIN t ON op.conv_id IS NOT DISTINCT FROM t.conv_id AND op.i = t.i AND op.op <> 'I' WHERE op.op <> 'D'),
rep AS (SELECT conv_id, string_agg(CASE WHEN op = 'K' THEN role ELSE CASE WHEN (k - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN op = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS said FROM said GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.cost, 0)::BIGINT AS cost,
  coalesce(b.audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN rep ON rep.conv_id IS NOT DISTINCT FROM c.conv_id
""",
    "op13_chat_format": rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '{_CONTROLS}')) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 16 + length(regexp_replace(role, '([\\\]])', '\\\1', 'g')) END AS size FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op1_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)
""",
    "op2_quality_rules": rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)
),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id
),
m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_text_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM l LEFT JOIN rep USING (doc_id)
),
b AS (
  SELECT *, CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 30 * n_text_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END AS fail_bits
  FROM m
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_text_lines::BIGINT AS n_text_lines, n_repeat_words::BIGINT AS n_repeat_words, fail_bits::BIGINT AS fail_bits,
  (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept
FROM b
""",
    "op8_url_filter": r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
),
p AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(verdict, h, q) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
hit AS (
  SELECT page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(verdict, length(h || q)) AS verdict
  FROM p JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, q) GROUP BY page_id
)
SELECT p.page_id, host, path, hit.rule AS rule, coalesce(hit.verdict, 'allow') AS verdict FROM p LEFT JOIN hit USING (page_id)
""",
    "op10_exact_dedup_batches": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h, CASE WHEN lang IN ('en', 'de') THEN 1 ELSE 2 END AS batch FROM documents
)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY h ORDER BY batch, n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h, batch) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY h ORDER BY batch, n DESC, doc_id) AS kept, h AS text_sha256
FROM d
""",
    "op10_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM documents
)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS kept, h AS text_sha256
FROM d
""",
}
