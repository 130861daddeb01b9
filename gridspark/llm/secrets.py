"""Secrets in texts: plain kinds, and weak parts that count only when complementary parts lie near them."""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import scratch, staged

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Weak parts: an identity, an endpoint, a secret value without a name.
IDENTITY = re.compile(r"\b(?:user(?:name)?|login|client_?id|account(?:_?id)?|access_?key_?id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@._+-]{3,})", re.I | re.A)
IDENTITY_HINT = re.compile(r"user|login|client|account|access", re.I | re.A)
ENDPOINT = re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9][A-Za-z0-9.:_@-]*[A-Za-z0-9/]|\barn:aws:[a-z0-9-]+:[A-Za-z0-9:/_.-]+", re.A)
#: A run of any length; '=' may stand before it, as in NAME=value, and pads its end.
VALUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])")
#: Order of kinds at one start.
KINDS = ("assign", "access", "hex", "identity", "endpoint", "value")
#: What a part of a credential can be for another part: a secret, an identity or an endpoint.
ROLES = {"assign": "secret", "hex": "secret", "value": "secret", "access": "who", "identity": "who", "endpoint": "where"}


@dataclass(frozen=True)
class SecretConfig:
    #: Characters between parts that belong together; a blank line ends a scope before that.
    reach: int = 200
    #: Bits a character that a value without a name must have at least.
    entropy: float = 3.5


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the plain kinds; finding a hint first spares most texts the slow pattern."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def _weak_value(s: str, config: SecretConfig) -> bool:
    return any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s) and _entropy(s) >= config.entropy


def _meets(spans: list[tuple[int, int]]):
    """Whether an interval overlaps one of some spans that do not overlap each other."""
    starts, ends = [s for s, _ in spans], [e for _, e in spans]

    def meets(start: int, end: int) -> bool:
        i = bisect.bisect_left(starts, end)
        return i > 0 and ends[i - 1] > start

    return meets


def parts(text: str | None, config: SecretConfig = SecretConfig()) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, scope) of the plain kinds and of weak parts that stand clear of them; a blank line starts
    a new scope."""
    if not text:
        return []
    base = base_spans(text)
    ends = [(m.start(), m.end()) for m in ENDPOINT.finditer(text)] if "://" in text or "arn:aws:" in text else []
    ids = [(m.start(), m.end()) for m in IDENTITY.finditer(text)] if IDENTITY_HINT.search(text) else []
    weak: list[tuple[int, int, str]] = []
    if ends or ids or any(k == "access" for *_, k in base):
        plain = [_meets([(s, e) for s, e, k in base if k == kind]) for kind in KINDS[:3]]
        clear = lambda s, e: not any(meets(s, e) for meets in plain)
        in_end, named = _meets(ends), _meets(ids)
        weak += [(s, e, "identity") for s, e in ids if clear(s, e)]
        weak += [(s, e, "endpoint") for s, e in ends if clear(s, e)]
        for m in VALUE.finditer(text):
            s, e = m.span()
            own = text[s - 1 : s] == "=" and named(s, e)  # NAME=value of an identity is not its own secret
            if not own and _weak_value(m.group(), config) and clear(s, e) and not in_end(s, s + 1):
                weak.append((s, e, "value"))
    scopes = [m.end() for m in re.finditer(r"\n[\x20\t\r]*\n", text)] if weak else []
    return [(s, e, k, bisect.bisect_right(scopes, s)) for s, e, k in base + weak]


def linked(found: DataFrame, config: SecretConfig) -> DataFrame:
    """(row, start, end, kind) of the weak parts that complementary parts complete: an interval join of all parts of a
    row's scope within reach of each other.

    A part is dealt to the buckets of text that it covers, with reach on both sides for the one that asks, so the
    join's key is (row, scope, bucket) and a pair is met only near its place, however many parts a text has.
    """
    each = found.select("row", F.explode("parts").alias("p")).select("row", "p.*")
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])[F.col("kind")]
    width = config.reach + 1
    bucket = lambda lo, hi: F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))
    asking = each.where(F.col("kind").isin(*KINDS[3:])).withColumn("bucket", bucket(F.col("start") - config.reach, F.col("end") + config.reach))
    there = each.select("row", "scope", F.col("start").alias("s"), F.col("end").alias("e"), role.alias("role"), bucket(F.col("start"), F.col("end")).alias("bucket"))
    near = asking.join(there, ["row", "scope", "bucket"]).where((F.col("s") <= F.col("end") + config.reach) & (F.col("e") > F.col("start") - config.reach))
    has = lambda name: F.bool_or(F.col("role") == name).alias(name)
    roles = near.groupBy("row", "start", "end", "kind").agg(has("secret"), has("who"), has("where"))
    kept = F.when(F.col("kind") == "identity", F.col("secret")).when(F.col("kind") == "value", F.col("who") | F.col("where")).otherwise(F.col("secret") & F.col("who"))
    return roles.where(kept).select("row", "start", "end", "kind")


def scan_secrets(docs: DataFrame, config: SecretConfig = SecretConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, spans (array of start, end, kind in code points, by start, then kind).

    A weak identity is reported when a secret of any kind lies within reach in its scope, a weak value when an
    identity or endpoint does, an endpoint when both do.  Workers only find parts; rows with weak parts, few of all,
    are linked by a join.  NULL text is empty and has no spans; NULL ids and repeated rows are kept; an empty table
    gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for pdf in batches:
            found = [[{"start": s, "end": e, "kind": k, "scope": c} for s, e, k, c in parts(t, config)] for t in pdf["text"]]
            yield pd.DataFrame({"row": range(row, row + len(pdf)), "doc_id": pdf["doc_id"].astype("Int64"), "parts": found})
            row += len(pdf)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = slim.mapInPandas(run, "row long, doc_id long, parts array<struct<start:long,end:long,kind:string,scope:long>>")
    with scratch(spark):
        found = staged(found, "secret-parts", keep=True)
        weak = F.exists("parts", lambda x: x["kind"].isin(*KINDS[3:]))
        more = linked(found.where(weak), config).groupBy("row").agg(F.collect_list(F.struct("start", "end", "kind")).alias("more"))
        plain = F.transform(F.filter("parts", lambda x: x["kind"].isin(*KINDS[:3])), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
        alone = found.where(~weak).select("doc_id", plain.alias("all"))
        joined = found.where(weak).join(staged(more, "secret-links", keep=True), "row", "left")
        joined = joined.select("doc_id", F.concat(plain, F.coalesce("more", F.array().cast("array<struct<start:long,end:long,kind:string>>"))).alias("all"))
    return alone.unionByName(joined).select("doc_id", _in_order(F.col("all")).alias("spans"))


def _in_order(spans: Column) -> Column:
    """Spans by start, then by the kinds' order, then by end."""
    place = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"])
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), place(x).alias("place"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.transform(F.sort_array(keyed), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))


def secret_digest(found: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the plain kinds, and all spans as one string."""
    plain = F.filter("spans", lambda x: x["kind"].isin("assign", "access", "hex"))
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(text(plain), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
    )

