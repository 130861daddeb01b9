"""Inputs of the third review: zeros among best times, large sessions, flat losses, wide tables."""

import datetime
import hashlib
import itertools
import struct
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from gridspark.llm.pieces import Codec
from gridspark.operators import checks, order, ridge, simulation
from gridspark.plans import ORACLES, QUERIES, catalog, models
from gridspark.sources import responses
from test_queries import plain


def equals_sql(spark, folder, name, **tables):
    """The query's rows over these tables, which must be those of its SQL."""
    con = duckdb.connect()
    for t, pdf in tables.items():
        pdf.to_parquet(f"{folder}/{t}.parquet", coerce_timestamps="us")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, str(folder))
    got = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    out = con.sql(ORACLES[name])
    want = Counter(tuple(plain(r[out.columns.index(c)]) for c in sorted(df.columns)) for r in out.fetchall())
    assert got == want
    return got


def events(values, users=None, days=None):
    n = len(values)
    days = [0] * n if days is None else days
    at = [datetime.datetime(2024, 1, 1) + datetime.timedelta(days=int(d), seconds=k) for k, d in enumerate(days)]
    return pd.DataFrame({"event_id": range(n), "ts": at, "user_id": list(range(1, n + 1)) if users is None else users, "event_type": "click", "value": np.asarray(values, float), "props": '{"k": 1}'})


@pytest.mark.parametrize("name", ["pace_gap", "race_pace", "pace_coverage"])
def test_gaps_to_a_best_time_of_zero(spark, tmp_path, name):
    users = [1, 1, 1, 2, 3, 4, 5, 1, 2, 2, 2, 3, 4, 4, 4, 5]
    rows = events([0, 0, 0, 0, 5, 7, 9, 3, 0, 0, 0, 4, 2, 2, 2, 0], users, [0] * 7 + [1] * 9)
    assert equals_sql(spark, tmp_path, name, events=rows)


def test_contrasts_of_a_session_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(checks, "BLOCK", 40)
    rng = np.random.default_rng(3)
    made = []
    for session, variances in (("few", [0.5, 0.75]), ("many", None), (None, [0.5])):
        for k in range(300):
            made.append((session, k, float(np.round(rng.normal(), 1)) if k % 2 else float(rng.normal()), float(rng.choice(variances)) if variances else float(rng.uniform(0.1, 1))))
    made.append(("alone", 1, 0.0, 1.0))
    df = spark.createDataFrame(made, "g string, k long, e double, v double")
    got = {r["g"]: r for r in checks.contrast_coverage(df, ["g"], "k", "e", "v", F.lit(0.01)).collect()}
    assert set(got) == {"few", "many", None}
    for g, r in got.items():
        s = [(x[2] - y[2]) ** 2 / (x[3] + y[3] - 0.02) for x, y in itertools.combinations([m for m in made if m[0] == g], 2)]
        assert (r["n_entries"], r["n_pairs"]) == (300, len(s)) and r["mean_square"] == pytest.approx(np.mean(s), abs=1e-9)
        for z, c in ((checks.Z80, "coverage_80"), (checks.Z95, "coverage_95")):
            assert r[c] == sum(x <= z * z for x in s) / len(s)


def test_contrasts_of_more_pairs_than_an_int_holds(spark):
    n = 70_000
    df = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("e"), F.lit(1.0).alias("v"))
    row = checks.contrast_coverage(df, ["g"], "k", "e", "v").first()
    assert (row["n_entries"], row["n_pairs"]) == (n, n * (n - 1) // 2)
    near = sum(1 for d in range(-6, 7) for x in range(7) if 0 <= x + d < 7 and d * d / 2 <= checks.Z80**2)
    assert row["coverage_80"] == pytest.approx((near * (n // 7) ** 2 - n) / (n * (n - 1)))


def test_streams_hashed_together():
    heads, tails = ["7|a|12|", "x|", "r\u00e9|" * 3, "y" * 51], range(8, 1203, 7)
    want = [[struct.unpack(">4I", hashlib.md5(f"{h}{t}".encode()).digest()) for t in tails] for h in heads]
    assert simulation.hashed(heads, tails).tolist() == [[list(w) for w in row] for row in want]
    assert simulation.hashed(heads + ["z" * 80], tails)[:4].tolist() == [[list(w) for w in row] for row in want]
    draws = simulation.Draws(5, 3, range(900, 1100), 23, ("a",))
    k, c = simulation.hashed(["5|a|3|"], range(900, 1100))[0] % simulation.PRIME, np.arange(1, 24)
    h = [[(((int(x[0]) * int(i) + int(x[1])) % simulation.PRIME * int(i) + int(x[2])) % simulation.PRIME * int(i) + int(x[3])) % simulation.PRIME for i in c] for x in k]
    assert (draws.uniform("a") == (np.array(h) + 0.5) / float(simulation.PRIME)).all()


def test_workers_of_the_ridge_get_arrays(spark, monkeypatch):
    """A slice of levels reaches Python as arrays of numbers, whose size is that of the numbers."""
    seen, real = [], ridge._arrays
    monkeypatch.setattr(ridge, "_arrays", lambda *a, **k: seen.append(a[1:]) or real(*a, **k))
    rows = [(t, d, 1.0 + (t * d) % 3, float(t + d), float((t + d) ** 2)) for t in range(4) for d in range(9)]
    cells = spark.createDataFrame(rows, "t long, d long, w double, wy double, wyy double")
    fit = ridge.solve(cells, "t", "d", 1.0)
    assert {("i", "j", "v"), ("i", "w"), ("b", "i", "w"), ("b", "i")} <= set(seen)
    x = np.zeros((36, 14))
    x[:, 0], w, y = 1, np.array([r[2] for r in rows]), np.array([r[3] / r[2] for r in rows])
    for k, r in enumerate(rows):
        x[k, 1 + r[0]] = x[k, 5 + r[1]] = 1
    beta = np.linalg.solve(x.T @ (w[:, None] * x) + np.diag([0.0] + [1.0] * 13), x.T @ (w * y))
    got = {r["level"]: r["effect"] for r in fit.small.collect()}
    assert [got[t] for t in range(4)] == pytest.approx(beta[1:5].tolist())


def test_schedule_keeps_columns_and_races_need_no_window(spark):
    body = '{"MRData": {"RaceTable": {"Races": [{"season": "2024", "round": "3", "date": "2024-05-01", "Circuit": {"circuitId": "c"}, "QualifyingResults": [{"position": "1", "Q1": "1:10.0"}, {"position": "2", "Q1": "1:17.0"}]}]}}}'
    landed = spark.createDataFrame([(body, "t", "a"), (body, "t", "b")], "body string, fetched_at string, query string")
    assert sorted((r["query"], r["race_id"]) for r in responses.flatten_schedule(landed, keep=("query",)).collect()) == [("a", "2024_03"), ("b", "2024_03")]
    out = responses.flatten_qualifying(landed)
    assert sorted(r["qual_gap_pct"] for r in out.collect()) == [0.0, 0.0, 10.0, 10.0]
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_days_without_a_ranked_order_are_asked_for_a_temperature(spark, tmp_path):
    """Of four users a day, all are unclassified on day 5, and all but one on day 12: those days have no loss, but a row."""
    users, days = [], []
    for day, user in itertools.product(range(14), range(1, 5)):
        n = 7 if day == 5 or (day == 12 and user != 2) else (user + day) % 5 + 1
        users, days = users + [user] * n, days + [day] * n
    got = equals_sql(spark, tmp_path, "asof_ranking_calibration", events=events([(7 * k * k + 3 * u) % 101 for k, u in enumerate(users)], users, days))
    races = {i: n for i, n, _ in got}
    assert len(got) == 14 and (races[5], races[6], races[12], races[13]) == (5, 5, 11, 11)


@pytest.mark.parametrize("name", ["difficulty_index", "venue_speed_profile", "pass_rate", "pit_lane_loss"])
def test_venue_queries_read_their_lines_as_often_as_they_name_them(spark, monkeypatch, name):
    """Medians of a venue read their rows once: the fact table isn't read anew for each column, count and set of groups."""
    scans, real = [], catalog.table
    counted = spark.sparkContext.accumulator(0)

    def table(spark, sf_dir, t):
        df = real(spark, sf_dir, t)
        if t != "lineitem":
            return df
        scans.append(df.count())

        def seen(batches):
            for b in batches:
                counted.add(b.num_rows)
                yield b

        return df.mapInArrow(seen, df.schema)

    for m in (catalog, models):
        monkeypatch.setattr(m, "table", table)
    assert QUERIES[name](spark, f"{DATA}/sf0.001").collect() is not None
    assert counted.value <= sum(scans)


def test_quantiles_count_the_rows_of_a_group_over_several_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        made = [(g, float(k * 37 % 500) if k % 5 else None, -float(k % 11)) for g, n in (("a", 900), ("b", 3), (None, 40)) for k in range(n)] + [("none", None, None)] * 2
        df = spark.createDataFrame(made, "g string, x double, y double")
        got = {r["g"]: tuple(r)[1:] for r in order.quantiles(df, ["g"], {"x5": ("x", 0.5), "y3": ("y", 0.3), "x9": ("x", 0.9)}, "rows").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for g in {m[0] for m in made}:
        x, y = ([m[i] for m in made if m[0] == g and m[i] is not None] for i in (1, 2))
        want = (*(float(np.quantile(v, q)) if v else None for v, q in ((x, 0.5), (y, 0.3), (x, 0.9))), sum(m[0] == g for m in made))
        assert got[g] == pytest.approx(want, abs=1e-9) if x else got[g] == want


def test_merges_look_up_only_pairs_that_changed():
    """Byte-pair merges as plain rounds over all pairs give them, at a few lookups a character."""

    class Counted(dict):
        seen = 0

        def __getitem__(self, key):
            self.seen += 1
            return super().__getitem__(key)

        def __contains__(self, key):
            self.seen += 1
            return super().__contains__(key)

        def get(self, key, default=None):
            self.seen += 1
            return super().get(key, default)

    rng = np.random.default_rng(5)
    made = {"".join(rng.choice(list("abc"), k)) for k in (1, 2, 2, 3, 4, 4, 6, 8) for _ in range(12)}
    codec = Codec([(p, -float(i // 2), "normal") for i, p in enumerate(sorted(made))])
    plain = dict(codec.score)
    for n in (0, 1, 2, 3, 7, 12, 60):
        for text in ("".join(rng.choice(list("abcd"), n)) for _ in range(20)):
            want = list(text)
            while pairs := [(plain[x + y], -i) for i, (x, y) in enumerate(zip(want, want[1:])) if x + y in plain]:
                i = -max(pairs)[1]
                want[i : i + 2] = [want[i] + want[i + 1]]
            codec.score = Counted(plain)
            assert codec.merged(text) == want and codec.score.seen <= 3 * n
