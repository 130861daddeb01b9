"""Streams stopped and started again from their checkpoint give what one batch over all rows gives."""

import shutil

import pytest
from pyspark.sql import functions as F

from gridspark.streaming import ordered


@pytest.fixture
def stored(spark):
    for k, v in ordered.STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k in ordered.STORE:
        spark.conf.unset(k)


def days_of(ev, tmp_path, n):
    """Events in n files of consecutive stretches of time, beside the folder that a stream reads."""
    cut = ev.withColumn("part", (F.dayofmonth("ts") * n / 32).cast("int")).orderBy("ts")
    out = []
    for k in range(n):
        cut.where(F.col("part") == k).drop("part").coalesce(1).write.parquet(f"{tmp_path}/landing/{k}")
        out.append(f"{tmp_path}/landing/{k}")
    return out


def land(path, folder, k):
    folder.mkdir(exist_ok=True)
    for f in path.glob("*.parquet"):
        shutil.copy(f, folder / f"{k}-{f.name}")


def test_levels_follow_order_over_restarts(stored, sf, tmp_path):
    from pathlib import Path

    spark = stored
    ev = spark.read.parquet(f"{sf}/events.parquet").where("user_id % 5 = 0")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000.0
    want = {}
    for r in ev.select("user_id", at.alias("at"), "value").orderBy("user_id", "at").collect():
        t, m, p, n = want.get(r["user_id"], (None, 0.0, 100.0, 0))
        if r["value"] is not None:
            p += r["at"] - t if t is not None else 0.0
            g = p / (p + 50.0)
            t, m, p, n = r["at"], m + g * (r["value"] - m), p * (1 - g), n + 1
        want[r["user_id"]] = (t, m, p, n)
    parts = days_of(ev, tmp_path, 3)
    for k, part in enumerate(parts):
        land(Path(part), tmp_path / "in", k)
        stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
        ordered.append(ordered.stream_levels(stream, "user_id", at, "value"), str(tmp_path / "out"), str(tmp_path / "ck"))
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == ev.count() and not rows.where("refused").count()
    last = {r["key"]: r["x"] for r in rows.groupBy("key").agg(F.max(F.struct("n", "at", "level", "variance")).alias("x")).collect()}
    assert set(last) == set(want)
    for k, (_, m, p, n) in want.items():
        assert (last[k]["n"], last[k]["level"], last[k]["variance"]) == (n, pytest.approx(m), pytest.approx(p))
    # The first file once more: all its rows are behind the state, which stays.
    land(Path(parts[0]), tmp_path / "in", 9)
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    ordered.append(ordered.stream_levels(stream, "user_id", at, "value"), str(tmp_path / "out"), str(tmp_path / "ck"))
    again = spark.read.parquet(str(tmp_path / "out"))
    late = spark.read.parquet(parts[0]).count()
    assert again.where("refused").count() == late
    for r in again.where("refused").select("key", "n", "level").distinct().collect():
        assert (r["n"], r["level"]) == (want[r["key"]][3], pytest.approx(want[r["key"]][1]))
    land(Path(parts[1]), tmp_path / "in", 10)
    with pytest.raises(Exception, match="Backwards"):
        ordered.append(ordered.stream_levels(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in")), "user_id", at, "value", strict=True), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == again.count()


@pytest.mark.parametrize("kind", ["sessions", "quota"])
def test_windows_over_restarts(spark, sf, tmp_path, kind):
    from pathlib import Path

    ev = spark.read.parquet(f"{sf}/events.parquet")
    made = lambda rows: ordered.sessions(rows, "user_id", "ts", "6 hours", "1 hour", "value") if kind == "sessions" else ordered.quota_windows(rows, "event_type", "ts", 3, "12 hours", "3 hours")
    for k, part in enumerate(days_of(ev, tmp_path, 3)):
        land(Path(part), tmp_path / "in", k)
        ordered.append(made(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    plain = lambda df: sorted(tuple(round(x, 6) if isinstance(x, float) else str(x) for x in r) for r in df.collect())
    last = ev.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    closed = made(ev).where(F.col("end") <= F.lit(last) - F.expr("INTERVAL 1 HOUR"))
    got = plain(spark.read.parquet(str(tmp_path / "out")))
    assert got == plain(closed) and len(got) > 10
    # A row from long before the watermark opens nothing.
    old = ev.orderBy("ts").limit(1)
    old.coalesce(1).write.parquet(f"{tmp_path}/old")
    land(tmp_path / "old", tmp_path / "in", 7)
    ordered.append(made(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert plain(spark.read.parquet(str(tmp_path / "out"))) == got
