"""Jobs from the command line on a small league."""

import json

import numpy as np

from gridspark import cli


def test_jobs(spark, tmp_path, capsys):
    rng = np.random.default_rng(1)
    calendar, results, timed = [], [], []
    for s in (2024, 2025):
        for r in range(1, 6):
            race = f"{s}_{r:02d}"
            calendar.append((race, s, r, f"{s}-03-{r:02d}"))
            order = sorted(range(6), key=lambda d: d + rng.normal(0, 1))
            results += [(race, f"d{d}", "abc"[d // 2], p, 1, 1, 0) for p, d in enumerate(order, 1)]
            timed += [(race, f"d{d}", "abc"[d // 2], float(p)) for p, d in enumerate(order)]
    folder = f"{tmp_path}/panel"
    spark.createDataFrame(calendar, "race_id string, season int, round int, date string").write.parquet(f"{folder}/schedule.parquet")
    spark.createDataFrame(results, "race_id string, driver_id string, constructor_id string, position_order int, classified int, started int, dnf int").write.parquet(f"{folder}/results.parquet")
    spark.createDataFrame(timed, "race_id string, driver_id string, constructor_id string, qual_gap_pct double").write.parquet(f"{folder}/qualifying.parquet")
    root = ["--root", str(tmp_path)]
    assert cli.main([*root, "backtest", folder, "--out", f"{tmp_path}/out", "--sims", "300", "--draws", "200", "--seasons", "2024", "2025"], spark) == 0
    board = {r["model"]: r for r in spark.read.option("header", True).option("inferSchema", True).csv(f"{tmp_path}/out/leaderboard").collect()}
    assert board["simulation"]["n_races"] == 9 and board["simulation"]["ndcg5"] > board["uniform"]["ndcg5"] * 0.5
    assert spark.read.option("header", True).csv(f"{tmp_path}/out/skipped").count() == 1 and spark.read.option("header", True).csv(f"{tmp_path}/out/paired_tests").count() == 4
    assert len(json.loads((tmp_path / "out" / "manifest.json").read_text())["inputs"]) >= 3
    (tmp_path / "entries.csv").write_text("race_id,driver_id,constructor_id\n" + "\n".join(f"2025_05,d{d},{'abc'[d // 2]}" for d in range(6)) + "\n2025_05,rookie,a\n")
    assert cli.main([*root, "predict", folder, f"{tmp_path}/entries.csv", "--out", f"{tmp_path}/next", "--sims", "300"], spark) == 0
    made = {r["driver"]: r for r in spark.read.parquet(f"{tmp_path}/next/forecast").collect()}
    assert len(made) == 7 and made["rookie"]["is_rookie"] and made["d0"]["predicted_rank"] < made["d5"]["predicted_rank"]
    (tmp_path / "landed" / "schedule").mkdir(parents=True)
    race = {"season": "2026", "round": "1", "raceName": "R", "date": "2026-03-01", "Circuit": {"circuitId": "c", "circuitName": "C", "Location": {}}}
    (tmp_path / "landed" / "schedule" / "1.json").write_text(json.dumps({"MRData": {"RaceTable": {"Races": [race]}}}))
    assert cli.main([*root, "ingest", f"{tmp_path}/landed", "--out", f"{tmp_path}/flat"], spark) == 0
    assert spark.read.parquet(f"{tmp_path}/flat/schedule.parquet").first()["race_id"] == "2026_01"
    assert cli.main([*root, "ingest", f"{tmp_path}/landed", "--out", "/elsewhere"], spark) == 2 and "outside" in capsys.readouterr().err
