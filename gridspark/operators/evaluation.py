"""Grouped ranking metrics, calibration, bootstraps, acceptance gates and price boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import american_to_decimal, american_to_implied, average_rank, hash_uniform, kelly_fraction, wilson
from .guards import ContractError

LOWER_IS_BETTER = frozenset({"rank_mae", "winner_logloss", "winner_brier", "ece"})
# Right edges of the fixed reliability bins.
EDGES = (0.02, 0.05, 0.10, 0.20, 0.35, 0.55, 1.0)


def race_metrics(df: DataFrame, group: list[str], entry: str, score: str, position: str, probability: str | None = None, classified: str | None = None) -> DataFrame:
    """Per group with a classified winner: top1, winner_top3, winner_rank, rank_mae, ndcg5, spearman, and log-loss and
    Brier of a probability.

    Rows without a score are left out.  Predicted order is by score, then entry; relevance is 6 - position between 0
    and 5, with gain 2^r - 1; spearman is over classified rows.  A group without any probability has NULL losses;
    require_probabilities refuses broken ones.
    """
    w = Window.partitionBy(*group)
    placed = F.coalesce(F.col(classified) == 1, F.lit(False)) if classified else F.lit(True)
    rel = F.least(F.greatest(6 - F.col(position), F.lit(0)), F.lit(5)).cast("double")
    out = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    out = out.withColumn("__r", F.row_number().over(w.orderBy(F.col(score).desc(), F.col(entry).cast("string")))).withColumn("__rel", rel).withColumn("__c", placed)
    out = out.withColumn("__i", F.row_number().over(w.orderBy(F.col("__rel").desc(), F.col(entry))))
    own = [*group, "__c"]
    out = out.withColumn("__p", average_rank(position, own)).withColumn("__q", average_rank("__r", own))
    gain = lambda rank: F.sum(F.when(F.col(rank) <= 5, (F.pow(F.lit(2.0), F.col("__rel")) - 1) / F.log2(F.col(rank) + 1.0)).otherwise(0.0))
    won = F.col("__c") & (F.col(position) == 1)
    p, q = F.when(F.col("__c"), F.col("__p")), F.when(F.col("__c"), F.col("__q"))
    winner_rank = F.min(F.when(won, F.col("__r")))
    metrics = [
        F.count("*").alias("n_entries"), (winner_rank == 1).cast("double").alias("top1"), (winner_rank <= 3).cast("double").alias("winner_top3"), winner_rank.cast("double").alias("winner_rank"),
        F.avg(F.abs(F.col("__r") - F.col(position))).alias("rank_mae"), F.try_divide(gain("__r"), gain("__i")).alias("ndcg5"),
        F.when((F.stddev_pop(p) > 0) & (F.count(p) > 2), F.corr(q, p)).alias("spearman"),
    ]
    if probability:
        x = F.col(probability).cast("double")
        metrics += [
            F.when(F.count(x) > 0, -F.ln(F.greatest(F.sum(F.when(won, x)), F.lit(1e-12)))).alias("winner_logloss"),
            F.avg(F.pow(x - won.cast("double"), 2)).alias("winner_brier"),
        ]
    return out.groupBy(*group).agg(*metrics).where("winner_rank IS NOT NULL")


def broken_probabilities(df: DataFrame, group: list[str], probability: str) -> DataFrame:
    """Groups that have probabilities, of which one is missing, not finite or outside [0, 1], or that do not sum to 1."""
    p = F.col(probability).cast("double")
    bad = F.coalesce(F.isnan(p) | (p < 0) | (p > 1), F.lit(True))
    per = df.groupBy(*group).agg(F.count(p).alias("n"), F.bool_or(bad).alias("bad"), F.sum(p).alias("total"))
    return per.where(F.col("n") > 0).where(F.col("bad") | (F.abs(F.col("total") - 1) > 1e-6)).select(*group, "n", "total")


def require_probabilities(df: DataFrame, group: list[str], probability: str) -> DataFrame:
    if not broken_probabilities(df, group, probability).isEmpty():
        raise ContractError(f"{probability} must be finite, within [0, 1] and sum to one by {', '.join(group)}")
    return df


def leaderboard(per_race: DataFrame, model: str, metrics: list[str]) -> DataFrame:
    low, high = wilson(F.sum("top1"), F.count("*").cast("double"))
    return per_race.groupBy(model).agg(F.count("*").alias("n_races"), *[F.avg(m).alias(m) for m in metrics], low.alias("top1_low"), high.alias("top1_high"))


def paired_deltas(a: DataFrame, b: DataFrame, race: str, metric: str) -> DataFrame:
    x, y = a.select(race, F.col(metric).alias("__a")), b.select(race, F.col(metric).alias("__b"))
    return x.join(y, race).withColumn("delta", F.col("__b") - F.col("__a")).where("delta IS NOT NULL AND NOT isnan(delta)").select(race, "delta")


def bootstrap(deltas: DataFrame, order: str, metric: str | Column, draws: int = 10000, seed: int = 20260913, block: int = 1, season: str | None = None, by: list[str] | None = None) -> DataFrame:
    """delta, ci_low, ci_high, p_better, n_races (for each group of by), by resampling whole races, or circular blocks
    within seasons.

    Draws are spread by draw number; every task has the races of a group (a few thousand at most) as an array, and
    a draw's mean is an aggregate over hashed places, so no draw is ever joined with all races as rows.
    """
    by = by or []
    name = metric if isinstance(metric, Column) else F.lit(metric)
    in_order = Window.partitionBy(*by, *([season] if season else [])).orderBy(order)
    rows = deltas.select(*by, name.alias("__metric"), F.col(season).alias("__s") if season else F.lit(0).alias("__s"), (F.row_number().over(in_order) - 1).alias("__i"), "delta")
    seasons = rows.groupBy(*by, "__metric", "__s").agg(F.transform(F.sort_array(F.collect_list(F.struct("__i", "delta"))), lambda x: x["delta"]).alias("v"))
    whole = seasons.groupBy(*by, "__metric").agg(F.collect_list(F.struct("__s", "v")).alias("all"))
    n_tasks = int(deltas.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draw = whole.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // 100)))).repartition(n_tasks, *by, "chunk")
    draw = draw.withColumn("draw", F.explode(F.sequence((F.col("chunk") * 100).cast("long"), (F.least(F.col("chunk") * 100 + 100, F.lit(draws)) - 1).cast("long"))))
    draw = draw.select(*by, "__metric", "draw", F.explode("all").alias("s"))
    n = F.size("s.v")
    width = F.least(F.lit(block), n)
    start = lambda j: F.floor(hash_uniform(F.lit(seed), F.col("__metric"), F.col("draw"), F.col("s.__s"), F.floor(j / width)) * n)
    value = lambda j: F.element_at(F.col("s.v"), ((start(j) + j % width) % n + 1).cast("int"))
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda acc, j: acc + value(j))
    means = draw.select(*by, "__metric", "draw", total.alias("t"), n.alias("n")).groupBy(*by, "__metric", "draw").agg((F.sum("t") / F.sum("n")).alias("mean"))
    better = F.when(F.col("__metric").isin(*LOWER_IS_BETTER), F.col("mean") < 0).otherwise(F.col("mean") > 0)
    out = means.groupBy(*by, "__metric").agg(F.percentile("mean", 0.025).alias("ci_low"), F.percentile("mean", 0.975).alias("ci_high"), F.avg(better.cast("double")).alias("p_better"))
    own = deltas.groupBy(*by).agg(F.avg("delta").alias("delta"), F.count("*").alias("n_races"))
    out = own.join(F.broadcast(out), by) if by else own.join(F.broadcast(out))
    return out.drop("__metric")


def paired_table(per_race: DataFrame, incumbent: str, race: str, metrics: tuple[str, ...] = ("top1", "ndcg5", "spearman", "rank_mae", "winner_logloss"), model: str = "model", draws: int = 10000, block: int = 1, season: str | None = None) -> DataFrame:
    """model, incumbent, metric and the paired bootstrap of every other model against the incumbent, race by race.

    Metrics are unpivoted once and met with the incumbent's by one join on race and metric.
    """
    if per_race.where(F.col(model) == incumbent).isEmpty():
        raise ContractError(f"incumbent {incumbent} is absent from the metric table")
    kept = [season] if season else []
    flat = per_race.select(race, model, *kept, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])))
    flat = flat.where("x IS NOT NULL AND NOT isnan(x)")
    base = flat.where(F.col(model) == incumbent).select(race, "metric", F.col("x").alias("__base"))
    deltas = flat.where(F.col(model) != incumbent).join(base, [race, "metric"]).select(race, *kept, F.col(model).alias("model"), "metric", (F.col("x") - F.col("__base")).alias("delta"))
    out = bootstrap(deltas, race, F.col("metric"), draws, block=block, season=season, by=["model", "metric"])
    return out.select("model", F.lit(incumbent).alias("incumbent"), "metric", "delta", "ci_low", "ci_high", "p_better", "n_races")


def calibration_table(df: DataFrame, probability: str, outcome: str, bins: int | None = 10, edges: tuple[float, ...] = EDGES, by: list[str] | None = None) -> DataFrame:
    """bin, n, predicted, observed, gap (signed, observed less predicted), weight: equal-width bins closed on the right,
    or fixed edges if bins is None.  Probabilities outside [0, 1] are in no bin."""
    p, by = F.col(probability), by or []
    if bins:
        place = F.greatest(F.ceil(F.round(p * bins, 9)), F.lit(1))
    else:
        place = F.lit(None).cast("long")
        for k in range(len(edges), 0, -1):
            place = F.when(p <= edges[k - 1], F.lit(k)).otherwise(place)
    rows = df.where(p.between(0, 1) & F.col(outcome).isNotNull()).select(*by, place.cast("long").alias("bin"), p.alias("p"), F.col(outcome).cast("double").alias("y"))
    out = rows.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("p").alias("predicted"), F.avg("y").alias("observed"), (F.avg("y") - F.avg("p")).alias("gap"))
    return out.withColumn("weight", F.col("n") / F.sum("n").over(Window.partitionBy(*(by or [F.lit(0)]))))


def expected_calibration_error(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    return table.groupBy(*(by or [])).agg(F.try_divide(F.sum(F.abs(F.col("gap")) * F.col("n")), F.sum("n")).alias("ece"), F.sum("n").alias("n"))


#: Metrics of which one must be clearly better.
PRIMARY = ("top1", "ndcg5", "winner_logloss")


def _clearly_better() -> Column:
    right = F.when(F.col("metric").isin(*LOWER_IS_BETTER), F.col("ci_high") < 0).otherwise(F.col("ci_low") > 0)
    return (F.col("p_better") >= 0.975) & right


def acceptance(predictions: DataFrame, per_race: DataFrame, incumbent: str, race: str, tests_passed: bool, season: str = "season", window: tuple[int, int] = (2022, 2025), draws: int = 10000, least_races: int = 30, probability: str = "win_probability", winner: str = "winner", scope: str = "evaluation_scope", blocks: tuple[int, ...] = ()) -> DataFrame:
    """A row per challenger: n_races, win_ece, incumbent_win_ece, the seven gates and adopt, which needs all of them.

    predictions has (model, race, season, probability, winner, evaluation_scope), per_race the metrics of each model.
    With blocks, an eighth gate needs one primary metric clearly better at every block size within seasons.
    """
    if not predictions.where(~F.coalesce(F.col(season).between(*window), F.lit(False))).isEmpty():
        raise ContractError("acceptance data must lie in the tuning window")
    shown = predictions.where(F.col(probability).isNotNull())
    ece = expected_calibration_error(calibration_table(shown, probability, winner, by=["model"]), ["model"]).select("model", F.col("ece").alias("win_ece"))
    old = ece.where(F.col("model") == incumbent).select(F.col("win_ece").alias("incumbent_win_ece"))
    brier = per_race.groupBy("model").agg(F.avg("winner_brier").alias("brier"))
    old_brier = brier.where(F.col("model") == incumbent).select(F.col("brier").alias("old_brier"))
    has = shown.groupBy("model").agg(F.countDistinct(race).alias("n_races"), F.bool_and(F.col(scope) == "timestamped_snapshot").alias("timestamped"))
    tests = paired_table(per_race, incumbent, race, PRIMARY, draws=draws)
    improved = tests.groupBy("model").agg(F.bool_or(_clearly_better()).alias("improved"))
    out = has.where(F.col("model") != incumbent).join(ece, "model").join(brier, "model").join(improved, "model", "left").join(F.broadcast(old)).join(F.broadcast(old_brier))
    false = F.lit(False)
    gates = {
        "tests_passed": F.lit(bool(tests_passed)), "tuning_only": F.lit(True), "enough_paired_races": F.col("n_races") >= least_races, "timestamped_snapshots": F.coalesce("timestamped", false),
        "calibration_not_degraded": F.coalesce(F.col("win_ece") <= F.col("incumbent_win_ece") + 1e-12, false), "brier_not_degraded": F.coalesce(F.col("brier") <= F.col("old_brier") + 1e-12, false),
        "primary_improved": F.coalesce("improved", false),
    }
    if blocks:
        support = block_support(per_race, incumbent, race, season, blocks, draws)
        out = out.join(support, "model", "left")
        gates["blocks_support"] = F.coalesce("supported", false)
    out = out.select("model", F.lit(incumbent).alias("incumbent"), "n_races", "win_ece", "incumbent_win_ece", *[g.alias(k) for k, g in gates.items()])
    adopt = F.lit(True)
    for k in gates:
        adopt = adopt & F.col(k)
    return out.withColumn("adopt", adopt)


def block_support(per_race: DataFrame, incumbent: str, race: str, season: str, blocks: tuple[int, ...] = (4, 8), draws: int = 10000) -> DataFrame:
    """model, supported: whether one primary metric is clearly better at every block size, by circular blocks within
    seasons."""
    out = None
    for size in blocks:
        one = paired_table(per_race, incumbent, race, PRIMARY, draws=draws, block=size, season=season).select("model", "metric", _clearly_better().alias("ok"))
        out = one if out is None else out.unionByName(one)
    per = out.groupBy("model", "metric").agg(F.bool_and("ok").alias("ok"))
    return per.groupBy("model").agg(F.bool_or("ok").alias("supported"))


def market_board(odds: DataFrame, column: str = "american_odds", board: list[str] | None = None) -> DataFrame:
    """odds with implied_raw, decimal_odds, the overround of their board (all rows, if none is named) and the market's
    probability."""
    out = odds.withColumn("implied_raw", american_to_implied(F.col(column))).withColumn("decimal_odds", american_to_decimal(F.col(column)))
    total = F.sum("implied_raw")
    out = out.withColumn("overround", total.over(Window.partitionBy(*board))) if board else out.join(F.broadcast(out.agg(total.alias("overround"))))
    return out.withColumn("market_probability", F.when(F.col("overround") > 0, F.col("implied_raw") / F.col("overround")).otherwise(F.col("implied_raw")))


def price_board(forecast: DataFrame, odds: DataFrame, key: list[str], probability: str = "win_probability", board: list[str] | None = None) -> DataFrame:
    p = F.col(probability)
    out = forecast.join(market_board(odds, board=board), key)
    out = out.withColumn("expected_value", p * F.col("decimal_odds") - 1).withColumn("edge_vs_market_pp", 100 * (p - F.col("market_probability")))
    return out.withColumn("kelly_fraction", kelly_fraction(p, F.col("decimal_odds")))


def compare_to_market(board: DataFrame, group: list[str], probability: str = "win_probability") -> DataFrame:
    rank = lambda c: F.rank().over(Window.partitionBy(*group).orderBy(F.col(c).desc_nulls_last()))
    out = board.withColumn("model_rank", rank(probability)).withColumn("market_rank", rank("market_probability"))
    return out.withColumn("disagreement", F.abs(F.col("model_rank") - F.col("market_rank")))


def agreement(compared: DataFrame, key: str, board: list[str], probability: str = "win_probability") -> DataFrame:
    """Per board of compare_to_market's rows with a market probability: Spearman correlation, mean and largest edge,
    whether both have the same favourite, and the overround."""
    rows = compared.where("market_probability IS NOT NULL")
    ranked = rows.withColumn("__x", average_rank(probability, board)).withColumn("__y", average_rank("market_probability", board))
    edge = F.abs(F.col("edge_vs_market_pp"))
    favourite = lambda c: F.max(F.struct(F.col(c).alias("p"), (-F.col("__o")).alias("o"), F.col(key).alias("k"))).getField("k")
    ranked = ranked.withColumn("__o", F.row_number().over(Window.partitionBy(*board).orderBy(key)))
    spread = (F.stddev_pop("__x") > 0) & (F.stddev_pop("__y") > 0)
    return ranked.groupBy(*board).agg(
        F.when(spread, F.corr("__x", "__y")).alias("spearman_vs_market"), F.avg(edge).alias("mean_abs_edge_pp"), F.max(edge).alias("max_abs_edge_pp"),
        (favourite(probability) == favourite("market_probability")).alias("same_favourite"), F.first("overround").alias("overround"))


def market_efficiency(board: DataFrame, by: list[str]) -> DataFrame:
    """How much room a priced board leaves: overround, house margin, disagreement and expected values."""
    edge = F.abs(F.col("edge_vs_market_pp"))
    out = board.groupBy(*by).agg(
        F.first("overround").alias("overround"), F.avg(edge).alias("mean_abs_disagreement_pp"), F.max(edge).alias("max_abs_disagreement_pp"),
        F.count(F.when(F.col("expected_value") > 0, 1)).alias("selections_with_positive_ev"), F.count("*").alias("selections"), F.max("expected_value").alias("best_expected_value"))
    return out.withColumn("house_margin_pct", 100.0 * (1.0 - F.try_divide(F.lit(1.0), F.col("overround"))))


def settle(board: DataFrame, won: str, bankroll: float = 1000.0, multiplier: float = 0.25, least_value: float = 0.05) -> DataFrame:
    plan = board.where(F.col("expected_value") >= least_value).withColumn("stake", bankroll * multiplier * F.col("kelly_fraction")).where("stake > 0")
    plan = plan.withColumn("returned", F.when(F.col(won), F.col("stake") * F.col("decimal_odds")).otherwise(0.0))
    return plan.withColumn("profit", F.col("returned") - F.col("stake"))


def staking_report(settled: DataFrame) -> DataFrame:
    return settled.agg(
        F.count("*").alias("n_bets"), F.sum("stake").alias("staked"), F.sum("returned").alias("returned"), F.sum("profit").alias("profit"), F.try_divide(F.sum("profit"), F.sum("stake")).alias("roi")
    )


def softmax(df: DataFrame, score: str, group: list[str], temperature: float = 1.0, name: str = "probability") -> DataFrame:
    w = Window.partitionBy(*group)
    return df.withColumn("__e", F.exp((F.col(score) - F.max(score).over(w)) / temperature)).withColumn(name, F.col("__e") / F.sum("__e").over(w)).drop("__e")


def fit_temperature(df: DataFrame, probability: str, group: list[str], winner: str, grid: list[float]) -> DataFrame:
    """temperature, loss for each of a grid: mean winner log-loss over groups with one winner.

    The grid is a literal array exploded beside each row, and both sums are partial aggregates.
    """
    rows = df.select(*group, F.greatest(F.col(probability), F.lit(1e-12)).alias("p"), F.col(winner).cast("int").alias("y"), F.explode(F.array(*map(F.lit, grid))).alias("temperature"))
    per = rows.groupBy(*group, "temperature").agg(F.sum(F.pow(F.col("p"), 1 / F.col("temperature"))).alias("z"), F.sum("y").alias("n"), F.max(F.when(F.col("y") == 1, F.col("p"))).alias("pw"))
    loss = -F.ln(F.greatest(F.pow(F.col("pw"), 1 / F.col("temperature")) / F.col("z"), F.lit(1e-12)))
    return per.where("n = 1").groupBy("temperature").agg(F.avg(loss).alias("loss"), F.count("*").alias("n_races"))


def geometric_grid(low: float, high: float, n: int) -> list[float]:
    """n values from low to high in equal ratios."""
    return [low * (high / low) ** (k / (n - 1)) for k in range(n)]


def best_temperature(df: DataFrame, probability: str, group: list[str], winner: str, grid: list[float] | None = None) -> DataFrame:
    """temperature, loss_before (at 1), loss_after, n_races, improved: the grid's least loss, ties to the lowest; without
    races the temperature is 1."""
    grid = grid or geometric_grid(0.3, 4.0, 80)
    losses = fit_temperature(df, probability, group, winner, [*grid, 1.0] if 1.0 not in grid else grid)
    inside = F.col("temperature").isin(*grid)
    best = F.min(F.when(inside, F.struct("loss", "temperature")))
    out = losses.agg(best.alias("b"), F.max(F.when(F.col("temperature") == 1.0, F.col("loss"))).alias("loss_before"), F.max("n_races").alias("n_races"))
    better = F.coalesce(F.col("b.loss") < F.col("loss_before"), F.lit(False))
    return out.select(
        F.when(better, F.col("b.temperature")).otherwise(1.0).alias("temperature"), "loss_before", F.when(better, F.col("b.loss")).otherwise(F.col("loss_before")).alias("loss_after"),
        F.coalesce("n_races", F.lit(0).cast("long")).alias("n_races"), better.alias("improved"))


# Published probabilities and the outcomes that they are about.
PUBLISHED = {"win_probability": "winner", "podium_probability": "podium", "top10_probability": "top10", "dnf_probability": "dnf"}


def with_outcomes(df: DataFrame) -> DataFrame:
    """podium and top10 from classified positions; winner and dnf too, unless the rows have them."""
    placed = F.coalesce(F.col("classified").cast("double"), F.lit(0.0)) != 0
    up_to = lambda k: F.coalesce(placed & (F.col("position_order") <= k), F.lit(False)).cast("double")
    derived = {"podium": up_to(3), "top10": up_to(10)}
    derived |= {k: v for k, v in {"winner": up_to(1), "dnf": (~placed).cast("double")}.items() if k not in df.columns}
    return df.withColumns(derived)


def probability_report(df: DataFrame, bins: int = 10) -> DataFrame:
    """A row per published probability that df has: count, means, calibration error, Brier score; and one for the
    share of finishes between the published 10% and 90% quantiles.  All pairs are unpivoted and binned in one pass."""
    rows = with_outcomes(df)
    have = [p for p in PUBLISHED if p in df.columns]
    pairs = F.array(*[F.struct(F.lit(PUBLISHED[p]).alias("outcome"), F.lit(p).alias("probability_column"), F.col(p).cast("double").alias("p"), F.col(PUBLISHED[p]).cast("double").alias("y")) for p in have])
    flat = rows.select(F.inline(pairs)).where("p IS NOT NULL AND y IS NOT NULL")
    bin_ = F.greatest(F.ceil(F.round(F.col("p") * bins, 9)), F.lit(1))
    key = ["outcome", "probability_column"]
    binned = flat.groupBy(*key, bin_.alias("bin")).agg(F.count("*").alias("n"), F.sum("p").alias("p"), F.sum("y").alias("y"), F.sum((F.col("p") - F.col("y")) ** 2).alias("e"))
    n = F.sum("n")
    out = binned.groupBy(*key).agg(n.alias("n"), (F.sum("p") / n).alias("predicted_mean"), (F.sum("y") / n).alias("observed_rate"), (F.sum(F.abs(F.col("p") - F.col("y"))) / n).alias("ece"), (F.sum("e") / n).alias("brier"))
    if not {"finish_p10", "finish_p90", "position_order"} <= set(df.columns):
        return out
    inside = F.col("position_order").between(F.col("finish_p10"), F.col("finish_p90")).cast("double")
    band = df.where(inside.isNotNull()).agg(F.count("*").alias("n"), F.avg(inside).alias("observed_rate")).where("n > 0")
    band = band.select(
        F.lit("finish_inside_p10_p90").alias("outcome"), F.lit("finish_p10..finish_p90").alias("probability_column"), "n", F.lit(0.8).alias("predicted_mean"), "observed_rate",
        F.abs(F.col("observed_rate") - 0.8).alias("ece"), F.lit(None).cast("double").alias("brier"),
    )
    return out.unionByName(band)
