"""Score matrices in long form (run, exam, i, j, value), their metrics, seed aggregates, comparisons and verdicts.

value null: not scored; NaN: not examined. i is the phase trained last, j the phase examined; i = -1 is the untrained model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sign of each exam's score; exams that may decide a hypothesis; thresholds of the verdicts.
SIGNS = {"perplexity": -1, "cloze": 1, "continuation": 1, "continuation_summed": 1}
DECIDING = ("continuation", "cloze")
H1_CONFIRM, H1_KILL, H2A_POINTS, H3_POINTS, BAND_LOW, BAND_HIGH = 0.15, 0.05, 3.0, 5.0, 1.5, 2.0


def scores(matrix: DataFrame) -> DataFrame:
    """Finite cells with the sign under which more is better."""
    sign = F.when(F.col("exam") == "perplexity", -1).otherwise(1)
    return matrix.where(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("score", F.col("value") * sign)


def incomplete(matrix: DataFrame, phases: int = 7) -> DataFrame:
    """(run, exam, i, n_bad) of rows with cells that are missing, null or not finite."""
    good = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    return matrix.where("i >= 0").groupBy("run", "exam", "i").agg((phases - F.sum(F.when(good, 1).otherwise(0))).alias("n_bad")).where("n_bad > 0")


def average_accuracy(matrix: DataFrame) -> DataFrame:
    """Mean of the last row."""
    rows = scores(matrix)
    last = rows.groupBy("run", "exam").agg(F.max("i").alias("i"))
    return rows.join(last, ["run", "exam", "i"]).groupBy("run", "exam").agg(F.avg("score").alias("value"))


def forgetting(matrix: DataFrame) -> DataFrame:
    """(run, exam, j, peak, final, forgetting): the best score of a phase less its last."""
    rows = scores(matrix).where("i >= 0")
    out = rows.groupBy("run", "exam", "j").agg(F.max("score").alias("peak"), F.max_by("score", "i").alias("final"))
    return out.withColumn("forgetting", F.col("peak") - F.col("final"))


def average_forgetting(matrix: DataFrame) -> DataFrame:
    """Mean forgetting of all phases but the last."""
    rows = forgetting(matrix)
    last = rows.groupBy("run", "exam").agg(F.max("j").alias("last"))
    return rows.join(last, ["run", "exam"]).where("j < last").groupBy("run", "exam").agg(F.avg("forgetting").alias("value"))


def forward_transfer(matrix: DataFrame) -> DataFrame:
    """(run, exam, j, transfer): the score of a phase before it was trained, less the untrained model's; the first has none."""
    rows = scores(matrix)
    phases = rows.where("i >= 0").select("run", "exam", F.col("j")).distinct()
    before = F.lag("j").over(Window.partitionBy("run", "exam").orderBy("j"))
    need = phases.withColumn("before", before)
    at = rows.select("run", "exam", F.col("i").alias("before"), "j", F.col("score").alias("prior"))
    base = rows.where("i = -1").select("run", "exam", "j", F.col("score").alias("base"))
    out = need.join(at, ["run", "exam", "before", "j"], "left").join(base, ["run", "exam", "j"], "left")
    return out.select("run", "exam", "j", (F.col("prior") - F.col("base")).alias("transfer"))


def peak_lost(matrix: DataFrame) -> DataFrame:
    """(run, exam, j, lost): share of the peak lost, for exams that may decide and peaks above zero."""
    rows = forgetting(matrix.where(F.col("exam").isin(*DECIDING)))
    return rows.where("peak > 0").select("run", "exam", "j", (F.col("forgetting") / F.col("peak")).alias("lost"))


def mean_matrix(matrix: DataFrame, by: list[str]) -> DataFrame:
    """(by, exam, i, j, mean): cell by cell over runs; a cell that is NaN in one run is NaN in the mean."""
    return matrix.where("i >= 0").groupBy(*by, "exam", "i", "j").agg(F.avg("value").alias("mean"))


def forgetting_curve(matrix: DataFrame, by: list[str]) -> DataFrame:
    """(by, exam, i, mean, sd, n): the first phase's value after each phase; one run has no spread."""
    sd = F.coalesce(F.when(F.count("value") > 1, F.stddev_samp("value")), F.lit(0.0))
    return matrix.where("i >= 0 and j = 0").groupBy(*by, "exam", "i").agg(F.avg("value").alias("mean"), sd.alias("sd"), F.count("value").alias("n"))


def dense(matrix: DataFrame, phases: int = 7) -> DataFrame:
    """The whole grid of cells of each run and exam, untrained row included, null where there is no score."""
    side = F.explode(F.sequence(F.lit(-1), F.lit(phases - 1)))
    grid = matrix.select("run", "exam").distinct().withColumn("i", side).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(phases - 1))))
    return grid.join(matrix, ["run", "exam", "i", "j"], "left")


def shape_violations(matrix: DataFrame, phases: int = 7) -> DataFrame:
    """(run, exam, i, n): rows of scores that don't have one number for each phase."""
    return matrix.groupBy("run", "exam", "i").agg(F.countDistinct("j").alias("n"), F.count("j").alias("c"), F.min("j").alias("low"), F.max("j").alias("high")).where(f"n <> {phases} or c <> n or low < 0 or high >= {phases}").select("run", "exam", "i", "n")


def seed_aggregate(rows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Mean, sample standard deviation (0 for one seed) and seeds of a value."""
    sd = F.coalesce(F.when(F.count(value) > 1, F.stddev_samp(value)), F.lit(0.0))
    seeds = F.array_join(F.transform(F.array_sort(F.collect_list("seed")), lambda s: s.cast("string")), ",")
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), sd.alias("sd"), F.count(value).alias("n"), seeds.alias("seeds"))


def compared(one: Column, one_sd: Column, two: Column, two_sd: Column) -> tuple[Column, Column, Column]:
    """Difference, spread (the larger deviation) and whether the difference exceeds it."""
    diff, spread = one - two, F.greatest(one_sd, two_sd)
    return diff, spread, F.abs(diff) > spread


def compare(aggregates: DataFrame, pairs: list[tuple[str, str]], metric: str = "metric") -> DataFrame:
    """Arms against arms on each metric."""
    rows = aggregates.sparkSession.createDataFrame(pairs, "arm string, other string")
    b = aggregates.select(F.col("arm").alias("other"), metric, F.col("mean").alias("other_mean"), F.col("sd").alias("other_sd"))
    out = aggregates.join(F.broadcast(rows), "arm").join(b, ["other", metric])
    diff, spread, decided = compared(F.col("mean"), F.col("sd"), F.col("other_mean"), F.col("other_sd"))
    return out.select("arm", "other", metric, diff.alias("diff"), spread.alias("spread"), decided.alias("decided"))


def run_results(matrix: DataFrame, runs: DataFrame, exam: str) -> DataFrame:
    """(run, arm, seed, accuracy, forgetting, lost, gpu_hours) of runs (run, arm, seed, gpu_hours) on an exam; null where it has no such score.

    lost: the share of its peak on the first phase that a run lost.
    """
    own = matrix.where(F.col("exam") == exam)
    parts = [average_accuracy(own).select("run", F.col("value").alias("accuracy")), average_forgetting(own).select("run", F.col("value").alias("forgetting")), peak_lost(own).where("j = 0").select("run", "lost")]
    out = runs.select("run", "arm", "seed", "gpu_hours")
    for part in parts:
        out = out.join(part, "run", "left")
    return out.select("run", "arm", "seed", "accuracy", "forgetting", "lost", "gpu_hours")


def verdict_table(matrix: DataFrame, runs: DataFrame, headline: str = DECIDING[0], second: str = DECIDING[1]) -> DataFrame:
    """(exam, hypothesis, verdict): the verdicts by each of the two deciding exams, and by `both`: shared, or split."""
    both = [verdicts(run_results(matrix, runs, exam)) for exam in (headline, second)]
    named = [b.select(F.lit(exam).alias("exam"), "hypothesis", "verdict") for b, exam in zip(both, (headline, second), strict=True)]
    return named[0].unionByName(named[1]).unionByName(split_verdicts(*both).select(F.lit("both").alias("exam"), "hypothesis", "verdict"))


def verdicts(runs: DataFrame) -> DataFrame:
    """(hypothesis, verdict) from per-run rows (arm, seed, accuracy, forgetting, lost, gpu_hours).

    H1: arm A loses a large share of its peak. H2a: D forgets no more than B and is within three points of E. H3: D beats C by
    five points. H4: D-nr forgets more than D. H2b: hours of D by B, a band only. An arm that is missing leaves it undetermined.
    """
    aggs = []
    for arm, name in (("A", "a"), ("B", "b"), ("C", "c"), ("D", "d"), ("D-nr", "n"), ("E", "e")):
        mine = F.col("arm") == arm
        for m in ("accuracy", "forgetting", "lost"):
            aggs.append(F.avg(F.when(mine, F.col(m))).alias(f"{name}_{m}"))
            aggs.append(F.coalesce(F.when(F.count(F.when(mine, F.col(m))) > 1, F.stddev_samp(F.when(mine, F.col(m)))), F.lit(0.0)).alias(f"{name}_{m}_sd"))
    one = runs.groupBy().agg(*aggs)
    hours = runs.where("arm = 'D'").select("seed", F.col("gpu_hours").alias("d_hours")).join(runs.where("arm = 'B' and gpu_hours > 0").select("seed", F.col("gpu_hours").alias("b_hours")), "seed")
    ratio = hours.groupBy().agg(F.avg(F.col("d_hours") / F.col("b_hours")).alias("ratio"))
    c = F.col
    f_diff, _, f_decided = compared(c("d_forgetting"), c("d_forgetting_sd"), c("b_forgetting"), c("b_forgetting_sd"))
    h3_diff, _, h3_decided = compared(c("d_accuracy"), c("d_accuracy_sd"), c("c_accuracy"), c("c_accuracy_sd"))
    h4_diff, _, h4_decided = compared(c("n_forgetting"), c("n_forgetting_sd"), c("d_forgetting"), c("d_forgetting_sd"))
    h1 = F.when(c("a_lost").isNull(), "undetermined").when(c("a_lost") >= H1_CONFIRM, "confirmed").when(c("a_lost") < H1_KILL, "killed").otherwise("neither")
    worse = (f_diff > 0) & f_decided
    near = (c("e_accuracy") - c("d_accuracy")) * 100 <= H2A_POINTS
    h2a = F.when((f_diff + c("e_accuracy") + c("d_accuracy")).isNull(), "undetermined").when(~worse & near, "confirmed").when(worse, "killed").otherwise("neither")
    h3 = F.when(h3_diff.isNull(), "undetermined").when(h3_decided & (h3_diff * 100 >= H3_POINTS), "confirmed").when(~h3_decided, "killed").otherwise("neither")
    h4 = F.when(h4_diff.isNull(), "undetermined").when(h4_decided & (h4_diff > 0), "confirmed").when(~h4_decided, "killed").otherwise("neither")
    band = F.when(c("ratio").isNull(), "undetermined").when(c("ratio") <= BAND_LOW, "low").when(c("ratio") <= BAND_HIGH, "middle").otherwise("high")
    out = one.crossJoin(ratio)  # one row with one row
    listed = F.array(*[F.struct(F.lit(n).alias("hypothesis"), v.alias("verdict")) for n, v in (("H1", h1), ("H2a", h2a), ("H2b", band), ("H3", h3), ("H4", h4))])
    return out.select(F.explode(listed).alias("x")).select("x.hypothesis", "x.verdict")


def split_verdicts(headline: DataFrame, second: DataFrame) -> DataFrame:
    """Verdicts of two exams as one: shared where they agree, else split."""
    both = headline.join(second.withColumnRenamed("verdict", "other"), "hypothesis")
    return both.select("hypothesis", F.when(F.col("verdict") == F.col("other"), F.col("verdict")).otherwise("split").alias("verdict"))
