"""Queries of the story and experiment analytics over a folder of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.operators import exam, guard, matrix, neardup, packing, probes, runs, scoring
from storyloom.plans import contracts
from storyloom.plans import views as V
from storyloom.streaming import ledger as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = dict(contracts.QUERIES)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def near_duplicate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(V.exam(spark, sf), V.train(spark, sf))


@query
def near_duplicate_pairs_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """Two groups of sources as exam and training, under the rule of at most 64 exam stories a shingle."""
    return neardup.near_duplicates(*V.by_language(spark, sf))


@query
def near_duplicate_pairs_uncapped(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of the view, however many exam stories hold a shingle."""
    return neardup.near_duplicates(*V.by_language(spark, sf), max_postings=None)


@query
def near_duplicate_by_phase(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.by_phase(*V.by_language(spark, sf))


@query
def drop_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    exam, train = V.by_language(spark, sf)
    return neardup.drop_near_duplicates(exam, neardup.flagged(exam, train)).select("id", "phase")


@query
def verbatim_ngram_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.ngram_overlap(V.exam(spark, sf), V.train(spark, sf))


@query
def verbatim_sentence_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.sentence_overlap(V.exam(spark, sf), V.train(spark, sf))


@query
def story_hash_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return guard.story_duplicates(V.train(spark, sf))


@query
def leak_line_hits(spark: SparkSession, sf: str) -> DataFrame:
    exam, train = V.by_language(spark, sf)
    lines = train.select("id", F.posexplode(T.loader_lines(F.col("story"))).alias("n", "line"))
    leaves = guard.leaves_of(train, "id", ["story", "model", "tier"]).unionByName(lines.select(F.col("id").cast("string").alias("entity"), F.concat(F.lit("line "), F.col("n").cast("string")).alias("location"), F.col("line").alias("value")).where("trim(value) <> ''"))
    return guard.leaf_hits(leaves, guard.manifest_of(exam))


@query
def manifest_story_reconcile_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every document: each 17th id not listed, each eleventh not on disk, the phase of each thirteenth moved in the manifest."""
    docs = V.train(spark, sf)
    moved = docs.where("id % 17 <> 3 or id is null").withColumn("phase", F.when(F.col("id") % 13 == 5, F.col("phase") + 1).otherwise(F.col("phase")))
    return guard.reconcile(docs.where("id % 11 <> 4 or id is null"), guard.manifest_of(moved))


@query
def provenance_violations(spark: SparkSession, sf: str) -> DataFrame:
    return guard.provenance_violations(V.train(spark, sf), "src0")


@query
def split_violations(spark: SparkSession, sf: str) -> DataFrame:
    labels = V.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality")
    stories = V.train(spark, sf).join(labels, "id", "left").withColumn("split", F.when(F.col("quality") == 0, "eval").otherwise("train"))
    return guard.split_violations(stories)


@query
def labelled_gate(spark: SparkSession, sf: str) -> DataFrame:
    bad = V.table(spark, sf, "labels").where("quality = 0 or toxic = 1").select(F.col("doc_id").alias("id"))
    kept = V.train(spark, sf).join(bad, "id", "left_anti")
    return kept.groupBy("phase").agg(F.count("*").alias("n_kept"))


@query
def replay_selection(spark: SparkSession, sf: str) -> DataFrame:
    return packing.selected(V.train(spark, sf), 50, V.SEED).select("phase", "id", "rank")


@query
def replay_pool_sizes(spark: SparkSession, sf: str) -> DataFrame:
    summary = packing.corpus_summary(V.train(spark, sf))
    return packing.pool_sizes(summary.select("phase", F.col("n_sequences").alias("n")))


@query
def keep_hash_missing(spark: SparkSession, sf: str) -> DataFrame:
    wanted = V.table(spark, sf, "labels").select((F.col("doc_id") * 2).alias("id")).distinct()
    kept, missing = packing.keep_and_missing(V.train(spark, sf), wanted)
    return kept.select("id", F.lit("kept").alias("state")).unionByName(missing.select("id", F.lit("missing").alias("state")))


@query
def first_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return packing.first_hashes(V.train(spark, sf), 20).select("phase", "id", "lineno")


@query
def byte_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return packing.token_counts(V.train(spark, sf)).select("phase", "id", "n_tokens")


@query
def packed_sequences(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed(V.train(spark, sf)).select("phase", "seq_id", F.sha2("tokens_hex", 256).alias("tokens_sha256"))


@query
def corpus_summary(spark: SparkSession, sf: str) -> DataFrame:
    return packing.corpus_summary(V.train(spark, sf))


@query
def token_budget(spark: SparkSession, sf: str) -> DataFrame:
    return packing.token_budget(packing.corpus_summary(V.train(spark, sf)), packing.arms(spark))


@query
def lr_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return packing.learning_rates(spark, 1000)


@query
def epoch_batches(spark: SparkSession, sf: str) -> DataFrame:
    sequences = V.train(spark, sf).select("phase", F.col("id").alias("seq_id"))
    return packing.epoch_batches(sequences, 2, 32, V.SEED)


@query
def replay_draws(spark: SparkSession, sf: str) -> DataFrame:
    pools = V.train(spark, sf).groupBy("phase").agg(F.count("*").alias("pool"))
    return packing.replay_draws(pools, 14, 20, V.SEED)


@query
def perplexity_windows(spark: SparkSession, sf: str) -> DataFrame:
    rows = packing.token_counts(V.train(spark, sf)).withColumn("w", scoring.windows(F.col("n_tokens") - 1, 1024))
    total = F.aggregate("w", F.lit(0).cast("long"), lambda a, n: a + n - 1)
    return rows.groupBy("phase").agg(F.sum(F.size("w")).cast("long").alias("n_windows"), F.sum(total).alias("n_predicted"))


@query
def bigram_perplexity(spark: SparkSession, sf: str) -> DataFrame:
    model = scoring.bigram_model(V.train(spark, sf), "story")
    return scoring.perplexity(V.exam(spark, sf), model, "phase", "story").select("phase", "n_tokens", F.round("loss", 6).alias("loss"))


def _scorer(spark: SparkSession, sf: str) -> scoring.Scorer:
    return scoring.bigram_scorer(scoring.bigram_model(V.exam(spark, sf), "story"))


def _cloze_all(spark: SparkSession, sf: str, tail: int | None = None) -> DataFrame:
    stories = V.train(spark, sf)
    return probes.cloze_items(stories, probes.share_lexicon(stories, 2, 28), V.SEED, tail=tail)


@query
def cloze_items_all(spark: SparkSession, sf: str) -> DataFrame:
    """One item for each usable story."""
    return _cloze_all(spark, sf).select("phase", "item", "story_id", "answer", F.sha2("text_with_mask", 256).alias("text_sha256"), F.array_join("candidates", ",").alias("candidates"))


@query
def item_shortfalls(spark: SparkSession, sf: str) -> DataFrame:
    """Phases that can't give a thousand cloze items."""
    return probes.shortfalls(_cloze_all(spark, sf), 1000, list(range(7)))


@query
def probe_violations_all(spark: SparkSession, sf: str) -> DataFrame:
    return probes.cloze_violations(_cloze_all(spark, sf)).groupBy("rule").agg(F.count("*").alias("n"))


def _drawn(spark: SparkSession, sf: str, tail: int | None = None) -> DataFrame:
    return probes.drawn_items(V.train(spark, sf), V.SEED, tail)


@query
def continuation_items_drawn(spark: SparkSession, sf: str) -> DataFrame:
    """Every story of two paragraphs or more; without a hash of options where its phase has no three distractors."""
    return _drawn(spark, sf).select("phase", "story_id", "answer_index", F.sha2("prefix", 256).alias("prefix_sha256"), F.sha2(F.array_join("options", "\n"), 256).alias("options_sha256"))


@query
def giveaway_report_drawn(spark: SparkSession, sf: str) -> DataFrame:
    return probes.giveaway_report(_drawn(spark, sf).where("options is not null"))


@query
def continuation_pmi_drawn(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.option_results(_drawn(spark, sf, scoring.BLOCK).where("options is not null"), _scorer(spark, sf)).drop("chance")


@query
def cloze_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Rank-1 accuracy of the bigram model on the items of every usable story."""
    return scoring.cloze_accuracy(_cloze_all(spark, sf, scoring.BLOCK), _scorer(spark, sf))


@query
def windowed_perplexity(spark: SparkSession, sf: str) -> DataFrame:
    """Loss of the exam's bigram model on all stories, in windows."""
    return scoring.windowed_perplexity(V.train(spark, sf), _scorer(spark, sf), "phase", "story").withColumn("loss", F.round("loss", 6))


@query
def exam_scores(spark: SparkSession, sf: str) -> DataFrame:
    """All exams of all phases over every story and every item that can be made of them."""
    stories, options = V.train(spark, sf), _drawn(spark, sf, scoring.BLOCK).where("options is not null")
    out = exam.evaluated(stories, _cloze_all(spark, sf, scoring.BLOCK), options, _scorer(spark, sf), key=("phase", "story_id"))
    rounded = ("perplexity", "cloze", "cloze_chance", "continuation", "continuation_summed", "continuation_chance")
    return out.withColumns({c: F.round(c, 6) for c in rounded})


@query
def matrix_incomplete(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.incomplete(V.matrix(spark, sf).where("run < 14 or j <> 3"))


@query
def average_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.average_accuracy(V.matrix(spark, sf)).withColumn("value", F.round("value", 9))


@query
def forgetting(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.forgetting(V.matrix(spark, sf)).select("run", "exam", "j", F.round("forgetting", 9).alias("forgetting"))


@query
def average_forgetting(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.average_forgetting(V.matrix(spark, sf)).withColumn("value", F.round("value", 9))


@query
def forward_transfer(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.forward_transfer(V.matrix(spark, sf)).withColumn("transfer", F.round("transfer", 9))


@query
def peak_lost(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.peak_lost(V.matrix(spark, sf)).withColumn("lost", F.round("lost", 9))


def _by_arm(spark: SparkSession, sf: str) -> DataFrame:
    rows = matrix.average_accuracy(V.matrix(spark, sf).where("exam = 'continuation'")).withColumn("seed", F.floor(F.col("run") / 7).cast("int"))
    arm = F.element_at(F.array(*[F.lit(a[0]) for a in packing.ARMS]), (F.col("run") % 7 + 1).cast("int"))
    return rows.select(arm.alias("arm"), "seed", F.lit("accuracy").alias("metric"), "value")


@query
def seed_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    out = matrix.seed_aggregate(_by_arm(spark, sf), ["arm", "metric"])
    return out.select("arm", "metric", F.round("mean", 9).alias("mean"), F.round("sd", 6).alias("sd"), "n", "seeds")


@query
def arm_compare(spark: SparkSession, sf: str) -> DataFrame:
    agg = matrix.seed_aggregate(_by_arm(spark, sf), ["arm", "metric"])
    out = matrix.compare(agg, [("A", "B"), ("D", "C"), ("D", "E"), ("D-nr", "D")])
    return out.select("arm", "other", "metric", F.round("diff", 9).alias("diff"), F.round("spread", 6).alias("spread"), "decided")


@query
def hypothesis_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts by either deciding exam and by both, over the runs that the events make."""
    return matrix.verdict_table(*V.two_exams(spark, sf))


@query
def gpu_ratio(spark: SparkSession, sf: str) -> DataFrame:
    hours = V.ledger(spark, sf).groupBy("arm", "seed").agg((F.sum(F.floor(F.col("gpu_hours") * 100).cast("long")) / 100).alias("gpu_hours"))
    return runs.gpu_ratio(hours)


@query
def majority_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("value"), F.col("source").alias("arm"))
    return guard.majority(rows, "value", "id", ["arm"]).groupBy("arm", "value").agg(F.count("*").alias("n"))


def _folders(spark: SparkSession, sf: str) -> DataFrame:
    e = V.spread(V.table(spark, sf, "events").select("event_id", "value"), "event_id")
    bad = lambda k, m: F.pmod("event_id", F.lit(m)) == k
    dirty = F.when(bad(1, 11), "true").otherwise("false")
    commit = F.concat(F.lit("commit: abc\nbranch: main\nDirty: "), dirty, F.lit("\r\ntorch: 1\r\n"), F.when(bad(2, 13), "").otherwise("cuda: 2\n"), F.when(bad(3, 43), "driver: ").otherwise("driver: 5"))
    run_id = F.concat(F.lit("A_s"), F.pmod("event_id", F.lit(3)).cast("string"), F.when(bad(3, 17), "_").otherwise("_abcdef0"), F.lit("_20250101T000000Z"))
    phases = F.when(bad(4, 19), F.array(F.lit(0), F.lit(3), F.lit(2))).when(bad(5, 23), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0), F.lit(3), F.lit(6)))
    return e.select("event_id", run_id.alias("run_id"), F.when(~bad(6, 29), commit).alias("commit_txt"), phases.alias("phases"), F.when(~bad(7, 31), "gpu").alias("gpu_name"), F.when(~bad(8, 37), F.col("value")).alias("gpu_hours"), F.when(~bad(9, 41), F.create_map(F.lit("data"), F.lit("x"))).alias("hashes"))


@query
def run_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    return runs.exclusions(_folders(spark, sf)).groupBy("reason").agg(F.count("*").alias("n"))


@query
def run_failures(spark: SparkSession, sf: str) -> DataFrame:
    return runs.failures(_folders(spark, sf)).groupBy("rule").agg(F.count("*").alias("n"))


@query
def ledger_summary(spark: SparkSession, sf: str) -> DataFrame:
    return runs.ledger_summary(V.ledger(spark, sf))


@query
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    out = stream.event_windows(V.table(spark, sf, "events"))
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))
