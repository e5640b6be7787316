"""Queries of contracts and run records: tables of items, runs and files made from whole tables, in which every rule is broken somewhere.

What is broken hangs on the remainder of a row's id, so that the expected violations follow from the ids alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.operators import guard, matrix, neardup, packing, probes, runs
from storyloom.plans import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Options and words of the made items.
OPTIONS, WORDS = ("one", "two", "three", "four"), tuple(f"word{chr(97 + k)}" for k in range(20))


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _counted(rows: DataFrame, rule: str = "rule") -> DataFrame:
    return rows.groupBy(rule).agg(F.count("*").alias("n"))


def _sha(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("-", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def _stories(spark: SparkSession, sf: str) -> DataFrame:
    """(d, p): ids and phases of all documents."""
    return V.train(spark, sf).where("id is not null").select(F.col("id").alias("d"), F.col("phase").alias("p"))


def _continuation(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _stories(spark, sf)
    d, p, bad = F.col("d"), F.col("p"), lambda k: F.col("d") % 41 == k
    at = (d % 4).cast("int")
    distractor = [((at + k) % 4) for k in (1, 2, 3)]

    def source(k: int) -> Column:
        story = F.when(bad(5) & F.lit(k == 0), None).when(bad(10) & (distractor[0] == k), d * 10 + at).when(bad(11) & (distractor[1] == k), d * 10 + distractor[0]).otherwise(d * 10 + k)
        sha = F.when(bad(6) & F.lit(k == 1), _sha("nowhere", d)).otherwise(_sha("story", d, F.lit(k)))
        phase = F.when(bad(7) & (distractor[0] == k), p + 1).when(bad(8) & (at == k), p + 1).otherwise(p)
        return F.struct(story.alias("story_id"), sha.alias("story_sha256"), phase.alias("phase"))

    options, sources = F.array(*map(F.lit, OPTIONS)), F.array(*map(source, range(4)))
    items = rows.select(
        p.alias("phase"), F.when(bad(1), p + 1).otherwise(p).alias("filed"), F.when(bad(15), F.lit("twice")).otherwise(F.concat(F.lit("continuation-"), d.cast("string"))).alias("id"),
        F.when(bad(2), F.slice(options, 1, 3)).when(bad(14), F.array(*map(F.lit, ("one", "two", "two", "four")))).otherwise(options).alias("options"), F.when(bad(3), 9).otherwise(at).alias("answer_index"),
        F.when(bad(4), F.slice(sources, 1, 3)).otherwise(sources).alias("option_sources"), F.when(bad(12), F.array().cast("array<int>")).when(bad(13), F.array(p, p, p + 1)).otherwise(F.array(p, p, p)).alias("distractor_phases"),
    )
    every = rows.withColumn("k", F.explode(F.array(*map(F.lit, range(4)))))
    manifest = every.select((d * 10 + F.col("k")).alias("story_id"), _sha("story", d, F.col("k")).alias("story_sha256"), p.alias("phase"))
    training = rows.where(bad(9)).select(_sha("story", d, F.lit(0)).alias("story_sha256"))
    return items, manifest, training


@query
def continuation_contract(spark: SparkSession, sf: str) -> DataFrame:
    return _counted(probes.continuation_contract(*_continuation(spark, sf), filed="filed"))


@query
def continuation_load_contract(spark: SparkSession, sf: str) -> DataFrame:
    return _counted(probes.continuation_contract(*_continuation(spark, sf), n_options=None))


@query
def cloze_contract(spark: SparkSession, sf: str) -> DataFrame:
    rows = _stories(spark, sf)
    d, p, bad = F.col("d"), F.col("p"), lambda *k: F.col("d") % 37 == k[0] if len(k) == 1 else (F.col("d") % 37).isin(*k)
    words = F.array(*map(F.lit, WORDS))
    other = lambda w: F.array(*map(F.lit, (*WORDS[:2], w, *WORDS[3:])))
    items = rows.select(
        p.alias("phase"), F.when(bad(1), p + 1).otherwise(p).alias("filed"), F.when(bad(12), F.lit("twice")).otherwise(F.concat(F.lit("cloze-"), d.cast("string"))).alias("id"),
        F.when(bad(2), "no gap in here").when(bad(3), "a [MASK] and a [MASK]").when(bad(8), "a [MASK] and WORDA").otherwise("a [MASK] in here").alias("text_with_mask"), F.when(bad(5), "zebra").otherwise(WORDS[0]).alias("answer"),
        F.when(bad(4), F.slice(words, 1, 19)).when(bad(6), other("WORDB")).when(bad(7), other("wordaing")).otherwise(words).alias("candidates"), F.when(bad(9), _sha("nowhere", d)).otherwise(F.upper(_sha("story", d))).alias("story_sha256"),
    )
    manifest = rows.select(d.alias("story_id"), _sha("story", d).alias("story_sha256"), F.when(bad(10), p + 1).otherwise(p).alias("phase"))
    return _counted(probes.cloze_contract(items, manifest, rows.where(bad(11)).select(_sha("story", d).alias("story_sha256")), filed="filed"))


@query
def phase_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Stories filed under a wrong phase, and stories that hold the mask."""
    rows = V.train(spark, sf).withColumn("filed", F.when(F.col("id") % 9 == 2, F.col("phase") + 1).otherwise(F.col("phase")))
    rows = rows.withColumn("story", F.when(F.col("id") % 8 == 1, F.concat("story", F.lit(" [MASK]"))).otherwise(F.col("story")))
    return probes.phase_row_violations(rows, "filed")


def folders(spark: SparkSession, sf: str) -> DataFrame:
    """A run folder for each event, as texts."""
    e, bad = F.col("event_id"), lambda m, k: F.col("event_id") % m == k
    row = "[1,1,1,1,1,1,1]"
    whole = F.lit("[" + ",".join([row] * 7) + "]")
    named = lambda name, value: F.concat(F.lit(f'"{name}": '), value)
    last_nan = F.lit("[" + ",".join([row] * 6) + ",[1,1,1,1,1,1,NaN]]")
    blocks = F.concat_ws(", ", named("perplexity", whole), F.when(~bad(41, 9), named("cloze", whole)), named("continuation", F.when(bad(47, 11), last_nan).otherwise(whole)), named("continuation_summed", whole))
    untrained = F.concat_ws(", ", named("perplexity", F.when(bad(43, 10), "[1,1,1,1,1,1,null]").otherwise(row)), *[named(x, F.lit(row)) for x in runs.EXAMS[1:]])
    text = F.concat(F.lit('{"untrained": {'), untrained, F.lit('}, "M": {'), blocks, F.lit("}}"))
    commit = F.concat(F.lit("commit: abcdef0123\nbranch: main\n"), F.when(bad(79, 18), "").otherwise(F.concat(F.lit("Dirty: "), F.when(bad(11, 1), "true").when(bad(83, 19), "maybe").otherwise("false"))), F.lit("\r\ntorch: 1\r\n"), F.when(bad(13, 2), "").when(bad(97, 21), "cuda: \n").otherwise("cuda: 2\n"), F.when(bad(101, 22), "").otherwise("driver: 5"))
    arm = F.when(bad(73, 17), "phase0").otherwise("A")
    run_id = F.concat(arm, F.lit("_s"), (e % 3).cast("string"), F.lit("_abcdef0_"), F.lpad(e.cast("string"), 8, "0"), F.lit("T000000Z"))
    phases = F.when(bad(19, 4), "[0,3,2]").when(bad(23, 5), "[1,2]").when(bad(67, 15), "[0,3]").otherwise("[0,1,2,3,4,5,6]")
    git = F.when(bad(17, 3), "1234567").otherwise("abcdef0123")
    hashes = F.when(bad(61, 14), "{}").otherwise('{"data": "x", "train_files": {"a": "1"}, "fingerprint": "f"}')
    config = F.concat(F.lit('{"arm": "'), arm, F.lit('", "seed": '), (e % 3 + F.when(bad(89, 20), 1).otherwise(0)).cast("string"), F.lit(', "pilot": '), F.when(bad(71, 16), "true").otherwise("false"), F.lit(', "phases": '), phases, F.lit(', "git": {"commit": "'), git, F.lit('"}, "hashes": '), hashes, F.lit("}"))
    timings = F.concat(F.lit('{"gpu_name": "'), F.when(bad(53, 12), " ").otherwise("gpu"), F.lit('", "gpu_hours": '), F.when(bad(59, 13), "null").otherwise("1.5"), F.lit("}"))
    return V.spread(V.table(spark, sf, "events").select("event_id"), "event_id").select(run_id.alias("run_id"), F.when(~bad(29, 6), commit).alias("commit_txt"), F.when(~bad(31, 7), text).alias("matrix"), timings.alias("timings"), F.when(bad(37, 8), "{").otherwise(config).alias("config"))


@query
def run_loads(spark: SparkSession, sf: str) -> DataFrame:
    """Runs by the first rule that refuses them; usable ones by whether they are pilots."""
    out = runs.loaded(folders(spark, sf))
    return _counted(out.withColumn("reason", F.coalesce("reason", F.when(F.col("pilot"), "pilot").otherwise("usable"))), "reason")


@query
def run_validation(spark: SparkSession, sf: str) -> DataFrame:
    return _counted(runs.validated(folders(spark, sf)), "failure")


@query
def runs_existing_valid(spark: SparkSession, sf: str) -> DataFrame:
    wanted = spark.createDataFrame([(a, s, c) for a in ("A", "B", "phase0") for s in range(3) for c in ("abcdef0", "0000000")], "arm string, seed int, commit7 string")
    return runs.existing_valid(folders(spark, sf), wanted)


@query
def runs_consistent(spark: SparkSession, sf: str) -> DataFrame:
    """Runs whose phases are those of most runs and whose hashes those of most of their arm, by arm."""
    e = V.table(spark, sf, "events")
    phases = F.when(F.col("event_id") % 5 == 0, F.array(F.lit(0), F.lit(3))).otherwise(F.array(*map(F.lit, range(7))))
    hashes = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("data"), F.lit("y"))).otherwise(F.map_from_arrays(F.array(F.lit("z"), F.lit("data")), F.array(F.lit("1"), F.lit("x"))))
    rows = e.select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("run_id"), (F.col("user_id") % 7).cast("string").alias("arm"), phases.alias("phases"), hashes.alias("hashes"))
    return runs.consistent(rows).groupBy("arm").agg(F.count("*").alias("n"), F.min("run_id").alias("first"))


def _arms(spark: SparkSession, sf: str) -> DataFrame:
    """Score cells with the arm and seed of their run."""
    arm = F.element_at(F.array(*[F.lit(a[0]) for a in packing.ARMS]), (F.col("run") % 7 + 1).cast("int"))
    return V.matrix(spark, sf).withColumns({"arm": arm, "seed": F.floor(F.col("run") / 7).cast("int")})


@query
def mean_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.mean_matrix(_arms(spark, sf), ["arm"]).withColumn("mean", F.round("mean", 9))


@query
def forgetting_curve(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.forgetting_curve(_arms(spark, sf), ["arm"]).withColumns({"mean": F.round("mean", 9), "sd": F.round("sd", 6)})


@query
def dense_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The whole grid of each run, from cells of which some are missing."""
    return matrix.dense(V.matrix(spark, sf).where("run < 14 or j <> 3 or i = 2")).withColumn("value", F.round("value", 9))


@query
def score_row_shapes(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.shape_violations(V.matrix(spark, sf).where("run < 14 or j <> 3 or i = 2"))


@query
def inherited_rows(spark: SparkSession, sf: str) -> DataFrame:
    cells = _arms(spark, sf)
    out = runs.inherited(cells.select("run", "exam", "i", "j", "value"), cells.select("run", "arm", "seed").distinct(), packing.arms(spark).select("arm", "shares_phase0"))
    return out.withColumn("value", F.round("value", 9))


@query
def arm_gpu_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Hours of arms over seeds; one arm ran on two kinds of GPU."""
    hours = V.ledger(spark, sf).groupBy("arm", "seed").agg((F.sum(F.floor(F.col("gpu_hours") * 100).cast("long")) / 100).alias("gpu_hours"))
    rows = hours.withColumn("gpu_name", F.when(F.col("arm") == "D", F.concat(F.lit("gpu"), (F.col("seed") % 2).cast("string"))).otherwise("gpu0"))
    return runs.arm_hours(rows).withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 4)})


@query
def timing_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Hours by user from the seconds of events as spans."""
    e = V.table(spark, sf, "events").where("value is not null and not isnan(value)")
    spans = e.select(F.col("user_id").alias("run"), (F.col("event_id") % 7).alias("phase"), F.col("event_type").alias("span"), F.floor(F.col("value") * 100).cast("long").alias("seconds"))
    return runs.timing_hours(spans).withColumn("gpu_hours", F.round("gpu_hours", 6))


@query
def exit_summary(spark: SparkSession, sf: str) -> DataFrame:
    outcome = F.when(F.col("event_id") % 5 == 0, "failed").when(F.col("event_id") % 5 == 1, "skip").otherwise("run")
    return runs.exit_summary(V.table(spark, sf, "events").select(outcome.alias("outcome")))


@query
def fingerprint_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Fields in which each document's fingerprint differs from one with its language as en."""
    docs = V.table(spark, sf, "documents").where("doc_id is not null")
    fields = lambda lang: F.map_from_arrays(F.array(F.lit("source"), F.lit("lang")), F.array(F.col("source"), lang))
    return runs.fingerprint_differences(docs.select("doc_id", fields(F.col("lang")).alias("fields")), docs.select("doc_id", fields(F.lit("en")).alias("fields")), "doc_id")


def _sequences(spark: SparkSession, sf: str) -> DataFrame:
    return V.train(spark, sf).where("id is not null").select("phase", F.col("id").alias("seq_id"))


@query
def replay_pool(spark: SparkSession, sf: str) -> DataFrame:
    return packing.replay_pool(_sequences(spark, sf), [0, 1, 3, 6])


@query
def joint_batches(spark: SparkSession, sf: str) -> DataFrame:
    return packing.joint_batches(_sequences(spark, sf), 2, 32, V.SEED)


def _zipped(spark: SparkSession, sf: str) -> DataFrame:
    sequences = _sequences(spark, sf)
    new = packing.epoch_batches(sequences, 1, 32, V.SEED).withColumnRenamed("seq_id", "item")
    pools = packing.replay_pool(sequences).groupBy("phase").agg(F.count("*").alias("pool"))
    replay = packing.replay_draws(pools, 14, 20, V.SEED).withColumnRenamed("index", "item")
    return packing.zipped(new, replay, 32)


@query
def zipped_batches(spark: SparkSession, sf: str) -> DataFrame:
    return _zipped(spark, sf)


@query
def batch_shapes(spark: SparkSession, sf: str) -> DataFrame:
    return packing.batch_violations(_zipped(spark, sf), 46)


@query
def parameter_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters of models whose sizes are those of parts."""
    size = F.col("p_size").cast("long")
    body, embeddings = packing.parameters(size, size * 64, F.lit(8192), F.lit(1024))
    return V.table(spark, sf, "part").select("p_partkey", body.alias("body"), embeddings.alias("embeddings"))


@query
def vocabulary_fits(spark: SparkSession, sf: str) -> DataFrame:
    """Models of parts' sizes that know fewer tokens than their tokenizer has."""
    part = V.table(spark, sf, "part")
    return packing.oversized_vocabularies(part.select(F.col("p_partkey").alias("name"), F.lit(800).alias("vocabulary")), part.select(F.col("p_partkey").alias("name"), (F.col("p_size") * 32).alias("vocabulary")))


def _files(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents outside two sources as training files of three kinds, and those of the two as exam stories."""
    exam, train = V.by_language(spark, sf)
    i = F.col("id")
    kind = F.element_at(F.array(*map(F.lit, ("txt", "json", "jsonl"))), (i % 3 + 1).cast("int"))
    document = F.to_json(F.struct(i.alias("k"), F.array(F.struct(F.col("story").alias("s"))).alias("all")))
    line = F.concat(F.to_json(F.struct(i.alias("k"), F.col("story").alias("s"))), F.when(i % 10 == 1, F.concat(F.lit('\n\n{"k": '), i.cast("string"))).otherwise(""))
    text = F.when(i % 3 == 0, F.col("story")).when(i % 3 == 1, document).otherwise(line)
    files = train.where("id is not null").select(F.concat(F.lit("f"), i.cast("string"), F.lit("."), kind).alias("path"), text.alias("text"))
    return files, guard.manifest_of(exam)


@query
def file_text_hits(spark: SparkSession, sf: str) -> DataFrame:
    return guard.text_hits(*_files(spark, sf)).select("path", "line", "reason", "story_id")


@query
def file_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Training documents that are byte for byte an exam file."""
    exam, train = V.by_language(spark, sf)
    listed = exam.select(F.concat(F.lit("exam/"), F.col("id").cast("string")).alias("path_relative_to_exam_dir"), F.upper(F.sha2("story", 256)).alias("sha256"), F.col("id").alias("at"))
    return guard.file_hits(train.select(F.col("id").cast("string").alias("path"), F.sha2("story", 256).alias("sha256")), listed)


@query
def manifest_refusals(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest for each document, by the first rule that refuses it."""
    bad = lambda k: F.col("d") % 17 == k
    d = F.col("d").cast("string")
    field = lambda name, value: F.concat(F.lit(f'"{name}": '), value)
    sha = F.when(bad(10), F.lit("xyz")).otherwise(_sha("story", F.col("d")))
    prompt = F.when(bad(11), F.lit("")).otherwise(d)
    phase = F.when(bad(12), F.lit('"one"')).otherwise((F.col("d") % 7).cast("string"))
    story = F.concat(F.lit("{"), F.concat_ws(", ", field("story_id", d), field("story_sha256", F.concat(F.lit('"'), sha, F.lit('"'))), field("phase", phase), F.when(~bad(9), field("prompt_hash", F.concat(F.lit('"'), prompt, F.lit('"'))))), F.lit("}"))
    stories = F.when(bad(7), "[]").when(bad(8), "[1]").otherwise(F.concat(F.lit("["), story, F.lit("]")))
    files = F.when(bad(3), "[]").when(bad(4), '[{"sha256": ""}]').otherwise('[{"sha256": "ab"}]')
    parts = F.concat_ws(", ", field("files", files), F.when(~bad(5), field("experiment_id", F.lit('"e"'))), field("generator_model", F.when(bad(6), '" "').otherwise('"m"')), field("stories", stories))
    text = F.when(bad(1), "{").when(bad(2), "[1]").otherwise(F.concat(F.lit("{"), parts, F.lit("}")))
    return _counted(guard.manifest_refusals(_stories(spark, sf).select(d.alias("path"), text.alias("text"))))


def _decomposed(stories: DataFrame) -> DataFrame:
    apart = T.normalizer("NFD")
    return stories.withColumn("story", F.when(F.col("id") % 2 == 0, apart(F.col("story"))).otherwise(F.col("story")))


@query
def near_duplicate_pairs_decomposed(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of near duplicates, however many exam stories hold a shingle, where every other training text has its accents apart."""
    exam, train = V.by_language(spark, sf)
    return neardup.near_duplicates(exam, _decomposed(train), max_postings=None)


@query
def story_hash_duplicates_decomposed(spark: SparkSession, sf: str) -> DataFrame:
    return guard.story_duplicates(_decomposed(V.train(spark, sf)))
