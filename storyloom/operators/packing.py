"""Byte tokens, packing into fixed sequences, corpus summaries, token budgets, seeded orders, replay pools and batches.

Tokens are the bytes of a text without NUL; NUL ends a story. Packing never makes a row for a token: a story's bytes are cut
at the borders of the sequences they fall into.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.functions import text as T

#: Sequence length, sequences of a batch, epochs, warm-up steps, learning rate and its floor.
BLOCK, BATCH, EPOCHS, WARMUP, RATE, FLOOR = 1024, 32, 4, 200, 3e-4, 0.1
#: Run configurations: share of replay, LoRA, what follows a phase, joint, shares the first phase, passes over new and replay.
ARMS = (
    ("phase0", 0.0, False, "identity", False, True, 1, 1),
    ("A", 0.0, False, "identity", False, True, 1, 1),
    ("B", 0.3, False, "identity", False, True, 1, 1),
    ("C", 0.0, True, "merge", False, True, 1, 1),
    ("D", 0.3, True, "distill", False, True, 2, 1),
    ("D-nr", 0.0, True, "distill", False, True, 2, 1),
    ("E", 0.0, False, "identity", True, False, 1, 1),
)
#: Rows of a step of the two-level running sum.
CHUNK = 4096


def arms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ARMS, "arm string, replay_fraction double, uses_lora boolean, after_phase string, joint boolean, shares_phase0 boolean, new_passes int, replay_passes int")


def byte_hex(text: Column) -> Column:
    """The tokens of a story and its end, two hexadecimal digits each."""
    return F.concat(F.hex(F.encode(F.replace(F.coalesce(text, F.lit("")), F.lit("\0"), F.lit("")), "UTF-8")), F.lit("00"))


def byte_tokens(text: Column, keep_nul: bool = False) -> Column:
    """The tokens of a story as array<int>, without its end; the evaluator's tokens keep NUL."""
    hexes = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"))
    every = F.transform(hexes, lambda h: F.conv(h, 16, 10).cast("int"))
    return every if keep_nul else F.filter(every, lambda x: x != 0)


def byte_text(tokens: Column) -> Column:
    """The text of byte tokens; bytes that aren't UTF-8 are replaced."""
    return F.decode(F.unhex(F.array_join(F.transform(tokens, lambda x: F.lpad(F.hex(x), 2, "0")), "")), "UTF-8")


def token_counts(stories: DataFrame) -> DataFrame:
    """(phase, lineno, id, n_tokens) with the end of the story counted."""
    return stories.select("phase", "lineno", "id", (F.octet_length(byte_hex(F.col("story"))) / 2).cast("long").alias("n_tokens"))


def offsets(counts: DataFrame, by: str = "phase", order: str = "lineno", value: str = "n_tokens") -> DataFrame:
    """counts with `start`, the sum of the rows before in their group, in two levels: no window holds a whole group's rows."""
    rows = counts.withColumn("chunk", F.floor(F.col(order) / CHUNK))
    sums = rows.groupBy(by, "chunk").agg(F.sum(value).alias("s"))
    before = F.sum("s").over(Window.partitionBy(by).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(by, "chunk", F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.sum(value).over(Window.partitionBy(by, "chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("inside", F.coalesce(inside, F.lit(0))).join(sums, [by, "chunk"]).withColumn("start", F.col("base") + F.col("inside")).drop("chunk", "base", "inside")


def packed(stories: DataFrame, block: int = BLOCK) -> DataFrame:
    """(phase, seq_id, tokens_hex) of full sequences of `block` tokens; the tail of a phase is dropped. lineno must order a phase."""
    rows = stories.select("phase", "lineno", byte_hex(F.col("story")).alias("h")).withColumn("n_tokens", (F.length("h") / 2).cast("long"))
    rows = offsets(rows)
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("n_tokens") - 1) / block)
    parts = rows.withColumn("seq_id", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("seq_id") * block - F.col("start"), F.lit(0))
    end = F.least((F.col("seq_id") + 1) * block - F.col("start"), F.col("n_tokens"))
    parts = parts.select("phase", "seq_id", "lineno", (end - begin).alias("n"), F.substring(F.col("h"), (begin * 2 + 1).cast("int"), ((end - begin) * 2).cast("int")).alias("piece"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lineno", "piece"))), lambda x: x["piece"]), "")
    return parts.groupBy("phase", "seq_id").agg(F.sum("n").alias("n"), joined.alias("tokens_hex")).where(F.col("n") == block).drop("n")


def corpus_summary(stories: DataFrame, block: int = BLOCK) -> DataFrame:
    """Stories, tokens, sequences and models of each phase."""
    n = (F.octet_length(byte_hex(F.col("story"))) / 2).cast("long")
    out = stories.groupBy("phase").agg(F.count("*").alias("n_stories"), F.sum(n).alias("n_tokens"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"))
    return out.withColumn("n_sequences", F.floor(F.col("n_tokens") / block))


def steps(n_sequences: Column, batch: int = BATCH, epochs: int = EPOCHS) -> Column:
    return F.greatest(F.lit(1), F.ceil(n_sequences * epochs / batch))


def replay_sequences(fraction: Column, new: int = BATCH) -> Column:
    """Replay sequences of a batch with `new` new ones, rounded half to even."""
    return F.bround(fraction * new / (1 - fraction)).cast("long")


def token_budget(summary: DataFrame, arms_: DataFrame, block: int = BLOCK, batch: int = BATCH, epochs: int = EPOCHS) -> DataFrame:
    """Steps and tokens of each arm and phase, and (phase null) of the arm, with its ratio to arm A's tokens."""
    rows = summary.crossJoin(arms_).where("arm <> 'phase0'")  # seven arms by seven phases
    per = rows.withColumn("steps", steps(F.col("n_sequences"), batch, epochs))
    replay = F.when(F.col("phase") > 0, replay_sequences(F.col("replay_fraction"), batch)).otherwise(0)
    per = per.withColumn("new_tokens", F.col("steps") * batch * block * F.when(F.col("phase") > 0, F.col("new_passes")).otherwise(1))
    per = per.withColumn("replay_tokens", F.col("steps") * replay * block * F.col("replay_passes"))
    sums = per.groupingSets([["arm", "phase"], ["arm"]], "arm", "phase").agg(F.sum("steps").alias("steps"), F.sum("new_tokens").alias("new_tokens"), F.sum("replay_tokens").alias("replay_tokens"))
    base = sums.where("arm = 'A'").select(F.col("phase").alias("p"), (F.col("new_tokens") + F.col("replay_tokens")).alias("base"))
    ratio = F.bround((F.col("new_tokens") + F.col("replay_tokens")) / F.col("base"), 6)
    return sums.join(base, F.col("phase").eqNullSafe(F.col("p"))).select("arm", "phase", "steps", "new_tokens", "replay_tokens", ratio.alias("tokens_vs_arm_a"))


def learning_rates(spark: SparkSession, total: int, warmup: int = WARMUP, rate: float = RATE, floor: float = FLOOR) -> DataFrame:
    """(step, rate): linear warm-up, then half a cosine down to the floor's share."""
    warm = max(1, min(warmup, total // 2))
    step = F.col("id")
    along = F.least(F.lit(1.0), (step - warm) / max(1, total - warm))
    shape = F.when(step < warm, (step + 1) / warm).otherwise(floor + (1 - floor) * 0.5 * (1 + F.cos(F.pi() * along)))
    return spark.range(total).select(step.alias("step"), F.round(shape * rate, 12).alias("rate"))


def selected(stories: DataFrame, n: int, seed: int, label: str = "replay") -> DataFrame:
    """The first n of each phase by seeded hash, with their rank."""
    order = Window.partitionBy("phase").orderBy(T.draw(seed, label, F.col("phase"), F.col("id")), "id")
    return stories.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def first_hashes(stories: DataFrame, n: int) -> DataFrame:
    """The first n distinct ids of each phase in file order, and all rows that carry them."""
    seen = stories.groupBy("phase", "id").agg(F.min("lineno").alias("first"))
    keep = seen.withColumn("nr", F.row_number().over(Window.partitionBy("phase").orderBy("first"))).where(F.col("nr") <= n)
    return stories.join(keep.select("phase", "id"), ["phase", "id"], "left_semi")


def keep_and_missing(stories: DataFrame, requested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose id is requested, and requested ids that no row has."""
    return stories.join(requested, "id", "left_semi"), requested.join(stories.select("id"), "id", "left_anti")


def pool_sizes(sequences: DataFrame) -> DataFrame:
    """For each phase: sequences of the earlier phases, which its replay is drawn from. sequences: (phase, n)."""
    before = F.sum("n").over(Window.orderBy("phase").rowsBetween(Window.unboundedPreceding, -1))
    return sequences.select("phase", F.coalesce(before, F.lit(0)).cast("long").alias("pool"))


def epoch_batches(sequences: DataFrame, epochs: int, batch: int, seed: int) -> DataFrame:
    """(phase, step, slot, epoch, seq_id): each epoch in its own seeded order, epochs joined; a batch may straddle two."""
    rows = sequences.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    size = rows.where("epoch = 0").groupBy("phase").agg(F.count("*").alias("n"))
    rows = rows.withColumn("_order", T.draw(seed, "epoch", F.col("phase"), F.col("epoch"), F.col("seq_id")))
    rows = T.ranked(rows, ["phase", "epoch"], "_order", "rank").join(F.broadcast(size), "phase")  # a row for each phase
    at = F.col("epoch") * F.col("n") + F.col("rank")
    return rows.select("phase", F.floor(at / batch).alias("step"), (at % batch).alias("slot"), "epoch", "seq_id")


def replay_draws(pools: DataFrame, slots: int, steps_: int, seed: int) -> DataFrame:
    """(phase, step, slot, index): draws with replacement from each phase's pool; phases without a pool have none."""
    grid = pools.where("pool > 0").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps_ - 1)))).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    return grid.select("phase", "step", "slot", T.draw_index(F.col("pool"), seed, "replay-draw", F.col("phase"), F.col("step"), F.col("slot")).alias("index"))


def replay_pool(sequences: DataFrame, phases: list[int] | None = None) -> DataFrame:
    """(phase, src_phase, seq_id): what each phase's replay is drawn from: sequences of all declared phases before it.

    sequences: (phase, seq_id). A declared phase without a sequence is refused where the pool is made, by empty_phases().
    """
    rows = sequences if phases is None else sequences.where(F.col("phase").isin(phases))
    later = rows.select("phase").distinct()  # as many as there are phases
    return rows.select(F.col("phase").alias("src_phase"), "seq_id").join(F.broadcast(later), F.col("src_phase") < F.col("phase")).select("phase", "src_phase", "seq_id")


def empty_phases(sequences: DataFrame, phases: list[int]) -> DataFrame:
    """(phase) of declared phases without a sequence."""
    declared = sequences.sparkSession.createDataFrame([(k,) for k in phases], "phase int")
    return declared.join(sequences.select("phase").distinct(), "phase", "left_anti")


def joint_batches(sequences: DataFrame, epochs: int, batch: int, seed: int) -> DataFrame:
    """(step, slot, epoch, phase, seq_id): batches over the sequences of all phases as one."""
    rows = sequences.select(F.lit(-1).alias("phase"), F.struct("phase", "seq_id").alias("seq_id"))
    named = rows.withColumn("key", F.concat_ws(":", F.col("seq_id.phase").cast("string"), F.col("seq_id.seq_id").cast("string")))
    out = epoch_batches(named.select("phase", F.col("key").alias("seq_id")), epochs, batch, seed)
    return out.select("step", "slot", "epoch", F.substring_index("seq_id", ":", 1).cast("int").alias("phase"), F.substring_index("seq_id", ":", -1).cast("long").alias("seq_id"))


def zipped(new: DataFrame, replay: DataFrame, batch: int) -> DataFrame:
    """(phase, step, slot, is_replay, item): new rows first, then the replay's of the same step; steps without new rows have none.

    new: (phase, step, slot, item); replay the same. Slots of the replay go on after the batch's.
    """
    steps_ = new.select("phase", "step").distinct()
    drawn = replay.join(steps_, ["phase", "step"], "left_semi")
    rows = new.select("phase", "step", "slot", F.lit(False).alias("is_replay"), "item")
    return rows.unionByName(drawn.select("phase", "step", (F.col("slot") + batch).alias("slot"), F.lit(True).alias("is_replay"), "item"))


def batch_violations(batches: DataFrame, rows: int) -> DataFrame:
    """(phase, step, n) of batches that don't hold exactly `rows` rows, or hold a slot twice."""
    out = batches.groupBy("phase", "step").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"))
    return out.where((F.col("n") != rows) | (F.col("slots") != rows)).select("phase", "step", "n")


def parameters(layers: Column, width: Column, vocabulary: Column, block: Column) -> tuple[Column, Column]:
    """Parameters of a decoder without biases beside the embeddings, and those of the embeddings."""
    return layers * 12 * width * width + (2 * layers + 1) * 2 * width, (vocabulary + block) * width


def oversized_vocabularies(tokenizers: DataFrame, models: DataFrame) -> DataFrame:
    """(name, vocabulary, model_vocabulary) of tokenizers with more tokens than their model knows. Both: (name, vocabulary)."""
    known = models.select("name", F.col("vocabulary").alias("model_vocabulary"))
    return tokenizers.join(known, "name").where("vocabulary > model_vocabulary").select("name", "vocabulary", "model_vocabulary")


def tokenizer_fingerprint(vocabulary: int, end: int, probe: list[int]) -> str:
    """SHA-256 of a tokenizer's size, its end token and its tokens of a probe text, as canonical JSON."""
    return hashlib.sha256(json.dumps({"eot": end, "probe": probe, "vocab_size": vocabulary}, sort_keys=True).encode()).hexdigest()
