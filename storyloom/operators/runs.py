"""Run folders and the ledger: loading with the first failing rule, validation with all of them, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.operators import guard, matrix
from storyloom.sources import corpus

#: What a run id looks like, and what its commit record must hold, none of it empty.
RUN_ID = r"^([A-Za-z0-9-]+)_s(\d+)_([0-9a-fA-F]{7})_(\d{8}T\d{6}Z)$"
REQUIRED = ("commit", "dirty", "torch", "cuda", "driver")
#: What ends a line, as str.splitlines() has it.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def commit_fields(text: Column) -> Column:
    """'key: value' lines as a map; keys lower-cased and stripped, of repeated keys the last."""
    lines = F.filter(F.split(text, LINE_END), lambda x: F.instr(x, ":") > 0)
    pairs = F.transform(lines, lambda x: F.struct(F.lower(T.stripped(F.substring_index(x, ":", 1))).alias("k"), T.stripped(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v")))

    def of(found: Column) -> Column:
        last = lambda k: F.element_at(F.filter(found, lambda p: p["k"] == k), -1)["v"]
        return T.once(F.array_distinct(F.transform(found, lambda p: p["k"])), lambda keys: F.map_from_arrays(keys, F.transform(keys, last)))

    return T.once(pairs, of)


def incomplete(fields: Column) -> Column:
    """Whether a commit record lacks a required key, or has it without a value."""
    return F.exists(F.array(*map(F.lit, REQUIRED)), lambda k: F.coalesce(F.try_element_at(fields, k), F.lit("")) == "")


def run_id_parts(run_id: Column) -> list[Column]:
    return [F.regexp_extract(run_id, RUN_ID, i).alias(n) for i, n in ((1, "arm"), (2, "seed"), (3, "commit7"), (4, "started"))]


def rules(run: DataFrame) -> list[tuple[str, Column]]:
    """Failures in their fixed order, over columns run_id, commit_txt, _fields (its fields), phases, gpu_name, gpu_hours, hashes."""
    fields = F.col("_fields")
    dirty = F.lower(F.try_element_at(fields, F.lit("dirty")))
    ascending = F.forall(F.sequence(F.lit(1), F.greatest(F.size("phases") - 1, F.lit(1))), lambda i: (F.size("phases") < 2) | (F.try_element_at("phases", i) < F.try_element_at("phases", i + 1)))
    return [
        ("files", F.col("commit_txt").isNull()),
        ("commit", incomplete(fields) | ~dirty.isin("true", "false")),
        ("dirty", ~F.coalesce(dirty == "false", F.lit(False))),
        ("run_id", ~F.col("run_id").rlike(RUN_ID)),
        ("phases", F.col("phases").isNull() | (F.size("phases") == 0) | ~F.coalesce(F.element_at(F.concat("phases", F.array(F.lit(-1))), 1) == 0, F.lit(False)) | ~ascending | F.exists("phases", lambda p: (p < 0) | (p > 6))),
        ("gpu_name", F.coalesce(F.trim("gpu_name"), F.lit("")) == ""),
        ("gpu_hours", F.col("gpu_hours").isNull() | F.isnan("gpu_hours") | (F.col("gpu_hours") < 0)),
        ("hashes", F.coalesce(F.size("hashes"), F.lit(0)) == 0),
    ]


def _with_fields(run: DataFrame) -> DataFrame:
    """run with the fields of commit_txt as a column of its own, so that they are read once a row."""
    return run.withColumn("_fields", commit_fields(F.coalesce("commit_txt", F.lit(""))))


def exclusions(run: DataFrame) -> DataFrame:
    """(run_id, reason): the first rule that fails; runs without any are not listed."""
    run = _with_fields(run)
    # Exploded: a filter on the reason would be pushed below, and the rules with it, to be worked out twice.
    first = F.array(F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules(run)]))
    return run.select("run_id", F.explode(F.filter(first, lambda x: x.isNotNull())).alias("reason"))


def failures(run: DataFrame) -> DataFrame:
    """(run_id, rule) of all rules that fail."""
    run = _with_fields(run)
    listed = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules(run)]), lambda x: x.isNotNull())
    return run.select("run_id", F.explode(listed).alias("rule"))


def ledger_summary(ledger: DataFrame) -> DataFrame:
    """For each arm: attempts, hours (none counts as 0), GPU names in order and how often each status came."""
    status = ledger.groupBy("arm", "status").agg(F.count("*").alias("c"), F.sum(F.coalesce("gpu_hours", F.lit(0.0))).alias("h"), F.collect_set("gpu_name").alias("g"))
    entry = F.concat_ws(":", "status", F.col("c").cast("string"))
    out = status.groupBy("arm").agg(F.sum("c").alias("attempts"), F.round(F.sum("h"), 6).alias("gpu_hours"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("g")))), ",").alias("gpu_names"), F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("statuses"))
    return out


def gpu_ratio(runs: DataFrame, arm: str = "D", other: str = "B") -> DataFrame:
    """(seed, ratio) of two arms' hours, where the other's are not zero."""
    a = runs.where(F.col("arm") == arm).select("seed", F.col("gpu_hours").alias("h"))
    b = runs.where((F.col("arm") == other) & (F.col("gpu_hours") != 0)).select("seed", F.col("gpu_hours").alias("o"))
    return a.join(b, "seed").select("seed", F.round(F.col("h") / F.col("o"), 9).alias("ratio"))


#: What arm and seed a run folder's name tells, the files of a run folder, the exams of its matrix, the phases there are, and a hash that differs by run.
NAMED = r"^(?:(.*?)_)?s(\d+)(?:_|$)"
FILES, EXAMS, PHASES, PER_RUN_HASH = ("commit.txt", "matrix.json", "timings.json", "config.json"), ("perplexity", "cloze", "continuation", "continuation_summed"), 7, "fingerprint"
MATRIX = "untrained map<string, array<double>>, M map<string, array<array<double>>>"
TIMINGS = "per_phase array<struct<phase: int, train_s: double, consolidate_s: double, eval_s: double>>, gpu_hours double, gpu_name string"
CONFIG = "arm string, seed int, pilot boolean, phases array<int>, token_budget struct<total_new_phase_tokens: double, total_replay_tokens: double, tokens_vs_arm_a: double>, git struct<commit: string, dirty: boolean, branch: string>, hashes map<string, string>"


def _finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def flat_hashes(hashes: Column) -> Column:
    """A map of hashes whose values may be maps again (as JSON): those with dotted keys; without what differs by run."""
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    inner = lambda e: F.transform(F.map_entries(F.from_json(e["value"], "map<string, string>")), lambda x: entry(F.concat(e["key"], F.lit("."), x["key"]), x["value"]))
    parts = F.transform(F.map_entries(hashes), lambda e: F.when(e["key"] == PER_RUN_HASH, F.array().cast("array<struct<key: string, value: string>>")).when(F.startswith(e["value"], F.lit("{")), inner(e)).otherwise(F.array(entry(e["key"], e["value"]))))
    return F.map_from_entries(F.array_sort(F.flatten(parts)))


def canonical_json(entries: Column) -> Column:
    """A map as JSON with its keys in order, without white space."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def parsed(folders: DataFrame) -> DataFrame:
    """Run folders with their documents: m, t, c (null where unreadable), phases (all where not declared), hashes."""
    whole = lambda c: F.when(F.try_parse_json(c).isNotNull() & F.coalesce(F.trim(c).startswith("{"), F.lit(False)), c)
    out = folders.withColumns({"m": F.from_json(whole(F.regexp_replace("matrix", r'(?<!")(-?\bInfinity\b|\bNaN\b)(?!")', '"$1"')), MATRIX), "t": F.from_json(whole(F.col("timings")), TIMINGS), "c": F.from_json(whole(F.col("config")), CONFIG)})
    every = F.array(*[F.lit(k) for k in range(PHASES)])
    return out.withColumns({"phases": F.coalesce("c.phases", every), "hashes": flat_hashes(F.col("c.hashes")), "fields": commit_fields(F.coalesce("commit_txt", F.lit("")))})


def _bad_phases(phases: Column) -> Column:
    ascending = F.forall(F.sequence(F.lit(1), F.greatest(F.size(phases) - 1, F.lit(1))), lambda i: (F.size(phases) < 2) | (F.try_element_at(phases, i) < F.try_element_at(phases, i + 1)))
    return phases.isNull() | (F.size(phases) == 0) | ~F.coalesce(F.get(phases, F.lit(0)) == 0, F.lit(False)) | ~ascending | F.exists(phases, lambda p: p.isNull() | (p < 0) | (p >= PHASES))


def _row_incomplete(row: Column, phases: Column) -> Column:
    return F.exists(phases, lambda j: ~_finite(F.get(row, j)))


def _block_bad(exam: str, rows: Column, phases: Column) -> Column:
    block = F.try_element_at(F.col("m.M"), F.lit(exam))
    shape = block.isNull() | (F.size(block) != PHASES) | F.exists(block, lambda r: F.coalesce(F.size(r), F.lit(-1)) != PHASES)
    return shape | F.exists(rows, lambda i: _row_incomplete(F.get(block, i), phases))


def _untrained_bad(exam: str, phases: Column) -> Column:
    row = F.try_element_at(F.col("m.untrained"), F.lit(exam))
    return row.isNull() | (F.size(row) != PHASES) | _row_incomplete(row, phases)


def _first(found: list[tuple[str, Column]]) -> Column:
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in found])


def loaded(folders: DataFrame) -> DataFrame:
    """(run_id, reason, arm, seed, pilot, commit, gpu_name, gpu_hours, phases, hashes, token_ratio, replay_overhead_ratio) of run folders.

    reason: the first rule that refuses the run, in their fixed order; null for a usable one. folders: (run_id, commit_txt,
    matrix, timings, config) as texts.
    """
    rows, fields = parsed(folders), F.col("fields")
    dirty = F.lower(F.try_element_at(fields, F.lit("dirty")))
    names = dict(zip(FILES, ("commit_txt", "matrix", "timings", "config"), strict=True))
    phases = F.col("phases")
    found = [(f"missing {f}", F.col(names[f]).isNull()) for f in FILES]
    found += [("unreadable", F.col("m").isNull() | F.col("t").isNull() | F.col("c").isNull())]
    found += [("commit", incomplete(fields) | ~dirty.isin("true", "false")), ("dirty", dirty == "true"), ("phases", _bad_phases(phases))]
    found += [("blocks", F.col("m.M").isNull() | F.col("m.untrained").isNull())]
    for e in EXAMS:
        found += [(f"matrix {e}", _block_bad(e, phases, phases)), (f"untrained {e}", _untrained_bad(e, phases))]
    found += [("gpu_name", F.coalesce(F.trim("t.gpu_name"), F.lit("")) == ""), ("gpu_hours", F.col("t.gpu_hours").isNull()), ("hashes", F.coalesce(F.size("hashes"), F.lit(0)) <= 0)]
    new, replay = F.col("c.token_budget.total_new_phase_tokens"), F.col("c.token_budget.total_replay_tokens")
    arm, seed = (F.nullif(F.regexp_extract("run_id", NAMED, i), F.lit("")) for i in (1, 2))
    return rows.select(
        "run_id", _first(found).alias("reason"), F.coalesce("c.arm", arm, F.lit("?")).alias("arm"), F.coalesce("c.seed", seed.cast("int"), F.lit(-1)).alias("seed"),
        F.coalesce("c.pilot", F.lit(False)).alias("pilot"), F.try_element_at(fields, F.lit("commit")).alias("commit"), F.trim("t.gpu_name").alias("gpu_name"), F.col("t.gpu_hours").alias("gpu_hours"),
        "phases", "hashes", F.col("c.token_budget.tokens_vs_arm_a").alias("token_ratio"), F.when(new != 0, (new + replay) / new).alias("replay_overhead_ratio"),
    )


def validated(folders: DataFrame) -> DataFrame:
    """(run_id, failure): all failures of run folders by the validator's rules; folders whose name begins with . or _ are left out.

    It looks at the first line of 'dirty' only, holds the run id against the config, and asks an arm phase0 for row 0 alone.
    """
    rows = parsed(folders.where(~F.col("run_id").rlike("^[._]")))
    there = lambda c: F.col(c).isNotNull()
    lines = F.filter(F.split("commit_txt", LINE_END), lambda x: (F.instr(x, ":") > 0) & (F.lower(T.stripped(F.substring_index(x, ":", 1))) == "dirty"))
    dirty = T.once(F.get(lines, F.lit(0)), lambda x: F.lower(T.stripped(F.substring(x, F.instr(x, ":") + 1, F.length(x)))))
    declared = F.when(_bad_phases(F.col("phases")), F.array(*[F.lit(k) for k in range(PHASES)])).otherwise(F.col("phases"))
    trained = F.when(F.col("c.arm") == "phase0", F.array(F.lit(0))).otherwise(declared)
    arm, seed, commit7 = (F.regexp_extract("run_id", RUN_ID, i) for i in (1, 2, 3))
    matches, commit = F.col("run_id").rlike(RUN_ID), F.coalesce("c.git.commit", F.lit(""))
    blocks = F.col("m.M").isNotNull() & F.col("m.untrained").isNotNull()
    found = [(f"missing {f}", ~there(c)) for f, c in zip(FILES, ("commit_txt", "matrix", "timings", "config"), strict=True)]
    found += [(f"unreadable {f}", there(f) & F.col(c).isNull()) for f, c in (("matrix", "m"), ("timings", "t"), ("config", "c"))]
    found += [("phases", _bad_phases(F.col("phases"))), ("blocks", there("m") & ~blocks)]
    for e in EXAMS:
        found += [(f"untrained {e}", there("m") & blocks & _untrained_bad(e, declared)), (f"matrix {e}", there("m") & blocks & _block_bad(e, trained, declared))]
    found += [("no dirty", there("commit_txt") & dirty.isNull()), ("dirty value", ~dirty.isin("true", "false")), ("dirty", dirty == "true")]
    found += [("gpu_name", there("t") & (F.coalesce(F.trim("t.gpu_name"), F.lit("")) == "")), ("gpu_hours", there("t") & (~_finite(F.col("t.gpu_hours")) | (F.col("t.gpu_hours") < 0)))]
    found += [("run id", there("c") & ~matches), ("arm", there("c") & matches & ~F.col("c.arm").eqNullSafe(arm)), ("seed", there("c") & matches & ~F.col("c.seed").eqNullSafe(seed.cast("int")))]
    found += [("no commit", there("c") & matches & (commit == "")), ("commit7", there("c") & matches & (commit != "") & (F.lower(F.substring(commit, 1, 7)) != F.lower(commit7)))]
    listed = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in found]), lambda x: x.isNotNull())
    return rows.select("run_id", F.explode(listed).alias("failure"))


def of_kind(runs: DataFrame, pilot: bool) -> DataFrame:
    """Usable runs of a kind: pilot runs are never mixed with others."""
    return runs.where(F.col("reason").isNull() & (F.col("pilot") == pilot))


def consistent(runs: DataFrame) -> DataFrame:
    """Usable runs whose phases are those of most runs, and whose hashes those of most of their arm; ties go to the first run id."""
    keyed = runs.withColumns({"_phases": F.to_json("phases"), "_hashes": canonical_json(F.col("hashes")), "_all": F.lit(1)})
    same = guard.majority(keyed, "_phases", "run_id", ["_all"])
    return guard.majority(same, "_hashes", "run_id", ["arm"]).drop("_phases", "_hashes", "_all")


def folder_verdicts(folders: DataFrame, pilot: bool = False) -> DataFrame:
    """(exam, hypothesis, verdict) from run folders as texts: usable runs of a kind that agree in phases and hashes, their scores, the verdicts."""
    # Kept: a dozen parts of the verdicts read both, and reading a folder's documents is what takes the time.
    read = loaded(folders).persist()
    used = consistent(of_kind(read, pilot)).select(F.col("run_id").alias("run"), "arm", "seed", "gpu_hours").persist()
    cells = corpus.matrix_cells(folders.join(used.select(F.col("run").alias("run_id")), "run_id", "left_semi")).persist()
    return matrix.verdict_table(cells, used)


def arm_hours(runs: DataFrame) -> DataFrame:
    """(arm, mean, sd, n, problem): hours over the seeds of an arm; more than one GPU's name is a problem, and gives no mean."""
    names = F.array_join(F.array_sort(F.collect_set("gpu_name")), ",")
    sd = F.coalesce(F.when(F.count("gpu_hours") > 1, F.stddev_samp("gpu_hours")), F.lit(0.0))
    out = runs.groupBy("arm").agg(F.avg("gpu_hours").alias("mean"), sd.alias("sd"), F.count("gpu_hours").alias("n"), names.alias("names"), F.countDistinct("gpu_name").alias("k"))
    one = F.col("k") <= 1
    return out.select("arm", F.when(one, F.col("mean")).alias("mean"), F.when(one, F.col("sd")).alias("sd"), "n", F.when(~one, F.col("names")).alias("problem"))


def timing_hours(spans: DataFrame) -> DataFrame:
    """(run, gpu_hours) from (run, phase, span, seconds): all spans' seconds, in hours."""
    return spans.groupBy("run").agg((F.sum("seconds") / 3600).alias("gpu_hours"))


def existing_valid(folders: DataFrame, wanted: DataFrame) -> DataFrame:
    """(arm, seed, commit7, run_id): of (arm, seed, commit7) wanted, those with a valid folder; the first in order of names."""
    bad = validated(folders).select("run_id").distinct()
    good = folders.where(F.col("run_id").rlike(RUN_ID)).join(bad, "run_id", "left_anti").select("run_id", *run_id_parts(F.col("run_id")))
    key = ["arm", "seed", "commit7"]
    return wanted.withColumn("seed", F.col("seed").cast("string")).join(good, key).groupBy(*key).agg(F.min("run_id").alias("run_id"))


def exit_summary(outcomes: DataFrame) -> DataFrame:
    """One row: how many runs were made, skipped and failed. outcomes: (outcome)."""
    return outcomes.agg(*[F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in ("run", "skip", "failed")])


def fingerprint_differences(mine: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """(key, field, mine, theirs) of fields in which two fingerprints (maps in column `fields`) differ."""
    a, b = (d.select(key, F.explode("fields").alias("field", name)) for d, name in ((mine, "mine"), (theirs, "theirs")))
    return a.join(b, [key, "field"], "full_outer").where(~F.col("mine").eqNullSafe(F.col("theirs")))


def inherited(cells: DataFrame, runs: DataFrame, arms: DataFrame) -> DataFrame:
    """Score cells of runs with row 0 and the untrained row of their seed's phase0 run, where their arm shares it.

    cells: (run, exam, i, j, value); runs: (run, arm, seed); arms: (arm, shares_phase0).
    """
    first = cells.where("i <= 0").join(runs.where("arm = 'phase0'").select("run", "seed"), "run").drop("run")
    heirs = runs.where("arm <> 'phase0'").join(arms.where("shares_phase0").select("arm"), "arm").select("run", "seed")
    given = heirs.join(first, "seed").select("run", "exam", "i", "j", "value")
    own = cells.join(given.select("run", "exam", "i", "j"), ["run", "exam", "i", "j"], "left_anti")
    return own.unionByName(given)
