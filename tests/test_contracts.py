"""Texts in other normal forms, scoring by hand-made scorers, file guard, sources and sinks, runs and the stream's state."""

import json
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.operators import guard, matrix, neardup, packing, probes, runs, scoring
from storyloom.plans import contracts, oracles
from storyloom.sources import corpus, files
from storyloom.streaming import ledger as stream


def stories(spark, rows):
    return spark.createDataFrame(rows, "id long, phase int, story string")


def test_decomposed_copies_are_found(spark):
    text = " ".join(f"été{chr(97 + i % 26)} naïve Straße{i}" for i in range(40))
    exam = stories(spark, [(1, 0, text)])
    copies = stories(spark, [(2, 0, unicodedata.normalize("NFD", text)), (3, 0, "something else entirely in here")])
    assert [(r["exam_id"], r["train_id"], r["containment"]) for r in neardup.near_duplicates(exam, copies).collect()] == [(1, 2, 1.0)]
    hits = guard.leaf_hits(guard.leaves_of(copies, "id", ["story"]), guard.manifest_of(exam)).collect()
    assert [(h["entity"], h["reason"]) for h in hits] == [("2", "story_sha256")]
    assert guard.story_duplicates(exam.unionByName(copies)).first()["n"] == 2


def test_decomposed_pairs_are_whole(spark, tmp_path):
    # 70 exam stories share a passage, each of whose shingles more than 64 of them hold.
    shared = " ".join(f"été{k}" for k in range(30))
    rows = [(i, f"own{i} {shared}", "en", "src1") for i in range(70)] + [(100 + i, f"other{i} {shared} end", "en", "src3") for i in range(2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["exam_id"], r["train_id"]) for r in contracts.QUERIES["near_duplicate_pairs_decomposed"](spark, str(tmp_path)).collect()}
    assert got == {(i, j) for i in range(70) for j in (100, 101)}
    assert oracles.ORACLES["near_duplicate_pairs_decomposed"] == oracles.ORACLES["near_duplicate_pairs_uncapped"]


def test_normal_forms_equal_pythons(spark):
    marks = [c for c in map(chr, range(0x300, 0x2FFFF)) if not 0xD800 <= ord(c) < 0xE000 and (unicodedata.normalize("NFC", c) != c or unicodedata.category(c)[0] == "M")]
    folds = [c for c in map(chr, range(0x20000)) if not 0xD800 <= ord(c) < 0xE000 and c.casefold() != c and c.lower() != "i̇"]
    rows = [(f"a{c}b e{c}", ) for c in marks] + [(f"x{c}y {c}",) for c in folds]
    got = spark.createDataFrame(rows, "t string").select("t", T.nfc(F.col("t")).alias("n"), T.casefold(F.col("t")).alias("c")).collect()
    assert all(r["n"] == unicodedata.normalize("NFC", r["t"]) for r in got)
    # letters that are newer than one of the two Unicode tables aside
    assert sum(r["c"] != r["t"].casefold() for r in got[len(marks) :]) < 60


def constant(prefers):
    """Logits of the 256 bytes: what is preferred, zero else; the same after every byte."""
    logits = np.zeros(256)
    for c, v in prefers.items():
        logits[ord(c)] = v
    logp = logits - np.log(np.exp(logits).sum())

    def score(ids, starts, given):
        ends = np.append(starts[1:], len(ids))
        return np.array([logp[ids[s + g : e]].sum() for s, g, e in zip(starts, given, ends, strict=True)])

    return score


def test_scorers(spark):
    c = np.log(254 + np.exp(3) + np.e)
    score = constant({"x": 3.0, "y": 1.0})
    got = score(np.frombuffer(b"qxqzz", np.uint8).astype(int), np.array([0, 2]), np.array([1, 1]))
    assert np.allclose(got, [3 - c, -2 * c]) and abs(c - 5.6233090197) < 1e-9
    schema = "phase int, story_id long, text_with_mask string, answer string, candidates array<string>"
    items = spark.createDataFrame([(0, 1, "q[MASK]", "x", ["x", "y", "zz"]), (0, 2, "q[MASK]", "y", ["x", "y", "zz"])], schema)
    r = scoring.cloze_accuracy(items, score).first()
    assert (r["n"], r["n_correct"], r["accuracy"], r["chance"]) == (2, 1, 0.5, 0.333333)
    tie = spark.createDataFrame([(0, 1, "q[MASK]", "xy", ["xy", "yx"])], schema)
    assert scoring.cloze_accuracy(tie, score).first()["accuracy"] == 0.0
    many = items.select("phase", "story_id", F.lit("q").alias("prefix"), F.col("candidates").alias("options"))
    one = {(r["story_id"], r["at"]): (r["conditional"], r["baseline"]) for r in scoring.option_scores(many, score).collect()}
    assert np.allclose(one[1, 0], [3 - c, 3 - c]) and np.allclose(one[2, 2], [-2 * c, -2 * c])


def test_bigram_scorer_does_not_hang_on_its_batch(spark):
    texts = spark.createDataFrame([("abcabcabd",), ("b\0ca",), (None,), ("",)], "t string")
    pairs = {(r["prev"], r["next"]): r["c"] for r in scoring.bigrams(texts, [], "t").collect()}
    assert pairs[97, 98] == 3 and pairs[0, 97] == 1 and pairs[98, 99] == 3 and sum(pairs.values()) == 12
    score = scoring.bigram_scorer(scoring.bigram_model(texts, "t"))
    a, b = np.frombuffer(b"abca", np.uint8).astype(int), np.frombuffer(b"bd", np.uint8).astype(int)
    both = score(np.concatenate([a, b, a]), np.array([0, 4, 6]), np.array([1, 2, 1]))
    assert np.allclose(both, [score(a, np.array([0]), np.array([1]))[0], 0.0, both[0]])
    ids, start = scoring.truncated_left(np.arange(10), 8, 4)
    assert ids.tolist() == [6, 7, 8, 9] and start == 2 and scoring.truncated_left(np.arange(10), 2, 4)[1] == 1


def test_continuation_items_keep_their_contract(spark):
    rows = stories(spark, [(i, 0, f"open {i}\n\nmiddle of it {i:03d}\n\nthe end of it {i:03d}") for i in range(12)])
    items = probes.drawn_items(rows, 1)
    manifest = guard.manifest_of(rows)
    none = spark.createDataFrame([], "story_sha256 string")
    assert probes.continuation_contract(items, manifest, none).count() == 0
    leaked = probes.continuation_contract(items, manifest, manifest.limit(1)).select("rule").distinct().collect()
    assert [r["rule"] for r in leaked] == ["source in training"]
    assert {r["id"] for r in items.collect()} == {f"continuation-p0-{k:04d}" for k in range(1, 13)}


def test_file_guard(spark):
    guard.disjoint("/data/train", "/data/exam")
    for a, b in (("/data/train", "/data/train/"), ("/data", "/data/exam"), ("file:///data/exam/x", "/data/exam")):
        with pytest.raises(guard.ContractViolation):
            guard.disjoint(a, b)
    manifest = guard.manifest_of(stories(spark, [(1, 0, "A held  out story")]))
    sha = manifest.first()["prompt_hash"]
    files = [("a.txt", "A held out\nstory"), ("b.jsonl", '{"story": "A held out story"}\r\n\r\nnot json\n'), ("c.json", json.dumps([sha], indent=1)), ("d.txt", f"clean\n {sha} \n"), ("e.bin", "clean")]
    got = guard.text_hits(spark.createDataFrame(files, "path string, text string"), manifest).collect()
    assert sorted((r["path"], r["line"], r["reason"]) for r in got) == [("a.txt", 0, "story_sha256"), ("b.jsonl", 1, "story_sha256"), ("b.jsonl", 3, "unparsable"), ("c.json", 0, "prompt_hash"), ("c.json", 2, "prompt_hash"), ("d.txt", 2, "prompt_hash")]
    lines = spark.createDataFrame([("f:1", "m"), ("f:2", "m"), ("f:3", None)], "place string, model string")
    assert guard.model_violations(lines, "m").first()["rule"] == "no model" and guard.model_violations(lines.where("model = 'm'"), "m").count() == 0
    assert guard.model_violations(lines.limit(0), "m").first()["rule"] == "no story lines" and guard.model_violations(lines.where("model = 'm'"), "k").first()["rule"] == "exam_model"
    expected = spark.createDataFrame([("x", "AA"), ("y", "bb"), ("../z", "cc"), ("w", "dd")], "path string, sha256 string")
    found = spark.createDataFrame([("x", "aa"), ("y", "b0")], "path string, sha256 string")
    assert {r["path"]: r["problem"] for r in guard.bundle_problems(found, expected).collect()} == {"y": "changed", "../z": "unsafe path", "w": "missing"}
    cells = {"cells": [{"cell_type": "code", "outputs": [{"a": 1}], "execution_count": 3}, {"cell_type": "markdown"}, {"cell_type": "code", "outputs": [], "execution_count": None}]}
    problems = guard.notebook_problems(spark.createDataFrame([("n", json.dumps(cells))], "path string, text string")).collect()
    assert sorted((r["cell"], r["problem"]) for r in problems) == [(0, "execution_count"), (0, "outputs")]


def test_corpus_files(spark, tmp_path):
    folder = tmp_path / "train"
    folder.mkdir()
    for k in (0, 2, 10):
        (folder / f"train_phase_{k}.jsonl").write_text('{"id": "a", "story": "s", "split": "train", "model": "m"}\n')
    (folder / "notes.txt").write_text("x")
    names = lambda paths: [p.rsplit("_", 1)[1] for p in paths]
    assert names(corpus.corpus_files(spark, str(folder))) == ["0.jsonl", "2.jsonl", "10.jsonl"] and names(corpus.corpus_files(spark, str(folder), [0, 2])) == ["0.jsonl", "2.jsonl"]
    for bad in ([0, 1], [5]):
        with pytest.raises(guard.ContractViolation):
            corpus.corpus_files(spark, str(folder), bad)
    (tmp_path / "other.jsonl").write_text("{}")
    (folder / "train_phase_3.jsonl").symlink_to(tmp_path / "other.jsonl")
    with pytest.raises(guard.ContractViolation, match="outside"):
        corpus.corpus_files(spark, str(folder))
    (folder / "replay").mkdir()
    (folder / "replay" / "phase_2.json").write_text('{"seed": 1, "prompt_hashes": ["a", "b", "a"]}')
    assert sorted(map(tuple, corpus.replay_hashes(spark, str(folder)).collect())) == [(2, "a"), (2, "b")]
    (folder / "bad.txt").write_bytes(b"\xff\xfe")
    (folder / "bom.txt").write_bytes("﻿hello".encode())
    read = {r["path"].rsplit("/", 1)[1]: (r["text"], r["refused"]) for r in corpus.readable(spark, str(folder)).collect()}
    assert read["bad.txt"] == (None, True) and read["bom.txt"] == ("hello", False)


def test_run_records_are_rewritten_whole(spark, tmp_path):
    record = lambda hours: [("A_s0_abcdef0_20250101T000000Z", "commit: 1\ndirty: false\n", None, json.dumps({"gpu_hours": hours}), "{}")]
    schema = "run_id string, commit_txt string, matrix string, timings string, config string"
    for hours in (1.0, 2.0):
        files.write_run_record(spark.createDataFrame(record(hours), schema), str(tmp_path))
    r = corpus.run_folders(spark, str(tmp_path)).first()
    assert json.loads(r["timings"]) == {"gpu_hours": 2.0} and r["matrix"] is None
    loaded = runs.loaded(corpus.run_folders(spark, str(tmp_path))).first()
    assert (loaded["reason"], loaded["arm"], loaded["seed"]) == ("missing matrix.json", "A", 0)
    aggregates = spark.createDataFrame([("A", "accuracy", 0.5, 0.25, 2, "0,1")], "arm string, metric string, mean double, sd double, n long, seeds string")
    lines = corpus.report_lines(aggregates, runs.loaded(corpus.run_folders(spark, str(tmp_path))).select("run_id", "reason"))
    assert lines == ["accuracy A: 0.5000 +- 0.2500 (n=2; seeds 0,1)", "left out A_s0_abcdef0_20250101T000000Z: missing matrix.json"]
    pairs = spark.createDataFrame([(2, 0, 9, 0, "shingle", 0.5, 0.5), (1, 0, 9, 0, "shingle", 0.5, 0.5)], "exam_id long, exam_phase int, train_id long, train_phase int, rule string, containment double, jaccard double")
    corpus.write_pairs_report(pairs, f"{tmp_path}/pairs")
    assert [json.loads(r["value"])["exam_id"] for r in spark.read.text(f"{tmp_path}/pairs").collect()] == [1, 2]
    items = spark.createDataFrame([(1, 5, "b"), (1, 2, "a")], "phase int, story_id long, answer string")
    corpus.write_probes(items, f"{tmp_path}/probes", "cloze")
    assert [r["story_id"] for r in spark.read.json(f"{tmp_path}/probes/kind=cloze/phase=1").collect()] == [2, 5]


def test_hashes_and_small_operators(spark):
    m = spark.createDataFrame([({"b": "2", "train": '{"z": "1", "a": "0"}', "fingerprint": "f"},)], "h map<string, string>")
    r = m.select(runs.flat_hashes(F.col("h")).alias("f"), runs.canonical_json(runs.flat_hashes(F.col("h"))).alias("j")).first()
    assert r["f"] == {"b": "2", "train.a": "0", "train.z": "1"} and r["j"] == '{"b":"2","train.a":"0","train.z":"1"}'
    one = lambda e: spark.range(1).select(e.alias("x")).first()["x"]
    assert one(packing.byte_tokens(F.lit("a\0b"), keep_nul=True)) == [97, 0, 98] and one(packing.byte_tokens(F.lit("a\0b"))) == [97, 98]
    assert sum(spark.range(1).select(*packing.parameters(F.lit(8), F.lit(512), F.lit(8192), F.lit(1024))).first()) == 29_901_824
    assert packing.tokenizer_fingerprint(256, 0, [1]) == packing.tokenizer_fingerprint(256, 0, [1]) != packing.tokenizer_fingerprint(256, 0, [2])
    assert [r["phase"] for r in packing.empty_phases(spark.createDataFrame([(0, 1)], "phase int, seq_id long"), [0, 3]).collect()] == [3]
    nan = spark.createDataFrame([("r", "cloze", 0, 0, float("nan")), ("s", "cloze", 0, 0, 1.0)], "run string, exam string, i int, j int, value double")
    assert np.isnan(matrix.mean_matrix(nan, []).first()["mean"])


def test_progress_is_acted_on_once(spark, tmp_path):
    source, state, acted = tmp_path / "timings", str(tmp_path / "state"), []
    schema = "run string, phase int, eval_s double"

    def go():
        q = stream.on_progress(spark.readStream.schema(schema).json(str(source)), acted.append, state)
        q.awaitTermination(60)

    for phases in ([(0, 1.0)], [(0, 2.0), (1, 0.0)], [(1, 3.0), (2, 1.0)]):
        spark.createDataFrame([("r", *p) for p in phases], schema).write.mode("append").json(str(source))
        go()
    go()
    assert acted == [1, 3]


def test_waiting_for_phases():
    class Query:
        isActive = False

    counts = iter([0, 1, 2])
    assert stream.wait_for_phases(Query(), lambda: next(counts), 2, 5.0) and not stream.wait_for_phases(Query(), lambda: 0, 1, 0.1)
