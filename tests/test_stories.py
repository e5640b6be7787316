"""Literal expectations of the text, overlap, packing, probe, matrix and run operators, the stream, and the oracles."""

import importlib
import json
import sys

import pytest
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.operators import guard, matrix, neardup, packing, probes, runs, scoring
from storyloom.plans import oracles, views
from storyloom.plans import queries as plans
from storyloom.sources import corpus, files
from storyloom.streaming import ledger as stream

SMALL = "/root/testdata/sf0.001"


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, "The  Cat\r\nsat.", T.words) == ["the", "cat", "sat"]
    assert one(spark, "  Hello\r\n  World ", T.prefix_key) == "hello world"
    assert len(one(spark, "a b", lambda c: T.shingles(T.words(c)))) == 1 and len(one(spark, "a b c d e f", lambda c: T.shingles(T.words(c)))) == 2
    assert one(spark, "", lambda c: T.shingles(T.words(c))) == []
    assert one(spark, "One two three four five six. Too short! one two\nthree", T.sentences) == ["one two three four five six"]
    assert one(spark, "a\r\nb\rc d\n", T.loader_lines) == ["a", "b", "c d", ""]
    assert one(spark, " a\n \n b \n\nc", T.paragraphs) == ["a", "b", "c"] and one(spark, "a\n b", T.paragraphs) == ["a", "b"]
    assert one(spark, "Straße", T.words) == ["strasse"]
    composed = T.nfc_rows(spark.createDataFrame([("é",), ("plain",)], "t string"), "t").collect()
    assert {r["t"] for r in composed} == {"é", "plain"}


@pytest.mark.parametrize("a,b,kin", [("jump", "Jumping", True), ("jumped", "jumps", True), ("baby", "babies", True), ("run", "running", True), ("make", "making", True), ("jump", "junk", False)])
def test_related(spark, a, b, kin):
    assert spark.range(1).select(T.related(F.lit(a), F.lit(b)).alias("x")).first()["x"] is kin


def stories(spark, rows):
    return spark.createDataFrame(rows, "id long, phase int, story string")


def test_near_duplicates(spark):
    a = " ".join(f"w{i}" for i in range(60))
    exam = stories(spark, [(1, 0, a), (2, 1, "nothing of the kind is in here at all"), (3, 2, "x " * 120 + "tail of its own")])
    train = stories(spark, [(10, 0, a + " more"), (11, 1, "new " + a[40:]), (12, 2, "X " * 120 + "another end")])
    pairs = {(r["exam_id"], r["train_id"]): r for r in neardup.near_duplicates(exam, train).collect()}
    assert set(pairs) == {(1, 10), (1, 11), (3, 12)} and pairs[1, 11]["rule"] == "shingle" and pairs[1, 10]["containment"] == 1.0
    kept = neardup.drop_near_duplicates(exam, neardup.near_duplicates(exam, train))
    assert [r["id"] for r in kept.collect()] == [2]
    assert neardup.near_duplicates(exam, train, max_postings=0).where("rule = 'shingle'").count() == 0


def test_best_of_a_phase_without_flagged_pairs(spark):
    text = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    exam = stories(spark, [(1, 0, text("a", 14) + " " + text("b", 24)), (2, 1, text("c", 30)), (3, 2, text("d", 30))])
    train = stories(spark, [(10, 0, "x " + text("a", 14)), (11, 0, text("c", 30))])
    # The first shares 10 of its 34 shingles, the second all, the third none.
    got = {r["phase"]: (r["n_dropped"], r["max_containment"]) for r in neardup.by_phase(exam, train).collect()}
    assert got == {0: (0, 0.2941), 1: (1, 1.0), 2: (0, 0.0)}


def test_near_duplicate_scores_by_counts(spark):
    # 70 exam stories share a passage, so its shingles are rare for none; copies are one class, whatever their number.
    shared = " ".join(f"s{i}" for i in range(20))
    exam = [(i, i % 3, " ".join(f"e{i}w{k}" for k in range(i % 30 + 2)) + " " + shared) for i in range(70)] + [(100 + i, i % 3, "copy " * 3 + shared + " of its own") for i in range(5)]
    train = [(1000 + i, i % 3, f"t{i} " * 70 + exam[i][2]) for i in range(40)] + [(2000 + i, 1, exam[70][2]) for i in range(9)] + [(None, 1, exam[3][2]), (3000, 2, "!"), (3001, 2, None)]

    def grams(text):
        w = (text or "").replace("!", "").split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    held = {}
    for _, _, text in exam:
        for g in grams(text):
            held[g] = held.get(g, 0) + 1
    for cap in (64, None):
        want, best = {}, {}
        for i, phase, a in exam:
            for j, _, b in train:
                both = grams(a) & grams(b)
                opens = b is not None and a[:200] == b[:200]
                if j is not None and (opens or any(cap is None or held[g] <= cap for g in both)):
                    c = len(both) / len(grams(a))
                    best[phase] = max(best.get(phase, 0), c)
                    if opens or c >= 0.5:
                        want[i, j] = (round(c, 4), round(len(both) / len(grams(a) | grams(b)), 4))
        e, t = stories(spark, exam), stories(spark, train)
        got = [((r["exam_id"], r["train_id"]), (r["containment"], r["jaccard"])) for r in neardup.near_duplicates(e, t, max_postings=cap).collect()]
        assert dict(got) == want and len(got) == len(want)
        assert {r["exam_id"] for r in neardup.flagged(e, t, max_postings=cap).collect()} == {i for i, _ in want}
        assert {r["phase"]: r["max_containment"] for r in neardup.by_phase(e, t, max_postings=cap).collect()} == {p: round(c, 4) for p, c in best.items()}
    # Of the training side no more is dealt than the screen of the exam's shingles lets pass: all that is shared, and little else.
    e, t = stories(spark, exam[:1]), stories(spark, train)
    held = neardup._entries(e, "exam")
    passed, every = neardup._entries(t, "train", neardup._screen(held)), neardup._entries(t, "train")
    shared = lambda df: df.join(held.select("gram", "opening"), ["gram", "opening"]).count()
    assert shared(passed) == shared(every) > 0 and passed.count() <= shared(every) + 5 < every.count()
    copies = neardup.class_pairs(stories(spark, exam[70:]), stories(spark, train[40:49]))
    assert [r["containment"] for r in copies.collect()] == [1.0]


def test_guard(spark):
    exam = stories(spark, [(1, 0, "The  story\nheld out"), (2, 1, "another")])
    manifest = guard.manifest_of(exam)
    docs = spark.createDataFrame([(7, json.dumps({"a": ["x", {"b": "The story held out"}], "k": 3}))], "id long, j string")
    hits = guard.leaf_hits(guard.json_leaves(docs, "id", "j"), manifest).collect()
    assert [(h["entity"], h["reason"], h["story_id"]) for h in hits] == [("7", "story_sha256", "1")]
    assert guard.reconcile(exam, manifest).count() == 0
    problems = {r["problem"] for r in guard.reconcile(stories(spark, [(1, 3, "The story held out"), (9, 1, "new")]), manifest).collect()}
    assert problems == {"wrong phase", "not in manifest", "missing"}
    with pytest.raises(guard.ContractViolation, match="split"):
        guard.enforce(guard.split_violations(spark.createDataFrame([(1, "test", "m", "s")], "id long, split string, model string, story string")))
    bad = spark.createDataFrame([("a", "", "xyz", 9), ("a", "p", "0" * 64, 1)], "story_id string, prompt_hash string, story_sha256 string, phase int")
    assert {r["rule"] for r in guard.manifest_violations(bad).collect()} == {"story_sha256", "prompt_hash", "phase", "duplicate"}


def test_packing(spark):
    rows = spark.createDataFrame([(1, 0, "abc", 0), (2, 0, "de\0", 1), (3, 0, "fghij", 2), (4, 0, "", 3)], "id long, phase int, story string, lineno long")
    whole = "61626300" + "646500" + "666768696a00" + "00"
    got = [r["tokens_hex"].lower() for r in packing.packed(rows, 4).orderBy("seq_id").collect()]
    assert got == [whole[i : i + 8] for i in range(0, 24, 8)]
    assert spark.range(1).select(packing.replay_sequences(F.lit(0.3)).alias("x")).first()["x"] == 14
    assert one(spark, "a\0é", packing.byte_tokens) == [97, 195, 169] and one(spark, "aé", lambda c: packing.byte_text(packing.byte_tokens(c))) == "aé"


def test_probes(spark):
    text = "alpha word here saw things and " + " ".join(f"lex{chr(97 + i)}word" for i in range(3))
    rows = stories(spark, [(i, 0, f"{text} number{chr(97 + i)}") for i in range(4)])
    lexicon = spark.createDataFrame([(0, f"lex{chr(97 + i)}word") for i in range(25)], "phase int, word string")
    items = probes.cloze_items(rows, lexicon, 1)
    assert items.count() == 4 and probes.cloze_violations(items).count() == 0
    broken = items.withColumn("text_with_mask", F.col("story_id").cast("string"))
    assert {r["rule"] for r in probes.cloze_violations(broken).collect()} == {"one mask"}


def test_scoring_ties_are_wrong(spark):
    scores = spark.createDataFrame([(1, 0, 1.0, 0), (1, 1, 1.0, 0), (2, 0, 2.0, 0), (2, 1, 1.0, 0), (3, 0, 1.0, 0), (3, 1, 2.0, 0)], "item int, at int, s double, answer int")
    assert {r["item"]: r["correct"] for r in scoring.rank_one(scores, ["item"], "at", F.col("s"), "answer").collect()} == {1: False, 2: True, 3: False}
    assert spark.range(1).select(scoring.windows(F.lit(10), 4).alias("x")).first()["x"] == [4, 4, 2] and spark.range(1).select(scoring.windows(F.lit(5), 4).alias("x")).first()["x"] == [4]


def test_matrix(spark):
    cells = [("r", "cloze", i, j, 0.9 - 0.1 * (i - j) if j <= i else 0.2 + 0.01 * i) for i in range(7) for j in range(7)] + [("r", "cloze", -1, j, 0.2) for j in range(7)]
    m = spark.createDataFrame(cells, "run string, exam string, i int, j int, value double")
    assert abs(matrix.average_accuracy(m).first()["value"] - 0.6) < 1e-9
    assert abs(matrix.average_forgetting(m).first()["value"] - 0.35) < 1e-9
    transfer = {r["j"]: r["transfer"] for r in matrix.forward_transfer(m).collect()}
    assert transfer[0] is None and abs(transfer[3] - 0.02) < 1e-9
    assert matrix.incomplete(m).count() == 0
    nan = m.withColumn("value", F.when((F.col("i") == 2) & (F.col("j") == 1), float("nan")).otherwise(F.col("value")))
    assert [(r["i"], r["n_bad"]) for r in matrix.incomplete(nan).collect()] == [(2, 1)]
    got = {r["hypothesis"]: r["verdict"] for r in matrix.verdicts(views.grid(spark, "confirming")).collect()}
    assert got == {"H1": "confirmed", "H2a": "confirmed", "H2b": "low", "H3": "confirmed", "H4": "confirmed"}
    seeds = spark.createDataFrame([("A", s, v) for s, v in enumerate((0.595, 0.600, 0.605))], "arm string, seed int, value double")
    r = matrix.seed_aggregate(seeds, ["arm"]).first()
    assert abs(r["mean"] - 0.6) < 1e-9 and abs(r["sd"] - 0.005) < 1e-9 and r["seeds"] == "0,1,2"


def test_sources(spark, tmp_path):
    lines = [{"prompt_hash": "a", "story": "one", "split": "train", "model": "m"}, {"id": "b", "story": "two", "split": "test", "model": "m"}]
    (tmp_path / "train_phase_3.jsonl").write_text("\n\n".join(map(json.dumps, lines)) + "\nnot json\n")
    got = corpus.stories(spark, str(tmp_path), [3]).orderBy("lineno").collect()
    assert [(r["lineno"], r["id"], r["phase"], r["corrupt"] is not None) for r in got] == [(1, "a", 3, False), (3, "b", 3, False), (4, None, 3, True)]
    run = tmp_path / "runs" / "A_s0_abcdef0_20250101T000000Z"
    run.mkdir(parents=True)
    (run / "matrix.json").write_text('{"untrained": {"cloze": [0.1, NaN]}, "M": {"cloze": [[0.5, null], [NaN, 0.25]]}}')
    (run / "commit.txt").write_text("commit: 1\nDirty: true\ndirty: false\n")
    folders = corpus.run_folders(spark, str(tmp_path / "runs"))
    cells = {(r["i"], r["j"]): r["value"] for r in corpus.matrix_cells(folders).collect()}
    assert cells[0, 0] == 0.5 and cells[0, 1] is None and cells[1, 0] != cells[1, 0] and cells[-1, 0] == 0.1
    assert folders.select(runs.commit_fields(F.col("commit_txt")).alias("m")).first()["m"] == {"commit": "1", "dirty": "false"}
    assert corpus.ledger(spark, str(tmp_path / "none")).count() == 0
    hashes = files.file_hashes(spark, str(tmp_path / "runs"))
    assert files.tree_digest(hashes).first()["n_files"] == 2


def test_ledger_stream_equals_batch(spark, tmp_path):
    path, state = str(tmp_path / "ledger"), str(tmp_path / "state")
    row = lambda arm, status, h: (arm, 0, "d", status, h, "g", "c", "n", "t")
    for k, rows in enumerate([[row("A", "complete", 1.0), row("B", "failed", None)], [row("A", "complete", 2.5)]]):
        corpus.append_ledger(spark.createDataFrame(rows, corpus.LEDGER), path)
        q = stream.start_summary(stream.ledger_stream(spark, path), f"summary{k}", state)
        q.awaitTermination(60)
    got = sorted(map(tuple, spark.table("summary1").collect()))
    assert got == sorted(map(tuple, stream.running_summary(corpus.ledger(spark, path)).collect())) == [("A", "complete", 2, 3.5), ("B", "failed", 1, 0.0)]


def test_queries_have_oracles(spark):
    assert set(plans.QUERIES) == set(oracles.ORACLES)
    assert plans.near_duplicate_pairs(spark, SMALL).count() == 3


def test_entry_without_the_corpus_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith(("storyloom.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    with pytest.raises(ModuleNotFoundError):
        import corpus_pipeline  # noqa: F401
    assert set(importlib.import_module("__spark_entry__").queries()) >= set(plans.QUERIES)


def test_distractors_come_from_the_whole_phase(spark):
    # The first paragraph of each story opens it; the only one of the answer's length is no story's last paragraph.
    rows = [(i, 0, f"open {i}\n\n{'m' * 40}{i:03d}\n\n{'z' * 400}{i:03d}") for i in range(40)] + [(90, 1, "alone\n\nhere")]
    items = {r["story_id"]: r for r in probes.drawn_items(stories(spark, rows), 1).collect()}
    assert len(items) == 41 and items[90]["options"] is None
    assert {len(items[i]["answer"]) for i in range(40)} == {43, 403}
    for i in range(40):
        r = items[i]
        assert r["options"][r["answer_index"]] == r["answer"] and {len(o) for o in r["options"]} == {len(r["answer"])} and len(set(r["options"])) == 4
        assert len({s["story_id"] for s in r["option_sources"]}) == 4 and r["option_sources"][r["answer_index"]]["story_id"] == i
        assert r["prefix"].startswith(f"open {i}\n\n") and r["prefix"].endswith("\n\n")
    assert sorted(items[i]["answer_index"] for i in range(40)) == [k for k in range(4) for _ in range(10)]


def test_distractors_outside_the_band_where_the_phase_has_none(spark):
    rows = [(1, 0, "a\n\n" + "x" * 100), (2, 0, "b\n\nshort"), (3, 0, "c\n\nshort"), (4, 0, "d\n\nbrief"), (5, 0, "e\n\nwee")]
    items = {r["story_id"]: r for r in probes.drawn_items(stories(spark, rows), 1).collect()}
    assert set(items[1]["options"]) == {"x" * 100, "short", "brief", "wee"}
    assert items[2]["options"] is not None and len(set(items[2]["options"])) == 4


def test_every_usable_story_has_a_cloze_item(spark):
    rows = spark.createDataFrame([(i, f"common rareword{chr(97 + i % 26)}x others{chr(97 + i // 26)}y tail") for i in range(104)], "id long, story string").withColumn("phase", F.lit(0))
    lexicon = probes.share_lexicon(rows, 2, 28)
    assert lexicon.where("word = 'common'").count() == 0 and lexicon.count() == 30
    assert probes.share_lexicon(rows.unionByName(rows.withColumn("id", F.col("id") + 1000)), 2, 28).exceptAll(lexicon).count() == 0
    assert probes.cloze_items(rows, lexicon, 7).count() == 104
    assert {"cloze_items_all", "probe_violations_all"} <= set(plans.QUERIES)


def test_pairs_of_groups_beyond_the_posting_cap(spark, tmp_path):
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"opening{i} " * 30 + body + f" {body} end{i}", "en", "src1" if i < 70 else "src9") for i in range(71)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert plans.near_duplicate_pairs_by_source(spark, str(tmp_path)).count() == 0
    assert plans.near_duplicate_pairs_uncapped(spark, str(tmp_path)).count() == 70
    fewer = spark.createDataFrame(rows[60:], "doc_id long, text string, lang string, source string")
    fewer.write.parquet(f"{tmp_path}/few/documents.parquet")
    assert plans.near_duplicate_pairs_by_source(spark, f"{tmp_path}/few").count() == 10


def test_reconcile_reads_every_source(spark, tmp_path):
    rows = [(i, f"story {i}", "en", f"src{i % 20}") for i in range(1, 101)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["problem"]: r["n"] for r in plans.manifest_story_reconcile_all(spark, str(tmp_path)).groupBy("problem").agg(F.count("*").alias("n")).collect()}
    off, gone = {i for i in range(1, 101) if i % 17 == 3}, {i for i in range(1, 101) if i % 11 == 4}
    moved = {i for i in range(1, 101) if i % 13 == 5}
    assert got == {"not in manifest": len(off - gone), "missing": len(gone - off), "wrong phase": len(moved - off - gone)}


def test_cloze_answers_do_not_hang_on_how_many_words_are_looked_up_first(spark, monkeypatch):
    rows = views.train(spark, SMALL)
    lexicon = probes.share_lexicon(rows, 2, 28)

    def items(first):
        monkeypatch.setattr(probes, "FIRST", first)
        got = sorted(map(tuple, probes.cloze_items(rows, lexicon, 7).select("phase", "item", "story_id", "answer", "candidates").collect()))
        spark.catalog.clearCache()
        return got

    assert items(16) == items(1) == items(100_000)
    few = probes._lookups(rows, lexicon.withColumn("stem", F.col("word")), 7, 16).groupBy("story_id").count()
    assert few.agg(F.max("count")).first()[0] == 16


def test_drawn_items_of_ids_that_repeat_or_lack(spark):
    text = lambda k: "\n\n".join(f"part {k} {j} " + "w" * (k % 5) for j in range(3))
    rows = [(k if k < 30 else 3 if k < 32 else None, 0, text(k)) for k in range(34)]
    out = probes.drawn_items(spark.createDataFrame(rows, "id long, phase int, story string"), 1).collect()
    assert len(out) == 34 and sorted(int(r["id"][-4:]) for r in out) == list(range(1, 35))
    assert {r["answer_index"] for r in out} == {0, 1, 2, 3} and sum(r["options"] is None for r in out) == 2
    assert all(r["options"][r["answer_index"]] == r["answer"] for r in out if r["options"])


def test_a_text_is_hashed_and_moved_but_not_kept_with_its_item(spark):
    probes.drawn_items(views.train(spark, SMALL), 1)
    plans_kept = spark._jsparkSession.sharedState().cacheManager()
    df = probes.drawn_items(views.train(spark, SMALL), 1)
    kept = df._jdf.queryExecution().withCachedData().toString()
    assert not plans_kept.isEmpty() and "prefix" not in "".join(x for x in kept.splitlines() if "InMemoryRelation" in x)
    spark.catalog.clearCache()


def test_normal_forms_hold_one_text_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(T, "NORMAL_BYTES", 4)
    texts = ["café", "café", None, "", "plain", "각"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1)
    got = rows.select("id", T.normalizer("NFD")(F.col("t")).alias("apart"), T.nfc(F.col("t")).alias("one")).orderBy("id").collect()
    assert [r["apart"] for r in got] == ["café", "café", None, "", "plain", "각"]
    assert [r["one"] for r in got] == ["café", "café", None, "", "plain", "각"]


def test_ngram_overlap_makes_only_exam_grams_distinct(spark):
    words = [f"w{i}" for i in range(12)]
    exam = stories(spark, [(1, 0, " ".join(words)), (2, 1, " ".join(words[:8]).upper()), (3, 2, None), (4, 2, "too short"), (5, 3, " ".join(words[:8] * 2))])
    train = stories(spark, [(1, 0, " ".join(words[1:10])), (2, 0, " ".join(words[1:10])), (3, 1, None), (4, 1, ""), (5, 2, "x " + " ".join(words[:8]) + ", y " + " ".join(words[:8]))])
    out = neardup.ngram_overlap(exam, train)
    got = {(r["exam_phase"], r["train_phase"]): (r["n_exam_ngrams"], r["n_shared"]) for r in out.collect()}
    assert len(got) == 12 and {k: v for k, v in got.items() if v[1]} == {(0, 0): (5, 2), (0, 2): (5, 1), (1, 2): (1, 1), (3, 2): (8, 1)}
    assert got[2, 0] == (0, 0) and got[1, 0] == (1, 0)
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()
