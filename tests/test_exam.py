"""Windowed perplexity and whole exams against plain loops, and what a folder is refused for."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.operators import exam, guard, probes, scoring

C = math.log(254 + math.e**3 + math.e)


def constant(prefers):
    logits = np.zeros(256)
    for c, v in prefers.items():
        logits[ord(c)] = v
    logp = logits - np.log(np.exp(logits).sum())

    def score(ids, starts, given):
        ends = np.append(starts[1:], len(ids))
        return np.array([logp[ids[s + g : e]].sum() for s, g, e in zip(starts, given, ends, strict=True)])

    return score


def after(prev, nxt):
    """Prefers a byte after another one, for whole spans."""

    def score(ids, starts, given):
        ends = np.append(starts[1:], len(ids))
        return np.array([sum((4.0 if (ids[i - 1], ids[i]) == (ord(prev), ord(nxt)) else 0.0) - 5.5 for i in range(s + g, e)) for s, g, e in zip(starts, given, ends, strict=True)])

    return score


def perplexity(spark, texts, scorer, **how):
    return {r["phase"]: (r["n_tokens"], r["loss"]) for r in scoring.windowed_perplexity(spark.createDataFrame(texts, "phase int, story string"), scorer, "phase", "story", **how).collect()}


def test_windows_of_stories(spark):
    score = constant({"x": 3.0, "y": 1.0})
    n, loss = perplexity(spark, [(0, "xy"), (0, "zzz")], score)[0]
    assert n == 3 and abs(loss - (C - 1 / 3)) < 1e-9 and abs(loss - 5.2899757) < 1e-7
    assert perplexity(spark, [(0, "a" * 10), (0, "b" * 5)], score, block=4)[0][0] == 7 + 3
    got = perplexity(spark, [(0, "a"), (0, ""), (0, None), (1, "xx"), (None, "zzz")], score)
    assert got[0][0] == 0 and math.isnan(got[0][1]) and got[1] == (1, pytest.approx(C - 3)) and got[None] == (2, pytest.approx(C))
    assert perplexity(spark, [], score) == {}


def test_windows_against_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    texts = [(int(rng.integers(0, 3)), "".join(rng.choice(list("xyzé "), int(rng.integers(0, 60))))) for _ in range(200)]
    score, block, want = after("x", "y"), 7, {}
    for phase, text in texts:
        ids = np.frombuffer(text.encode(), np.uint8)
        for at in range(0, len(ids), block):
            window = ids[at : at + block]
            if len(window) > 1:
                n, s = want.get(phase, (0, 0.0))
                want[phase] = n + len(window) - 1, s + score(window, np.array([0]), np.array([1]))[0]
    got = perplexity(spark, texts, score, block=block)
    assert {k: (n, pytest.approx(-s / n)) for k, (n, s) in want.items()} == got


def test_another_tokenizer(spark):
    words = {}
    encode = lambda t: np.array([words.setdefault(w, len(words) + 1) for w in t.split()], np.int64)
    even = lambda ids, starts, given: -(np.append(starts[1:], len(ids)) - starts - given) * 2.0
    assert perplexity(spark, [(0, "a b c"), (0, "a"), (0, "b c")], even, encode=encode) == {0: (3, pytest.approx(2.0))}
    items = spark.createDataFrame([(0, "i", "a b", ["c d", "e"], 0)], "phase int, id string, prefix string, options array<string>, answer_index int")
    got = scoring.option_scores(items.withColumn("prefix", items.prefix), even, key=("phase", "id"), encode=lambda t: np.arange(len(t)), end=9).collect()
    assert {r["at"]: r["conditional"] for r in got} == {0: -6.0, 1: -2.0}


STORIES = {0: ["qx and so on", "qxx told twice"], 3: ["zzz", "xyxy"]}


def sha(spark, text):
    return spark.range(1).select(T.story_sha256(__import__("pyspark.sql.functions", fromlist=["lit"]).lit(text))).first()[0]


@pytest.fixture
def folder(spark, tmp_path):
    hashes = {}
    for d in ("stories", "probes"):
        (tmp_path / d).mkdir()
    for k in range(exam.PHASES):
        rows = [{"id": f"s{k}-{i}", "phase": k, "story": s} for i, s in enumerate(STORIES.get(k, [f"story of phase {k}", f"another of phase {k}"]))]
        hashes |= {sha(spark, r["story"]): (k, r["id"]) for r in rows}
        source = [{"story_id": r["id"], "story_sha256": sha(spark, r["story"]), "phase": k} for r in rows]
        cloze = [{"id": f"c{k}-{i}", "phase": k, "text_with_mask": "q[MASK]", "answer": a, "candidates": ["x", "y", "zz"]} for i, a in enumerate("xy")]
        options = [{"id": f"o{k}", "phase": k, "prefix": "q", "options": ["y", "x"], "answer_index": 1, "distractor_phases": [k], "option_sources": source}]
        for name, values in ((f"stories/exam_phase_{k}", rows), (f"probes/cloze_phase_{k}", cloze), (f"probes/continuation_phase_{k}", options)):
            (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, values)) + "\n")
    frozen = spark.createDataFrame([(h.upper() if i % 2 else h, k) for i, (h, (k, _)) in enumerate(hashes.items())], "story_sha256 string, phase int")
    return tmp_path, frozen


def edit(path, change):
    rows = [json.loads(x) for x in path.read_text().splitlines()]
    change(rows)
    path.write_text("\n".join(map(json.dumps, rows)) + "\n")


def test_an_exam_folder_gives_a_row_of_four_scores(spark, folder):
    path, frozen = folder
    scores = exam.evaluate_folder(spark, str(path), constant({"x": 3.0, "y": 1.0}), [0, 3], frozen).cache()
    got = {r["phase"]: r for r in scores.collect()}
    assert sorted(got) == list(range(7)) and got[0]["n_tokens"] == 11 + 13 and got[3]["n_tokens"] == 5
    assert (got[3]["cloze"], got[3]["n_cloze"], got[3]["cloze_chance"]) == (0.5, 2, pytest.approx(1 / 3))
    # the same after every prefix: no option gains by one, and the sums tell x from y
    assert (got[0]["continuation"], got[0]["continuation_summed"], got[0]["n_continuation"], got[0]["continuation_chance"]) == (0.0, 1.0, 1, 0.5)
    assert math.isnan(got[1]["perplexity"]) and got[1]["n_tokens"] == 0 and got[1]["cloze_chance"] is None
    row = exam.matrix_row(scores).first()
    assert [len(row[c]) for c in exam.SCORES] == [7] * 4 and row["perplexity"][3] == pytest.approx(C - 1)
    assert [i for i, x in enumerate(row["cloze"]) if not math.isnan(x)] == [0, 3]
    pmi = exam.evaluate_folder(spark, str(path), after("q", "x"), [0]).where("phase = 0").first()
    assert (pmi["continuation"], pmi["continuation_summed"]) == (1.0, 1.0)
    with pytest.raises(ValueError, match="phases"):
        exam.evaluate_folder(spark, str(path), after("q", "x"), [7])


@pytest.mark.parametrize(
    ("name", "change", "rule"),
    [
        ("stories/exam_phase_0", lambda r: r[0].update(story="edited"), "not frozen.*missing|missing.*not frozen"),
        ("stories/exam_phase_0", lambda r: r.append(dict(r[0])), "twice"),
        ("stories/exam_phase_0", lambda r: r.pop(), "missing"),
        ("stories/exam_phase_0", lambda r: r[0].update(phase=3), "filed under another phase"),
        ("stories/exam_phase_0", lambda r: r[0].update(story="zzz"), "frozen for another phase"),
        ("stories/exam_phase_0", lambda r: r[0].pop("story"), "no story"),
        ("probes/cloze_phase_0", lambda r: r[0].update(text_with_mask="[MASK] [MASK]"), "one mask"),
        ("probes/cloze_phase_0", lambda r: r[0].update(answer="w"), "answer missing"),
        ("probes/continuation_phase_0", lambda r: r[0].update(answer_index=2), "answer index"),
        ("probes/continuation_phase_0", lambda r: r[0]["option_sources"][0].update(story_sha256="0" * 64), "source unknown"),
        ("probes/continuation_phase_0", lambda r: r[0]["option_sources"][0].update(phase=3), "source phase"),
    ],
)
def test_folders_that_are_refused(spark, folder, name, change, rule):
    path, frozen = folder
    edit(path / f"{name}.jsonl", change)
    with pytest.raises(guard.ContractViolation, match=rule):
        exam.evaluate_folder(spark, str(path), after("q", "x"), [0], frozen)


def test_a_short_exam_is_refused(spark):
    from storyloom.operators import probes

    items = spark.createDataFrame([(k, f"i{k}{n}") for k in (0, 2) for n in range(3 + k)], "phase int, id string")
    short = {(r["entity"], r["detail"]) for r in probes.shortfalls(items, 4, [0, 1, 2]).collect()}
    assert short == {("0", "3 of 4"), ("1", "0 of 4")}
    with pytest.raises(guard.ContractViolation, match="too few items: 0"):
        probes.asked_items(items, 4, [0, 2])
    assert sorted(r["id"] for r in probes.asked_items(items, 3, [0, 2]).collect()) == ["i00", "i01", "i02", "i20", "i21", "i22"]


def test_items_are_made_and_scored_once(spark):
    items = spark.createDataFrame([("a", 0, "x [MASK] y", ["one", "two"], "two", "p", ["q", "r"], 1)], "story_id string, phase int, text_with_mask string, candidates array<string>, answer string, prefix string, options array<string>, answer_index int")
    score = lambda ids, starts, given: np.add.reduceat(ids, starts).astype(float)
    for out in (scoring.option_results(items, score), scoring.cloze_results(items, score)):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
        assert out.first()["n"] == 1
    rows = [(f"{'é' * 700} [MASK] {'b' * n}", c) for n in (0, 1017, 1018, 1019, 1024, 3000) for c in ("", "word", "é")]
    for text, c in rows:
        assert scoring._tail(text, 1024).replace("[MASK]", c).encode()[-1024:] == text.replace("[MASK]", c).encode()[-1024:]
    assert len(scoring._tail(rows[-1][0], 1024)) < 1100


def test_ends_of_texts_score_as_whole_texts(spark):
    words = ["amber", "birch", "cedar", "delta", "ember", "flint", "grove", "heath", "inlet", "jetty", "knoll", "larch", "marsh", "north", "ocean", "plume", "quill", "ridge", "shoal", "thorn", "umber", "vale1"]
    rows = [(i, 0, f"{'é' * (i % 7)} start{words[i % 22]} of it\n\n{'x' * (5 * i)} {words[i % 22]} {'tail ' * (3 * i % 17)}[MASK]"[: -6 if i % 5 else None]) for i in range(60)]
    stories = spark.createDataFrame(rows, "id long, phase int, story string")
    lexicon = spark.createDataFrame([(0, w) for w in words], "phase int, word string")
    scorer = scoring.bigram_scorer(scoring.bigram_model(stories, "story"))
    scores = lambda tail: {(r["story_id"], r["at"]): r["score"] for r in scoring.cloze_scores(probes.cloze_items(stories, lexicon, 7, tail=tail), scorer, 12).collect()}
    whole, ends = scores(None), scores(12)
    assert len(whole) == 60 * probes.N_CANDIDATES and ends == whole
    moved = lambda tail: probes.cloze_items(stories, lexicon, 7, tail=tail).agg(F.sum(F.length("text_with_mask"))).first()[0]
    assert moved(12) < moved(None)
    both = [{(r["story_id"], r["at"]): (r["conditional"], r["baseline"]) for r in scoring.option_scores(probes.drawn_items(stories, 7, tail), scorer, 12).collect()} for tail in (None, 12)]
    assert both[0] == both[1] and both[0]
    # No more stories and paragraphs are moved than are wanted.
    some = stories.where("id % 20 = 3").select("phase", "id")
    assert {r["id"] for r in probes._screened(stories, some, ["phase", "id"]).collect()} == {3, 23, 43}
