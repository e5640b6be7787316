"""Toxicity: grams and FTRL steps against plain Python, what is learned from, held-out accuracy, odd rows."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from storyloom.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def plain_grams(text):
    """Grams by kind as tuples of words."""
    w = [x for x in re.split(rb"[^0-9a-z\x80-\xff]+", (text or "").lower().encode()) if x]
    out = {0: w} | {k: [x[:n] for x in w if len(x) > n] for k, n in enumerate(toxicity.STEMS, 1)}
    return out | {k: list(zip(w, w[g:])) for k, g in enumerate(toxicity.GAPS, 1 + len(toxicity.STEMS))}


def test_grams_are_those_of_plain_python():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["Idiot,", "É", "über", "a", "don't", "x" * 70, "\n", "100%", "ße"]) for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, "", "...", "one"]
    named = {}
    for kind, doc, bucket in toxicity.grams(pa.array(texts)):
        want = [(i, g) for i, t in enumerate(texts) for g in plain_grams(t)[kind]]
        assert doc.tolist() == [i for i, _ in want]
        for (_, gram), b in zip(want, bucket.tolist()):
            assert named.setdefault((kind, gram), b) == b
    assert len(set(named.values())) > 0.99 * len(named)


def test_grams_do_not_hang_on_the_batch():
    texts = ["an old tale of the sea", "", "the sea of old"]
    whole = {(k, t, b) for k, d, v in toxicity.grams(pa.array(texts)) for t, b in zip(d.tolist(), v.tolist())}
    assert whole == {(k, i, b) for i, t in enumerate(texts) for k, _, v in toxicity.grams(pa.array([t])) for b in v.tolist()}


def test_steps_are_those_of_the_plain_rule():
    rng = np.random.default_rng(3)
    model = toxicity.Ftrl(alpha=0.4, beta=1.0, l1=0.2, l2=0.1)
    z, n = {}, {}
    for _ in range(200):
        at, y, weight = np.unique(rng.integers(0, 20, 5)), float(rng.integers(0, 2)), float(rng.uniform(0.5, 2))
        w = {i: 0.0 if abs(z.get(i, 0)) <= 0.2 else -(z[i] - math.copysign(0.2, z[i])) / ((1 + math.sqrt(n[i])) / 0.4 + 0.1) for i in at.tolist()}
        g = (1 / (1 + math.exp(-sum(w.values()))) - y) * weight
        for i in w:
            was = n.get(i, 0.0)
            z[i] = z.get(i, 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / 0.4 * w[i]
            n[i] = was + g * g
        model.learn(at, y, weight)
    assert np.allclose([model.z[i] for i in z], list(z.values())) and np.allclose([model.n[i] for i in n], list(n.values()))


def test_held_out_rows_are_told_apart(spark):
    got = {r.doc_id: r for r in queries.op11_ftrl_toxicity(spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(got) == docs.count()
    held = [(got[i].score, y) for i, y in labels.items() if got[i].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    ones, zeros = np.array([s for s, y in held if y]), np.array([s for s, y in held if not y])
    auc = ((ones[:, None] > zeros).sum() + 0.5 * (ones[:, None] == zeros).sum()) / (len(ones) * len(zeros))
    assert auc > 0.98 and (ones >= 0.3).mean() > 0.85 and (zeros >= 0.3).mean() < 0.01


def test_labels_of_held_out_rows_do_not_count(spark):
    rows = [(i, f"tale {i % 7} of the sea " + ("scum" if i % 3 == 0 else "calm"), 1, "x") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, label string")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    known = spark.createDataFrame([(i, int(i % 3 == 0), 1) for i in range(400)], "doc_id long, toxic int, quality int")
    turned = spark.createDataFrame([(i, int((i % 3 == 0) != held(i)), 0) for i in range(400)], "doc_id long, toxic int, quality int")
    first, second = ({r.doc_id: r.score for r in toxicity.scored(docs, k).collect()} for k in (known, turned))
    assert first == second
    assert min(s for i, s in first.items() if i % 3 == 0) > max(s for i, s in first.items() if i % 3)
    assert toxicity.scored(docs, known).columns == ["doc_id", "text", "score_in", "label", "score"]


def test_rows_of_one_id_are_learned_from_once(spark):
    docs = spark.createDataFrame([(1, f"scum {i % 50}") for i in range(5000)] + [(2, "calm"), (3, "calm sea"), (4, "scum")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, 1), (4, 1), (None, 1), (5, None), (6, 7)], "doc_id long, toxic int")
    seen = []
    real = toxicity.Ftrl.fit
    try:
        toxicity.Ftrl.fit = lambda self, rows, *a, **k: seen.append(len(rows)) or real(self, rows, *a, **k)
        assert toxicity.scored(docs.repartition(8), labels).count() == 5003
    finally:
        toxicity.Ftrl.fit = real
    assert seen and seen[0] <= 4


def test_odd_rows_and_empty_tables(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    rows = [(i, "mild" if i % 2 == 0 else "nasty") for i in range(40)] + [(7, "nasty"), (None, "nasty"), (50, None), (51, ""), (52, "mild " * 300000 + "nasty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.scored(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.text == "nasty"}) == 1 and len({r.score for r in got if not r.text}) == 1
    assert toxicity.scored(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.scored(docs, labels.limit(0)).collect()} == {0.5}
