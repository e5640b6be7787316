"""The filter audit against a plain count over sets, and on nulls, repeated rows, empty tables and clashing columns."""

import itertools
import random

import numpy as np

from storyloom.llm import filter_audit

ASCII = "\x20\x09\x0a\x0b\x0c\x0d"


def fails(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, part in rows:
        t = t or ""
        w = "".join(" " if c in ASCII else c for c in t).split(" ")
        w = [x for x in w if x]
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t)}
        f["E"] = i is not None and i > least[t]
        out.append((part or "", {k for k, v in f.items() if v}))
    return out


def plain(rows, marks):
    """Every figure from sets of documents, order by order."""
    found = fails(rows)
    good, toxic = ({i for i, q, x in marks if v(q, x)} for v in (lambda q, x: q == 1, lambda q, x: x == 1))
    out = {}
    for part in {p for p, _ in found}:
        of = {k: {n for n, (p, f) in enumerate(found) if p == part and k in f} for k in "ABCDE"}
        every = {n for n, (p, _) in enumerate(found) if p == part}
        share = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            gone = set()
            for k, f in enumerate(order):
                now = of[f] - gone
                share[f] += len(now)
                only = of[f] - set().union(*(of[x] for x in "ABCDE" if x != f))
                lost = lambda s: sum(rows[n][0] in s for n in now)  # noqa: B023, E731
                out[part, "".join(order), k + 1] = [len(every - gone - now), len(now), len(of[f] & gone), len(only), lost(good), lost(toxic)]
                gone |= now
        for key in [k for k in out if k[0] == part]:
            out[key].append(share[key[1][key[2] - 1]])
    return out


def run(spark, rows, marks):
    docs = spark.createDataFrame([(i, t, p, 1, 2, "x", 3) for i, t, p in rows], "doc_id long, text string, lang string, own int, salt int, part string, toxic int")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = filter_audit.audited(docs.repartition(3), labels).collect()
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got}


def test_audit_against_plain_sets(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 9)
    texts = [" ".join(word() for _ in range(rng.choice([5, 99, 100, 150]))) + rng.choice(["", " #", " ABC" * 40, " É É"]) for _ in range(40)]
    texts += [" ".join(f"w{i}" for i in range(n)) for n in (99, 100, 101)] + [None, "", " \t\n", "A" * 11 + "b" * 89, "A" * 10 + "b" * 90, "x" * 200000]
    rows = [(i, rng.choice(texts), rng.choice(["en", "fr", None, ""])) for i in range(150)]
    rows += [(7, texts[0], "en"), (7, texts[0], "en"), (None, texts[0], "fr"), (None, None, None)]
    marks = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    assert run(spark, rows, marks) == plain(rows, [m for m in marks if m[0] is not None])


def test_audit_of_no_rows_and_no_labels(spark):
    assert run(spark, [], []) == {}
    rows = [(1, "a b", "en"), (2, "a b", "en")]
    assert run(spark, rows, []) == plain(rows, [])


def test_bitsets_of_many_parts():
    rng = np.random.default_rng(1)
    part, fails_, good, toxic = rng.integers(0, 50, 1000) * 3, rng.integers(0, 32, 1000), rng.integers(0, 2, 1000), rng.integers(0, 2, 1000)
    for subset, kinds, (alive, of_good, of_toxic) in filter_audit.bitset_counts(part, fails_, good, toxic):
        kept = fails_ & subset == 0
        assert kinds.tolist() == sorted(set(part.tolist()))
        assert alive.tolist() == [int((kept & (part == k)).sum()) for k in kinds]
        assert of_good.tolist() == [int((kept & (part == k) & (good == 1)).sum()) for k in kinds]
        assert of_toxic.tolist() == [int((kept & (part == k) & (toxic == 1)).sum()) for k in kinds]
