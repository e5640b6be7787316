"""Each operator against brute force, an exact round trip or its invariants, and on nulls, empty and odd tables."""

import base64
import collections
import datetime
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from storyloom.llm import ann, bpe, common, exact_topk, html_extract, line_dedup, mixing, near_dedup, pii, quality, queries, sharding

WORDS = [f"w{i}" for i in range(300)]
EXTRA = "size long, id long, hash string, label int, n long, batch int, rank int, key string, copies int"


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def table(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    schema = f"doc_id long, text string, source string, lang string, {EXTRA}"
    return spark.createDataFrame([(*r, "en", 1, 2, "h", 3, 4, 5, 6, "k", 7) for r in rows], schema)


def odd_rows():
    rng = random.Random(4)
    a = text(rng, 40)
    line = "This line is in many of the documents\nbut this is short"
    rows = [(1, a, "x"), (2, a, "x"), (2, a, "x"), (3, a + " end", "y"), (4, None, None), (5, "", "y"), (6, "one two", "y"), (7, "one two", None), (None, a, "x"), (8, " \t\n ", "z")]
    rows += [(10 + i, f"{text(rng, 12)}\n  {line if i % 2 else line.upper()}  \n{text(rng, 3)}", "xyz"[i % 3]) for i in range(12)]
    return [*rows, (99, " ".join([a] * 400), "x")]


def shingles(t):
    w = [x for x in "".join(c.lower() if c.isascii() else c for c in t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(docs, percent):
    sets = {i: shingles(t) for i, t in docs.items()}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and label[j] < label[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    label[i], changed = label[j], True
    return sets, label


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(1)
    rows, base = [], [text(rng, 70).split() for _ in range(3)]
    for i in range(150):  # copies with up to 14 words changed: links, chains of links and near misses
        w = list(base[i % 3])
        for _ in range(rng.randrange(15)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((i, " ".join(w), "x"))
    rows += [(200 + i, r[1], "x") for i, r in enumerate(rows[:20])]
    for percent in (85, 80):
        got = {r["doc_id"]: r for r in near_dedup.near_duplicates(table(spark, rows), percent).collect()}
        sets, label = brute_components({i: t for i, t, _ in rows}, percent)
        assert {i: r["component_id"] for i, r in got.items()} == label
        assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (label[i] == i) for i, r in got.items())


def test_pairs_across_components_are_found_whatever_the_leaders(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEADERS", 1)
    test_near_duplicates_against_brute_force(spark)


def test_superminhash_estimates_jaccard():
    rng = np.random.default_rng(2)
    both, one, two = (rng.integers(1, 2**63, n, dtype=np.uint64) for n in (300, 60, 60))
    a, b = np.unique(np.concatenate([both, one])), np.unique(np.concatenate([both, two]))
    s = near_dedup.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 512)
    assert abs((s[0] == s[1]).mean() - 300 / 420) < 0.08
    alone = near_dedup.signatures(a[:1], np.array([0, 1]), 64)[0]
    assert sorted(int(x) >> 48 for x in alone) == list(range(64))  # one element takes a place at each level


def test_near_duplicates_odd_rows(spark):
    got = near_dedup.near_duplicates(table(spark, odd_rows()), 85).collect()
    assert len(got) == len(odd_rows())
    by = {r["doc_id"]: r for r in got}
    assert by[2]["component_id"] == 1 and by[3]["component_id"] == 1 and by[7]["component_id"] == 6
    assert by[4]["n_shingles"] == by[5]["n_shingles"] == by[8]["n_shingles"] == 0 and by[4]["kept"] and by[5]["kept"]
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert near_dedup.near_duplicates(table(spark, [])).count() == 0


def line_oracle(rows, least=20, docs=3):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(set)
    for i, t, _ in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                held[key(x)].add(i)
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or len(key(x)) < least or len(held[key(x)]) < docs or max(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches", [1, 4, 9])
def test_line_dedup(spark, batches):
    rng = random.Random(batches)
    shared = [f"{text(rng, 4)} shared line {i}" for i in range(6)]
    rows = odd_rows() + [(1000 + i, "\n".join(rng.sample(shared, rng.randrange(5)) + [text(rng, 6)]), "x") for i in range(60)]
    got = line_dedup.deduped(table(spark, rows), batches=batches)
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()), key=str) == line_oracle(rows)
    assert line_dedup.deduped(table(spark, [])).count() == 0


def test_bpe_is_tiktoken(spark):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    odd = ["", None, " ", "a     b", "x" * 500, "%" * 2000, "ab" * 700, "a  \n b　   c", " \x85  z", "it's  we'll   \t\tx", "<|endoftext|>", "é" * 200]
    odd += ["".join(rng.choice(" \n\t ab1!é ") for _ in range(60)) for _ in range(100)] + ["".join(rng.choice("abcdefgh") for _ in range(900))]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    digest = lambda x: hashlib.sha256(x).hexdigest()
    for r in bpe.encode_digests(docs).collect():
        t = odd[r["doc_id"]] or ""
        ids = enc.encode_ordinary(t)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest(" ".join(map(str, ids)).encode()), digest(t.encode()))
    encoded = bpe.encode_texts(docs)
    assert {r["doc_id"]: bytes(r["bytes"]).decode() for r in bpe.decode_ids(encoded).collect()} == {i: t or "" for i, t in enumerate(odd)}
    assert all(r["ids"] == enc.encode_ordinary(odd[r["doc_id"]] or "") for r in encoded.collect())
    with pytest.raises(Exception, match="no token has the id"):
        bpe.decode_ids(spark.createDataFrame([(1, [60000])], "doc_id long, ids array<int>")).collect()


def vectors(spark, n=700, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16)).astype(np.float32)
    x[100:160] = x[100]  # ties
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(n, None, 1), (n + 20, [], 1), (n + 40, [0.0] * 16, 1), (n + 60, [float("nan")] * 16, 1), (n + 80, [None] * 16, 1), (n + 100, [float("inf")] * 16, 1), rows[40], (None, [1.0] * 16, 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int"), x.astype(float)


def brute(ids, x, k=20, zero=()):
    out = {}
    for q in [i for i in ids if i % 20 == 0]:
        s = x[list(ids)] @ x[q] if q < len(x) else np.zeros(len(ids))
        order = sorted(((-round(v, 12), i) for i, v in zip(ids, s, strict=True) if i != q))[:k]
        out[q] = [i for _, i in order]
    return out


def test_vp_tree(spark):
    df, x = vectors(spark)
    want = brute(list(range(700)), x)
    got = collections.defaultdict(list)
    for r in ann.neighbours(df, factor=1.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
        assert abs(r["score"] - x[r["query_id"]] @ x[r["vec_id"]]) < 1e-9
    assert got == want
    tree = ann.Tree(x, 1.25, leaf=32)  # the factor of the query
    q = np.arange(0, 700, 20)
    a, b = tree.search(q, np.arange(700), x[q], 20)
    found = collections.defaultdict(set)
    for i, j in zip(q[a], b, strict=True):
        found[i].add(j)
    assert np.mean([len(found[i] & set(want[i])) / 20 for i in q]) >= 0.9
    assert ann.neighbours(df.limit(0)).count() == 0
    few = ann.neighbours(df.where("vec_id < 5"))
    assert [r["vec_id"] for r in few.orderBy("rank").collect()] == sorted(range(1, 5), key=lambda i: -(x[0] @ x[i]))


def test_pivot_top_k(spark):
    df, x = vectors(spark)
    z = np.vstack([np.floor(64 * x), np.zeros((41, x.shape[1]))])
    ids = [*range(700), 740]
    want = {q: sorted(((-int(z[q] @ z[i]), i) for i in ids if i != q))[:20] for q in ids if q % 20 == 0}
    got = collections.defaultdict(list)
    for r in exact_topk.top_k(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((-r["score"], r["vec_id"]))
    assert got == want
    assert exact_topk.top_k(df.limit(0)).count() == 0


def test_pivots_eliminate():
    rng = np.random.default_rng(1)
    x = np.concatenate([np.floor(rng.normal(size=(300, 8)) * 4 + 200 * c) for c in np.eye(8)])
    t = exact_topk.PivotTable(x)
    q, c = t.search(np.arange(len(x)), np.arange(0, len(x), 50), x[::50], 5)
    s = x[::50] @ x.T
    s[np.arange(len(s)), np.arange(0, len(x), 50)] = -np.inf
    assert all({*c[q == i]} == {*np.flatnonzero(s[i] >= np.sort(s[i])[-5])} for i in range(len(s)))
    assert t.evaluated < 0.6 * s.size


def test_sharding(spark):
    rng = random.Random(6)
    rows = [(i, text(rng, rng.randrange(1, 60)), "x") for i in range(3000)] + [(5000 + i, "one text that a third of all rows hold " * 4, "x") for i in range(1500)] + [(None, None, None), (7, None, "x")]
    got = sharding.sharded(table(spark, rows)).collect()
    assert len(got) == len(rows)
    load, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(load) == set(range(8)) and max(load.values()) < 1.01 * sum(load.values()) / 8 and min(load.values()) > 0.95 * sum(load.values()) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by = {r["doc_id"]: r for r in got}
    t = rows[5][1]
    assert by[5]["size"] == len(t) + 1 and by[5]["text_crc32"] == zlib.crc32(t.encode()) and by[None]["size"] == 1 and by[None]["text_crc32"] is None
    assert sorted(got, key=str) == sorted(sharding.sharded(table(spark, rows).repartition(7)).collect(), key=str)
    assert sharding.sharded(table(spark, [])).count() == 0


def test_repeated_rows_are_dealt_over_all_shards(spark):
    rng = random.Random(16)
    for again in ((7, "one row that comes again and again"), (None, "one row that comes again and again"), (7, None)):
        rows = [(i, text(rng, rng.randrange(1, 60)), "x") for i in range(3000)] + [(*again, "x")] * 6000
        got = sharding.sharded(table(spark, rows).repartition(5)).collect()
        load, slots = collections.Counter(), collections.defaultdict(list)
        for r in got:
            load[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
        mean = sum(load.values()) / 8
        assert len(got) == 9000 and len(load) == 8 and max(load.values()) < 1.01 * mean and min(load.values()) > 0.98 * mean
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert sorted(map(str, got)) == sorted(map(str, sharding.sharded(table(spark, rows).repartition(3)).collect()))


def test_equal_texts_share_a_shard_where_it_has_room(spark):
    rng = random.Random(17)
    rows = [(i, text(rng, 20), "x") for i in range(4000)] + [(5000 + i, f"text {i % 200} held by five documents", "x") for i in range(1000)]
    shards = collections.defaultdict(set)
    for r in sharding.sharded(table(spark, rows)).collect():
        shards[r["text_crc32"]].add(r["shard"])
    assert sum(len(s) > 1 for s in shards.values()) <= 8


def test_rows_of_one_labelled_id_are_learned_from_once(spark):
    rows = [(1, f"one labelled text {i % 60} of an id") for i in range(50_000)] + [(i, f"text {i} " * 9) for i in range(2, 40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    seen, real = [], quality.BagModel.fit
    try:
        quality.BagModel.fit = lambda self, x, bounds, y, **k: seen.append(len(y)) or real(self, x, bounds, y, **k)
        quality.fitted(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), labels, sample=30)
    finally:
        quality.BagModel.fit = real
    assert 20 <= seen[0] <= 30


def test_ring_moves_few_keys():
    sizes = [(c, 0, 1) for c in range(sharding.CELLS)]
    a, b = (sharding.place_cells(sizes, n, 64, 0.3) for n in (8, 9))
    assert sum(a[k] != b[k] for k in a) < 0.35 * len(a)


def test_mixing_targets():
    t = mixing.targets([("a", 100), ("b", 1000), (None, 5), ("c", 300)])
    assert t[None] <= 15 and t["a"] <= 300 and abs(sum(t.values()) - 1405) < 1e-6
    assert t["c"] <= 900 and mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0.0}


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(i, text(rng, rng.randrange(1, 40)), rng.choice(["s1", "s2", "s3", None])) for i in range(2000)] + odd_rows()
    got = mixing.mixed(table(spark, rows)).collect()
    assert len(got) == len(rows) and got != [] and all(0 <= r["copies"] <= 3 for r in got)
    per = collections.defaultdict(lambda: [0, 0.0, 0, 0])
    for r in got:
        per[r["source"]][0] += r["size"] * r["copies"]
        per[r["source"]][1] = r["target"]
        per[r["source"]][2] = max(per[r["source"]][2], r["size"])
        per[r["source"]][3] += r["size"]
    want = mixing.targets([(s, v[3]) for s, v in per.items()])
    for s, (taken, target, largest, _) in per.items():
        assert abs(target - want[s]) < 1e-6 and abs(taken - target) <= largest
    assert sorted(got, key=str) == sorted(mixing.mixed(table(spark, rows).repartition(5)).collect(), key=str)
    assert mixing.mixed(table(spark, [])).count() == 0
    docs = table(spark, rows)
    mix = mixing.mixed_rows(docs)
    assert mix.columns == docs.columns and mix.count() == sum(r["copies"] for r in got)


def test_flight_keeps_totals():
    rng = random.Random(8)
    x, p = [float(rng.randrange(1, 900)) for _ in range(500)], [rng.random() for _ in range(500)]
    out = mixing.flight(p, x, (1,))
    assert sum(0 < v < 1 for v in out) <= 2 and abs(sum(out) - sum(p)) < 1e-6
    assert abs(sum(a * b for a, b in zip(out, x, strict=True)) - sum(a * b for a, b in zip(p, x, strict=True))) < 1e-3


def test_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r["doc_id"]: r["score"] for r in quality.scored(docs, labels).collect()}
    held = [(got[r["doc_id"]], r["quality"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and r["quality"] is not None]
    assert len(got) == docs.count() and np.mean([(s >= 0.5) == (q == 1) for s, q in held]) >= 0.97
    odd = table(spark, odd_rows())
    assert all(0 <= r["score"] <= 1 for r in quality.scored(odd, labels).collect())
    assert {r["score"] for r in quality.scored(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.scored(odd.limit(0), labels).count() == 0


def test_passages_whole_texts():
    x, bounds = quality.passages(pa.array([None, "", "a " * 1000, "  ", "x" * 9, "\n", "é ü"]))
    assert np.diff(bounds).tolist() == [1, 1, 16, 1, 1, 1, 1] and np.isfinite(x).all()


def test_gradients():
    rng = np.random.default_rng(0)
    m, x, bounds, y = quality.BagModel(), rng.normal(size=(9, quality.WIDTH)), np.array([0, 2, 3, 9]), np.array([1.0, 0, 1])
    loss = lambda: -np.mean(np.log(np.where(y == 1, (s := m._forward(x, bounds)["score"]), 1 - s)))
    grads = m._gradients(m._forward(x, bounds), y)
    for k, g in grads.items():
        i = tuple(rng.integers(0, n) for n in g.shape)
        m.p[k][i] += 1e-5
        up = loss()
        m.p[k][i] -= 2e-5
        assert abs((up - loss()) / 2e-5 - g[i]) < 1e-6
        m.p[k][i] += 1e-5


PAGE = '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">menu one</a></li><li><a>two</a></li></ul></nav><article><h1>The &amp; title</h1><p><b>First   words of it<br><p>A second paragraph\nwith &eacute; more words in it than the first<div class="ad">buy now at once</div><p>And a third paragraph of the story, the last</article><section class="comments"><p>I do not agree at all with what is said here</p></section><footer>&copy; all rights</footer>'


def test_html(spark):
    want = "The & title\nFirst words of it\nA second paragraph with é more words in it than the first\nAnd a third paragraph of the story, the last"
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, "t"), (3, "u", "", "t"), (None, "u", "<<<", "t"), (1, "u", PAGE, "t"), (4, "u", "<p>" + "word " * 200000, "t")], "page_id long, url string, html string, text string")
    got = html_extract.extracted(pages).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == 6 and by[1]["text"] == want and by[1]["n_chars"] == len(want) and by[2]["text"] == by[3]["text"] == "" and by[4]["n_chars"] == 999999
    assert html_extract.extracted(pages.limit(0)).count() == 0
    for deep in ("<div>" * 3000 + "word " * 50, "<p " * 5000, "<!-- never closed", "<script>never closed", "</p></div>" * 50):
        html_extract.extract(deep)


KEY = "of these tests"


def luhn(d):
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pii(spark):
    texts = ["a und.34@mail7.example.com x +1 (017) 555-7713 y 97.51.17.173 z 4111 1111 1111 1111 was", "DE89 3704 0044 0532 0130 00 and 123-45-6789 on 1990-02-28 and 31.12.1999", None, "", "clean 123456, version 3.0 of 300.1.2.3 on 1990-02-30, 4111111111111112", "again und.34@mail7.example.com und.34@mail7.example.com " + "word " * 30000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_replaced int")
    out = pii.pseudonymised(docs, KEY)
    got = [r["text"] for r in out.orderBy("doc_id").collect()]
    assert got[2:5] == texts[2:5] and [r["n_replaced"] for r in out.orderBy("doc_id").collect()] == [4, 4, 0, 0, 0, 2]
    for value in ("und.34@", "555-7713", "97.51.17.173", "4111 1111", "3704 0044", "123-45-6789", "1990-02-28", "31.12.1999"):
        assert not any(value in g for g in (got[0], got[1], got[5]))
    mail = got[0].split()[1]
    assert got[5].split()[1] == got[5].split()[2] == mail and mail.endswith("@mail7.example.com")
    card = "".join(got[0].split(" z ")[1].split()[:4])
    iban = got[1].split(" and ")[0].replace(" ", "")
    assert luhn(card) and len(card) == 16 and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert [r["text"] for r in pii.pseudonymised(out, KEY, undo=True).orderBy("doc_id").collect()] == texts
    assert pii.pseudonymised(docs.limit(0), KEY).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F

    rows = spark.range(1000).select(F.array((F.col("id") / 100).cast("int"), (F.col("id") / 10 % 10).cast("int"), (F.col("id") % 10).cast("int")).alias("v"))
    assert rows.select(pii.permuted(F.col("v"), F.array(*[F.lit(10)] * 3), F.lit("k")).alias("v")).distinct().count() == 1000


def test_screen_keeps_all_wanted(spark):
    rows, wanted = spark.range(5000), spark.range(0, 5000, 7)
    got = common.screened(rows, "id", wanted)
    assert got.join(wanted, "id", "left_semi").count() == wanted.count() and got.count() < 1000


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs, before = spark.read.parquet(f"{sf}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES:
        out = common.written(stage(spark, docs, sf), "stage")
        before, docs = docs, out
        assert 0 < out.count() <= 3 * before.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == before.columns
    assert out.columns == ["doc_id", "n_tokens", "ids"]
    empty = before.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_queries_and_oracles_name_each_other():
    assert set(queries.ORACLE) <= set(queries.QUERIES) and [q.split("_")[0] for q in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_long_secrets_are_replaced(spark):
    secret = "0123456789abcdef" * 8
    docs = spark.createDataFrame([(1, f"key {secret} end"), (2, secret[:96])], "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.pseudonymised(docs, KEY).collect()}
    assert out[1]["n_replaced"] == out[2]["n_replaced"] == 1 and secret not in out[1]["text"] and len(out[1]["text"]) == 136
    assert {r["text"] for r in pii.pseudonymised(pii.pseudonymised(docs, KEY), KEY, undo=True).collect()} == {f"key {secret} end", secret[:96]}


def test_unsettled_components_are_an_error(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError, match="not settled"):
        near_dedup.components(links, at_most=1)
    assert near_dedup.components(links).select("label").distinct().count() == 1


def test_later_links_unite_components(spark):
    schema = "a long, b long"
    tables = common.Tables(spark)
    labels = near_dedup._relabelled(None, spark.createDataFrame([(1, 2), (3, 4), (8, 9)], schema), tables)
    labels = near_dedup._relabelled(labels, spark.createDataFrame([(2, 4), (7, 9), (5, 6), (1, 2)], schema), tables)
    assert {r["node"]: r["label"] for r in labels.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 7, 8: 7, 9: 7}
    tables.drop(labels)
    assert labels.count() == 9 and len(tables.paths) == 1


def test_hub_rows_reach_members_of_all_levels(spark):
    members = spark.createDataFrame([(1, i, i % 3) for i in range(90)] + [(2, 5, 0)], "lid long, id long, level int")
    hubs = spark.createDataFrame([(1, "x"), (2, "y")], "lid long, mark string")
    got = near_dedup._to_members(members, hubs, members.select("lid", "level").distinct())
    assert sorted(map(tuple, got.select("lid", "id", "mark").collect())) == sorted((r["lid"], r["id"], "xy"[r["lid"] - 1]) for r in members.collect())


def twin_permuted(values, counts, tweak):
    """The Feistel network over numbers, in plain Python."""
    values = list(values)
    half = len(values) // 2
    for i in range(pii.ROUNDS):
        moves = [(p < half) == (i % 2 == 0) for p in range(len(values))]
        other = ",".join(str(x) for x, m in zip(values, moves, strict=True) if not m)
        for nth, p in enumerate(p for p, m in enumerate(moves) if m):
            key = hashlib.sha256("|".join((tweak, str(i), str(nth // 5), other)).encode()).hexdigest()
            values[p] = (values[p] + int(key[nth % 5 * 12 :][:12], 16)) % counts[p]
    return values


def twin_digits(digits, tweak):
    return "".join(map(str, twin_permuted(map(int, digits), [10] * len(digits), tweak)))


def twin_spaced(like, plain):
    it = iter(plain)
    return "".join(next(it) if c.isalnum() else c for c in like)


def twin_characters(chars, tweak, letters=26):
    """Letters and digits permuted in their kinds, other characters kept."""
    kinds = [next(((a, n) for a, n in (("0", 10), ("A", letters), ("a", letters)) if 0 <= ord(c) - ord(a) < n), (c, 1)) for c in chars]
    moved = twin_permuted([ord(c) - ord(a) for c, (a, _) in zip(chars, kinds, strict=True)], [n for _, n in kinds], tweak)
    return "".join(chr(ord(a) + x) for x, (a, _) in zip(moved, kinds, strict=True))


def twin_date(m, tweak):
    """A day's place in its block of 28 years, as 21 rows of 487 days, permuted."""
    year_first, mark = m[4] in "-/.", m[4] if m[4] in "-/." else m[2]
    a, b, c = m.split(mark)
    orders = ["ymd"] if year_first else ["dmy", "mdy"]
    for order in orders:
        part = dict(zip(order, (a, b, c), strict=True))
        try:
            day = datetime.date(int(part["y"]), int(part["m"]), int(part["d"]))
        except ValueError:
            continue
        start = datetime.date(day.year - (day.year - 1904) % 28, 1, 1)
        nr = (day - start).days
        x, y = twin_permuted([nr // 487, nr % 487], [21, 487], f"{tweak}|{start}")
        new = start + datetime.timedelta(days=x * 487 + y)
        return mark.join({"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}[k] for k in order)
    return m


def mod97(x):
    return int("".join(str(int(c, 36)) for c in x)) % 97


def twin(kind, m):
    """The pseudonym of a valid value of a kind, by brute force."""
    if kind == "email":
        name, host = m.split("@")
        return f"{twin_characters(name, f'{KEY}|email|@{host}')}@{host}"
    if kind == "secret":
        return twin_characters(m, f"{KEY}|secret", 6)
    if kind == "iban":
        land, bank = m[:2], twin_characters(m.replace(" ", "")[4:], f"{KEY}|iban")
        return twin_spaced(m, f"{land}{98 - mod97(bank + land + '00'):02d}{bank}")
    if kind == "date":
        return twin_date(m, f"{KEY}|date")
    digits, tweak = "".join(c for c in m if c.isdigit()), f"{KEY}|{kind}"
    if kind == "ssn":
        valid = [[a for a in range(1, 900) if a != 666], list(range(1, 100)), list(range(1, 10000))]
        parts = [v.index(int(x)) for v, x in zip(valid, m.split("-"), strict=True)]
        a, g, n = (v[i] for v, i in zip(valid, twin_permuted(parts, [len(v) for v in valid], tweak), strict=True))
        return f"{a:03d}-{g:02d}-{n:04d}"
    if kind == "card":
        body = twin_digits(digits[:-1], tweak)
        return twin_spaced(m, next(body + c for c in "0123456789" if luhn(body + c)))
    if kind == "ip":
        return ".".join(map(str, twin_permuted(map(int, m.split(".")), [256] * 4, tweak)))
    code = {"+49": "49", "+1 ": "1", "+35": "353"}.get(m[:3], "")
    return twin_spaced(m, code + twin_digits(digits[len(code) :], f"{tweak}|{code}"))


def test_pii_against_a_plain_twin(spark):
    rng = random.Random(12)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    values = [("ssn", f"{rng.choice([a for a in range(1, 900) if a != 666]):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}") for _ in range(500)]
    for _ in range(25):
        card = number(15)
        card = next(card + c for c in "0123456789" if luhn(card + c))
        values += [("card", card), ("card", " ".join(card[i : i + 4] for i in range(0, 16, 4))), ("ip", ".".join(str(rng.randrange(256)) for _ in range(4)))]
        n = number(9)
        values += [("phone", f"+49 {n[:2]} {n[2:6]} {n[6:]}"), ("phone", f"+49{n}"), ("phone", f"+1 ({n[:3]}) {n[3:6]}-{number(4)}"), ("phone", f"+353 {n[:2]} {n[2:5]} {n[5:]}")]
        values += [("email", rng.choice(["ann.Lee-7", "x", "A" * 40 + "9" * 20, "q_1+z%2"]) + number(2) + "@mail.example.org"), ("secret", "".join(rng.choice("0123456789abcdefABCDEF") for _ in range(rng.choice([32, 40, 64, 65, 128]))) + "0a")]
        day = datetime.date(1904, 1, 1) + datetime.timedelta(days=rng.randrange(71_000))
        values += [("date", day.isoformat()), ("date", day.strftime("%d.%m.%Y")), ("date", day.strftime("%m/%d/%Y"))]
        bank = "".join(rng.choice("0123456789ABCXYZ") for _ in range(16)) + number(2)
        account = f"DE{98 - mod97(bank + 'DE00'):02d}{bank}"
        values += [("iban", account), ("iban", " ".join(account[i : i + 4] for i in range(0, 22, 4)))]
    docs = spark.createDataFrame([(i, f"was {v} there") for i, (_, v) in enumerate(values)], "doc_id long, text string")
    out = pii.pseudonymised(docs, KEY)
    got = [r["text"][4:-6] for r in out.orderBy("doc_id").collect()]
    assert got == [twin(*v) for v in values]
    ssns = [g for g, (k, _) in zip(got, values, strict=True) if k == "ssn"]
    assert not [x for x in ssns if x[:3] in ("000", "666") or x[0] == "9" or x[4:6] == "00" or x[7:] == "0000"]
    back = [r["text"][4:-6] for r in pii.pseudonymised(out, KEY, undo=True).orderBy("doc_id").collect()]
    assert all(b == v for b, (_, v) in zip(back, values, strict=True) if "/" not in v)  # month first, its pseudonym may read day first
    phones = [g for g, (k, v) in zip(got, values, strict=True) if k == "phone" and v.startswith("+49")]
    assert all(a.replace(" ", "") == b for a, b in zip(phones[::2], phones[1::2], strict=True))
    with pytest.raises(ValueError, match="key"):
        pii.pseudonymised(docs, "")


def test_no_two_places_of_a_half_move_alike(spark):
    """Differences of places 15 apart, and of all others of a half, are not kept."""
    from pyspark.sql import functions as F

    rows = spark.range(400).select(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: (F.xxhash64(p, "id") % 5 + 5).cast("int")).alias("v"))
    got = rows.select("v", pii.permuted(F.col("v"), F.array_repeat(F.lit(10), 64), F.lit("k")).alias("w")).collect()
    v, w = (np.array([r[c] for r in got]) for c in "vw")
    moved = (w - v) % 10
    for half in (moved[:, :32], moved[:, 32:]):
        same = (half[:, :, None] == half[:, None, :]).mean(axis=0)
        assert same[~np.eye(32, dtype=bool)].max() < 0.2
    assert abs(np.bincount(moved.ravel(), minlength=10) / moved.size - 0.1).max() < 0.01


def test_no_plan_shows_the_key(spark):
    docs = spark.createDataFrame([(1, "x a1@b.example.com 1990-02-28")], "doc_id long, text string")
    out = pii.pseudonymised(docs, "hide this key of mine")
    out.collect()
    execution = out._jdf.queryExecution()
    assert not any("hide this key" in str(x) for x in (execution.toString(), execution.executedPlan().toString(), execution.analyzed().toString(), execution.optimizedPlan().toJSON()))


def test_columns_of_an_operators_names_are_kept(spark):
    docs = spark.createDataFrame([(1, "a b", 9, 8, 7, 6, 5)], "doc_id long, text string, score int, n_lines int, n_dropped int, n_replaced int, score_in int")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    scored = quality.scored(docs, labels).first()
    assert (scored["score_in_"], scored["score_in"]) == (9, 5) and scored["score"] != 9
    lines = line_dedup.deduped(docs).first()
    assert (lines["n_lines"], lines["n_lines_in"], lines["n_dropped"], lines["n_dropped_in"]) == (1, 8, 0, 7)
    assert (lambda r: (r["n_replaced"], r["n_replaced_in"]))(pii.pseudonymised(docs, KEY).first()) == (0, 6)


def test_whole_words_are_hashed():
    long = "x" * 300
    texts = ["internationalx", "internatqwertz", long + "a", long + "b", "a" * 64, "a" * 63 + "b"]
    x, _ = quality.passages(pa.array(texts))
    body = np.frombuffer("".join(texts).encode(), np.uint8)
    sizes = np.array([len(t) for t in texts])
    assert len(set(quality.word_hashes(body, np.append(0, np.cumsum(sizes))[:-1], sizes).tolist())) == 6 and x.shape == (6, quality.WIDTH)


def test_lines_of_long_texts(spark):
    import time

    def took(n):
        body = "\n".join(f"this is a line that three texts share {i}" for i in range(n))
        docs = spark.createDataFrame([(i, body + f"\nown {i}") for i in range(3)], "doc_id long, text string").repartition(1)
        began = time.perf_counter()
        assert [r["n_dropped"] for r in line_dedup.deduped(docs, batches=1).orderBy("doc_id").collect()] == [n, n, 0]
        return time.perf_counter() - began

    took(1000)
    assert took(40000) < 5 * took(8000) + 2


def test_trees_take_ties(spark):
    for x in (np.eye(2000), np.ones((3000, 4))):
        ids = np.arange(len(x))
        tree = ann.Tree(x)
        q, c = tree.search(ids[:5], ids, x[:5], 20)
        assert len(set(zip(q.tolist(), c.tolist()))) >= 100
    rows = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(500)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.neighbours(rows).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert got == {q: [i for i in range(21) if i != q][:20] for q in range(0, 500, 20)}


def test_recall_of_the_query_on_embeddings(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = collections.defaultdict(set)
    for r in queries.op3_vp_tree_neighbours(spark, sf).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(got[ids[q]] & set(ids[np.argsort(-s)[:20]].tolist())) / 20)
    assert np.mean(hits) >= 0.9 and len(got) == len(hits)


def test_mixing_rows_that_repeat(spark):
    rows = [(7, "one text that all rows have", "s1")] * 900 + [(None, "another " * 3, "s2")] * 300 + [(i, "word " * (i % 9), "s2") for i in range(200)]
    docs = table(spark, rows)
    got = sorted(map(str, mixing.mixed(docs).collect()))
    assert got == sorted(map(str, mixing.mixed(docs.repartition(7)).collect()))
    numbers = common.numbered(docs.select("doc_id", "source").repartition(5), ["doc_id", "source"], "nr").collect()
    by = collections.defaultdict(list)
    for r in numbers:
        by[r["doc_id"], r["source"]].append(r["nr"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    mix = mixing.mixed_rows(docs)
    assert mix.columns == docs.columns and sorted(map(str, mix.collect())) == sorted(map(str, mixing.mixed_rows(docs.repartition(3)).collect()))


def test_shared_folder_of_a_cluster_must_be_named(spark):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint.dir"):
        common.shared_folder(Session())


A = "Harvest began early on the hills above the lake, and every barn in the valley was full before the end of August."
B = "Old people said that such a summer had come only twice before, and both times a hard winter had followed it."
C = "The council has now asked the farms to keep a third of their grain until the spring, whatever the traders offer."
MENU = "<ul><li><a href='/1'>Start</a></li><li><a href='/2'>Shop</a></li><li><a href='/3'>Team</a></li></ul>"
LAYOUTS = {
    "article with an advert": (f"<body><nav>{MENU}</nav><article><h1>Harvest</h1><p>{A}</p><div class='advert'>Cheap tools, order today and save</div><p>{B}</p><p>{C}</p></article><footer>All rights reserved</footer></body>", f"Harvest\n{A}\n{B}\n{C}"),
    "main and sections": (f"<body><header><div class='logo'>Lake News</div><nav>{MENU}</nav></header><main><section><h2>Harvest</h2><p>{A}</p></section><section><p>{B}</p><p>{C}</p></section></main><footer><p>Imprint</p></footer></body>", f"Harvest\n{A}\n{B}\n{C}"),
    "divs with ids": (f"<body><div id='navigation'>{MENU}</div><div id='main'><h1>Harvest</h1><p>{A}</p><p>{B}</p></div><div id='sidebar'><p>Follow us on all our channels</p></div><div id='footer'>Imprint</div></body>", f"Harvest\n{A}\n{B}"),
    "classes without meaning": (f"<body><div class='a1'>{MENU}</div><div class='b2'><h1>Harvest</h1><p>{A}</p><p>{B}</p><p>{C}</p></div></body>", f"Harvest\n{A}\n{B}\n{C}"),
    "header in the article": (f"<body><nav>{MENU}</nav><article><header><h1>Harvest</h1><p class='header'>{C}</p></header><p>{A}</p><p>{B}</p></article></body>", f"Harvest\n{C}\n{A}\n{B}"),
    "a formula": (f"<body><main><p>{A}</p><p>Yield is <math><mi>x</mi></math> by field.</p><p>{B}</p></main></body>", f"{A}\nYield is x by field.\n{B}"),
    "reader comments": (f"<body><article><h1>Harvest</h1><p>{A}</p><p>{B}</p></article><section id='comments'><h3>Comments</h3><div class='comment'><p>{C}</p></div></section></body>", f"Harvest\n{A}\n{B}"),
    "a form between": (f"<body><article><p>{A}</p><form><p>Write to us if you know more about it</p><input><button>Send</button></form><p>{B}</p><p>{C}</p></article></body>", f"{A}\n{B}\n{C}"),
    "a notice on top": (f"<body><div class='cookie notice'><p>We use cookies to make this site better for all of you</p></div><div class='content'><h1>Harvest</h1><p>{A}</p><p>{B}</p></div></body>", f"Harvest\n{A}\n{B}"),
    "lists and a table": (f"<body><aside>{MENU}</aside><article><p>{A}</p><ul><li>{B}</li></ul><table><tr><td>Barley</td><td>{C}</td></tr></table></article><footer>Imprint</footer></body>", f"{A}\n{B}\nBarley\n{C}"),
    "unclosed paragraphs": (f"<body><nav>{MENU}</nav><article><h1>Harvest<p>{A}<p>{B}<p>{C}</article><footer>Imprint</footer>", f"Harvest\n{A}\n{B}\n{C}"),
    "plain text": (f"{A} {B}", f"{A} {B}"),
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_html_layouts(layout):
    page, want = LAYOUTS[layout]
    assert html_extract.extract(page) == want


def test_best_region_against_brute_force():
    rng = random.Random(13)
    for _ in range(300):
        scores = [rng.randrange(-6, 6) + rng.random() for _ in range(rng.randrange(25))]
        a, b = html_extract.best_region(scores)
        best = max([0.0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])
        assert abs(sum(scores[a:b]) - best) < 1e-9


@pytest.mark.parametrize("page", [lambda n: "<b>" * n + "</i>" * n, lambda n: "<div><span>" * n, lambda n: "<b>" * n + "<p>x" * n, lambda n: "".join(f"<div class=c{i}>" for i in range(2 * n))])
def test_html_takes_linear_time(page):
    """Four times the page takes less than six times the time, whatever the machine's speed."""
    import time

    def least(n):
        took = []
        for _ in range(3):
            began = time.process_time()
            html_extract.extract(page(n))
            took.append(time.process_time() - began)
        return min(took)

    small = least(10_000)
    assert least(40_000) < 6 * small + 0.05


def test_bpe_odd_rows(spark):
    docs = table(spark, [(None, "a b", "x"), (1, None, "x"), (2, "", "x"), (3, "same", "x"), (3, "same", "x")])
    out = bpe.encode_texts(docs)
    assert out.columns == ["doc_id", "n_tokens", "ids"] and sorted((r["doc_id"] or 0, r["n_tokens"]) for r in out.collect()) == [(0, 2), (1, 0), (2, 0), (3, 1), (3, 1)]
    assert sorted((r["doc_id"] or 0, bytes(r["bytes"])) for r in bpe.decode_ids(out).collect()) == [(0, b"a b"), (1, b""), (2, b""), (3, b"same"), (3, b"same")]
    empty = docs.limit(0)
    assert bpe.encode_digests(empty).count() == bpe.encode_texts(empty).count() == bpe.decode_ids(out.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, None)], "doc_id long, ids array<int>")
    assert [bytes(r["bytes"]) for r in bpe.decode_ids(nulls).collect()] == [b""]


def test_words_known_from_a_slice_before_are_not_encoded_again(monkeypatch):
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abc": 257}
    codec = bpe.Codec(ranks, r"\w+|\W+")
    monkeypatch.setattr(bpe, "KNOWN", 3)
    encode, seen = codec._encode, []
    monkeypatch.setattr(codec, "_encode", lambda words: (seen.extend(words), encode(words))[1])
    for words in (["abc", "", "ab", "abcab", "é"], ["é", "abc", "abcab", "z" * 60], []):
        n, ids, decoded = codec.pieces(words)
        assert decoded.to_pylist() == [w.encode() for w in words]
        assert [len(x.split()) for x in ids.to_pylist()] == n.tolist()
    assert seen == [b"abc", b"", b"ab", b"abcab", "é".encode(), "é".encode(), b"abcab", b"z" * 60]


def test_words_are_encoded_some_at_a_time_and_decoded_only_if_wanted(monkeypatch):
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abc": 257}
    codec = bpe.Codec(ranks, r"\w+|\W+")
    monkeypatch.setattr(bpe, "WORDS", 2)
    monkeypatch.setattr(bpe, "CHUNKS", 2)
    encode, sizes = codec._encode, []
    monkeypatch.setattr(codec, "_encode", lambda words: (sizes.append(len(words)), encode(words))[1])
    n, ids, decoded = codec.pieces(["abc", "ab", "x" * 60, "abca", ""])
    assert sizes == [2, 2, 1] and n.tolist() == [1, 1, 60, 2, 0]
    assert decoded.to_pylist() == [b"abc", b"ab", b"x" * 60, b"abca", b""]
    monkeypatch.setattr(bpe, "DECODE", "not to be run")
    texts = pa.array(["abc ab abca", None, "", "ab  abc ab", "abc"])
    for _ in range(2):  # the second time from the words known
        coded = bpe._Coded(codec, texts, False)
        assert coded.listed().to_pylist() == [[257, 32, 256, 32, 257, 97], [], [], [256, 32, 32, 257, 32, 256], [257]]
        assert coded.count.tolist() == [6, 0, 0, 6, 1]


def test_pipeline_gives_heap_back_before_it_encodes(spark):
    beans = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName())
    before = beans()
    corpus_pipeline.encode(spark, spark.createDataFrame([(1, "a b")], "doc_id long, text string"), "")
    assert beans() > before
