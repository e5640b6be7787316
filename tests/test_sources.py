"""Line numbers over splits, JSON leaves of any depth and number."""

import json
import random

import pytest
from pyspark.sql import functions as F

from storyloom.functions import leaves
from storyloom.operators import guard
from storyloom.sources import corpus


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}
    was = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in was.items():
        spark.conf.set(k, v)


def plain_lines(data: bytes):
    """Lines parted by CRLF, CR or LF; what follows the last end is no line if it is empty."""
    text = data.replace(b"\r\n", b"\n").replace(b"\r", b"\n").decode()
    lines = text.split("\n")
    return lines[:-1] if lines[-1] == "" else lines


def test_line_numbers_over_splits(small_splits, tmp_path):
    spark, rng = small_splits, random.Random(3)
    want = {}
    for k in range(6):
        rows = ["".join(rng.choice("ab é ") for _ in range(rng.choice([0, 0, 1, 7, 62, 63, 64, 65, 200]))) for _ in range(60)]
        ends = [rng.choice([b"\n", b"\r", b"\r\n"]) for _ in rows]
        data = (b"\xef\xbb\xbf" if k == 3 else b"") + b"".join(r.encode() + e for r, e in zip(rows, ends)) + (b"last" if k % 2 else b"")
        path = tmp_path / f"a file+{k}_phase_{k}.jsonl"
        path.write_bytes(data)
        want[k] = [(i, line) for i, line in enumerate(plain_lines(data), 1)]
    files = sorted(str(p) for p in tmp_path.iterdir())
    lines = corpus.numbered_lines(spark, files)
    assert lines.rdd.getNumPartitions() > 50
    got = {}
    for r in lines.select(corpus.phase_of(F.col("path")).alias("k"), "lineno", "line").collect():
        got.setdefault(r["k"], []).append((r["lineno"], r["line"]))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_every_edge_of_a_split(small_splits, tmp_path):
    """A line's end, of one byte or two, on, before and behind each edge."""
    for n in range(58, 72):
        for end in (b"\n", b"\r", b"\r\n"):
            data = b"x" * n + end + b"y" + end + end + b"z" * 70 + end
            path = tmp_path / f"{n}{end.hex()}.txt"
            path.write_bytes(data)
            got = sorted((r["lineno"], r["line"]) for r in corpus.numbered_lines(small_splits, [str(path)]).collect())
            assert got == list(enumerate(plain_lines(data), 1)), (n, end)


def test_counts_of_many_splits_are_joined_by_a_shuffle(small_splits, tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_bytes(b"one line of it\n" * 500)
    monkeypatch.setattr(corpus, "MOST_SPLITS", 3)
    lines = corpus.numbered_lines(small_splits, [str(tmp_path / "a.txt")])
    assert sorted(r["lineno"] for r in lines.collect()) == list(range(1, 501))


def test_stories_of_several_files_in_splits(small_splits, tmp_path):
    for k in (0, 2):
        rows = [json.dumps({"prompt_hash": f"{k}-{i}", "phase": k, "story": "once " * i, "split": "train", "model": "m"}) for i in range(30)]
        (tmp_path / f"train_phase_{k}.jsonl").write_text("\n\n".join(rows) + "\nno json\n")
    got = sorted((r["phase"], r["lineno"], r["id"]) for r in corpus.stories(small_splits, str(tmp_path)).where("corrupt is null").collect())
    assert got == [(k, 2 * i + 1, f"{k}-{i}") for k in (0, 2) for i in range(30)]
    assert [r["lineno"] for r in corpus.stories(small_splits, str(tmp_path)).where("corrupt is not null").collect()] == [60, 60]


def plain_strings(value, at="$"):
    if isinstance(value, str):
        return [(at, value)]
    inner = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    return [x for k, v in inner for x in plain_strings(v, f"{at}.{k}")]


def some_json(rng, depth):
    kind = rng.randrange(7 if depth else 5)
    if kind < 5:
        return [rng.choice(["", "a", 'q"\\\n', "é🎈"]), 3.5, None, True, -2][kind]
    inner = [some_json(rng, depth - 1) for _ in range(rng.randrange(4))]
    return inner if kind == 5 else {rng.choice(["k", "é", 'a"b', "x.y"]) + str(i): v for i, v in enumerate(inner)}


def test_json_strings_are_those_of_a_plain_walk(spark):
    rng = random.Random(6)
    docs = [json.dumps(some_json(rng, 5), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for _ in range(400)]
    bad = ["", "{", "[1,]", '{"a" 1}', "nul", '"a" "b"', "[1] x", '{"a": "b",}', "plain words"]
    rows = list(enumerate(docs + bad)) + [(0, docs[0]), (None, '["x"]'), (1000, None)]
    got = {}
    for r in leaves.json_strings(spark.createDataFrame(rows, "id long, j string"), "id", "j").collect():
        got.setdefault(r["entity"], []).append((r["location"], r["value"], r["is_json"]))
    for i, d in enumerate(docs):
        assert got.get(str(i), []) == [(*x, True) for x in plain_strings(json.loads(d))] * (2 if i == 0 else 1)
    assert [got[str(len(docs) + k)] for k in range(len(bad))] == [[("text", b, False)] for b in bad]
    assert None in got and "1000" not in got


def test_deep_reader_equals_pythons():
    rng = random.Random(7)
    good = [json.dumps(some_json(rng, 6)) for _ in range(500)] + [" [ ] ", '{"a":1,"a":"b"}', "NaN", "-Infinity", "[1e5,-0.5]"]
    for d in good:
        assert list(leaves.strings(leaves._deep(d))) == list(leaves.strings(json.loads(d)))
    cut = [d[:k] + d[k + 1 :] for d in good for k in [rng.randrange(len(d))]] + ["01", "[1,,2]", "{,}", "[,]", "[}", "{]", '{"a":}', "]", ""]
    for d in cut:
        try:
            want = list(leaves.strings(json.loads(d)))
        except ValueError:
            with pytest.raises(ValueError):
                leaves._deep(d)
        else:
            assert list(leaves.strings(leaves._deep(d))) == want


def test_leaves_have_no_limit_of_depth_or_number(spark):
    deep = [(n, "[" * n + '"leaf"' + "]" * n) for n in (1, 500, 100_000)] + [(7, '{"a":' * 30_000 + '"leaf"' + "}" * 30_000)]
    got = guard.json_leaves(spark.createDataFrame(deep, "id long, j string"), "id", "j").select("entity", "value", F.length("location").alias("n"))
    assert {(r["entity"], r["value"], r["n"]) for r in got.collect()} == {("1", "leaf", 3), ("500", "leaf", 1001), ("100000", "leaf", 200001), ("7", "leaf", 60001)}
    many = spark.range(1_200_000).select("id", F.concat(F.lit('{"k": ["s'), F.col("id") % 97, F.lit('", 3]}')).alias("j"))
    counts = guard.json_leaves(many, "id", "j").groupBy("value").count().collect()
    assert len(counts) == 97 and sum(r["count"] for r in counts) == 1_200_000


def test_halves_of_surrogates_and_wide_documents(spark):
    wide = json.dumps({"all": [f"s{i}" for i in range(50_000)]})
    rows = spark.createDataFrame([(1, '["\\ud800x"]'), (2, wide)], "id long, j string")
    got = guard.json_leaves(rows, "id", "j").groupBy("entity").agg(F.count("*").alias("n"), F.min("value").alias("least")).collect()
    assert {(r["entity"], r["n"], r["least"]) for r in got} == {("1", 1, "?x"), ("2", 50_000, "s0")}
