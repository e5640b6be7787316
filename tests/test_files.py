"""Digests of files by ranges and whole, trees of them, and run records that are there whole or not at all."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from storyloom.sources import corpus, files

MIB = 1 << 20
SCHEMA = "run_id string, commit_txt string, matrix string, timings string, config string"


def plain_root(data, fan):
    level = [hashlib.sha256(b"\0" + data[i : i + MIB]).hexdigest() for i in range(0, len(data), MIB)]
    while len(level) > 1:
        level = [hashlib.sha256(("\1" + "".join(level[i : i + fan])).encode()).hexdigest() for i in range(0, len(level), fan)]
    return level[0]


def test_digests_of_files(spark, tmp_path):
    rng = random.Random(1)
    (tmp_path / "deep" / "er").mkdir(parents=True)
    data = {"a": b"", "b": b"x", "deep/c é": rng.randbytes(MIB), "deep/er/d": rng.randbytes(5 * MIB + 7), "z": rng.randbytes(2 * MIB)}
    for name, body in data.items():
        (tmp_path / name).write_bytes(body)
    hashes = files.file_hashes(spark, str(tmp_path))
    want = {str(tmp_path / k): (hashlib.sha256(v).hexdigest(), len(v)) for k, v in data.items()}
    assert {r["path"]: (r["sha256"], r["length"]) for r in hashes.collect()} == want
    assert {r["path"]: r["length"] for r in files.file_hashes(spark, str(tmp_path / "b")).collect()} == {str(tmp_path / "b"): 1}
    text = "".join(f"{p}\0{h}\n" for p, (h, _) in sorted(want.items()))
    r = files.tree_digest(hashes).first()
    assert (r["digest"], r["n_files"]) == (hashlib.sha256(text.encode()).hexdigest(), 5)
    for fan in (2, 3, 1024):
        roots = files.merkle_roots(files.chunk_hashes(spark, str(tmp_path), 2 * MIB), fan).collect()
        assert {r["path"]: r["root"] for r in roots} == {str(tmp_path / k): plain_root(v, fan) for k, v in data.items() if v}
    (tmp_path / "none").mkdir()
    assert files.file_hashes(spark, str(tmp_path / "none")).count() == 0
    empty = hashes.limit(0)
    assert (files.tree_digest(empty).first()["n_files"], files.merkle_roots(files.chunk_hashes(spark, str(tmp_path / "a"))).count()) == (0, 0)


def test_many_tasks_read_one_file_of_over_2_gb(spark, tmp_path):
    with open(tmp_path / "big", "wb") as f:
        f.truncate((2 << 30) + 5 * MIB + 3)
        f.seek((2 << 30) + MIB)
        f.write(b"here")
    chunks = files.chunk_hashes(spark, str(tmp_path), 256 * MIB)
    assert chunks.rdd.getNumPartitions() == 9
    assert chunks.agg(F.count("*").alias("n"), F.countDistinct("hash").alias("k"), F.max("nr").alias("m")).first() == (2054, 3, 2053)
    whole = files.file_hashes(spark, str(tmp_path)).first()
    digest = hashlib.sha256()
    with open(tmp_path / "big", "rb") as f:
        while block := f.read(1 << 24):
            digest.update(block)
    assert (whole["sha256"], whole["length"]) == (digest.hexdigest(), (2 << 30) + 5 * MIB + 3)


def test_a_file_that_shrinks_is_an_error(tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 100)
    with pytest.raises(OSError, match="ended"):
        list(files._blocks(files.opened(str(tmp_path))[0], str(tmp_path / "a"), 0, 101))


def test_trees_of_files_tell_what_differs(spark):
    rows = [(f"dir/{i}", hashlib.sha256(str(i).encode()).hexdigest()) for i in range(3000)]
    table = lambda r: spark.createDataFrame(r, "path string, sha256 string")
    one = files.tree_levels(table(rows)).cache()
    again = files.tree_levels(table(rows[::-1]).repartition(7))
    root = lambda t: t.where("prefix = ''").select("digest", "n_files").first()
    assert root(one) == root(again) and root(one)["n_files"] == 3000
    changed = files.tree_levels(table([*rows[:-1], (rows[-1][0], "0" * 64)]))
    assert root(changed)["digest"] != root(one)["digest"]
    leaf = hashlib.sha256(rows[-1][0].encode()).hexdigest()[: files.DIGITS]
    assert [r["prefix"] for r in files.differing(one, changed).collect()] == [leaf]
    assert one.groupBy("prefix").count().where("count > 1").count() == 0


def record(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def seen(tmp_path):
    return {f"{r}/{f}".removeprefix(f"{tmp_path}/"): open(os.path.join(r, f)).read() for r, _, fs in os.walk(tmp_path) for f in fs}


def test_records_are_moved_into_place(spark, tmp_path):
    many = [(f"A_s{i}", "commit: 1\n", None, json.dumps({"gpu_hours": i}), "{}") for i in range(40)]
    files.write_run_record(record(spark, many).repartition(5), str(tmp_path))
    assert len(seen(tmp_path)) == 120 and seen(tmp_path)["A_s7/timings.json"] == '{"gpu_hours": 7}'
    (tmp_path / "A_s3" / ".timings.json.left.new").write_text("of a killed task")
    files.write_run_record(record(spark, [("A_s3", "commit: é\n", "[]", None, None)]), str(tmp_path))
    now = seen(tmp_path)
    assert len(now) == 121 and now["A_s3/commit.txt"] == "commit: é\n" and now["A_s3/timings.json"] == '{"gpu_hours": 3}' and now["A_s3/matrix.json"] == "[]"
    assert corpus.run_folders(spark, str(tmp_path)).count() == 40
    files.write_run_record(record(spark, []), str(tmp_path))
    assert seen(tmp_path) == now


@pytest.mark.parametrize("how", ["raises", "killed", "twice", "outside"])
def test_records_of_a_failed_write_are_not_seen(spark, tmp_path, how):
    files.write_run_record(record(spark, [("A", "old", "old", "old", "old"), ("B", "old", None, None, None)]), str(tmp_path))
    before = seen(tmp_path)

    @F.udf("string")
    def breaks(run):
        if run == "B" and how == "raises":
            raise ValueError("no more")
        if run == "B" and how == "killed":
            os._exit(1)
        return "new"

    rows = [("A", "new", "new", None, None), ("B", "new", "new", None, None)]
    rows += {"twice": [("A", "again", None, None, None)], "outside": [("../C", "x", None, None, None)]}.get(how, [])
    fresh = record(spark, rows).repartitionByRange(2, "run_id").withColumn("matrix", breaks("run_id"))
    with pytest.raises(Exception):  # noqa: B017, PT011
        files.write_run_record(fresh, str(tmp_path))
    shown = {k: v for k, v in seen(tmp_path).items() if "/." not in k}
    assert shown == before
    files.write_run_record(record(spark, [("A", "last", None, None, None), ("B", "last", None, None, None)]), str(tmp_path))
    after = seen(tmp_path)
    assert not [k for k in after if k.endswith(".new")] and after["A/commit.txt"] == after["B/commit.txt"] == "last" and after["A/matrix.json"] == "old"
