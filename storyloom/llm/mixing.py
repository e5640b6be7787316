"""Mixing sources to target weights by cube-method balanced sampling.

A source's target is its share by weight of all words, not more than `most` times its own words; what is over is shared
again by weight. With r the ratio of target to words, each document is taken floor(r) times and once more with probability
r - floor(r). The cube method draws these: probabilities move along the null space of the balancing constraints (sum of
probabilities, sum of probabilities times words) until one of the units at hand is 0 or 1, so both totals keep their values.
Units are split into bounded chunks, chunks leave two fractional units each, and these go up a tree of flights. The
last two of a source land on the choice nearest to its target.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import Tables, ascii_words, numbered, shipped

#: Units of a chunk, about; smaller than this a probability counts as 0, nearer than this to 1 as 1; sources of a mix at most.
CHUNK, TINY, MOST_SOURCES = 4000, 1e-9, 100_000
CYCLE = (1, 2, 3)


def targets(sizes: list[tuple[str | None, int]], most: float = 3, cycle: tuple[float, ...] = CYCLE) -> dict[str | None, float]:
    """Target of each source; sources are weighted by the cycle in code point order, null last."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: cycle[i % len(cycle)] for i, (s, _) in enumerate(order)}
    left, open_, out = float(sum(n for _, n in order)), dict(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = [s for s, n in open_.items() if share[s] > most * n]
        if not over:
            return out | share
        for s in over:
            out[s] = most * open_.pop(s)
            left -= out[s]
    return out


def _draw(*key: object) -> float:
    return (int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=8).digest()) + 0.5) / 2.0**64


def flight(p: list[float], x: list[float], seed: tuple) -> list[float]:
    """The flight phase for the constraints sum(p) and sum(p * x): all but two of the probabilities end at 0 or 1."""
    p, held = list(p), []
    for i in range(len(p)):
        if TINY < p[i] < 1 - TINY:
            held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        # u is orthogonal to (1, 1, 1) and to (x_a, x_b, x_c); equal sizes leave a plane, of which one direction does.
        u = (x[b] - x[c], x[c] - x[a], x[a] - x[b])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[k]) / v if v > 0 else -p[k] / v for k, v in zip(held, u, strict=True) if v)
        down = min(p[k] / v if v > 0 else (p[k] - 1) / v for k, v in zip(held, u, strict=True) if v)
        step = up if _draw(seed, i, len(held)) * (up + down) < down else -down
        for k, v in zip(held, u, strict=True):
            p[k] += step * v
            p[k] = 0.0 if p[k] < TINY else 1.0 if p[k] > 1 - TINY else p[k]
        held = [k for k in held if 0 < p[k] < 1]
    return p


def _landing(p: list[float], x: list[float], seed: tuple) -> list[float]:
    """The few units still fractional: the choice of least distance in words, then in units, from what was due."""
    held = [i for i, v in enumerate(p) if TINY < v < 1 - TINY]
    due, units = sum(p[i] * x[i] for i in held), sum(p[i] for i in held)
    choices = [[k >> j & 1 for j in range(len(held))] for k in range(1 << len(held))]
    best = min(choices, key=lambda c: (abs(sum(a * x[i] for a, i in zip(c, held, strict=True)) - due), abs(sum(c) - units), _draw(seed, tuple(c))))
    for i, v in zip(held, best, strict=True):
        p[i] = float(v)
    return [round(v) if v in (0.0, 1.0) else v for v in p]


def _flown(seed: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def fly(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["turn", "id", "size", "unit"], kind="stable", ignore_index=True)
        key = (seed, int(rows["source_nr"][0]), int(rows["chunk"][0]))
        p = flight(rows["p"].tolist(), rows["size"].astype(float).tolist(), key)
        if last:
            p = _landing(p, rows["size"].astype(float).tolist(), key)
        return rows.assign(p=p)

    return fly


def mixed(docs: DataFrame, most: float = 3, cycle: tuple[float, ...] = CYCLE, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows of docs (id, source) with size, source_size, target and copies (how often the mix takes the row).

    Null texts and texts without words have size 0, and are taken floor(r) times or drawn like others. A source without
    words has the target 0 and copies 0. Null sources are one source, weighed last. Reruns agree: draws hang on ids, texts and
    the number of a row among those alike in both. Rows that repeat are units of their own, dealt into chunks as any
    others. An empty table gives an empty result. One row for each source reaches the driver; more than MOST_SOURCES
    are refused.
    """
    return _drawn(docs, most, cycle, seed, id_col, text_col, source_col).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies")


def _drawn(docs: DataFrame, most: float, cycle: tuple[float, ...], seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    spark = docs.sparkSession
    shipped(spark)
    tables = Tables(spark)
    key = ["id", "source", "size", "hash"]
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), ascii_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("hash"))
    slim = tables.write(slim, "sizes")
    sums = slim.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(sums) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources to mix")
    due = targets([(r["source"], r["size"]) for r in sums], most, cycle)
    order = sorted(sums, key=lambda r: (r["source"] is None, r["source"] or ""))
    facts = [(r["source"], i, r["size"], float(due[r["source"]]), due[r["source"]] / r["size"] if r["size"] else 0.0, max(1, -(-r["n"] // CHUNK))) for i, r in enumerate(order)]
    facts = spark.createDataFrame(facts, "source string, source_nr int, source_size long, target double, ratio double, chunks int")
    facts = F.broadcast(facts.withColumnRenamed("source", "own"))  # MOST_SOURCES rows at most
    units = numbered(slim, key, "nr").join(facts, F.col("source").eqNullSafe(F.col("own")), "left").drop("own")
    turn = F.xxhash64("id", "size", "hash", "nr", F.lit(seed))
    whole = F.least(F.floor("ratio"), F.lit(most)).cast("int")
    units = units.withColumns({"turn": turn, "whole": whole, "p": F.col("ratio") - whole, "chunk": F.pmod(F.xxhash64("id", "hash", "nr", F.lit(seed + 1)), F.col("chunks")).cast("int"), "unit": F.monotonically_increasing_id()})
    units = tables.write(units.select(*key, "nr", "source_nr", "source_size", "target", "whole", "turn", "p", "chunk", "unit"), "units")
    schema = "id long, size long, source_nr int, turn long, p double, chunk int, unit long"
    slimmer = units.select(schema_names := [x.split()[0] for x in schema.split(", ")])
    fly = lambda rows, last: rows.groupBy("source_nr", "chunk").applyInPandas(_flown(seed, last), schema)
    flown = tables.write(fly(slimmer.where((F.col("p") > TINY) & (F.col("p") < 1 - TINY)), False), "flown")
    decided, left = flown.where("p = 0 or p = 1"), flown.where("p > 0 and p < 1")
    wide = max((r["n"] for r in sums), default=0) // CHUNK + 1
    while True:  # up the tree: two units of each of CHUNK / 2 chunks fly together
        wide = -(-wide // (CHUNK // 2))
        level = left.withColumn("chunk", F.pmod(F.col("chunk"), F.lit(wide)).cast("int")).select(schema_names)
        level = tables.write(fly(level, wide == 1), "flown")
        decided, left = decided.unionByName(level.where("p = 0 or p = 1")), level.where("p > 0 and p < 1")
        if wide == 1:
            break
    drawn = decided.where("p = 1").select("unit", F.lit(1).alias("drawn"))
    out = units.join(drawn, "unit", "left").withColumn("copies", F.col("whole") + F.coalesce("drawn", F.lit(0)) + F.when(F.col("p") >= 1 - TINY, 1).otherwise(0))
    out = tables.write(out.select(*key, "nr", "source_size", "target", "copies"), "taken")
    tables.drop(out)
    return out


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: float = 3, cycle: tuple[float, ...] = CYCLE, seed: int = 11) -> DataFrame:
    """The mix itself: docs with each row as often as the mix takes it. Rows alike in id, source and text are dealt their copies by number.

    docs is read several times and must read alike each time, as a table does.
    """
    key = ["id", "source", "size", "hash"]
    taken = _drawn(docs, most, cycle, seed, id_col, text_col, source_col).where("copies > 0")
    taken = taken.select(*(F.col(k).alias(f"_storyloom_{k}_b") for k in [*key, "nr"]), F.col("copies").alias("_storyloom_copies"))
    own = dict(zip(key, (F.col(id_col).cast("long"), F.col(source_col), ascii_words(F.col(text_col)), F.xxhash64(text_col)), strict=True))
    out = docs.withColumns({f"_storyloom_{k}": c for k, c in own.items()})
    out = numbered(out, [f"_storyloom_{k}" for k in key], "_storyloom_nr")
    same = [F.col(f"_storyloom_{k}").eqNullSafe(F.col(f"_storyloom_{k}_b")) for k in [*key, "nr"]]
    return out.join(taken, same).withColumn("_storyloom_copy", F.explode(F.expr("sequence(1, _storyloom_copies)"))).select(docs.columns)
