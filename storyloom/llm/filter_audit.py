"""Which documents each filter removes, in every order of the filters: a packed bitmap index and sums of its counts.

Every partition turns its rows into bitsets, one for each filter, label and part, with the rows of a part next to each other
and padded to whole bytes. For each of the 32 subsets of filters it counts, by AND-NOT and popcount, the rows that no filter of
the subset fails: all of them, those of good quality and the toxic ones. The partitions' counts are summed by part and subset.
All figures of a prefix of an order follow from these sums, so what is gathered grows with the parts only.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import Tables, shipped

#: The filters in the order of their bits.
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
#: Copies of one text are dealt into this many parts while the smallest id among them is looked for.
SALTS = 64
_COUNTS = "part string, subset int, alive long, good long, toxic long"


def failures(text: Column) -> dict[str, Column]:
    """Failure of the filters that look at one text only; null is empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    many, kinds = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": many < 100,
        "B": 100 * kinds.cast("long") < 80 * many.cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 10 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def flagged(tables: Tables, docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """part, fails (a bit for each filter) and the labels of every row, written once; texts are read once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = sum((F.when(failed, 1 << FILTERS.index(f)).otherwise(0) for f, failed in failures(F.col(text_col)).items()), F.lit(0))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        own.cast("int").alias("own"),
        F.unhex(F.md5(text)).alias("digest"),
    ).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    rows = tables.write(rows, "audit-rows")
    # The smallest id of a text: first within its parts, then over the parts, of which there are SALTS at most.
    parts = rows.groupBy("digest", "salt").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    both = {"least": F.min("least"), "n": F.sum("n"), "salts": F.collect_set("salt")}
    known = parts.groupBy("digest").agg(*(c.alias(k) for k, c in both.items())).where("n > 1").select("digest", "least", F.explode("salts").alias("salt"))
    of = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
    of = of.agg(F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    later = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    fails = F.col("own") + F.when(later, 1 << FILTERS.index("E")).otherwise(0)
    joined = rows.join(known, ["digest", "salt"], "left").join(of, "id", "left")
    return joined.select("part", fails.alias("fails"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def bitset_counts(part: np.ndarray, fails: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each subset of filters, the parts (numbers, ascending) and rows of three counts: alive, good, toxic."""
    order = np.argsort(part, kind="stable")
    kinds, start, size = np.unique(part[order], return_index=True, return_counts=True)
    wide = -(-size // 8) * 8
    first = np.append(0, np.cumsum(wide))
    place = np.arange(len(part)) - np.repeat(start, size) + np.repeat(first[:-1], size)

    def bits(which: np.ndarray) -> np.ndarray:
        flat = np.zeros(first[-1], bool)
        flat[place] = which[order]
        return np.packbits(flat)

    held = bits(np.ones(len(part), bool))
    filters = [bits(fails >> k & 1 == 1) for k in range(len(FILTERS))]
    sets = held, bits(good == 1), bits(toxic == 1)
    for subset in range(1 << len(FILTERS)):
        gone = np.zeros_like(held)
        for k, failing in enumerate(filters):
            if subset >> k & 1:
                gone |= failing
        yield subset, kinds, np.stack([np.add.reduceat(np.bitwise_count(s & ~gone).astype(np.int64), first[:-1] // 8) for s in sets])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = batch.column("part").dictionary_encode()
        values = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fails", "good", "toxic"))
        for subset, kinds, counts in bitset_counts(parts.indices.to_numpy(zero_copy_only=False), *values):
            names = parts.dictionary.take(pa.array(kinds))
            yield pa.RecordBatch.from_arrays([names, pa.array(np.full(len(kinds), subset, np.int32)), *map(pa.array, counts)], names=["part", "subset", "alive", "good", "toxic"])


def audited(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """For every part, order of the five filters and step: what the step keeps and removes, and how the filters overlap.

    A row is a document, repeated ids and rows too. Filter E fails a row if a row of a smaller id has the same text; a null id
    is smaller than none and larger than none. Of several labels for one id, a good and a toxic one count. Null parts are the
    empty string. An empty table gives no row. Columns of docs other than the three named ones are not read.
    """
    shipped(docs.sparkSession)
    tables = Tables(docs.sparkSession)
    try:
        counts = flagged(tables, docs, labels, id_col, text_col, part_col).mapInArrow(_count, _COUNTS)
        # 32 rows a part: written, so that the table of the rows can go.
        sums = Tables(docs.sparkSession).write(counts.groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in ("alive", "good", "toxic"))), "audit-counts")
    finally:
        tables.drop()
    return prefixes(sums)


def prefixes(sums: DataFrame) -> DataFrame:
    """The figures of all 120 orders and their steps from the counts by part and subset of filters."""
    each = F.sort_array(F.collect_list(F.struct("subset", "alive", "good", "toxic")))
    parts = sums.groupBy("part").agg(each.alias("c"))
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    steps = [{"filter_order": o, "step": k + 1, "before": sum(bit[f] for f in o[:k]), "bit": bit[f]} for o in ORDERS for k, f in enumerate(o)]
    steps = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, before int, bit int>>")
    at = lambda subset, field="alive": F.get(F.col("c"), subset)[field]

    def shapley(b: int) -> str:
        """The removals by a filter, over the subsets that can come before it, each as often as orders have it there."""
        before = [s for s in range(1 << len(FILTERS)) if not s & b]
        often = lambda s: math.factorial(s.bit_count()) * math.factorial(len(FILTERS) - 1 - s.bit_count())
        return " + ".join(f"(c[{s}].alive - c[{s | b}].alive) * {often(s)}L" for s in before)

    parts = parts.select("part", "c", F.expr(f"map({', '.join(f'{b}, {shapley(b)}' for b in bit.values())})").alias("shares"))
    rows = parts.select("part", "c", "shares", F.explode(steps).alias("s")).select("part", "c", "shares", "s.*")
    before, after = F.col("before"), F.col("before").bitwiseOR(F.col("bit"))
    removed = at(before) - at(after)
    whole = (1 << len(FILTERS)) - 1
    alone = F.lit(whole) - F.col("bit")
    return rows.select(
        "part", "filter_order", "step",
        at(after).alias("kept"),
        removed.alias("removed"),
        (at(F.lit(0)) - at(F.col("bit")) - removed).alias("redundant"),
        (at(alone) - at(F.lit(whole))).alias("unique_fails"),
        (at(before, "good") - at(after, "good")).alias("good_lost"),
        (at(before, "toxic") - at(after, "toxic")).alias("toxic_lost"),
        F.element_at("shares", F.col("bit")).alias("shapley"),
    )
