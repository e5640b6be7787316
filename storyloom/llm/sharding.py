"""Consistent-hash ring with virtual nodes and bounded loads.

A document's key is its text's hash, so equal texts are neighbours on the ring. The ring is cut into CELLS arcs of equal
length; a cell's owner is the next virtual node clockwise. Cells are placed in ring order: a cell whose shard is full
(its bytes would exceed (1 + slack) of the mean) continues clockwise to the next shard with room. Cells that hold many
times the mean are first split into parts of about the mean, by the hash of the document's id and of its number among the rows
of the same id and text, so that a group of copies, or of repeated rows, may span shards. Only the totals of cells and parts reach the driver: less than four times CELLS rows, whatever the input.
"""

from __future__ import annotations

import bisect
import hashlib
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import numbered, written

#: Arcs of the ring, and from how many times the mean a cell is crowded.
CELLS, CROWDED = 1 << 14, 8


def ring(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes, clockwise; a shard's nodes depend on its own number only."""
    place = lambda s, v: int.from_bytes(hashlib.sha256(f"shard {s} node {v}".encode()).digest()[:8]) % CELLS
    return sorted((place(s, v), s) for s in range(shards) for v in range(virtual_nodes))


def place_cells(sizes: list[tuple[int, int, int]], shards: int, virtual_nodes: int, slack: float) -> dict[tuple[int, int], int]:
    """The shard of each (cell, part, bytes), in ring order; the least loaded takes what fits nowhere."""
    nodes = ring(shards, virtual_nodes)
    at = [n[0] for n in nodes]
    most = sum(s for *_, s in sizes) / shards * (1 + slack)
    load, out = [0] * shards, {}
    for cell, part, size in sorted(sizes):
        first = bisect.bisect_left(at, cell)
        order = dict.fromkeys(nodes[(first + k) % len(nodes)][1] for k in range(len(nodes))) if load[nodes[first % len(nodes)][1]] + size > most else [nodes[first % len(nodes)][1]]
        shard = next((s for s in order if load[s] + size <= most), None)
        if shard is None:
            shard = min(range(shards), key=lambda s: (load[s], s))
        load[shard] += size
        out[cell, part] = shard
    return out


def sharded(docs: DataFrame, shards: int = 8, virtual_nodes: int = 64, slack: float = 0.002, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, size (UTF-8 bytes of the text, null none, plus 1), text_crc32, shard and slot (gapless from 0 in each shard).

    Null texts are one key, null ids one id. Rows that repeat are placed alike unless their cell is crowded; then they are dealt
    like others. Columns beside id and text are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text, nr = F.col(text_col), F.col(id_col)
    rows = docs.select(
        nr.alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text, F.lit(1)).alias("hash"),
        F.pmod(F.xxhash64(text, F.lit(1)), F.lit(CELLS)).cast("int").alias("cell"),
    )
    rows = written(rows, "sizes")
    # CELLS rows at most
    cells = rows.groupBy("cell").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    most, many = (max(1.0, sum(r[k] for r in cells) / CELLS) for k in ("size", "n"))
    # A crowded cell has as many parts as it holds means of either kind: 2 * CELLS and one for each cell at most, all together.
    crowded = [(r["cell"], math.ceil(max(r["size"] / most, r["n"] / many))) for r in cells if r["size"] > CROWDED * most or r["n"] > CROWDED * many]
    split = F.broadcast(spark.createDataFrame(crowded, "cell int, parts int"))
    # Only rows of crowded cells are numbered, and each part of a hot group by itself.
    dealt = numbered(rows.join(split, "cell"), ["id", "hash"], "nr").withColumn("part", F.pmod(F.xxhash64("id", "nr", F.lit(2)), "parts").cast("int"))
    whole = rows.join(split, "cell", "left_anti").withColumn("part", F.lit(0))
    rows = written(whole.unionByName(dealt.drop("nr", "parts")).drop("hash"), "parts")
    sums = rows.groupBy("cell", "part").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    sums = sums.collect()
    place = place_cells([(r["cell"], r["part"], r["size"]) for r in sums], shards, virtual_nodes, slack)
    offset, before = {}, [0] * shards
    for r in sorted(sums, key=lambda r: (r["cell"], r["part"])):
        key = r["cell"], r["part"]
        offset[key] = before[place[key]]
        before[place[key]] += r["n"]
    table = spark.createDataFrame([(*k, s, offset[k]) for k, s in place.items()], "cell int, part int, shard int, first long")
    out = rows.join(F.broadcast(table), ["cell", "part"])
    turn = Window.partitionBy("cell", "part").orderBy(F.xxhash64("id"), "id", "size", "text_crc32")
    out = out.withColumn("slot", F.col("first") + F.row_number().over(turn) - 1)
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")
