"""MinHash near-duplicate detection with SuperMinHash signatures, banding, exact verification and union-find grouping.

One pass over the texts gives each document its number of distinct word shingles, a fingerprint of the whole
set and the hashes of its signature's bands. Documents with the same set are one class at once. Class
representatives that share a band are candidates. They are compared on their full sets with the smallest id of their
bucket, then with two more leaders from other components. Pairs that are in different components even then are
compared unless their differences from the leader rule out, exactly, that they are linked. So every pair in every bucket is
compared, joined or ruled out; no bucket is capped and no group is expanded into all its pairs. Components are
united link by link as in a union-find, by star contraction; later links only unite the components found so far.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from storyloom.llm.common import Tables, by_bytes, mix64, screened, shipped

#: Elements whose permutations are held at once, while a signature is made.
ELEMENTS, SETS = 40_000, 1_000
#: Leaders that the members of a hub are compared with before pairs across components are sought.
LEADERS = 3
#: Members of a bucket beyond which it is of the next level; a hub's rows of level n are dealt into 8 ** n parts.
LEVELS = (128, 1024, 8192, 65536)


def shingle_sets(text: pa.Array, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one text after the other, and where each text's set starts.

    A-Z are lower-cased; words are runs of other than ASCII white space. A text with fewer words than a shingle has
    its whole sequence as its only shingle; null and empty texts have none.
    """
    flat = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    owner = pc.list_parent_indices(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(flat)
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    there = pc.greater(pc.binary_length(flat), 0)
    owner, flat = owner[there.to_numpy(zero_copy_only=False)], flat.filter(there)
    coded = flat.dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    word = hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.uint64)
    n = len(text)
    starts = np.searchsorted(owner, np.arange(n + 1))
    counts = np.diff(starts)
    # A shingle starts at each word with enough words after it in its text, or at the first of a short text.
    first = np.arange(len(word)) - starts[owner]
    length = np.minimum(counts[owner], words)
    at = np.flatnonzero(first + length <= counts[owner]) if len(word) else np.zeros(0, np.int64)
    value = mix64(length[at].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for k in range(words):
        inside = k < length[at]
        step = mix64((value ^ word[np.minimum(at + k, max(len(word) - 1, 0))]) + np.uint64(0xD1B54A32D192ED03))
        value = np.where(inside, step, value)
    doc = owner[at]
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[fresh], doc[fresh]
    return value, np.searchsorted(doc, np.arange(n + 1))


def _signatures(value: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures, one row of m values per set; a value holds its level in the upper 16 bits.

    At level j each element draws its j-th place of a Fisher-Yates permutation and a random part. The smallest
    level and part stay in each place. A set is done when all its places hold a value of a level already drawn:
    later levels can't be smaller. Most sets are done after a few levels.
    """
    n = len(starts) - 1
    out = np.full((n, m), np.iinfo(np.uint64).max, np.uint64)
    sizes = np.diff(starts)
    doc = np.repeat(np.arange(n), sizes)
    active, element = doc, value
    swapped: np.ndarray | None = None
    flat = out.reshape(-1)
    for j in range(m):
        if not len(element):
            break
        x = mix64(element + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = j + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        if swapped is None and j == 0:
            place = k
        else:
            if swapped is None:
                # level 0 again, now with its exchange kept
                swapped = np.tile(np.arange(m, dtype=np.int16), (len(element), 1))
                before = mix64(element + np.uint64(0x9E3779B97F4A7C15))
                k0 = ((before & np.uint64(0xFFFFFFFF)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
                rows = np.arange(len(element))
                swapped[rows, k0] = 0
                swapped[:, 0] = k0
            rows = np.arange(len(element))
            place = swapped[rows, k].astype(np.int64)
            swapped[rows, k] = swapped[:, j]
            swapped[:, j] = place
        np.minimum.at(flat, active * m + place, (np.uint64(j) << np.uint64(48)) | (x >> np.uint64(16)))
        open_ = active[np.flatnonzero(np.diff(active, prepend=-1))]
        still = np.zeros(n, bool)
        still[open_] = (out[open_].max(axis=1) >> np.uint64(48)) > np.uint64(j)
        keep = still[active]
        if not keep.all():
            active, element = active[keep], element[keep]
            swapped = swapped[keep] if swapped is not None else None
    return out


def signatures(value: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """Signatures in blocks of sets, so that the permutations of a block stay small."""
    n = len(starts) - 1
    parts, a = [], 0
    while a < n:
        b = min(max(a + 1, int(np.searchsorted(starts, starts[a] + ELEMENTS, side="right")) - 1), a + SETS, n)
        parts.append(_signatures(value[starts[a] : starts[b]], starts[a : b + 1] - starts[a], m))
        a = b
    return np.concatenate(parts) if parts else np.zeros((0, m), np.uint64)


def banding(threshold: float, miss: float = 1e-4) -> tuple[int, int]:
    """Rows and bands: the most rows up to 7 whose bands, 32 at most, miss a pair at the threshold with less than `miss`."""
    for rows in range(7, 0, -1):
        bands = math.ceil(math.log(miss) / math.log(1 - threshold**rows))
        if bands <= 32:
            return rows, bands
    return 1, 32


def _signed(text: pa.Array, words: int, rows: int, bands: int) -> dict[str, pa.Array]:
    value, starts = shingle_sets(text, words)
    sizes = np.diff(starts)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix64(value), dtype=np.uint64)])
    other = np.concatenate([[np.uint64(0)], np.cumsum(mix64(value ^ np.uint64(0xA24BAED4963EE407)), dtype=np.uint64)])
    signature = signatures(value, starts, rows * bands).reshape(-1, bands, rows)
    key = np.broadcast_to(mix64(np.arange(bands, dtype=np.uint64) + np.uint64(1)), signature.shape[:2])
    for r in range(rows):
        key = mix64((key ^ signature[:, :, r]) + np.uint64(0x9E3779B97F4A7C15))
    each = np.arange(0, (len(sizes) + 1) * bands, bands, dtype=np.int32)
    return {
        "n": pa.array(sizes.astype(np.int64)),
        "fa": pa.array((total[starts[1:]] - total[starts[:-1]]).view(np.int64)),
        "fb": pa.array((other[starts[1:]] - other[starts[:-1]]).view(np.int64)),
        "bands": pa.ListArray.from_arrays(each, pa.array(np.ascontiguousarray(key).reshape(-1).view(np.int64))),
    }


def components(links: DataFrame, tables: Tables | None = None, at_most: int = 60) -> DataFrame:
    """Connected components of links (a, b): node and label, the smallest node reachable, for each node with a link.

    Large-star and small-star steps in turn, each a grouped minimum and a join, until the stars no longer change;
    each round is a written table. Raises if at_most rounds do not settle them.
    """
    tables = tables or Tables(links.sparkSession)
    low = lambda rows: rows.groupBy("u").agg(F.min("v").alias("low")).hint("merge")
    stars = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    last = None
    for _ in range(at_most):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(low(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("low", "u").alias("v"))
        large = large.distinct()
        small = large.join(low(large), "u").select(F.explode(F.array(F.struct("v", "low"), F.struct(F.col("u").alias("v"), "low"))).alias("e"))
        small = small.select(F.col("e.v").alias("u"), F.col("e.low").alias("v")).where("u <> v").distinct()
        seen = Observation()
        stars = tables.write(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("sum")), "stars")
        if seen.get == last:
            break
        last = seen.get
    else:
        raise RuntimeError(f"components not settled after {at_most} rounds")
    roots = stars.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def _relabelled(labels: DataFrame | None, links: DataFrame, tables: Tables) -> DataFrame:
    """Labels of all nodes with a link, after more links; only links between components found so far are looked at."""
    if labels is None:
        return tables.write(components(links, tables), "labels")
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")).hint("merge")
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    between = between.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    moved = components(between, tables).select(F.col("node").alias("old"), F.col("label").alias("new"))
    out = labels.select("node", F.col("label").alias("old")).join(moved.hint("merge"), "old", "full_outer")
    # A node without a link so far is a label of its own.
    return tables.write(out.select(F.coalesce("node", "old").alias("node"), F.coalesce("new", "old").alias("label")), "labels")


def _part(level: Column) -> Column:
    """What member rows of a level are dealt by beside their hub."""
    return F.pmod(F.xxhash64("id"), F.pow(F.lit(8), level).cast("long"))


def _to_members(rows: DataFrame, hubs: DataFrame, levels: DataFrame) -> DataFrame:
    """Member rows (lid, id, level) joined with one row of each hub, which is dealt to every part of the hub's levels."""
    dealt = hubs.join(levels, "lid").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(8), F.col("level")).cast("long") - 1)))
    return rows.withColumn("part", _part(F.col("level"))).join(dealt, ["lid", "level", "part"]).drop("part")


def _across(live: DataFrame, levels: DataFrame, full: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """Pairs (a, b) of one hub's members in two components that may be linked; all others are ruled out, exactly.

    Let D(x) be the shingles in which x differs from its hub. Two sets of sizes m, n are linked when they differ in at most
    k * (m + n) shingles, k = (100 - percent) / (100 + percent), and they differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)|. So
    a link needs |D(x) & D(y)| >= (|D(x)| + |D(y)| - k * (m + n)) / 2, which is more than nothing unless both are linked to
    the hub. With D ordered from the rarest shingle on, sets that share that many share one of the first few: only
    members that do so, at places which leave enough to share, are paired.
    """
    k = (100 - percent) / (100 + percent)
    hub = full.select(F.col("id").alias("lid"), F.col("shingles").alias("theirs")).join(live.select("lid").distinct(), "lid")
    sets = _to_members(live.join(full, "id"), hub, levels)
    differ = F.concat(F.array_except("shingles", "theirs"), F.array_except("theirs", "shingles"))
    sets = sets.select("lid", "id", "label", "n", differ.alias("d")).withColumn("dn", F.size("d"))
    held = tables.write(sets.select("lid", "id", "label", "n", "dn", F.explode("d").alias("shingle")), "differences")
    often = held.groupBy("lid", "shingle").agg(F.count("*").alias("often"), (F.min("label") < F.max("label")).alias("shared"))
    most = held.groupBy("lid").agg(F.min(F.col("dn") - k * F.col("n")).alias("least_w"), F.max("n").alias("most_n"))
    one = held.join(often, ["lid", "shingle"]).groupBy("lid", "id", "label", "n", "dn").agg(F.array_sort(F.collect_list(F.struct("often", "shingle", "shared"))).alias("order"))
    w = F.col("dn") - k * F.col("n")
    partner = F.greatest("least_w", F.col("dn") - k * (F.col("n") + 2 * F.col("most_n")))
    need = F.greatest(F.lit(1), F.ceil((w + partner) / 2 - 1e-9))
    first = F.slice("order", F.lit(1), F.greatest(F.lit(0), F.col("dn") - need + 1).cast("int"))
    first = one.join(most, "lid").select("lid", "id", "label", "dn", w.alias("w"), F.posexplode(first).alias("at", "s"))
    first = tables.write(first.where("s.shared").select("lid", "id", "label", "dn", "w", "at", F.col("s.shingle").alias("shingle")), "prefixes")
    x, y = first.alias("x"), first.alias("y")
    enough = F.least(F.col("x.dn") - F.col("x.at"), F.col("y.dn") - F.col("y.at")) >= (F.col("x.w") + F.col("y.w")) / 2 - 1e-9
    both = x.join(y, (F.col("x.lid") == F.col("y.lid")) & (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.label") != F.col("y.label")) & enough)
    return both.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id and kept (doc_id is its component's smallest).

    Documents are linked when 100 * |A & B| >= percent * |A | B| on their sets of distinct shingles. Rows with no
    words are linked with nothing. Rows that repeat an id each come out, in the component of their own text; of several
    texts under one id the least is compared. A null id has a null component and is kept. Columns beside id and text are not
    read. An empty table gives an empty result.
    """
    shipped(docs.sparkSession)
    tables = Tables(docs.sparkSession)
    rows, bands = banding(percent / 100)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                out = {"id": part.column("id")} | _signed(part.column("text"), words, rows, bands)
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                value, starts = shingle_sets(part.column("text"), words)
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists], names=["id", "shingles"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = tables.write(texts.mapInArrow(sign, "id long, n long, fa long, fb long, bands array<long>"), "signed")
    some = signed.where("n > 0 and id is not null")
    classes = tables.write(some.groupBy("fa", "fb", "n").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands")), "classes")
    keyed = tables.write(classes.select(F.col("rep").alias("id"), "n", F.explode("bands").alias("key")), "keys")
    buckets = keyed.groupBy("key").agg(F.min(F.struct("id", "n")).alias("lead"), F.count("*").alias("c")).where("c > 1")
    buckets = tables.write(buckets.select("key", F.col("lead.id").alias("lid"), F.col("lead.n").alias("ln"), "c"), "buckets")
    # All buckets with one leader are one hub: what shares a bucket shares a hub. Members of large buckets are of a higher level.
    level = sum((F.when(F.col("c") > most, 1).otherwise(0) for most in LEVELS), F.lit(0))
    hubs = screened(keyed, "key", buckets.select("key")).join(buckets, "key").groupBy("lid", "ln", "id", "n").agg(F.max(level).alias("level"))
    hubs = tables.write(hubs, "hubs")
    levels = tables.write(hubs.select("lid", "level").distinct(), "levels")
    wanted = tables.write(hubs.select("id").distinct(), "wanted")
    full = screened(texts, "id", wanted).join(wanted, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    full = tables.write(full.mapInArrow(sets, "id long, shingles array<long>"), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        one = full.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
        two = full.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        return pairs.join(two, "b").join(one, "a").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")

    near = lambda n, m: F.least(n, m) * 100 >= F.greatest(n, m) * percent
    pairs = hubs.where((F.col("id") != F.col("lid")) & near("n", "ln")).select(F.col("lid").alias("a"), F.col("id").alias("b"))
    live, tested, labels = hubs.withColumn("leads", F.array("lid")), None, None
    for turn in range(LEADERS + 1):
        if turn:
            label = labels.select(F.col("node").alias("id"), "label").hint("merge")
            live = live.select("lid", "id", "n", "level", "leads").join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
            groups = live.groupBy("lid", "label").agg(F.min(F.struct("id", "n")).alias("first"), F.max(F.array_contains("leads", F.col("id"))).alias("led"))
            # The next leader of a hub: the smallest id that is in none of its leaders' components.
            found = groups.groupBy("lid").agg(F.count("*").alias("c"), F.min(F.when(~F.col("led"), F.struct("first.id", "first.n", "label"))).alias("next"))
            live, n = tables.counted(_to_members(live, found.where("c > 1").select("lid", "next"), levels), "open")
            if not n:
                break
            if turn == LEADERS:
                pairs = _across(live, levels, full, percent, tables)
            else:
                pairs = live.where((F.col("label") != F.col("next.label")) & near("n", "next.n"))
                pairs = pairs.select(F.least("id", "next.id").alias("a"), F.greatest("id", "next.id").alias("b")).distinct()
                live = live.withColumn("leads", F.when(F.col("next").isNull(), F.col("leads")).otherwise(F.array_append("leads", F.col("next.id"))))
        pairs = tables.write(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        links, n = tables.counted(verified(pairs), "verified")
        tested = pairs if tested is None else tested.unionByName(pairs)
        if n or labels is None:
            labels = _relabelled(labels, links, tables)
    group = classes.select("fa", "fb", "n", "rep").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left")
    group = tables.write(group.select("fa", "fb", "n", F.coalesce("label", "rep").alias("label")), "groups")
    tables.drop(signed, group)
    out = signed.select("id", "n", "fa", "fb").join(group, ["fa", "fb", "n"], "left")
    out = out.withColumn("component_id", F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.coalesce("label", "id"))).otherwise(F.col("id")))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", (F.col("component_id").isNull() | F.col("id").eqNullSafe(F.col("component_id"))).alias("kept"))
