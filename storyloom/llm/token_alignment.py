"""How the tokens of two tokenizers line up: cuts where both end, groups between cuts, links within groups.

The relational work is done once for each distinct segment of the corpus, not for each of its places. A segment begins at a
blank or line end that follows a character which is no white space, or at a sign after a letter: both tokenizers are bound to
cut there, so a segment's tokens don't hang on its neighbours (where a vocabulary doesn't promise that, a whole text is one
segment).

1. Documents are dealt into chunks of bounded bytes by row, whatever their texts. A chunk's segments are numbered by
   frequency, and its documents kept as these numbers.
2. The distinct segments of all chunks are tokenized. Their tokens' lengths are exploded by position and summed by window to
   ends, A's and B's ends are joined on segment and end, and the cuts met so far number the groups. A segment's groups are
   ranges of its tokens; links are the pairs of a group's different ids with their number, never of their occurrences.
3. In each chunk the documents that hold an id pair linked are counted, each once; the counts are summed by pair.
4. Counts and best links are summed by segment, then, in the chunks, by document.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import string
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.llm.common import Tables, by_bytes, give_back, shipped, text_bytes

#: Bytes of text in a chunk, at most but for one long text; there are more chunks if tasks would idle.
CHUNK_BYTES = 16 << 20
#: Bytes of packed numbers that are worked on at once in a chunk, and cells of the table of documents and pairs.
BLOCK, CELLS = 1 << 19, 1 << 23
#: Fixed value: the mark that stands for a blank in pieces.
MARK = "▁"


class TokenPair:
    """Both tokenizers, and the bytes of each of their ids."""

    def __init__(self, a_json: str, b_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.a_bytes = {i: bytes(byte_of[c] for c in t) for t, i in self.a.get_vocab(False).items() if all(c in byte_of for c in t)}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)}
        self.blank = self.b.piece_to_id(MARK)
        spec = json.loads(a_json)
        pre = spec.get("pre_tokenizer") or {}
        byte_level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        # No piece goes on over a blank or a line end, and both are kept as they are.
        kept = [self.b.encode(t, out_type=str) for t in ("a  b\nc ", "\nab")] == [[MARK + "a", MARK, MARK + "b", "<0x0A>", "c", MARK], [MARK, "<0x0A>", "ab"]]
        self.separable = byte_level and kept and not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces)
        # A ends a run of letters at a sign; so does B, if none of its pieces goes on from a letter to it.
        after = {y for p in pieces for x, y in zip(p, p[1:], strict=False) if x.isalpha()}
        self.signs = "".join(c for c in string.punctuation if c not in after) if self.separable else ""

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B of segments of a text with a blank before it; both empty where their bytes are not the segment's."""
        many = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        of_a = [e.ids for e in many(segments, add_special_tokens=False)]
        # B puts a blank before what it is given: one is taken off, and where there is none, a line end keeps B's apart.
        of_b = self.b.encode([s[1:] if s[:1] == " " else "\n" + s for s in segments], num_threads=1)
        for k, s in enumerate(segments):
            if s == " ":
                of_b[k] = [self.blank]
            elif s[:1] != " ":
                of_b[k] = of_b[k][2:]
            raw = s.encode()
            if b"".join(map(self.a_bytes.__getitem__, of_a[k])) != raw or b"".join(map(self.b_bytes.__getitem__, of_b[k])) != raw:
                of_a[k], of_b[k] = [], []
        return of_a, of_b


LETTERS = np.isin(np.arange(256), np.frombuffer(string.ascii_letters.encode(), np.uint8))


def segment_starts(body: np.ndarray, starts: np.ndarray, signs: str) -> np.ndarray:
    """Where segments begin in texts that lie one after the other: at the texts, before " " or "\\n" after no white space, and before signs after a letter."""
    if not len(body):
        return np.zeros(0, np.int64)
    mark = np.zeros(len(body), bool)
    mark[starts[:-1][np.diff(starts) > 0]] = True
    kind = np.zeros(256, np.uint8)
    kind[[32, 10]] = 1
    kind[list(signs.encode())] = 2
    kind = kind[body[1:]]
    mark[1:] |= (kind == 2) & LETTERS[body[:-1]]
    mark[1:] |= (kind == 1) & (body[:-1] > 32) & (body[:-1] < 127)
    at = np.flatnonzero((kind == 1) & (body[:-1] > 127)) + 1
    one, two, three = (np.where(at >= k, body[np.maximum(at - k, 0)], 0) for k in (1, 2, 3))
    # What is white space beyond ASCII lies in these ranges of bytes; some of what they hold isn't, and merely isn't cut after.
    wide = ((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | ((three == 0xE1) & (two == 0x9A)) | ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE3) & (two == 0x80))
    mark[at[~wide]] = True
    return np.flatnonzero(mark)


def packed(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2^28 in groups of seven bits, least first, and where each begins (one more entry)."""
    size = 1 + (numbers >= 1 << 7).astype(np.int64) + (numbers >= 1 << 14) + (numbers >= 1 << 21)
    at = np.append(0, np.cumsum(size))
    out = np.zeros(at[-1], np.uint8)
    for k in range(4):
        some = size > k
        out[at[:-1][some] + k] = (numbers[some] >> 7 * k & 127) | np.where(size[some] > k + 1, 128, 0)
    return out, at


def unpacked(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of packed bytes, and how many of them end before each byte (one more entry)."""
    last = data < 128
    ends = np.flatnonzero(last)
    begins = np.append(0, ends[:-1] + 1) if len(ends) else ends
    out = np.zeros(len(ends), np.int64)
    for k in range(4):
        some = begins + k <= ends
        out[some] |= (data[begins[some] + k] & 127).astype(np.int64) << 7 * k
    return out, np.append(0, np.cumsum(last))


_CODED = "chunk int, doc_id long, codes binary, code int, seg string"


def _coder(separable: bool, signs: str):
    """A chunk's documents as numbers of segments (`codes`), and the segments by number."""

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts, counts = [], []
        for batch in table.combine_chunks().to_batches():
            for part in by_bytes(batch, "text", 2 << 20):
                text = pc.fill_null(part.column("text").cast(pa.large_string()), "")
                text = pc.if_else(pc.equal(text, ""), text, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text, pa.scalar("", pa.large_string())))
                body, starts = text_bytes(text)
                at = segment_starts(body, starts, signs) if separable else starts[:-1][np.diff(starts) > 0]
                segs = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(body)).astype(np.int64)), pa.py_buffer(body))
                parts.append(segs.dictionary_encode())
                counts.append(np.diff(np.searchsorted(at, starts)))
        whole = pa.chunked_array(parts, pa.dictionary(pa.int32(), pa.large_string())).unify_dictionaries().combine_chunks()
        if isinstance(whole, pa.ChunkedArray):
            whole = pa.concat_arrays(whole.chunks)
        codes, names = whole.indices.to_numpy(zero_copy_only=False).astype(np.int64), whole.dictionary
        order = np.argsort(-np.bincount(codes, minlength=len(names)), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        data, at = packed(rank[codes])
        bounds = at[np.append(0, np.cumsum(np.concatenate(counts)))]
        docs, n = table.num_rows, len(names)
        names = names.take(pa.array(order)).cast(pa.string())
        codes = pa.LargeBinaryArray.from_buffers(pa.large_binary(), docs, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
        columns = [
            pa.array(np.full(docs + n, key[0].as_py(), np.int32)),
            pa.concat_arrays([table.column("doc_id").combine_chunks().cast(pa.int64()), pa.nulls(n, pa.int64())]),
            pa.concat_arrays([codes.cast(pa.binary()), pa.nulls(n, pa.binary())]),
            pa.concat_arrays([pa.nulls(docs, pa.int32()), pa.array(np.arange(n, dtype=np.int32))]),
            pa.concat_arrays([pa.nulls(docs, pa.string()), names]),
        ]
        give_back()
        return pa.Table.from_arrays(columns, names=["chunk", "doc_id", "codes", "code", "seg"])

    return work


def _tokenizer(a_json: str, b_model: bytes):
    @F.arrow_udf("struct<a array<int>, a_len array<int>, b array<int>, b_len array<int>>")
    def tokens(segments: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pair = TokenPair(a_json, b_model)
        sizes = []
        for known in (pair.a_bytes, pair.b_bytes):
            sizes.append(np.zeros(max(known, default=0) + 1, np.int32))
            sizes[-1][list(known)] = [len(x) for x in known.values()]
        for segs in segments:
            found = pair.encode(segs.to_pylist())
            columns = []
            for ids, size in zip(found, sizes, strict=True):
                flat = np.fromiter((x for y in ids for x in y), np.int32)
                at = pa.array(np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32))
                columns += [pa.ListArray.from_arrays(at, pa.array(flat)), pa.ListArray.from_arrays(at, pa.array(size[flat]))]
            yield pa.StructArray.from_arrays(columns, names=["a", "a_len", "b", "b_len"])

    return tokens


@contextmanager
def _kept_partitioning(spark: SparkSession):
    """Lets a join on segment and end keep a partitioning by segment, which windows before and after it need."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    was = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def cuts(tokens: DataFrame) -> DataFrame:
    """seg_id and `cut`: for each of its groups in order how many tokens of A and of B end with it or before; from seg_id, a_len, b_len."""
    by = Window.partitionBy("seg_id")

    def ends(side: str) -> DataFrame:
        rows = tokens.select("seg_id", F.posexplode(f"{side}_len").alias("pos", "len"))
        return rows.select("seg_id", F.sum("len").over(by.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).alias("end"), (F.col("pos") + 1).alias(side))

    both = ends("a").join(ends("b"), ["seg_id", "end"])
    group = F.count(F.lit(1)).over(by.orderBy("end").rowsBetween(Window.unboundedPreceding, -1)).cast("int").alias("g")
    return both.select("seg_id", group, "a", "b").groupBy("seg_id").agg(F.array_sort(F.collect_list(F.struct("g", "a", "b"))).alias("cut"))


_FACTS = "struct<n_a long, n_b long, n_groups long, n_links long, text string, pairs array<int>, times array<int>>"


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists, and where each list's begin (one more entry)."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))).astype(np.int64)


def segment_facts(a: pa.Array, b: pa.Array, cut_a: pa.Array, cut_b: pa.Array, wide: int) -> pa.Array:
    """Of segments: tokens, groups and links, the groups as text, and the linked id pairs (a * wide + b) with how often."""
    ids, sizes, owner, group, last = {}, {}, None, {}, {}
    for side, tokens, cut in (("a", a, cut_a), ("b", b, cut_b)):
        ids[side], starts = _flat(tokens)
        upto, bounds = _flat(cut)
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))  # of each group, its segment
        before = np.append(0, upto[:-1])
        before[bounds[:-1][np.diff(bounds) > 0]] = 0
        sizes[side] = upto - before
        group[side] = np.repeat(np.arange(len(upto)), sizes[side])
        last[side] = np.cumsum(sizes[side]) - 1
    n = len(bounds) - 1
    total = lambda x: np.diff(np.append(0, np.cumsum(x))[bounds])
    # The text: each id with what follows it, A's before B's in each group, is one piece; pieces lie in their order.
    pieces, places = [], []
    for side, by, end in (("a", 0, "|"), ("b", 1, ";")):
        mark = np.full(len(ids[side]), ",", object)
        mark[last[side]] = end
        pieces.append(pc.binary_join_element_wise(pa.array(ids[side]).cast(pa.large_string()), pa.array(mark, pa.large_string()), pa.scalar("", pa.large_string())))
        places.append(group[side] * 2 + by)
    place = np.concatenate(places)
    pieces = pa.concat_arrays(pieces).take(pa.array(np.argsort(place, kind="stable")))
    body, at = text_bytes(pieces)
    many = total(sizes["a"]) + total(sizes["b"])
    text = pa.LargeStringArray.from_buffers(n, pa.py_buffer(at[np.append(0, np.cumsum(many))].astype(np.int64)), pa.py_buffer(body)).cast(pa.string())
    # The links: a group's different ids of A, each with its different ids of B.
    most = max((int(x.max()) for x in ids.values() if len(x)), default=0) + 1
    kinds = {s: np.unique(group[s] * most + ids[s], return_counts=True) for s in "ab"}
    of = {s: np.append(np.searchsorted(k // most, np.arange(len(owner))), len(k)) for s, (k, _) in kinds.items()}
    with_b = np.diff(of["b"])[kinds["a"][0] // most]
    left = np.repeat(np.arange(len(with_b)), with_b)
    right = np.arange(with_b.sum()) - np.repeat(np.cumsum(with_b) - with_b, with_b) + of["b"][kinds["a"][0][left] // most]
    key = owner[kinds["a"][0][left] // most] << 31 | kinds["a"][0][left] % most * wide + kinds["b"][0][right] % most
    pair, back = np.unique(key, return_inverse=True)
    times = np.zeros(len(pair), np.int64)
    np.add.at(times, back, kinds["a"][1][left] * kinds["b"][1][right])
    at = pa.array(np.append(np.searchsorted(pair >> 31, np.arange(n)), len(pair)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (pair & 0x7FFFFFFF, times)]
    sums = [total(sizes["a"]), total(sizes["b"]), np.diff(bounds), total(sizes["a"] * sizes["b"])]
    return pa.StructArray.from_arrays([*(pa.array(x.astype(np.int64)) for x in sums), text, *lists], names=["n_a", "n_b", "n_groups", "n_links", "text", "pairs", "times"])


_SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _documents(coded: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """A chunk's documents some at a time, the numbers of their segments, and where each document's begin (one more entry)."""
    for batch in coded.combine_chunks().to_batches():
        for part in by_bytes(batch, "codes", BLOCK):
            data, starts = text_bytes(part.column("codes").cast(pa.large_binary()).view(pa.large_string()))
            codes, ended = unpacked(data)
            yield part, codes, ended[starts]


def _by_code(segments: pa.Table) -> pa.Table:
    return segments.combine_chunks().sort_by("code")


def _count_pairs(coded: pa.Table, segments: pa.Table) -> pa.Table:
    """How many of a chunk's documents hold each pair; those with a segment that has no tokens hold none."""
    segments = _by_code(segments)
    lists = segments.column("pairs").combine_chunks()
    void = lists.is_null().to_numpy(zero_copy_only=False)
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.append(0, np.cumsum(size))[:-1]
    pair, number = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    held, wide = np.zeros(len(pair), np.int64), max(len(pair), 1)

    def linked(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
        n = size[codes]
        at = np.repeat(begin[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(doc, n) * wide + number[at]

    for _, codes, bounds in _documents(coded):
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        bad = np.zeros(len(bounds) - 1, bool)
        bad[doc[void[codes]]] = True
        codes, doc = codes[~bad[doc]], doc[~bad[doc]]
        rows = max(1, CELLS // wide)  # documents that are marked in a table at once
        if len(bounds) * wide > 64 * size[codes].sum():  # short documents, many pairs
            key = np.unique(doc * len(size) + codes) if len(codes) else codes
            held += np.bincount(np.unique(linked(key % len(size), key // len(size))) % wide, minlength=len(pair)) if len(codes) else 0
            continue
        for first in range(0, len(bounds) - 1, rows):
            a, b = np.searchsorted(doc, (first, first + rows))
            seen = np.zeros(rows * wide, bool)
            seen[linked(codes[a:b], doc[a:b] - first)] = True
            held += seen.reshape(rows, wide).sum(axis=0)[: len(pair)]
    give_back()
    some = held > 0
    return pa.table({"pair": pair[some].astype(np.int32), "docs": held[some]})


def _freed(spark: SparkSession) -> None:
    """Has the driver find the shuffles that nothing reads any more, so that Spark deletes their files before the next ones are written."""
    spark.range(0).count()  # what listens to queries may hold the last one's plan, and with it its shuffles
    gc.collect()
    spark._jvm.System.gc()


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _per_document(coded: pa.Table, segments: pa.Table) -> pa.Table:
    """The sums of its segments' figures for each document, and the digest of its groups."""
    segments = _by_code(segments)
    text = segments.column("text").combine_chunks().cast(pa.large_string())
    void = text.is_null().to_numpy(zero_copy_only=False)
    figures = [pc.fill_null(segments.column(c), 0).to_numpy().astype(np.int64) for c in _SUMS]
    out = []
    for part, codes, bounds in _documents(coded):
        none = np.diff(bounds) == 0
        none |= np.diff(np.append(0, np.cumsum(void[codes]))[bounds]) > 0
        sums = [np.where(none, 0, np.diff(np.append(0, np.cumsum(f[codes]))[bounds])) for f in figures]
        body, at = text_bytes(text.take(pa.array(codes)))
        body, at = memoryview(body), at[bounds]
        digests = ["" if no else hashlib.sha256(body[a : b - 1]).hexdigest() for no, a, b in zip(none, at[:-1], at[1:], strict=True)]
        out.append(pa.table([part.column("doc_id"), *map(pa.array, sums), pa.array(digests, pa.string())], names=["doc_id", *_SUMS, "groups_sha256"]))
    give_back()
    return pa.concat_tables(out)


def chunk_of(docs: DataFrame, text: Column) -> Column:
    """A number for each row, so that chunks are about even in rows whatever the ids and texts, and bounded in bytes."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    tasks = docs.sparkSession.sparkContext.defaultParallelism
    many = max(-(-size // CHUNK_BYTES), min(4 * tasks, -(-size // (1 << 20))), 1)
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(many)).cast("int")


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row of docs: tokens of A and B, their groups and links, and how common the linked id pairs are in the corpus.

    a_path is a byte-level BPE of the `tokenizers` library, b_path a model of `sentencepiece`. A is given a blank before the
    text, which B puts there itself. Null and empty texts, and texts whose bytes one of the two doesn't keep, have zeros and
    an empty digest. Each row is a document, repeated ids and rows too; a null id stays null. Other columns are not read.
    """
    spark = docs.sparkSession
    shipped(spark)
    if a_path is None or b_path is None:
        import public_tokenizers

        a_path, b_path = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:  # vocabularies on the driver, of bounded size
        a_json, b_model = f.read(), g.read()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("chunk", chunk_of(docs, F.col(text_col)))
    tables, last = Tables(spark), Tables(spark)
    pair = TokenPair(a_json, b_model)
    coded = last.write(rows.groupBy("chunk").applyInArrow(_coder(pair.separable, pair.signs), _CODED), "align-coded")
    _freed(spark)
    texts, places = coded.where("codes is not null").select("chunk", "doc_id", "codes"), coded.where("seg is not null").select(F.col("chunk").alias("part"), "code", "seg")
    tokens = coded.where("seg is not null").select("seg").distinct().select("seg", _tokenizer(a_json, b_model)("seg").alias("t"))
    tokens = tables.write(tokens.select(F.monotonically_increasing_id().alias("seg_id"), "seg", "t.*"), "align-tokens")
    wide = pair.b.get_piece_size()
    if (max(pair.a_bytes) + 1) * wide > 1 << 31:
        raise ValueError("the two vocabularies have more than 2^31 pairs of ids")

    @F.arrow_udf(_FACTS)
    def facts(a: pa.Array, b: pa.Array, cut_a: pa.Array, cut_b: pa.Array) -> pa.Array:
        return segment_facts(a, b, cut_a, cut_b, wide)

    with _kept_partitioning(spark):
        with_cuts = tokens.select("seg_id", "seg", "a", "b").join(cuts(tokens), "seg_id").select("seg", facts("a", "b", F.col("cut.a"), F.col("cut.b")).alias("f"))
        segments = tables.write(with_cuts.select("seg", "f.*"), "align-segments")
    tables.drop(segments)
    _freed(spark)
    # The tasks of a chunk read its documents and its segments; both are bounded by the bytes of a chunk.
    in_chunks = lambda of, work, schema: texts.groupBy("chunk").cogroup(places.join(of, "seg", "left").drop("seg").groupBy("part")).applyInArrow(work, schema)
    counted = in_chunks(segments.select("seg", "pairs"), _count_pairs, "pair int, docs long")
    counts = tables.write(counted.groupBy("pair").agg(F.sum("docs").alias("docs")), "align-counts")
    a_id = F.floor(F.col("pair") / wide).cast("int")
    top = counts.groupBy(a_id.alias("a")).agg(F.max("docs").alias("top"))  # a row for each id of A at most
    # A table: Spark broadcasts it if it is small, and joins by a shuffle if it isn't.
    scored = counts.withColumn("a", a_id).join(F.broadcast(top), "a").select("pair", "docs", (F.col("docs") == F.col("top")).cast("long").alias("best"))
    scored = tables.write(scored, "align-scored")
    _freed(spark)
    linked = segments.select("seg", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("n"))))
    sums = linked.join(scored, "pair").groupBy("seg").agg(F.sum(F.col("n") * F.col("best")).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"))
    facts = last.write(segments.drop("pairs", "times").join(sums, "seg"), "align-facts")
    tables.drop()
    _freed(spark)
    return in_chunks(facts, _per_document, _RESULT)
