"""Byte-level BPE encoding and decoding with DuckDB recursive queries, one database per Python worker.

A text is cut into chunks (a run of white space with what follows it up to the next), which no match of the
pre-tokeniser's pattern crosses. Only distinct chunks of a slice of rows are matched and only distinct pieces are
encoded: their token-position rows join the merge table, each word's leftmost pair of least rank is contracted, and
so on until no word has a pair left. Ordered aggregation gives back a word's ids and, joined with the vocabulary,
its bytes. Words of more than LONG bytes contract every occurrence of their least pair that comes before any new
pair of a lesser rank, in the same order as one at a time, so that a long run takes few rounds.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import by_bytes, give_back, shipped, text_bytes

#: Bytes above which a word takes the query for long ones;  words encoded by one query;  chunks that are Python strings at once.
LONG, WORDS, CHUNKS = 48, 30_000, 20_000
#: Words of at most LONG bytes whose ids and bytes a worker keeps, as Arrow arrays, for its next slices; all others are encoded anew.
KNOWN = 200_000
#: White space beyond ASCII as its last three UTF-8 bytes (0: any), and the range of the last one.
WIDE_SPACES = ((0, 0xC2, 0x85, 0x85), (0, 0xC2, 0xA0, 0xA0), (0xE1, 0x9A, 0x80, 0x80), (0xE2, 0x80, 0x80, 0x8A), (0xE2, 0x80, 0xA8, 0xA9), (0xE2, 0x80, 0xAF, 0xAF), (0xE2, 0x81, 0x9F, 0x9F), (0xE3, 0x80, 0x80, 0x80))

#: A row is a token with where the next one begins and what it is; a merged pair's second row goes, its neighbours are linked anew.
ENCODE = """
INSERT INTO tokens
WITH RECURSIVE state(step, word, pos, token, next, following) AS (
    SELECT 0, word, pos, token, lead(pos) OVER w, lead(token) OVER w FROM start WINDOW w AS (PARTITION BY word ORDER BY pos)
  UNION ALL (
    WITH least AS MATERIALIZED (
        SELECT s.word, min(m.token::BIGINT * 65536 + s.pos * 256 + s.next) AS best
        FROM state s JOIN merges m ON m.a = s.token AND m.b = s.following GROUP BY s.word
    ), merged AS (
        SELECT l.word, (l.best // 65536)::INTEGER AS token, (l.best // 256 % 256)::INTEGER AS pos, (l.best % 256)::INTEGER AS gone, s.next, s.following
        FROM least l JOIN state s ON s.word = l.word AND s.pos = l.best % 256
    )
    SELECT s.step + 1, s.word, s.pos, CASE WHEN s.pos = m.pos THEN m.token ELSE s.token END, CASE WHEN s.pos = m.pos THEN m.next ELSE s.next END,
        CASE WHEN s.pos = m.pos THEN m.following WHEN s.next = m.pos THEN m.token ELSE s.following END
    FROM state s JOIN merged m ON m.word = s.word WHERE s.pos <> m.gone
  )
)
SELECT s.word + $first, s.pos, s.token
FROM state s JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) l ON l.word = s.word AND l.step = s.step
"""

#: One step for words of many bytes. `chosen` are the occurrences that don't overlap; a merge whose new pairs rank lower ends the step.
LONG_STEP = """
CREATE OR REPLACE TEMP TABLE after AS
WITH pairs AS (
    SELECT word, pos, token, lead(token) OVER w AS following, lead(token, 2) OVER w AS beyond, lag(token) OVER w AS previous, row_number() OVER w AS nr
    FROM state WINDOW w AS (PARTITION BY word ORDER BY pos)
), ranked AS (
    SELECT p.*, m.token AS rank, min(m.token) OVER (PARTITION BY p.word) AS least
    FROM pairs p LEFT JOIN merges m ON m.a = p.token AND m.b = p.following
), runs AS (
    SELECT *, nr - row_number() OVER (PARTITION BY word ORDER BY pos) AS run FROM ranked WHERE rank = least
), chosen AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word, run ORDER BY pos) AS place FROM runs) WHERE place % 2 = 1
), around AS (
    SELECT c.*, lag(c.nr) OVER (PARTITION BY c.word ORDER BY c.pos) = c.nr - 2 AS adjoining FROM chosen c
), stop AS (
    SELECT a.word, min(a.pos) AS pos
    FROM around a
    LEFT JOIN merges l ON l.a = CASE WHEN a.adjoining THEN a.rank ELSE a.previous END AND l.b = a.rank
    LEFT JOIN merges r ON r.a = a.rank AND r.b = a.beyond
    WHERE l.token < a.rank OR r.token < a.rank
    GROUP BY a.word
), taken AS (
    SELECT c.word, c.pos, c.nr, c.rank FROM chosen c LEFT JOIN stop s ON s.word = c.word WHERE s.pos IS NULL OR c.pos <= s.pos
)
SELECT p.word, p.pos, coalesce(t.rank, p.token) AS token, p.word IN (SELECT word FROM taken) AS active
FROM pairs p
LEFT JOIN taken t ON t.word = p.word AND t.nr = p.nr
LEFT JOIN taken g ON g.word = p.word AND g.nr = p.nr - 1
WHERE g.nr IS NULL
"""

IDS = """
SELECT word, count(*) AS n, string_agg(token::VARCHAR, ' ' ORDER BY pos) AS ids FROM tokens GROUP BY word ORDER BY word
"""

DECODE = """
SELECT t.word, from_hex(string_agg(v.hex, '' ORDER BY t.pos)) AS bytes
FROM tokens t JOIN vocabulary v ON v.token = t.token GROUP BY t.word ORDER BY t.word
"""


class Codec:
    """Vocabulary and merge table in a DuckDB of its own; encodes and decodes words.

    ranks maps token bytes to ids. Every way to put a token together from two others is a row of the merge table.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.known: dict[bool, list[pa.Array]] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "preserve_insertion_order": False})
        a, b, token = [], [], []
        for word, rank in ranks.items():
            for cut in range(1, len(word)):
                left, right = ranks.get(word[:cut]), ranks.get(word[cut:])
                if left is not None and right is not None:
                    a.append(left)
                    b.append(right)
                    token.append(rank)
        merges = pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "token": pa.array(token, pa.int32())})
        vocabulary = pa.table({"token": pa.array(ranks.values(), pa.int32()), "hex": pa.array([w.hex() for w in ranks])})
        for name, table in (("merges", merges), ("vocabulary", vocabulary)):
            self._give("given", table)
            self._do(f"CREATE TABLE {name} AS FROM given")
            self.db.unregister("given")
        self.single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        self._do("CREATE TABLE tokens (word INTEGER, pos INTEGER, token INTEGER)")

    def _do(self, query: str) -> list[tuple]:
        """Runs a statement to its end: a result that isn't read out would block the next one."""
        rows = self.db.execute(query).fetchall()
        self.db.complete()
        return rows

    def _give(self, name: str, table: pa.Table) -> None:
        self.db.complete()
        self.db.register(name, table)

    def _start(self, words: list[bytes]) -> pa.Table:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        body = np.frombuffer(b"".join(words), np.uint8)
        pos = np.arange(len(body)) - np.repeat(ends - sizes, sizes)
        token = self.single[body]
        if len(token) and token.min() < 0:
            raise ValueError("the vocabulary lacks single bytes")
        return pa.table({"word": np.repeat(np.arange(len(words), dtype=np.int32), sizes), "pos": pos.astype(np.int32), "token": token})

    def _encode(self, words: list[bytes]) -> None:
        """Fills the table of tokens: each word's position in the list, its tokens and where they begin."""
        self._do("DELETE FROM tokens")
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        short = [*np.flatnonzero((sizes > 0) & (sizes <= LONG)), *np.flatnonzero(sizes > LONG)]
        n = int((sizes > 0).sum() - (sizes > LONG).sum())
        for k in range(0, n, WORDS):
            part = short[k : min(k + WORDS, n)]
            self._give("start", self._start([words[i] for i in part]))
            self._do(ENCODE.replace("$first", str(k)))
        first = n
        while first < len(short):  # long words, about a million bytes at a time
            end = first + max(1, int(np.searchsorted(np.cumsum(sizes[short[first:]]), 1 << 20, side="right")))
            self._give("start", self._start([words[i] for i in short[first:end]]))
            self._long(first)
            first = end
        self._give("given", pa.table({"word": np.arange(len(short), dtype=np.int32), "own": np.array(short, np.int32)}))
        self._do("CREATE OR REPLACE TABLE tokens AS SELECT g.own AS word, t.pos, t.token FROM tokens t JOIN given g ON g.word = t.word")

    def _long(self, first: int) -> None:
        self._do("CREATE OR REPLACE TEMP TABLE state AS FROM start")
        while self._do("SELECT count(*) FROM state")[0][0]:
            self._do(LONG_STEP)
            self._do(f"INSERT INTO tokens SELECT word + {first}, pos, token FROM after WHERE NOT active")
            self._do("CREATE OR REPLACE TEMP TABLE state AS SELECT word, pos, token FROM after WHERE active")

    def _all(self, query: str, words: int, **empty: pa.Scalar) -> list[pa.Array]:
        """Columns of a query that has a row for each word with tokens, by word; `empty` for the others."""
        self.db.complete()
        got = self.db.sql(query).to_arrow_table()
        at = np.full(words, -1)
        at[got["word"].to_numpy()] = np.arange(len(got))
        nr = pa.array(at, mask=at < 0)
        return [got[c].cast(x.type).combine_chunks().take(nr).fill_null(x) for c, x in empty.items()]

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word."""
        self._encode(words)
        (ids,) = self._all(IDS, len(words), ids=pa.scalar("", pa.string()))
        return [[int(x) for x in i.split()] for i in ids.to_pylist()]

    def decode(self, ids: list[list[int]]) -> list[bytes]:
        """The bytes of each list of ids; an id beyond the vocabulary is refused."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for y in ids for x in y), np.int32, int(sizes.sum()))
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self._give("given", pa.table({"word": np.repeat(np.arange(len(ids), dtype=np.int32), sizes), "pos": pos.astype(np.int32), "token": flat}))
        self._do("CREATE OR REPLACE TABLE tokens AS FROM given")
        lost = self._do("SELECT min(token) FROM tokens WHERE token NOT IN (SELECT token FROM vocabulary)")[0][0]
        if lost is not None:
            raise ValueError(f"no token has the id {lost}")
        return self._all(DECODE, len(ids), bytes=pa.scalar(b"", pa.binary()))[0].to_pylist()

    def pieces(self, words: list[str] | pa.Array, decoding: bool = True) -> tuple[np.ndarray, pa.Array, pa.Array | None]:
        """For each word: how many ids, the ids in decimal joined by spaces, and, if wanted, the bytes that its ids decode to.

        New words are encoded WORDS at a time, so that memory doesn't grow with how many of a slice's words are new.
        """
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.large_string())
        known = self.known.setdefault(decoding, [pa.array([], t) for t in (pa.large_string(), pa.int64(), pa.binary(), *[pa.binary()] * decoding)])
        at = pc.index_in(words, value_set=known[0])
        lacks = pc.is_null(at)
        new = words.filter(lacks)
        made = [known]
        for k in range(0, len(new), WORDS):
            part = new.slice(k, WORDS)
            self._encode([w.encode() for w in part.to_pylist()])
            n, ids = self._all(IDS, len(part), n=pa.scalar(0, pa.int64()), ids=pa.scalar("", pa.string()))
            decoded = self._all(DECODE, len(part), bytes=pa.scalar(b"", pa.binary())) if decoding else []
            made.append([part, n, ids.cast(pa.binary()), *decoded])
        every = [pa.concat_arrays(x) for x in zip(*made, strict=True)]
        if len(new) and len(known[0]) < KNOWN:
            short = pc.indices_nonzero(pc.less_equal(pc.binary_length(every[0]), LONG))[:KNOWN]
            self.known[decoding] = [x.take(short) for x in every]
        place = at.to_numpy(zero_copy_only=False).astype(np.float64)
        place[lacks.to_numpy(zero_copy_only=False)] = len(known[0]) + np.arange(len(new))
        n, ids, *decoded = (x.take(pa.array(place.astype(np.int64))) for x in every[1:])
        return n.to_numpy(), ids, decoded[0] if decoding else None


def chunk_starts(body: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where texts, and inside them chunks, begin: at ASCII white space after anything that is no white space."""
    if not len(body):
        return np.zeros(0, np.int64)
    space = (body == 32) | ((body >= 9) & (body <= 13))
    cut = np.zeros(len(body), bool)
    cut[1:] = space[1:] & ~space[:-1]
    at = np.flatnonzero(cut)
    wide = at[(body[at - 1] >= 0x80) & (at >= 2)]
    one, two, three = body[wide - 1], body[wide - 2], body[np.maximum(wide - 3, 0)]
    for x, y, low, high in WIDE_SPACES:
        cut[wide[(two == y) & (one >= low) & (one <= high) & ((x == 0) | (three == x))]] = False
    cut[starts[:-1][np.diff(starts) > 0]] = True
    return np.flatnonzero(cut)


class _Coded:
    """A slice's texts cut into chunks, of which the distinct ones are cut into words, of which the distinct ones are encoded.

    Words of chunk i are `nr[inside[i] : inside[i + 1]]`, chunks of text i are `chunk[bounds[i] : bounds[i + 1]]`; `count` is the number of
    ids of each text.
    """

    def __init__(self, codec: Codec, text: pa.Array, decoding: bool):
        body, starts = text_bytes(text)
        at = chunk_starts(body, starts)
        offsets = pa.array(np.append(at, len(body)).astype(np.int64))
        coded = pa.LargeStringArray.from_buffers(len(at), offsets.buffers()[1], pa.py_buffer(body)).dictionary_encode()
        sizes, found = [np.zeros(1, np.int64)], [pa.array([], pa.large_string())]
        for k in range(0, len(coded.dictionary), CHUNKS):
            some = [codec.pattern.findall(c) for c in coded.dictionary.slice(k, CHUNKS).to_pylist()]
            sizes.append(np.fromiter(map(len, some), np.int64, len(some)))
            found.append(pa.array([w for f in some for w in f], pa.large_string()))
        words = pa.concat_arrays(found).dictionary_encode()
        self.n, self.ids, self.decoded = codec.pieces(words.dictionary, decoding)
        self.size, self.nr, self.chunk = len(body), words.indices, coded.indices
        self.inside = np.cumsum(np.concatenate(sizes))
        self.per_chunk = np.append(0, np.cumsum(self.n[self.nr.to_numpy(zero_copy_only=False)]))[self.inside]
        self.bounds = np.searchsorted(at, starts)
        self.count = np.diff(np.append(0, np.cumsum(np.diff(self.per_chunk)[self.chunk.to_numpy(zero_copy_only=False)]))[self.bounds])

    def joined(self, values: pa.Array, by: bytes) -> list[bytes]:
        """Of each text the values of its words, joined."""
        chunk = pc.binary_join(pa.ListArray.from_arrays(pa.array(self.inside.astype(np.int32)), values.take(self.nr)), pa.scalar(by, pa.binary()))
        if self.size > 100 << 20:  # one text so long that Arrow's offsets could run over
            parts, of = chunk.to_pylist(), self.chunk.to_pylist()
            return [by.join([parts[i] for i in of[a:b]]) for a, b in zip(self.bounds[:-1], self.bounds[1:], strict=True)]
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(self.bounds.astype(np.int32)), chunk.take(self.chunk)), pa.scalar(by, pa.binary())).to_pylist()

    def listed(self) -> pa.Array:
        """Of each text its ids; numbers are read once for each distinct word."""
        flat = np.fromstring(b" ".join(x for x in self.ids.to_pylist() if x), np.int32, sep=" ")
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(self.n)).astype(np.int32)), pa.array(flat, pa.int32()))
        chunk = pa.ListArray.from_arrays(pa.array(self.per_chunk.astype(np.int32)), lists.take(self.nr).flatten())
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(self.count)).astype(np.int32)), chunk.take(self.chunk).flatten())


_codecs: dict[str, Codec] = {}


def _codec(lines: bytes, pattern: str) -> Codec:
    """This worker's codec for a rank file; made once."""
    key = hashlib.sha256(lines + pattern.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x.strip())}, pattern)
    return _codecs[key]


def _shared(spark: SparkSession, path: str | None, pattern: str | None):
    shipped(spark)
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    with open(path, "rb") as f:  # a vocabulary on the driver, of bounded size
        return spark.sparkContext.broadcast((f.read(), pattern))


def encode_digests(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_tokens, ids_sha256 (of the decimal ids joined by one space) and decoded_sha256 (of the bytes decoded).

    Null and empty texts have no ids, and the digests of the empty string. Rows that repeat come out as often; a null id
    stays null. No row is shuffled.
    """
    rank_file = _shared(docs.sparkSession, path, pattern)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*rank_file.value)
        for batch in batches:
            for part in by_bytes(batch, "text", 6 << 20):  # the more words, the fewer of them new
                coded = _Coded(codec, part.column("text"), True)
                hexes = [[hashlib.sha256(x).hexdigest() for x in coded.joined(*y)] for y in ((coded.ids, b" "), (coded.decoded, b""))]
                out = pa.RecordBatch.from_arrays([part.column("id"), pa.array(coded.count), *(pa.array(x, pa.string()) for x in hexes)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
                del coded
                give_back()
                yield out

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def encode_texts(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_tokens and ids as array<int>; null and empty texts have an empty array."""
    rank_file = _shared(docs.sparkSession, path, pattern)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*rank_file.value)
        for batch in batches:
            for part in by_bytes(batch, "text", 2 << 20):
                coded = _Coded(codec, part.column("text"), False)
                out = pa.RecordBatch.from_arrays([part.column("id"), pa.array(coded.count), coded.listed()], names=["id", "n_tokens", "ids"])
                del coded
                give_back()
                yield out

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, n_tokens long, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(rows: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and bytes, what its ids decode to; null or empty ids give no bytes."""
    rank_file = _shared(rows.sparkSession, path, pattern)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*rank_file.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = codec.decode([x or [] for x in part.column("ids").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(texts, pa.binary())], names=["id", "bytes"])

    rows = rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, bytes binary").withColumnRenamed("id", id_col)
