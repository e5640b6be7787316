"""FTRL-proximal logistic regression over hashed word n-grams and skip-grams, for toxicity.

A word is a run of letters, digits and bytes beyond ASCII, in lower case. The grams of a text are its words, their stems (the
first four and five bytes of a longer word), pairs of neighbours, and pairs that skip one or two words, hashed into DIM buckets; a gram
counts once for a text, however often it stands there. FTRL-proximal learns with a rate for each coordinate, and its L1 term
leaves most weights at zero. What is left, some thousand numbers, goes with the scoring function; scoring needs no shuffle.

The model is fitted on the driver on at most `sample` labelled documents, half of them of each label at most, drawn by hash of
the id; the labels' shares among all labelled documents weigh the two halves. Each is one row, and at most `grams` of its grams
are learned from: words and stems first, then pairs in order of their hash. Scores read every gram of every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import by_bytes, mix64, set_aside, shipped, text_bytes
from storyloom.llm.quality import word_hashes

DIM = 1 << 20
#: Bytes of stems, and words from the first to the second of a pair; each has a salt, after that of words.
STEMS, GAPS = (4, 5), (1, 2, 3)
_SALT = mix64(np.arange(1, 2 + len(STEMS) + len(GAPS), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
WORDLIKE = np.zeros(256, bool)
WORDLIKE[128:] = True
WORDLIKE[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def grams(text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each kind of gram, its number, the text each gram is of and its bucket; texts in order, grams repeat."""
    body, starts = text_bytes(pc.utf8_lower(text.cast(pa.large_string())))
    word = WORDLIKE[body]
    edges = starts[:-1][np.diff(starts) > 0]
    first = word.copy()
    first[1:] &= ~word[:-1]
    first[edges] = word[edges]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[edges[1:] - 1] = word[edges[1:] - 1]
    at = np.flatnonzero(first)
    length = np.flatnonzero(last) + 1 - at
    doc = np.searchsorted(starts, at, side="right") - 1
    whole = word_hashes(body, at, length)
    bucket = lambda value: (mix64(value) & np.uint64(DIM - 1)).astype(np.int64)
    yield 0, doc, bucket(whole ^ _SALT[0])
    for kind, stem in enumerate(STEMS, 1):
        long = length > stem
        yield kind, doc[long], bucket(word_hashes(body, at[long], np.full(int(long.sum()), stem)) ^ _SALT[kind])
    for kind, gap in enumerate(GAPS, 1 + len(STEMS)):
        same = doc[gap:] == doc[:-gap]
        with np.errstate(over="ignore"):
            pair = mix64(whole[:-gap][same]) * np.uint64(3) + whole[gap:][same]
        yield kind, doc[gap:][same], bucket(pair ^ _SALT[kind])


class Ftrl:
    """FTRL-proximal with a rate for each coordinate; grams are present or not, and the last coordinate is always present."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 12.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(DIM + 1), np.zeros(DIM + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: float, weight: float) -> None:
        w, n = self.weights(at), self.n[at]
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label) * weight
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] += g * g

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, epochs: int = 10, seed: int = 11) -> Model:
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                self.learn(np.append(rows[i], DIM), labels[i], weights[i])
        w = self.weights(slice(None))
        some = np.flatnonzero(w[:DIM])
        return Model(some.astype(np.int32), w[some].astype(np.float32), float(w[DIM]))


class Model:
    """The weights that are not zero, by bucket, and the bias."""

    def __init__(self, at: np.ndarray, weight: np.ndarray, bias: float):
        self.at, self.weight, self.bias, self._dense = at, weight, bias, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_dense": None}

    def score(self, text: pa.Array) -> np.ndarray:
        """Scores from 0 to 1 of whole texts."""
        if self._dense is None:
            self._dense = np.zeros(DIM, np.float32)
            self._dense[self.at] = self.weight
        held = [(doc[w], b[w]) for _, doc, b in grams(text) for w in [self._dense[b] != 0]]
        key = np.unique(np.concatenate([doc * DIM + b for doc, b in held])) if held else np.zeros(0, np.int64)
        total = np.bincount(key // DIM, weights=self._dense[key % DIM], minlength=len(text)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def learnable(doc_id: Column) -> Column:
    """Labels of these rows may be learned: crc32 of the id as text, modulo 4, isn't 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = 8000, grams_kept: int = 8192, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """The weights learned from labels that may be learned; None if none has a document.

    Labels other than 0 and 1 are passed over, as are labels without a document; of several for an id the least counts, and
    of several rows of an id the one whose text has the least hash.
    """
    shipped(docs.sparkSession)
    known = labels.where(learnable(F.col(id_col)) & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    shares = dict(known.groupBy("label").count().collect())  # two rows at most
    drawn = [known.where(F.col("label") == v).orderBy(F.xxhash64("id"), "id").limit(sample // 2) for v in (0, 1)]
    known = drawn[0].unionAll(drawn[1])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                found = [np.unique(doc * DIM + b) + (k << 52) for k, doc, b in grams(part.column("text"))]
                doc = np.concatenate([(f >> 20) & 0xFFFFFFFF for f in found])
                order = np.argsort(doc, kind="stable")  # kinds stay in their order
                doc, value = doc[order], (np.concatenate(found)[order] & (DIM - 1)).astype(np.int32)
                bounds = np.searchsorted(doc, np.arange(part.num_rows + 1))
                flat = [np.unique(value[a : min(b, a + grams_kept)]).tobytes() for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array(flat, pa.binary())], names=["id", "label", "grams"])

    # `sample` rows at most are broadcast, and as many documents' grams fetched.
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.struct(F.xxhash64(text_col), F.col(text_col).alias("text")).alias("one"))
    texts = texts.join(F.broadcast(known), "id").groupBy("id").agg(F.min("one").alias("one"), F.min("label").alias("label")).select("id", "label", "one.text")
    rows = sorted(texts.mapInArrow(encode, "id long, label int, grams binary").collect(), key=lambda r: r["id"])
    if not rows:
        return None
    label = np.array([r["label"] for r in rows])
    held = np.bincount(label, minlength=2)
    weight = np.array([shares.get(v, 0) / max(held[v], 1) for v in (0, 1)])[label]
    return Ftrl().fit([np.frombuffer(r["grams"], np.int32) for r in rows], label.astype(float), weight / weight.mean())


def scored(docs: DataFrame, labels: DataFrame, sample: int = 8000, grams_kept: int = 8192, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", score_col: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 for every whole text; higher means that label 1 is likelier.

    Null and empty texts have no grams; the bias alone scores them. Without a label to learn from, every score is 0.5. Rows that
    repeat score alike; other columns pass through, one of the score's name as {name}_in.
    """
    model = fitted(docs, labels, sample, grams_kept, id_col, text_col, label_col)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            parts = by_bytes(pa.RecordBatch.from_arrays([text], names=["text"]), "text")
            out = [model.score(p.column("text")) if model else np.full(p.num_rows, 0.5) for p in parts]
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return set_aside(docs, score_col).withColumn(score_col, score(F.col(text_col)))
