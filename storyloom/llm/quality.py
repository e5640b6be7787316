"""Attention-based multiple-instance learning for document quality.

A document is a bag of passages of PASSAGE words. Every passage of a whole text is encoded: shares of character classes,
word lengths, repetition, and a histogram of word hashes, through a learned layer. Gated attention weighs the passages,
learned from labels of documents only, and the weighted sum of the encodings is scored. The model is fitted on the driver
on at most `sample` labelled documents, drawn by hash; scoring needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import by_bytes, mix64, set_aside, shipped, text_bytes

#: Words of a passage, and buckets of the histogram of words.
PASSAGE, BUCKETS = 64, 32
#: Character classes: 0 space, 1 line end, 2 a-z, 3 A-Z, 4 digit, 5 marks of sentences, 6 other marks, 7 beyond ASCII.
CLASSES = np.full(256, 7, np.uint8)
CLASSES[:128] = 6
CLASSES[[32, 9, 11, 12, 13]] = 0
CLASSES[10] = 1
CLASSES[97:123], CLASSES[65:91], CLASSES[48:58] = 2, 3, 4
CLASSES[[ord(c) for c in ".,;:!?'\"()-"]] = 5
KINDS = 8
WIDTH = KINDS + 6 + BUCKETS
#: Bytes of a word that are hashed eight at a time for all words together; the rest of a longer word is hashed on its own.
STEPS = 64


def word_hashes(body: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every byte of each word."""
    value = mix64(length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    padded = np.append(body, np.zeros(8, np.uint8))
    eight = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(body) + 1,), (1,))
    some = np.arange(len(at))
    for k in range(0, STEPS, 8):
        some = some[length[some] > k]
        if not len(some):
            return value
        left = np.minimum(length[some] - k, 8)
        part = eight[at[some] + k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * (8 - left)).astype(np.uint64))
        value[some] = mix64(value[some] ^ part)
    for i in some[length[some] > STEPS]:
        rest = xxhash.xxh64_intdigest(body[at[i] + STEPS : at[i] + length[i]].tobytes())
        value[i] = mix64(value[i : i + 1] ^ np.uint64(rest))[0]
    return value


def passages(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of the texts, one text after the other, and where each text's passages begin.

    A null or empty text, or one without words, is one passage.
    """
    body, starts = text_bytes(text)
    n, size = len(starts) - 1, len(body)
    kind = CLASSES[body]
    word = kind > 1
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = starts[:-1][np.diff(starts) > 0]
    first[edges] = word[edges]
    at = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends = edges[1:] - 1
    last[ends] = word[ends]
    length = np.flatnonzero(last) + 1 - at
    doc = np.searchsorted(starts, at, side="right") - 1
    ordinal = np.arange(len(at)) - np.searchsorted(at, starts)[doc]
    counts = np.bincount(doc, minlength=n)
    number = np.maximum(-(-counts // PASSAGE), 1)
    bounds = np.append(0, np.cumsum(number))
    passage = bounds[doc] + ordinal // PASSAGE
    begin = np.zeros(bounds[-1], np.int64)
    begin[passage[::-1]] = at[::-1]
    begin[bounds[:-1]] = starts[:-1]
    end = np.append(begin[1:], size)
    out = np.zeros((bounds[-1], WIDTH), np.float32)
    some = np.flatnonzero(end > begin)
    for k in range(KINDS if len(some) else 0):
        out[some, k] = np.add.reduceat(kind == k, begin[some], dtype=np.int32)
    total = np.maximum(out[:, :KINDS].sum(axis=1), 1)
    out[:, :KINDS] /= total[:, None]
    if len(at):
        value = word_hashes(body, at, length)
        words = np.maximum(np.bincount(passage, minlength=len(out)), 1)
        again = np.zeros(len(at), bool)
        again[1:] = (value[1:] == value[:-1]) & (doc[1:] == doc[:-1])
        sums = lambda x: np.bincount(passage, weights=x, minlength=len(out))
        mean = sums(length) / words
        out[:, KINDS + 0] = words / PASSAGE * (end > begin)
        out[:, KINDS + 1] = np.minimum(mean, 50) / 10
        out[:, KINDS + 2] = np.minimum(np.sqrt(np.maximum(sums(length.astype(float) ** 2) / words - mean**2, 0)), 50) / 10
        out[:, KINDS + 3] = sums(again) / words
        out[:, KINDS + 4] = sums(kind[at] == 3) / words
        out[:, KINDS + 5] = sums(kind[at] == 2) / words
        bucket = (value % np.uint64(BUCKETS)).astype(np.int64)
        out[:, KINDS + 6 :] = np.bincount(passage * BUCKETS + bucket, minlength=len(out) * BUCKETS).reshape(-1, BUCKETS) / words[:, None]
    return out, bounds


class BagModel:
    """Passage encoder, gated attention and scorer; fitted by Adam on whole bags."""

    def __init__(self, hidden: int = 16, gate: int = 8, seed: int = 3):
        rng = np.random.default_rng(seed)
        normal = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        self.p = {"w": normal(WIDTH, hidden), "b": np.zeros(hidden), "v": normal(hidden, gate), "u": normal(hidden, gate), "a": normal(gate, 1)[:, 0], "c": normal(hidden, 1)[:, 0], "d": np.zeros(1)}
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)

    def _forward(self, x: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
        p, start = self.p, bounds[:-1]
        bag = np.repeat(np.arange(len(start)), np.diff(bounds))
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * g) @ p["a"]
        e = np.exp(e - np.maximum.reduceat(e, start)[bag])
        weight = e / np.add.reduceat(e, start)[bag]
        z = np.add.reduceat(h * weight[:, None], start, axis=0)
        score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return {"x": x, "bag": bag, "start": start, "h": h, "t": t, "g": g, "weight": weight, "z": z, "score": score}

    def _gradients(self, f: dict[str, np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        p, bag, start = self.p, f["bag"], f["start"]
        ds = (f["score"] - y) / len(y)
        dz = ds[:, None] * p["c"]
        dw = (f["h"] * dz[bag]).sum(axis=1)
        de = f["weight"] * (dw - np.add.reduceat(f["weight"] * dw, start)[bag])
        dt = de[:, None] * p["a"] * f["g"] * (1 - f["t"] ** 2)
        dg = de[:, None] * p["a"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (dz[bag] * f["weight"][:, None] + dt @ p["v"].T + dg @ p["u"].T) * (1 - f["h"] ** 2)
        return {"w": f["x"].T @ dh, "b": dh.sum(axis=0), "v": f["h"].T @ dt, "u": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ ds, "d": np.array([ds.sum()])}

    def fit(self, x: np.ndarray, bounds: np.ndarray, y: np.ndarray, epochs: int = 40, size: int = 128, rate: float = 0.01, decay: float = 1.0, seed: int = 7) -> BagModel:
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        rng, step = np.random.default_rng(seed), 0
        one, two = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for a in range(0, len(y), size):
                at = order[a : a + size]
                rows = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in at])
                grads = self._gradients(self._forward(x[rows], np.append(0, np.cumsum(np.diff(bounds)[at]))), y[at])
                step += 1
                for k, g in grads.items():
                    one[k] = 0.9 * one[k] + 0.1 * g
                    two[k] = 0.999 * two[k] + 0.001 * g * g
                    pace = rate * (1 - epoch / epochs) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
                    self.p[k] = self.p[k] * (1 - rate * decay) - pace * one[k] / (1 - 0.9**step)
        return self

    def score(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Scores of bags, from 0 to 1."""
        if len(bounds) < 2:
            return np.zeros(0)
        out, a = [], 0
        while a < len(bounds) - 1:  # some bags at a time, whose passages are held in double precision
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + 4096, side="right")) - 1)
            part = (x[bounds[a] : bounds[b]].astype(np.float64) - self.mean) / self.scale
            out.append(self._forward(np.clip(part, -8, 8), bounds[a : b + 1] - bounds[a])["score"])
            a = b
        return np.concatenate(out)


def learnable(doc_id: Column) -> Column:
    """Labels of these rows may be learned: crc32 of the id as text, modulo 3, isn't 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = 4000, bag: int = 32, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> BagModel | None:
    """A model fitted on the texts of at most `sample` labelled documents whose labels may be learned; None if there are none.

    Of a document of more than `bag` passages, that many from its whole length are learned from; scores read all of them.

    Labels other than 0 and 1 are passed over, as are labels without a document; of several for an id the least counts, and of
    several rows of an id the one whose text has the least hash.
    """
    shipped(docs.sparkSession)
    known = labels.where(learnable(F.col(id_col)) & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                x, bounds = passages(part.column("text"))
                bags = (a[np.linspace(0, len(a) - 1, min(len(a), bag)).astype(int)] for a in np.split(x, bounds[1:-1]))
                flat = pa.array([a.tobytes() for a in bags], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), flat], names=["id", "label", "passages"])

    # `sample` rows at most are broadcast, and as many documents' features fetched, one for each id.
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.struct(F.xxhash64(text_col), F.col(text_col).alias("text")).alias("one"))
    texts = texts.join(F.broadcast(known.withColumn("label", F.col("label").cast("int"))), "id").groupBy("id").agg(F.min("one").alias("one"), F.min("label").alias("label")).select("id", "label", "one.text")
    rows = sorted(texts.mapInArrow(encode, "id long, label int, passages binary").collect(), key=lambda r: (r["id"], r["passages"]))
    if not rows:
        return None
    bags = [np.frombuffer(r["passages"], np.float32).reshape(-1, WIDTH) for r in rows]
    return BagModel().fit(np.concatenate(bags).astype(np.float64), np.append(0, np.cumsum([len(b) for b in bags])), np.array([r["label"] for r in rows], float))


def scored(docs: DataFrame, labels: DataFrame, sample: int = 4000, bag: int = 32, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", score_col: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 for every whole text; higher means that label 1 is likelier.

    Null and empty texts are scored as one passage without words. Without a label to learn from, every score is 0.5.
    Rows that repeat score alike; other columns pass through, one of the score's name as {name}_in.
    """
    model = fitted(docs, labels, sample, bag, id_col, text_col, label_col)  # some thousand numbers, which go with the function

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            out = []
            for part in by_bytes(pa.RecordBatch.from_arrays([text], names=["text"]), "text"):
                x, bounds = passages(part.column("text"))
                out.append(model.score(x, bounds) if model else np.full(len(bounds) - 1, 0.5))
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return set_aside(docs, score_col).withColumn(score_col, score(F.col(text_col)))
