"""Exam scoring around a pluggable scorer of spans. The default is an add-k byte bigram model, counted by batches of texts.

No row is ever made for a byte: counts and spans are vectors over an Arrow batch. A scorer is any function of (ids, starts, given):
all tokens one after the other, where each span begins, and for each span how many of its tokens only give context; it
returns the sum of the log-likelihoods of each span's other tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.functions.workers import shipped

#: The bytes a model knows, its smoothing, the end of a story and the tokens a scorer sees at most.
VOCABULARY, SMOOTHING, END, BLOCK = 256, 1.0, 0, 1024
#: Bytes of text that are worked on at once.
SLICE = 4 << 20

Scorer = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
#: A tokenizer: the ids of a text.
Encode = Callable[[str], np.ndarray]


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about SLICE bytes in a column; a longer row is a part of its own."""
    sizes = np.array([len(x.as_buffer() or b"") if x.is_valid else 0 for x in batch.column(column)], np.int64)
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), SLICE, side="right")))
        yield batch.slice(at, n)
        at += n


def _pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of all bytes but NUL of the texts, each with the one before it (END before the first): the pair's number, and its text."""
    parts = [x.as_buffer().to_pybytes().replace(b"\0", b"") if x.is_valid else b"" for x in texts]
    body = np.frombuffer(b"\0" + b"\0".join(parts), np.uint8)
    owner = np.repeat(np.arange(len(parts)), [len(p) + 1 for p in parts])
    some = np.flatnonzero(body[1:]) + 1
    return body[some - 1].astype(np.int32) * VOCABULARY + body[some], owner[some]


def bigrams(texts: DataFrame, key: list[str], column: str) -> DataFrame:
    """(key, prev, next, c): how often each pair of bytes occurs, the end token before the first. key: at most one column."""
    kinds = ", ".join(f"{k} {texts.schema[k].dataType.simpleString()}" for k in key)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, column):
                pair, owner = _pairs(part.column(column))
                groups = part.column(key[0]).dictionary_encode() if key else None
                of = groups.indices.to_numpy(zero_copy_only=False)[owner].astype(np.int64) if key else np.zeros(len(pair), np.int64)
                found, n = np.unique(of * VOCABULARY**2 + pair, return_counts=True)
                columns = [groups.dictionary.take(pa.array(found // VOCABULARY**2))] if key else []
                pair = found % VOCABULARY**2
                columns += [pa.array((pair // VOCABULARY).astype(np.int32)), pa.array((pair % VOCABULARY).astype(np.int32)), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=[*key, "prev", "next", "c"])

    shipped(texts.sparkSession)
    rows = texts.where(" and ".join(f"{k} is not null" for k in [*key, column])).select(*key, column)
    counted = rows.mapInArrow(count, ", ".join(x for x in (kinds, "prev int, next int, c long") if x))
    return counted.groupBy(*key, "prev", "next").agg(F.sum("c").alias("c"))


def bigram_model(texts: DataFrame, column: str, k: float = SMOOTHING) -> DataFrame:
    """(prev, next, logp): at most VOCABULARY squared rows; pairs not seen have the row of next null."""
    counts = bigrams(texts, [], column)
    totals = counts.groupBy("prev").agg(F.sum("c").alias("t"))
    logp = lambda c: F.log((c + k) / (F.col("t") + k * VOCABULARY))
    seen = counts.join(totals, "prev").select("prev", "next", logp(F.col("c")).alias("logp"))
    return seen.unionByName(totals.select("prev", F.lit(None).cast("int").alias("next"), logp(F.lit(0)).alias("logp")))


def bigram_scorer(model: DataFrame) -> Scorer:
    """The scorer of a bigram model, whose rows (fixed by the bytes there are) are fetched."""
    table = np.full((VOCABULARY, VOCABULARY), -np.log(float(VOCABULARY)))
    rows = model.collect()
    for r in rows:
        if r["next"] is None:
            table[r["prev"]] = r["logp"]
    for r in rows:
        if r["next"] is not None:
            table[r["prev"], r["next"]] = r["logp"]

    def score(ids: np.ndarray, starts: np.ndarray, given: np.ndarray) -> np.ndarray:
        logp = np.concatenate([[0.0], table[ids[:-1], ids[1:]], [0.0]])
        begin, end = starts + given, np.append(starts[1:], len(ids))
        sums = np.add.reduceat(logp, np.stack([begin, end], axis=1).ravel())[::2]
        return np.where(begin < end, sums, 0.0)

    return score


def perplexity(texts: DataFrame, model: DataFrame, by: str, column: str) -> DataFrame:
    """(by, n_tokens, loss): the sum of all losses by the sum of all tokens, never a mean of means."""
    pairs = bigrams(texts, [by], column)
    seen = F.broadcast(model.where("next is not null"))  # VOCABULARY squared rows at most
    rest = F.broadcast(model.where("next is null").select("prev", F.col("logp").alias("unseen")))
    out = pairs.join(seen, ["prev", "next"], "left").join(rest, "prev", "left")
    logp = F.coalesce("logp", "unseen", F.lit(-1.0) * F.log(F.lit(float(VOCABULARY))))
    return out.groupBy(by).agg(F.sum("c").alias("n_tokens"), (-F.sum(F.col("c") * logp) / F.sum("c")).alias("loss"))


def windows(n_tokens: Column, block: int) -> Column:
    """Lengths of a story's windows of `block` tokens; a last one of fewer than two is dropped."""
    starts = F.sequence(F.lit(0), F.greatest(n_tokens - 1, F.lit(0)), F.lit(block))
    return F.filter(F.transform(starts, lambda s: F.least(F.lit(block), n_tokens - s)), lambda n: n >= 2)


def window_spans(tokens: list[np.ndarray], block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts' tokens, each cut into windows of `block` that don't overlap, those of two tokens or more: ids, starts, and whose each is."""
    size = np.array([len(x) for x in tokens], np.int64)
    ids = np.concatenate([*tokens, np.zeros(0, np.int64)]).astype(np.int64)
    count = -(-size // block)
    owner = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(block, size[owner] - nth * block)
    lone = (np.cumsum(size) - size)[owner] + nth * block
    kept = np.ones(len(ids), bool)
    kept[lone[length < 2]] = False
    owner, length = owner[length >= 2], length[length >= 2]
    return ids[kept], np.cumsum(length) - length, owner


def windowed_perplexity(texts: DataFrame, scorer: Scorer, by: str, column: str, block: int = BLOCK, encode: Encode | None = None) -> DataFrame:
    """(by, n_tokens, loss): the loss by a scorer of every token in every window of every text, but each window's first.

    A text's windows are of `block` tokens and don't overlap; one of fewer than two tokens predicts nothing. The sum over a
    group is divided by its tokens: no mean of means. A group without a window has 0 tokens and NaN. Null texts have no tokens.
    """
    kind, cut = texts.schema[by].dataType.simpleString(), encode or _bytes

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, column):
                ids, starts, owner = window_spans([np.asarray(cut(x or "")) for x in part.column(column).to_pylist()], block)
                sums = scorer(ids, starts, np.ones(len(starts), np.int64)) if len(starts) else np.zeros(0)
                groups = part.column(by).dictionary_encode("encode")
                of = groups.indices.to_numpy(zero_copy_only=False)
                n = np.bincount(of[owner], weights=np.diff(np.append(starts, len(ids))) - 1, minlength=len(groups.dictionary))
                yield pa.RecordBatch.from_arrays([groups.dictionary, pa.array(n.astype(np.int64)), pa.array(np.bincount(of[owner], weights=sums, minlength=len(n)).astype(float))], names=[by, "n", "logp"])

    shipped(texts.sparkSession)
    rows = texts.select(by, column).mapInArrow(score, f"{by} {kind}, n long, logp double").groupBy(by).agg(F.sum("n").alias("n_tokens"), F.sum("logp").alias("logp"))
    return rows.select(by, "n_tokens", F.when(F.col("n_tokens") > 0, -F.col("logp") / F.col("n_tokens")).otherwise(float("nan")).alias("loss"))


def truncated_left(ids: np.ndarray, start: int, block: int = BLOCK) -> tuple[np.ndarray, int]:
    """The last `block` tokens, and where a span that began at `start` begins in them: never before the second one."""
    cut = max(0, len(ids) - block)
    return ids[cut:], max(1, start - cut)


def _scored(spans: list[tuple[np.ndarray, int]], scorer: Scorer) -> np.ndarray:
    """Sums of spans (tokens, where the scored ones begin), a slice at a time: a score doesn't hang on what is scored with it."""
    out, at = [], 0
    sizes = np.cumsum([len(x) for x, _ in spans])
    while at < len(spans):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE, side="right")))
        part = spans[at:end]
        starts = np.cumsum([0, *(len(x) for x, _ in part[:-1])])
        out.append(scorer(np.concatenate([x for x, _ in part]).astype(np.int64), starts, np.array([g for _, g in part])))
        at = end
    return np.concatenate(out) if out else np.zeros(0)


def _bytes(text: str) -> np.ndarray:
    """The evaluator's tokens: all bytes, NUL too."""
    return np.frombuffer(text.encode(), np.uint8)


def _tail(text: str, block: int) -> str:
    """The end of a text with a mask that holds its last `block` bytes whatever takes the place of the mask, even nothing."""
    size, cut = len(T.MASK), max(0, len(text) - max(block, 2) - len(T.MASK))
    while cut and (len(text) - cut - size * text.count(T.MASK, cut) < max(block, 2) or T.MASK in text[max(0, cut - size) : cut + size]):
        cut = max(0, cut - block)
    return text[cut:]


def _at_least_two(ids: np.ndarray) -> np.ndarray:
    """Tokens, filled up with END to two, so that there is one to score."""
    return ids if len(ids) > 1 else np.append(ids, np.full(2 - len(ids), END))


def option_scores(items: DataFrame, scorer: Scorer, block: int = BLOCK, key: tuple[str, ...] = ("phase", "story_id"), encode: Encode | None = None, end: int = END, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carry, at, conditional, baseline): log-likelihood of each option after the prefix and after the end of a story.

    Prefix and option are read as one text; what comes after the prefix's tokens is the span, at least the last token and never
    the first. Both sequences keep their last `block` tokens.
    """
    cut, kept = encode or _bytes, (*key, *carry)
    kinds = ", ".join(f"{k} {items.schema[k].dataType.simpleString()}" for k in kept)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, "prefix"):
                after, alone, owner, at = [], [], [], []
                for i, (prefix, options) in enumerate(zip(part.column("prefix").to_pylist(), part.column("options").to_pylist(), strict=True)):
                    if encode is None and prefix:  # bytes: the prefix's are the same before every option, and no more than the last can be seen
                        mine = cut(prefix)[-max(block, 2):]
                        prefix_tokens, both = len(mine), [np.concatenate([mine, cut(o)]) for o in options]
                    else:
                        prefix_tokens, both = len(cut(prefix)), [cut(prefix + o) for o in options]
                    for j, ids in enumerate(map(_at_least_two, both)):
                        start = max(1, min(prefix_tokens, len(ids) - 1))
                        after.append(truncated_left(ids, start, block))
                        alone.append(truncated_left(np.append(end, ids[start:]), 1, block))
                        owner.append(i)
                        at.append(j)
                columns = [part.column(k).take(pa.array(owner, pa.int64())) for k in kept]
                columns += [pa.array(at, pa.int32()), pa.array(_scored(after, scorer).round(9)), pa.array(_scored(alone, scorer).round(9))]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "at", "conditional", "baseline"])

    shipped(items.sparkSession)
    return items.select(*kept, "prefix", "options").where("prefix is not null and options is not null").mapInArrow(score, f"{kinds}, at int, conditional double, baseline double")


def cloze_scores(items: DataFrame, scorer: Scorer, block: int = BLOCK, key: tuple[str, ...] = ("phase", "story_id"), encode: Encode | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carry, at, score): log-likelihood of the whole text filled with each candidate, of its last `block` tokens but the first."""
    cut, kept = encode or _bytes, (*key, *carry)
    kinds = ", ".join(f"{k} {items.schema[k].dataType.simpleString()}" for k in kept)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, "text_with_mask"):
                for i, (text, candidates) in enumerate(zip(part.column("text_with_mask").to_pylist(), part.column("candidates").to_pylist(), strict=True)):
                    if encode is None:  # bytes: those of the last `block` characters are enough
                        text = _tail(text, block)
                    spans = [truncated_left(_at_least_two(cut(text.replace(T.MASK, c))), 1, block) for c in candidates]
                    n = len(spans)
                    columns = [part.column(k).take(pa.array([i] * n, pa.int64())) for k in kept]
                    columns += [pa.array(np.arange(n, dtype=np.int32)), pa.array(_scored(spans, scorer).round(9))]
                    yield pa.RecordBatch.from_arrays(columns, names=[*kept, "at", "score"])

    shipped(items.sparkSession)
    return items.select(*kept, "text_with_mask", "candidates").mapInArrow(score, f"{kinds}, at int, score double")


def cloze_results(items: DataFrame, scorer: Scorer, block: int = BLOCK, key: tuple[str, ...] = ("phase", "story_id"), encode: Encode | None = None) -> DataFrame:
    """(phase, n, n_correct, accuracy, chance): rank-1 accuracy; a tie for the best is wrong; chance is the mean of 1 by candidates."""
    by = list(key)
    items = items.withColumns({"answer_index": (F.array_position("candidates", F.col("answer")) - 1).cast("int"), "k": F.size("candidates")})
    right = rank_one(cloze_scores(items, scorer, block, key, encode, ("answer_index", "k")).dropna(subset=by), [*by, "k"], "at", F.round("score", 6), "answer_index")
    return right.groupBy("phase").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg(1 / F.col("k")).alias("chance"))


def cloze_accuracy(items: DataFrame, scorer: Scorer, block: int = BLOCK) -> DataFrame:
    """cloze_results() with six decimals."""
    return cloze_results(items, scorer, block).withColumns({c: F.round(c, 6) for c in ("accuracy", "chance")})


def option_results(items: DataFrame, scorer: Scorer, block: int = BLOCK, key: tuple[str, ...] = ("phase", "story_id"), encode: Encode | None = None, end: int = END) -> DataFrame:
    """(phase, n, n_pmi, n_summed, chance): items whose answer alone ranks first after its prefix, less what it scores alone (pmi), and as it is."""
    by = list(key)
    scores = option_scores(items.withColumn("k", F.size("options")), scorer, block, key, encode, end, ("answer_index", "k")).dropna(subset=by)
    ways = {"correct": F.round(F.col("conditional") - F.col("baseline"), 6), "summed": F.round("conditional", 6)}
    both = rank_one(scores, [*by, "k"], "at", ways, "answer_index")
    return both.groupBy("phase").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_pmi"), F.count_if("summed").alias("n_summed"), F.avg(1 / F.col("k")).alias("chance"))


def rank_one(scores: DataFrame, by: list[str], at: str, score: Column | dict[str, Column], answer: str) -> DataFrame:
    """(by, correct): whether the answer alone has the highest score; a tie is wrong. Several scores: a column for each, by its name."""
    ways = score if isinstance(score, dict) else {"correct": score}
    top = scores.withColumns({f"_{c}": s for c, s in ways.items()}).groupBy(*by, answer).agg(F.collect_list(F.struct(at, *[f"_{c}" for c in ways])).alias("all"))

    def alone(c: str) -> Column:
        best = T.once(F.array_max(F.transform("all", lambda x: x[f"_{c}"])), lambda m: F.filter("all", lambda x: x[f"_{c}"] == m))
        return T.once(best, lambda b: (F.size(b) == 1) & (F.get(b, F.lit(0))[at] == F.col(answer))).alias(c)

    return top.select(*by, *map(alone, ways))
