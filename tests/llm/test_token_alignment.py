"""Token alignment against whole texts tokenized and linked in plain Python, and its parts on their own."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from storyloom.llm import queries, token_alignment
from storyloom.llm.common import text_bytes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pair():
    return token_alignment.TokenPair(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read(), open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())


def whole_groups(pair, text):
    """[(A's ids, B's ids)] of a whole text; none where the bytes differ."""
    if not text:
        return []
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(pair.a_bytes[i] for i in a) != raw or b"".join(pair.b_bytes[i] for i in b) != raw:
        return []
    ends = [np.cumsum([len(t[i]) for i in ids]).tolist() for t, ids in ((pair.a_bytes, a), (pair.b_bytes, b))]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    number = {e: k for k, e in enumerate(cuts)}
    out = [([], []) for _ in cuts]
    for side, ids in enumerate((a, b)):
        k = 0
        for i, e in zip(ids, ends[side]):
            out[k][side].append(i)
            k += e in number
    return out


def plain(pair, texts):
    found = [whole_groups(pair, t) for t in texts]
    links = [collections.Counter((x, y) for a, b in g for x in a for y in b) for g in found]
    docs = collections.Counter(p for c in links for p in c)
    top = collections.Counter()
    for (a, _), n in docs.items():
        top[a] = max(top[a], n)
    out = []
    for g, c in zip(found, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        digest = hashlib.sha256(text.encode()).hexdigest() if g else ""
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), sum(n for p, n in c.items() if docs[p] == top[p[0]]), sum(n * docs[p] for p, n in c.items()), digest))
    return out


def run(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, chunk int, seg string, code int")
    return sorted(map(tuple, token_alignment.aligned(docs.repartition(3), **how).collect()), key=str)


def odd_texts():
    rng = random.Random(8)
    signs = ["a", "the", "Zürich", "日本語", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\u00a0", "\u3000", "\u2003", "\u2028", "\u1680", "\x85", "\x1c", "'s", "don't", "!!", "123", "4567", "é", "🎈", "ﬁ", "<s>", "<|endoftext|>", "<unk>", "<0x0A>", "\x7f", "\ufeff", "—", "x" * 40, "=" * 50]
    return ["".join(rng.choice(signs) + rng.choice(["", "", " "]) for _ in range(rng.randint(1, 40))) for _ in range(250)]


def test_alignment_against_whole_texts(spark, pair):
    texts = odd_texts() + [None, "", " ", "\n", "a", "a ", "\na", " a", "the▁mark", "▁", "the old man and the sea"] * 2
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, texts[3]), (None, texts[5]), (7, "another text of the same id")]
    want = plain(pair, [t for _, t in rows])
    assert sum(w[0] == 0 for w in want) > 5 and sum(w[0] > 0 for w in want) > 200
    assert run(spark, rows) == sorted(((i, *w) for (i, _), w in zip(rows, want)), key=str)


def test_long_segments_and_many_copies(spark, pair):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefXYZ019=") for _ in range(30000))
    rows = [(1, long), (2, long + " end"), (3, "=" * 5000), (4, "words of a tale " * 5000)] + [(10 + i, "one tale, told again") for i in range(300)]
    want = plain(pair, [t for _, t in rows])
    assert run(spark, rows) == sorted(((i, *w) for (i, _), w in zip(rows, want)), key=str)


def test_empty_table(spark):
    assert run(spark, []) == []
    assert [r[1:] for r in run(spark, [(1, None), (2, "")])] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_query_on_a_whole_table(spark, pair):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = plain(pair, [r.text for r in docs])
    assert sorted(map(tuple, queries.op12_token_alignment(spark, SF).collect()), key=str) == sorted(((r.doc_id, *w) for r, w in zip(docs, want)), key=str)


def test_whole_texts_where_segments_are_not_promised(spark, pair, monkeypatch):
    texts = odd_texts()[:40]
    rows = list(enumerate(texts))
    want = sorted(((i, *w) for i, w in enumerate(plain(pair, texts))), key=str)
    real = token_alignment._coder
    monkeypatch.setattr(token_alignment, "_coder", lambda separable, signs: real(False, ""))
    assert run(spark, rows) == want


def test_segments_and_packed_numbers():
    texts = ["a b\nc", "", " x  y", "é z  q"]
    body, starts = text_bytes(pa.array(texts))
    at = [*token_alignment.segment_starts(body, starts, ".'").tolist(), len(body)]
    assert [bytes(body[a:b]).decode() for a, b in zip(at, at[1:])] == ["a", " b", "\nc", " x", "  y", "é", " z  q"]
    numbers = np.array([0, 1, 127, 128, 16383, 16384, 2097151, 2097152, (1 << 28) - 1])
    data, at = token_alignment.packed(numbers)
    back, ended = token_alignment.unpacked(data)
    assert back.tolist() == numbers.tolist() and ended[at].tolist() == list(range(len(numbers) + 1))
    assert [x.tolist() for x in token_alignment.unpacked(np.zeros(0, np.uint8))] == [[], [0]]


def test_pieces_go_over_no_segment(pair):
    assert pair.separable and set(".,;!?") <= set(pair.signs)
