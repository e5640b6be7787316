"""Main-text extraction as a maximum-scoring subsequence of words and tags.

A page is read as a sequence of words and tags. Each scores its probability of belonging to the article, less one half, so
content words are positive, and tags and words of menus, notices and the like negative. The weights are those of a
logistic model of the tag itself, the elements that are open and the words of their class and id, fitted on the labelled pages
of html_labels.py. One linear scan finds the contiguous region of the largest sum; blocks inside it whose words score negative
in sum (an advert between two paragraphs) are left out.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import shipped
from storyloom.llm.html_labels import LABELLED

TAG = re.compile(r"""<(?:!--|([/!?]?)([A-Za-z][^\s/>]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|[!?][^>]*+>)""")
ATTRIBUTE = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
#: Elements whose content is no text; without an end tag; that part blocks of text.
DROPPED = frozenset("script style noscript template iframe svg canvas object audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
#: Elements that an opening tag of a kind closes if they are the ones open.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
#: Weight of the squares of the weights in fitting.
RIDGE = 0.5
#: A token: how many words (0: a tag), its features, its block and its text.
Token = tuple[int, tuple[str, ...], int, str]


@lru_cache(4096)
def _hints(attributes: str) -> tuple[str, ...]:
    """Words of an element's class, id and role, in lower case."""
    words = (w for value in ATTRIBUTE.findall(attributes) for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", value.strip("\"'")))
    return tuple(dict.fromkeys(f"hint {w.lower()}" for w in words))


class _Open:
    """The elements that are open: a stack, with where each name and each block stands in it. Steps take constant time, but for what they close."""

    def __init__(self, known: frozenset[str] | None):
        self.known, self.names, self.features = known, [], [()]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, name: str, own: tuple[str, ...]) -> None:
        new = [x for x in own if self.known is None or x in self.known]
        held = self.features[-1]
        self.at.setdefault(name, []).append(len(self.names))
        if name in BLOCKS:
            self.blocks.append(len(self.names))
        self.names.append(name)
        self.features.append(held if all(x in held for x in new) else tuple(dict.fromkeys((*held, *new))))

    def cut(self, n: int) -> None:
        """Closes all elements from the n-th on."""
        while len(self.names) > n:
            name = self.names.pop()
            self.features.pop()
            self.at[name].pop()
            if name in BLOCKS:
                self.blocks.pop()

    def close(self, name: str) -> None:
        if self.at.get(name):
            self.cut(self.at[name][-1])


def tokens(page: str, known: frozenset[str] | None = None) -> Iterator[Token]:
    """Words (by run of text) and tags of a page. Tags that are never closed, crossed or stray are taken as they come.

    known: the features that count; None: all.
    """
    open_ = _Open(known)
    block, at, size = 0, 0, len(page)

    while at < size:
        found = TAG.search(page, at)
        end = found.start() if found else size
        if end > at and (text := html.unescape(page[at:end])):
            yield len(text.split()), open_.features[-1], block, text
        if not found:
            return
        at = found.end()
        if found.group(2) is None:
            if page.startswith("<!--", found.start()):
                close = page.find("-->", found.start() + 2)
                at = size if close < 0 else max(close + 3, found.end())
            continue
        mark, name, attributes = found.group(1), found.group(2).lower(), found.group(3)
        if mark in ("!", "?"):
            continue
        if not mark and name in DROPPED and not attributes.rstrip().endswith("/"):
            close = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
            at = close.end() if close else size
            continue
        if name in BLOCKS:
            block += 1
        if mark:
            open_.close(name)
        elif name not in VOID and not attributes.endswith("/"):
            # a paragraph ends where another block begins
            if name in BLOCKS and open_.blocks:
                nearest = open_.names[open_.blocks[-1]]
                if nearest == "p" or nearest in CLOSES.get(name, ()):
                    open_.cut(open_.blocks[-1])
            open_.push(name, (f"in {name}", *_hints(attributes)))
        yield 0, (f"tag {name}", *open_.features[-1]), block, " " if name == "br" else ""


def _labelled() -> tuple[list[tuple[str, ...]], list[float], list[float]]:
    """Features, label and weight of the tokens of the labelled pages; x-main is the article, x-off what isn't of it."""
    rows, labels, weights = [], [], []
    for page in LABELLED:
        state = [0.0]
        for words, features, _, _ in tokens(page):
            name = features[0][4:] if not words and features and features[0].startswith("tag x-") else ""
            if name:
                inside = f"in {name}" in features
                state = [*state, float(name == "x-main")] if inside else state[:-1] or [0.0]
                continue
            rows.append(tuple(x for x in features if not x.startswith("in x-")))
            labels.append(state[-1])
            weights.append(float(min(words, 12)) if words else 1.0)
    return rows, labels, weights


@lru_cache(1)
def weights() -> dict[str, float]:
    """Weights of the logistic model, by Newton steps with a ridge; the same on every machine."""
    rows, labels, importance = _labelled()
    names = {x: i for i, x in enumerate(sorted({x for r in rows for x in r} | {"word", "tag"}))}
    x, y, w = np.zeros((len(rows), len(names))), np.array(labels), np.array(importance)
    for i, r in enumerate(rows):
        x[i, [names[f] for f in r]] = 1
        x[i, names["tag" if r and r[0].startswith("tag ") else "word"]] = 1
    b = np.zeros(len(names))
    for _ in range(25):
        p = 1 / (1 + np.exp(-(x @ b)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(b)), x.T @ (w * (y - p)) - RIDGE * b)
        b += step
    return {n: float(b[i]) for n, i in names.items()}


def best_region(scores: list[float]) -> tuple[int, int]:
    """The run of scores of the largest sum, as where it begins and ends; nothing where no sum is above zero."""
    best, now, first, region = 0.0, 0.0, 0, (0, 0)
    for i, score in enumerate(scores):
        if now <= 0:
            now, first = 0.0, i
        now += score
        if now > best:
            best, region = now, (first, i + 1)
    return region


def extract(page: str | None) -> str:
    """The main text of a page: blocks in page order joined by one line end, white space inside a block as one space."""
    if not page:
        return ""
    by, known, runs, scores = weights(), {}, [], []
    names = frozenset(by)
    for words, features, block, text in tokens(page, names):
        kind = "word" if not features or not features[0].startswith("tag ") else "tag"
        p = known.get(features)
        if p is None:
            total = by[kind] + sum(by.get(f, 0.0) for f in features)
            p = known[features] = 1 / (1 + np.exp(-total)) - 0.5
        # A tag never scores for content, it only parts or joins.
        scores.append(words * p if kind == "word" else min(p, 0.0) * 0.5 - 0.05)
        runs.append((words * p, block, text))
    blocks: dict[int, list[str]] = {}
    sums: dict[int, float] = {}
    for score, block, text in runs[slice(*best_region(scores))]:
        if text:
            blocks.setdefault(block, []).append(text)
            sums[block] = sums.get(block, 0.0) + score
    lines = (" ".join("".join(parts).split()) for block, parts in blocks.items() if sums[block] > 0)
    return "\n".join(x for x in lines if x)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of pages: id, url, text and n_chars (code points of text).

    Null and empty html, and pages without an article, have an empty text. Rows that repeat come out alike; null ids and urls
    stay; other columns are not read. Nothing is shuffled.
    """
    shipped(pages.sparkSession)
    extract("<p>")  # a fault of the labelled pages shows on the driver

    @F.arrow_udf("string")
    def text(rows: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for row in rows:
            yield pa.array([extract(x.as_py()) for x in row], pa.string())

    out = pages.select(F.col(id_col), F.col(url_col), text(F.col(html_col)).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
