"""Normal forms of stories, words, shingles and sentences, and seeded draws, as expressions that stay in the JVM."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space as str.split() has it, and word characters (letters, numbers and the underscore).
SPACE = r"(?U)[\s\x1c-\x1f]+"
WORD = r"[\p{L}\p{N}_]+"
#: Thresholds of the near-duplicate and overlap operators.
PREFIX_CHARS, SHINGLE_WORDS, NGRAM_WORDS, MIN_SENTENCE_WORDS = 200, 5, 8, 6
MASK = "[MASK]"
#: Bytes of normalised texts that Python holds beside Arrow's.
NORMAL_BYTES = 4 << 20


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _class(points: Iterable[int], gap: int) -> str:
    """A pattern's class of code points; what lies between two that are at most `gap` apart is in it, so that it stays short."""
    ranges: list[list[int]] = []
    for c in sorted(points):
        if ranges and c - ranges[-1][1] <= gap:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


@lru_cache(1)
def _odd() -> str:
    """Pattern of the characters that can change in NFC: marks, vowel and final jamo, all whose composed form is another, and some beside them."""
    every = (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    return _class((c for c in every if unicodedata.category(chr(c))[0] == "M" or 0x1161 <= c <= 0x11C2 or unicodedata.normalize("NFC", chr(c)) != chr(c)), 128)


def normalizer(form: str) -> Callable[[Column], Column]:
    """A function that puts texts in a normal form. Of a batch, which Arrow holds as UTF-8, one text at a time is a Python string."""

    @F.arrow_udf("string")
    def normal(texts: pa.Array) -> pa.Array:
        parts, rows, size = [], [], 0
        for t in texts:
            rows.append(unicodedata.normalize(form, t.as_py()).encode() if t.is_valid else None)
            size += len(rows[-1] or b"")
            if size > NORMAL_BYTES:
                parts.append(pa.array(rows, pa.binary()).cast(pa.string()))
                rows, size = [], 0
        parts.append(pa.array(rows, pa.binary()).cast(pa.string()))
        return pa.concat_arrays(parts)

    return normal


def nfc(text: Column) -> Column:
    """A text in NFC. Python sees only texts with a character that NFC can change; of all others it is handed a null."""
    compose = normalizer("NFC")
    # Nothing below U+0300 can change.
    return F.coalesce(compose(F.when(text.rlike(r"[\x{300}-\x{10FFFF}]") & text.rlike(_odd()), text)), text)


def nfc_rows(df: DataFrame, column: str) -> DataFrame:
    """df with a column in NFC."""
    return df.withColumn(column, nfc(F.col(column)))


@lru_cache(1)
def _folds() -> tuple[str, str]:
    """Letters whose full case folding isn't their lower case, as a pattern (some beside them in it), and what they become, as JSON."""
    folds = {c: c.casefold() for c in map(chr, range(0x20000)) if c.lower() == c and c.casefold() != c and c != "\u00df"}
    return _class(map(ord, folds), 8), json.dumps(folds)


def casefold(text: Column) -> Column:
    """Full case folding: lower case, sharp s as ss; texts with rarer letters (final sigma, ligatures) are folded letter by letter."""
    rare, folds = _folds()
    table = F.from_json(F.lit(folds), "map<string, string>")
    by_letter = lambda t: F.array_join(F.transform(F.split(t, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return once(F.replace(F.lower(text), F.lit("\u00df"), F.lit("ss")), lambda t: F.when(t.rlike(r"[\xB5\x{149}-\x{10FFFF}]") & t.rlike(rare), by_letter(t)).otherwise(t))


def squeezed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def stripped(text: Column) -> Column:
    """A text without white space at its ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def story_sha256(text: Column) -> Column:
    """Hash of a story in NFC whose white space is squeezed and whose case is kept."""
    return F.sha2(squeezed(nfc(text)), 256)


def prefix_key(text: Column, chars: int = PREFIX_CHARS) -> Column:
    """The first characters of the text in NFC, folded and squeezed."""
    return composed_prefix(nfc(text), chars)


def composed_prefix(text: Column, chars: int = PREFIX_CHARS) -> Column:
    """The first characters, folded and squeezed, of a text that is in NFC."""
    return F.substring(squeezed(casefold(text)), 1, chars)


def words(text: Column) -> Column:
    """Folded words of a text in NFC."""
    return composed_words(nfc(text))


def composed_words(text: Column) -> Column:
    """Folded words of a text that is in NFC."""
    return F.regexp_extract_all(casefold(text), F.lit(f"({WORD})"))


def ngrams(word_array: Column, n: int) -> Column:
    """All runs of n words as 64-bit hashes; none for a shorter array."""

    def of(w: Column) -> Column:
        start = F.sequence(F.lit(1), F.size(w) - n + 1)
        runs = F.transform(start, lambda i: F.xxhash64(*[F.element_at(w, (i + k).cast("int")) for k in range(n)]))
        return F.when(F.size(w) >= n, runs).otherwise(F.array().cast("array<bigint>"))

    return once(word_array, of)


def shingles(word_array: Column, n: int = SHINGLE_WORDS) -> Column:
    """Distinct hashes of runs of n words; fewer words are one run, no words none."""


    def of(w: Column) -> Column:
        short = F.when(F.size(w) > 0, F.array(F.xxhash64(F.lit("short"), F.array_join(w, " "))))
        return F.when(F.size(w) >= n, F.array_distinct(ngrams(w, n))).otherwise(F.coalesce(short, F.array().cast("array<bigint>")))

    return once(word_array, of)


def sentences(text: Column, least: int = MIN_SENTENCE_WORDS) -> Column:
    """Sentences of `least` words or more, each as its folded words joined by spaces; repeats stay."""
    parts = F.transform(F.split(nfc(text), r"[.!?\n]+"), composed_words)
    return F.transform(F.filter(parts, lambda w: F.size(w) >= least), lambda w: F.array_join(w, " "))


def loader_lines(text: Column) -> Column:
    """Lines parted by CRLF, CR or LF only."""
    return F.split(text, r"\r\n|\r|\n", -1)


def paragraphs(text: Column) -> Column:
    """Parts between blank lines if there is one, else lines; stripped, empty ones dropped."""
    plain = F.btrim(F.regexp_replace(text, r"\r\n|\r", "\n"), F.lit(" \t\n\x0b\x0c\r"))
    parts = once(plain, lambda t: F.when(t.rlike(r"\n\s*\n"), F.split(t, r"\n\s*\n")).otherwise(F.split(t, "\n")))
    return F.filter(F.transform(parts, lambda p: F.btrim(p, F.lit(" \t\n\x0b\x0c\r"))), lambda p: p != "")


def paragraph_separator(text: Column) -> Column:
    """What parts a text's paragraphs: a blank line if there is one, else a line end."""
    plain = F.btrim(F.regexp_replace(text, r"\r\n|\r", "\n"), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(plain.rlike(r"\n\s*\n"), "\n\n").otherwise("\n")


#: Endings that a stem loses, the first that fits, and the letters that must remain.
ENDINGS, STEM_LETTERS = ("ing", "est", "ed", "er", "es", "ly", "s"), 3


def stem(word: Column) -> Column:
    """A word folded and without a common English ending: -ies is -y, a double last letter counts once, a last e goes."""
    without = lambda c, n: F.substring(c, F.lit(1), F.length(c) - n)
    fits = lambda w, e: w.endswith(e) & (F.length(w) - len(e) >= STEM_LETTERS) & (~w.endswith("ss") if e == "s" else F.lit(True))
    single = lambda c: F.when((F.length(c) >= STEM_LETTERS) & (F.substring(c, -1, 1) == F.substring(c, -2, 1)), without(c, 1)).otherwise(c)

    def of(w: Column) -> Column:
        cut = once(F.coalesce(*[F.when(fits(w, e), without(w, len(e))) for e in ENDINGS]), single)
        return F.when((F.length(w) > 4) & w.endswith("ies"), F.concat(without(w, 3), F.lit("y"))).otherwise(F.coalesce(cut, w))

    return once(once(casefold(word), of), lambda x: F.when((F.length(x) > 3) & x.endswith("e"), without(x, 1)).otherwise(x))


def related(a: Column, b: Column) -> Column:
    """Whether two words are equal when folded or stemmed."""
    return (casefold(a) == casefold(b)) | (stem(a) == stem(b))


def draw(seed: int, label: str, *ids: Column) -> Column:
    """The hexadecimal hash by which seeded orders and samples are made: a function of seed, label and ids alone."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(label), *[i.cast("string") for i in ids]), 256)


def draw_index(n: Column, seed: int, label: str, *ids: Column) -> Column:
    """A whole number from 0 to n - 1."""
    return F.pmod(F.conv(F.substring(draw(seed, label, *ids), 1, 15), 16, 10).cast("long"), n)


def derived_seed(tag: str, seed: int, namespace: str = "storyloom") -> Column:
    """A seed from 0 to 2^63 - 2 for a named stream."""
    head = F.substring(F.sha2(F.lit(f"{namespace}:{tag}:{seed}"), 256), 1, 16)
    return (F.conv(head, 16, 10).cast("decimal(20,0)") % F.lit(9223372036854775807).cast("decimal(20,0)")).cast("long")


def ranked(df: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
    """df with the rank from 0 in each group by a hexadecimal hash: counts of its prefixes, then ranks below each prefix."""
    rows = df.withColumn("_head", F.substring(order, 1, 3))
    heads = rows.groupBy(*by, "_head").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_bytes", F.unhex(order))  # same order, half the size
    within = F.row_number().over(Window.partitionBy(*by, "_head").orderBy("_bytes")) - 1
    out = rows.withColumn("_within", within).join(heads.withColumn("_before", before).drop("_n"), [*by, "_head"])
    return out.withColumn(name, F.col("_before") + F.col("_within")).drop("_head", "_within", "_before", "_bytes")
