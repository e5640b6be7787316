"""Cloze and continuation probes: construction by seeded ranks, verification as rules, giveaway report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import screens
from storyloom.functions import text as T
from storyloom.operators import guard

#: Candidates of a cloze item, options of a continuation item, and their length by the answer's.
N_CANDIDATES, N_OPTIONS, LENGTH_LOW, LENGTH_HIGH = 20, 4, 0.5, 2.0
#: Fixed value: places drawn in the length band for each item; items that these do not fill look at the whole phase.
DRAWS = 24
#: Fixed value: places drawn in a phase's lexicon for each cloze item.
TRIES = 32
#: Fixed value: drawn words of a story that are looked up in the lexicon at first; stories that these don't settle look up all.
FIRST = 16
#: Fixed value: 64-bit words of the screens of stories and paragraphs (8 MB).
SCREEN = 1 << 20


def _screened(rows: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key may be among the wanted ones: before a join, so that few texts are moved that it would drop."""
    bits = screens.screen(wanted.select(F.xxhash64(*key).alias("key")), "key", SCREEN)
    return rows.where(screens.passes(bits, F.xxhash64(*key), SCREEN))


def deduped_lexicon(lexicon: DataFrame) -> DataFrame:
    """(phase, word): stripped, not empty, the first in order of each folded form."""
    rows = lexicon.select("phase", F.trim("word").alias("word")).where("word <> ''").withColumn("fold", T.casefold(F.col("word")))
    first = F.row_number().over(Window.partitionBy("phase", "fold").orderBy("word"))
    return rows.withColumn("nr", first).where("nr = 1").select("phase", "word", "fold", T.stem(F.col("word")).alias("stem"))


def band_lexicon(stories: DataFrame, low: int, high: int, letters: int = 5) -> DataFrame:
    """(phase, word) of the lower-case words of at least `letters` letters that `low` to `high` stories of a phase hold."""
    words = F.filter(F.array_distinct(F.regexp_extract_all("story", F.lit(f"({T.WORD})"))), lambda w: (F.length(w) >= letters) & (w == F.lower(w)))
    df = stories.select("phase", F.explode(words).alias("word")).groupBy("phase", "word").count()
    return df.where(F.col("count").between(low, high)).select("phase", "word")


def share_lexicon(stories: DataFrame, low: int, percent: int, letters: int = 5) -> DataFrame:
    """As band_lexicon, but the upper bound is a share of the phase's stories, so that it means the same at any size."""
    words = F.filter(F.array_distinct(F.regexp_extract_all("story", F.lit(f"({T.WORD})"))), lambda w: (F.length(w) >= letters) & (w == F.lower(w)))
    df = stories.select("phase", F.explode(words).alias("word")).groupBy("phase", "word").agg(F.count("*").alias("c"))
    n = stories.groupBy("phase").agg(F.count("*").alias("n"))
    return df.join(n, "phase").where((F.col("c") >= low) & (F.col("c") * 100 <= F.col("n") * percent)).select("phase", "word")


def item_id(kind: str, number: Column) -> Column:
    """kind-p{phase}-{four digits or more}."""
    digits = number.cast("string")
    return F.concat(F.lit(f"{kind}-p"), F.col("phase").cast("string"), F.lit("-"), F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), F.lit("0")))


def _lookups(stories: DataFrame, able: DataFrame, seed: int, first: int | None = None) -> DataFrame:
    """(phase, story_id, hit, edge): words that a story holds once, in the order drawn; hit: (draw, word, stem) where it is an able word.

    first: only so many of each story. The draw of the last of so many is the edge: no word left out comes before it.
    """
    # A text's words are sorted by their lower case; those that stand alone among them occur once. No word of another kind leaves the text.
    pairs = F.array_sort(F.transform(F.regexp_extract_all("story", F.lit(f"({T.WORD})")), lambda w: F.struct(F.lower(w).alias("low"), w.alias("seen"))))
    alone = lambda p: lambda x, i: ((i == 0) | (F.get(p, i - 1)["low"] != x["low"])) & F.coalesce(F.get(p, i + 1)["low"] != x["low"], F.lit(True))
    once = T.once(pairs, lambda p: F.transform(F.filter(p, alone(p)), lambda x: x["seen"]))
    draw = lambda w: T.draw(seed, "cloze-answer", F.col("phase"), F.col("story_id"), w)
    rows = stories.select("phase", F.col("id").alias("story_id"), once.alias("words"))  # outer: else the words are made twice, for a filter of Spark's own
    if first is None:
        rows = rows.select("phase", "story_id", F.explode_outer("words").alias("word"), F.lit(False).alias("last"))
    else:
        drawn = F.slice(F.array_sort(F.transform("words", lambda w: F.struct(draw(w).alias("draw"), w.alias("word")))), 1, first)
        rows = rows.select("phase", "story_id", F.posexplode_outer(drawn).alias("at", "drawn"))
        rows = rows.select("phase", "story_id", F.col("drawn")["word"].alias("word"), (F.col("at") == first - 1).alias("last"))
    found = rows.where("word is not null").join(able, ["phase", "word"], "left").withColumn("draw", draw(F.col("word")))
    return found.select("phase", "story_id", F.when(F.col("stem").isNotNull(), F.struct("draw", "word", "stem")).alias("hit"), F.when(F.col("last"), F.col("draw")).alias("edge"))


def _end(story: Column, tail: int) -> Column:
    """The end of a story that holds its last `tail` characters whatever takes the place of one of its words; a text that holds the mask itself is whole.

    It is longer by twice the longest word: where the cut makes a word of the end of another, that is too far off to be seen.
    """
    longest = F.array_max(F.transform(F.regexp_extract_all(story, F.lit(f"({T.WORD})")), F.length))
    return F.when(F.contains(story, F.lit(T.MASK)), story).otherwise(F.right(story, 2 * F.coalesce(longest, F.lit(0)) + (max(tail, 2) + 16)))


def cloze_items(stories: DataFrame, lexicon: DataFrame, seed: int, per_phase: int | None = None, tail: int | None = None) -> DataFrame:
    """(phase, item, id, story_id, story_sha256, answer, text_with_mask, candidates) of stories that hold a lexicon word exactly once.

    tail: for who looks at no more than so many bytes at the end of a filled text, as a scorer of bytes does: the beginning
    is left out of text_with_mask, and there is no story_sha256.

    An answer occurs once whatever its case, as written in the lexicon, and has enough unrelated words beside it. The theta
    join of stories and words is an equi join on lower-case words here. All choices are seeded hash ranks.
    """
    words = deduped_lexicon(lexicon).persist()  # read six times; no larger than the phases' vocabularies
    size = words.groupBy("phase").agg(F.count("*").alias("n"))
    kin = words.groupBy("phase", "stem").agg(F.count("*").alias("kin"))
    able = words.join(kin, ["phase", "stem"]).join(size, "phase").where(F.col("n") - F.col("kin") >= N_CANDIDATES - 1).select("phase", "word", "stem")
    key = ["phase", "story_id"]
    # Each story looks up its first drawn words; one of which a word not looked up may come before the best found looks up all.
    few = _lookups(stories.where("phase is not null and id is not null"), able, seed, FIRST).groupBy(*key).agg(F.min("hit").alias("hit"), F.min("edge").alias("edge")).persist()
    open_ = F.col("edge").isNotNull() & (F.col("hit").isNull() | (F.col("hit")["draw"] > F.col("edge")))
    unsettled = few.where(open_).select("phase", F.col("story_id").alias("id"))
    again = _screened(stories, unsettled, ["phase", "id"]).join(unsettled, ["phase", "id"], "left_semi")
    full = _lookups(again, able, seed).groupBy(*key).agg(F.min("hit").alias("hit"))
    chosen = few.where(~open_).select(*key, "hit").unionByName(full).where("hit is not null")
    chosen = chosen.select(*key, F.col("hit")["word"].alias("answer"), F.col("hit")["stem"].alias("answer_stem")).persist()
    chosen = T.ranked(chosen.withColumn("_order", T.draw(seed, "cloze-order", F.col("phase"), F.col("story_id"))), ["phase"], "_order", "item")
    chosen = chosen.withColumn("item", (F.col("item") + 1).cast("int")).drop("_order").persist()
    if per_phase is not None:
        chosen = chosen.where(F.col("item") <= per_phase)
    listed = T.ranked(words.withColumn("_order", T.draw(seed, "cloze-lexicon", F.col("phase"), F.col("word"))), ["phase"], "_order", "place").select("phase", "place", "word", "stem")
    tries = chosen.join(size, "phase").withColumn("nr", F.explode(F.sequence(F.lit(0), F.lit(TRIES - 1))))
    tries = tries.withColumn("place", T.draw_index(F.col("n"), seed, "cloze-candidate", F.col("phase"), F.col("story_id"), F.col("nr")))
    drawn = tries.join(listed, ["phase", "place"]).where("stem <> answer_stem").groupBy(*key).agg(F.collect_list(F.struct("nr", "word")).alias("d"))  # TRIES at most
    drawn = drawn.select(*key, F.slice(F.array_distinct(F.transform(F.array_sort("d"), lambda x: x["word"])), 1, N_CANDIDATES - 1).alias("others")).where(F.size("others") == N_CANDIDATES - 1).persist()  # read twice, a list for each item
    # Items that the draws don't fill, as in a small lexicon, rank all words of their phase.
    rest = chosen.join(drawn.select(*key), key, "left_anti").join(words.select("phase", "word", "stem"), "phase").where("stem <> answer_stem")
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(T.draw(seed, "cloze-rest", F.col("phase"), F.col("story_id"), F.col("word"))))
    rest = rest.withColumn("nr", rank).where(F.col("nr") < N_CANDIDATES).groupBy(*key).agg(F.collect_list("word").alias("others"))
    others = drawn.unionByName(rest)
    shuffled = F.transform(F.array_sort(F.transform(F.concat(F.array("answer"), "others"), lambda w: F.struct(T.draw(seed, "cloze-shuffle", F.col("story_id"), w).alias("h"), w.alias("w")))), lambda x: x["w"])
    story = F.col("story") if tail is None else _end(F.col("story"), tail)
    out = chosen.join(others, ["phase", "story_id"]).join(stories.select("phase", F.col("id").alias("story_id"), story.alias("story")), ["phase", "story_id"])
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.col("answer"), F.lit(r"\E(?![\p{L}\p{N}_])"))
    masked = F.regexp_replace(F.col("story"), quoted, F.lit("[MASK]"))
    sha = [T.story_sha256(F.col("story")).alias("story_sha256")] if tail is None else []
    return out.select("phase", "item", item_id("cloze", F.col("item")).alias("id"), "story_id", *sha, "answer", masked.alias("text_with_mask"), shuffled.alias("candidates"))


def drawn_items(stories: DataFrame, seed: int, tail: int | None = None) -> DataFrame:
    """(phase, id, story_id, prefix, answer, answer_index, options, option_sources, distractor_phases) of each story of two paragraphs or more.

    The split point is drawn. Distractors are non-opening paragraphs of three other stories of the phase, in the band of lengths
    while there are any, of different texts; options are null for a story whose phase holds no such three. Paragraphs have places
    in the order of length, so a band is a run of places and a draw is an equi join; an item that DRAWS draws do not fill is
    compared with all paragraphs of its phase.

    tail: for who looks at no more than so many bytes at the end of a prefix, as a scorer of bytes does: only so many characters are there.
    """
    parts = stories.select("phase", F.col("id").alias("story_id"), T.story_sha256(F.col("story")).alias("sha"), T.paragraphs(F.col("story")).alias("p"), T.paragraph_separator(F.col("story")).alias("sep"), F.monotonically_increasing_id().alias("_row")).where(F.size("p") >= 2).persist()
    parts = parts.withColumn("cut", T.draw_index(F.greatest(F.size("p") - 1, F.lit(1)), seed, "continuation-cut", F.col("phase"), F.col("story_id")).cast("int") + 1)
    turns = T.ranked(parts.select("phase", "story_id", "_row", T.draw(seed, "continuation-order", F.col("phase"), F.col("story_id")).alias("_order")), ["phase"], "_order", "_turn")
    turns = turns.groupBy(F.struct("phase", "story_id").alias("_key")).agg(F.collect_list(F.struct("_row", "_turn")).alias("_turns"))  # one, but for ids that repeat
    pool = parts.select("phase", F.col("story_id").alias("other"), F.col("sha").alias("other_sha"), F.posexplode("p").alias("at", "option")).where("at > 0")
    pool = pool.withColumn("len", F.length("option")).withColumn("_order", T.draw(seed, "continuation-pool", F.col("phase"), F.col("other"), F.col("at")))
    slim = pool.select("phase", "other", "at", "len", F.xxhash64("option").alias("text"), "_order").persist()

    # Paragraphs of the phase up to each length, those of the bands' ends among them.
    answer = F.get("p", F.col("cut"))
    goal = parts.select("phase", "story_id", F.xxhash64(answer).alias("answer_text"), F.length(answer).alias("n"))
    goal = goal.withColumn("below", F.floor((F.col("n") - 1) / 2).cast("int")).withColumn("top", F.col("n") * 2)
    lengths = slim.groupBy("phase", "len").agg(F.count("*").alias("c"))
    ends = goal.select("phase", F.explode(F.array("below", "top")).alias("len"), F.lit(0).cast("long").alias("c")).distinct()
    upto = lengths.unionByName(ends).groupBy("phase", "len").agg(F.sum("c").alias("c")).withColumn("upto", F.sum("c").over(Window.partitionBy("phase").orderBy("len")))
    placed = T.ranked(slim, ["phase", "len"], "_order", "_in").join(upto, ["phase", "len"]).withColumn("place", F.col("upto") - F.col("c") + F.col("_in"))
    goal = goal.join(upto.select("phase", F.col("len").alias("below"), F.col("upto").alias("low")), ["phase", "below"]).join(upto.select("phase", F.col("len").alias("top"), F.col("upto").alias("high")), ["phase", "top"]).persist()

    tries = goal.withColumn("nr", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))))
    tries = tries.withColumn("place", F.col("low") + T.draw_index(F.greatest(F.col("high") - F.col("low"), F.lit(1)), seed, "distractor", F.col("phase"), F.col("story_id"), F.col("nr")))
    found = tries.join(placed.select("phase", "place", "other", "at", "text"), ["phase", "place"]).where("other <> story_id and text <> answer_text")
    key = ["phase", "story_id"]
    found = found.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("nr", "other", "at", "text"))).alias("d"))
    unlike = lambda a: lambda x: (x["other"] != F.col(a)["other"]) & (x["text"] != F.col(a)["text"])
    # The first of the list, the first unlike it, and the first unlike both, each found once.
    unlike = lambda a: lambda x: (x["other"] != a["other"]) & (x["text"] != a["text"])
    first = lambda d, then: T.once(F.struct(F.get(d, F.lit(0)).alias("a"), d.alias("d")), lambda s: then(s["a"], F.filter(s["d"], unlike(s["a"]))))
    three = first(F.col("d"), lambda x, d: first(d, lambda y, e: F.struct(x.alias("x"), y.alias("y"), F.get(e, F.lit(0)).alias("z"))))
    found = found.select(*key, F.inline(F.array(three))).where("z is not null")
    places = lambda df: df.select(*key, F.array(*[F.struct(F.col(c)["other"].alias("other"), F.col(c)["at"].alias("at")) for c in "xyz"]).alias("picks"))
    filled = places(found).persist()

    # The rest, dealt by the first digit of the paragraphs' hashes: one pass for each distractor.
    rest = goal.join(filled, key, "left_anti").withColumn("digit", F.explode(F.split(F.lit("0 1 2 3 4 5 6 7 8 9 a b c d e f"), " ")))
    rest = rest.join(slim.withColumn("digit", F.substring("_order", 1, 1)), ["phase", "digit"]).where("other <> story_id and text <> answer_text")
    outside = F.when((F.col("len") > F.col("below")) & (F.col("len") <= F.col("top")), 0).otherwise(1)
    rest = rest.select(*key, F.struct(outside.alias("outside"), T.draw(seed, "distractor-rest", F.col("story_id"), F.col("other"), F.col("at")).alias("h"), "other", "at", "text").alias("c")).persist()
    late = rest.groupBy(*key).agg(F.min("c").alias("x"))
    for old, name in (("x", "y"), ("y", "z")):
        left = rest.join(late, key)
        for a in "xyz"[: "xyz".index(old) + 1]:
            left = left.where((F.col("c")["other"] != F.col(a)["other"]) & (F.col("c")["text"] != F.col(a)["text"]))
        late = late.join(left.groupBy(*key).agg(F.min("c").alias(name)), key)
    picks = filled.unionByName(places(late)).select(*key, F.posexplode("picks").alias("nr", "pick")).select(*key, "nr", "pick.other", "pick.at")
    source = F.struct(F.col("other").alias("story_id"), F.col("other_sha").alias("story_sha256"), F.col("phase"))
    # A text is moved twice: the paragraphs that items picked, and what an item shows of its own story.
    place = ["phase", "other", "at"]
    options = _screened(pool.select(*place, "other_sha", "option"), picks, place)
    texts = picks.join(options, place).groupBy(F.struct(*key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct("nr", "option", source.alias("source")))).alias("d"))
    prefix = F.replace(F.concat(F.array_join(F.slice("p", F.lit(1), F.col("cut")), "\x00"), F.lit("\x00")), F.lit("\x00"), F.col("sep"))
    prefix = prefix if tail is None else F.right(prefix, F.lit(max(tail, 2)))
    own = parts.select(*key, F.struct(*key).alias("_key"), "_row", "sha", prefix.alias("prefix"), answer.alias("answer"))
    out = own.join(turns, "_key").join(texts, "_key", "left")
    out = out.withColumn("_turn", F.get(F.filter("_turns", lambda x: x["_row"] == F.col("_row")), F.lit(0))["_turn"])
    out = out.select(*key, "sha", "prefix", "answer", (F.col("_turn") % N_OPTIONS).cast("int").alias("answer_index"), item_id("continuation", F.col("_turn") + 1).alias("item_id"), "d")
    around = lambda x, mine: F.concat(F.slice(x, F.lit(1), F.col("answer_index")), F.array(mine), F.slice(x, F.col("answer_index") + 1, F.lit(N_OPTIONS)))
    own = F.struct("story_id", F.col("sha").alias("story_sha256"), "phase")
    return out.select(
        *key, F.col("item_id").alias("id"), "prefix", "answer", "answer_index",
        around(F.transform("d", lambda x: x["option"]), F.col("answer")).alias("options"),
        around(F.transform("d", lambda x: x["source"]), own).alias("option_sources"),
        F.transform("d", lambda x: x["source"]["phase"]).alias("distractor_phases"),
    )


def cloze_violations(items: DataFrame) -> DataFrame:
    """Rules of cloze items: one mask, the count of candidates, the answer among them, none twice, none related, answer unseen."""
    masks = (F.length("text_with_mask") - F.length(F.replace("text_with_mask", F.lit(T.MASK), F.lit("")))) / len(T.MASK)
    folds = F.transform("candidates", T.casefold)
    kin = F.size(F.filter("candidates", lambda w: T.related(w, F.col("answer"))))
    low = F.transform(F.regexp_extract_all("text_with_mask", F.lit(f"({T.WORD})")), F.lower)
    rules = {
        "one mask": masks != 1,
        "candidate count": F.size("candidates") != N_CANDIDATES,
        "answer missing": ~F.array_contains("candidates", F.col("answer")),
        "same word twice": F.size(F.array_distinct(folds)) != F.size("candidates"),
        "inflection": kin > 1,
        "answer visible": F.array_contains(low, F.lower("answer")),
    }
    listed = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull())
    return items.select("phase", "story_id", F.explode(listed).alias("rule"))


def _listed(items: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(phase, id, rule) of all rules that an item breaks."""
    listed = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull())
    return items.select("phase", "id", F.explode(listed).alias("rule"))


def _sourced(items: DataFrame, column: str, manifest: DataFrame, training: DataFrame) -> DataFrame:
    """(column, recorded, trained) for each distinct source hash of items: its phase in the manifest, and whether it is a training story."""
    known = manifest.groupBy(F.lower("story_sha256").alias(column)).agg(F.max_by("phase", "story_id").alias("recorded"))
    seen = training.select(F.lower("story_sha256").alias(column)).distinct().withColumn("trained", F.lit(True))
    out = items.select(F.lower(column).alias(column)).distinct().join(known, column, "left").join(seen, column, "left")
    return out.withColumn("trained", F.coalesce("trained", F.lit(False)))


def _twice(items: DataFrame) -> DataFrame:
    return items.groupBy("id").agg(F.min("phase").alias("phase"), F.count("*").alias("c")).where("c > 1").select("phase", "id", F.lit("duplicate id").alias("rule"))


def cloze_contract(items: DataFrame, manifest: DataFrame, training: DataFrame, filed: str = "phase") -> DataFrame:
    """(phase, id, rule) of cloze items against all their rules; filed: the column with the phase of the file an item is in.

    A null in a field that a rule reads breaks it. manifest: (story_sha256, phase, story_id); training: (story_sha256).
    """
    sources = _sourced(items, "story_sha256", manifest, training).withColumnRenamed("story_sha256", "_sha")
    rows = items.join(sources, F.lower("story_sha256") == F.col("_sha"), "left")
    masks = (F.length("text_with_mask") - F.length(F.replace("text_with_mask", F.lit(T.MASK), F.lit("")))) / len(T.MASK)
    low = F.transform(F.regexp_extract_all(F.replace("text_with_mask", F.lit(T.MASK), F.lit(" ")), F.lit(f"({T.WORD})")), F.lower)
    answer, has = F.col("answer"), F.col("story_sha256").isNotNull()
    rules = {
        "phase": F.col("phase") != F.col(filed),
        "one mask": masks != 1,
        "candidate count": F.size("candidates") != N_CANDIDATES,
        "answer missing": ~F.array_contains("candidates", answer),
        "same word twice": F.size(F.array_distinct(F.transform("candidates", T.casefold))) != F.size("candidates"),
        "inflection": F.exists("candidates", lambda w: (w != answer) & T.related(w, answer)),
        "answer visible": F.array_contains(low, F.lower(answer)),
        "source of another phase": has & ~F.col("recorded").eqNullSafe(F.col("phase")),
        "source in training": has & F.col("trained"),
    }
    return _listed(rows, rules).unionByName(_twice(items))


def continuation_contract(items: DataFrame, manifest: DataFrame, training: DataFrame, filed: str = "phase", n_options: int | None = N_OPTIONS) -> DataFrame:
    """(phase, id, rule) of continuation items against all their rules.

    n_options None: the check at loading, which takes any count from two on, alike in a phase, and does not ask for
    distractor_phases nor for training stories.
    """
    spread = items.select("id", F.posexplode("option_sources").alias("at", "source"))
    spread = spread.select("id", "at", "source.story_id", "source.story_sha256", F.col("source.phase").alias("phase_claimed"))
    known = spread.join(_sourced(spread, "story_sha256", manifest, training).withColumnRenamed("story_sha256", "_sha"), F.lower("story_sha256") == F.col("_sha"), "left")
    bare = F.col("story_id").isNull() | F.col("story_sha256").isNull() | F.col("phase_claimed").isNull()
    sums = known.groupBy("id").agg(
        F.max(bare).alias("bare"),
        F.max(F.col("story_sha256").isNotNull() & F.col("recorded").isNull()).alias("unknown"),
        F.max(F.col("recorded") != F.col("phase_claimed")).alias("claims"),
        F.max("trained").alias("trained"),
    )
    rows = items.join(sums, "id", "left")
    at = F.col("answer_index")
    answer = F.get("option_sources", at)
    others = F.filter("option_sources", lambda _, i: i != at)
    size, n = F.size("options"), F.size("option_sources")
    inside = at.isNotNull() & (at >= 0) & (at < size)
    ready = inside & (n == size)
    rules = {
        "phase": F.col("phase") != F.col(filed),
        "option count": (size < 2) if n_options is None else (size != n_options),
        "answer index": ~inside,
        "sources": F.coalesce(n, F.lit(-1)) != size,
        "source fields": F.coalesce("bare", F.lit(False)),
        "source unknown": F.coalesce("unknown", F.lit(False)),
        "source phase": F.coalesce("claims", F.lit(False)),
        "answer of another phase": ready & ~answer["phase"].eqNullSafe(F.col("phase")),
        "distractor of another phase": ready & F.exists(others, lambda s: ~s["phase"].eqNullSafe(F.col("phase"))),
        "distractor of the answer's story": ready & F.exists(others, lambda s: s["story_id"].eqNullSafe(answer["story_id"])),
    }
    if n_options is not None:
        rules |= {
            "source in training": F.coalesce("trained", F.lit(False)),
            "two of one story": ready & (F.size(F.array_distinct(F.transform(others, lambda s: s["story_id"]))) != F.size(others)),
            "no distractor phases": F.coalesce(F.size("distractor_phases"), F.lit(0)) <= 0,
            "distractor phases": ready & (F.coalesce(F.size("distractor_phases"), F.lit(0)) > 0) & ~F.transform(others, lambda s: s["phase"]).eqNullSafe(F.col("distractor_phases")),
            "same option twice": F.size(F.array_distinct("options")) != size,
        }
    out = _listed(rows, rules).unionByName(_twice(items))
    if n_options is None:
        mixed = items.groupBy("phase").agg(F.min(size).alias("a"), F.max(size).alias("b")).where("a <> b")
        out = out.unionByName(mixed.select("phase", F.lit(None).cast("string").alias("id"), F.lit("option counts differ").alias("rule")))
    return out


def shortfalls(items: DataFrame, asked: int, phases: list[int]) -> DataFrame:
    """(rule, entity, detail) of phases that have fewer items than are asked of each, phases without any included."""
    every = items.sparkSession.createDataFrame([(k,) for k in phases], "phase int")
    counts = every.join(items.groupBy("phase").agg(F.count("*").alias("n")), "phase", "left").select("phase", F.coalesce("n", F.lit(0)).alias("n"))
    return counts.where(F.col("n") < asked).select(F.lit("too few items").alias("rule"), F.col("phase").cast("string").alias("entity"), F.concat(F.col("n").cast("string"), F.lit(f" of {asked}")).alias("detail"))


def asked_items(items: DataFrame, asked: int, phases: list[int]) -> DataFrame:
    """The first `asked` items of each phase by id; ContractViolation if a phase has fewer: a short exam is refused, not given."""
    guard.enforce(shortfalls(items, asked, phases))
    turn = Window.partitionBy("phase").orderBy("id")
    return items.where(F.col("phase").isin(phases)).withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") <= asked).drop("_turn")


def phase_row_violations(stories: DataFrame, filed: str = "phase") -> DataFrame:
    """(phase, id, rule) of stories that are not of the phase they are filed under, or hold the mask."""
    rules = {"phase": ~F.col("phase").eqNullSafe(F.col(filed)), "holds the mask": F.coalesce(F.contains("story", F.lit(T.MASK)), F.lit(False))}
    return _listed(stories.select("phase", F.col("id").cast("string").alias("id"), *([filed] if filed != "phase" else []), "story"), rules)


def giveaway_report(items: DataFrame) -> DataFrame:
    """For each phase: items, answers in each slot, mean ratio of the answer's length to the others' mean, share strictly longest."""
    mine = F.length("answer")
    lengths = F.transform("options", F.length)
    total = F.aggregate(lengths, F.lit(0), lambda a, x: a + x)
    others = (total - mine) / (F.size("options") - 1)
    longest = F.size(F.filter(lengths, lambda x: x >= mine)) == 1
    slots = [F.count(F.when(F.col("answer_index") == k, 1)).alias(f"slot_{k}") for k in range(N_OPTIONS)]
    ratio = F.bround(F.avg(F.when(others > 0, mine / others).otherwise(float("inf"))), 6).alias("length_ratio")
    return items.groupBy("phase").agg(F.count("*").alias("n"), *slots, ratio, F.bround(F.avg(longest.cast("double")), 6).alias("longest_share"))
