"""DuckDB SQL for the queries, written on its own."""

from __future__ import annotations

from storyloom.plans import contract_oracles

ORACLES: dict[str, str] = dict(contract_oracles.ORACLES)

_FOLD = "replace(lower({}), 'ß', 'ss')"
_WORDS = r"regexp_extract_all(" + _FOLD + r", '[\p{{L}}\p{{N}}_]+')"
_SQUEEZED = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_STORY = f"sha256({_SQUEEZED.format('story')})"
_TRAIN = "train AS (SELECT doc_id AS id, (doc_id % 7)::INTEGER AS phase, lang AS tier, text AS story, doc_id AS lineno, source AS model FROM documents)"
_EXAM = "exam AS (SELECT item_id AS id, (item_id % 7)::INTEGER AS phase, text AS story FROM benchmark)"
_PAIR = "exam AS (SELECT * FROM train0 WHERE model IN ('src1', 'src2')), train AS (SELECT * FROM train0 WHERE model NOT IN ('src1', 'src2'))"
_TRAIN0 = _TRAIN.replace("train AS", "train0 AS")
_DRAW = "sha256(concat_ws('|', '7', '{}', {}))"


def _sides(post: int) -> str:
    """Shingles, rare ones, candidates and their scores of exam and train."""
    sets = """{s}w AS (SELECT id, phase, {words} AS w, left({squeezed}, 200) AS prefix FROM {s}),
{s}s AS (SELECT id, phase, prefix, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM {s}w),
{s}x AS (SELECT id, unnest(s) AS g FROM {s}s)"""
    both = ",\n".join(sets.format(s=s, words=_WORDS.format("story"), squeezed=_SQUEEZED.format(_FOLD.format("story"))) for s in ("exam", "train"))
    return both + f""",
rare AS (SELECT g FROM examx GROUP BY g HAVING count(*) <= {post}),
cand AS (SELECT DISTINCT e.id AS exam_id, t.id AS train_id FROM examx e JOIN rare USING (g) JOIN trainx t USING (g)
    UNION SELECT e.id, t.id FROM exams e JOIN trains t ON e.prefix = t.prefix AND e.prefix <> ''),
inter AS (SELECT c.exam_id, c.train_id, count(*) AS n FROM cand c JOIN examx e ON e.id = c.exam_id JOIN trainx t ON t.id = c.train_id AND t.g = e.g GROUP BY ALL),
scored AS (
    SELECT c.exam_id, e.phase AS exam_phase, c.train_id, t.phase AS train_phase, e.prefix = t.prefix AND e.prefix <> '' AS by_prefix,
        CASE WHEN len(e.s) > 0 THEN coalesce(i.n, 0) / len(e.s) ELSE 0.0 END AS containment,
        CASE WHEN len(e.s) + len(t.s) - coalesce(i.n, 0) > 0 THEN coalesce(i.n, 0) / (len(e.s) + len(t.s) - coalesce(i.n, 0)) ELSE 0.0 END AS jaccard
    FROM cand c JOIN exams e ON e.id = c.exam_id JOIN trains t ON t.id = c.train_id LEFT JOIN inter i ON i.exam_id = c.exam_id AND i.train_id = c.train_id
),
flagged AS (SELECT * FROM scored WHERE by_prefix OR containment >= 0.5)"""


_FLAGGED = """SELECT exam_id, exam_phase, train_id, train_phase, CASE WHEN by_prefix AND containment >= 0.5 THEN 'prefix+shingle' WHEN by_prefix THEN 'prefix' ELSE 'shingle' END AS rule,
    round_even(containment, 4) AS containment, round_even(jaccard, 4) AS jaccard FROM flagged"""
ORACLES["near_duplicate_pairs"] = f"WITH {_TRAIN}, {_EXAM}, {_sides(64)} {_FLAGGED}"
ORACLES["near_duplicate_pairs_by_source"] = f"WITH {_TRAIN0}, {_PAIR}, {_sides(64)} {_FLAGGED}"
ORACLES["near_duplicate_pairs_uncapped"] = f"WITH {_TRAIN0}, {_PAIR}, {_sides(2**62)} {_FLAGGED}"
ORACLES["near_duplicate_by_phase"] = f"""WITH {_TRAIN0}, {_PAIR}, {_sides(64)}
SELECT e.phase, count(*)::BIGINT AS n_stories, any_value(coalesce(d.n, 0))::BIGINT AS n_dropped, any_value(round_even(coalesce(m.top, 0.0), 4)) AS max_containment
FROM exam e LEFT JOIN (SELECT exam_phase, count(DISTINCT exam_id) AS n FROM flagged GROUP BY 1) d ON d.exam_phase = e.phase
LEFT JOIN (SELECT exam_phase, max(containment) AS top FROM scored GROUP BY 1) m ON m.exam_phase = e.phase GROUP BY e.phase"""
ORACLES["drop_near_duplicates"] = f"WITH {_TRAIN0}, {_PAIR}, {_sides(64)} SELECT id, phase FROM exam WHERE id NOT IN (SELECT exam_id FROM flagged)"

_GRAMS = "SELECT DISTINCT phase, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM (SELECT phase, " + _WORDS.format("story") + " AS w FROM {}) WHERE len(w) >= 8"
ORACLES["verbatim_ngram_overlap"] = f"""WITH {_TRAIN}, {_EXAM}, e AS ({_GRAMS.replace("{}", "exam")}), t AS ({_GRAMS.replace("{}", "train")}),
cells AS (SELECT * FROM (SELECT DISTINCT phase AS exam_phase FROM exam), (SELECT DISTINCT phase AS train_phase FROM train)),
hit AS (SELECT e.phase AS exam_phase, t.phase AS train_phase, count(*) AS n FROM e JOIN t USING (g) GROUP BY ALL), total AS (SELECT phase AS exam_phase, count(*) AS n FROM e GROUP BY 1)
SELECT c.exam_phase, c.train_phase, coalesce(total.n, 0)::BIGINT AS n_exam_ngrams, coalesce(hit.n, 0)::BIGINT AS n_shared,
    round_even(CASE WHEN coalesce(total.n, 0) > 0 THEN coalesce(hit.n, 0) / total.n ELSE 0.0 END, 6) AS fraction
FROM cells c LEFT JOIN total USING (exam_phase) LEFT JOIN hit USING (exam_phase, train_phase)"""

_SENTENCES = "SELECT id, phase, array_to_string(w, ' ') AS s FROM (SELECT id, phase, " + _WORDS.format("p") + r" AS w FROM (SELECT id, phase, unnest(regexp_split_to_array(story, '[.!?\n]+')) AS p FROM {})) WHERE len(w) >= 6"
ORACLES["verbatim_sentence_overlap"] = f"""WITH {_TRAIN}, {_EXAM}, e AS ({_SENTENCES.replace("{}", "exam")}), t AS (SELECT DISTINCT phase, s FROM ({_SENTENCES.replace("{}", "train")})),
hit AS (SELECT e.phase AS exam_phase, t.phase AS train_phase, count(*) AS n, count(DISTINCT e.id) AS k FROM e JOIN t USING (s) GROUP BY ALL),
cells AS (SELECT * FROM (SELECT phase AS exam_phase, count(DISTINCT id)::BIGINT AS n_stories FROM exam GROUP BY 1), (SELECT DISTINCT phase AS train_phase FROM train))
SELECT c.exam_phase, c.train_phase, coalesce((SELECT count(*) FROM e WHERE e.phase = c.exam_phase), 0)::BIGINT AS n_exam_sentences, c.n_stories, coalesce(h.n, 0)::BIGINT AS n_shared,
    coalesce(h.k, 0)::BIGINT AS n_stories_hit, round_even(coalesce(h.k, 0) / c.n_stories, 6) AS story_fraction
FROM cells c LEFT JOIN hit h USING (exam_phase, train_phase)"""

ORACLES["story_hash_duplicates"] = f"WITH {_TRAIN} SELECT {_STORY} AS story_sha256, count(*)::BIGINT AS n, min(id) AS first_id FROM train GROUP BY 1 HAVING count(*) > 1"
ORACLES["leak_line_hits"] = f"""WITH {_TRAIN0}, {_PAIR},
m AS (SELECT id::VARCHAR AS story_id, id, sha256(id::VARCHAR) AS prompt_hash, {_STORY} AS sha FROM exam),
leaves AS (SELECT id::VARCHAR AS entity, 'story' AS location, story AS value FROM train UNION ALL SELECT id::VARCHAR, 'model', model FROM train UNION ALL SELECT id::VARCHAR, 'tier', tier FROM train
    UNION ALL SELECT id::VARCHAR, 'line ' || (unnest(range(len(l)))), unnest(l) FROM (SELECT id, regexp_split_to_array(story, '\\r\\n|\\r|\\n') AS l FROM train)),
v AS (SELECT * FROM leaves WHERE value IS NOT NULL AND (location NOT LIKE 'line%' OR trim(value) <> ''))
SELECT v.entity, v.location, CASE WHEN p.prompt_hash IS NOT NULL THEN 'prompt_hash' ELSE 'story_sha256' END AS reason, coalesce(p.story_id, s.story_id) AS story_id
FROM v LEFT JOIN m p ON p.prompt_hash = v.value LEFT JOIN (SELECT sha, max(id)::VARCHAR AS story_id FROM m GROUP BY sha) s ON s.sha = sha256({_SQUEEZED.format("v.value")})
WHERE p.prompt_hash IS NOT NULL OR s.sha IS NOT NULL"""
ORACLES["manifest_story_reconcile_all"] = f"""WITH {_TRAIN}, x AS (SELECT *, {_STORY} AS sha FROM train),
d AS (SELECT sha, count(*) AS n, min(phase) AS a, max(phase) AS b FROM x WHERE coalesce(id % 11, 0) <> 4 GROUP BY sha),
m AS (SELECT sha, arg_max(CASE WHEN id % 13 = 5 THEN phase + 1 ELSE phase END, id) AS phase FROM x WHERE coalesce(id % 17, 0) <> 3 GROUP BY sha),
j AS (SELECT coalesce(d.sha, m.sha) AS sha, d.n, CASE WHEN m.phase IS NULL THEN 'not in manifest' WHEN d.n IS NULL THEN 'missing' WHEN d.n > 1 THEN 'duplicate' WHEN d.a <> m.phase OR d.b <> m.phase THEN 'wrong phase' END AS problem FROM d FULL JOIN m ON d.sha = m.sha)
SELECT sha, problem, coalesce(n, 0)::BIGINT AS n FROM j WHERE problem IS NOT NULL"""
ORACLES["provenance_violations"] = f"""WITH {_TRAIN}, p AS (SELECT phase, list_sort(list(DISTINCT model)) AS m FROM train GROUP BY phase), w AS (SELECT list_sort(list(DISTINCT model)) AS m FROM train)
SELECT 'phase_models' AS rule, phase::VARCHAR AS entity, array_to_string(m, ',') AS detail FROM p WHERE len(m) <> 1
UNION ALL SELECT 'models', 'all', array_to_string(m, ',') FROM w WHERE len(m) <> 1
UNION ALL SELECT 'exam_model', 'src0', array_to_string(m, ',') FROM w WHERE NOT list_contains(m, 'src0')"""
ORACLES["split_violations"] = f"""WITH {_TRAIN}, s AS (SELECT t.*, CASE WHEN l.quality = 0 THEN 'eval' ELSE 'train' END AS split FROM train t LEFT JOIN labels l ON l.doc_id = t.id)
SELECT 'split' AS rule, id::VARCHAR AS entity, split AS detail FROM s WHERE split <> 'train'
UNION ALL SELECT 'model', id::VARCHAR, 'empty' FROM s WHERE coalesce(model, '') = '' UNION ALL SELECT 'story', id::VARCHAR, 'empty' FROM s WHERE coalesce(story, '') = ''
UNION ALL SELECT 'id', '?', 'empty' FROM s WHERE id IS NULL"""
ORACLES["labelled_gate"] = f"WITH {_TRAIN} SELECT phase, count(*)::BIGINT AS n_kept FROM train WHERE id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 OR toxic = 1) GROUP BY phase"
ORACLES["replay_selection"] = f"WITH {_TRAIN}, r AS (SELECT phase, id, row_number() OVER (PARTITION BY phase ORDER BY {_DRAW.format('replay', 'phase, id')}, id)::INTEGER AS rank FROM train) SELECT * FROM r WHERE rank <= 50"

_TOKENS = "strlen(replace(coalesce(story, ''), chr(0), '')) + 1"
_SUMMARY = f"summary AS (SELECT phase, count(*)::BIGINT AS n_stories, sum({_TOKENS})::BIGINT AS n_tokens, array_to_string(list_sort(list(DISTINCT model)), ',') AS models, (sum({_TOKENS}) // 1024)::BIGINT AS n_sequences FROM train GROUP BY phase)"
ORACLES["replay_pool_sizes"] = f"WITH {_TRAIN}, {_SUMMARY} SELECT a.phase, coalesce(sum(b.n_sequences), 0)::BIGINT AS pool FROM summary a LEFT JOIN summary b ON b.phase < a.phase GROUP BY a.phase"
ORACLES["keep_hash_missing"] = f"WITH {_TRAIN}, w AS (SELECT DISTINCT doc_id * 2 AS id FROM labels) SELECT id, 'kept' AS state FROM train WHERE id IN (SELECT id FROM w) UNION ALL SELECT id, 'missing' FROM w WHERE id NOT IN (SELECT id FROM train)"
ORACLES["first_hashes"] = f"WITH {_TRAIN}, r AS (SELECT phase, id, lineno, dense_rank() OVER (PARTITION BY phase ORDER BY lineno) AS nr FROM train) SELECT phase, id, lineno FROM r WHERE nr <= 20"
ORACLES["byte_token_counts"] = f"WITH {_TRAIN} SELECT phase, id, ({_TOKENS})::BIGINT AS n_tokens FROM train"
ORACLES["packed_sequences"] = f"""WITH {_TRAIN}, h AS (SELECT phase, string_agg(hex(encode(replace(coalesce(story, ''), chr(0), ''))) || '00', '' ORDER BY lineno) AS h FROM train GROUP BY phase),
k AS (SELECT phase, h, unnest(range(strlen(h) // 2048)) AS seq_id FROM h)
SELECT phase, seq_id::BIGINT AS seq_id, sha256(substr(h, seq_id * 2048 + 1, 2048)) AS tokens_sha256 FROM k"""
ORACLES["corpus_summary"] = f"WITH {_TRAIN}, {_SUMMARY} FROM summary"
ORACLES["token_budget"] = f"""WITH {_TRAIN}, {_SUMMARY}, arms(arm, r, np, rp) AS (VALUES ('A', 0, 1, 1), ('B', 14, 1, 1), ('C', 0, 1, 1), ('D', 14, 2, 1), ('D-nr', 0, 2, 1), ('E', 0, 1, 1)),
per AS (SELECT arm, phase, greatest(1, (n_sequences * 4 + 31) // 32) AS steps, CASE WHEN phase > 0 THEN np ELSE 1 END AS np, CASE WHEN phase > 0 THEN r * rp ELSE 0 END AS rr FROM summary, arms),
s AS (SELECT arm, phase, sum(steps)::BIGINT AS steps, sum(steps * 32 * 1024 * np)::BIGINT AS new_tokens, sum(steps * rr * 1024)::BIGINT AS replay_tokens FROM per GROUP BY GROUPING SETS ((arm, phase), (arm)))
SELECT s.*, round_even((s.new_tokens + s.replay_tokens) / (a.new_tokens + a.replay_tokens), 6) AS tokens_vs_arm_a FROM s JOIN s a ON a.arm = 'A' AND a.phase IS NOT DISTINCT FROM s.phase"""
ORACLES["lr_schedule"] = "SELECT i::BIGINT AS step, round((CASE WHEN i < 200 THEN (i + 1) / 200 ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * ((i - 200) / 800))) END) * 0.0003, 12) AS rate FROM range(1000) t(i)"
ORACLES["epoch_batches"] = f"""WITH {_TRAIN}, x AS (SELECT phase, id AS seq_id, unnest([0, 1]) AS epoch FROM train), n AS (SELECT phase, count(*) AS n FROM train GROUP BY 1),
r AS (SELECT x.*, n.n, row_number() OVER (PARTITION BY x.phase, epoch ORDER BY {_DRAW.format('epoch', 'x.phase, epoch, seq_id')}) - 1 AS k FROM x JOIN n ON n.phase = x.phase)
SELECT phase, ((epoch * n + k) // 32)::BIGINT AS step, ((epoch * n + k) % 32)::BIGINT AS slot, epoch::INTEGER AS epoch, seq_id FROM r"""
ORACLES["replay_draws"] = f"""WITH {_TRAIN}, p AS (SELECT phase, count(*) AS pool FROM train GROUP BY 1), g AS (SELECT p.*, s.step, t.slot FROM p, range(20) s(step), range(14) t(slot))
SELECT phase, step::INTEGER AS step, slot::INTEGER AS slot, (('0x' || substr({_DRAW.format('replay-draw', 'phase, step, slot')}, 1, 15))::BIGINT % pool)::BIGINT AS index FROM g"""
ORACLES["perplexity_windows"] = f"""WITH {_TRAIN}, t AS (SELECT phase, {_TOKENS} - 1 AS n FROM train), w AS (SELECT phase, n // 1024 AS f, n % 1024 AS r FROM t)
SELECT phase, sum(f + CASE WHEN r >= 2 THEN 1 ELSE 0 END)::BIGINT AS n_windows, sum(f * 1023 + CASE WHEN r >= 2 THEN r - 1 ELSE 0 END)::BIGINT AS n_predicted FROM w GROUP BY phase"""


def _unnested(key: str, text: str, source: str) -> str:
    return f"SELECT {key}i AS pos, substr(h, i * 2 - 1, 2) AS prev, substr(h, i * 2 + 1, 2) AS next FROM (SELECT *, unnest(range(1, strlen(h) // 2)) AS i FROM (SELECT *, '00' || hex(encode({text})) AS h FROM {source}))"


_MODEL = """counts AS (SELECT prev, next, count(*) AS c FROM grams GROUP BY ALL), totals AS (SELECT prev, sum(c) AS t FROM counts GROUP BY prev)"""
_LOGP = "coalesce(ln((coalesce(m.c, 0) + 1.0) / (o.t + 256.0)), -ln(256.0))"
ORACLES["bigram_perplexity"] = f"""WITH {_TRAIN}, {_EXAM}, grams AS ({_unnested("", "story", "train")}), {_MODEL},
p AS (SELECT phase, prev, next, count(*) AS c FROM ({_unnested("phase, ", "story", "exam")}) GROUP BY ALL)
SELECT phase, sum(p.c)::BIGINT AS n_tokens, round(-sum(p.c * {_LOGP}) / sum(p.c), 6) AS loss FROM p LEFT JOIN counts m ON m.prev = p.prev AND m.next = p.next LEFT JOIN totals o ON o.prev = p.prev GROUP BY phase"""

_CUT = "CASE " + " ".join(f"WHEN ends_with(f, '{e}') AND length(f) - {len(e)} >= 3{' AND NOT ends_with(f, ' + chr(39) + 'ss' + chr(39) + ')' if e == 's' else ''} THEN left(f, length(f) - {len(e)})" for e in ("ing", "est", "ed", "er", "es", "ly", "s")) + " END"
_LEXICON = rf"""seenw AS (SELECT DISTINCT phase, id, unnest(regexp_extract_all(story, '[\p{{L}}\p{{N}}_]+')) AS word FROM train),
lex0 AS (SELECT phase, word FROM seenw WHERE length(word) >= 5 AND word = lower(word) GROUP BY ALL HAVING count(*) BETWEEN 2 AND 40),
lex1 AS (SELECT phase, word, f, row_number() OVER (PARTITION BY phase, f ORDER BY word) AS nr FROM (SELECT phase, word, {_FOLD.format("word")} AS f FROM lex0)),
lex2 AS (SELECT phase, word, f, {_CUT} AS cut FROM lex1 WHERE nr = 1),
lex3 AS (SELECT phase, word, CASE WHEN length(f) > 4 AND ends_with(f, 'ies') THEN left(f, length(f) - 3) || 'y' WHEN cut IS NULL THEN f WHEN substr(cut, -1, 1) = substr(cut, -2, 1) THEN left(cut, length(cut) - 1) ELSE cut END AS s FROM lex2),
lex AS (SELECT phase, word, CASE WHEN length(s) > 3 AND ends_with(s, 'e') THEN left(s, length(s) - 1) ELSE s END AS stem FROM lex3),
able AS (SELECT a.phase, a.word, a.stem FROM lex a JOIN (SELECT phase, count(*) AS n FROM lex GROUP BY 1) n ON n.phase = a.phase JOIN (SELECT phase, stem, count(*) AS k FROM lex GROUP BY ALL) k ON k.phase = a.phase AND k.stem = a.stem WHERE n.n - k.k >= 19),
occ AS (SELECT phase, id, unnest(regexp_extract_all(story, '[\p{{L}}\p{{N}}_]+')) AS seen FROM train),
once AS (SELECT phase, id, lower(seen) AS low, min(seen) AS seen FROM occ GROUP BY ALL HAVING count(*) = 1),
hits AS (SELECT o.phase, o.id AS story_id, a.word, a.stem, row_number() OVER (PARTITION BY o.phase, o.id ORDER BY {_DRAW.format('cloze-answer', 'o.phase, o.id, a.word')}) AS nr FROM once o JOIN able a ON a.phase = o.phase AND lower(a.word) = o.low AND a.word = o.seen),
chosen AS (SELECT * FROM (SELECT phase, story_id, word AS answer, stem, row_number() OVER (PARTITION BY phase ORDER BY {_DRAW.format('cloze-order', 'phase, story_id')})::INTEGER AS item FROM hits WHERE nr = 1) WHERE item <= 40),
listed AS (SELECT phase, word, stem, row_number() OVER (PARTITION BY phase ORDER BY {_DRAW.format('cloze-lexicon', 'phase, word')}) - 1 AS place, count(*) OVER (PARTITION BY phase) AS n FROM lex),
tries AS (SELECT c.phase, c.story_id, c.stem, r.nr, ('0x' || substr({_DRAW.format('cloze-candidate', 'c.phase, c.story_id, r.nr')}, 1, 15))::BIGINT % n.n AS place FROM chosen c JOIN (SELECT phase, any_value(n) AS n FROM listed GROUP BY phase) n ON n.phase = c.phase, range(32) r(nr)),
seen32 AS (SELECT t.phase, t.story_id, l.word, min(t.nr) AS nr FROM tries t JOIN listed l ON l.phase = t.phase AND l.place = t.place WHERE l.stem <> t.stem GROUP BY t.phase, t.story_id, l.word),
filled32 AS (SELECT phase, story_id, word, row_number() OVER (PARTITION BY phase, story_id ORDER BY nr) AS nr, count(*) OVER (PARTITION BY phase, story_id) AS c FROM seen32),
oth AS (SELECT phase, story_id, word, nr FROM filled32 WHERE c >= 19 UNION ALL
    SELECT c.phase, c.story_id, l.word, row_number() OVER (PARTITION BY c.phase, c.story_id ORDER BY {_DRAW.format('cloze-rest', 'c.phase, c.story_id, l.word')}) AS nr FROM (SELECT * FROM chosen ANTI JOIN (SELECT * FROM filled32 WHERE c >= 19) USING (phase, story_id)) c JOIN lex l ON l.phase = c.phase AND l.stem <> c.stem),
cands AS (SELECT phase, story_id, word FROM oth WHERE nr < 20 UNION ALL SELECT phase, story_id, answer FROM chosen)"""
ORACLES["cloze_items"] = rf"""WITH {_TRAIN}, {_LEXICON}
SELECT c.phase, c.item, c.story_id, c.answer, sha256(regexp_replace(story, '(^|[^\p{{L}}\p{{N}}_])' || c.answer || '($|[^\p{{L}}\p{{N}}_])', '\1[MASK]\2')) AS text_sha256,
    (SELECT string_agg(word, ',' ORDER BY {_DRAW.format('cloze-shuffle', 'k.story_id, word')}) FROM cands k WHERE k.phase = c.phase AND k.story_id = c.story_id) AS candidates
FROM chosen c JOIN train t ON t.id = c.story_id"""
ORACLES["probe_violations"] = f"""WITH {_TRAIN}, {_LEXICON}, bad AS (SELECT c.story_id FROM cands c GROUP BY ALL HAVING count(*) <> 20 OR count(DISTINCT {_FOLD.format("word")}) <> 20)
SELECT 'candidate count' AS rule, count(*)::BIGINT AS n FROM bad HAVING count(*) > 0"""

_LEXICON_ALL = _LEXICON.replace(" WHERE item <= 40", "").replace("SELECT phase, word FROM seenw WHERE length(word) >= 5 AND word = lower(word) GROUP BY ALL HAVING count(*) BETWEEN 2 AND 40", "SELECT phase, word FROM (SELECT phase, word, count(*) AS c FROM seenw WHERE length(word) >= 5 AND word = lower(word) GROUP BY ALL) JOIN (SELECT phase, count(*) AS n FROM train GROUP BY phase) USING (phase) WHERE c >= 2 AND c * 100 <= n * 28")
for _name in ("cloze_items", "probe_violations"):
    ORACLES[f"{_name}_all"] = ORACLES.pop(_name).replace(_LEXICON, _LEXICON_ALL)

_ITEMS = rf"""plain AS (SELECT phase, id AS story_id, trim(regexp_replace(story, '\r\n|\r', chr(10), 'g'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM train),
parts AS (SELECT phase, story_id, list_filter(list_transform(CASE WHEN regexp_matches(t, '\n\s*\n') THEN regexp_split_to_array(t, '\n\s*\n') ELSE regexp_split_to_array(t, '\n') END, lambda x: trim(x)), lambda x: x <> '') AS p FROM plain),
items AS (SELECT phase, story_id, array_to_string(p[:-2], chr(10)) AS prefix, p[-1] AS answer, row_number() OVER (PARTITION BY phase ORDER BY {_DRAW.format('continuation', 'phase, story_id')}) AS turn, count(*) OVER (PARTITION BY phase) AS n FROM parts WHERE len(p) >= 2),
seek AS (SELECT i.*, o.story_id AS other_id, o.answer AS opt, row_number() OVER (PARTITION BY i.phase, i.story_id ORDER BY CASE WHEN length(o.answer) / length(i.answer) BETWEEN 0.5 AND 2.0 THEN 0 ELSE 1 END, {_DRAW.format('distractor', 'i.story_id, o.story_id')}) AS nr
    FROM items i, range(1, 13) s(step) JOIN items o ON o.phase = i.phase AND o.turn = (i.turn - 1 + step) % i.n + 1 WHERE step < i.n AND o.answer <> i.answer),
final AS (SELECT phase, story_id, any_value(prefix) AS prefix, any_value(answer) AS answer, any_value((turn - 1) % 4)::INTEGER AS answer_index, list(opt ORDER BY nr) AS d FROM seek WHERE nr < 4 GROUP BY phase, story_id HAVING count(*) = 3),
cont AS (SELECT *, list_concat(list_concat(d[:answer_index], [answer]), d[answer_index + 1:]) AS options FROM (SELECT * FROM final WHERE answer_index > 0) UNION ALL SELECT *, list_concat([answer], d) FROM final WHERE answer_index = 0)"""
ORACLES["continuation_items"] = f"WITH {_TRAIN}, {_ITEMS} SELECT phase, story_id, answer_index, sha256(prefix) AS prefix_sha256, sha256(array_to_string(options, chr(10))) AS options_sha256 FROM cont"
ORACLES["giveaway_report"] = f"""WITH {_TRAIN}, {_ITEMS}, x AS (SELECT phase, answer_index AS a, length(answer) AS m, list_sum(list_transform(d, lambda o: length(o))) / 3 AS o, list_max(list_transform(d, lambda o: length(o))) AS top FROM cont)
SELECT phase, count(*)::BIGINT AS n, (count(*) FILTER (WHERE a = 0))::BIGINT AS slot_0, (count(*) FILTER (WHERE a = 1))::BIGINT AS slot_1, (count(*) FILTER (WHERE a = 2))::BIGINT AS slot_2, (count(*) FILTER (WHERE a = 3))::BIGINT AS slot_3,
    round_even(avg(m / o), 6) AS length_ratio, round_even(avg((m > top)::INTEGER::DOUBLE), 6) AS longest_share FROM x GROUP BY phase"""
ORACLES["continuation_pmi"] = f"""WITH {_TRAIN}, {_EXAM}, {_ITEMS}, grams AS ({_unnested("", "story", "exam")}), {_MODEL},
o0 AS (SELECT phase, story_id, answer_index, right(hex(encode(prefix)), 2) AS tail, unnest(range(4)) AS nr, unnest(options) AS opt FROM cont),
b AS (SELECT * FROM ({_unnested("phase, story_id, answer_index, nr, tail, strlen(opt) AS l, ", "opt", "o0")}) WHERE pos > l - 1023),
l AS (SELECT b.phase, b.story_id, b.answer_index, b.nr, round(sum({_LOGP}), 9) AS base, round(sum({_LOGP.replace("m.c", "m2.c").replace("o.t", "o2.t")}), 9) AS cond
    FROM b LEFT JOIN counts m ON m.prev = b.prev AND m.next = b.next LEFT JOIN totals o ON o.prev = b.prev
    LEFT JOIN counts m2 ON m2.prev = CASE WHEN b.pos = 1 THEN b.tail ELSE b.prev END AND m2.next = b.next LEFT JOIN totals o2 ON o2.prev = CASE WHEN b.pos = 1 THEN b.tail ELSE b.prev END GROUP BY ALL),
v AS (SELECT *, round(cond - base, 6) AS pmi, round(cond, 6) AS s FROM l),
r AS (SELECT phase, story_id, max(pmi) FILTER (WHERE nr = answer_index) > max(pmi) FILTER (WHERE nr <> answer_index) AS p, max(s) FILTER (WHERE nr = answer_index) > max(s) FILTER (WHERE nr <> answer_index) AS q FROM v GROUP BY ALL)
SELECT phase, count(*)::BIGINT AS n, (count(*) FILTER (WHERE p))::BIGINT AS n_pmi, (count(*) FILTER (WHERE q))::BIGINT AS n_summed FROM r GROUP BY phase"""

_PARTS = _ITEMS.split("items AS")[0].replace("SELECT phase, story_id, list_filter", "SELECT phase, story_id, CASE WHEN regexp_matches(t, '\\n\\s*\\n') THEN chr(10) || chr(10) ELSE chr(10) END AS sep, list_filter")
_DRAWN = _PARTS + f"""cuts AS (SELECT *, (('0x' || substr({_DRAW.format('continuation-cut', 'phase, story_id')}, 1, 15))::BIGINT % (len(p) - 1) + 1)::INTEGER AS cut FROM parts WHERE len(p) >= 2),
items AS (SELECT phase, story_id, CASE WHEN length(sep) = 2 THEN array_to_string(p[:cut], chr(10) || chr(10)) ELSE array_to_string(p[:cut], chr(10)) END || sep AS prefix, p[cut + 1] AS answer, length(p[cut + 1]) AS l, ((row_number() OVER (PARTITION BY phase ORDER BY {_DRAW.format('continuation-order', 'phase, story_id')}) - 1) % 4)::INTEGER AS answer_index FROM cuts),
pool0 AS (SELECT phase, story_id, k, p[k + 1] AS text FROM (SELECT *, unnest(range(1, len(p))) AS k FROM cuts)),
pool AS (SELECT *, length(text) AS l, row_number() OVER (PARTITION BY phase ORDER BY length(text), {_DRAW.format('continuation-pool', 'phase, story_id, k')}) - 1 AS place FROM pool0),
band AS (SELECT i.phase, i.story_id, count(*) FILTER (WHERE q.l * 2 < i.l) AS low, count(*) FILTER (WHERE q.l <= i.l * 2) AS high FROM items i JOIN pool q ON q.phase = i.phase GROUP BY ALL),
tries AS (SELECT phase, story_id, nr, low + ('0x' || substr({_DRAW.format('distractor', 'phase, story_id, nr')}, 1, 15))::BIGINT % (high - low) AS place FROM band, range(24) r(nr)),
drawn AS (SELECT i.phase, i.story_id, 0 AS late, t.nr::VARCHAR AS h, t.nr, q.story_id AS other, q.text FROM tries t JOIN items i USING (phase, story_id) JOIN pool q ON q.phase = t.phase AND q.place = t.place WHERE q.story_id <> i.story_id AND q.text <> i.answer),
lists AS (SELECT phase, story_id, list({{'o': other, 't': text}} ORDER BY nr) AS d FROM drawn GROUP BY ALL),
early AS (SELECT phase, story_id, d[1] AS x, list_filter(d, lambda c: c.o <> d[1].o AND c.t <> d[1].t) AS d2 FROM lists),
early2 AS (SELECT phase, story_id, x, d2[1] AS y, list_filter(d2, lambda c: c.o <> d2[1].o AND c.t <> d2[1].t)[1] AS z FROM early),
full1 AS (SELECT phase, story_id, x, y, z FROM early2 WHERE z IS NOT NULL),
lists2 AS (SELECT i.phase, i.story_id, list({{'o': q.story_id, 't': q.text}} ORDER BY CASE WHEN q.l * 2 >= i.l AND q.l <= i.l * 2 THEN 0 ELSE 1 END, {_DRAW.format('distractor-rest', 'i.story_id, q.story_id, q.k')}) AS d
    FROM (SELECT * FROM items ANTI JOIN full1 USING (phase, story_id)) i JOIN pool q ON q.phase = i.phase AND q.story_id <> i.story_id AND q.text <> i.answer GROUP BY ALL),
late AS (SELECT phase, story_id, d[1] AS x, list_filter(d, lambda c: c.o <> d[1].o AND c.t <> d[1].t) AS d2 FROM lists2),
late2 AS (SELECT phase, story_id, x, d2[1] AS y, list_filter(d2, lambda c: c.o <> d2[1].o AND c.t <> d2[1].t)[1] AS z FROM late),
picked AS (FROM full1 UNION ALL SELECT * FROM late2 WHERE z IS NOT NULL),
every AS (SELECT i.*, CASE WHEN x IS NULL THEN NULL ELSE [x.t, y.t, z.t] END AS d FROM items i LEFT JOIN picked USING (phase, story_id)),
cont AS (SELECT *, CASE answer_index WHEN 0 THEN [answer, d[1], d[2], d[3]] WHEN 1 THEN [d[1], answer, d[2], d[3]] WHEN 2 THEN [d[1], d[2], answer, d[3]] ELSE [d[1], d[2], d[3], answer] END AS options FROM every WHERE d IS NOT NULL)"""
ORACLES["continuation_items_drawn"] = f"""WITH {_TRAIN}, {_DRAWN} SELECT i.phase, i.story_id, i.answer_index, sha256(i.prefix) AS prefix_sha256, sha256(array_to_string(c.options, chr(10))) AS options_sha256
FROM items i LEFT JOIN cont c ON c.phase = i.phase AND c.story_id = i.story_id"""
for _name in ("giveaway_report", "continuation_pmi"):
    ORACLES[f"{_name}_drawn"] = ORACLES.pop(_name).replace(_ITEMS, _DRAWN)
del ORACLES["continuation_items"]
ORACLES["cloze_accuracy"] = f"""WITH {_TRAIN}, {_EXAM}, {_LEXICON_ALL}, grams AS ({_unnested("", "story", "exam")}), {_MODEL},
texts AS (SELECT c.phase, c.story_id, c.answer, regexp_replace(story, '(^|[^\\p{{L}}\\p{{N}}_])' || c.answer || '($|[^\\p{{L}}\\p{{N}}_])', '\\1[MASK]\\2') AS t FROM chosen c JOIN train t ON t.id = c.story_id),
filled AS (SELECT x.phase, x.story_id, x.answer, k.word, right(hex(encode(replace(x.t, '[MASK]', k.word))), 2048) AS h FROM texts x JOIN cands k ON k.phase = x.phase AND k.story_id = x.story_id),
b AS (SELECT phase, story_id, answer, word, substr(h, i * 2 - 1, 2) AS prev, substr(h, i * 2 + 1, 2) AS next FROM (SELECT *, unnest(range(1, strlen(h) // 2)) AS i FROM filled)),
p AS (SELECT phase, story_id, answer, word, prev, next, count(*) AS k FROM b GROUP BY ALL),
s AS (SELECT p.phase, p.story_id, p.answer, p.word, round(sum(p.k * {_LOGP}), 6) AS s FROM p LEFT JOIN counts m ON m.prev = p.prev AND m.next = p.next LEFT JOIN totals o ON o.prev = p.prev GROUP BY ALL),
r AS (SELECT phase, story_id, max(s) FILTER (WHERE word = answer) > max(s) FILTER (WHERE word <> answer) AS ok, count(*) AS k FROM s GROUP BY ALL)
SELECT phase, count(*)::BIGINT AS n, (count(*) FILTER (WHERE ok))::BIGINT AS n_correct, round(avg(ok::INTEGER::DOUBLE), 6) AS accuracy, round(avg(1 / k), 6) AS chance FROM r GROUP BY phase"""
ORACLES["item_shortfalls"] = f"""SELECT 'too few items' AS rule, p.phase::VARCHAR AS entity, coalesce(c.n, 0) || ' of 1000' AS detail FROM range(7) p(phase) LEFT JOIN (SELECT phase, n FROM ({ORACLES["cloze_accuracy"]})) c ON c.phase = p.phase WHERE coalesce(c.n, 0) < 1000"""
ORACLES["windowed_perplexity"] = f"""WITH {_TRAIN}, {_EXAM}, grams AS ({_unnested("", "story", "exam")}), {_MODEL},
p AS (SELECT phase, prev, next, count(*) AS c FROM ({_unnested("phase, ", "story", "train")}) WHERE (pos - 1) % 1024 <> 0 GROUP BY ALL)
SELECT phase, sum(p.c)::BIGINT AS n_tokens, round(-sum(p.c * {_LOGP}) / sum(p.c), 6) AS loss FROM p LEFT JOIN counts m ON m.prev = p.prev AND m.next = p.next LEFT JOIN totals o ON o.prev = p.prev GROUP BY phase"""
ORACLES["exam_scores"] = f"""SELECT w.phase, w.loss AS perplexity, w.n_tokens, c.accuracy AS cloze, c.n AS n_cloze, c.chance AS cloze_chance, round(k.n_pmi / k.n, 6) AS continuation, round(k.n_summed / k.n, 6) AS continuation_summed,
    k.n AS n_continuation, 0.25 AS continuation_chance FROM ({ORACLES["windowed_perplexity"]}) w JOIN ({ORACLES["cloze_accuracy"]}) c ON c.phase = w.phase JOIN ({ORACLES["continuation_pmi_drawn"]}) k ON k.phase = w.phase"""
for _name in ("near_duplicate_pairs", "story_hash_duplicates"):
    ORACLES[f"{_name}_decomposed"] = ORACLES["near_duplicate_pairs_uncapped" if "pairs" in _name else _name]

_CELLS = """cells AS (SELECT (user_id % 21)::INTEGER AS run, ((event_id % 8) - 1)::INTEGER AS i, ((event_id // 8) % 7)::INTEGER AS j, sum(floor(value * 100)::BIGINT) / count(value) / 100 AS value FROM events GROUP BY ALL),
m AS (SELECT run, CASE WHEN run % 2 = 0 THEN 'continuation' ELSE 'perplexity' END AS exam, i, j, value FROM cells), s AS (SELECT *, CASE WHEN exam = 'perplexity' THEN -value ELSE value END AS score FROM m)"""
_ACCURACY = "acc AS (SELECT run, exam, avg(score) AS value FROM s WHERE i = (SELECT max(t.i) FROM s t WHERE t.run = s.run AND t.exam = s.exam) GROUP BY run, exam)"
_FORGET = "f AS (SELECT run, exam, j, max(score) AS peak, arg_max(score, i) AS final, max(score) - arg_max(score, i) AS forgetting FROM s WHERE i >= 0 GROUP BY run, exam, j)"
ORACLES["matrix_incomplete"] = f"WITH {_CELLS} SELECT run, exam, i, (7 - count(value))::BIGINT AS n_bad FROM m WHERE i >= 0 AND (run < 14 OR j <> 3) GROUP BY run, exam, i HAVING count(value) < 7"
ORACLES["average_accuracy"] = f"WITH {_CELLS}, {_ACCURACY} SELECT run, exam, round(value, 9) AS value FROM acc"
ORACLES["forgetting"] = f"WITH {_CELLS}, {_FORGET} SELECT run, exam, j, round(forgetting, 9) AS forgetting FROM f"
ORACLES["average_forgetting"] = f"WITH {_CELLS}, {_FORGET} SELECT run, exam, round(avg(forgetting), 9) AS value FROM f WHERE j < (SELECT max(g.j) FROM f g WHERE g.run = f.run AND g.exam = f.exam) GROUP BY run, exam"
ORACLES["forward_transfer"] = f"""WITH {_CELLS}, d AS (SELECT DISTINCT run, exam, j FROM s WHERE i >= 0), b AS (SELECT *, lag(j) OVER (PARTITION BY run, exam ORDER BY j) AS before FROM d)
SELECT b.run, b.exam, b.j, round(p.score - u.score, 9) AS transfer FROM b LEFT JOIN s p ON p.run = b.run AND p.exam = b.exam AND p.i = b.before AND p.j = b.j LEFT JOIN s u ON u.run = b.run AND u.exam = b.exam AND u.i = -1 AND u.j = b.j"""
ORACLES["peak_lost"] = f"WITH {_CELLS}, {_FORGET} SELECT run, exam, j, round(forgetting / peak, 9) AS lost FROM f WHERE exam IN ('continuation', 'cloze') AND peak > 0"
_ARMS = f"{_CELLS}, {_ACCURACY}, a AS (SELECT ['phase0', 'A', 'B', 'C', 'D', 'D-nr', 'E'][run % 7 + 1] AS arm, 'accuracy' AS metric, run // 7 AS seed, value FROM acc WHERE exam = 'continuation'), g AS (SELECT arm, metric, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS sd, count(*)::BIGINT AS n, string_agg(seed::VARCHAR, ',' ORDER BY seed) AS seeds FROM a GROUP BY ALL)"
ORACLES["seed_aggregate"] = f"WITH {_ARMS} SELECT arm, metric, round(mean, 9) AS mean, round(sd, 6) AS sd, n, seeds FROM g"
ORACLES["arm_compare"] = f"""WITH {_ARMS}, p(arm, other) AS (VALUES ('A', 'B'), ('D', 'C'), ('D', 'E'), ('D-nr', 'D'))
SELECT x.arm, y.arm AS other, x.metric, round(x.mean - y.mean, 9) AS diff, round(greatest(x.sd, y.sd), 6) AS spread, abs(x.mean - y.mean) > greatest(x.sd, y.sd) AS decided FROM p JOIN g x ON x.arm = p.arm JOIN g y ON y.arm = p.other"""

ORACLES["hypothesis_verdicts"] = f"""WITH s AS (SELECT (user_id % 21)::INTEGER AS run, CASE WHEN event_id % 2 = 0 THEN 'continuation' ELSE 'cloze' END AS exam, ((event_id // 2) % 8)::INTEGER - 1 AS i, ((event_id // 16) % 7)::INTEGER AS j, sum(floor(value * 100)::BIGINT) / count(value) / 100 AS score FROM events GROUP BY ALL),
{_ACCURACY}, {_FORGET}, hh AS (SELECT (user_id % 21)::INTEGER AS run, sum(floor(value * 100)::BIGINT) / 100 AS hours FROM events GROUP BY 1),
af AS (SELECT run, exam, avg(forgetting) AS forg FROM f WHERE j < (SELECT max(g.j) FROM f g WHERE g.run = f.run AND g.exam = f.exam) GROUP BY run, exam),
r AS (SELECT a.exam AS grid, ['phase0', 'A', 'B', 'C', 'D', 'D-nr', 'E'][a.run % 7 + 1] AS arm, a.run // 7 AS seed, a.value AS acc, af.forg, p.forgetting / p.peak AS lost, hh.hours FROM acc a LEFT JOIN af ON af.run = a.run AND af.exam = a.exam LEFT JOIN f p ON p.run = a.run AND p.exam = a.exam AND p.j = 0 AND p.peak > 0 JOIN hh ON hh.run = a.run),
g AS (SELECT grid, arm, avg(acc::DOUBLE) AS acc, stddev_samp(acc::DOUBLE) AS acc_sd, avg(forg::DOUBLE) AS forg, stddev_samp(forg::DOUBLE) AS forg_sd, avg(lost::DOUBLE) AS lost, avg(hours::DOUBLE) AS hours FROM r GROUP BY ALL),
h AS (SELECT d.grid, avg(d.hours::DOUBLE / b.hours) AS ratio FROM r d JOIN r b ON b.grid = d.grid AND b.seed = d.seed AND b.arm = 'B' WHERE d.arm = 'D' GROUP BY d.grid),
v AS (
  SELECT grid, 'H1' AS hypothesis, CASE WHEN lost >= 0.15 THEN 'confirmed' WHEN lost < 0.05 THEN 'killed' ELSE 'neither' END AS verdict FROM g WHERE arm = 'A'
  UNION ALL SELECT d.grid, 'H2a', CASE WHEN d.forg > b.forg AND abs(d.forg - b.forg) > greatest(d.forg_sd, b.forg_sd) THEN 'killed' WHEN (e.acc - d.acc) * 100 <= 3 THEN 'confirmed' ELSE 'neither' END FROM g d JOIN g b ON b.grid = d.grid AND b.arm = 'B' JOIN g e ON e.grid = d.grid AND e.arm = 'E' WHERE d.arm = 'D'
  UNION ALL SELECT grid, 'H2b', CASE WHEN ratio <= 1.5 THEN 'low' WHEN ratio <= 2 THEN 'middle' ELSE 'high' END FROM h
  UNION ALL SELECT d.grid, 'H3', CASE WHEN NOT abs(d.acc - c.acc) > greatest(d.acc_sd, c.acc_sd) THEN 'killed' WHEN (d.acc - c.acc) * 100 >= 5 THEN 'confirmed' ELSE 'neither' END FROM g d JOIN g c ON c.grid = d.grid AND c.arm = 'C' WHERE d.arm = 'D'
  UNION ALL SELECT d.grid, 'H4', CASE WHEN NOT abs(n.forg - d.forg) > greatest(n.forg_sd, d.forg_sd) THEN 'killed' WHEN n.forg > d.forg THEN 'confirmed' ELSE 'neither' END FROM g d JOIN g n ON n.grid = d.grid AND n.arm = 'D-nr' WHERE d.arm = 'D')
SELECT grid AS exam, hypothesis, verdict FROM v UNION ALL SELECT 'both', a.hypothesis, CASE WHEN a.verdict = b.verdict THEN a.verdict ELSE 'split' END FROM v a JOIN v b ON b.hypothesis = a.hypothesis AND a.grid = 'continuation' AND b.grid = 'cloze'"""

_LEDGER = "led AS (SELECT ['phase0', 'A', 'B', 'C', 'D', 'D-nr', 'E'][user_id % 7 + 1] AS arm, (user_id % 3)::INTEGER AS seed, event_type AS status, value AS gpu_hours, 'gpu' || (user_id % 2) AS gpu_name FROM events)"
ORACLES["gpu_ratio"] = f"WITH {_LEDGER}, h AS (SELECT arm, seed, sum(floor(gpu_hours * 100)::BIGINT) / 100 AS h FROM led GROUP BY ALL) SELECT a.seed, round(a.h / b.h, 9) AS ratio FROM h a JOIN h b ON b.seed = a.seed WHERE a.arm = 'D' AND b.arm = 'B' AND b.h <> 0"
ORACLES["majority_filter"] = """WITH c AS (SELECT source AS arm, lang AS value, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY ALL)
SELECT arm, value, n::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY n DESC, first) AS k FROM c) WHERE k = 1"""
_RULES = """e AS (SELECT event_id % 29 = 6 AS files, event_id % 13 = 2 OR event_id % 43 = 3 AS no_cuda, event_id % 11 = 1 AS dirt, event_id % 17 = 3 AS rid, event_id % 19 = 4 OR event_id % 23 = 5 AS ph, event_id % 31 = 7 AS gn, event_id % 37 = 8 OR value IS NULL OR isnan(value) OR value < 0 AS gh, event_id % 41 = 9 AS hs FROM events)"""
ORACLES["run_exclusions"] = f"""WITH {_RULES}, r AS (SELECT CASE WHEN files THEN 'files' WHEN no_cuda THEN 'commit' WHEN dirt THEN 'dirty' WHEN rid THEN 'run_id' WHEN ph THEN 'phases' WHEN gn THEN 'gpu_name' WHEN gh THEN 'gpu_hours' WHEN hs THEN 'hashes' END AS reason FROM e)
SELECT reason, count(*)::BIGINT AS n FROM r WHERE reason IS NOT NULL GROUP BY reason"""
ORACLES["run_failures"] = f"""WITH {_RULES}, r AS (SELECT unnest(list_filter([CASE WHEN files THEN 'files' END, CASE WHEN files OR no_cuda THEN 'commit' END, CASE WHEN files OR dirt THEN 'dirty' END, CASE WHEN rid THEN 'run_id' END, CASE WHEN ph THEN 'phases' END, CASE WHEN gn THEN 'gpu_name' END, CASE WHEN gh THEN 'gpu_hours' END, CASE WHEN hs THEN 'hashes' END], lambda x: x IS NOT NULL)) AS rule FROM e)
SELECT rule, count(*)::BIGINT AS n FROM r GROUP BY rule"""
ORACLES["ledger_summary"] = f"""WITH {_LEDGER}, c AS (SELECT arm, status || ':' || count(*) AS x FROM led GROUP BY arm, status)
SELECT arm, count(*)::BIGINT AS attempts, round(sum(coalesce(gpu_hours, 0)), 6) AS gpu_hours, array_to_string(list_sort(list(DISTINCT gpu_name)), ',') AS gpu_names, (SELECT string_agg(x, ',' ORDER BY x) FROM c WHERE c.arm = led.arm) AS statuses FROM led GROUP BY arm"""
ORACLES["event_windows"] = "SELECT epoch(time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01'))::BIGINT AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL"
