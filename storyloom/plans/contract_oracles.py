"""DuckDB SQL for the queries of contracts and run records, written on its own."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

_D = "d AS (SELECT doc_id AS d, (doc_id % 7)::INTEGER AS p, doc_id % 4 AS a, doc_id % 41 AS r, doc_id % 37 AS q FROM documents WHERE doc_id IS NOT NULL)"
_ONE = "SELECT '{}' AS rule, d FROM d WHERE {}"


def _rules(table: dict[str, str], extra: str = "") -> str:
    each = " UNION ALL ".join(_ONE.format(k.replace("'", "''"), v) for k, v in table.items())
    return f"WITH {_D}, v AS ({each}{extra}) SELECT rule, count(*)::BIGINT AS n FROM v GROUP BY rule"


_BOTH = {
    "answer index": "r = 3 OR (r = 2 AND a = 3)",
    "sources": "r = 2 OR r = 4",
    "source fields": "r = 5",
    "source unknown": "r = 6",
    "source phase": "r = 7 OR r = 8",
    "answer of another phase": "r = 8",
    "distractor of another phase": "r = 7",
    "distractor of the answer's story": "r = 10",
}
_TWICE = " UNION ALL SELECT 'duplicate id', min(d) FROM d WHERE {} HAVING count(*) > 1"
ORACLES["continuation_contract"] = _rules(
    _BOTH | {"phase": "r = 1", "option count": "r = 2", "source in training": "r = 9", "two of one story": "r = 11", "no distractor phases": "r = 12", "distractor phases": "r = 13 OR r = 7", "same option twice": "r = 14"}, _TWICE.format("r = 15")
)
ORACLES["continuation_load_contract"] = _rules(_BOTH, _TWICE.format("r = 15") + " UNION ALL SELECT 'option counts differ', min(d) FROM d GROUP BY p HAVING count(*) FILTER (WHERE r = 2) BETWEEN 1 AND count(*) - 1")
ORACLES["cloze_contract"] = _rules(
    {"phase": "q = 1", "one mask": "q = 2 OR q = 3", "candidate count": "q = 4", "answer missing": "q = 5", "same word twice": "q = 6", "inflection": "q = 7", "answer visible": "q = 8", "source of another phase": "q = 9 OR q = 10", "source in training": "q = 11"}, _TWICE.format("q = 12")
)
ORACLES["phase_rows"] = """WITH x AS (SELECT (doc_id % 7)::INTEGER AS phase, doc_id::VARCHAR AS id, doc_id AS d, text FROM documents)
SELECT phase, id, 'phase' AS rule FROM x WHERE d % 9 = 2 UNION ALL SELECT phase, id, 'holds the mask' FROM x WHERE (d % 8 = 1 AND text IS NOT NULL) OR contains(text, '[MASK]')"""

_E = """e AS (SELECT event_id AS e, event_id % 29 = 6 AS no_commit, event_id % 31 = 7 AS no_matrix, event_id % 37 = 8 AS broken, event_id % 11 = 1 AS dirt, event_id % 83 = 19 AS maybe, event_id % 79 = 18 AS no_dirt, event_id % 13 = 2 OR event_id % 97 = 21 AS no_cuda, event_id % 101 = 22 AS no_driver,
    event_id % 17 = 3 AS other_commit, event_id % 19 = 4 OR event_id % 23 = 5 AS bad_phases, event_id % 67 = 15 AS subset, event_id % 41 = 9 AS no_cloze, event_id % 43 = 10 AS untrained, event_id % 47 = 11 AS nan, event_id % 53 = 12 AS no_name, event_id % 59 = 13 AS no_hours,
    event_id % 61 = 14 AS no_hashes, event_id % 71 = 16 AS pilot, event_id % 73 = 17 AS phase0, event_id % 89 = 20 AS seed FROM events)"""
ORACLES["run_loads"] = f"""WITH {_E}, r AS (SELECT CASE WHEN no_commit THEN 'missing commit.txt' WHEN no_matrix THEN 'missing matrix.json' WHEN broken THEN 'unreadable' WHEN no_dirt OR no_cuda OR no_driver OR (maybe AND NOT dirt) THEN 'commit' WHEN dirt THEN 'dirty' WHEN bad_phases THEN 'phases'
    WHEN untrained AND NOT subset THEN 'untrained perplexity' WHEN no_cloze THEN 'matrix cloze' WHEN nan AND NOT subset THEN 'matrix continuation' WHEN no_name THEN 'gpu_name' WHEN no_hours THEN 'gpu_hours' WHEN no_hashes THEN 'hashes' WHEN pilot THEN 'pilot' ELSE 'usable' END AS reason FROM e)
SELECT reason, count(*)::BIGINT AS n FROM r GROUP BY reason"""
_SUBSET = "(subset AND NOT bad_phases AND NOT broken)"
_FAILURES = {
    "missing commit.txt": "no_commit",
    "missing matrix.json": "no_matrix",
    "unreadable config": "broken",
    "phases": "bad_phases AND NOT broken",
    "untrained perplexity": f"untrained AND NOT no_matrix AND NOT {_SUBSET}",
    "matrix cloze": "no_cloze AND NOT no_matrix",
    "matrix continuation": f"nan AND NOT no_matrix AND NOT {_SUBSET} AND NOT (phase0 AND NOT broken)",
    "no dirty": "no_dirt AND NOT no_commit",
    "dirty value": "maybe AND NOT dirt AND NOT no_dirt AND NOT no_commit",
    "dirty": "dirt AND NOT no_dirt AND NOT no_commit",
    "gpu_name": "no_name",
    "gpu_hours": "no_hours",
    "seed": "seed AND NOT broken",
    "commit7": "other_commit AND NOT broken",
}
_FAILED = " UNION ALL ".join(f"SELECT '{k}' AS failure, e FROM e WHERE {v}" for k, v in _FAILURES.items())
ORACLES["run_validation"] = f"WITH {_E}, f AS ({_FAILED}) SELECT failure, count(*)::BIGINT AS n FROM f GROUP BY failure"
ORACLES["runs_existing_valid"] = f"""WITH {_E}, f AS ({_FAILED}), g AS (SELECT CASE WHEN phase0 THEN 'phase0' ELSE 'A' END AS arm, e FROM e WHERE e NOT IN (SELECT e FROM f))
SELECT arm, (e % 3)::VARCHAR AS seed, 'abcdef0' AS commit7, min(arm || '_s' || (e % 3) || '_abcdef0_' || lpad(e::VARCHAR, 8, '0') || 'T000000Z') AS run_id FROM g GROUP BY ALL"""
ORACLES["runs_consistent"] = """WITH r AS (SELECT event_id AS e, (user_id % 7)::VARCHAR AS arm, event_id % 5 = 0 AS few, event_id % 3 = 0 AS y FROM events),
p AS (SELECT few FROM r GROUP BY few ORDER BY count(*) DESC, min(e) LIMIT 1), s AS (SELECT r.* FROM r JOIN p USING (few)),
h AS (SELECT arm, y FROM (SELECT arm, y, row_number() OVER (PARTITION BY arm ORDER BY count(*) DESC, min(e)) AS k FROM s GROUP BY arm, y) WHERE k = 1)
SELECT arm, count(*)::BIGINT AS n, lpad(min(e)::VARCHAR, 12, '0') AS first FROM s JOIN h USING (arm, y) GROUP BY arm"""

_CELLS = """cells AS (SELECT (user_id % 21)::INTEGER AS run, ((event_id % 8) - 1)::INTEGER AS i, ((event_id // 8) % 7)::INTEGER AS j, sum(floor(value * 100)::BIGINT) / count(value) / 100 AS value FROM events GROUP BY ALL),
m AS (SELECT run, CASE WHEN run % 2 = 0 THEN 'continuation' ELSE 'perplexity' END AS exam, i, j, value, ['phase0', 'A', 'B', 'C', 'D', 'D-nr', 'E'][run % 7 + 1] AS arm, run // 7 AS seed FROM cells)"""
ORACLES["mean_matrix"] = f"WITH {_CELLS} SELECT arm, exam, i, j, round(avg(value), 9) AS mean FROM m WHERE i >= 0 GROUP BY ALL"
ORACLES["forgetting_curve"] = f"WITH {_CELLS} SELECT arm, exam, i, round(avg(value), 9) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd, count(value)::BIGINT AS n FROM m WHERE i >= 0 AND j = 0 GROUP BY ALL"
_SOME = "s AS (SELECT * FROM m WHERE run < 14 OR j <> 3 OR i = 2)"
ORACLES["dense_matrix"] = f"""WITH {_CELLS}, {_SOME}, g AS (SELECT * FROM (SELECT DISTINCT run, exam FROM s), range(-1, 7) a(i), range(7) b(j))
SELECT g.run, g.exam, g.i::INTEGER AS i, g.j::INTEGER AS j, round(s.value, 9) AS value FROM g LEFT JOIN s ON s.run = g.run AND s.i = g.i AND s.j = g.j"""
ORACLES["score_row_shapes"] = f"WITH {_CELLS}, {_SOME} SELECT run, exam, i, count(DISTINCT j)::BIGINT AS n FROM s GROUP BY run, exam, i HAVING count(DISTINCT j) <> 7"
ORACLES["inherited_rows"] = f"""WITH {_CELLS}, g AS (SELECT h.run, z.exam, z.i, z.j, z.value FROM (SELECT DISTINCT run, seed FROM m WHERE arm NOT IN ('phase0', 'E')) h JOIN m z ON z.arm = 'phase0' AND z.seed = h.seed AND z.i <= 0)
SELECT run, exam, i, j, round(value, 9) AS value FROM g UNION ALL SELECT m.run, m.exam, m.i, m.j, round(m.value, 9) FROM m ANTI JOIN g ON g.run = m.run AND g.exam = m.exam AND g.i = m.i AND g.j = m.j"""
ORACLES["arm_gpu_hours"] = """WITH h AS (SELECT ['phase0', 'A', 'B', 'C', 'D', 'D-nr', 'E'][user_id % 7 + 1] AS arm, user_id % 3 AS seed, sum(floor(value * 100)::BIGINT) / 100 AS h FROM events GROUP BY ALL)
SELECT arm, CASE WHEN arm <> 'D' THEN round(avg(h), 6) END AS mean, CASE WHEN arm <> 'D' THEN round(coalesce(stddev_samp(h), 0), 4) END AS sd, count(*)::BIGINT AS n, CASE WHEN arm = 'D' THEN 'gpu0,gpu1' END AS problem FROM h GROUP BY arm"""
ORACLES["timing_hours"] = "SELECT user_id AS run, round(sum(floor(value * 100)::BIGINT) / 3600, 6) AS gpu_hours FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY user_id"
ORACLES["exit_summary"] = "SELECT (count(*) FILTER (WHERE event_id % 5 > 1))::BIGINT AS n_run, (count(*) FILTER (WHERE event_id % 5 = 1))::BIGINT AS n_skip, (count(*) FILTER (WHERE event_id % 5 = 0))::BIGINT AS n_failed FROM events"
ORACLES["fingerprint_differences"] = "SELECT doc_id, 'lang' AS field, lang AS mine, 'en' AS theirs FROM documents WHERE doc_id IS NOT NULL AND lang IS DISTINCT FROM 'en'"

_T = "t AS (SELECT (doc_id % 7)::INTEGER AS phase, doc_id AS seq_id FROM documents WHERE doc_id IS NOT NULL)"
_DRAW = "sha256(concat_ws('|', '7', '{}', {}))"
ORACLES["replay_pool"] = f"WITH {_T}, s AS (SELECT * FROM t WHERE phase IN (0, 1, 3, 6)) SELECT p.phase, s.phase AS src_phase, s.seq_id FROM s JOIN (SELECT DISTINCT phase FROM s) p ON s.phase < p.phase"
ORACLES["joint_batches"] = f"""WITH {_T}, k AS (SELECT phase, seq_id, unnest([0, 1]) AS epoch FROM t), n AS (SELECT count(*) AS n FROM t),
r AS (SELECT k.*, n.n, row_number() OVER (PARTITION BY epoch ORDER BY {_DRAW.format("epoch", "-1, epoch, phase || ':' || seq_id")}) - 1 AS x FROM k, n)
SELECT ((epoch * n + x) // 32)::BIGINT AS step, ((epoch * n + x) % 32)::BIGINT AS slot, epoch::INTEGER AS epoch, phase, seq_id FROM r"""
_ZIP = f"""{_T}, n AS (SELECT phase, count(*) AS n FROM t GROUP BY phase), r AS (SELECT phase, seq_id, row_number() OVER (PARTITION BY phase ORDER BY {_DRAW.format("epoch", "phase, 0, seq_id")}) - 1 AS x FROM t),
fresh AS (SELECT phase, (x // 32)::BIGINT AS step, (x % 32)::BIGINT AS slot, false AS is_replay, seq_id AS item FROM r),
pools AS (SELECT b.phase, sum(a.n) AS pool FROM n a JOIN n b ON a.phase < b.phase GROUP BY b.phase),
again AS (SELECT phase, s.step::BIGINT AS step, (l.slot + 32)::BIGINT AS slot, true AS is_replay, (('0x' || substr({_DRAW.format("replay-draw", "phase, s.step, l.slot")}, 1, 15))::BIGINT % pool)::BIGINT AS item FROM pools, range(20) s(step), range(14) l(slot)),
z AS (FROM fresh UNION ALL SELECT * FROM again WHERE (phase, step) IN (SELECT (phase, step) FROM fresh))"""
ORACLES["zipped_batches"] = f"WITH {_ZIP} FROM z"
ORACLES["batch_shapes"] = f"WITH {_ZIP} SELECT phase, step, count(*)::BIGINT AS n FROM z GROUP BY phase, step HAVING count(*) <> 46 OR count(DISTINCT slot) <> 46"
ORACLES["parameter_counts"] = "SELECT p_partkey, 12 * p_size::BIGINT * (p_size * 64)::BIGINT * (p_size * 64)::BIGINT + (2 * p_size::BIGINT + 1) * 2 * (p_size * 64) AS body, 9216 * p_size::BIGINT * 64 AS embeddings FROM part"
ORACLES["vocabulary_fits"] = "SELECT p_partkey AS name, 800 AS vocabulary, (p_size * 32)::INTEGER AS model_vocabulary FROM part WHERE p_size * 32 < 800"

_SQUEEZED = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_FILES = f"""x AS (SELECT doc_id AS id, text AS story, sha256({_SQUEEZED.format("text")}) AS sha, source FROM documents WHERE doc_id IS NOT NULL),
exam AS (SELECT sha, max(id)::VARCHAR AS story_id FROM x WHERE source IN ('src1', 'src2') GROUP BY sha), prompts AS (SELECT sha256(id::VARCHAR) AS value, id::VARCHAR AS story_id FROM x WHERE source IN ('src1', 'src2')),
train AS (SELECT * FROM x WHERE source NOT IN ('src1', 'src2'))"""
ORACLES["file_text_hits"] = rf"""WITH {_FILES}, hit AS (SELECT t.id, t.id % 3 AS k, e.story_id FROM train t JOIN exam e ON e.sha = t.sha),
lines AS (SELECT id, nr, trim(l, chr(32) || chr(9) || chr(11) || chr(12)) AS l FROM (SELECT id, unnest(regexp_split_to_array(story, '\r\n|\r|\n')) AS l, generate_subscripts(regexp_split_to_array(story, '\r\n|\r|\n'), 1) AS nr FROM train WHERE id % 3 = 0))
SELECT 'f' || id || '.txt' AS path, 0 AS line, 'story_sha256' AS reason, story_id FROM hit WHERE k = 0
UNION ALL SELECT 'f' || id || '.txt', nr::INTEGER, CASE WHEN p.value IS NOT NULL THEN 'prompt_hash' ELSE 'story_sha256' END, coalesce(p.story_id, e.story_id) FROM lines l LEFT JOIN prompts p ON p.value = l.l LEFT JOIN exam e ON e.sha = sha256({_SQUEEZED.format("l.l")}) WHERE l.l <> '' AND (p.value IS NOT NULL OR e.sha IS NOT NULL)
UNION ALL SELECT 'f' || id || '.json', unnest([0, 1]), 'story_sha256', story_id FROM hit WHERE k = 1
UNION ALL SELECT 'f' || id || '.jsonl', 1, 'story_sha256', story_id FROM hit WHERE k = 2
UNION ALL SELECT 'f' || id || '.jsonl', 3, 'unparsable', NULL FROM train WHERE id % 3 = 2 AND id % 10 = 1"""
ORACLES["file_copies"] = "SELECT t.doc_id::VARCHAR AS path, 'exam/' || e.id AS exam_path FROM documents t JOIN (SELECT text, min(doc_id) AS id FROM documents WHERE source IN ('src1', 'src2') GROUP BY text) e ON e.text = t.text WHERE t.source NOT IN ('src1', 'src2')"
ORACLES["manifest_refusals"] = """WITH r AS (SELECT ['', 'unreadable', 'no object', 'no files', 'file hash', 'experiment_id', 'generator_model', 'no stories', 'story is no object', 'story fields', 'story_sha256', 'prompt_hash', 'story phase'][doc_id % 17 + 1] AS rule FROM documents WHERE doc_id IS NOT NULL)
SELECT rule, count(*)::BIGINT AS n FROM r WHERE rule <> '' GROUP BY rule"""
