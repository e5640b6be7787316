"""Run records by the five keys that they must have, their lines and their names; runs of a kind."""

import json

import pytest

from storyloom.operators import runs

FIVE = {"commit": "abcdef0123", "dirty": "false", "torch": "2", "cuda": "12", "driver": "550"}
ROW = [1.0] * runs.PHASES
MATRIX = json.dumps({"untrained": {e: ROW for e in runs.EXAMS}, "M": {e: [ROW] * runs.PHASES for e in runs.EXAMS}})
CONFIG = json.dumps({"arm": "A", "seed": 0, "pilot": False, "git": {"commit": "abcdef0123"}, "hashes": {"data": "x"}, "token_budget": {"total_new_phase_tokens": 8.0, "total_replay_tokens": 3.0, "tokens_vs_arm_a": 1.25}})
TIMINGS = json.dumps({"gpu_name": "gpu", "gpu_hours": 1.5})
NAME = "A_s0_abcdef0_20250101T000000Z"
SCHEMA = "run_id string, commit_txt string, matrix string, timings string, config string"


def text(fields, end="\n"):
    return "".join(f"{k}: {v}{end}" for k, v in fields.items())


def test_commit_records(spark):
    cases = {
        "five": (text(FIVE), None),
        "crlf": (text(FIVE, "\r\n"), None),
        "cr": (text(FIVE, "\r"), None),
        "cases and space": ("\n".join(f"  {k.upper()} :\t{v} " for k, v in FIVE.items()), None),
        "last of two": (text(FIVE) + "dirty: FALSE\n", None),
        "no value": (text(FIVE | {"cuda": ""}), "commit"),
        "blank value": (text(FIVE | {"driver": " \t"}), "commit"),
        "no dirty": (text({k: v for k, v in FIVE.items() if k != "dirty"}), "commit"),
        "maybe": (text(FIVE | {"dirty": "maybe"}), "commit"),
        "dirty": (text(FIVE | {"dirty": "True"}), "dirty"),
        "empty": ("", "commit"),
    } | {f"without {k}": (text({x: v for x, v in FIVE.items() if x != k}), "commit") for k in FIVE}
    rows = [(f"{NAME}-{k}", v, MATRIX, TIMINGS, CONFIG) for k, (v, _) in cases.items()]
    got = {r["run_id"].removeprefix(f"{NAME}-"): r for r in runs.loaded(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {k: reason for k, (_, reason) in cases.items()}
    one = got["five"]
    assert (one["commit"], one["token_ratio"], one["replay_overhead_ratio"]) == ("abcdef0123", 1.25, pytest.approx(1.375))


def test_names_of_runs(spark):
    names = {NAME: True, "my-arm9_s12_ABCDEF0_20250101T000000Z": True, "A_s0_abcdef_20250101T000000Z": False, "A_b_s0_abcdef0_20250101T000000Z": False, "A_s0_abcdef0_20250101": False}
    rows = [(n, text(FIVE), MATRIX, TIMINGS, CONFIG.replace('"arm": "A", "seed": 0, ', "")) for n in names]
    bad = {r["run_id"] for r in runs.validated(spark.createDataFrame(rows, SCHEMA)).where("failure = 'run id'").collect()}
    assert bad == {n for n, right in names.items() if not right}
    told = {r["run_id"]: (r["arm"], r["seed"]) for r in runs.loaded(spark.createDataFrame([*rows, ("of no kind", *rows[0][1:])], SCHEMA)).collect()}
    assert told == {NAME: ("A", 0), "my-arm9_s12_ABCDEF0_20250101T000000Z": ("my-arm9", 12), "A_s0_abcdef_20250101T000000Z": ("A", 0), "A_b_s0_abcdef0_20250101T000000Z": ("A_b", 0), "A_s0_abcdef0_20250101": ("A", 0), "of no kind": ("?", -1)}


def test_runs_of_a_kind(spark):
    rows = [(NAME, text(FIVE), MATRIX, TIMINGS, CONFIG), ("A_s1_abcdef0_20250101T000000Z", text(FIVE), MATRIX, TIMINGS, CONFIG.replace("false", "true")), ("A_s2_abcdef0_20250101T000000Z", "", MATRIX, TIMINGS, CONFIG)]
    loaded = runs.loaded(spark.createDataFrame(rows, SCHEMA))
    assert [r["run_id"] for r in runs.of_kind(loaded, True).collect()] == [rows[1][0]] and [r["run_id"] for r in runs.of_kind(loaded, False).collect()] == [NAME]


#: Final score, forgetting and hours of each arm in a grid that confirms every hypothesis and in one that kills them.
CONFIRMING = {"A": (0.30, 0.30, 1.0), "B": (0.40, 0.30, 1.0), "C": (0.50, 0.20, 1.1), "D": (0.60, 0.10, 1.4), "D-nr": (0.45, 0.25, 1.4), "E": (0.62, 0.02, 1.0)}
KILLING = {"A": (0.48, 0.02, 1.0), "B": (0.55, 0.10, 1.0), "C": (0.55, 0.30, 1.0), "D": (0.55, 0.30, 2.1), "D-nr": (0.55, 0.30, 1.0), "E": (0.60, 0.05, 1.0)}


def folders_of(spark, headline, second, pilot=False):
    """Run folders of three seeds an arm, with one grid's scores on continuation and another's on cloze."""
    rows = []
    for arm in headline:
        for seed in range(3):
            blocks = {}
            for exam, grid in (("continuation", headline), ("cloze", second), ("perplexity", headline), ("continuation_summed", headline)):
                final, lost = grid[arm][0] + (seed - 1) * 0.005, grid[arm][1] + (seed - 1) * 0.004
                blocks[exam] = [[final + lost if i == j < 6 else final for j in range(7)] for i in range(7)]
            matrix = json.dumps({"untrained": {e: ROW for e in runs.EXAMS}, "M": blocks})
            config = json.dumps({"arm": arm, "seed": seed, "pilot": pilot, "hashes": {"data": "x"}})
            rows.append((f"{arm}_s{seed}_abcdef0_20250101T000000Z", text(FIVE), matrix, json.dumps({"gpu_name": "gpu", "gpu_hours": headline[arm][2]}), config))
    return rows


def test_verdicts_from_run_folders(spark):
    rows = folders_of(spark, CONFIRMING, KILLING)
    # neither a dirty run nor a pilot one has a say
    rows += [("D_s7_abcdef0_20250101T000000Z", text(FIVE | {"dirty": "true"}), *rows[0][2:]), folders_of(spark, KILLING, KILLING, True)[0]]
    rows[-1] = ("A_s9_abcdef0_20250101T000000Z", *rows[-1][1:])
    got = {(r["exam"], r["hypothesis"]): r["verdict"] for r in runs.folder_verdicts(spark.createDataFrame(rows, SCHEMA)).collect()}
    four = ("H1", "H2a", "H3", "H4")
    assert {h: got["continuation", h] for h in four} == dict.fromkeys(four, "confirmed")
    assert {h: got["cloze", h] for h in four} == dict.fromkeys(four, "killed")
    assert {h: got["both", h] for h in four} == dict.fromkeys(four, "split")
    assert got["continuation", "H2b"] == got["cloze", "H2b"] == got["both", "H2b"] == "low"
    none = {r["verdict"] for r in runs.folder_verdicts(spark.createDataFrame(rows[:3], SCHEMA)).where("exam = 'continuation' and hypothesis <> 'H1'").collect()}
    assert none == {"undetermined"}


def test_run_rows_are_dealt_and_their_records_read_once(spark):
    from storyloom.plans import contracts
    from storyloom.plans import queries as plans

    for rows in (plans._folders(spark, "/root/testdata/sf0.001"), contracts.folders(spark, "/root/testdata/sf0.001")):
        assert rows.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    plan = runs.exclusions(plans._folders(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
