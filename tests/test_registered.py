"""Every registered query against its SQL, and what its plan must not contain."""

import re

import pytest

from compare import compare, duck
from turnsift.plans.catalog import registered

SMALL = "/root/testdata/sf0.001"
ENTRIES = registered()
BANNED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", [n for n, (_, sql) in ENTRIES.items() if sql])
def test_same_rows_as_sql(spark, con, name):
    """Equal rows, and no pairwise join or row-at-a-time UDF in the plan of a batch query."""
    run, sql = ENTRIES[name]
    frames = []

    def noted(session, sf_dir):
        frames.append(run(session, sf_dir))
        return frames[0]

    ok, note = compare(spark, con, noted, sql, SMALL)
    assert ok, note
    if not name.startswith("stream_"):
        plan = frames[0]._jdf.queryExecution().executedPlan().toString()
        assert not [word for word in BANNED if word in plan]


@pytest.mark.parametrize("name", [n for n, (_, sql) in ENTRIES.items() if not sql])
def test_runs(spark, name):
    assert ENTRIES[name][0](spark, SMALL).count() > 0


def test_scan_reads_only_needed_columns(spark):
    plan = ENTRIES["mixed_script"][0](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_document_scan_moves_nothing(spark):
    plan = ENTRIES["doc_scan"][0](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_windows_move_texts_once(spark):
    """One hash exchange carries texts; a second branch may read the same one again."""
    plan = ENTRIES["window_signals"][0](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    texts = set(re.findall(r"Exchange hashpartitioning\(_key#\d+, _chunk#\d+L?, \d+\)", plan))
    assert len(texts) >= 1 and "RoundRobin" not in plan
    assert plan.count("rangepartitioning") == 0


def test_entry_module():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 70


def test_all_sessions_are_read_back(spark):
    """Not only a list of ids: every session that has signals or events."""
    from turnsift.plans import detection, overlay

    sources = {"stored_signals_whole": detection.signals, "session_log_whole": overlay.conversations}
    for name, source in sources.items():
        got, want = ({r.session_id for r in f(spark, SMALL).select("session_id").distinct().collect()} for f in (ENTRIES[name][0], source))
        assert got == want and len(got) > 1
