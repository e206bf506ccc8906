"""Plans that must hold at any size: pruned scans, no products, no rows through Python where columns suffice."""

import os
import re

import pytest

from spanview import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")

#: One row of totals beside one row an arm.
SMALL_PRODUCTS = {"ledger_arm_deltas"}
STREAMS = {"stream_tracked", "stream_delivery", "stream_activity"}
#: Parsers and JSON of any depth, framed decoding, generated edits, ordered folds (hashes and choices of reads too) and whole relocation decisions.
PYTHON = {
    "select_greedy_budget", "selection_summary", "render_order", "projection_text", "decode_frames", "canonical_payloads", "refresh_counters", "collapse_history", "shell_parse", "shell_stale_dumps", "shell_observed_span",
    "shell_discovery", "fail_open_envelope", "relocate_regions", "relocation_failures", "symbol_table", "symbol_resolve", "trace_replay", "budget_pressure", "document_replay",
    "redaction", "symbol_pack", "trace_events", "sampled_traces", "trace_pack", "binding_hash", "overlapping_reads", "set_hash",
}


@pytest.fixture(scope="module")
def plans(spark):
    out = {}
    for name, query in registry.queries().items():
        if name not in STREAMS:
            out[name] = query(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    return out


def test_no_products(plans):
    assert {n for n, p in plans.items() if re.search("CartesianProduct|BroadcastNestedLoopJoin", p)} <= SMALL_PRODUCTS


def test_python_only_where_columns_do_not_suffice(plans):
    assert {n for n, p in plans.items() if re.search("Python|Pandas|Arrow", p)} <= PYTHON


def test_scans_read_the_columns_they_need(plans):
    assert "html" not in plans["unit_identity"] and "lang" not in re.search(r"ReadSchema: \S+", plans["unit_identity"])[0]
    assert re.search(r"ReadSchema: struct<event_id:bigint>", plans["recorded_verdict"])
    assert re.search(r"ReadSchema: struct<\S*l_returnflag", plans["latency_percentiles"]) and "l_shipdate" not in plans["latency_percentiles"]
    assert re.search(r"PushedFilters: \[[^\]]", plans["served_calls"] + plans["corpus_lock"] + plans["hash_sample"])
