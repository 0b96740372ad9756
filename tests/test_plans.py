"""Shapes of physical plans that have to hold at any scale."""

import pytest

import __spark_entry__ as contract
from riskloom.operators.attribution import topk_rows
from riskloom.operators.timeseries import rate_limit
from riskloom.registry import bindings as b

# What these return is read from what their jobs wrote, or is a single number.
EAGER = {
    "train_gbt", "auc_pr", "auc_roc", "stage_events_stream", "pipeline_events_stream", "metrics_stream", "counters_stream",
    "requests_stream", "duplicate_ids_stream", "append_call_log",
}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - EAGER))
def test_no_cross_join_and_no_unpartitioned_window(spark, folder, name):
    text = plan(contract.queries()[name](spark, folder))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    lines = text.split("\n")
    for at, line in enumerate(lines):
        if "Window [" in line:
            assert "SinglePartition" not in "\n".join(lines[at:at + 4])


def test_ranked_filters_act_before_the_shuffle(spark, folder):
    for df in (topk_rows(b.f_attr(spark, folder)), rate_limit(b.f_req(spark, folder))):
        text = plan(df)
        assert "WindowGroupLimit" in text and "Partial" in text


def test_columns_and_filters_reach_the_scan(spark, tmp_path):
    from riskloom.operators.costs import call_records, cost_by_phase, in_phase
    from riskloom.sources.transactions import lookup_transaction

    spark.range(10).selectExpr("id AS TransactionID", "id * 2 AS a", "id AS b").write.parquet(str(tmp_path / "t"))
    text = plan(lookup_transaction(spark.read.parquet(str(tmp_path / "t")), "3").select("TransactionID", "a"))
    assert "EqualTo(TransactionID,3)" in text and "ReadSchema: struct<TransactionID:bigint,a:bigint>" in text
    calls = spark.createDataFrame(
        [("t", "x", "p", "A", "m", 1, 1, 1.0)],
        "timestamp string, transaction_id string, phase string, agent_name string, model string, input_tokens bigint, "
        "output_tokens bigint, duration_seconds double")
    call_records(calls).write.parquet(str(tmp_path / "r"))
    text = plan(cost_by_phase(in_phase(spark.read.parquet(str(tmp_path / "r")), "p")))
    assert "EqualTo(phase,p)" in text and "ReadSchema: struct<phase:string,cost_usd:double>" in text


def test_calls_of_run_explain_once(spark, folder, monkeypatch):
    """Explanations are worked out in one pass, not once per kind of call."""
    from riskloom.plans import run_pipeline as R
    from riskloom.registry import all_queries
    from riskloom.session import settle

    kept = []
    monkeypatch.setattr(R, "settle", lambda df: kept.append(df) or settle(df))
    out = all_queries()["calls_of_run"](spark, folder)
    assert len(kept) == 1 and "get_json_object" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_result_json_reads_its_text_once(spark, folder):
    """All fields come from one pass over the text, not from one pass each."""
    text = contract.queries()["result_json"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "json_tuple" in text and "get_json_object(to_json" not in text and "get_json_object(result" not in text
