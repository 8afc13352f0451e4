"""What the physical plans must and must not hold."""

import re

import pytest

from palimpsest.plans import queries as q

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_no_cross_joins(spark, name):
    text = plan(q.QUERIES[name](spark, SF))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", text)


def test_search_is_one_bounded_step_and_pushed_down(spark):
    text = plan(q.topk_cosine_project(spark, SF))
    assert "TakeOrderedAndProject" in text and "Window" not in text
    assert "label" in re.search(r"PushedFilters: \[([^\]]*)\]", plan(q.t(spark, SF, "embeddings").where("label = 3")))[1]


def test_columns_are_pruned(spark):
    text = plan(q.type_histogram(spark, SF))
    assert re.findall(r"ReadSchema: (\S+)", text) == ["struct<event_type:string>"]


def test_no_python_in_text_queries(spark):
    for name in ("redact_secrets", "chunk_windows", "extract_keywords", "session_rollup", "session_continuation", "hot_chunks", "graph_nodes", "memory_tiers"):
        assert not re.search(r"Python|Pandas|Arrow", plan(q.QUERIES[name](spark, SF))), name


def test_counts_before_shuffles(spark):
    text = plan(q.hot_chunks(spark, SF))
    assert text.count("HashAggregate") >= 4
