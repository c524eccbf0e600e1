"""Plans that must hold at scale: pushed filters, pruned columns, limits before shuffles, no pairwise joins."""

import pytest
from pyspark.sql import functions as F

from wrenchbook.operators import commands, embed, events, governed, ingest, jobs, orders, retrieve, views
from wrenchbook.plans.registry import all_queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_needed_columns(tables):
    text = plan(governed.orders_of_priority(views.work_order_v(tables["order_fact"], "1998-06-15")))
    scan = next(line for line in text.splitlines() if "FileScan" in line and "orders.parquet" in line)
    assert "o_totalprice" not in scan and "o_orderpriority" in scan


def test_creation_range_reaches_the_scan(tables):
    month = governed.created_this_month(views.work_order_v(tables["order_fact"], "1998-06-15"), "1998-06-15 00:00:00")
    scan = next(line for line in plan(month).splitlines() if "FileScan" in line and "orders.parquet" in line)
    assert "GreaterThanOrEqual(o_orderdate" in scan and "LessThan(o_orderdate" in scan


def test_wanted_columns_decide_the_joins(tables):
    parts = (tables["quality_result"], tables["order_fact"], tables["model_call"], tables["quality_finding"])
    assert "lineitem.parquet" in plan(views.quality_v(*parts))
    assert "lineitem.parquet" not in plan(views.quality_v(*parts, columns=("project_name", "verdict")))


def test_newest_first_keeps_only_the_page(tables):
    page = orders.search(tables["order_fact"], tables["scope"], page=2, size=10).items
    assert "TakeOrderedAndProject" in plan(page)


@pytest.mark.parametrize("build", [lambda t: jobs.claimable(t["quality_job"], "1998-06-15"), lambda t: jobs.claimable_events(t["outbox"], "1998-06-15")])
def test_queues_are_cut_before_the_shuffle(tables, build):
    text = plan(build(tables))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_scores_are_summed_where_the_postings_are(tables):
    from wrenchbook.plans.retrieval import corpus

    terms = retrieve.query_terms(tables["benchmark_query"])
    index = retrieve.bm25_index(corpus(tables), vocabulary=terms.select("tenant_id", "term").distinct())
    lines = plan(retrieve.bm25_topk(terms, index, pad=False)).splitlines()
    at = next(n for n, line in enumerate(lines) if "HashAggregate" in line and "partial_sum" in line and "chunk_id" in line)
    assert "HashAggregate" in lines[at - 1] and "Exchange" not in lines[at - 1]


def test_python_runs_once_per_row(tables):
    assert plan(ingest.chunk(tables["section"])).count("ArrowEvalPython") == 1
    assert plan(ingest.sections(tables["markdown"])).count("ArrowEvalPython") == 1
    assert plan(embed.hash_embed(tables["documents"], 8)).count("ArrowEvalPython") == 1


def test_most_operators_stay_in_the_jvm(tables):
    for df in (
        events.replay(tables["order_event"])[0],
        commands.classify_requests(tables["request"]),
        commands.decide(tables["proposal"], tables["decision"], tables["actor_role"]),
        commands.preview(tables["submitted_command"], tables["order_fact"], tables["project"], "1998-06-15", ".+"),
    ):
        assert "Python" not in plan(df)


STREAMS = {n for n in all_queries() if n.endswith("_stream")}


@pytest.mark.parametrize("name", sorted(set(all_queries()) - STREAMS))
def test_no_pairwise_joins(spark, data_dir, name):
    text = plan(all_queries()[name].run(spark, data_dir))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_searches_take_one_pass_over_the_orders(tables):
    text = plan(orders.answer_requests(tables["message"], tables["numbered_order"], tables["numbered_scope"]))
    # The newest of a cell and the pages of the filters, each cut before its shuffle.
    assert text.count("WindowGroupLimit") >= 4
    # Slots come out of a generator, so that no pattern is repeated in a condition.
    assert not any("RLIKE" in line for line in text.splitlines() if line.lstrip(" :+-*()0123456789").startswith("Filter"))
