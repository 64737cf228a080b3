import re

import pytest

from folioforge.plans import indexed, inline, served, streamed  # noqa: F401
from folioforge.plans.catalogue import QUERIES
from tests.oracle import SF, same

WITH_TWIN = sorted(k for k, (_, sql) in QUERIES.items() if sql)


@pytest.mark.parametrize("name", WITH_TWIN)
def test_twin(spark, name):
    build, sql = QUERIES[name]
    same(spark, build, sql)


def test_no_python_on_hot_paths(spark):
    for name in ("search_topk", "hits_dedupe_union", "research_merge", "lint_broken", "graph_components"):
        plan = QUERIES[name][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan, name


def test_scan_is_pruned(spark):
    plan = QUERIES["index_diff"][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_search_asks_for_tokens_before_quality_and_scores_last(spark):
    plan = QUERIES["search_topk"][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
    where = plan[plan.index("Filter") :]
    # A token is looked for first; only then is the body asked whether it can be read, and nothing is counted there.
    assert 0 < where.index("RLIKE(lower(") < where.index("Contains(") and not re.search("(?<!regexp_)replace\\(", where.split("FileScan")[0])
    assert "Window" not in plan and "Exchange hashpartitioning" not in plan


def test_the_registry_is_not_ranked(spark):
    from folioforge.operators import search
    from folioforge.plans import shapes

    plan = search.search(shapes.doc_pages(spark, SF), "the thin", shapes.registry(spark, SF))._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Window") :]
    assert plan.count("Window [") == 1 and "TakeOrderedAndProject" in below  # the only window is over the rows that are left


def test_topics_without_evidence_do_not_read_paragraphs(spark):
    plan = QUERIES["topic_sources"][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "是指" not in plan and "refers to" not in plan


def test_order_of_partitions_does_not_matter(spark):
    from folioforge.operators import search
    from folioforge.plans import shapes
    from folioforge.plans.catalogue import QUERY

    pages = shapes.doc_pages(spark, SF)
    one = search.page_hits(pages.repartition(1), QUERY).collect()
    assert one == search.page_hits(pages.repartition(8), QUERY).collect() and len(one) == 12


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 12
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_short_rows_that_cost_much_are_dealt_out(spark):
    for name in ("front_matter_pages", "titles_and_paragraphs"):
        assert "REPARTITION_BY_NUM" in QUERIES[name][0](spark, SF)._jdf.queryExecution().executedPlan().toString(), name
