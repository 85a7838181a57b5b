"""Driver contract: entry runs, keys and SQL agree, plans avoid cartesian products."""

import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"qid", "rank", "vec_id", "dist"}


def entry_core_keys():
    from ragspark.plans import registry
    return set(registry.queries())


def test_every_sql_key_is_a_query():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 139
    assert entry_core_keys() <= set(qs)


def test_no_cartesian_product_in_search_plans(spark):
    from conftest import SF
    for key in ("vec_topk_merge", "vec_exact_knn", "tel_summary", "rte_map_probes"):
        plan = E.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, key


def test_layout_read_prunes_partitions(spark):
    from conftest import SF
    df = E.queries()["run_layout"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "view" in plan
