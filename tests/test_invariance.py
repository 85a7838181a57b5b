"""Registered queries give the same rows at 1, 4 and 16 shuffle partitions
(catches order-dependent logic)."""

import pytest

import __spark_entry__ as E
from conftest import SF

KEYS = ["vec_topk_merge", "tel_summary", "hit_cdf", "ivf_local_id", "rte_pad", "txt_chunk_ids", "cap_best_batch"]


def _rows(spark, key, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = E.queries()[key](spark, SF)
        return sorted(tuple(str(v) for v in r) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("key", KEYS)
def test_partition_invariance(spark, key):
    base = _rows(spark, key, 1)
    assert base, key
    for parts in (4, 16):
        assert _rows(spark, key, parts) == base, (key, parts)
