"""Session helpers and re-execution stability of the pinned range layout."""

from cadenza.operators.scan import earlier_count
from cadenza.session import ensure_checkpoint_dir


def test_checkpoint_dir_is_kept(spark):
    first = ensure_checkpoint_dir(spark)
    assert first and ensure_checkpoint_dir(spark) == first
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:                      # a configured shared folder is used, never replaced
        assert configured.rstrip("/").split("/")[-1] in first


def test_prefix_count_is_stable_across_reexecution(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_partkey", "l_orderkey",
                                                                               "l_linenumber", "l_suppkey")
    out = earlier_count(li, ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey"], out="e")
    a = sorted(map(tuple, out.collect()))
    b = sorted(map(tuple, out.collect()))
    assert a == b and len(a) == li.count()
