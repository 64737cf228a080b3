import types

import pytest
from pyspark.sql import functions as F

from folioforge.operators import tables


def _session(master, **conf):
    """What ``shared_root`` asks of a session."""
    held = {}
    context = types.SimpleNamespace(master=master, getConf=lambda: conf, getCheckpointDir=lambda: None)
    return types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda k, d=None: held.get(k, d), set=held.__setitem__))


def test_no_machine_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        tables.shared_root(_session("spark://host:7077"))
    with pytest.raises(RuntimeError):
        tables.shared_root(_session("local-cluster[2,1,1024]"))
    assert tables.shared_root(_session("yarn", **{"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"
    local = _session("local[4]")
    assert tables.shared_root(local).startswith("file://") and tables.shared_root(local) == tables.shared_root(local)


def test_output_paths_outlive_the_scratch_folder(spark):
    one, two = tables.output_path(spark, "x"), tables.output_path(spark, "x")
    assert one != two and not one.startswith(tables.scratch_root(spark))


@pytest.mark.parametrize("few", [0, 10**6])
def test_ranked(spark, monkeypatch, few):
    monkeypatch.setattr(tables, "FEW", few)
    rows = spark.range(500).select((F.col("id") * 37 % 500).alias("v"), F.when(F.col("id") % 2 == 0, "x").alias("o"))
    got = tables.ranked(rows, F.col("v").desc(), to="place").collect()
    assert sorted((r.place, r.v) for r in got) == [(i, 499 - i) for i in range(500)]
    assert tables.ranked(rows.filter("false"), F.col("v"), to="place").count() == 0
