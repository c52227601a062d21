from types import SimpleNamespace

import pytest

from mediaprism.llm import common


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    conf = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(applicationId="app-of-a-cluster", master="spark://host:7077", getConf=lambda: conf)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(SimpleNamespace(sparkContext=context, conf=conf))


def test_stored_tables_can_be_cleared(spark):
    kept = common.stored(spark.range(5), "kept")
    assert kept.count() == 5
    common.clear(spark)
    with pytest.raises(Exception):
        kept.count()
    assert common.stored(spark.range(3), "kept").count() == 3
