import pytest

from freshet.llm import common
from freshet.llm.components import components


class Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)


class Session:
    """A session of a cluster that names no shared folder."""

    def __init__(self, master, **conf):
        self.conf = Conf(conf)
        self.sparkContext = type("Context", (), {"master": master, "getConf": lambda _: Conf()})()


def test_a_cluster_has_to_name_its_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_root(Session(master))
    assert common.shared_root(Session("yarn", **{"spark.checkpoint.dir": "hdfs://a/b/"})) == "hdfs://a/b"


def test_staged_tables_leave_no_shuffle_files(spark):
    before = spark.conf.get(common._CLEANUP, None)
    df = common.stage(spark, spark.range(1000).repartition(7, "id").groupBy("id").count(), common.scratch(spark, "t"))
    assert df.count() == 1000 and spark.conf.get(common._CLEANUP, None) == before


def test_components_of_a_hub_and_a_chain(spark):
    edges = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5001)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {x.node: x.component for x in components(spark, df, common.scratch(spark, "components")).collect()}
    assert got == {i: 0 for i in range(300)} | {i: 1000 for i in range(1000, 1061)} | {5000: 5000, 5001: 5000}
