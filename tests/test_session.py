import pytest

from demandgrid.session import shared_dir


class Session:
    """The settings of a session, without one."""

    def __init__(self, **settings):
        values = {k.replace("_", "."): v for k, v in settings.items()}
        self.conf = type("Conf", (), {"get": staticmethod(lambda name, default=None: values.get(name, default))})


def test_the_shared_folder_is_named_on_a_cluster():
    assert shared_dir(Session(spark_master="yarn", spark_checkpoint_dir="hdfs://a/b/")) == "hdfs://a/b"
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(Session(spark_master=master))


def test_one_process_uses_its_warehouse():
    for master in ("local", "local[8]"):
        assert shared_dir(Session(**{"spark_master": master, "spark_sql_warehouse_dir": "/w"})) == "/w/_scratch"


def test_tasks_over_small_groups_grow_in_number_not_in_rows(spark, monkeypatch):
    from demandgrid import session as ss
    from demandgrid.plans.driver_tables import DriverTables

    whole = DriverTables(spark, "/root/testdata/sf0.001").material_store_daily
    monkeypatch.setattr(ss, "ROWS_PER_TASK", 300)
    dealt = DriverTables(spark, "/root/testdata/sf0.001").material_store_daily
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert sorted(whole.collect()) == sorted(dealt.collect())
    rows = DriverTables(spark, "/root/testdata/sf0.001").raw.count()
    assert f", {-(-rows // 300)})" in plan and plan.count("hashpartitioning(material_key") == 1
