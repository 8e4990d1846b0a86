import pytest

from ratewise import session as S


class FakeConf:
    def __init__(self, d):
        self.d = d

    def get(self, k, default=None):
        return self.d.get(k, default)


class FakeSpark:
    def __init__(self, d):
        self.conf = FakeConf(d)

    @property
    def sparkContext(self):
        raise AttributeError("no context")


def test_cluster_without_checkpoint_dir_is_refused():
    with pytest.raises(RuntimeError):
        S.scratch_dir(FakeSpark({"spark.master": "yarn"}))


def test_checkpoint_dir_from_session_is_used():
    assert S.scratch_dir(FakeSpark({"spark.master": "yarn", "spark.checkpoint.dir": "/shared/ck"})) == "/shared/ck"


def test_local_without_setting_gets_private_tmp():
    p = S.scratch_dir(FakeSpark({"spark.master": "local[2]", "spark.app.id": "x"}))
    assert p.startswith("/tmp/ratewise-")


def test_small_marks_and_does_not_recount(spark):
    df = spark.range(10)
    a = S.small(df)
    assert a._rw_rows == 10
    assert S.small(a) is a
    big = S.small(spark.range(50), max_rows=5)
    assert big._rw_rows == 50


def test_dealt_tasks_grow_with_the_rows_not_a_task(spark, monkeypatch):
    df = spark.range(4000).repartition(1)
    assert S.dealt(df, 4000, "id") is df  # few rows: left to the planner
    monkeypatch.setattr(S, "TASK_ROWS", 100)
    for n in (2000, 4000):
        parts = S.dealt(df.filter(f"id < {n}"), n, "id").rdd.glom().map(len).collect()
        assert len(parts) == n // 100 and max(parts) < 200 and sum(parts) == n
