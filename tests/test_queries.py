import pytest

from lodestream.plans import queries as Q

from .oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_its_sql(spark, name):
    compare(spark, Q.QUERIES[name], Q.SQL[name], SF)


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_whole_import_is_many_bounded_files(spark, monkeypatch):
    import glob

    made = []
    monkeypatch.setattr(Q, "new_path", lambda spark, name, real=Q.new_path: made.append(real(spark, name)) or made[-1])
    events = Q.table(spark, SF, "events")
    assert Q.QUERIES["scan_import_all"](spark, SF).count() == events.count()
    files = glob.glob(made[0].removeprefix("file:").replace("//", "/") + "/part-*.txt")
    assert len(files) == events.selectExpr("event_id div 1000").distinct().count()


def test_every_region_is_a_candidate(spark, tmp_path):
    names = [f"far away place {k}" for k in range(150)] + ["near"]
    spark.createDataFrame(list(enumerate(names)), "r_regionkey int, r_name string").coalesce(1).write.parquet(f"{tmp_path}/region.parquet")
    spark.createDataFrame([(1, "near1")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    assert [r.hint for r in Q.QUERIES["nearest_command"](spark, str(tmp_path)).collect()] == ["near"]
