"""Rows are counted by file before files are matched by name."""

from titrate.plans import registry, sources_queries  # noqa: F401


def test_join_takes_one_row_a_file(spark):
    registry.load()
    df = registry.QUERIES["a07_directory_scan"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(plan) if "Join " in line)
    assert "Aggregate [name" in plan[at + 1] and "count(1)" in plan[at + 1]
    assert df.first()["n_rows"] == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
