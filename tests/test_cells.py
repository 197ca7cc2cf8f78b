"""Joins of cells by workbook hold no table of all workbooks in one place."""

from titrate.plans import registry
from titrate.plans import tabular_queries  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_workbooks_are_never_broadcast(spark):
    registry.load()
    for name in ("g02_sheet_choice", "g03_table_header", "g04_header_index", "g16_cells_to_results"):
        df = registry.QUERIES[name](spark, SF)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        # The one broadcast left is that of connections (a row each), not of workbooks.
        joins = [line for line in plan.split("\n") if "BroadcastHashJoin" in line and "file_id" in line.split("BroadcastHashJoin")[1].split("]")[0]]
        assert not joins and "SortMergeJoin" in plan, (name, joins)
