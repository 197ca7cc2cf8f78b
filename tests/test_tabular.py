"""Cells are found by places that depend on the header only, and their texts are cut by compiled code."""

import pytest
from pyspark.sql import functions as F

from titrate.operators import tabular
from titrate.plans import registry
from titrate.plans import tabular_queries  # noqa: F401

MAPPING = [("Tube", "sampleId"), ("Tube 2", "sampleId"), ("Channel", "testCode"), ("Cycle", "ctValue"), ("Gone", "units"), ("Amount", "result")]


@pytest.fixture
def rows(spark):
    def read(content, delimiter=",", marker=None):
        schema = ("path string, connection_id string, content binary, delimiter string, skip_rows int, "
                  "layout struct<header_marker:string,max_rows_to_scan:int>, column_mapping array<struct<key:string,value:string>>")
        files = spark.createDataFrame([("p", "c", content.encode(), delimiter, 0, (marker, 20), MAPPING)], schema)
        got = tabular.semantic_fields(tabular.delimited_rows(files, "connection_id"))
        return [tuple(x) for x in got.orderBy("row_no").select("row_no", "sampleId", "testCode", "units", "ctValue", "result").collect()]

    return read


def test_several_columns_repeated_headers_and_quotes(rows):
    text = 'Tube,Tube 2,Channel,Cycle,Cycle,Amount\n,b,"T,1",1,2,3\n a ,b,T1,1,\t\n" ",\'b, "say ""x""" ,4,5, \n\n"",,,"",,"7"\n'
    assert rows(text) == [(0, "b", "T,1", None, "2", "3"), (1, "a", "T1", None, None, None), (2, "'b", 'say "x"', None, "5", None),
                          (3, None, None, None, None, "7")]


def test_line_breaks_inside_quotes_and_other_delimiters(rows):
    assert rows('x\nTube|Channel|Amount\n"a|\nb"|T1|"5"\n', "|", "Tube") == [(0, "a|\nb", "T1", None, None, "5")]
    for d in "\t;.":
        assert rows(f"Tube{d}Channel{d}Amount\na{d} T1{d}\n", d) == [(0, "a", "T1", None, None, None)]


def test_order_of_value_fields(spark):
    data = [(["ctValue", "result"], " ", "r", "i", "r"), (["result", "x", "y", "ctValue", "interpretation"], None, None, "i", "i"), ([], "c", "r", "i", None),
            (["nothing", "interpretation"], "c", "r", " ", None), (None, "c", "r", "i", None)]
    docs = spark.createDataFrame(data, "o array<string>, ctValue string, result string, interpretation string, want string")
    assert all(x["got"] == x["want"] for x in docs.select("want", tabular.selected_value(F.col("o")).alias("got")).collect())


def test_rows_run_no_lambda_over_the_mapping(spark):
    registry.load()
    df = registry.QUERIES["g05_semantic_fields"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("posexplode")]  # what is done for every row of a file
    assert "column_mapping" not in above and "header" not in above
