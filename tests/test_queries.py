import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
CHECKED = ["a03_delimited_scan", "b06_retransmission", "b25_frame_sequence", "c09_resolution", "d05_code_to_loinc", "d40_value_sets", "e16_note_attach",
           "f11_parts_reading", "g13_tabular_reading", "g16_cells_to_results", "h12_glob_match", "i04_specimen_pattern", "i05_rule_assessment", "i08_evidence_by_protocol", "j05_bundles", "j05_mixed_bundles", "k06_retry_budget", "l01_counts_by_state", "m02_order_code_mapping", "n03_frame_sessions", "n06_delivery_hand_off"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_query_agrees_with_sql(spark, con, name):
    ok, detail, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, detail


def test_every_query_has_sql():
    from titrate.plans import registry

    assert set(registry.ORACLES) == set(registry.QUERIES)


def test_bundles_are_identical_on_rerun(spark):
    from titrate.plans.bundles_queries import hl7_bundles

    first, again = ({r.delivery_id: r.bundle for r in hl7_bundles(spark, SF).collect()} for _ in range(2))
    assert first == again and first
