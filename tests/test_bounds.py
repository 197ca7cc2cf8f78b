from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from titrate.operators import delivery, reports

NOW = datetime(2024, 5, 1)
SCHEMA = "delivery_id string, state string, failure_reason string, connection_id string, lease_until timestamp, has_bundle boolean, dismissed_at timestamp, received_at timestamp"


def dead(spark):
    """Newest first: four that cannot be retried, then six that can."""
    rows = [(f"d{k}", "DMQ", "INCOMPLETE_TRANSMISSION" if k < 2 else "REJECTED", "c", NOW + timedelta(hours=1) if k in (2, 3) else None, True, None,
             NOW - timedelta(hours=k)) for k in range(10)]
    return spark.createDataFrame(rows, SCHEMA)


def test_bulk_retry_reaches_past_rows_that_cannot_be_retried(spark):
    def counts(most):
        return tuple(delivery.bulk_retry(dead(spark), None, None, F.lit(NOW), most).select("requested", "retried", "skipped", "remaining").first())

    assert counts(4) == (8, 4, 4, 2)
    assert counts(1000) == (10, 6, 4, 0)


def test_bulk_retry_by_ids(spark):
    got = {x.delivery_id: (x.retried, x.reason) for x in delivery.bulk_retry_ids(["d9", "d2", "none"], dead(spark), F.lit(NOW)).collect()}
    assert got == {"d9": (True, None), "d2": (False, "delivery_in_progress"), "none": (False, "not_found")}
    with pytest.raises(ValueError):
        delivery.bulk_retry_ids(["x"] * 501, dead(spark), F.lit(NOW))


def test_large_pages_are_refused(spark):
    assert reports.page(dead(spark), ["delivery_id"], 3).count() == 3
    with pytest.raises(ValueError):
        reports.page(dead(spark), ["delivery_id"], 1001)
