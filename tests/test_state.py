import random
from datetime import datetime, timedelta

from titrate.operators import delivery


def simulate(events, most):
    """The same log, folded one event at a time."""
    state, n, reason, status = "PENDING", 0, None, None
    for kind, code in events:
        if state == "DELIVERED" or kind == "DISMISS":
            continue
        if kind == "RETRY":
            state, reason = "PENDING", None
            continue
        if state == "DMQ":
            continue
        n, status = n + 1, code
        if code == 200:
            state, reason = "DELIVERED", None
        elif code in (422, 404, 302):
            state, reason = "DMQ", {422: "CONFIG_STATE", 404: "REJECTED", 302: "UNEXPECTED_REDIRECT"}[code]
        elif n >= most:
            state, reason = "DMQ", "RETRY_EXHAUSTED"
        else:
            state, reason = "RETRYING", None
    return state, n, reason, status


def test_state_fold_agrees_with_simulation(spark):
    rng = random.Random(7)
    rows, expected = [], {}
    for d in range(60):
        events = []
        for i in range(rng.randint(1, 40)):
            kind = rng.choice(["ATTEMPT"] * 6 + ["RETRY", "DISMISS"])
            code = rng.choice([None, 503, 408, 429, 422, 404, 302] + ([200] if rng.random() < 0.2 else [])) if kind == "ATTEMPT" else None
            events.append((kind, code))
            rows.append((f"d{d}", datetime(2024, 1, 1) + timedelta(hours=7 * i), i, kind, code))
        expected[f"d{d}"] = simulate(events, 4)
    log = spark.createDataFrame(rows, "delivery_id string, at timestamp, event_id int, kind string, status int")
    got = {r.delivery_id: (r.state, r.attempts, r.failure_reason, r.last_http_status) for r in delivery.states(log, 4).collect()}
    assert got == expected
