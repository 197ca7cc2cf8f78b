import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from titrate.operators import frames
from titrate.streaming import jobs

SCHEMA = "session_id string, seq int, frame_no int, text string, terminator string, checksum string, issue string"


class State:
    """What the stream's fold asks of a session's state."""

    exists, hasTimedOut, get = False, False, None

    def update(self, value):
        self.exists, self.get = True, value

    def remove(self):
        self.exists = False


def noisy(name, good, repeats, bad, rng, closed=True):
    """A session of ``good`` frames in turn, with exact repeats and refused frames strewn in."""
    out = []
    extra = sorted(rng.choices(range(good), k=repeats + bad))
    kinds = [True] * repeats + [False] * bad
    rng.shuffle(kinds)
    for k in range(good):
        own = ((k + 1) % 8, f"t{k}|", "ETX" if closed and k == good - 1 else "ETB", f"{k % 256:02X}")
        out.append((*own, None))
        while extra and extra[0] == k:
            extra.pop(0)
            out.append((*own, None) if kinds.pop() else rng.choice([(*own, "checksum"), ((k + 4) % 8, "lost", "ETB", "00", None), (None, None, None, None, "shape")]))
    return [(name, n, *f) for n, f in enumerate(out)]


def batch(spark, rows, **options):
    data = spark.createDataFrame(rows, SCHEMA)
    sessions = frames.sequenced(data, F.col("issue"), **options)
    ended = data.select("session_id").distinct()
    return sessions, {x.session_id: (x.raw_text, x.n_frames, x.state) for x in frames.assembled(sessions, ended).collect()}


def stream(rows):
    out = {}
    for name in {x[0] for x in rows}:
        data = pd.DataFrame([(*x[1:], "FRAME") for x in rows if x[0] == name], columns=["seq", "frame_no", "text", "terminator", "checksum", "issue", "kind"])
        data = data.astype(object).where(data.notna(), None)
        data.loc[len(data)] = [len(data), None, None, None, None, None, "EOT"]
        for got in jobs._sessions(None)((name,), iter([data]), State()):
            out[name] = (got.raw_text[0], got.n_frames[0], got.state[0])
    return out


def test_batch_and_stream_agree(spark):
    rng = random.Random(3)
    rows = [x for n in range(40) for x in noisy(f"s{n}", rng.randint(1, 60), rng.randint(0, 20), rng.randint(0, 20), rng, n % 3 > 0)]
    rows += [(f"r{n}", k, rng.randrange(10), rng.choice("ab"), rng.choice(["ETX", "ETB"]), "00", rng.choice([None, None, None, "checksum"]))
             for n in range(40) for k in range(50)]
    rng.shuffle(rows)
    want = stream(rows)
    for chunk in (1, 7, 256):
        sessions, got = batch(spark, rows, chunk=chunk)
        assert {k: v for k, v in got.items() if v[1]} == want
        sizes = {k: sum(x[0] == k for x in rows) for k in got}
        assert all(x.n_accepted + x.refused + x.repeated == sizes[x.session_id] for x in sessions.collect())


@pytest.mark.parametrize(("good", "state"), [(4096, "COMPLETE"), (4097, "INCOMPLETE_TRANSMISSION")])
def test_only_accepted_frames_count(spark, good, state):
    rows = noisy("long", good, 2000, 1904, random.Random(good))
    began = time.perf_counter()
    sessions, got = batch(spark, rows)
    took = time.perf_counter() - began
    assert got == stream(rows) and got["long"][1:] == (good, state) and len(rows) == good + 3904
    one = sessions.first()
    assert len(one.accepted) == 4096 and one.repeated + one.refused == 3904 and one.repeated >= 2000
    assert took < 30


def test_no_frames_and_only_refused_frames(spark):
    assert batch(spark, [])[1] == {}
    assert batch(spark, [("x", 0, 5, "a", "ETX", "00", None), ("x", 1, 1, "b", "ETX", "00", "checksum")])[1] == {"x": ("", 0, "INCOMPLETE_TRANSMISSION")}


class Clock(State):
    now, due = 1000, None

    def getCurrentProcessingTimeMs(self):
        return self.now

    def setTimeoutDuration(self, ms):
        self.due = self.now + ms


def test_sessions_of_a_bucket_keep_their_own_state_and_timers():
    def frames_of(name, *numbers, end=False):
        rows = [(name, k, "FRAME", n, f"{name}{n}|", "ETX" if n == 2 else "ETB", "00", None) for k, n in enumerate(numbers)]
        return rows + [(name, 99, "EOT", None, None, None, None, None)] * end

    def run(state, *rows):
        data = pd.DataFrame([r for part in rows for r in part],
                            columns=["session_id", "seq", "kind", "frame_no", "text", "terminator", "checksum", "issue"])
        data = data.astype(object).where(data.notna(), None)
        return [tuple(x) for got in jobs._sessions(100)((7,), iter([data]), state) for x in got.itertuples(index=False)]

    state = Clock()
    assert run(state, frames_of("a", 1), frames_of("b", 1, 2, end=True), frames_of("c", 1)) == [("b", "b1|b2|", 2, "COMPLETE")]
    assert state.due == 1100
    state.now = 1050
    assert run(state, frames_of("c", 2)) == [] and state.due == 1100
    state.now = 1120  # frames of c alone: a is late, c goes on
    assert run(state, frames_of("c", 3)) == [("a", "a1|", 1, "INCOMPLETE_TRANSMISSION")]
    state.now, state.hasTimedOut = 1220, True
    assert run(state) == [("c", "c1|c2|c3|", 3, "INCOMPLETE_TRANSMISSION")] and not state.exists
