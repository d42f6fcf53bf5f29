import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from framewright.operators import intervals

SCHEMA = "video_id int, box_label string, start_frame long, end_frame long, start_ms long, end_ms long, kind string"


def run(spark, rows):
    return {tuple(r) for r in intervals.label_periods(spark.createDataFrame(rows, SCHEMA)).collect()}


def brute(rows):
    covered = {}
    for v, label, sf, ef, sm, em, _ in rows:
        s = sf if sf is not None else None if sm is None else -(-sm * 3 // 100)
        e = ef if ef is not None else None if em is None else -(-em * 3 // 100)
        if None not in (v, label, s, e):
            covered.setdefault((v, label.strip().upper()), set()).update(range(min(s, e), max(s, e) + 1))
    out = set()
    for k, frames in covered.items():
        periods = []
        for f in sorted(frames):
            if periods and periods[-1][1] == f - 1:
                periods[-1][1] = f
            else:
                periods.append([f, f])
        out |= {(*k, "period", a, b) for a, b in periods}
        out |= {(*k, "gap", b + 1, c - 1) for (_, b), (c, _) in zip(periods, periods[1:])}
    return out


def test_cases(spark):
    rows = [
        (1, " a", 5, 9, None, None, "x"), (1, "A ", 10, 12, None, None, "x"), (1, "a", 20, 18, None, None, "x"), (1, "A", None, 30, 800, None, "x"),
        (1, "A", None, 40, None, None, "x"), (None, "A", 1, 2, None, None, "x"), (1, None, 1, 2, None, None, "x"), (1, "", 3, 3, None, None, "x"),
        (1, "A", 5, 9, None, None, "x"), (2, "A", None, None, 33, 66, "x"),
    ]
    found = run(spark, rows)
    assert found == brute(rows)
    assert (1, "A", "period", 5, 12) in found and (1, "A", "gap", 13, 17) in found and (2, "A", "period", 1, 2) in found and (1, "", "period", 3, 3) in found


def test_empty(spark):
    assert run(spark, []) == set()


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(0, 60), st.sampled_from("AB")), min_size=1, max_size=60))
def test_any(spark, spans):
    rows = [(1, label, a, a + n, None, None, "") for a, n, label in spans]
    block, intervals.BLOCK = intervals.BLOCK, 32
    try:
        assert run(spark, rows) == brute(rows)
    finally:
        intervals.BLOCK = block


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, 0, 4, 7, 8, dt.date(2024, 1, 1))], "k int, at long, last long, block int, change int, next date")
    assert [tuple(r) for r in intervals.sweep(df, ["k"], "at", "last").collect()] == [(1, "period", 0, 4)]
