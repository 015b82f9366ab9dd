import random


import pandas as pd
import pytest

from casagrid.operators import trace_rules as R
from casagrid.operators import traces as T
from casagrid.streaming import streams

COLS = "session_id long, event_id long, ts_ms long, latitude double, longitude double, accuracy double, speed double, heading double"


def walk(n=400, sessions=3, seed=5):
    rnd = random.Random(seed)
    rows, state = [], {s: [1_700_000_000_000, -34.6, -58.65] for s in range(sessions)}
    for i in range(n):
        s = 0 if rnd.random() < 0.7 else rnd.randrange(sessions)
        st = state[s]
        st[0] += rnd.choice([0, 500, 1500, 3000, 4000, 9000, 31000, 400000])
        far = rnd.random() < 0.05
        st[1] += rnd.uniform(-1, 1) * (0.05 if far else 0.0004)
        st[2] += rnd.uniform(-1, 1) * 0.0004
        rows.append((s, i, st[0], st[1], st[2], rnd.choice([8.0, 25.0, 45.0, 90.0]), rnd.choice([None, 0.5, 6.0, 12.0]), rnd.choice([None, rnd.uniform(0, 360)])))
    return rows


def frame(rows):
    return pd.DataFrame(rows, columns=[c.split()[0] for c in COLS.split(",")])


def one_by_one(rows, rule):
    """The rule fed a single row at a time."""
    out, states = {}, {}
    for row in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        states[row[0]], columns = rule(states.get(row[0]), frame([row]))
        if columns.pop("_out", [True])[0]:
            out[row[1]] = {k: v[0] for k, v in columns.items()}
    return out


def test_acceptance_segments_equal_one_by_one(spark):
    rows = walk()
    rows += [(0, 900, rows[0][2] + 5, None, -58.0, 5.0, None, None), (0, 901, rows[0][2] + 6, -34.6, -58.65, None, None, None), (0, 902, None, -34.6, -58.65, 5.0, None, None)]
    want = one_by_one([r for r in rows if r[2] is not None], R.accept_rule)
    got = {r["event_id"]: r for r in T.accept_trace_points(spark.createDataFrame(rows, COLS)).collect()}
    assert (got[900]["reason"], got[901]["reason"], got.pop(902)["reason"]) == ("invalid", "accuracy", "timestamp")
    assert set(got) == set(want)
    for k, v in want.items():
        assert (got[k]["accepted"], got[k]["reason"]) == (v["accepted"], v["reason"])
        assert abs(got[k]["distance_m"] - v["distance_m"]) < 1e-6
    assert {v["reason"] for v in want.values()} >= {"first", "jump", "movement", "invalid", "accuracy"}


@pytest.mark.parametrize("rule", [R.accept_rule, R.heading_rule, R.sample_rule])
def test_rules_do_not_depend_on_how_rows_are_cut(rule):
    rows = sorted((r for r in walk(seed=3) if r[0] == 0), key=lambda r: (r[2], r[1]))
    whole = rule(None, frame(rows))[1]
    single = one_by_one(rows, rule)
    for i, r in enumerate(rows):
        if whole.get("_out", [True] * len(rows))[i]:
            assert all(a == b or (pd.isna(a) and pd.isna(b)) for a, b in zip([v[i] for k, v in whole.items() if k != "_out"], single[r[1]].values(), strict=True))
        else:
            assert r[1] not in single


def test_sampling_equals_one_by_one(spark):
    rows = walk(seed=8)
    got = {r["event_id"] for r in T.sample_positions(spark.createDataFrame(rows, COLS)).collect()}
    assert got == set(one_by_one(rows, R.sample_rule))


def test_literal_reasons():
    def reasons(*fixes):
        return R.accept_rule(None, frame([(1, i, ts, lat, -58.6, 5.0, None, None) for i, (ts, lat) in enumerate(fixes)]))[1]["reason"].tolist()

    assert reasons((0, -34.6), (0, -34.6), (1000, -34.5), (1000, -34.6), (5000, -34.6), (31000, -34.6)) == ["first", "order", "jump", "interval", "noise", "continuity"]


def test_heading_turns_smoothly_and_ignores_outliers():
    rows = [(1, i, i * 2000, -34.6 + i * 0.0002, -58.6, 5.0, 11.0, 0.0) for i in range(12)] + [(1, 12, 24000, -33.0, -58.6, 5.0, 11.0, 0.0)]
    out = R.heading_rule(None, frame(rows))[1]
    assert out["reason"][-2:].tolist() == ["moving", "jump"]
    assert min(abs(out["camera_heading"][-1]), abs(out["camera_heading"][-1] - 360)) < 1


def test_alerts_equal_brute_force(spark):
    rows = walk(seed=2, n=150)
    rnd = random.Random(4)
    props = [(i, -34.6 + rnd.uniform(-0.004, 0.004), -58.65 + rnd.uniform(-0.004, 0.004)) for i in range(60)]
    got = {(r["session_id"], r["event_id"], r["group_id"]) for r in T.proximity_alerts(spark.createDataFrame(rows, COLS), spark.createDataFrame(props, "property_id long, latitude double, longitude double")).collect()}
    want, done = set(), {}
    for s, e, ts, lat, lon, _acc, speed, heading in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        options = []
        for pid, plat, plon in props:
            d = float(R.metres(lat, lon, plat, plon))
            group = f"{plat:.6f},{plon:.6f}"
            if d > T.ALERT_M or group in done.setdefault(s, set()):
                continue
            rank = 1
            if speed is not None and heading is not None and speed >= 2:
                course = float(R.course(lat, lon, plat, plon))
                turn = abs(R.turn(course, heading))
                rank = 0 if turn <= 35 else 3 if turn >= 155 else 1
            if rank < 3:
                options.append((rank, d, pid, group))
        if options:
            best = min(options)
            done[s].add(best[3])
            want.add((s, e, best[3]))
    assert got == want and want


def test_sampling_works_short_segments_as_one_run(spark, monkeypatch):
    rows = [(s, i * 2 + s, 1_700_000_000_000 + i * 9000 * (1 + i % 3), -34.6 + i % 7 * 4e-4, -58.6, 5.0, None, None) for s in (0, 1) for i in range(600)]
    frames, rule = spark.sparkContext.accumulator(0), R.sample_rule
    monkeypatch.setattr(R, "sample_rule", lambda last, frame: (frames.add(1), rule(last, frame))[1])
    got = {(r["session_id"], r["event_id"]) for r in T.sample_positions(spark.createDataFrame(rows, COLS)).collect()}
    want, last = set(), {}
    for s, e, ts, lat, lon, *_ in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        then = last.get(s)
        if then is None or (ts - then[0] >= 5000 and (ts - then[0] >= 15000 or R.metres(then[1], then[2], lat, lon) >= 60)):
            want.add((s, e))
            last[s] = ts, lat, lon
    assert got == want and len(want) < len(rows) and frames.value < 100


def farthest(points, lo, hi, tolerance):
    """The farthest-point rule by recursion."""
    if hi - lo < 2:
        return []
    off = [float(R.off_chord(*points[i], *points[lo], *points[hi])) for i in range(lo + 1, hi)]
    at = lo + 1 + off.index(max(off))
    if max(off) <= tolerance:
        return []
    return [*farthest(points, lo, at, tolerance), at, *farthest(points, at, hi, tolerance)]


@pytest.mark.parametrize("stretch", [60, 10_000])
def test_simplify_is_exact_for_any_length(spark, stretch):
    import math

    rnd, rows, lat, lon = random.Random(6), [], -34.6, -58.6
    for i in range(240):
        lat, lon = lat + rnd.uniform(-1, 1) * 3e-4, lon + rnd.uniform(-1, 1) * 3e-4
        rows.append((i % 2, i, 1_700_000_000_000 + i * 1000, lat, lon, 5.0, None, None))
    rows += [(7, 1000, 5, -34.6, -58.6, 5.0, None, None), (8, 1001, 5, -34.6, -58.6, 5.0, None, None), (8, 1002, 6, -34.7, -58.6, 5.0, None, None)]
    got = {(r["session_id"], r["event_id"]) for r in T.simplify_traces(spark.createDataFrame(rows, COLS), 12.0, stretch).collect()}
    want = set()
    for session in (0, 1, 7, 8):
        own = [r for r in rows if r[0] == session]
        scale = T.EARTH_M * math.pi / 180
        points = [(r[4] * scale * math.cos(math.radians(own[0][3])), r[3] * scale) for r in own]
        want |= {(session, own[i][1]) for i in [0, *farthest(points, 0, len(own) - 1, 12.0), len(own) - 1]}
    assert got == want and len(want) > 30


def test_rims_hold_every_farthest_point():
    import numpy as np

    rng = np.random.default_rng(5)
    shapes = [rng.normal(size=(300, 2)) * 100, rng.integers(0, 5, (300, 2)) * 10.0, np.column_stack([np.arange(300.0), np.zeros(300)]), np.ones((4, 2)), np.array([[0.0, 1], [np.nan, 2], [3, 4], [1, np.inf]])]
    for points in shapes:
        x, y = points.T
        inside = R.rim(x, y)
        assert not inside[~np.isfinite(x) | ~np.isfinite(y)].any()
        for _ in range(200):
            off = R.off_chord(x, y, *rng.normal(size=4) * rng.choice([1, 100]))
            best = np.nanmax(off[np.isfinite(x) & np.isfinite(y)])
            assert inside[np.flatnonzero(off == best)].all()
    assert R.rim(*shapes[0].T).sum() < 40


@pytest.mark.parametrize("rim_points", [1000, 10])
def test_a_zigzag_is_settled_in_few_rounds(spark, monkeypatch, rim_points):
    """Far spots come back again and again, so each split takes off a short piece only."""
    import math

    n = 2400 if rim_points > 10 else 300
    spots = [(i * 37 % 40, i * 11 % 40) for i in range(40)]
    rows = [(1, i, 1_700_000_000_000 + i * 1000, -34.6 + spots[i * i % 40][0] * 6e-5, -58.6 + spots[i * 7 % 40][1] * 6e-5, 5.0, None, None) for i in range(n)]
    df = spark.createDataFrame(rows, COLS)
    rounds, kept = [], type(df).checkpoint
    monkeypatch.setattr(type(df), "checkpoint", lambda self, *a, **k: (rounds.append(1), kept(self, *a, **k))[1])
    got = {r["event_id"] for r in T.simplify_traces(df, 12.0, 100, rim_points).collect()}
    scale = T.EARTH_M * math.pi / 180
    points = [(r[4] * scale * math.cos(math.radians(-34.6)), r[3] * scale) for r in rows]
    import sys

    sys.setrecursionlimit(10_000)
    assert got == {0, *farthest(points, 0, n - 1, 12.0), n - 1}
    assert rim_points == 10 or len(rounds) <= 9


def test_trip_lists_cut_alike(spark):
    rows = walk(seed=2, n=150)
    props = spark.createDataFrame([(i, -34.6 + (i % 20) * 1e-4, -58.65) for i in range(60)], "property_id long, latitude double, longitude double")
    fixes = spark.createDataFrame(rows, COLS)
    none = spark.createDataFrame([], "session_id long, property_id long")
    for most in (None, 7):
        met = T.accumulate_encounters(fixes, props, 350.0, most)
        held = {r["session_id"]: r["n"] for r in met.groupBy("session_id").agg({"kept_properties": "sum"}).withColumnRenamed("sum(kept_properties)", "n").collect()}
        listed = {r["session_id"]: r["count"] for r in T.trip_properties(met, props, none).groupBy("session_id").count().collect()}
        assert held == listed and (max(held.values()) <= 7 if most else max(held.values()) > 7)


def test_stream_in_many_batches_equals_batch(spark, tmp_path):
    rows = sorted(walk(n=120, seed=9), key=lambda r: (r[2], r[1]))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.STATE_PROVIDER)
    for part in range(3):
        chunk = rows[part * 40 : (part + 1) * 40]
        spark.createDataFrame(chunk, COLS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.run_to_table(streams.accept_stream(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r["event_id"]: (r["accepted"], r["reason"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {k: (v["accepted"], v["reason"]) for k, v in one_by_one(rows, R.accept_rule).items()}
    assert got == want


def test_nearby_cuts_only_a_first_suspicious_group(spark):
    props = [(i, -34.6, -58.6) for i in range(8)] + [(100, -34.6005, -58.6)]
    df = spark.createDataFrame(props, "property_id long, latitude double, longitude double")
    pos = spark.createDataFrame([(1, -34.6, -58.6)], "position_id long, latitude double, longitude double")
    rows = T.nearby_query(pos, df, 350.0, limit=6).collect()
    assert len(rows) == 6 and all(r["group_truncated"] and r["group_suspicious"] for r in rows)
    assert T.nearby_query(pos, df, 350.0, limit=9).count() == 9
