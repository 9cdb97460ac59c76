"""Orders, quantiles, neighbours, merged states and repeatable appends against plain versions; NULL groups; hard values."""

import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracube.operators import evaluate as ev
from terracube.operators import moments as mo
from terracube.operators import ordered as od
from terracube.operators import sampling as sp
from terracube.operators import scoring as sc
from terracube.operators import sequences as sq
from terracube.operators import stats as st
from terracube.queries import Huber
from terracube.sources import blocks as bl
from terracube.sources import grids as io

HARD = [0.0, -0.0, 1e-308, -1e-308, 5e-324, 1e300, -1e300, 1.0, 1.0, 1.0, -1.5, 2.0**53, 2.0**53 + 2, 1e-7, 3.0, 3.0000000000000004]


def pairs(spark, rows):
    return spark.createDataFrame(rows, "g string, o double, p double")


def test_bits_sort_like_numbers_and_come_back(spark):
    values = [*HARD, float("inf"), float("-inf")]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").select("v", od.order_bits(F.col("v")).alias("b")).select("v", "b", od.from_bits(F.col("b")).alias("w")).collect()
    assert all(r.v == r.w for r in rows) and rows[-1].b is None
    for x, y in itertools.combinations(rows[:-1], 2):
        assert (x.v < y.v) == (x.b < y.b) and (x.v == y.v) == (x.b == y.b)


def test_null_groups_are_kept(spark):
    rng = np.random.default_rng(0)
    rows = [(g, float(rng.integers(0, 6)), float(rng.integers(0, 6))) for g in ("a", None) for _ in range(40)]
    df = pairs(spark, rows)
    by = lambda g: [(o, p) for h, o, p in rows if h == g]
    rank = lambda v: [sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v]
    got = {r.g: r.spearman for r in ev.spearman(df, ["g"], "o", "p").collect()}
    for g in ("a", None):
        o, p = zip(*by(g), strict=True)
        assert got[g] == pytest.approx(np.corrcoef(rank(o), rank(p))[0, 1])
    named = {r.g: r for r in ev.spaef(df.fillna("b", ["g"]), ["g"], "o", "p", bins=4).collect()}
    nulls = {r.g: r for r in ev.spaef(df, ["g"], "o", "p", bins=4).collect()}
    assert (nulls[None].beta, nulls[None].spaef) == (named["b"].beta, named["b"].spaef) and nulls[None].beta is not None
    numbered = df.withColumn("k", F.monotonically_increasing_id()).withColumn("h", F.when(F.col("g") == "a", 1))
    drawn = sp.with_replacement(numbered, 0.5, "k", "h", 3).groupBy("h").count().collect()
    assert {(r.h, r["count"]) for r in drawn} == {(1, 20), (None, 20)}
    assert ev.spearman(df.where("false"), ["g"], "o", "p").count() == 0
    assert ev.spearman(df, [], "o", "p").count() == 1


def test_spearman_moves_groups_once(spark):
    df = pairs(spark, [(g, float(i % 5), float(i % 7)) for i in range(40) for g in ("a", "b")])
    plan = ev.spearman(df, ["g"], "o", "p")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


@pytest.mark.parametrize("most", [0, 50, 1000])
def test_spearman_by_sorts_and_by_counts(spark, monkeypatch, most):
    monkeypatch.setattr(ev, "SORTED_PAIRS", most)
    rng = np.random.default_rng(5)
    sizes = {("a", 1): 200, ("a", None): 51, (None, 1): 50, (None, None): 120, ("b", 2): 1, ("b", 3): 30}
    rows = [(g, k, float(rng.choice(HARD)), float(rng.choice([*HARD, math.nan]))) for (g, k), n in sizes.items() for _ in range(n)]
    rows += [("c", 1, 1.0, float(i)) for i in range(60)] + [("a", 1, None, 1.0), ("d", 1, 1.0, None)]
    got = {(r.g, r.k): r.spearman for r in ev.spearman(spark.createDataFrame(rows, "g string, k int, o double, p double"), ["g", "k"], "o", "p").collect()}
    assert set(got) == {*sizes, ("c", 1)} and got["c", 1] is None and got["b", 2] is None
    rank = lambda v: [sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v]
    for key in set(sizes) - {("b", 2)}:
        o, p = zip(*[(o, math.inf if math.isnan(p) else p) for g, k, o, p in rows if (g, k) == key and o is not None], strict=True)
        assert got[key] == pytest.approx(np.corrcoef(rank(o), rank(p))[0, 1])


def test_running_sums_by_days_and_real_numbers(spark):
    rows = [("x", dt.date(2020, 1, 1) + dt.timedelta(days=7 * i), float(i)) for i in range(30)] + [(None, dt.date(1960, 1, 1), 5.0), (None, dt.date(1980, 1, 1), 7.0)]
    df = spark.createDataFrame(rows, "g string, t date, v double")
    got = {(r.g, r.t): r.s for r in od.running_sum(df, ["g"], "t", F.col("v"), "s").collect()}
    assert got == {(g, t): sum(v for h, u, v in rows if h == g and u < t) for g, t, _ in rows}
    real = spark.createDataFrame([(v,) for v in set(HARD)], "v double")
    got = {r.v: r.s for r in od.running_sum(real, [], "v", F.lit(1), "s").collect()}
    assert got == {v: i for i, v in enumerate(sorted(set(HARD)))}


@pytest.mark.parametrize("n", [1, 2, 7, 400])
def test_exact_quantiles(spark, n):
    rng = np.random.default_rng(n)
    groups = {"a": list(rng.normal(280, 5, n)), None: list(rng.choice(HARD, n)), "ties": [4.25] * n, "wide": list(10.0 ** rng.integers(-300, 300, n))}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("a", None), ("a", float("nan")), ("none", None)]
    ps = [0.0, 0.1, 0.5, 0.999, 1.0]
    got = {(r.g, r.p): r["quantile"] for r in od.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", ps).collect()}
    assert len(got) == 4 * len(ps)
    for (g, p), q in got.items():
        s = sorted(groups[g])
        at = p * (len(s) - 1)
        lo, hi = s[math.floor(at)], s[math.ceil(at)]
        assert q == lo + (hi - lo) * (at - math.floor(at))


def test_monotonicity(spark):
    rng = np.random.default_rng(4)
    rows = [(g, i, None if rng.random() < 0.1 else float(rng.integers(0, 9)), None if rng.random() < 0.1 else float(rng.integers(0, 9))) for g, n in (("a", 300), ("b", 1), (None, 50)) for i in range(n)]
    got = {r.g: r for r in od.monotonicity(spark.createDataFrame(rows, "g string, t long, x double, y double").repartition(5), ["g"], "t", "x", "y").collect()}
    for g in ("a", "b", None):
        own = [(x, y) for h, _, x, y in rows if h == g]
        falls = [max(y0 - y1, 0.0) for (x0, y0), (x1, y1) in itertools.pairwise(own) if None not in (x0, y0, x1, y1) and x1 >= x0]
        assert (got[g].steps, got[g].broken) == (len(falls), sum(f > 0 for f in falls))
        assert got[g].penalty == (pytest.approx(sum(f * f for f in falls) / len(falls)) if falls else None)


def test_nearest(spark):
    rng = np.random.default_rng(8)
    lats, lons = (sorted(set(v.round(3).tolist())) for v in (rng.random(23) ** 3 * 50 - 20, rng.random(31) ** 2 * 90))
    cells = [(i * 100 + j, float(a), float(b)) for i, a in enumerate(lats) for j, b in enumerate(lons) if rng.random() < 0.6]
    places = [(k, float(rng.uniform(-200, 200)), float(rng.uniform(-100, 300))) for k in range(60)] + [(60 + k, (lats[k] + lats[k + 1]) / 2, lons[3]) for k in range(9)]
    places += [(90, None, 3.0), (91, float("nan"), 3.0), (92, lats[0], lons[0]), (92, lats[0], lons[0])]
    c, p = spark.createDataFrame(cells, "cell_id long, lat double, lon double"), spark.createDataFrame(places, "id long, lat double, lon double")
    there = sorted({a for _, a, _ in cells}), sorted({b for _, _, b in cells})
    near = lambda axis, x: min(axis, key=lambda a: (abs(x - a), a))
    sound = [r for r in places if r[1] is not None and not math.isnan(r[1])]
    got = od.nearest_on_axes(p, c).collect()
    assert len(got) == len(places)
    by_place = {(a, b): i for i, a, b in cells}
    for r in got:
        if r.id in (90, 91):
            assert r.cell_lat is None and r.cell_id is None
        else:
            assert (r.cell_lat, r.cell_lon) == (near(there[0], r.lat), near(there[1], r.lon))
            assert r.cell_id == by_place.get((r.cell_lat, r.cell_lon))
    got = {r.id: r for r in od.nearest_existing(p, c, "id").collect()}
    assert set(got) == {r[0] for r in sound}
    for k, lat, lon in sound:
        want = min((math.sqrt((lat - a) * (lat - a) + (lon - b) * (lon - b)), i) for i, a, b in cells)
        assert (got[k].distance, got[k].cell_id) == want
    assert od.nearest_existing(p, c.where("false"), "id").count() == 0
    assert {r.nearest for r in od.nearest_on_axis(p, c.where("false"), "lat", "lat").collect()} == {None}


def test_merged_states_are_those_of_a_whole_pass(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(f"c{i % 5}" if i % 11 else None, i % 3, 1e6 + float(rng.normal()), 1e6 + float(rng.normal(0.3, 2)) if i % 7 else None) for i in range(600)] + [("empty", 0, None, 1.0)]
    df = spark.createDataFrame(rows, "cell_id string, slab int, y_true double, y_pred double")
    path = f"file://{tmp_path}/states"
    with pytest.raises(FileNotFoundError):
        mo.stored(spark, path)
    for slab in (0, 1, 1, 2):
        mo.update(df.where(F.col("slab") == slab), path, str(slab), ["cell_id"])
    names = ("mse", "rmse", "bias", "pbias", "pearson", "nse", "kge", "gamma", "nrmse")
    for keys in (["cell_id"], []):
        got = {tuple(r[k] for k in keys): r for r in mo.scores(mo.merge(mo.stored(spark, path), keys), names, keys).collect()}
        want = {tuple(r[k] for k in keys): r for r in ev.skill(df, keys, names).collect()}
        assert set(got) == set(want)
        for key, r in want.items():
            for name in names:
                assert got[key][name] == (None if r[name] is None else pytest.approx(r[name], rel=1e-6, abs=1e-9)), (key, name)
    fits = {v: mo.statistics(mo.merge(mo.stored(spark, path), []), v).first() for v in ("minmax", "standard")}
    both = [o for _, _, o, p in rows if o is not None and p is not None]
    assert (fits["minmax"].center, fits["minmax"].scale) == (min(both), max(both) - min(both))
    assert fits["standard"].scale == pytest.approx(np.std(both))


def test_user_metric_in_two_phases(spark):
    rng = np.random.default_rng(2)
    rows = [("hot" if i % 3 else (None if i % 2 else "a,\"b\""), i % 2, float(rng.normal()), None if i % 10 == 0 else float(rng.normal(0, 3))) for i in range(500)] + [("none", 0, None, 1.0)]
    df = spark.createDataFrame(rows, "g string, h int, y_true double, y_pred double").repartition(7)
    for keys in (["g"], ["g", "h"], []):
        got = {tuple(r[k] for k in keys): r.value for r in sc.user_metric_merged(df, Huber(1.0), keys).collect()}
        groups = {}
        for g, h, o, p in rows:
            groups.setdefault(tuple({"g": g, "h": h}[k] for k in keys), []).extend([(o, p)] if o is not None and p is not None else [])
        assert set(got) == set(groups)
        for key, own in groups.items():
            e = [abs(p - o) for o, p in own]
            assert got[key] == (pytest.approx(sum(x * x / 2 if x <= 1 else x - 0.5 for x in e) / len(e) / 1e6) if e else None)
    assert sc.user_metric_merged(df.where("false"), Huber(1.0), ["g"]).count() == 0


def test_resampling(spark):
    at = [dt.datetime(2023, 12, 31, 23, 30), dt.datetime(2024, 1, 1, 0, 10), dt.datetime(2024, 1, 1, 7), dt.datetime(2024, 4, 2), dt.datetime(1969, 12, 31, 23)]
    df = spark.createDataFrame([(1, t, float(i)) for i, t in enumerate(at)] + [(None, at[0], 9.0), (1, None, 3.0), (2, at[1], None)], "cell_id int, t timestamp_ntz, v double")
    rows = lambda *a, **k: sorted(((r.cell_id, r.t, r.v) for r in st.resample(df, "v", *a, **k).collect()), key=str)
    hours = {(c, t) for c, t, _ in rows("6 hours", "max")}
    assert hours == {(1, dt.datetime(2023, 12, 31, 18)), (1, dt.datetime(2024, 1, 1)), (1, dt.datetime(2024, 1, 1, 6)), (1, dt.datetime(2024, 4, 2)), (1, dt.datetime(1969, 12, 31, 18)), (None, dt.datetime(2023, 12, 31, 18)), (2, dt.datetime(2024, 1, 1))}
    assert (1, dt.datetime(2024, 4, 1), 3.0) in rows("1 quarter", "mean") and (1, dt.datetime(1969, 12, 1), 4.0) in rows("1 month", "mean")
    assert (1, dt.datetime(2023, 12, 22), 0.0) in rows("10 days", "sum", origin="2024-01-01 00:00:00")
    filled = [r for r in rows("1 year", "count", fill=True) if r[0] == 1]
    assert len(filled) == 2024 - 1969 + 1 and filled[0][2] == 1 and filled[1][2] is None
    with pytest.raises(ValueError):
        rows("3 moons")
    six = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, h), float(h)) for h in range(6)], "cell_id int, t timestamp_ntz, v double")
    assert st.daily(six, "v", unit="hour").count() == 6 and st.daily(six, "v").count() == 1


def test_appends_can_be_repeated(spark, tmp_path):
    path = f"file://{tmp_path}/slabs"
    df = spark.createDataFrame([(c, t, float(c * t)) for c in range(5) for t in range(30)], "cell_id long, t_i int, v double")
    rows = lambda: sorted((r.cell_id, r.t_i, r.v) for r in io.read_time_chunks(spark, path).collect())
    want = lambda n: sorted((r.cell_id, r.t_i, r.v) for r in df.where(F.col("t_i") < n).collect())
    first, second = df.where("t_i < 13"), df.where("t_i >= 13")
    for _ in range(2):
        io.append_time_chunks(first, path, 5)
        assert rows() == want(13)
    half = second.where("t_i < 17").withColumns({"t_chunk": F.expr("t_i div 5").cast("long"), "batch": F.lit("13-29")})
    half.write.mode("append").partitionBy("t_chunk", "batch").parquet(path)  # killed half-way: nothing is committed
    assert rows() == want(13)
    io.append_time_chunks(second, path, 5)
    io.append_time_chunks(second, path, 5)
    assert rows() == want(30)
    assert sum(r.rows for r in io.committed_slabs(spark, path).collect()) == 150
    io.append_time_chunks(second.where("t_i < 20"), path, 5, batch="13-29")  # a batch that shrinks loses its other slabs
    assert rows() == want(20)
    with pytest.raises(Exception, match="without a time step"):
        io.append_time_chunks(df.withColumn("t_i", F.lit(None).cast("int")), path, 5, batch="x")


def test_a_broken_table_is_not_taken_for_an_absent_one(spark, tmp_path):
    (tmp_path / "stats").mkdir()
    (tmp_path / "stats" / "part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):  # noqa: B017
        io.load_or_compute(spark, f"file://{tmp_path}/stats", lambda: pytest.fail("computed"), is_train=True, use_cached=True)


def test_samples_and_ranks_start_no_job(spark):
    keys = spark.range(500).select(F.col("id").alias("cell_id"))
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    sp.sample_keys(keys, "cell_id", 0.3)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before


@pytest.mark.parametrize("slab", [1, 3, 8, 100])
@pytest.mark.parametrize("length", [1, 5, 12])
def test_windows_of_slabs_are_those_of_whole_series(spark, slab, length):
    rng = np.random.default_rng(slab)
    rows = [(c, int(t), float(t * 10 + c)) for c, n in ((1, 30), (2, 5), (3, 12), (4, 13)) for t in np.sort(rng.choice(60, n, replace=False))]
    df = spark.createDataFrame(rows, "cell_id long, t_i int, x double")
    series = sq.cell_series(df, ["x"])
    key = lambda out, at: sorted((r.cell_id, r[at], tuple(r.x)) for r in out.collect())
    for more in (False, True):
        assert key(sq.forward_windows(df, ["x"], length, slab, more), "t0") == key(sq.forward_sequences(series, ["x"], length, more), "t0")
        assert key(sq.trailing_windows(df, ["x"], length, slab, more), "t") == key(sq.trailing_sequences(series, ["x"], length, more), "t")
    assert sq.slab_series(df, ["x"], slab, length).where(F.size("x") > slab + length).count() == 0


def files_read(df):
    df.collect()
    scans = df._jdf.queryExecution().executedPlan().collectLeaves()
    own = [scans.apply(i).metrics() for i in range(scans.size())]
    return sum(m.apply("numFiles").value() for m in own if m.contains("numFiles"))


def test_a_box_opens_only_its_zones(spark, tmp_path):
    df = spark.range(24 * 24 * 24).select((F.col("id") % 24).cast("int").alias("lat_i"), (F.expr("id div 24") % 24).cast("int").alias("lon_i"), F.expr("id div 576").cast("int").alias("t_i"), F.col("id").alias("v"))
    path = f"file://{tmp_path}/blocks"
    bl.write_blocks(df, path, (1, 2, 3), files=16)
    counts = []
    for box in ([(0, 23), (0, 23), (0, 23)], [(3, 9), (5, 20), (0, 11)], [(7, 7), (8, 8), (23, 23)], [(5, 4), (0, 1), (0, 1)], [(-5, 0), (0, 0), (22, 99)], [(40, 90), (0, 9), (0, 9)]):
        got = bl.read_box(spark, path, (1, 2, 3), box)
        want = df
        for axis, (a, b) in zip(bl.AXES, box, strict=True):
            want = want.where(F.col(axis).between(a, b))
        assert sorted(r.v for r in got.collect()) == sorted(r.v for r in want.collect())
        counts.append(files_read(bl.read_box(spark, path, (1, 2, 3), box)))
    assert counts[0] > 3 * counts[1] > 6 * counts[2] and counts[2] <= 2 and counts[3] == 0
    rng = np.random.default_rng(0)
    for _ in range(50):
        ends = [sorted(int(x) for x in rng.integers(0, 5_000, 2)) for _ in range(3)]
        ranges = bl.zone_ranges(ends, (1, 2, 3), 16)
        assert len(ranges) <= 16 * 8
        at = [[int(x) for x in rng.integers(a, b + 1, 20)] for a, b in ends]
        for place in zip(*at, strict=True):
            zone = 0
            for k in reversed(range(18)):
                for x, size in zip(place, (1, 2, 3), strict=True):
                    zone = zone << 1 | (x // size >> bl.ZONE_BITS >> k & 1)
            assert any(a <= zone <= b for a, b in ranges)
    with pytest.raises(Exception, match="outside of the blocks"):
        bl.write_blocks(df.withColumn("lat_i", F.lit(-1)), f"{path}2", (1, 1, 1))


def test_dense_blocks_in_batches(spark):
    rng = np.random.default_rng(1)
    rows = [(b, 0, t, a, o, float(rng.normal()), float(rng.normal())) for b in range(6) for t in range(3) for a in range(2 + b % 2) for o in range(4) if (b, t, a, o) != (2, 1, 1, 1)]
    df = spark.createDataFrame(rows, "s_idx int, k_idx int, t_i int, lat_i int, lon_i int, u double, v double").repartition(5)
    plain = lambda cube: cube[:, 0] - 2 * cube[:, 1] + np.isnan(cube[:, 0]).sum()
    together = lambda cubes: cubes[:, :, 0] - 2 * cubes[:, :, 1] + np.isnan(cubes[:, :, 0]).sum(axis=(1, 2, 3))[:, None, None, None]
    want = sorted((b, k, t, a, o, u - 2 * v + (b == 2)) for b, k, t, a, o, u, v in rows)
    for model, stacked in ((plain, False), (together, True)):
        got = sorted(tuple(r) for r in sc.score_cubelets(df, model, ["u", "v"], stacked=stacked).collect())
        assert [g[:5] for g in got] == [w[:5] for w in want] and np.allclose([g[5] for g in got], [w[5] for w in want])
