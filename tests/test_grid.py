"""Formulas, round trips, degenerate groups, and independence of partitioning."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terracube.functions import metrics as m
from terracube.functions import transforms as tr
from terracube.operators import cubelets as cb
from terracube.operators import evaluate as ev
from terracube.operators import grid as g
from terracube.operators import sampling as sp
from terracube.operators import scoring as sc
from terracube.operators import sequences as sq
from terracube.operators import stats as st
from terracube.operators import uncertainty as un
from terracube.plans import calibration, evaluation, training_samples
from terracube.sources import grids as io
from terracube.sources import scratch


@pytest.fixture(scope="module")
def small(spark):
    """7 x 9 cells, 40 days: gaps, one empty cell, one constant cell, one cell with a single value."""
    rng = np.random.default_rng(4)
    rows = []
    for c in range(63):
        for t in range(40):
            o, p = rng.normal(10, 3), rng.normal(11, 2)
            if c == 5:
                o = None
            if c == 6:
                o = 4.0
            if c == 7 and t:
                o = None
            if rng.random() < 0.05:
                p = None
            rows.append((c, c // 9, c % 9, t, str(np.datetime64("2020-01-01") + t), o, p))
    df = spark.createDataFrame(rows, "cell_id long, lat_i int, lon_i int, t_i int, t string, y_true double, y_pred double")
    return df.withColumn("t", F.to_date("t")).persist()


def numpy_scores(o, p):
    r = np.corrcoef(o, p)[0, 1]
    a, b = p.std(ddof=1) / o.std(ddof=1), p.mean() / o.mean()
    return {
        "mse": ((p - o) ** 2).mean(), "rmse": np.sqrt(((p - o) ** 2).mean()), "bias": (p - o).mean(), "pbias": 100 * (p - o).mean() / np.abs(o).mean(), "pearson": r,
        "nse": 1 - ((p - o) ** 2).sum() / ((o - p.mean()) ** 2).sum(), "kge": 1 - np.sqrt((r - 1) ** 2 + (a - 1) ** 2 + (b - 1) ** 2), "gamma": (p.std() / p.mean()) / (o.std() / o.mean()), "nrmse": np.sqrt(((p - o) ** 2).mean()) / p.mean(),
    }


def test_metrics_against_numpy(small):
    got = ev.skill(small, ["cell_id"]).toPandas().set_index("cell_id")
    pdf = small.toPandas()
    for c in (0, 20, 62):
        x = pdf[pdf.cell_id == c].dropna()
        want = numpy_scores(x.y_true.to_numpy(), x.y_pred.to_numpy())
        for name, value in want.items():
            assert got.loc[c, name] == pytest.approx(value, rel=1e-9), name
    assert got.loc[5].isna().all()
    assert pd.isna(got.loc[6, "kge"]) and pd.isna(got.loc[6, "pearson"])
    assert pd.isna(got.loc[7, "kge"])


def test_identical_series_have_no_error(small):
    df = small.withColumn("y_pred", F.col("y_true"))
    row = df.agg(m.mse(F.col("y_true"), F.col("y_pred")).alias("e"), m.kge(F.col("y_true"), F.col("y_pred")).alias("k"), m.nse(F.col("y_true"), F.col("y_pred")).alias("n")).first()
    assert row.e == 0 and row.k == pytest.approx(1) and row.n == pytest.approx(1)
    masked = df.agg(m.metric("mse", F.col("y_true"), F.col("y_pred"), valid=F.col("t_i") % 2 == 0).alias("e")).first()
    assert masked.e == 0


def test_propagated_gaps(small):
    got = ev.skill(small, ["cell_id"], ("bias",), nulls="propagate").toPandas().set_index("cell_id").bias
    gaps = small.toPandas().groupby("cell_id")[["y_true", "y_pred"]].apply(lambda x: x.isna().any().any())
    assert (got.isna().sort_index() == gaps.sort_index()).all()


def test_scaling_round_trip_and_ranges(small):
    for variant in ("minmax", "standard", "minmax11"):
        stats = st.fit(small, {"y_true": variant, "y_pred": variant})
        there = st.scale(small, stats, ["y_true", "y_pred"])
        x = there.agg(F.min("y_true").alias("lo"), F.max("y_true").alias("hi"), F.avg("y_true").alias("m"), F.stddev_pop("y_true").alias("s")).first()
        assert (x.lo, x.hi) == pytest.approx({"minmax": (0, 1), "minmax11": (-1, 1)}.get(variant, (x.lo, x.hi)))
        if variant == "standard":
            assert (x.m, x.s) == pytest.approx((0, 1), abs=1e-9)
        back = st.unscale(there, stats, ["y_true", "y_pred"]).toPandas().sort_values(["cell_id", "t_i"])
        np.testing.assert_allclose(back.y_true, small.toPandas().sort_values(["cell_id", "t_i"]).y_true)


def test_nan_becomes_null_and_transforms_invert(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.5,)], "x double").withColumn("x", tr.no_nan("x"))
    assert df.agg(F.count("x")).first()[0] == 2
    for kind in tr.TRANSFORMS:
        back = tr.preprocess(tr.preprocess(df, {kind: ["x"]}), {kind: ["x"]}, inverse=True)
        assert [r.x for r in back.collect()] == pytest.approx([1.0, None, None, 3.5])


def test_stats_on_disk(spark, small, tmp_path):
    path = f"file://{tmp_path}/stats"
    with pytest.raises(Exception):  # noqa: B017
        io.load_or_compute(spark, path, lambda: st.fit_minmax(small, ["y_true"]), is_train=False)
    first = io.load_or_compute(spark, path, lambda: st.fit_minmax(small, ["y_true"]), is_train=True).collect()
    other = io.load_or_compute(spark, path, lambda: st.fit_minmax(small.limit(1), ["y_true"]), is_train=False).collect()
    assert first == other


def test_read_write_append(spark, small, tmp_path):
    path = f"file://{tmp_path}/grid"
    io.append_time_chunks(small.where("t_i < 20"), path, 10)
    io.append_time_chunks(small.where("t_i >= 20"), path, 10)
    back = io.read_grid(spark, path, ["y_true", "y_pred"], ["cell_id", "t_i"])
    assert back.count() == small.count() and back.columns == ["cell_id", "t_i", "y_true", "y_pred"]
    io.append_time_chunks(small.where("t_i >= 20"), path, 10)
    assert io.read_time_chunks(spark, path).count() == small.count()
    io.write_grid(small.select("cell_id", "y_true"), f"{path}2", partition_by=["cell_id"])
    assert spark.read.parquet(f"{path}2").count() == small.count()
    cells = io.decode_cells(small.select("cell_id", F.col("lat_i").alias("a"), F.col("lon_i").alias("b")), 9)
    assert cells.where("a <> lat_i or b <> lon_i").count() == 0


@pytest.mark.parametrize("policy", ["all", "any", 0.3])
@pytest.mark.parametrize("keep", [False, True])
def test_tiles_against_loops(spark, policy, keep):
    n_lat, n_lon, xs, ys, xo, yo = 7, 9, 4, 3, 1, 1
    mask = np.zeros((n_lat, n_lon), bool)
    mask[:4, :5] = True
    want, reasons = [], []
    for ix, x in enumerate(range(0, n_lon, xs - xo)):
        for iy, y in enumerate(range(0, n_lat, ys - yo)):
            part = mask[y : y + ys, x : x + xs]
            missing = part.all() if policy == "all" else part.any() if policy == "any" else part.mean() > policy
            if part.shape != (ys, xs) and not keep:
                reasons.append((ix, iy, "degenerate"))
            elif missing:
                reasons.append((ix, iy, "missing"))
            else:
                want.append((len(want), ix, iy))
    df = spark.createDataFrame([(i, j, bool(mask[i, j])) for i in range(n_lat) for j in range(n_lon)], "lat_i int, lon_i int, mask boolean")
    got = cb.spatial_cubelets(spark, n_lat, n_lon, xs, ys, xo, yo, keep, df, policy).collect()
    assert sorted((r.s_idx, r.ix, r.iy) for r in got if r.kept) == want
    assert sorted((r.ix, r.iy, r.reason) for r in got if not r.kept) == reasons


def test_members_against_loops(spark):
    rows = spark.createDataFrame([(a, b, t) for a in range(7) for b in range(9) for t in range(11)], "lat_i int, lon_i int, t_i int")
    space, time = cb.spatial_cubelets(spark, 7, 9, 4, 3, 1, 1), cb.time_cubelets(spark, 11, 4, 2)
    blocks = cb.catalogue(space, time)
    got = cb.members(rows, blocks.select("s_idx", "k_idx", "ix", "iy", "it"), (4, 3, 4), (1, 1, 2), (9, 7, 11))
    want = sum((b.x1 - b.x0) * (b.y1 - b.y0) * (b.t1 - b.t0) for b in blocks.collect())
    assert got.count() == want == got.distinct().count()


def test_sequences(small):
    series = sq.cell_series(small, ["y_pred"])
    ahead = sq.forward_sequences(series, ["y_pred"], 7).where("cell_id = 3").toPandas()
    x = small.where("cell_id = 3").toPandas().sort_values("t_i").y_pred.to_numpy()
    assert sorted(ahead.t0) == list(range(33))
    for t0, y in zip(ahead.t0, ahead.y_pred, strict=True):
        np.testing.assert_array_equal(np.array(y, float), x[t0 : t0 + 7])
    assert sq.forward_sequences(series, ["y_pred"], 7, include_last=True).where("cell_id = 3").count() == 34
    back = sq.trailing_sequences(series, ["y_pred"], 7).where("cell_id = 3").toPandas()
    assert sorted(back.t) == list(range(7, 40))
    for t, y in zip(back.t, back.y_pred, strict=True):
        np.testing.assert_array_equal(np.array(y, float), x[t - 6 : t + 1])


def test_samples_do_not_depend_on_partitions(small):
    parts = [sp.downsample(small.repartition(n), cell_fraction=0.3, time_fraction=0.4, seed=2).select("cell_id", "t_i").toPandas() for n in (1, 7)]
    a, b = (set(map(tuple, p.to_numpy())) for p in parts)
    assert a == b and len({c for c, _ in a}) == 18 and len({t for _, t in a}) == 16
    draws = sp.with_replacement(small.select("t_i", "cell_id"), 0.5, "cell_id", "t_i", 1).groupBy("t_i").count().toPandas()
    assert set(draws["count"]) == {31}


def test_dense_index(spark):
    df = spark.createDataFrame([(x,) for x in (5, 3, 3, 9, None, 100, 7)], "k long")
    assert sorted((r.k, r.i) for r in g.dense_index(df, "k", "i", 3).collect()) == [(3, 0), (5, 1), (7, 2), (9, 3), (100, 4)]


def test_spearman_with_ties(spark):
    df = spark.createDataFrame([(0, float(a), float(b)) for a, b in [(1, 2), (1, 3), (2, 3), (5, 1), (4, 4)]], "cell_id int, y_true double, y_pred double")
    want = np.corrcoef([1.5, 1.5, 3, 5, 4], [2, 3.5, 3.5, 1, 5])[0, 1]
    assert ev.spearman(df, ["cell_id"]).first().spearman == pytest.approx(want)


def test_spaef_against_numpy(small):
    x = small.where("t_i = 3").dropna().toPandas()
    o, p = x.y_true.to_numpy(), x.y_pred.to_numpy()
    h = [np.histogram(v, 100, (v.min(), v.max()))[0] / len(v) for v in (o, p)]
    beta = np.minimum(*h).sum()
    got = ev.spaef(small, ["t_i"]).where("t_i = 3").first()
    assert got.beta == pytest.approx(beta) and got.alpha == pytest.approx(p.std() / o.std())


def test_conformal(small):
    df = small.withColumns({"lower": F.col("y_pred") - 1, "upper": F.col("y_pred") + 1})
    x = df.dropna().toPandas()
    want = np.quantile(np.maximum(x.y_true - x.upper, x.lower - x.y_true), [0.5, 0.9])
    q = un.conformal_q(df, [0.5, 0.9])
    assert [r.q for r in q.orderBy("coverage").collect()] == pytest.approx(list(want))
    cover = un.empirical_coverage(un.conformal_intervals(df, q)).orderBy("coverage").collect()
    assert [r.empirical_coverage for r in cover] == pytest.approx([50, 90], abs=1)


def test_scoring_and_user_metric(small):
    double = lambda x: 2 * x[:, :, :1]
    got = sc.score_series(small.fillna(0.0), double, ["y_pred"])
    assert got.join(small.fillna(0.0), ["cell_id", "t_i"]).where("abs(y_hat - 2 * y_pred) > 1e-9").count() == 0
    med = sc.user_metric(small, lambda o, p: float(len(o)), ["cell_id"]).where("cell_id = 7").first()
    assert med.value <= 1
    none = sc.user_metric(small.withColumn("y_true", F.lit(None).cast("double")), lambda o, p: float(np.median(o)), ["cell_id"])
    assert none.where("value is not null").count() == 0 < none.count()


def test_quantiles_by_sketches(spark):
    df = spark.range(10_001).select((F.col("id") % 2).alias("category"), F.lit(0).alias("t"), F.col("id").cast("double").alias("v"))
    exact = {r.category: r for r in ev.category_quantiles(df, "v").collect()}
    for r in ev.category_quantiles(df, "v", accuracy=1000).collect():
        assert all(abs(r[c] - exact[r.category][c]) <= 10_001 / 1000 + 1 for c in ("p10", "median", "p90"))
        assert (r.vmin, r.vmax) == (exact[r.category].vmin, exact[r.category].vmax)


def test_shared_folder_is_cleared(spark):
    session = spark.newSession()
    path = scratch.new_path(session)
    session.range(3).write.parquet(path)
    assert session.read.parquet(path).count() == 3
    folder = scratch.shared_folder(session).removeprefix("file://")
    scratch.clear(session)
    assert not os.path.exists(f"{folder}/{session.sparkContext.applicationId}")


def test_jobs(spark, small, tmp_path):
    static = small.select("cell_id", "lat_i", "lon_i").distinct().withColumn("lake", F.col("cell_id") == 2)
    cfg = training_samples.SampleConfig(["y_pred"], ["lat_i"], ["y_true"], ["lake"], ("2020-01-01", "2020-02-09"), 5, {"y_pred": "standard"}, {"lat_i": "minmax"}, cell_fraction=0.5, start_fraction=0.2, stats_path=f"file://{tmp_path}/s")
    out = training_samples.run(small, static, cfg)
    assert out.count() == 31 * 7 and {len(r.xd) for r in out.collect()} == {5}
    maps, table = evaluation.run(small.select("cell_id", "t", "y_true"), small.select("cell_id", "t", "y_pred"), g.combine_masks(static, ["lake"]))
    assert maps.count() == 63 and table.count() == 6
    obs = small.select("cell_id", "t", F.col("y_true").alias("v"))
    cal = calibration.run(small, small.select("cell_id", "t", F.col("y_pred").alias("v")), obs, static, "v", ("2020-01-01", "2020-01-31"), ["y_pred"], ["lat_i"], 5)
    assert cal.count() == 61


def test_statistics_are_computed_when_nothing_is_kept(spark, tmp_path):
    from terracube.operators import stats as st
    from terracube.sources import grids as io

    path = f"file://{tmp_path}/stats"
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    first = io.load_or_compute(spark, path, lambda: st.fit_minmax(df, ["x"]), is_train=True, use_cached=True).first()
    assert (first.center, first.scale) == (1.0, 2.0)
    other = spark.createDataFrame([(7.0,), (9.0,)], "x double")
    for train in (True, False):
        kept = io.load_or_compute(spark, path, lambda: st.fit_minmax(other, ["x"]), is_train=train, use_cached=True).first()
        assert (kept.center, kept.scale) == (1.0, 2.0)


def test_overlap_of_flat_slices(spark):
    from terracube.operators import evaluate as ev

    rows = [("one", 127.11, 50.17), ("flat", 3.3, 1.0), ("flat", 3.3, 2.0), ("both", 0.1, 7.7), ("both", 0.1, 7.7)]
    got = {r.t: r.beta for r in ev.spaef(spark.createDataFrame(rows, "t string, y_true double, y_pred double"), ["t"]).collect()}
    assert got == {"one": 1.0, "flat": 0.0, "both": 1.0}


def test_running_sums_and_samples_at_any_partitioning(spark):
    from pyspark.sql import functions as F

    from terracube.operators import sampling as sp
    from terracube.operators.ordered import running_sum

    rows = [(g, k, (k * 7) % 5) for g, n in (("a", 200), ("b", 3), ("c", 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, k long, x long").repartition(6)
    for groups in (["g"], []):
        data = df if groups else df.where("g = 'a'")
        got = {(r.g, r.k): r.s for r in running_sum(data, groups, "k", F.col("x"), "s").collect()}
        assert all(got[g, k] == sum(x for h, j, x in rows if h == g and j < k) for g, k in got) and len(got) == data.count()
    keys = spark.range(5000).select(F.col("id").alias("cell_id"))
    every = sorted(keys.collect(), key=lambda r: (((h := (r.cell_id + 3 * 7919) * 48271 % sp.PRIME) * (h + 12345)) % sp.PRIME, r.cell_id))
    for n in (0, 1, 777, 5000, 9000):
        assert {r.cell_id for r in sp.sample_keys(keys, "cell_id", count=n, seed=3).collect()} == {r.cell_id for r in every[:n]}
