"""Registered queries on the driver's tables, and the DuckDB SQL that gives the same rows.

The tables stand in for a grid: order lines are pairs of truth and prediction at a cell (supplier) and day, events are a dynamic grid
of five variables, suppliers and parts are static grids, embeddings are ensemble members over 64 steps.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terracube.functions import metrics as m
from terracube.functions import transforms as tr
from terracube.operators import cubelets as cb
from terracube.operators import evaluate as ev
from terracube.operators import grid as g
from terracube.operators import moments as mo
from terracube.operators import ordered as od
from terracube.operators import sampling as sp
from terracube.operators import scoring as sc
from terracube.operators import sequences as sq
from terracube.operators import stats as st
from terracube.operators import uncertainty as un
from terracube.plans import evaluation
from terracube.sources import blocks as bl
from terracube.sources import grids as io
from terracube.sources.scratch import new_path, stash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
VARIABLES = ("click", "error", "purchase", "signup", "view")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(x: Column | str, n: int = 4) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, n)


def rounded(df: DataFrame, n: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded, whole numbers as long."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f.name)
        out.append((F.round(c, n) if kind == "double" else c.cast("long") if kind in ("integer", "short", "byte") else c).alias(f.name))
    return df.select(*out)


# -- stand-ins ---------------------------------------------------------------------------------


def pairs(spark, d) -> DataFrame:
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    part = table(spark, d, "part").select("p_partkey", "p_retailprice", "p_brand")
    both = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return both.select(F.col("l_suppkey").alias("cell_id"), F.to_date("l_shipdate").alias("t"), "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice")).alias("y_true"), (F.col("l_quantity") * F.col("p_retailprice")).alias("y_pred"), F.col("p_brand").alias("category"))


PAIRS = """pairs AS (
  SELECT l_suppkey AS cell_id, CAST(l_shipdate AS DATE) AS t, l_orderkey, l_linenumber,
         CASE WHEN l_linenumber <> 7 THEN l_extendedprice END AS y_true, l_quantity * p_retailprice AS y_pred, p_brand AS category
  FROM lineitem JOIN part ON l_partkey = p_partkey),
ok AS (SELECT *, y_true AS o, y_pred AS p FROM pairs WHERE y_true IS NOT NULL AND y_pred IS NOT NULL)"""


def grid(spark, d) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "ts", "event_type", "value")
    means = [F.avg(F.when(F.col("event_type") == v, F.col("value"))).alias(v) for v in VARIABLES]
    return e.groupBy(F.col("user_id").alias("cell_id"), F.to_date("ts").alias("t")).agg(*means)


def indexed(spark, d) -> DataFrame:
    """The grid with the number of each day and the row and column of each cell."""
    df = grid(spark, d)
    days = g.time_index(df)
    return df.join(F.broadcast(days), "t").withColumns({"lat_i": F.expr("cell_id div 10").cast("int"), "lon_i": F.expr("cell_id % 10").cast("int"), "t_i": F.col("t_i").cast("int")})  # one row a day


def n_days(spark, d) -> int:
    return g.time_index(grid(spark, d)).count()


_MEANS = ", ".join(f"avg(CASE WHEN event_type = '{v}' THEN value END) AS {v}" for v in VARIABLES)
GRID = f"""grid AS (SELECT user_id AS cell_id, CAST(ts AS DATE) AS t, {_MEANS} FROM events GROUP BY 1, 2),
days AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS t_i FROM (SELECT DISTINCT t FROM grid)),
gi AS (SELECT grid.*, CAST(t_i AS BIGINT) AS t_i, cell_id // 10 AS lat_i, cell_id % 10 AS lon_i FROM grid JOIN days USING (t))"""

HASH = lambda key, seed: f"((({key}) + {seed} * 7919) * 48271 % 2147483647) * (((({key}) + {seed} * 7919) * 48271 % 2147483647) + 12345) % 2147483647"

R = "covar_pop(o, p) / nullif(stddev_pop(o) * stddev_pop(p), 0)"
ALPHA, BETA = "stddev_samp(p) / nullif(stddev_samp(o), 0)", "avg(p) / nullif(avg(o), 0)"
KGE = f"1 - sqrt(pow({R} - 1, 2) + pow({ALPHA} - 1, 2) + pow({BETA} - 1, 2))"
NSE = "1 - avg((p - o) * (p - o)) / nullif(var_pop(o) + pow(avg(o) - avg(p), 2), 0)"
GAMMA = "(stddev_pop(p) / nullif(avg(p), 0)) / nullif(stddev_pop(o) / nullif(avg(o), 0), 0)"
FORMULAS = {"rmse": "sqrt(avg((p - o) * (p - o)))", "bias": "avg(p - o)", "pbias": "100 * avg(p - o) / nullif(avg(abs(o)), 0)", "pearson": R, "nse": NSE, "kge": KGE, "gamma": GAMMA, "nrmse": "sqrt(avg((p - o) * (p - o))) / nullif(avg(p), 0)"}


def _list(names, n=4) -> str:
    return ", ".join(f"round({FORMULAS[x]}, {n}) AS {x}" for x in names)


MAPS = ("rmse", "bias", "pbias", "pearson", "nse", "kge", "gamma")

# -- skill -------------------------------------------------------------------------------------


@query(f"WITH {PAIRS} SELECT cell_id, {_list(MAPS)} FROM ok GROUP BY cell_id")
def cell_skill(spark, d):
    return rounded(ev.skill(pairs(spark, d), ["cell_id"], MAPS))


@query(f"""WITH {PAIRS}, c AS (SELECT cell_id, {', '.join(f'{FORMULAS[x]} AS {x}' for x in MAPS)} FROM ok GROUP BY cell_id)
{' UNION ALL '.join(f"SELECT '{x}' AS metric, round(avg({x}), 4) AS mean, round(stddev_pop({x}), 4) AS std FROM c" for x in MAPS)}""")
def global_skill(spark, d):
    return rounded(ev.global_table(ev.skill(pairs(spark, d), ["cell_id"], MAPS), MAPS))


@query(f"WITH {PAIRS} SELECT category, {_list(('rmse', 'pearson', 'nse', 'kge'))} FROM ok GROUP BY category")
def skill_by_category(spark, d):
    return rounded(ev.skill(pairs(spark, d), ["category"], ("rmse", "pearson", "nse", "kge")))


@query(f"""WITH {GRID}, l AS (
  SELECT 'view' AS target, "view" AS o, signup AS p FROM grid WHERE error IS NOT NULL UNION ALL SELECT 'click', click, purchase FROM grid),
ok AS (SELECT * FROM l WHERE o IS NOT NULL AND p IS NOT NULL),
s AS (SELECT target, {_list(('rmse', 'pearson', 'nse', 'kge'), 6)} FROM ok GROUP BY target)
UNPIVOT s ON rmse, pearson, nse, kge INTO NAME metric VALUE value""")
def metric_collection(spark, d):
    df = grid(spark, d).withColumn("has_error", F.col("error").isNotNull())
    return rounded(ev.metric_collection(df, {"view": ("view", "signup"), "click": ("click", "purchase")}, ("rmse", "pearson", "nse", "kge"), valid={"view": "has_error"}), 6)


@query(f"WITH {PAIRS} SELECT cell_id, round({R}, 6) AS r, round({ALPHA}, 6) AS alpha, round({BETA}, 6) AS beta, round({KGE}, 6) AS kge FROM ok GROUP BY cell_id")
def kge_components(spark, d):
    o, p = F.col("y_true"), F.col("y_pred")
    return rounded(pairs(spark, d).groupBy("cell_id").agg(*[c.alias(n) for n, c in m.kge_parts(o, p).items()], m.kge(o, p).alias("kge")), 6)


@query(f"""WITH {PAIRS}, s AS (SELECT *, avg(p) OVER (PARTITION BY cell_id) AS mp, avg(o) OVER (PARTITION BY cell_id) AS mo FROM ok)
SELECT cell_id, round(1 - sum(pow(p - o, 2)) / nullif(sum(pow(o - mp, 2)), 0), 6) AS nse_pred, round(1 - sum(pow(p - o, 2)) / nullif(sum(pow(o - mo, 2)), 0), 6) AS nse_obs FROM s GROUP BY cell_id""")
def nse_pred_mean(spark, d):
    o, p = F.col("y_true"), F.col("y_pred")
    return rounded(pairs(spark, d).groupBy("cell_id").agg(m.nse(o, p).alias("nse_pred"), m.nse(o, p, "obs").alias("nse_obs")), 6)


@query(f"WITH {PAIRS} SELECT {_list(('rmse', 'bias', 'pbias', 'pearson', 'nse', 'kge', 'gamma', 'nrmse'))}, round(avg((p - o) * (p - o)) / 1000000, 6) AS mse_millions FROM ok")
def pooled_skill(spark, d):
    names = ("rmse", "bias", "pbias", "pearson", "nse", "kge", "gamma", "nrmse")
    df = pairs(spark, d)
    o, p = F.col("y_true"), F.col("y_pred")
    return df.agg(*[r(m.METRICS[n](o, p)).alias(n) for n in names], r(m.mse(o, p) / 1000000, 6).alias("mse_millions"))


for _name, _metric in (("pbias_map", "pbias"), ("gamma_map", "gamma"), ("nrmse", "nrmse"), ("bias_map", "bias"), ("rmse_map", "rmse"), ("pearson_map", "pearson")):

    def _one(spark, d, _metric=_metric):
        return rounded(ev.skill(pairs(spark, d), ["cell_id"], (_metric,)))

    QUERIES[_name] = _one
    SQL[_name] = f"WITH {PAIRS} SELECT cell_id, {_list((_metric,))} FROM ok GROUP BY cell_id"


@query(f"WITH {PAIRS} SELECT cell_id, CASE WHEN bool_or(y_true IS NULL OR y_pred IS NULL) THEN NULL ELSE round(avg(y_pred - y_true), 4) END AS bias FROM pairs GROUP BY cell_id")
def bias_propagate(spark, d):
    return rounded(ev.skill(pairs(spark, d), ["cell_id"], ("bias",), nulls="propagate"))


@query(f"WITH {GRID} SELECT cell_id, round(var_pop(\"view\"), 4) AS variance, round(stddev_pop(\"view\"), 4) AS std FROM grid GROUP BY cell_id")
def variance_map(spark, d):
    return grid(spark, d).groupBy("cell_id").agg(r(m.variance(F.col("view"))).alias("variance"), r(m.variance(F.col("view"), std=True)).alias("std"))


@query(f"""WITH {PAIRS}, k AS (SELECT cell_id,
  rank() OVER (PARTITION BY cell_id ORDER BY o) + (count(*) OVER (PARTITION BY cell_id, o) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY cell_id ORDER BY p) + (count(*) OVER (PARTITION BY cell_id, p) - 1) / 2.0 AS b FROM ok)
SELECT cell_id, round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 6) AS spearman FROM k GROUP BY cell_id""")
def spearman_by_cell(spark, d):
    return rounded(ev.spearman(pairs(spark, d), ["cell_id"]), 6)


def _spaef_sql(unit: bool, keys: str, source: str) -> str:
    if unit:
        bin_ = lambda c: f"CASE WHEN {c} BETWEEN 0 AND 1 THEN least(floor({c} * 100), 99) END"
    else:
        bin_ = lambda c: f"CASE WHEN lo_{c} = hi_{c} THEN 50 ELSE least(floor(({c} - lo_{c}) / (hi_{c} - lo_{c}) * 100), 99) END"
    return f"""{source},
s AS (SELECT {keys}, {R} AS r, {ALPHA} AS alpha, min(o) AS lo_o, max(o) AS hi_o, min(p) AS lo_p, max(p) AS hi_p FROM ok GROUP BY {keys}),
b AS (SELECT {keys}, {bin_('o')} AS bo, {bin_('p')} AS bp FROM ok JOIN s USING ({keys})),
ho AS (SELECT {keys}, bo AS bin, count(*) AS n FROM b WHERE bo IS NOT NULL GROUP BY ALL),
hp AS (SELECT {keys}, bp AS bin, count(*) AS n FROM b WHERE bp IS NOT NULL GROUP BY ALL),
tot AS (SELECT {keys}, count(bo) AS t_o, count(bp) AS t_p FROM b GROUP BY {keys}),
ov AS (SELECT {keys}, sum(least(ho.n / t_o, hp.n / t_p)) AS beta FROM ho JOIN hp USING ({keys}, bin) JOIN tot USING ({keys}) GROUP BY {keys}),
f AS (SELECT {keys}, r, alpha, CASE WHEN t_o > 0 AND t_p > 0 THEN coalesce(beta, 0) END AS beta FROM s JOIN tot USING ({keys}) LEFT JOIN ov USING ({keys})),
spaef AS (SELECT *, 1 - sqrt(pow(r - 1, 2) + pow(alpha - 1, 2) + pow(beta - 1, 2)) AS spaef FROM f)"""


_GRID_OK = f'WITH {GRID}, ok AS (SELECT *, "view" AS o, signup AS p FROM grid WHERE "view" IS NOT NULL AND signup IS NOT NULL)'
_ROUND4 = "round(r, 4) AS r, round(alpha, 4) AS alpha, round(beta, 4) AS beta, round(spaef, 4) AS spaef"


@query(_spaef_sql(False, "t", _GRID_OK) + f" SELECT t, {_ROUND4} FROM spaef")
def spaef_by_time(spark, d):
    return rounded(ev.spaef(grid(spark, d), ["t"], "view", "signup"))


_UNIT_OK = f'WITH {GRID}, ok AS (SELECT *, "view" / 100 AS o, signup / 100 AS p FROM grid WHERE "view" IS NOT NULL AND signup IS NOT NULL)'


@query(_spaef_sql(True, "t", _UNIT_OK) + f" SELECT t, {_ROUND4} FROM spaef")
def spaef_unit_range(spark, d):
    df = grid(spark, d).withColumns({"view": F.col("view") / 100, "signup": F.col("signup") / 100})
    return rounded(ev.spaef(df, ["t"], "view", "signup", unit_range=True))


@query(_spaef_sql(False, "t", _GRID_OK) + " SELECT round(avg(spaef), 4) AS mean, round(quantile_disc(spaef, 0.5), 4) AS median, round(quantile_cont(spaef, 0.9), 4) AS p90 FROM spaef")
def spaef_aggregate(spark, d):
    s = ev.spaef(grid(spark, d), ["t"], "view", "signup").select("spaef")
    return s.agg(r(F.avg("spaef")).alias("mean"), r(F.expr("percentile_disc(0.5) within group (order by spaef)")).alias("median"), r(F.percentile("spaef", 0.9)).alias("p90"))


@query(f"WITH {PAIRS}, w AS (SELECT *, CASE WHEN o > 30000 THEN 1.0 ELSE 0.5 END AS w FROM ok) SELECT category, round(sum(w * pow(p - o, 2)) / sum(w) / 1000000, 6) AS mse_millions, round(sqrt(sum(w * pow(p - o, 2)) / sum(w)), 4) AS rmse FROM w GROUP BY category")
def weighted_mse(spark, d):
    e = m.bimodal_mse(F.col("y_true"), F.col("y_pred"), 30000)
    return pairs(spark, d).groupBy("category").agg(r(e / 1000000, 6).alias("mse_millions"), r(F.sqrt(e)).alias("rmse"))


@query(f"WITH {PAIRS} SELECT category, round(avg(greatest(0.1 * (o - p), -0.9 * (o - p))), 4) AS tau10, round(avg(greatest(0.9 * (o - p), -0.1 * (o - p))), 4) AS tau90 FROM ok GROUP BY category")
def pinball(spark, d):
    o, p = F.col("y_true"), F.col("y_pred")
    return pairs(spark, d).groupBy("category").agg(r(m.pinball(o, p, 0.1)).alias("tau10"), r(m.pinball(o, p, 0.9)).alias("tau90"))


@query(f'WITH {GRID} SELECT cell_id, round(avg(CASE WHEN purchase > 0 THEN ln(purchase) + 0.5 * ln(2 * pi()) + pow("view" - signup, 2) / (2 * purchase * purchase) END), 4) AS nll FROM grid GROUP BY cell_id')
def gauss_nll(spark, d):
    return grid(spark, d).groupBy("cell_id").agg(r(m.gauss_nll(F.col("view"), F.col("signup"), F.col("purchase"))).alias("nll"))


@query(f"""WITH {PAIRS} SELECT cell_id, round(1 - sqrt(pow(count(*) * covar_pop(o, p) / sqrt(count(*) * var_pop(o) * count(*) * var_pop(p) + 1e-8) - 1, 2)
  + pow(stddev_samp(p) / (stddev_samp(o) + 1e-8) - 1, 2) + pow(avg(p) / (avg(o) + 1e-8) - 1, 2)), 6) AS kge FROM ok GROUP BY cell_id""")
def kge_eps(spark, d):
    return pairs(spark, d).groupBy("cell_id").agg(r(m.kge_eps(F.col("y_true"), F.col("y_pred")), 6).alias("kge"))


@query(f"""WITH {GRID} SELECT round(avg(pow(signup - "view", 2)) FILTER (WHERE error IS NOT NULL) * avg(CAST(error IS NOT NULL AS INT)) * 0.75 + avg(pow(purchase - click, 2)) * 0.25, 4) AS score FROM grid""")
def multi_target_score(spark, d):
    df = grid(spark, d).withColumn("has_error", F.col("error").isNotNull())
    return rounded(ev.weighted_score(df, {"view": ("view", "signup"), "click": ("click", "purchase")}, m.mse, {"view": 0.75, "click": 0.25}, {"view": "has_error"}))


@query("""SELECT 'p_size' AS parameter, round(avg(greatest(p_size - 40, 0) + greatest(5 - p_size, 0)) / 2.0, 6) AS penalty FROM part
UNION ALL SELECT 'p_retailprice', round(avg(greatest(p_retailprice - 1500, 0) + greatest(950 - p_retailprice, 0)) / 2.0, 6) FROM part""")
def range_penalty(spark, d):
    return rounded(ev.range_penalties(table(spark, d, "part"), {"p_size": (5, 40), "p_retailprice": (950, 1500)}), 6)


@query(f"""WITH {GRID} SELECT 'view >= signup' AS rule, CAST(count(*) FILTER (WHERE NOT "view" >= signup) AS BIGINT) AS broken, round(coalesce(avg(abs("view" - signup)) FILTER (WHERE NOT "view" >= signup), 0), 4) AS violation FROM grid
UNION ALL SELECT 'click < error', count(*) FILTER (WHERE NOT click < error), round(coalesce(avg(abs(click - error)) FILTER (WHERE NOT click < error), 0), 4) FROM grid""")
def constraint_audit(spark, d):
    return rounded(ev.constraint_audit(grid(spark, d), [("view", ">=", "signup"), ("click", "<", "error")]))


# -- statistics and transforms -----------------------------------------------------------------


def _fit_sql(kind: str, names) -> str:
    c, s = {"minmax": ("min({0})", "max({0}) - min({0})"), "standard": ("avg({0})", "stddev_pop({0})")}[kind]
    return " UNION ALL ".join(f"""SELECT 'dynamic' AS group_type, '{v}' AS variable, '{kind}' AS variant, round({c.format('"' + v + '"')}, 4) AS center, round({s.format('"' + v + '"')}, 4) AS scale FROM grid""" for v in names)


@query(f"WITH {GRID} {_fit_sql('minmax', VARIABLES)}")
def fit_minmax(spark, d):
    return rounded(st.fit_minmax(grid(spark, d), VARIABLES))


@query(f"WITH {GRID} {_fit_sql('standard', VARIABLES)}")
def fit_standard(spark, d):
    return rounded(st.fit_standard(grid(spark, d), VARIABLES))


@query(f"WITH {GRID} {_fit_sql('minmax', ('click', 'error'))} UNION ALL {_fit_sql('standard', ('view', 'signup'))}")
def fit_mixed(spark, d):
    return rounded(st.fit(grid(spark, d), {"click": "minmax", "error": "minmax", "view": "standard", "signup": "standard"}))


@query(f"""WITH {GRID}, s AS (SELECT min(click) AS c, max(click) - min(click) AS w, avg("view") AS mv, stddev_pop("view") AS sv FROM grid)
SELECT cell_id, t, round(2 * (click - c) / nullif(w, 0) - 1, 6) AS click, round(("view" - mv) / nullif(sv, 0), 6) AS "view" FROM grid, s""")
def scale_minmax11(spark, d):
    df = grid(spark, d)
    stats = st.fit(df, {"click": "minmax11", "view": "standard"})
    return rounded(st.scale(df, stats, ["click", "view"]).select("cell_id", "t", "click", "view"), 6)


@query(f'WITH {GRID} SELECT cell_id, t, round(click, 6) AS click, round("view", 6) AS "view", round(error, 6) AS error FROM grid')
def unscale_roundtrip(spark, d):
    df = grid(spark, d)
    names = ["click", "view", "error"]
    stats = st.fit(df, {"click": "minmax11", "view": "standard", "error": "minmax"})
    return rounded(st.unscale(st.scale(df, stats, names), stats, names).select("cell_id", "t", *names), 6)


@query("SELECT p_partkey, round((p_size - 1) / 49.0, 6) AS p_size, round((p_retailprice - 900) / 1200.0, 6) AS p_retailprice FROM part")
def bounded_scale(spark, d):
    return rounded(st.bounded_scale(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), {"p_size": (1, 50), "p_retailprice": (900, 2100)}, ["p_size", "p_retailprice"]), 6)


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(ln(l_quantity + 1), 6) AS logged, round(l_quantity, 6) AS back FROM lineitem")
def log1p_roundtrip(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("logged"))
    there = tr.preprocess(df, {"log1p": ["logged"]})
    return rounded(there.withColumn("back", tr.exp_minus1(F.col("logged"))), 6)


@query(f'WITH {GRID} SELECT cell_id, t, round(log10(click + 1), 6) AS click, round(pow(10, log10("view" + 1)) - 1, 6) AS "view" FROM grid')
def log10p(spark, d):
    df = tr.preprocess(grid(spark, d), {"log10p": ["click", "view"]})
    return rounded(df.select("cell_id", "t", "click", tr.pow10_minus1(F.col("view")).alias("view")), 6)


@query("SELECT p_partkey, round(1 + 9 / (1 + exp(-(p_size - 25) / 10.0)), 6) AS parameter FROM part")
def sigmoid_parameters(spark, d):
    return rounded(table(spark, d, "part").select("p_partkey", tr.sigmoid_range((F.col("p_size") - 25) / 10.0, 1, 10).alias("parameter")), 6)


# -- masks, cells, reshaping -------------------------------------------------------------------


def static(spark, d) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell_id"), "s_acctbal", "s_nationkey")
    return s.withColumns({"mask_low": F.col("s_acctbal") < 0, "mask_lake": F.pmod("s_nationkey", F.lit(7)) == 0})


STATIC = "static AS (SELECT s_suppkey AS cell_id, s_acctbal, s_nationkey, s_acctbal < 0 AS mask_low, s_nationkey % 7 = 0 AS mask_lake FROM supplier)"


@query(f"WITH {STATIC} SELECT cell_id, mask_low OR mask_lake AS mask FROM static")
def combine_masks(spark, d):
    return g.combine_masks(static(spark, d), ["mask_low", "mask_lake"]).select("cell_id", "mask")


@query(f"WITH {STATIC} SELECT cell_id, CAST(row_number() OVER (ORDER BY cell_id) - 1 AS BIGINT) AS cell_index FROM static WHERE NOT (mask_low OR mask_lake)")
def valid_cells_index(spark, d):
    return g.cell_linear_index(g.combine_masks(static(spark, d), ["mask_low", "mask_lake"]))


@query(f"""WITH {GRID}, days2 AS (SELECT cell_id, t, max(purchase) AS p FROM grid GROUP BY 1, 2)
SELECT cell_id, CAST(count(*) FILTER (WHERE p IS NULL) AS BIGINT) AS gaps, CAST(count(p) AS BIGINT) AS "valid", count(*) FILTER (WHERE p IS NULL) > 10 AS mask FROM days2 GROUP BY 1""")
def target_mask_min_samples(spark, d):
    return rounded(st.target_mask_min_samples(grid(spark, d), "purchase", 10))


@query(f"WITH {GRID} SELECT cell_id, count(error) = 0 AS mask FROM grid GROUP BY 1")
def target_mask_all(spark, d):
    return st.target_mask_all(grid(spark, d), "error")


@query(f"WITH {GRID} SELECT cell_id, t, round(click, 4) AS click FROM grid WHERE t IN (SELECT DISTINCT t FROM grid WHERE error > 60)")
def time_aligned_dynamics(spark, d):
    df = grid(spark, d)
    return rounded(g.on_times_of(df, df.where("error > 60")).select("cell_id", "t", "click"))


@query(f"WITH {PAIRS}, {STATIC} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN NOT (mask_low OR mask_lake) THEN round(y_true, 4) END AS y_true, CASE WHEN NOT (mask_low OR mask_lake) THEN round(y_pred, 4) END AS y_pred FROM pairs JOIN static USING (cell_id)")
def masked_predictions(spark, d):
    masks = g.combine_masks(static(spark, d), ["mask_low", "mask_lake"])
    return rounded(g.mask_values(pairs(spark, d), masks, ["y_true", "y_pred"]).select("l_orderkey", "l_linenumber", "y_true", "y_pred"))


@query(f"WITH {GRID} SELECT cell_id, t, click IS NULL OR error IS NULL AS missing FROM grid")
def missing_cells(spark, d):
    return g.missing_cells(grid(spark, d), ["click", "error"]).select("cell_id", "t", "missing")


@query(f"WITH {GRID}, c AS (SELECT DISTINCT cell_id FROM grid), v AS (SELECT cell_id, t, click FROM grid WHERE click > 50) SELECT cell_id, t, round(click, 4) AS click FROM c CROSS JOIN days LEFT JOIN v USING (cell_id, t)")
def reconstruct_missing(spark, d):
    df = grid(spark, d)
    cells = g.complete_grid(df.select("cell_id", "t"), df, df).select("cell_id", "t")
    return rounded(g.reconstruct_missing(df.where("click > 50").select("cell_id", "t", "click"), cells, ["cell_id", "t"]))


@query(f"WITH {GRID} SELECT cell_id, t, round(coalesce(click, 0), 4) AS click, round(coalesce(\"view\", 0), 4) AS \"view\" FROM (SELECT DISTINCT cell_id FROM grid) CROSS JOIN days LEFT JOIN grid USING (cell_id, t)")
def complete_and_fill(spark, d):
    df = grid(spark, d).select("cell_id", "t", "click", "view")
    return rounded(g.fill_missing(g.complete_grid(df, df, df), 0.0, ["click", "view"]))


@query("SELECT p_partkey, CASE WHEN p_size >= 40 THEN 3.0 WHEN p_size >= 20 THEN 2.0 WHEN p_size >= 10 THEN 1.0 WHEN p_size >= 5 THEN 0.0 ELSE p_size END AS class FROM part")
def reclass(spark, d):
    return table(spark, d, "part").select("p_partkey", tr.reclass(F.col("p_size"), [5, 10, 20, 40]).alias("class"))


@query(f"WITH {GRID} SELECT DISTINCT cell_id, lat_i, lon_i, CAST(lat_i * 10 + lon_i AS BIGINT) AS linear FROM gi")
def grid_index(spark, d):
    df = indexed(spark, d)
    return rounded(df.select("cell_id", "lat_i", "lon_i", g.grid_index(F.col("lat_i"), F.col("lon_i"), 10).alias("linear")).distinct())


@query(f"WITH {GRID} SELECT t, CAST(t_i AS BIGINT) AS t_i FROM days")
def time_index(spark, d):
    return g.time_index(grid(spark, d))


@query(f"""WITH {GRID}, {STATIC}, c AS (SELECT row_number() OVER (ORDER BY cell_id) - 1 AS cell_index FROM static WHERE NOT (mask_low OR mask_lake)), nd AS (SELECT count(*) AS nd FROM days)
SELECT CAST(cell_index AS BIGINT) AS cell_index, CAST(t0 AS BIGINT) AS t0, CAST(t0 + cell_index * nd AS BIGINT) AS flat_id FROM c, nd, range(0, nd - 7) x(t0)""")
def spacetime_index(spark, d):
    cells = g.cell_linear_index(g.combine_masks(static(spark, d), ["mask_low", "mask_lake"]))
    n = n_days(spark, d)
    return rounded(g.flat_time_ids(g.spacetime_index(cells, n, 7), n))


@query(f'WITH {GRID} SELECT cell_id, t, feat, round(v, 4) AS v FROM (SELECT cell_id, t, unnest([{", ".join(repr(v) for v in VARIABLES)}]) AS feat, unnest([click, error, purchase, signup, "view"]) AS v FROM grid)')
def stack_features(spark, d):
    return rounded(g.stack_features(grid(spark, d), VARIABLES))


@query(f'WITH {GRID} SELECT cell_id, t, {", ".join(f"""round("{v}", 4) AS "{v}" """ for v in VARIABLES)} FROM grid')
def spread_features(spark, d):
    return rounded(g.spread_features(g.stack_features(grid(spark, d), VARIABLES), VARIABLES))


@query(f'WITH {GRID} SELECT cell_id, t, round(coalesce(click, 0) + coalesce(error, 0) + coalesce("view", 0), 4) AS total, CAST(3 AS BIGINT) AS n FROM grid')
def feature_vectors(spark, d):
    df = g.feature_vectors(grid(spark, d), ["click", "error", "view"])
    return df.select("cell_id", "t", r(F.aggregate("x", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))).alias("total"), F.size("x").cast("long").alias("n"))


@query(f"WITH {PAIRS}, {STATIC} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(y_pred, 4) AS x1, round(s_acctbal, 4) AS x2, CAST(s_nationkey AS DOUBLE) AS x3 FROM pairs JOIN static USING (cell_id)")
def static_to_dynamic(spark, d):
    dyn = g.feature_vectors(pairs(spark, d), ["y_pred"], "xd")
    both = g.static_to_dynamic(dyn, g.feature_vectors(static(spark, d), ["s_acctbal", "s_nationkey"], "xs"))
    return both.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), *[r(F.col("x")[i]).alias(f"x{i + 1}") for i in range(3)])


_POINTS = "points AS (SELECT c_custkey, c_custkey % 97 * 0.37 AS lat, c_custkey % 89 * 0.41 AS lon FROM customer), cells AS (SELECT p_partkey AS cell_id, CAST((p_partkey - 1) // 40 AS DOUBLE) AS lat, CAST((p_partkey - 1) % 40 AS DOUBLE) AS lon FROM part)"


def _cells(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("cell_id"), F.expr("(p_partkey - 1) div 40").cast("double").alias("lat"), F.expr("(p_partkey - 1) % 40").cast("double").alias("lon"))


@query(f"WITH {_POINTS} SELECT c_custkey, cell_id FROM points JOIN cells ON cells.lat = floor(points.lat + 0.5) AND cells.lon = floor(points.lon + 0.5)")
def nearest_cell(spark, d):
    points = table(spark, d, "customer").select("c_custkey", (F.pmod("c_custkey", F.lit(97)) * F.lit(0.37)).alias("lat"), (F.pmod("c_custkey", F.lit(89)) * F.lit(0.41)).alias("lon"))
    return g.nearest_cell(points, _cells(spark, d), 1.0, 0.0, 0.0).select("c_custkey", "cell_id")


@query("""WITH fine AS (SELECT l_orderkey, l_linenumber, l_partkey % 200 * 0.1 AS lat, l_suppkey % 200 * 0.1 AS lon FROM lineitem),
coarse AS (SELECT n_nationkey AS cell_id, CAST(n_nationkey // 5 AS DOUBLE) AS lat, CAST(n_nationkey % 5 AS DOUBLE) AS lon FROM nation)
SELECT coarse.cell_id AS coarse_id, CAST(count(*) AS BIGINT) AS n FROM fine JOIN coarse ON floor(fine.lat + 0.5) = coarse.lat AND floor(fine.lon + 0.5) = coarse.lon GROUP BY 1""")
def half_cell_range_join(spark, d):
    fine = table(spark, d, "lineitem").select((F.pmod("l_partkey", F.lit(200)) * F.lit(0.1)).alias("lat"), (F.pmod("l_suppkey", F.lit(200)) * F.lit(0.1)).alias("lon"))
    coarse = table(spark, d, "nation").select(F.col("n_nationkey").alias("cell_id"), F.expr("n_nationkey div 5").cast("double").alias("lat"), F.expr("n_nationkey % 5").cast("double").alias("lon"))
    return g.half_cell_join(fine, coarse, 1.0, 0.0, 0.0).groupBy("coarse_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_POINTS} SELECT min(lat) - 0.5 * (max(lat) - min(lat)) / (count(DISTINCT lat) - 1) AS min_lat, min(lon) - 0.5 * (max(lon) - min(lon)) / (count(DISTINCT lon) - 1) AS min_lon, max(lat) + 0.5 * (max(lat) - min(lat)) / (count(DISTINCT lat) - 1) AS max_lat, max(lon) + 0.5 * (max(lon) - min(lon)) / (count(DISTINCT lon) - 1) AS max_lon, (max(lat) - min(lat)) / (count(DISTINCT lat) - 1) AS res_lat, (max(lon) - min(lon)) / (count(DISTINCT lon) - 1) AS res_lon FROM cells")
def grid_extent(spark, d):
    return rounded(g.extent(_cells(spark, d)), 6)


@query(f"WITH {GRID} SELECT cell_id, t, round(click, 4) AS click, 'train' AS period FROM grid WHERE t < DATE '2024-01-16' UNION ALL SELECT cell_id, t, round(click, 4), 'test' FROM grid WHERE t BETWEEN DATE '2024-01-10' AND DATE '2024-01-25'")
def split_periods(spark, d):
    df = g.split_periods(grid(spark, d), {"train": ("1900-01-01", "2024-01-15"), "test": ("2024-01-10", "2024-01-25")})
    return rounded(df.select("cell_id", "t", "click", "period"))


# -- sampling ----------------------------------------------------------------------------------


def _top(keys: str, key: str, size: str, seed: int) -> str:
    return f"(SELECT {key} FROM (SELECT {key}, row_number() OVER (ORDER BY {HASH(key, seed)}, {key}) AS rn, count(*) OVER () AS n FROM ({keys})) WHERE rn <= {size})"


@query(f"WITH {GRID} SELECT cell_id, t_i, round(click, 4) AS click FROM gi WHERE cell_id IN {_top('SELECT DISTINCT cell_id FROM gi', 'cell_id', 'floor(n * 0.3 + 1e-9)', 5)} AND t_i IN {_top('SELECT DISTINCT t_i FROM gi', 't_i', 'floor(n * 0.5 + 1e-9)', 5)}")
def random_downsample(spark, d):
    return rounded(sp.downsample(stash(indexed(spark, d).select("cell_id", "t_i", "click")), cell_fraction=0.3, time_fraction=0.5, seed=5))


@query(f"WITH {GRID} SELECT DISTINCT cell_id FROM gi WHERE lat_i >= 1 AND lon_i >= 1 AND (lat_i - 1) % 3 = 0 AND (lon_i - 1) % 3 = 0")
def regular_interval(spark, d):
    return sp.regular_interval(indexed(spark, d), 3, 1).select("cell_id").distinct()


@query(f"""WITH {GRID}, k AS (SELECT t_i, cell_id, row_number() OVER (PARTITION BY t_i ORDER BY cell_id) - 1 AS pos FROM gi),
n AS (SELECT t_i, count(*) AS n FROM gi GROUP BY 1),
dr AS (SELECT t_i, draw, n, {HASH('draw + t_i * 100003', 3)} % n AS pos FROM (SELECT t_i, n, unnest(range(1, CAST(floor(n * 0.2 + 1e-9) AS BIGINT) + 1)) AS draw FROM n))
SELECT t_i, draw, cell_id FROM dr JOIN k USING (t_i, pos)""")
def with_replacement_by_time(spark, d):
    df = indexed(spark, d).select(F.col("t_i").cast("long").alias("t_i"), "cell_id")
    return sp.with_replacement(df, 0.2, "cell_id", "t_i", 3).select("t_i", "draw", "cell_id")


@query(f"""WITH {GRID}, nd AS (SELECT count(*) AS nd FROM days), s AS (SELECT e.epoch, t.t0, nd, row_number() OVER (PARTITION BY e.epoch ORDER BY {HASH('t0 + epoch * 100003', 1)}, t0) AS rn FROM nd, range(0, 3) e(epoch), range(0, nd - 7) t(t0)),
c AS (SELECT DISTINCT user_id AS cell_id FROM events)
SELECT cell_id, epoch, CAST(t0 AS BIGINT) AS t0 FROM s, c WHERE rn <= floor((nd - 7) * 0.5)""")
def temporal_subset_epoch(spark, d):
    starts = sp.epoch_starts(n_days(spark, d), 7, spark, epochs=3, fraction=0.5, seed=1)
    cells = table(spark, d, "events").select(F.col("user_id").alias("cell_id")).distinct()
    return rounded(cells.join(F.broadcast(starts)).select("cell_id", "epoch", "t0"))  # a few starts an epoch


@query(f"SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY {HASH('p_partkey', 2)}, p_partkey) AS rn FROM part) WHERE rn <= 3")
def points_per_category(spark, d):
    return sp.points_per_category(table(spark, d, "part").select("p_brand", "p_partkey"), "p_brand", 3, "p_partkey", 2)


@query(f"SELECT c_custkey FROM customer WHERE c_custkey % 4 = 1 ORDER BY {HASH('c_custkey + 200006', 9)}, c_custkey")
def epoch_shard(spark, d):
    return sp.epoch_order(sp.shard(table(spark, d, "customer").select("c_custkey"), "c_custkey", 1, 4), "c_custkey", 2, 9)


# -- sequences and blocks ----------------------------------------------------------------------

_SERIES = f"WITH {GRID}, c AS (SELECT cell_id, list(t_i ORDER BY t_i) AS steps, list(coalesce(click, 0) ORDER BY t_i) AS x FROM gi GROUP BY cell_id)"


def _series(spark, d) -> DataFrame:
    return sq.cell_series(indexed(spark, d).withColumn("x", F.coalesce("click", F.lit(0.0))), ["x"])


def _digest(df: DataFrame, at: str) -> DataFrame:
    return df.select("cell_id", F.col(at).cast("long").alias(at), F.size("x").cast("long").alias("n"), r(F.col("x")[0]).alias("first"), r(F.element_at("x", -1)).alias("last"), r(F.aggregate("x", F.lit(0.0), lambda a, v: a + v)).alias("total"))


@query(_SERIES + ", w AS (SELECT cell_id, t0, x[t0 + 1:t0 + 7] AS x FROM (SELECT *, unnest(range(0, len(x) - 7)) AS t0 FROM c)) SELECT cell_id, t0, CAST(len(x) AS BIGINT) AS n, round(x[1], 4) AS first, round(x[-1], 4) AS last, round(list_sum(x), 4) AS total FROM w")
def forward_sequences(spark, d):
    return _digest(sq.forward_sequences(_series(spark, d), ["x"], 7), "t0")


@query(_SERIES + ", w AS (SELECT cell_id, t, x[t - 5:t + 1] AS x FROM (SELECT *, unnest(range(7, len(x))) AS t FROM c)) SELECT cell_id, t, CAST(len(x) AS BIGINT) AS n, round(x[1], 4) AS first, round(x[-1], 4) AS last, round(list_sum(x), 4) AS total FROM w")
def trailing_sequences(spark, d):
    return _digest(sq.trailing_sequences(_series(spark, d), ["x"], 7), "t")


@query(_SERIES + " SELECT cell_id, CAST(len(steps) AS BIGINT) AS n, CAST(steps[1] AS BIGINT) AS first_step, CAST(steps[-1] AS BIGINT) AS last_step, round(list_sum(x), 4) AS total, round(x[-1], 4) AS last FROM c")
def cell_series(spark, d):
    s = _series(spark, d)
    return s.select("cell_id", F.size("steps").cast("long").alias("n"), F.col("steps")[0].cast("long").alias("first_step"), F.element_at("steps", -1).cast("long").alias("last_step"), r(F.aggregate("x", F.lit(0.0), lambda a, v: a + v)).alias("total"), r(F.element_at("x", -1)).alias("last"))


def _shape(df: DataFrame) -> tuple[DataFrame, int]:
    """The grid's mask (cells whose mean error is above 50 or that have none) and its number of rows."""
    cells = stash(df.groupBy("lat_i", "lon_i").agg(F.avg("error").alias("e")))
    n_lat = cells.agg(F.max("lat_i")).first()[0] + 1
    return cells.select("lat_i", "lon_i", (F.coalesce(F.col("e") > 50, F.lit(True))).alias("mask")), n_lat


_TILES = f"""WITH {GRID}, mask AS (SELECT lat_i, lon_i, coalesce(avg(error) > 50, true) AS m FROM gi GROUP BY 1, 2), n AS (SELECT max(lat_i) + 1 AS nlat FROM gi),
tiles AS (SELECT ix, iy, ix * 2 AS x0, least(ix * 2 + 4, 10) AS x1, iy * 2 AS y0, least(iy * 2 + 4, nlat) AS y1 FROM range(0, 5) a(ix), n, range(0, CAST(ceil(nlat / 2.0) AS BIGINT)) b(iy)),
cov AS (SELECT ix, iy, count(*) FILTER (WHERE m) AS masked FROM tiles LEFT JOIN mask ON lon_i >= x0 AND lon_i < x1 AND lat_i >= y0 AND lat_i < y1 GROUP BY 1, 2),
judged AS (SELECT tiles.*, CASE WHEN x1 - x0 < 4 OR y1 - y0 < 4 THEN 'degenerate' WHEN masked / ((x1 - x0) * (y1 - y0)) > {{0}} THEN 'missing' END AS reason FROM tiles JOIN cov USING (ix, iy)),
space AS (SELECT CASE WHEN reason IS NULL THEN CAST(sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY ix, iy) - 1 AS BIGINT) END AS s_idx, ix, iy, x0, x1, y0, y1, reason IS NULL AS kept, reason FROM judged)"""
_TIME = "nd AS (SELECT count(*) AS nd FROM days), time AS (SELECT CASE WHEN it * 5 + 10 <= nd THEN it END AS k_idx, it, it * 5 AS t0, least(it * 5 + 10, nd) AS t1, it * 5 + 10 <= nd AS kept FROM nd, range(0, CAST(ceil(nd / 5.0) AS BIGINT)) x(it))"


def _space(df: DataFrame, policy=0.5) -> DataFrame:
    mask, n_lat = _shape(df)
    return cb.spatial_cubelets(df.sparkSession, n_lat, 10, 4, 4, 2, 2, mask=mask, missing_policy=policy)


def _catalogue(df: DataFrame) -> DataFrame:
    days = df.agg(F.max("t_i")).first()[0] + 1
    return stash(cb.catalogue(_space(df), cb.time_cubelets(df.sparkSession, days, 10, 5)))


def _in_blocks(df: DataFrame) -> DataFrame:
    """The rows of the kept blocks."""
    n_lat, days = (x + 1 for x in df.agg(F.max("lat_i"), F.max("t_i")).first())
    blocks = _catalogue(df).select("s_idx", "k_idx", "ix", "iy", "it")
    return cb.members(df.select("lat_i", "lon_i", "t_i", "click"), blocks, (4, 4, 10), (2, 2, 5), (10, n_lat, days))


@query(_TILES.format("99") + " SELECT * FROM space")
def spatial_cubelets(spark, d):
    _, n_lat = _shape(indexed(spark, d))
    return rounded(cb.spatial_cubelets(spark, n_lat, 10, 4, 4, 2, 2))


@query(_TILES.format("0.5") + " SELECT * FROM space")
def cubelet_missing_policy(spark, d):
    return rounded(_space(stash(indexed(spark, d).select("lat_i", "lon_i", "error"))))


@query(f"WITH {GRID}, {_TIME} SELECT * FROM time")
def time_cubelets(spark, d):
    return rounded(cb.time_cubelets(spark, n_days(spark, d), 10, 5))


@query(_TILES.format("0.5") + f", {_TIME} SELECT s_idx, ix, iy, x0, x1, y0, y1, k_idx, it, t0, t1 FROM space, time WHERE space.kept AND time.kept")
def cubelet_catalogue(spark, d):
    return rounded(_catalogue(stash(indexed(spark, d))))


@query(_TILES.format("0.5") + f", {_TIME} SELECT s_idx, k_idx, CAST(count(*) AS BIGINT) AS n, round(sum(click), 4) AS total FROM space, time, gi WHERE space.kept AND time.kept AND lon_i >= x0 AND lon_i < x1 AND lat_i >= y0 AND lat_i < y1 AND t_i >= t0 AND t_i < t1 GROUP BY 1, 2")
def cubelet_members(spark, d):
    rows = _in_blocks(stash(indexed(spark, d)))
    return rounded(rows.groupBy("s_idx", "k_idx").agg(F.count(F.lit(1)).alias("n"), F.sum("click").alias("total")))


@query(_TILES.format("0.5") + f", {_TIME}, cat AS (SELECT s_idx, k_idx FROM space, time WHERE space.kept AND time.kept) SELECT s_idx, k_idx FROM cat WHERE s_idx IN {_top('SELECT DISTINCT s_idx FROM cat', 's_idx', 'floor(n * 0.5 + 1e-9)', 4)} AND k_idx IN {_top('SELECT DISTINCT k_idx FROM cat', 'k_idx', 'floor(n * 0.6 + 1e-9)', 5)}")
def cubelet_downsample(spark, d):
    cat = _catalogue(stash(indexed(spark, d)))
    return rounded(sp.sample_cubelets(cat, 0.5, 0.6, 4).select("s_idx", "k_idx"))


# -- calibration targets, distributions, uncertainty -------------------------------------------


@query(f"""WITH {PAIRS}, {STATIC}, b AS (SELECT cell_id, min(y_true) AS lo, max(y_true) AS hi FROM pairs GROUP BY 1)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round((y_true - lo) / nullif(hi - lo, 0) * ((s_nationkey + 2) / 10.0 - s_nationkey / 10.0) + s_nationkey / 10.0, 6) AS y_true FROM pairs JOIN b USING (cell_id) JOIN static USING (cell_id)""")
def rescale_target(spark, d):
    bounds = static(spark, d).select("cell_id", (F.col("s_nationkey") / F.lit(10.0)).alias("lower"), ((F.col("s_nationkey") + 2) / F.lit(10.0)).alias("upper"))
    return rounded(st.rescale_target(pairs(spark, d), "y_true", bounds).select("l_orderkey", "l_linenumber", "y_true"), 6)


_MATCH = """WITH obs AS (SELECT l_suppkey AS cell_id, l_orderkey, l_linenumber, l_extendedprice AS y FROM lineitem),
o AS (SELECT cell_id, avg(y) AS om, stddev_pop(y) AS os, min(y) AS olo, max(y) AS ohi FROM obs GROUP BY 1),
s AS (SELECT l_suppkey AS cell_id, avg(l_quantity) AS sm, stddev_pop(l_quantity) AS ss, min(l_quantity) AS slo, max(l_quantity) AS shi FROM lineitem WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '2000-01-01' GROUP BY 1)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round({0}, 6) AS matched FROM obs JOIN o USING (cell_id) JOIN s USING (cell_id)"""


def _matched(spark, d, method):
    line = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("cell_id"), "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", F.col("l_extendedprice").alias("y"))
    sim = g.time_range(line, "1997-01-01", "1999-12-31", "l_shipdate").select("cell_id", F.col("l_quantity").alias("y"))
    out = st.match_distribution(line.drop("l_quantity", "l_shipdate"), sim, "y", method)
    return rounded(out.select("l_orderkey", "l_linenumber", F.col("y_matched").alias("matched")), 6)


@query(_MATCH.format("ss / nullif(os, 0) * (y - om) + sm"))
def zscore_match(spark, d):
    return _matched(spark, d, "zscore")


@query(_MATCH.format("(y - olo) / nullif(ohi - olo, 0) * (shi - slo) + slo"))
def minmax_match(spark, d):
    return _matched(spark, d, "minmax")


@query(f"""WITH {GRID}, l AS (SELECT 'view' AS variable, "view" AS v FROM grid UNION ALL SELECT 'signup', signup FROM grid), e AS (SELECT variable, min(v) AS lo, max(v) AS hi FROM l GROUP BY 1)
SELECT variable, CAST(least(floor((v - lo) / ((hi - lo) / 100.0)), 99) AS BIGINT) AS bin, round(lo + least(floor((v - lo) / ((hi - lo) / 100.0)), 99) * ((hi - lo) / 100.0), 4) AS "left", CAST(count(*) AS BIGINT) AS n FROM l JOIN e USING (variable) WHERE v IS NOT NULL GROUP BY ALL""")
def histogram_pair(spark, d):
    return rounded(ev.histogram(grid(spark, d), ["view", "signup"]))


@query(f"WITH {GRID} SELECT cell_id % 4 AS category, t, round(quantile_cont(click, 0.1), 4) AS p10, round(quantile_cont(click, 0.9), 4) AS p90, round(min(click), 4) AS vmin, round(max(click), 4) AS vmax, round(quantile_cont(click, 0.5), 4) AS median FROM grid GROUP BY 1, 2")
def category_quantiles(spark, d):
    return rounded(ev.category_quantiles(grid(spark, d).withColumn("category", F.pmod("cell_id", F.lit(4))), "click"))


# means that may lie on a rounding edge are taken of decimals: exact sums, four more digits rounded half up, then rounded to what is shown


def _decimal_mean(s: str, n: str, more: int) -> str:
    """The SQL of such a mean: ``s`` in whole units, ``more`` more digits, of which those beyond the fourth place go."""
    return f"((2 * {s} * 10000 + {n}) // (2 * {n}) + {5 * 10 ** (more - 1)}) // {10**more} / 10000.0"


@query(f"""WITH s AS (SELECT l_suppkey AS cell_id, CAST(month(l_shipdate) AS BIGINT) AS month, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS s, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT cell_id, month, {_decimal_mean('s', 'n', 2)} AS y FROM s""")
def monthly_climatology(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("cell_id"), F.col("l_shipdate").alias("t"), F.col("l_extendedprice").cast("decimal(18,2)").alias("y"))
    return rounded(ev.monthly_climatology(line, "y").withColumn("y", F.round("y", 4).cast("double")))


_CLICK_MEANS = f"WITH {GRID}, s AS (SELECT cell_id, CAST(sum(CAST(round(click * 1000000) AS BIGINT)) AS BIGINT) AS s, count(click) AS n, coalesce(stddev_pop(click), 0) AS u FROM grid GROUP BY 1)"


@query(f"{_CLICK_MEANS} SELECT cell_id, CASE WHEN n > 0 THEN {_decimal_mean('s', 'n', 6)} END AS click FROM s")
def time_mean_map(spark, d):
    df = grid(spark, d).select("cell_id", F.col("click").cast("decimal(18,6)").alias("click"))
    return rounded(ev.time_mean(df, "click").withColumn("click", F.round("click", 4).cast("double")))


@query("SELECT user_id AS cell_id, CAST(ts AS DATE) AS t, round(max(value), 4) AS value FROM events GROUP BY 1, 2")
def daily_maximum(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("cell_id"), F.col("ts").alias("t"), "value")
    return rounded(st.daily(e, "value"))


_MEMBERS = "WITH e AS (SELECT label AS cell_id, vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS t FROM embeddings)"


def _members(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("label").alias("cell_id"), "vec_id", F.posexplode("embedding").alias("t", "v")).withColumn("v", F.col("v").cast("double"))


@query(_MEMBERS + " SELECT CAST(cell_id AS BIGINT) AS cell_id, CAST(t AS BIGINT) AS t, round(avg(CAST(v AS DOUBLE)), 6) AS mean, round(stddev_samp(CAST(v AS DOUBLE)), 6) AS std FROM e GROUP BY ALL")
def ensemble_mean_std(spark, d):
    return rounded(un.ensemble_spread(_members(spark, d), "v"), 6)


_CONF = f"""WITH {PAIRS}, b AS (SELECT *, 0.5 * y_pred AS lower, 1.5 * y_pred AS upper FROM pairs),
q AS (SELECT c AS coverage, quantile_cont(greatest(y_true - upper, lower - y_true), c) AS q FROM b, (SELECT unnest([0.5, 0.8, 0.9]) AS c) WHERE l_orderkey % 2 = 0 AND y_true IS NOT NULL GROUP BY c),
i AS (SELECT b.*, coverage, lower - q AS lo, upper + q AS hi FROM b, q WHERE l_orderkey % 2 = 1)"""


def _conformal(spark, d) -> DataFrame:
    df = pairs(spark, d).withColumns({"lower": 0.5 * F.col("y_pred"), "upper": 1.5 * F.col("y_pred")})
    q = un.conformal_q(df.where("l_orderkey % 2 = 0"), [0.5, 0.8, 0.9])
    return un.conformal_intervals(df.where("l_orderkey % 2 = 1"), q)


_CONF_Q = _CONF.replace("quantile_cont(greatest(y_true - upper, lower - y_true), c) AS q FROM b, (SELECT unnest([0.5, 0.8, 0.9]) AS c) WHERE l_orderkey % 2 = 0 AND y_true IS NOT NULL GROUP BY c", "q FROM (SELECT unnest([0.5, 0.8, 0.9]) AS c, unnest(quantile_cont(greatest(y_true - upper, lower - y_true), [0.5, 0.8, 0.9])) AS q FROM b WHERE l_orderkey % 2 = 0 AND y_true IS NOT NULL)")


@query(_CONF_Q + " SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, coverage, round(lo, 3) AS interval_lower, round(hi, 3) AS interval_upper, round((lo + hi) / 2, 3) AS midpoint FROM i")
def conformal_interval(spark, d):
    return rounded(_conformal(spark, d).select("l_orderkey", "l_linenumber", "coverage", "interval_lower", "interval_upper", "midpoint"), 3)


@query(_CONF_Q + " SELECT coverage, round(avg(CAST(y_true BETWEEN lo AND hi AS INT)) * 100, 4) AS empirical_coverage FROM i GROUP BY 1")
def conformal_coverage(spark, d):
    return rounded(un.empirical_coverage(_conformal(spark, d)))


@query(f"{_CLICK_MEANS} SELECT cell_id, printf('%.5f ± %.5f', {_decimal_mean('s', 'n', 6)}, u) AS shown FROM s WHERE n > 0")
def uncertainty_format(spark, d):
    s = grid(spark, d).groupBy("cell_id").agg(F.round(F.avg(F.col("click").cast("decimal(18,6)")), 4).cast("double").alias("v"), F.coalesce(F.stddev_pop("click"), F.lit(0.0)).alias("u")).where("v is not null")
    return s.select("cell_id", tr.with_uncertainty(F.col("v"), F.col("u")).alias("shown"))


# -- a user's model ----------------------------------------------------------------------------


def reservoir(x: np.ndarray) -> np.ndarray:
    """A linear reservoir: each step keeps 0.8 of the store and adds the input. [rows, steps, features] -> [rows, steps, 1]."""
    inflow = np.nan_to_num(x[:, :, 0])
    out, store = np.zeros((*inflow.shape, 1)), np.zeros(len(inflow))
    for t in range(inflow.shape[1]):
        store = 0.8 * store + inflow[:, t]
        out[:, t, 0] = 0.2 * store
    return out


@query(f"""WITH RECURSIVE {GRID}, s AS (SELECT cell_id, t_i, coalesce(click, 0) AS x, row_number() OVER (PARTITION BY cell_id ORDER BY t_i) AS k FROM gi),
w AS (SELECT cell_id, t_i, k, x AS store FROM s WHERE k = 1 UNION ALL SELECT s.cell_id, s.t_i, s.k, 0.8 * w.store + s.x FROM w JOIN s ON s.cell_id = w.cell_id AND s.k = w.k + 1)
SELECT cell_id, t_i, round(0.2 * store, 6) AS y_hat FROM w""")
def score_series(spark, d):
    return rounded(sc.score_series(indexed(spark, d), reservoir, ["click"]), 6)


@query(_SERIES + """, w AS (SELECT cell_id, t0, x[t0 + 1:t0 + 7] AS x FROM (SELECT *, unnest(range(0, len(x) - 7)) AS t0 FROM c))
SELECT cell_id, t0, round(0.2 * list_sum(list_transform(x, lambda v, i: v * pow(0.8, 7 - i))), 6) AS y_hat FROM w""")
def score_sequences(spark, d):
    seq = sq.forward_sequences(_series(spark, d), ["x"], 7)
    seq = seq.withColumn("x", F.transform("x", lambda v: F.array(v)))
    out = sc.score_sequences(seq, reservoir, "x", ["cell_id", "t0"])
    return sq.select_steps(out, "y_hat", 0).select("cell_id", F.col("t0").cast("long").alias("t0"), r("y_hat", 6).alias("y_hat"))


def noisy(x: np.ndarray, seed: int) -> np.ndarray:
    """The reservoir, up to 5 % more or less; the noise follows from the seed in whole numbers."""
    h = seed * 48271 % sp.PRIME
    return reservoir(x) * (0.95 + 0.1 * (h * (h + 12345) % sp.PRIME) / sp.PRIME)


_RESERVOIR = f"""WITH RECURSIVE {GRID}, s AS (SELECT cell_id, t_i, coalesce(click, 0) AS x, row_number() OVER (PARTITION BY cell_id ORDER BY t_i) AS k FROM gi),
w AS (SELECT cell_id, t_i, k, x AS store FROM s WHERE k = 1 UNION ALL SELECT s.cell_id, s.t_i, s.k, 0.8 * w.store + s.x FROM w JOIN s ON s.cell_id = w.cell_id AND s.k = w.k + 1)"""
_NOISE = HASH("(cell_id * 1000003 + sample * 7919) % 2147483648", 0)


@query(_RESERVOIR + f""", f AS (SELECT cell_id, 0.95 + 0.1 * ({_NOISE}) / 2147483647.0 AS f FROM (SELECT DISTINCT cell_id FROM s), range(0, 4) x(sample))
SELECT cell_id, t_i, round(avg(0.2 * store * f), 6) AS mean, round(stddev_samp(0.2 * store * f), 6) AS std FROM w JOIN f USING (cell_id) GROUP BY 1, 2""")
def score_mc(spark, d):
    return rounded(un.ensemble_spread(sc.score_samples(indexed(spark, d), noisy, ["click"], 4), "y_hat", ["cell_id", "t_i"]), 6)


@query(_TILES.format("0.5") + f", {_TIME} SELECT s_idx, k_idx, t_i, lat_i, lon_i, round(2 * coalesce(click, 0), 6) AS y_hat FROM space, time, gi WHERE space.kept AND time.kept AND lon_i >= x0 AND lon_i < x1 AND lat_i >= y0 AND lat_i < y1 AND t_i >= t0 AND t_i < t1")
def score_cubelets(spark, d):
    rows = _in_blocks(stash(indexed(spark, d)))
    return rounded(sc.score_cubelets(rows, lambda cube: np.nanmean(np.nan_to_num(cube), axis=1) * 2, ["click"]), 6)


@query(_RESERVOIR + " SELECT cell_id, t_i, round(0.2 * store * (0.1 + 0.8 / (1 + exp(0.1 * (cell_id % 10) - 0.05 * (cell_id // 10)))), 6) AS y_hat FROM w")
def score_two_stage(spark, d):
    static_ = indexed(spark, d).select("cell_id", "lat_i", "lon_i").distinct()
    parameters = lambda s: s @ np.array([[0.05], [-0.1]])
    head = lambda x: reservoir(x) * x[:, :, 1:2]
    return rounded(sc.score_two_stage(static_, indexed(spark, d), parameters, [("k", 0.1, 0.9)], head, ["lat_i", "lon_i"], ["click"]), 6)


@query(f"WITH {PAIRS} SELECT cell_id, round(quantile_cont(abs(y_pred - y_true), 0.5), 4) AS value FROM pairs GROUP BY 1")
def user_metric(spark, d):
    return rounded(sc.user_metric(pairs(spark, d), lambda o, p: float(np.median(np.abs(p - o))), ["cell_id"]))  # a cell's series, never a category


# -- set operations and joins that the rest doesn't show ---------------------------------------


@query(f"WITH {STATIC} SELECT cell_id, cell_id IN {_top('SELECT cell_id FROM static', 'cell_id', 'floor(n * 0.25 + 1e-9)', 6)} AS sampled FROM static")
def mark_sampled(spark, d):
    cells = static(spark, d).select("cell_id")
    return g.mark_sampled(cells, sp.sample_keys(cells, "cell_id", 0.25, seed=6))


@query(f"""WITH {PAIRS}, a AS (SELECT cell_id, max(y_pred) AS hi FROM pairs WHERE y_pred > 90000 GROUP BY 1), b AS (SELECT cell_id, min(y_pred) AS lo FROM pairs WHERE y_pred < 1000 GROUP BY 1)
SELECT coalesce(a.cell_id, b.cell_id) AS cell_id, round(hi, 4) AS hi, round(lo, 4) AS lo FROM a FULL JOIN b ON a.cell_id = b.cell_id""")
def merge_columns(spark, d):
    df = pairs(spark, d)
    hi = df.where("y_pred > 90000").groupBy("cell_id").agg(F.max("y_pred").alias("hi"))
    lo = df.where("y_pred < 1000").groupBy("cell_id").agg(F.min("y_pred").alias("lo"))
    return rounded(g.merge_columns([hi, lo], ["cell_id"]))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE 1 END AS batch FROM lineitem")
def concat_batches(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    parts = [df.where(F.pmod("l_orderkey", F.lit(2)) == k).withColumn("batch", F.lit(k)) for k in (0, 1)]
    return rounded(io.concat(*parts)).withColumn("batch", F.col("batch").cast("int"))


@query("SELECT event_type AS metric, round(avg(value), 4) AS value FROM events GROUP BY 1")
def averaged_losses(spark, d):
    return rounded(ev.averaged(table(spark, d, "events").select(F.col("event_type").alias("metric"), "value")))


@query(f"""WITH k AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos, count(*) OVER () AS n FROM customer),
dr AS (SELECT draw, {HASH('draw', 8)} % n AS pos FROM (SELECT n, unnest(range(1, CAST(floor(n * 0.4 + 1e-9) AS BIGINT) + 1)) AS draw FROM (SELECT count(*) AS n FROM customer)))
SELECT draw, c_custkey FROM dr JOIN k USING (pos)""")
def with_replacement_all(spark, d):
    return sp.with_replacement(table(spark, d, "customer").select("c_custkey"), 0.4, "c_custkey", seed=8).select("draw", "c_custkey")


@query(f"WITH {GRID} SELECT cell_id, t_i, round(click, 4) AS click, lat_i, lon_i FROM gi WHERE click IS NOT NULL")
def label_predictions(spark, d):
    df = indexed(spark, d)
    pred = g.keep_valid(df.select("cell_id", "t_i", "click"), "click", "click")
    return rounded(io.label_predictions(pred, df.select("cell_id", "t_i", "lat_i", "lon_i")))


# -- reading, writing, and what one period hands to another ------------------------------------


def _marked(spark, d) -> DataFrame:
    """A grid as simulators write it: NaN where a value is missing, a member number for each row."""
    df = indexed(spark, d).select("cell_id", "t_i", "click", "view", "error")
    return df.withColumns({"click": F.when(F.col("error").isNull(), F.lit(float("nan"))).otherwise(F.col("click")), "member": F.pmod("cell_id", F.lit(4)).cast("int")})


@query(f'WITH {GRID} SELECT cell_id, t_i, CASE WHEN error IS NOT NULL THEN round(click, 4) END AS click, round("view", 4) AS "view" FROM gi')
def written_grid(spark, d):
    path = new_path(spark, "grid")
    io.write_grid(_marked(spark, d), path, partition_by=["member"])
    return rounded(io.read_grid(spark, path, ["click", "view"], ("cell_id", "t_i")))


@query(f"WITH {GRID} SELECT cell_id, t_i, CASE WHEN error IS NOT NULL THEN round(click, 4) END AS click, lat_i, lon_i FROM gi WHERE cell_id % 4 IN (1, 3)")
def members_of_ensemble(spark, d):
    path = new_path(spark, "members")
    io.write_grid(_marked(spark, d), path)
    return rounded(io.decode_cells(io.read_grid(spark, path, ["click"], ("cell_id", "t_i"), member=[1, 3]), 10))


@query(f"WITH {GRID} SELECT cell_id, t_i, t_i // 7 AS t_chunk, round(click, 4) AS click FROM gi")
def appended_slabs(spark, d):
    path, df = new_path(spark, "slabs"), indexed(spark, d).select("cell_id", "t_i", "click")
    io.append_time_chunks(df.where("t_i < 14"), path, 7)
    io.append_time_chunks(df.where("t_i >= 14"), path, 7)
    return rounded(io.read_time_chunks(spark, path).select("cell_id", "t_i", "t_chunk", "click"))


@query(f"WITH {GRID} SELECT cell_id, t_i, t_i // 7 AS t_chunk, round(click, 4) AS click FROM gi WHERE t_i < 21")
def repeated_append(spark, d):
    """One append runs twice, one is killed before its end and runs again, one never ends."""
    path, df = new_path(spark, "slabs"), stash(indexed(spark, d).select("cell_id", "t_i", "click"))
    first, second = df.where("t_i < 10"), df.where("t_i >= 10 and t_i < 21")
    io.append_time_chunks(first, path, 7)
    io.append_time_chunks(first, path, 7)
    left = second.where("cell_id % 2 = 0").withColumns({"t_chunk": F.expr("t_i div 7").cast("long"), "batch": F.lit("10-20")})
    left.write.mode("append").partitionBy("t_chunk", "batch").parquet(path)
    io.append_time_chunks(second, path, 7)
    df.where("t_i >= 21").withColumns({"t_chunk": F.expr("t_i div 7").cast("long"), "batch": F.lit("21-29")}).write.mode("append").partitionBy("t_chunk", "batch").parquet(path)
    return rounded(io.read_time_chunks(spark, path).select("cell_id", "t_i", "t_chunk", "click"))


_TRAIN = f"""WITH {GRID}, s AS (SELECT min(click) AS c, max(click) - min(click) AS w, avg("view") AS mv, stddev_pop("view") AS sv FROM gi WHERE t_i < 15)"""


@query(_TRAIN + """ SELECT 'dynamic' AS group_type, 'click' AS variable, 'minmax' AS variant, round(c, 4) AS center, round(w, 4) AS scale FROM s
UNION ALL SELECT 'dynamic', 'view', 'standard', round(mv, 4), round(sv, 4) FROM s""")
def saved_stats(spark, d):
    path = new_path(spark, "stats")
    io.save_stats(st.fit(indexed(spark, d).where("t_i < 15"), {"click": "minmax", "view": "standard"}), path)
    return rounded(io.load_stats(spark, path, "dynamic"))


@query(_TRAIN + """ SELECT cell_id, t_i, round((click - c) / nullif(w, 0), 6) AS click, round(("view" - mv) / nullif(sv, 0), 6) AS "view" FROM gi, s WHERE t_i >= 15""")
def reused_stats(spark, d):
    path, df = new_path(spark, "stats"), indexed(spark, d).select("cell_id", "t_i", "click", "view")
    fit = lambda: st.fit(df.where("t_i < 15"), {"click": "minmax", "view": "standard"})
    io.load_or_compute(spark, path, fit, is_train=True, use_cached=True)  # nothing is kept yet: computed and kept
    test = df.where("t_i >= 15")
    stats = io.load_or_compute(spark, path, lambda: st.fit(test, {"click": "minmax", "view": "standard"}), is_train=False)
    return rounded(st.scale(test, stats, ["click", "view"]), 6)


@query(f"WITH {PAIRS} SELECT category, {_list(('rmse', 'pearson', 'kge'))} FROM ok GROUP BY 1")
def metric_table(spark, d):
    path = new_path(spark, "metrics")
    io.write_metric_table(ev.skill(pairs(spark, d), ["category"], ("rmse", "pearson", "kge")), path)
    return rounded(spark.read.option("header", True).schema("category string, rmse double, pearson double, kge double").csv(path))


# -- truth and prediction in tables of their own -----------------------------------------------


_ALIGNED = f"""WITH {PAIRS}, a AS (SELECT cell_id, t, avg(y_true) AS o FROM pairs WHERE l_orderkey % 3 <> 0 GROUP BY 1, 2), b AS (SELECT cell_id, t, avg(y_pred) AS p FROM pairs WHERE l_orderkey % 3 <> 1 GROUP BY 1, 2),
paired AS (SELECT * FROM a JOIN b USING (cell_id, t)), {STATIC}, masked AS (SELECT cell_id, CASE WHEN mask_low THEN NULL ELSE o END AS o, CASE WHEN mask_low THEN NULL ELSE p END AS p FROM paired JOIN static USING (cell_id)),
maps AS (SELECT cell_id, {_list(('rmse', 'bias', 'nse', 'kge'), 10)} FROM (SELECT cell_id, CASE WHEN p IS NOT NULL THEN o END AS o, CASE WHEN o IS NOT NULL THEN p END AS p FROM masked) GROUP BY 1)"""


def _evaluated(spark, d) -> tuple[DataFrame, DataFrame]:
    df = pairs(spark, d)
    true = df.where("l_orderkey % 3 <> 0").groupBy("cell_id", "t").agg(F.avg("y_true").alias("y_true"))
    pred = df.where("l_orderkey % 3 <> 1").groupBy("cell_id", "t").agg(F.avg("y_pred").alias("y_pred"))
    masks = static(spark, d).select("cell_id", F.col("mask_low").alias("mask"))
    return evaluation.run(true, pred, masks, metrics=("rmse", "bias", "nse", "kge"))


@query(_ALIGNED + " SELECT cell_id, round(rmse, 4) AS rmse, round(bias, 4) AS bias, round(nse, 4) AS nse, round(kge, 4) AS kge FROM maps")
def evaluation_maps(spark, d):
    return rounded(_evaluated(spark, d)[0])


@query(_ALIGNED + " " + " UNION ALL ".join(f"SELECT '{x}' AS metric, round(avg({x}), 4) AS mean, round(stddev_pop({x}), 4) AS std FROM maps" for x in ("rmse", "bias", "nse", "kge")))
def evaluation_table(spark, d):
    return rounded(_evaluated(spark, d)[1].select("metric", "mean", "std"))


@query(f"WITH {PAIRS}, a AS (SELECT cell_id, t, max(y_true) AS y_true FROM pairs WHERE l_orderkey % 3 <> 0 GROUP BY 1, 2), b AS (SELECT cell_id, t, max(y_pred) AS y_pred FROM pairs WHERE l_orderkey % 3 <> 1 GROUP BY 1, 2) SELECT cell_id, t, round(y_true, 4) AS y_true, round(y_pred, 4) AS y_pred FROM a JOIN b USING (cell_id, t)")
def aligned_pairs(spark, d):
    df = pairs(spark, d)
    true = df.where("l_orderkey % 3 <> 0").groupBy("cell_id", "t").agg(F.max("y_true").alias("y_true"))
    return rounded(g.align(true, df.where("l_orderkey % 3 <> 1").groupBy("cell_id", "t").agg(F.max("y_pred").alias("y_pred"))))


@query(f"WITH {GRID} SELECT cell_id, t_i, round(click, 4) AS click, round(signup, 4) AS signup FROM gi")
def selected_variables(spark, d):
    return rounded(g.select_variables(indexed(spark, d), ["click", "signup"], ("cell_id", "t_i")))


@query("SELECT vec_id, label FROM embeddings WHERE label IN (1, 4, 7)")
def selected_members(spark, d):
    return rounded(g.select_members(table(spark, d, "embeddings").select("vec_id", "label"), "label", [1, 4, 7])).withColumn("label", F.col("label").cast("int"))


@query(f"WITH {PAIRS}, {STATIC} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, cell_id FROM pairs WHERE cell_id NOT IN (SELECT cell_id FROM static WHERE mask_lake)")
def dropped_cells(spark, d):
    out = g.drop_cells(pairs(spark, d), static(spark, d).where("mask_lake"))
    return rounded(out.select("l_orderkey", "l_linenumber", "cell_id"))


# a cell's value in whole millionths, so that sums don't depend on the order; the mean is rounded half up in whole numbers, too
@query(f"""WITH {GRID}, c AS (SELECT s_suppkey AS cell_id, CASE WHEN s_nationkey < 10 THEN 'low' ELSE 'high' END AS category FROM supplier),
w AS (SELECT category, t_i, CAST(sum(CAST(round(click * 1000000) AS BIGINT)) AS BIGINT) AS s, count(click) AS k, count(*) AS n FROM gi JOIN c USING (cell_id) GROUP BY 1, 2)
SELECT category, t_i, CASE WHEN k > 0 THEN (s + 50 * k) // (100 * k) / 10000.0 END AS click, CAST(n AS BIGINT) AS n FROM w""")
def categories_of_cells(spark, d):
    cells = table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell_id"), F.when(F.col("s_nationkey") < 10, "low").otherwise("high").alias("category"))
    out = g.with_category(indexed(spark, d).select("cell_id", "t_i", F.round(F.col("click") * 1000000).cast("long").alias("w")), cells)
    whole = out.groupBy("category", F.col("t_i").cast("long").alias("t_i")).agg(F.sum("w").alias("s"), F.count("w").alias("k"), F.count(F.lit(1)).alias("n"))
    mean = F.when(F.col("k") > 0, F.floor((F.col("s") + 50 * F.col("k")) / (100 * F.col("k"))) / F.lit(10000.0))
    return whole.select("category", "t_i", mean.alias("click"), "n")


@query(_spaef_sql(False, "t", _GRID_OK) + " SELECT 'mean' AS method, round(avg(spaef), 4) AS spaef FROM spaef UNION ALL SELECT 'median', round(quantile_disc(spaef, 0.5), 4) FROM spaef UNION ALL SELECT 'percentile_90', round(quantile_cont(spaef, 0.9), 4) FROM spaef")
def aggregated_scores(spark, d):
    s = ev.spaef(grid(spark, d), ["t"], "view", "signup").select("spaef")
    return rounded(io.concat(*[ev.aggregate_scores(s, "spaef", how).select(F.lit(how).alias("method"), "spaef") for how in ("mean", "median", "percentile_90")]))


@query(f"""WITH {GRID}, nd AS (SELECT count(*) AS nd FROM days), s AS (SELECT e.epoch, t.t0, row_number() OVER (PARTITION BY e.epoch ORDER BY {HASH('t0 + epoch * 100003', 2)}, t0) AS rn FROM nd, range(0, 4) e(epoch), range(0, nd - 7) t(t0))
SELECT cell_id, epoch, CAST(t0 AS BIGINT) AS t0 FROM s, (SELECT DISTINCT cell_id FROM grid) WHERE rn <= 5""")
def counted_starts(spark, d):
    starts = sp.epoch_starts(n_days(spark, d), 7, spark, epochs=4, count=5, seed=2)
    cells = grid(spark, d).select("cell_id").distinct()
    return rounded(cells.join(F.broadcast(starts)).select("cell_id", "epoch", "t0"))  # five starts an epoch


@query(f"WITH {GRID} SELECT cell_id, t_i, round(2 * coalesce(click, 0), 4) AS vwc FROM gi")
def selected_outputs(spark, d):
    df = indexed(spark, d).select("cell_id", "t_i", (2 * F.coalesce("click", F.lit(0.0))).alias("vwc"), (3 * F.col("view")).alias("actevap"))
    return rounded(sc.select_outputs(df, ["vwc"]))


# -- long series, blocks on disk ---------------------------------------------------------------


QUERIES["windows_of_long_series"] = lambda spark, d: _digest(sq.forward_windows(indexed(spark, d).withColumn("x", F.coalesce("click", F.lit(0.0))), ["x"], 7, 8), "t0")
SQL["windows_of_long_series"] = SQL["forward_sequences"]
QUERIES["trailing_windows_of_long_series"] = lambda spark, d: _digest(sq.trailing_windows(indexed(spark, d).withColumn("x", F.coalesce("click", F.lit(0.0))), ["x"], 7, 4), "t")
SQL["trailing_windows_of_long_series"] = SQL["trailing_sequences"]


@query(f'WITH {GRID} SELECT cell_id, lat_i, lon_i, t_i, round(click, 4) AS click FROM gi WHERE lat_i BETWEEN 1 AND 7 AND lon_i BETWEEN 3 AND 6 AND t_i BETWEEN 9 AND 17')
def box_of_blocks(spark, d):
    path = new_path(spark, "blocks")
    bl.write_blocks(indexed(spark, d).select("cell_id", "lat_i", "lon_i", "t_i", "click"), path, (2, 2, 3))
    return rounded(bl.read_box(spark, path, (2, 2, 3), [(1, 7), (3, 6), (9, 17)]))


# -- uneven axes, merged states, orders --------------------------------------------------------

_UNEVEN = """points AS (SELECT c_custkey, (c_custkey * 37 % 1009) * 0.731 - 120 AS lat, (c_custkey * 53 % 997) * 0.417 - 40 AS lon FROM customer),
cells AS (SELECT p_partkey AS cell_id, round(pow((p_partkey - 1) // 40, 1.7) * 0.5 - 20, 3) AS lat, round(((p_partkey - 1) % 40) * ((p_partkey - 1) % 40) * 0.25, 3) AS lon FROM part WHERE p_size > 25)"""


def _uneven(spark, d) -> tuple[DataFrame, DataFrame]:
    """Points in and far outside of a grid whose axes are uneven and which has holes."""
    spread = lambda k, n, step, low: (F.pmod(F.col("c_custkey") * k, F.lit(n)) * F.lit(step) - low)
    points = table(spark, d, "customer").select("c_custkey", spread(37, 1009, 0.731, 120).alias("lat"), spread(53, 997, 0.417, 40).alias("lon"))
    row, column = F.expr("(p_partkey - 1) div 40"), F.expr("(p_partkey - 1) % 40")
    cells = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("cell_id"), F.round(F.pow(row, F.lit(1.7)) * F.lit(0.5) - 20, 3).alias("lat"), F.round(column * column * F.lit(0.25), 3).alias("lon"))
    return points, cells


_NEAR = lambda axis: f"(SELECT p.{axis} AS at, a.{axis} AS near FROM (SELECT DISTINCT {axis} FROM points) p, (SELECT DISTINCT {axis} FROM cells) a QUALIFY row_number() OVER (PARTITION BY p.{axis} ORDER BY abs(a.{axis} - p.{axis}), a.{axis}) = 1)"


@query(f"""WITH {_UNEVEN}, y AS {_NEAR('lat')}, x AS {_NEAR('lon')}
SELECT c_custkey, round(y.near, 3) AS cell_lat, round(x.near, 3) AS cell_lon, cell_id FROM points JOIN y ON y.at = points.lat JOIN x ON x.at = points.lon LEFT JOIN cells ON cells.lat = y.near AND cells.lon = x.near""")
def nearest_on_uneven_axes(spark, d):
    points, cells = _uneven(spark, d)
    return rounded(od.nearest_on_axes(points, cells).select("c_custkey", "cell_lat", "cell_lon", "cell_id"), 3)


@query(f"""WITH {_UNEVEN} SELECT c_custkey, cell_id, round(distance, 4) AS distance FROM (
  SELECT c_custkey, cell_id, sqrt((p.lat - c.lat) * (p.lat - c.lat) + (p.lon - c.lon) * (p.lon - c.lon)) AS distance FROM points p, cells c)
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY distance, cell_id) = 1""")
def nearest_existing_cell(spark, d):
    points, cells = _uneven(spark, d)
    return rounded(od.nearest_existing(points, cells, "c_custkey").select("c_custkey", "cell_id", "distance"))


_LEVELS = ("rmse", "pbias", "pearson", "nse", "kge", "gamma")


@query(f"""WITH {PAIRS}, {STATIC}, x AS (SELECT ok.*, s_nationkey FROM ok JOIN static USING (cell_id)),
a AS ({' UNION ALL '.join(f"SELECT '{level}' AS level, {key} AS key, CAST(count(*) AS BIGINT) AS n, {_list(_LEVELS)} FROM x GROUP BY ALL" for level, key in (('cell', 'CAST(cell_id AS VARCHAR)'), ('nation', 'CAST(s_nationkey AS VARCHAR)'), ('globe', "'all'")))}) SELECT * FROM a""")
def merged_moments(spark, d):
    """Two slabs of time, the second added later, the first written twice; three levels from the states of cells and slabs."""
    path = new_path(spark, "moments")
    df = pairs(spark, d)
    for slab, own in (("before", df.where("t < date '1995-01-01'")), ("before", df.where("t < date '1995-01-01'")), ("after", df.where("t >= date '1995-01-01'"))):
        mo.update(own, path, slab, ["cell_id"])
    states = mo.stored(spark, path).join(static(spark, d).select("cell_id", "s_nationkey"), "cell_id")
    return rounded(mo.levels(states, {"cell": ["cell_id"], "nation": ["s_nationkey"], "globe": []}, _LEVELS))


@query(f"""WITH {PAIRS} SELECT category, 'minmax' AS variant, round(min(o), 4) AS center, round(max(o) - min(o), 4) AS scale FROM ok GROUP BY 1
UNION ALL SELECT category, 'standard', round(avg(o), 4), round(stddev_pop(o), 4) FROM ok GROUP BY 1""")
def statistics_of_moments(spark, d):
    states = stash(mo.moments(pairs(spark, d), ["category", "cell_id"]))
    whole = mo.merge(states, ["category"])
    return rounded(io.concat(*[mo.statistics(whole, v).withColumn("variant", F.lit(v)) for v in ("minmax", "standard")]))


@query(f"WITH {PAIRS}, s AS (SELECT category, y_pred AS v FROM pairs UNION ALL SELECT NULL, y_true FROM pairs), q AS (SELECT category, unnest([0.1, 0.5, 0.9, 0.999]) AS p, unnest(quantile_cont(v, [0.1, 0.5, 0.9, 0.999])) AS q FROM s WHERE v IS NOT NULL GROUP BY 1) SELECT category, p, round(q, 4) AS quantile FROM q")
def quantiles_of_large_groups(spark, d):
    df = pairs(spark, d)
    both = df.select("category", F.col("y_pred").alias("v")).unionByName(df.select(F.lit(None).cast("string").alias("category"), F.col("y_true").alias("v")))
    return rounded(od.exact_quantiles(both, ["category"], "v", [0.1, 0.5, 0.9, 0.999]))


@query(f"""WITH {GRID}, s AS (SELECT cell_id, click - lag(click) OVER w AS dx, "view" - lag("view") OVER w AS dy FROM gi WINDOW w AS (PARTITION BY cell_id ORDER BY t_i)),
f AS (SELECT cell_id, CASE WHEN dx >= 0 AND dy IS NOT NULL THEN greatest(-dy, 0) END AS fall FROM s)
SELECT cell_id, CAST(count(fall) AS BIGINT) AS steps, CAST(count(*) FILTER (WHERE fall > 0) AS BIGINT) AS broken, round(avg(fall * fall), 4) AS penalty FROM f GROUP BY 1""")
def monotonicity_by_cell(spark, d):
    return rounded(od.monotonicity(indexed(spark, d), ["cell_id"], "t_i", "click", "view"))


@query("""WITH s AS (SELECT user_id - lag(user_id) OVER (ORDER BY event_id) AS dx, value - lag(value) OVER (ORDER BY event_id) AS dy FROM events),
f AS (SELECT CASE WHEN dx >= 0 AND dy IS NOT NULL THEN greatest(-dy, 0) END AS fall FROM s)
SELECT CAST(count(fall) AS BIGINT) AS steps, CAST(count(*) FILTER (WHERE fall > 0) AS BIGINT) AS broken, round(avg(fall * fall), 4) AS penalty FROM f""")
def monotonicity_of_one_series(spark, d):
    return rounded(od.monotonicity(table(spark, d, "events"), [], "event_id", "user_id", "value"))


class Huber:
    """Mean Huber loss: squares up to ``delta``, beyond it straight."""

    def __init__(self, delta: float):
        self.delta = delta

    def init(self) -> np.ndarray:
        return np.zeros(2)

    def add(self, state: np.ndarray, true: np.ndarray, pred: np.ndarray) -> np.ndarray:
        e = np.abs(pred - true)
        return state + [len(e), np.where(e <= self.delta, e * e / 2, self.delta * (e - self.delta / 2)).sum()]

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a + b

    def finish(self, state: np.ndarray) -> float | None:
        return state[1] / state[0] / 1e6 if state[0] else None


@query(f"WITH {PAIRS} SELECT category, round(avg(CASE WHEN abs(p - o) <= 1000 THEN pow(p - o, 2) / 2 ELSE 1000 * (abs(p - o) - 500) END) / 1000000, 4) AS value FROM ok GROUP BY 1")
def user_metric_by_category(spark, d):
    return rounded(sc.user_metric_merged(pairs(spark, d), Huber(1000.0), ["category"]))


_BINS = "WITH e AS (SELECT user_id AS cell_id, ts, value FROM events)"


def _resample_sql(every: str, start: str, fill: bool) -> str:
    plain = f"{_BINS}, b AS (SELECT cell_id, {start} AS t, max(value) AS value FROM e GROUP BY 1, 2)"
    if not fill:
        return f"{plain} SELECT '{every}' AS every, cell_id, CAST(t AS VARCHAR) AS t, round(value, 4) AS value FROM b"
    return f"{plain}, r AS (SELECT cell_id, unnest(generate_series(min(t), max(t), INTERVAL '{every}')) AS t FROM b GROUP BY 1) SELECT '{every}' AS every, cell_id, CAST(t AS VARCHAR) AS t, round(value, 4) AS value FROM r LEFT JOIN b USING (cell_id, t)"


_FREQUENCIES = (
    ("1 hour", "date_trunc('hour', ts)", True), ("6 hours", "time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01')", True), ("10 days", "time_bucket(INTERVAL '10 days', ts, TIMESTAMP '1970-01-01')", True),
    ("1 month", "CAST(date_trunc('month', ts) AS TIMESTAMP)", False),
)


@query(" UNION ALL ".join(f"SELECT * FROM ({_resample_sql(*x)})" for x in _FREQUENCIES))
def resampled(spark, d):
    e = stash(table(spark, d, "events").select(F.col("user_id").alias("cell_id"), F.col("ts").alias("t"), "value"))
    parts = [st.resample(e, "value", every, "max", fill=fill).select(F.lit(every).alias("every"), "cell_id", F.col("t").cast("string").alias("t"), "value") for every, _, fill in _FREQUENCIES]
    return rounded(io.concat(*parts))


@query(f"WITH {STATIC}, l AS (SELECT cell_id, mask_low AS mask FROM static UNION ALL SELECT cell_id, mask_lake FROM static UNION ALL SELECT cell_id, NULL FROM static) SELECT cell_id, coalesce(bool_or(mask), false) AS mask FROM l GROUP BY 1")
def combine_mask_layers(spark, d):
    long = g.stack_features(static(spark, d).withColumn("mask_none", F.lit(None).cast("boolean")), ["mask_low", "mask_lake", "mask_none"], ("cell_id",))
    return g.combine_mask_rows(long.withColumnRenamed("v", "mask"))


def _day_as_text(name: str) -> None:
    """Days as text, so that both engines show the same."""
    plain = QUERIES[name]
    QUERIES[name] = lambda spark, d: plain(spark, d).withColumn("t", F.col("t").cast("string"))
    SQL[name] = f"SELECT * REPLACE (CAST(t AS VARCHAR) AS t) FROM ({SQL[name]})"


for _name in ("spaef_by_time", "spaef_unit_range", "scale_minmax11", "unscale_roundtrip", "log10p", "time_aligned_dynamics", "missing_cells", "reconstruct_missing", "complete_and_fill", "time_index", "stack_features", "spread_features", "feature_vectors", "split_periods", "category_quantiles", "daily_maximum", "aligned_pairs"):
    _day_as_text(_name)
