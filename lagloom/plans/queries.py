"""Registered queries of the library's own operators, each beside its DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lag, text
from ..operators import baskets, exposure as ex, series
from ..session import shared_folder
from ..sources import ods
from ..sources.i18n import DATE_FORMATS, SHORT_DATE
from . import plot, simulate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# The event table as a diary: errors are outcomes, all other events are items (type and a number).
def observations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'error'")
    return e.select(F.col("user_id").alias("diary_id"), F.col("event_id").alias("obs_id"), lag.hours(F.col("ts")).alias("t_h"), F.col("value").alias("y"), "ts")


def entries(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type <> 'error'")
    item = F.concat("event_type", F.lit("_"), (F.get_json_object("props", "$.k").cast("int") % 8).cast("string"))
    return e.select(F.col("user_id").alias("diary_id"), F.col("event_id").alias("entry_id"), lag.hours(F.col("ts")).alias("t_h"), item.alias("item"))


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Baskets: the part types of an order."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entry_id"), F.col("l_partkey").alias("p_partkey"))
    return li.join(table(spark, d, "part").select("p_partkey", F.col("p_type").alias("item")), "p_partkey").select(F.lit(0).alias("diary_id"), "entry_id", "item")


def r4(c) -> F.col:
    """Four decimals, and no negative zero."""
    return F.round(c, 4) + 0.0


OBS = "obs AS (SELECT user_id AS diary_id, event_id AS obs_id, epoch_us(ts)/3.6e9 AS t_h, value AS y, ts FROM events WHERE event_type = 'error')"
ENT = "ent AS (SELECT user_id AS diary_id, event_id AS entry_id, epoch_us(ts)/3.6e9 AS t_h, event_type || '_' || (json_extract_string(props, '$.k')::INT % 8) AS item FROM events WHERE event_type <> 'error')"
KER = "ker(k, c, w) AS (VALUES (0,2e0,3e0),(1,5e0,4e0),(2,9e0,5e0),(3,15e0,8e0),(4,24e0,12e0),(5,40e0,18e0),(6,60e0,24e0))"
X = "x AS (SELECT o.diary_id, o.obs_id, e.item, k, sum(0.5e0*(1+cos(pi()*((o.t_h-e.t_h)-c)/w))) AS x FROM obs o JOIN ent e ON o.diary_id = e.diary_id AND o.t_h-e.t_h BETWEEN 0.25e0 AND 84e0 JOIN ker ON abs((o.t_h-e.t_h)-c) < w GROUP BY ALL)"
BASE = f"WITH {OBS}, {ENT}, {KER}, {X} "
BASKET = "b AS (SELECT DISTINCT l_orderkey AS entry_id, p_type AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"
PAIRS = f"{BASKET}, n AS (SELECT item, count(*) AS n FROM b GROUP BY 1), j AS (SELECT x.item AS a, y.item AS b, count(*) AS together FROM b x JOIN b y ON x.entry_id = y.entry_id AND x.item < y.item GROUP BY 1, 2), p AS (SELECT a, j.b, together, together / (na.n + nb.n - together)::DOUBLE AS jaccard FROM j JOIN n na ON na.item = a JOIN n nb ON nb.item = j.b)"
ROOTS = "r(item, root) AS (SELECT item, item FROM n UNION SELECT r.item, CASE WHEN p.a = r.root THEN p.b ELSE p.a END FROM r JOIN p ON p.jaccard >= 0.3 AND r.root IN (p.a, p.b)), l AS (SELECT item, min(root) AS root FROM r GROUP BY item), bl AS (SELECT item, root, string_agg(item, '+') OVER (PARTITION BY root ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS block FROM l)"


# ---- range join and exposures
def _x(s, d):
    return ex.exposure(observations(s, d), entries(s, d))


@query(BASE + "SELECT diary_id, obs_id, item, k, round(x, 4) AS x FROM x")
def exposure(s, d):
    return _x(s, d).withColumn("x", r4("x"))


@query(f"WITH {OBS}, {ENT} SELECT o.diary_id, o.obs_id, e.entry_id, e.item FROM obs o JOIN ent e ON o.diary_id = e.diary_id AND o.t_h - e.t_h BETWEEN 0.25e0 AND 84e0")
def lag_range_join(s, d):
    return ex.lag_join(observations(s, d), entries(s, d)).select("diary_id", "obs_id", "entry_id", "item")


@query(BASE + "SELECT diary_id, obs_id, item, round(sum(x), 4) AS x FROM x GROUP BY ALL")
def exposure_series(s, d):
    return ex.series(_x(s, d)).withColumn("x", r4("x"))


@query(BASE + "SELECT diary_id, obs_id, item, k, round(CASE WHEN item LIKE 'signup%' THEN -x ELSE x END, 4) + 0e0 AS x FROM x")
def signed_exposure(s, d):
    e = entries(s, d)
    return ex.signed(_x(s, d), e.where("item like 'signup%'")).withColumn("x", r4("x"))


@query(BASE + "SELECT diary_id, obs_id, item, CASE WHEN k < 2 THEN 0 WHEN k < 5 THEN 1 ELSE 2 END AS band, round(sum(x), 4) AS x FROM x GROUP BY ALL")
def band_exposure(s, d):
    return ex.bands(_x(s, d)).withColumn("x", r4("x"))


@query(BASE + "SELECT item, k, count(*) FILTER (x > 0) AS n FROM x GROUP BY ALL")
def exposed_counts(s, d):
    return _x(s, d).groupBy("item", "k").agg(F.count_if(F.col("x") > 0).alias("n"))


@query(BASE + ", g AS (SELECT diary_id, obs_id, k, sum(x) AS x FROM x GROUP BY ALL) SELECT a.k AS i, b.k AS j, round(sum(a.x*b.x), 4) AS s FROM g a JOIN g b ON a.obs_id = b.obs_id AND a.diary_id = b.diary_id AND a.k <= b.k GROUP BY ALL")
def gram_long(s, d):
    g = _x(s, d).groupBy("diary_id", "obs_id", "k").agg(F.sum("x").alias("x"))
    return ex.gram(g, "k").withColumn("s", r4("s"))


DAYS = "dy AS (SELECT *, floor((t_h - min(t_h) OVER (PARTITION BY diary_id))/24)::BIGINT AS day FROM obs), db AS (SELECT diary_id, day, ((row_number() OVER (PARTITION BY diary_id ORDER BY day) - 1)//3)::BIGINT AS block FROM (SELECT DISTINCT diary_id, day FROM dy)), xb AS (SELECT x.*, block, y FROM x JOIN dy USING (diary_id, obs_id) JOIN db USING (diary_id, day))"


def by_block(s, d):
    """Exposures with the day block and the outcome of their observation."""
    o = observations(s, d).withColumn("day", F.floor((F.col("t_h") - F.min("t_h").over(series.whole())) / 24))
    placed = o.join(series.day_blocks(observations(s, d)), ["diary_id", "day"]).select("diary_id", "obs_id", "block", "y")
    return _x(s, d).join(placed, ["diary_id", "obs_id"])


@query(BASE + f", {DAYS} SELECT a.diary_id, a.block, a.item AS i_item, a.k AS i_k, b.item AS j_item, b.k AS j_k, round(sum(a.x*b.x), 4) AS s FROM xb a JOIN xb b ON a.diary_id = b.diary_id AND a.obs_id = b.obs_id AND (a.item, a.k) <= (b.item, b.k) GROUP BY ALL")
def gram_blocks(s, d):
    """Gram matrix over (item, kernel) of each diary's day blocks, upper half."""
    return ex.gram_blocks(by_block(s, d)).withColumn("s", r4("s"))


@query(BASE + f", {DAYS} SELECT diary_id, block, item, k, round(sum(x*y), 4) AS xy, count(*) AS n FROM xb GROUP BY ALL")
def cross_moments(s, d):
    return by_block(s, d).groupBy("diary_id", "block", "item", "k").agg(r4(F.sum(F.col("x") * F.col("y"))).alias("xy"), F.count("*").alias("n"))


@query(BASE + "SELECT item, k, round(sqrt(sum(x*x)), 4) AS length FROM x GROUP BY ALL")
def column_norms(s, d):
    return _x(s, d).groupBy("item", "k").agg(r4(F.sqrt(F.sum(F.col("x") * F.col("x")))).alias("length"))


@query(BASE + ", c AS (SELECT count(*) AS n FROM obs) SELECT item, k, round(CASE WHEN sqrt(sum(x*x)/any_value(n)) < 1e-12 THEN 1e0 ELSE sqrt(sum(x*x)/any_value(n)) END, 4) AS scale FROM x, c GROUP BY ALL")
def rms_scale(s, d):
    n = observations(s, d).agg(F.count("*").alias("n"))
    scale = F.sqrt(F.sum(F.col("x") * F.col("x")) / F.first("n"))
    # one row
    return _x(s, d).join(F.broadcast(n)).groupBy("item", "k").agg(r4(F.when(scale < 1e-12, 1.0).otherwise(scale)).alias("scale"))


@query(BASE + ", c AS (SELECT count(*) AS n FROM obs) SELECT item, round(sum(x*(k+1)/10e0)/any_value(n), 4) AS effect FROM x, c GROUP BY item")
def mean_effect(s, d):
    """Effect of coefficients (k + 1) / 10: zero exposures count in the mean."""
    n = observations(s, d).agg(F.count("*").alias("n"))
    return _x(s, d).join(F.broadcast(n)).groupBy("item").agg(r4(F.sum(F.col("x") * (F.col("k") + 1) / 10) / F.first("n")).alias("effect"))


@query(BASE + ", m AS (SELECT diary_id, item, k, avg(x) AS mx, sqrt(sum(x*x)) AS raw, sqrt(sum(x*x) - count(*)*avg(x)*avg(x)) AS res FROM x GROUP BY ALL HAVING count(*) > 2) SELECT diary_id, item, round(max(CASE WHEN raw <= 1e-12 THEN 0e0 ELSE coalesce(res, 0e0)/raw END), 3) AS share FROM m GROUP BY ALL HAVING max(CASE WHEN raw <= 1e-12 THEN 0e0 ELSE coalesce(res, 0e0)/raw END) >= 0.1005")
def free_share(s, d):
    """Share of a column that a constant leaves free, best kernel per item; items under 10 % go."""
    m = _x(s, d).groupBy("diary_id", "item", "k").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.sum(F.col("x") * F.col("x")).alias("ss")).where("n > 2")
    raw, res = F.sqrt("ss"), F.sqrt(F.col("ss") - F.col("n") * F.col("mx") * F.col("mx"))
    share = F.max(F.when(raw <= 1e-12, 0.0).otherwise(F.coalesce(res, F.lit(0.0)) / raw))
    return m.groupBy("diary_id", "item").agg(share.alias("s")).where("s >= 0.1005").select("diary_id", "item", F.round("s", 3).alias("share"))


# Gram-Schmidt over the six controls, one column after the other
_Z = "z0 AS (SELECT o.diary_id, obs_id, 1e0 AS v0, sin(2*pi()*h/24) AS v1, cos(2*pi()*h/24) AS v2, sin(4*pi()*h/24) AS v3, cos(4*pi()*h/24) AS v4, (t_h - avg(t_h) OVER (PARTITION BY o.diary_id))/24 AS v5 FROM (SELECT *, hour(ts) + minute(ts)/60e0 AS h, count(*) OVER (PARTITION BY diary_id) AS n FROM obs) o WHERE n >= 10)"
for _i in range(6):
    _kept = ", ".join(f"v{j}" for j in range(_i))
    _turn = ", ".join(f"v{j} - sum(v{j}*q) OVER (PARTITION BY diary_id)*q AS v{j}" for j in range(_i + 1, 6))
    _norm = f"SELECT *, v{_i}/sqrt(sum(v{_i}*v{_i}) OVER (PARTITION BY diary_id)) AS q FROM z{_i}"
    _Z += f", z{_i + 1} AS (SELECT diary_id, obs_id{', ' + _kept if _kept else ''}, q AS v{_i}{', ' + _turn if _turn else ''} FROM ({_norm}))"


@query(BASE + f", {_Z}, m AS (SELECT diary_id, item, k, sum(x*x) AS xx, {', '.join(f'sum(x*v{j}) AS p{j}' for j in range(6))} FROM x JOIN z6 USING (diary_id, obs_id) GROUP BY ALL) SELECT diary_id, item, round(max(CASE WHEN xx <= 1e-24 THEN 0e0 ELSE sqrt(greatest(xx - {' - '.join(f'p{j}*p{j}' for j in range(6))}, 0e0)/xx) END), 3) AS share FROM m GROUP BY ALL")
def free_share_controls(s, d):
    """Share of an item's exposure that the six controls leave free, best kernel per item; diaries of 10 readings on."""
    o = observations(s, d).withColumn("n", F.count("*").over(series.whole())).where("n >= 10")
    z = series.controls(o, lag.hour_of_day(F.col("ts"))).select("diary_id", "obs_id", F.array(*(f"z{i}" for i in range(6))).alias("z"))
    m = _x(s, d).join(series.orthonormal(z), ["diary_id", "obs_id"]).groupBy("diary_id", "item", "k").agg(
        F.sum(F.col("x") * F.col("x")).alias("xx"), *(F.sum(F.col("x") * F.col("q")[i]).alias(f"p{i}") for i in range(6))
    )
    left = F.greatest(F.col("xx") - sum((F.col(f"p{i}") * F.col(f"p{i}") for i in range(6)), F.lit(0.0)), F.lit(0.0))
    share = F.max(F.when(F.col("xx") <= 1e-24, 0.0).otherwise(F.sqrt(left / F.col("xx"))))
    return m.groupBy("diary_id", "item").agg(F.round(share, 3).alias("share"))


@query(BASE + ", c AS (SELECT item, k, sum(x*y) AS c FROM x JOIN obs USING (diary_id, obs_id) GROUP BY ALL) SELECT round(max(g), 4) AS lambda_max FROM (SELECT sqrt(sum(greatest(c, 0)*greatest(c, 0)))/sqrt(7e0) AS g FROM c GROUP BY item)")
def lambda_max(s, d):
    o = observations(s, d).select("diary_id", "obs_id", "y")
    c = _x(s, d).join(o, ["diary_id", "obs_id"]).groupBy("item", "k").agg(F.sum(F.col("x") * F.col("y")).alias("c"))
    p = F.greatest("c", F.lit(0.0))
    return c.groupBy("item").agg((F.sqrt(F.sum(p * p)) / F.sqrt(F.lit(7.0))).alias("g")).agg(r4(F.max("g")).alias("lambda_max"))


@query(f"WITH {KER}, t AS (SELECT unnest(range(1, 100))::DOUBLE AS d) SELECT d, k, round(CASE WHEN abs((d-c)/w) < 1 THEN 0.5e0*(1+cos(pi()*(d-c)/w)) ELSE 0 END, 4) AS weight FROM t, ker")
def kernel_curve(s, d):
    t = s.range(1, 100).select(F.col("id").cast("double").alias("d"))
    return t.crossJoin(F.broadcast(lag.kernel_table(s))).select("d", "k", r4(lag.kernel(F.col("d"), F.col("c"), F.col("w"))).alias("weight"))


@query(f"WITH {KER}, g AS (SELECT i*84e0/399 AS d FROM (SELECT unnest(range(400)) AS i)), it(item, a) AS (VALUES ('p', 0), ('q', 3), ('s', 6)), h AS (SELECT item, d, sum(CASE WHEN abs((d-c)/w) < 1 AND d >= 0.25e0 THEN 0.5e0*(1+cos(pi()*(d-c)/w)) ELSE 0 END * (1 + (k+a)%7)/7e0) AS h FROM g, ker, it GROUP BY ALL) SELECT item, round(d, 4) AS lag_h, round(h, 4) AS peak FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY round(h, 9) DESC, d) AS i FROM h) WHERE i = 1 AND h > 1e-9")
def response_peak(s, d):
    """First maximum of a response over the 400-point grid, for three made-up coefficient rows."""
    g = s.range(400).select((F.col("id") * 84.0 / 399).alias("d"))
    it = s.createDataFrame([("p", 0), ("q", 3), ("s", 6)], "item string, a int")
    w = lag.kernel(F.col("d"), F.col("c"), F.col("w")) * (1 + (F.col("k") + F.col("a")) % 7) / 7.0
    h = g.crossJoin(F.broadcast(lag.kernel_table(s))).crossJoin(F.broadcast(it)).groupBy("item", "d").agg(F.sum(w).alias("h"))
    first = F.row_number().over(Window.partitionBy("item").orderBy(F.desc(F.round("h", 9)), "d"))
    return h.withColumn("i", first).where("i = 1 and h > 1e-9").select("item", r4("d").alias("lag_h"), r4("h").alias("peak"))


@query(f"WITH {OBS}, {ENT}, a AS (SELECT o.diary_id, o.obs_id, sum(2e0*CASE WHEN abs((o.t_h-e.t_h-6)/7) < 1 AND o.t_h >= e.t_h THEN 0.5e0*(1+cos(pi()*(o.t_h-e.t_h-6)/7)) ELSE 0 END) AS v FROM obs o JOIN ent e ON o.diary_id = e.diary_id AND o.t_h-e.t_h BETWEEN 0.25e0 AND 84e0 AND e.item LIKE 'click%' GROUP BY ALL) SELECT diary_id, obs_id, round(v, 4) + 0e0 AS signal FROM a")
def sim_signal(s, d):
    """The generator's additive response of one kind of item, delay 6 h and size 2."""
    pairs = ex.lag_join(observations(s, d), entries(s, d).where("item like 'click%'"))
    return pairs.groupBy("diary_id", "obs_id").agg(r4(F.sum(2.0 * lag.bump(F.col("d"), 6.0))).alias("signal"))


# ---- series, windows
@query(f"WITH {OBS} SELECT diary_id, obs_id, round(t_h - lag(t_h) OVER (PARTITION BY diary_id ORDER BY t_h, obs_id), 4) AS dt FROM obs")
def gap(s, d):
    return series.gaps(observations(s, d)).select("diary_id", "obs_id", r4("dt").alias("dt"))


@query(f"WITH {OBS}, g AS (SELECT diary_id, t_h - lag(t_h) OVER (PARTITION BY diary_id ORDER BY t_h, obs_id) AS dt FROM obs) SELECT diary_id, round(median(dt), 4) AS median_dt FROM g GROUP BY 1")
def median_gap(s, d):
    return series.median_gap(observations(s, d)).withColumn("median_dt", r4("median_dt"))


RHO = f"{OBS}, m AS (SELECT *, y - avg(y) OVER (PARTITION BY diary_id) AS r FROM obs), q AS (SELECT *, lag(r) OVER o AS p, lag(y) OVER o AS py, t_h - lag(t_h) OVER o AS dt FROM m WINDOW o AS (PARTITION BY diary_id ORDER BY t_h, obs_id)), rho AS (SELECT diary_id, least(greatest(coalesce(sum(p*r), 0e0)/greatest(coalesce(sum(p*p), 0e0), 1e-9), 0e0), 0.9e0) AS rho, median(dt) AS md FROM q GROUP BY 1)"


@query(f"WITH {RHO} SELECT diary_id, round(rho, 4) AS rho FROM rho")
def ar1_rho(s, d):
    return series.rho(series.demeaned(observations(s, d))).withColumn("rho", r4("rho"))


@query(f"WITH {RHO} SELECT q.diary_id, obs_id, round(y - pow(rho, dt/greatest(md, 1e-6))*py, 4) + 0e0 AS y_w FROM q JOIN rho USING (diary_id) WHERE dt IS NOT NULL")
def whitened_y(s, d):
    return series.whitened(observations(s, d)).select("diary_id", "obs_id", r4("y_w").alias("y_w"))


@query(f"WITH {OBS}, g AS (SELECT DISTINCT diary_id, floor((t_h - min(t_h) OVER (PARTITION BY diary_id))/24)::BIGINT AS day FROM obs) SELECT diary_id, day, ((row_number() OVER (PARTITION BY diary_id ORDER BY day) - 1)//3)::BIGINT AS block FROM g")
def day_blocks(s, d):
    return series.day_blocks(observations(s, d))


@query(f"WITH {OBS}, z AS (SELECT *, hour(ts) + minute(ts)/60e0 AS hod FROM obs) SELECT diary_id, obs_id, 1e0 AS z0, round(sin(2*pi()*hod/24), 4) + 0e0 AS z1, round(cos(2*pi()*hod/24), 4) + 0e0 AS z2, round(sin(4*pi()*hod/24), 4) + 0e0 AS z3, round(cos(4*pi()*hod/24), 4) + 0e0 AS z4, round((t_h - avg(t_h) OVER (PARTITION BY diary_id))/24, 3) + 0e0 AS z5 FROM z")
def controls(s, d):
    z = series.controls(observations(s, d), lag.hour_of_day(F.col("ts")))
    return z.select("diary_id", "obs_id", "z0", *((F.round(f"z{i}", 4 if i < 5 else 3) + 0.0).alias(f"z{i}") for i in range(1, 6)))


@query(f"WITH {OBS}, o AS (SELECT diary_id, obs_id, t_h - min(t_h) OVER (PARTITION BY diary_id) AS t_h, y FROM obs), f AS (SELECT diary_id, regr_slope(y, t_h) AS b, avg(y) AS my, avg(t_h) AS mt FROM o GROUP BY 1) SELECT o.diary_id, obs_id, round(y - my - coalesce(CASE WHEN isfinite(b) THEN b END, 0e0)*(t_h - mt), 4) + 0e0 AS r FROM o JOIN f USING (diary_id)")
def fwl_residual(s, d):
    o = observations(s, d).withColumn("t_h", F.col("t_h") - F.min("t_h").over(series.whole()))
    return series.drift_residual(o).withColumn("r", r4("r"))


@query(f"WITH {OBS} SELECT diary_id, obs_id, floor((t_h - min(t_h) OVER (PARTITION BY diary_id))/96)::BIGINT AS fold FROM obs")
def cv_blocks(s, d):
    return observations(s, d).select("diary_id", "obs_id", F.floor((F.col("t_h") - F.min("t_h").over(series.whole())) / 96).alias("fold"))


@query(f"WITH {OBS} SELECT diary_id, obs_id, round(t_h - min(t_h) OVER (PARTITION BY diary_id), 4) AS hours FROM obs")
def hours_since_origin(s, d):
    return observations(s, d).select("diary_id", "obs_id", r4(F.col("t_h") - F.min("t_h").over(series.whole())).alias("hours"))


@query("SELECT event_id, round((epoch_us(ts) - first_value(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))/3.6e9, 4) AS hours FROM events")
def hours_since_first_row(s, d):
    """Hours since the first row of a diary, whatever its time."""
    return table(s, d, "events").select("event_id", r4(lag.since_first(F.col("ts"), F.col("event_id"), ["user_id"])).alias("hours"))


@query(f"WITH {OBS} SELECT obs_id, round(hour(ts) + minute(ts)/60e0, 4) AS hod FROM obs")
def hour_of_day(s, d):
    return observations(s, d).select("obs_id", r4(lag.hour_of_day(F.col("ts"))).alias("hod"))


@query(f"WITH {OBS}, h AS (SELECT obs_id, t_h - min(t_h) OVER () AS h FROM obs) SELECT obs_id, floor(h/24)::BIGINT AS day, round(h - 24*floor(h/24), 4) AS hour FROM h")
def day_hour_split(s, d):
    o = observations(s, d)
    start = o.agg(F.min("t_h").alias("start"))
    return o.join(F.broadcast(start)).select("obs_id", F.floor((F.col("t_h") - F.col("start")) / 24).alias("day"), r4(F.pmod(F.col("t_h") - F.col("start"), F.lit(24.0))).alias("hour"))


@query(f"WITH {OBS} SELECT diary_id, obs_id, row_number() OVER (PARTITION BY diary_id ORDER BY t_h, obs_id) AS place FROM obs")
def chrono_sort(s, d):
    return observations(s, d).select("diary_id", "obs_id", F.row_number().over(series.ordered()).cast("long").alias("place"))


@query(f"WITH {OBS} SELECT obs_id, row_number() OVER (PARTITION BY diary_id ORDER BY obs_id) + 1 AS line_no FROM obs WHERE round(y)::BIGINT % 3 <> 0")
def line_numbers(s, d):
    """Lines count from 2 on; blank ones (here: outcomes divisible by 3) don't."""
    o = observations(s, d).where(F.round("y").cast("long") % 3 != 0)
    return o.select("obs_id", (F.row_number().over(Window.partitionBy("diary_id").orderBy("obs_id")) + 1).cast("long").alias("line_no"))


# ---- baskets and names
@query(f"WITH {PAIRS} SELECT a, b, together, round(jaccard, 6) AS jaccard FROM p")
def jaccard_pairs(s, d):
    return baskets.jaccard(parts(s, d), ["diary_id"]).select("a", "b", "together", F.round("jaccard", 6).alias("jaccard"))


@query(f"WITH RECURSIVE {PAIRS}, {ROOTS} SELECT item, root FROM l")
def item_components(s, d):
    p = parts(s, d)
    return baskets.components(p, baskets.jaccard(p, ["diary_id"]).where("jaccard >= 0.3"), ["diary_id"]).select("item", "root")


@query(f"WITH RECURSIVE {PAIRS}, {ROOTS} SELECT item, block FROM bl")
def block_names(s, d):
    return baskets.fuse(parts(s, d), ["diary_id"], 0.3, grouped=False).select("item", "block")


@query(f"WITH RECURSIVE {PAIRS}, {ROOTS} SELECT DISTINCT entry_id, block FROM b JOIN bl USING (item)")
def events_to_blocks(s, d):
    p = parts(s, d).withColumn("t_h", F.lit(0.0))
    return baskets.block_events(p, baskets.fuse(p, ["diary_id"], 0.3, grouped=False), ["diary_id"]).select("entry_id", "block")


@query(f"WITH RECURSIVE {PAIRS}, {ROOTS} SELECT block, count(DISTINCT entry_id) AS n FROM b JOIN bl USING (item) GROUP BY 1")
def block_occurrences(s, d):
    return events_to_blocks(s, d).groupBy("block").agg(F.count("*").alias("n"))


@query(f"WITH {ENT} SELECT diary_id, item, count(DISTINCT entry_id) AS n FROM ent GROUP BY 1, 2")
def item_counts(s, d):
    return baskets.item_counts(entries(s, d), ["diary_id"])


@query(f"WITH {ENT} SELECT diary_id, item FROM ent GROUP BY 1, 2 HAVING count(DISTINCT entry_id) >= 3")
def items_frequent(s, d):
    return item_counts(s, d).where("n >= 3").select("diary_id", "item")


@query(f"WITH {ENT}, c AS (SELECT diary_id, item, count(DISTINCT entry_id) AS n FROM ent GROUP BY 1, 2 HAVING count(DISTINCT entry_id) < 3) SELECT diary_id, item, n FROM c WHERE item NOT LIKE 'signup%' UNION ALL SELECT diary_id, item, n FROM c WHERE item LIKE 'signup%'")
def discarded(s, d):
    few = item_counts(s, d).where("n < 3")
    return few.where("item not like 'signup%'").unionByName(few.where("item like 'signup%'"))


@query(f"WITH {ENT} SELECT DISTINCT item FROM ent")
def distinct_items(s, d):
    return entries(s, d).select("item").distinct()


@query(f"WITH {ENT} SELECT diary_id, list_contains(list(item), 'click_0') AS has_item FROM ent GROUP BY 1")
def item_membership(s, d):
    return entries(s, d).groupBy("diary_id").agg(F.collect_set("item").alias("items")).select("diary_id", F.array_contains("items", "click_0").alias("has_item"))


@query(f"WITH {ENT} SELECT diary_id, item FROM (SELECT DISTINCT diary_id, item FROM ent WHERE item LIKE 'signup%') r WHERE NOT EXISTS (SELECT 1 FROM ent e WHERE e.diary_id = r.diary_id AND e.item = replace(r.item, 'signup', 'click'))")
def reliever_antijoin(s, d):
    """Relievers without an item of the same number."""
    e = entries(s, d)
    r = e.where("item like 'signup%'").select("diary_id", "item").distinct()
    taken = e.where("item like 'click%'").select("diary_id", F.replace("item", F.lit("click"), F.lit("signup")).alias("item"))
    return r.join(taken, ["diary_id", "item"], "left_anti")


@query(f"WITH {ENT} SELECT diary_id, entry_id, item, 1 AS sign FROM ent WHERE item NOT LIKE 'signup%' UNION ALL SELECT diary_id, entry_id, item, -1 FROM ent WHERE item LIKE 'signup%'")
def events_union(s, d):
    e = entries(s, d).select("diary_id", "entry_id", "item")
    return e.where("item not like 'signup%'").withColumn("sign", F.lit(1)).unionByName(e.where("item like 'signup%'").withColumn("sign", F.lit(-1)))


@query("SELECT l_orderkey AS entry_id, array_to_string(list_sort(list_distinct(list_concat(list(p_type), CASE WHEN count(*) FILTER (p_type = (SELECT min(p_type) FROM part)) > 0 THEN [(SELECT max(p_type) FROM part)] ELSE [] END))), ';') AS items FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def pair_completion(s, d):
    """An entry with the first part type also gets the last: inseparable items come together."""
    ends = table(s, d, "part").agg(F.min("p_type").alias("lo"), F.max("p_type").alias("hi"))
    e = parts(s, d).groupBy("entry_id").agg(F.collect_set("item").alias("items")).join(F.broadcast(ends))
    both = F.when(F.array_contains("items", F.col("lo")), F.array_union("items", F.array("hi"))).otherwise(F.col("items"))
    return e.select("entry_id", F.array_join(F.array_sort(both), ";").alias("items"))


@query("WITH n AS (SELECT DISTINCT c_name AS n FROM customer) SELECT a.n AS a, b.n AS b FROM n a JOIN n b ON a.n < b.n AND a.n[1] = b.n[1] AND abs(length(a.n) - length(b.n)) <= 1 AND levenshtein(a.n, b.n) <= 1")
def near_duplicate_names(s, d):
    return text.near_names(table(s, d, "customer").select(F.col("c_name").alias("item")))


@query("SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(strip_accents(text)), '[-_\\s]+'), lambda x: x <> ''), '_') AS name FROM documents")
def normalize_names(s, d):
    return text.normalize_column(table(s, d, "documents").select("doc_id", F.col("text").alias("t")), "t", "name").select("doc_id", "name")


@query("SELECT p_partkey, replace(trim(split_part(lower(trim(p_name || ' (' || p_size || ')')), '(', 1)), ' ', '_') AS header FROM part")
def normalize_header(s, d):
    p = table(s, d, "part")
    return p.select("p_partkey", text.header(F.concat("p_name", F.lit(" ("), F.col("p_size").cast("string"), F.lit(")"))).alias("header"))


# ---- diary parsing on texts made from orders
LINES = "ln AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN 'junk' WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%-m/%-d/%Y') END AS date, CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN '99:99' ELSE (o_orderkey % 24) || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') END AS time, CASE WHEN o_orderkey % 17 = 0 THEN 'abc' WHEN o_orderkey % 3 = 0 THEN '' ELSE ' ' || (o_orderkey % 10) || ',5' END AS pain, o_orderpriority || ';' || o_orderstatus || '; ;' || o_orderstatus AS foods FROM orders)"
PARSED = f"{LINES}, p AS (SELECT *, CASE WHEN date LIKE '%/%' THEN strptime(date, '%m/%d/%Y') WHEN date LIKE '____-%' THEN strptime(date, '%Y-%m-%d') END AS d, CASE WHEN time NOT IN ('', '99:99') THEN split_part(time, ':', 1)::INT * 60 + split_part(time, ':', 2)::INT END AS m, try_cast(replace(trim(pain), ',', '.') AS DOUBLE) AS y FROM ln)"


def lines(s, d):
    k = F.col("o_orderkey")
    return table(s, d, "orders").select(
        k.alias("id"),
        F.when(k % 11 == 0, "").when(k % 13 == 0, "junk").when(k % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "M/d/yyyy")).alias("date"),
        F.when(k % 5 == 0, "").when(k % 7 == 0, "99:99").otherwise(F.concat((k % 24).cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"))).alias("time"),
        F.when(k % 17 == 0, "abc").when(k % 3 == 0, "").otherwise(F.concat(F.lit(" "), (k % 10).cast("string"), F.lit(",5"))).alias("pain"),
        F.concat("o_orderpriority", F.lit(";"), "o_orderstatus", F.lit("; ;"), "o_orderstatus").alias("foods"),
    )


def parsed(s, d):
    from ..sources.diary import parse

    return parse(lines(s, d).withColumnRenamed("id", "line_no"))


@query(f"WITH {PARSED} SELECT id, strftime(d + to_minutes(coalesce(m, 720)), '%Y-%m-%d %H:%M') AS ts, y AS outcome FROM p WHERE d IS NOT NULL")
def diary_parse(s, d):
    return parsed(s, d).where("ts is not null").select(F.col("line_no").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"), "outcome")


@query(f"WITH {PARSED} SELECT id, 'bad_date' AS code, date AS arg FROM p WHERE d IS NULL AND date <> '' UNION ALL SELECT id, 'bad_time', time FROM p WHERE d IS NOT NULL AND m IS NULL AND time <> '' UNION ALL SELECT id, 'bad_outcome', trim(pain) FROM p WHERE d IS NOT NULL AND y IS NULL AND trim(pain) <> ''")
def diary_rejects(s, d):
    p, kept = parsed(s, d).withColumnRenamed("line_no", "id"), F.col("ts").isNotNull()
    said = lambda cond, code, arg: p.where(cond).select("id", F.lit(code).alias("code"), F.col(arg).alias("arg"))
    return said(F.col("date_problem") == "bad_date", "bad_date", "date_text").unionByName(said(kept & (F.col("time_problem") == "bad_time"), "bad_time", "time_text")).unionByName(said(kept & F.col("outcome_problem").isNotNull(), "bad_outcome", "outcome_text"))


@query(f"WITH {PARSED} SELECT count(*) AS n FROM p WHERE d IS NOT NULL AND time = ''")
def diary_default_time(s, d):
    return parsed(s, d).where("ts is not null and time_problem = 'default_time'").agg(F.count("*").alias("n"))


@query(f"WITH {LINES} SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(foods, ';'), lambda x: replace(trim(regexp_replace(lower(x), '[-_\\s]+', ' ', 'g')), ' ', '_')), lambda x: x <> ''))), ';') AS items FROM ln")
def items_parse(s, d):
    return lines(s, d).select("id", F.array_join(text.item_list(F.col("foods")), ";").alias("items"))


@query(f"WITH {PARSED} SELECT id, y AS outcome FROM p")
def outcome_parse(s, d):
    return lines(s, d).select("id", text.number(F.col("pain")).alias("outcome"))


@query(f"WITH {PARSED} SELECT id, strftime(d, '%Y-%m-%d') AS day FROM p")
def parse_dates(s, d):
    return lines(s, d).select("id", F.date_format(text.parsed_date(F.col("date"), DATE_FORMATS["en"]), "yyyy-MM-dd").alias("day"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE (o_orderkey % 24) * 60 + o_orderkey % 60 END AS minutes FROM orders")
def parse_times(s, d):
    """Times written as 8:05, 08:05:00 or 8:05am, some unreadable."""
    k = F.col("o_orderkey")
    h, m = k % 24, F.lpad((k % 60).cast("string"), 2, "0")
    twelve = F.concat(F.when(h % 12 == 0, 12).otherwise(h % 12).cast("string"), F.lit(":"), m, F.when(k % 2 == 0, " ").otherwise(""), F.when(h < 12, "AM").otherwise("pm"))
    t = F.when(k % 9 == 0, "13:05pm").when(k % 3 == 0, twelve).when(k % 3 == 1, F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":"), m, F.lit(":59"))).otherwise(F.concat(h.cast("string"), F.lit(":"), m))
    return table(s, d, "orders").select("o_orderkey", text.parsed_minutes(t).cast("long").alias("minutes"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%-m/%-d/%y') AS en, strftime(o_orderdate, '%d/%m/%Y') AS fr, strftime(o_orderdate, '%H:%M') AS hm FROM orders")
def format_dates(s, d):
    t = F.col("o_orderdate")
    return table(s, d, "orders").select("o_orderkey", F.date_format(t, SHORT_DATE["en"]).alias("en"), F.date_format(t, SHORT_DATE["fr"]).alias("fr"), F.date_format(t, "HH:mm").alias("hm"))


@query(f"WITH {PARSED} SELECT 'entry' AS series, count(*) AS n FROM p WHERE d IS NOT NULL AND foods <> '' UNION ALL SELECT 'observation', count(*) FROM p WHERE d IS NOT NULL AND y IS NOT NULL")
def series_split(s, d):
    p = parsed(s, d).where("ts is not null")
    one = lambda name, rows: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("series"), "n")
    return one("entry", p.where(F.size(text.item_list(F.col("foods"))) > 0)).unionByName(one("observation", p.where("outcome is not null")))


@query(f"WITH {OBS}, {ENT}, o AS (SELECT diary_id FROM obs GROUP BY 1 HAVING count(*) >= 10), e AS (SELECT diary_id FROM ent GROUP BY 1 HAVING count(*) >= 5) SELECT diary_id FROM o SEMI JOIN e USING (diary_id)")
def gate_min_size(s, d):
    n = lambda df, least: df.groupBy("diary_id").agg(F.count("*").alias("n")).where(f"n >= {least}").select("diary_id")
    return n(observations(s, d), 10).join(n(entries(s, d), 5), "diary_id", "left_semi")


# ---- resampling and reports
REPS = f"{OBS}, g AS (SELECT DISTINCT diary_id, floor((t_h - min(t_h) OVER (PARTITION BY diary_id))/24)::BIGINT AS day FROM obs), bl AS (SELECT diary_id, day, ((row_number() OVER (PARTITION BY diary_id ORDER BY day) - 1)//3)::BIGINT AS block FROM g), rep AS (SELECT r, b FROM (SELECT unnest(range(20)) AS r), (SELECT unnest(range(10)) AS b) WHERE (r*7 + b*b*3) % 5 < 2), ob AS (SELECT o.*, block FROM (SELECT *, floor((t_h - min(t_h) OVER (PARTITION BY diary_id))/24)::BIGINT AS day FROM obs) o JOIN bl USING (diary_id, day)), rr AS (SELECT r AS rep, diary_id, obs_id, y FROM ob JOIN rep ON block = b)"


def replicate_plan(s):
    """20 made-up draws of day blocks (the analysis draws its own with NumPy)."""
    return s.range(20).select(F.col("id").alias("rep")).crossJoin(s.range(10).select(F.col("id").alias("block"))).where("(rep * 7 + block * block * 3) % 5 < 2")


@query(f"WITH {REPS} SELECT rep, diary_id, obs_id FROM rr")
def replicate_rows(s, d):
    o = observations(s, d).withColumn("day", F.floor((F.col("t_h") - F.min("t_h").over(series.whole())) / 24))
    b = o.join(series.day_blocks(observations(s, d)), ["diary_id", "day"])
    return b.join(F.broadcast(replicate_plan(s)), "block").select("rep", "diary_id", "obs_id")


@query(f"WITH {REPS} SELECT rep, diary_id, count(*) AS n FROM rr GROUP BY 1, 2 HAVING count(*) >= 8")
def replicate_valid(s, d):
    return replicate_rows(s, d).groupBy("rep", "diary_id").agg(F.count("*").alias("n")).where("n >= 8")


@query("SELECT r AS rep, l AS li, user_id AS diary_id FROM (SELECT unnest(range(20)) AS r), (SELECT unnest(range(6)) AS l), (SELECT DISTINCT user_id FROM events)")
def replicate_grid(s, d):
    ids = table(s, d, "events").select(F.col("user_id").alias("diary_id")).distinct()
    grid = s.range(20).select(F.col("id").alias("rep")).crossJoin(s.range(6).select(F.col("id").alias("li")))
    # 120 rows
    return ids.crossJoin(F.broadcast(grid)).select("rep", "li", "diary_id")


FREQ = f"{ENT}, c AS (SELECT diary_id, item, entry_id % 6 AS li, count(*) FILTER (entry_id % 3 = 0) AS n, 40 AS valid FROM ent GROUP BY ALL), f AS (SELECT item AS block, max(n)*10/any_value(valid)::DOUBLE AS frequency, CASE WHEN item LIKE 'signup%' THEN -1 ELSE 1 END AS sign FROM c GROUP BY item)"


def frequencies(s, d):
    """A made-up table of selection counts: (block, frequency, sign)."""
    c = entries(s, d).groupBy("diary_id", "item", (F.col("entry_id") % 6).alias("li")).agg(F.count_if(F.col("entry_id") % 3 == 0).alias("n"))
    return c.groupBy(F.col("item").alias("block")).agg((F.max("n") * 10 / 40.0).alias("frequency")).withColumn("sign", F.when(F.col("block").startswith("signup"), -1).otherwise(1))


@query(f"WITH {FREQ} SELECT block, round(frequency, 4) AS frequency FROM f")
def selection_frequency(s, d):
    return frequencies(s, d).select("block", r4("frequency").alias("frequency"))


@query(f"WITH {FREQ}, q AS (SELECT *, row_number() OVER (ORDER BY frequency DESC, block) AS rn, count(*) FILTER (frequency >= 0.7) OVER () AS n_sel FROM f) SELECT block, round(frequency, 4) AS frequency FROM q WHERE (n_sel >= 2 AND frequency >= 0.7) OR (n_sel < 2 AND rn <= 2)")
def candidates(s, d):
    # one row for each block of a report
    f = frequencies(s, d)
    n = f.agg(F.count_if(F.col("frequency") >= 0.7).alias("n_sel"))
    best = f.orderBy(F.desc("frequency"), "block").limit(2).select("block", F.lit(True).alias("best"))
    return f.join(F.broadcast(n)).join(F.broadcast(best), "block", "left").where("(n_sel >= 2 and frequency >= 0.7) or (n_sel < 2 and best)").select("block", r4("frequency").alias("frequency"))


@query(f"WITH {FREQ} SELECT block, round(frequency, 4) AS frequency, sign FROM f WHERE frequency >= 0.15 ORDER BY f.frequency DESC, block LIMIT 12")
def report_top(s, d):
    from .report import top

    return top(frequencies(s, d)).select("block", r4("frequency").alias("frequency"), "sign")


@query(f"WITH {FREQ} SELECT block FROM f WHERE sign > 0 AND frequency >= 0.7 ORDER BY frequency DESC, block LIMIT 3")
def advice_top3(s, d):
    from .report import advice

    return advice(frequencies(s, d)).select("block")


@query(f"WITH {FREQ} SELECT block, count(*) AS n FROM f WHERE frequency >= 0.5 AND block NOT LIKE 'click%' GROUP BY 1")
def eval_false_pos(s, d):
    from .evaluate import false_positives

    f = frequencies(s, d).withColumn("selected", F.col("frequency") >= 0.5).withColumn("diary_id", F.lit(0))
    truth = f.where("block like 'click%'").select("diary_id", F.col("block").alias("item"))
    return false_positives(f, truth)


@query(f"WITH {ENT}, sel AS (SELECT diary_id, item, count(*) AS n, avg(entry_id % 50)::DOUBLE AS lag FROM ent GROUP BY 1, 2 HAVING count(*) >= 3), t(item, lag_h) AS (VALUES ('click_0', 10e0), ('view_1', 20e0), ('purchase_2', 30e0)), ids AS (SELECT DISTINCT diary_id FROM ent), h AS (SELECT i.diary_id, count(s.item) AS hit, median(abs(s.lag - t.lag_h)) AS err FROM ids i CROSS JOIN t LEFT JOIN sel s ON s.diary_id = i.diary_id AND s.item = t.item GROUP BY 1), m AS (SELECT diary_id, count(*) AS n FROM sel GROUP BY 1) SELECT h.diary_id, round(hit/3e0, 4) AS recall, round(CASE WHEN coalesce(n, 0) = 0 THEN 1 ELSE hit/n::DOUBLE END, 4) AS precision, round(err, 4) AS err_lag_h, (coalesce(n, 0) - hit)::BIGINT AS false_positives FROM h LEFT JOIN m USING (diary_id)")
def eval_metrics(s, d):
    from .evaluate import diary_scores

    e = entries(s, d)
    results = e.groupBy("diary_id", F.col("item").alias("block")).agg(F.count("*").alias("n"), F.avg(F.col("entry_id") % 50).alias("lag_h")).withColumn("selected", F.col("n") >= 3)
    t = s.createDataFrame([("click_0", 10.0), ("view_1", 20.0), ("purchase_2", 30.0)], "item string, lag_h double")
    out = diary_scores(results, e.select("diary_id").distinct().crossJoin(F.broadcast(t)))
    return out.select("diary_id", r4("recall").alias("recall"), r4("precision").alias("precision"), r4("err_lag_h").alias("err_lag_h"), F.col("false_positives").cast("long").alias("false_positives"))


# ---- joins on time
@query(f"WITH {OBS}, {ENT} SELECT obs_id, entry_id FROM (SELECT obs_id, diary_id, round(t_h, 0) AS t FROM obs) o LEFT JOIN (SELECT entry_id, diary_id, round(t_h, 0) AS t FROM ent) e USING (diary_id, t)")
def rounded_time_join(s, d):
    o = observations(s, d).select("diary_id", "obs_id", F.round("t_h", 0).alias("t"))
    return o.join(entries(s, d).select("diary_id", "entry_id", F.round("t_h", 0).alias("t")), ["diary_id", "t"], "left").select("obs_id", "entry_id")


@query(f"WITH {OBS}, sl(i, slot, h) AS (VALUES (0, 'breakfast', 8e0), (1, 'lunch', 12.5e0), (2, 'dinner', 19e0)), q AS (SELECT obs_id, slot, row_number() OVER (PARTITION BY obs_id ORDER BY abs(hour(ts) + minute(ts)/60e0 - h), i) AS n FROM obs, sl) SELECT obs_id, slot FROM q WHERE n = 1")
def nearest_slot(s, d):
    h = lag.hour_of_day(F.col("ts"))
    near = F.array_min(F.array(*(F.struct(F.abs(h - at).alias("far"), F.lit(i).alias("i"), F.lit(slot).alias("slot")) for i, (slot, at) in enumerate(simulate.SLOTS))))
    return observations(s, d).select("obs_id", near["slot"].alias("slot"))


@query("WITH a AS (SELECT user_id, ts, true AS flag FROM events WHERE event_type = 'click'), b AS (SELECT user_id, ts, value FROM events WHERE event_type = 'error') SELECT user_id, epoch_us(ts) AS us, coalesce(flag, false) AS flag, value FROM a FULL JOIN b USING (user_id, ts)")
def full_outer_flag(s, d):
    e = table(s, d, "events")
    a = e.where("event_type = 'click'").select("user_id", "ts", F.lit(True).alias("flag"))
    b = e.where("event_type = 'error'").select("user_id", "ts", "value")
    return a.join(b, ["user_id", "ts"], "full_outer").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.coalesce("flag", F.lit(False)).alias("flag"), "value")


# ---- scalar functions
@query("SELECT l_orderkey, l_linenumber, round_even(l_quantity/2, 0)::BIGINT AS half_even FROM lineitem")
def bankers_round(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") / 2, 0).cast("long").alias("half_even"))


@query("SELECT event_id, round(least(greatest(value/10, 0e0), 10e0), 4) + 0e0 AS clipped FROM events")
def clip_values(s, d):
    return table(s, d, "events").select("event_id", r4(lag.clip(F.col("value") / 10, 0.0, 10.0)).alias("clipped"))


@query("SELECT i, round(pow(10e0, -2e0*i/49), 4) AS factor FROM (SELECT unnest(range(50)) AS i)")
def lambda_path(s, d):
    return s.range(50).select(F.col("id").alias("i"), r4(F.pow(F.lit(10.0), -2.0 * F.col("id") / 49)).alias("factor"))


@query("SELECT n, i, round_even(i*(n-1)/5e0, 0)::BIGINT AS place FROM (SELECT unnest(range(7, 50)) AS n), (SELECT unnest(range(6)) AS i)")
def lambda_subset(s, d):
    n, i = s.range(7, 50).select(F.col("id").alias("n")), s.range(6).select(F.col("id").alias("i"))
    return n.crossJoin(i).select("n", "i", F.bround(F.col("i") * (F.col("n") - 1) / 5.0, 0).cast("long").alias("place"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN q = floor(q) THEN q::BIGINT::VARCHAR ELSE q::VARCHAR END AS num FROM (SELECT *, l_quantity/2 AS q FROM lineitem)")
def fn_num_text(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", text.number_text(F.col("l_quantity") / 2).alias("num"))


@query("SELECT o_orderkey, lpad((o_orderkey % 30)::VARCHAR, 2, '0') || ':' || lpad(CASE WHEN o_orderkey % 4 = 0 THEN '0' ELSE (o_orderkey % 60)::VARCHAR END, 2, '0') AS hm FROM orders")
def fn_iso_duration_hhmm(s, d):
    k = F.col("o_orderkey")
    minutes = F.when(k % 4 == 0, F.lit("")).otherwise(F.concat((k % 60).cast("string"), F.lit("M")))
    return table(s, d, "orders").select("o_orderkey", text.iso_duration(F.concat(F.lit("PT"), (k % 30).cast("string"), F.lit("H"), minutes, F.lit("09S"))).alias("hm"))


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ') AS joined FROM documents")
def fn_join_paragraphs(s, d):
    return table(s, d, "documents").select("doc_id", text.paragraphs(F.split("text", "\n")).alias("joined"))


@query("SELECT o_orderkey, coalesce(least(greatest(try_cast(CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE (o_orderkey*7 - 50)::VARCHAR END AS INT), 1), 4096), 1) AS n FROM orders")
def fn_clamp_repeat(s, d):
    k = F.col("o_orderkey")
    return table(s, d, "orders").select("o_orderkey", text.repeat_count(F.when(k % 3 == 0, F.lit("x")).otherwise((k * 7 - 50).cast("string"))).alias("n"))


CELLS = "CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 5 = 2 THEN (o_orderkey % 24) || ':30' WHEN o_orderkey % 5 = 3 THEN (o_orderkey % 100) || '.5' ELSE o_orderpriority || ' <&> ' END"


def _cells(s, d):
    k = F.col("o_orderkey")
    c = (
        F.when(k % 5 == 0, "").when(k % 5 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 5 == 2, F.concat((k % 24).cast("string"), F.lit(":30")))
        .when(k % 5 == 3, F.concat((k % 100).cast("string"), F.lit(".5"))).otherwise(F.concat("o_orderpriority", F.lit(" <&> ")))
    )
    return table(s, d, "orders").select("o_orderkey", c.alias("c"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'blank' WHEN 1 THEN 'date' WHEN 2 THEN 'time' WHEN 3 THEN 'float' ELSE 'string' END AS kind FROM orders")
def fn_cell_type(s, d):
    return _cells(s, d).select("o_orderkey", text.cell_type(F.col("c")).alias("kind"))


@query(f"SELECT o_orderkey, replace(replace(replace({CELLS}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS safe FROM orders")
def fn_xml_escape(s, d):
    return _cells(s, d).select("o_orderkey", text.xml_escaped(F.col("c")).alias("safe"))


@query("SELECT l_orderkey, l_linenumber, unnest(range(l_quantity::BIGINT % 4 + 1)) AS copy FROM lineitem")
def src_rle_expand(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(F.sequence(F.lit(0).cast("long"), F.col("l_quantity").cast("long") % 4)).alias("copy"))


@query("WITH c AS (SELECT o_orderkey, [o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN 'm' ELSE '' END, '', CASE WHEN o_orderkey % 3 = 0 THEN 'e' ELSE '' END, ''] AS c FROM orders) SELECT o_orderkey, array_to_string(c[1:list_max(list_transform(range(1, 6), lambda i: CASE WHEN c[i] <> '' THEN i ELSE 0 END))], '|') AS cells FROM c")
def src_trim_trailing(s, d):
    k = F.col("o_orderkey")
    c = F.array("o_orderstatus", F.when(k % 2 == 0, "m").otherwise(""), F.lit(""), F.when(k % 3 == 0, "e").otherwise(""), F.lit(""))
    last = F.array_max(F.transform("c", lambda x, i: F.when(x != "", i + 1).otherwise(0)))
    return table(s, d, "orders").select("o_orderkey", c.alias("c")).select("o_orderkey", F.array_join(F.slice("c", F.lit(1), last), "|").alias("cells"))


@query("SELECT o_orderkey::DOUBLE AS number, o_orderdate::DATE AS date, (o_orderkey % 24) * 60 + 5 AS time, o_totalprice AS amount, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (o_orderkey % 9)::DOUBLE END AS some, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS status FROM orders")
def src_typed_infer(s, d):
    """Text columns by what all their values are: dates, minutes, numbers, other texts; blanks as nulls."""
    k = F.col("o_orderkey")
    o = table(s, d, "orders").select(
        k.cast("string").alias("number"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.concat((k % 24).cast("string"), F.lit(":05")).alias("time"),
        F.col("o_totalprice").cast("string").alias("amount"), F.when(k % 4 == 0, "").otherwise((k % 9).cast("string")).alias("some"),
        F.when(k % 5 == 0, "").otherwise(F.col("o_orderstatus")).alias("status"),
    )
    return ods.typed(o).withColumn("time", F.col("time").cast("long"))


def _scratch(s) -> str:
    """A round trip's own folder in the one that all executors share."""
    return f"{shared_folder(s)}/files-{uuid.uuid4().hex}"


TRIP = "SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority FROM orders"


def _orders(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority")


@query(TRIP)
def src_csv_roundtrip(s, d):
    from ..sources.diary import read_lines

    path = f"{_scratch(s)}/orders.csv"
    _orders(s, d).coalesce(1).write.option("header", True).csv(path)
    return read_lines(s, path).select("o_orderkey", "o_orderstatus", "day", "o_orderpriority")


@query(TRIP)
def src_ods_roundtrip(s, d):
    """Through a folder of sheets: one alone ends at 1,048,576 rows."""
    path = _scratch(s)
    ods.register(s)
    _orders(s, d).write.format("ods").mode("append").save(path)
    return ods.read_ods(s, path).select("o_orderkey", "o_orderstatus", "day", "o_orderpriority")


SHOWN = (("click_0", None), ("view_1", 2), 12)


@query(BASE + "SELECT o.diary_id, o.obs_id, s.series, round(coalesce(sum(x.x), 0e0), 4) AS value FROM obs o CROSS JOIN (VALUES (0, 'click_0', NULL), (1, 'view_1', 2), (2, 'click_1', 5)) s(series, item, k) LEFT JOIN x ON x.diary_id = o.diary_id AND x.obs_id = o.obs_id AND x.item = s.item AND (s.k IS NULL OR s.k = x.k) GROUP BY ALL")
def exposure_plot(s, d):
    """Chosen series as they are plotted: an item's total, one of its kernels, and a column by number."""
    rows = plot.series(observations(s, d), _x(s, d), ["click_0", "click_1", "view_1"], SHOWN)
    return rows.select("diary_id", "obs_id", "series", r4("value").alias("value"))


@query(f"WITH {KER}, t AS (SELECT unnest(range(1, 100))::DOUBLE AS d) SELECT d, k, round(CASE WHEN abs((d-c)/w) < 1 THEN 0.5e0*(1+cos(pi()*(d-c)/w)) ELSE 0 END, 4) AS weight FROM t, ker")
def kernel_function(s, d):
    """The kernels as an SQL table function."""
    lag.register_kernels(s)
    return s.sql("SELECT t.d, w.k, round(w.weight, 4) + 0D AS weight FROM (SELECT CAST(id AS DOUBLE) AS d FROM range(1, 100)) t, LATERAL lag_kernels(t.d) w")


# ---- operators without an SQL form
@query()
def sim_generate(s, d):
    return simulate.generate(s, 4, simulate.Setup(n_days=14, reading_hours=simulate.READING_HOURS, reliever=simulate.RELIEVER))


@query(f"WITH {OBS}, o AS (SELECT *, row_number() OVER (PARTITION BY diary_id ORDER BY t_h, obs_id) AS i, count(*) OVER (PARTITION BY diary_id) AS n FROM obs) SELECT diary_id, round(sum(y * pow(0.45e0, n - i)), 4) AS e FROM o GROUP BY 1")
def ar1_noise(s, d):
    """AR(1) recursion e_i + 0.45 e_(i-1) over outcomes in order, as a fold."""
    o = observations(s, d).groupBy("diary_id").agg(F.array_sort(F.collect_list(F.struct("t_h", "obs_id", "y"))).alias("o"))
    fold = F.aggregate("o", F.lit(0.0), lambda e, x: x["y"] + 0.45 * e)
    return o.select("diary_id", r4(fold).alias("e"))


def _analyzed(s, d, **params):
    from .analyze import analyze

    e = entries(s, d).groupBy("diary_id", "entry_id", "t_h").agg(F.collect_set("item").alias("items"))
    return analyze(observations(s, d).withColumn("hod", lag.hour_of_day(F.col("ts"))), e, **params)


@query()
def analyze_full(s, d):
    """The whole analysis of all diaries of the event table."""
    return _analyzed(s, d)[0]


@query()
def selection_counts(s, d):
    """Frequencies and run statistics of four generated diaries."""
    from .analyze import analyze

    setup = simulate.Setup(n_days=21, reading_hours=simulate.READING_HOURS)
    o, e, r = simulate.split(simulate.generate(s, 4, setup))
    results, stats, _ = analyze(o, e, r)
    return results.select("diary_id", "block", "frequency").join(stats.select("diary_id", "n_obs", "replicates"), "diary_id")


@query()
def group_lasso_path(s, d):
    """Active groups along the penalty path of a planted problem per seed."""
    import numpy as np
    import pandas as pd

    from ..operators.solver import Groups

    def solved(batches):
        for pdf in batches:
            for seed in pdf["seed"]:
                r = np.random.default_rng(int(seed))
                x = r.normal(size=(200, 42))
                y = x[:, 7:14] @ np.full(7, 1.5) + r.normal(0, 0.5, 200)
                g, c = Groups(x.T @ x / 200), x.T @ y / 200
                beta, rows = None, []
                for i, lam in enumerate(g.largest(c) * np.logspace(0, -2, 50)):
                    beta = g.solve(c, lam, beta)
                    rows.append((seed, i, lam, int(g.active(beta).sum())))
                yield pd.DataFrame(rows, columns=["seed", "i", "lam", "active"])

    return s.range(4).select(F.col("id").alias("seed")).mapInPandas(solved, "seed long, i int, lam double, active int")


@query()
def nnls_refit(s, d):
    import numpy as np
    import pandas as pd

    from ..operators.solver import nnls

    def solved(batches):
        for pdf in batches:
            for seed in pdf["seed"]:
                r = np.random.default_rng(int(seed))
                x, true = r.normal(size=(100, 6)), np.array([1.0, 0, 2, 0, 0.5, 0])
                y = x @ true + r.normal(0, 0.01, 100)
                yield pd.DataFrame({"seed": seed, "j": range(6), "coef": nnls(x.T @ x, x.T @ y)})

    return s.range(4).select(F.col("id").alias("seed")).mapInPandas(solved, "seed long, j int, coef double")


def _banded(s, d):
    o = observations(s, d)
    x = ex.bands(ex.exposure(o, entries(s, d))).withColumn("feature", F.concat("item", F.lit("_b"), F.col("band").cast("string")))
    return o, x


@query()
def forest_rank(s, d):
    from .forest import rank

    return rank(*_banded(s, d))


@query()
def forest_folds(s, d):
    from .forest import cross_validate

    return cross_validate(*_banded(s, d))
