"""The query catalogue: one query per operator family over canonical cubes of the test tables, each with the same thing in plain SQL.

Canonical cubes: E(day, hr, etype | total, n), S(nation, yr, segment | total), L(mon, flag, status | qty, price), M(nation | region),
V(vec, comp | x). A missing combination is a missing cell.
"""

from __future__ import annotations

import atexit
import datetime
import shutil
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcube.axes import Axis, IntervalLabel
from sparkcube.cube import Cube, Dataset, wide_dataset
from sparkcube.functions import nulls
from sparkcube.operators import align, combine, group, reduce, resample, select, slices, window
from sparkcube.operators.select import At, Between, Interval, Near, Touches, Where
from sparkcube.sources import store
from sparkcube.streaming import stats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_CUBES = """WITH E AS (
  SELECT CAST(ts AS DATE) AS day, CAST(extract(hour FROM ts) AS INT) AS hr, event_type AS etype, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, COUNT(*) AS n
  FROM events GROUP BY 1, 2, 3
), S AS (
  SELECT c_nationkey AS nation, CAST(extract(year FROM o_orderdate) AS INT) AS yr, c_mktsegment AS segment, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3
), L AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS mon, l_returnflag AS flag, l_linestatus AS status,
         CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price
  FROM lineitem GROUP BY 1, 2, 3
), M AS (SELECT n_nationkey AS nation, n_regionkey AS region FROM nation),
V AS (SELECT vec_id AS vec, CAST(generate_subscripts(embedding, 1) AS INT) AS comp, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
D AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM E),
G AS (SELECT day, hr, etype FROM D, (SELECT CAST(unnest(range(24)) AS INT) AS hr), (SELECT DISTINCT etype FROM E)),
EG AS (SELECT day, hr, etype, total FROM G LEFT JOIN E USING (day, hr, etype)),
LM AS (SELECT CAST(unnest(generate_series(min(mon), max(mon), INTERVAL 1 MONTH)) AS DATE) AS mon FROM L)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = _CUBES + (", " if sql.lstrip().startswith("x") else " ") + sql
        return fn

    return register


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _sum(column: str) -> F.Column:
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


def _days(df: DataFrame, column: str) -> Callable[[], list]:
    def load() -> list:
        a, b = df.agg(F.min(column).cast("date"), F.max(column).cast("date")).first()  # answered from file statistics
        return [a + datetime.timedelta(days=i) for i in range((b - a).days + 1)] if a else []

    return load


def _months(df: DataFrame, column: str) -> Callable[[], list]:
    def load() -> list:
        a, b = df.agg(F.min(column).cast("date"), F.max(column).cast("date")).first()
        return [datetime.date(k // 12, k % 12 + 1, 1) for k in range(a.year * 12 + a.month - 1, b.year * 12 + b.month)] if a else []

    return load


def _distinct(df: DataFrame, column: str) -> Callable[[], list]:
    return lambda: [r[0] for r in df.select(column).distinct().orderBy(column).collect()]


def events(spark: SparkSession, sf: str) -> Dataset:
    t = _table(spark, sf, "events")
    df = t.groupBy(F.col("ts").cast("date").alias("day"), F.hour("ts").alias("hr"), F.col("event_type").alias("etype")).agg(_sum("value").alias("total"), F.count(F.lit(1)).alias("n"))
    axes = {"day": Axis("day", _days(t, "ts")), "hr": Axis("hr", range(24)), "etype": Axis("etype", _distinct(t, "event_type"))}
    return wide_dataset(df, list(axes), ["total", "n"], axes)


def sales(spark: SparkSession, sf: str) -> Cube:
    o, c = _table(spark, sf, "orders"), _table(spark, sf, "customer")
    df = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_nationkey").alias("nation"), F.year("o_orderdate").alias("yr"), F.col("c_mktsegment").alias("segment")).agg(_sum("o_totalprice").alias("total"))
    years = lambda: list(range(*(x + i for i, x in enumerate(o.agg(F.year(F.min("o_orderdate")), F.year(F.max("o_orderdate"))).first()))))
    axes = {"nation": Axis("nation", _distinct(_table(spark, sf, "nation"), "n_nationkey")), "yr": Axis("yr", years), "segment": Axis("segment", _distinct(c, "c_mktsegment"))}
    return Cube(df, tuple(axes.values()), "total", {"long_name": "total order price", "units": "USD"})


def lines(spark: SparkSession, sf: str) -> Dataset:
    t = _table(spark, sf, "lineitem")
    df = t.groupBy(F.trunc("l_shipdate", "month").alias("mon"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(_sum("l_quantity").alias("qty"), _sum("l_extendedprice").alias("price"))
    axes = {"mon": Axis("mon", _months(t, "l_shipdate")), "flag": Axis("flag", _distinct(t, "l_returnflag")), "status": Axis("status", _distinct(t, "l_linestatus"))}
    return wide_dataset(df, list(axes), ["qty", "price"], axes)


def regions(spark: SparkSession, sf: str) -> Cube:
    t = _table(spark, sf, "nation")
    df = t.select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    return Cube(df, (Axis("nation", _distinct(t, "n_nationkey")),), "region")


def vectors(spark: SparkSession, sf: str) -> Cube:
    t = _table(spark, sf, "embeddings")
    df = t.select(F.col("vec_id").alias("vec"), F.posexplode("embedding").alias("p", "x")).select("vec", (F.col("p") + 1).alias("comp"), F.col("x").cast("double").alias("x"))
    return Cube(df, (Axis("vec", _distinct(t, "vec_id")), Axis("comp", range(1, 65))), "x")


def _out(cube: Cube, name: str = "total", digits: int | None = 4) -> DataFrame:
    return cube.df.select(*cube.dims, (F.round(cube.v, digits) if digits is not None else cube.v).alias(name))


def _scratch(spark: SparkSession) -> str:
    """A place for a query's store in the folder that all executors share; a temporary one only where none is named and Spark is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp()
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
    return f"{base}/cubes/{uuid.uuid4().hex}"


# reductions and selection


@query("SELECT day, etype, round(avg(total), 6) AS mean_total FROM E GROUP BY 1, 2")
def min_slice_mean_hours(spark, sf):
    return _out(reduce.mapslices("mean", events(spark, sf)["total"], "hr"), "mean_total", 6)


@query("SELECT day, hr, etype, total FROM E WHERE day < (SELECT min(day) FROM E) + 10")
def sel_positional_range(spark, sf):
    return events(spark, sf)["total"].isel(day=range(1, 11)).to_df()


@query("SELECT day, hr, total FROM E WHERE etype = (SELECT min(etype) FROM E)")
def sel_at_label(spark, sf):
    e = events(spark, sf)["total"]
    return e.sel(etype=At(e.etype.values[0])).to_df()


@query("SELECT nation, yr, segment, total FROM S WHERE yr IN (1996, 1998)")
def sel_at_list(spark, sf):
    return sales(spark, sf).sel(yr=At([1996, 1998])).to_df()


@query("SELECT vec, comp, round(x, 6) AS x FROM V WHERE abs(comp - 10.2) <= 1.5")
def sel_at_atol(spark, sf):
    return _out(vectors(spark, sf).sel(comp=At(10.2, atol=1.5)), "x", 6)


@query("SELECT flag, status, qty FROM L WHERE mon = DATE '1998-06-01'")
def sel_near(spark, sf):
    return lines(spark, sf)["qty"].sel(mon=Near(datetime.date(1998, 5, 20))).to_df()


@query("SELECT nation, yr, segment, total FROM S WHERE yr BETWEEN 1996 AND 1999")
def sel_closed_interval(spark, sf):
    return sales(spark, sf).sel(yr=Interval(1996, 1999)).to_df()


@query("SELECT nation, yr, segment, total FROM S WHERE yr > 1996 AND yr < 1999")
def sel_open_interval(spark, sf):
    return sales(spark, sf).sel(yr=Interval(1996, 1999, "neither")).to_df()


@query("SELECT 'left' AS side, * FROM S WHERE yr >= 1996 AND yr < 1999 UNION ALL SELECT 'right', * FROM S WHERE yr > 1996 AND yr <= 1999")
def sel_half_open(spark, sf):
    s = sales(spark, sf)
    parts = {side: s.sel(yr=Interval(1996, 1999, side)).to_df().select(F.lit(side).alias("side"), "*") for side in ("left", "right")}
    return parts["left"].unionByName(parts["right"])


@query("SELECT mon, flag, status, price FROM L WHERE mon BETWEEN DATE '1996-02-01' AND DATE '1997-03-15'")
def sel_between(spark, sf):
    return lines(spark, sf)["price"].sel(mon=Between(datetime.date(1996, 2, 1), datetime.date(1997, 3, 15))).to_df()


@query("SELECT mon, flag, status, price FROM L WHERE extract(year FROM mon) IN (1996, 1997)")
def sel_year_range(spark, sf):
    return lines(spark, sf)["price"].sel(mon=(1996, 1997)).to_df()


@query("SELECT nation, yr, segment, total FROM S WHERE nation IN (SELECT nation FROM M WHERE region = 2)")
def sel_where(spark, sf):
    return select.where_other(sales(spark, sf), "nation", regions(spark, sf), lambda r: r == 2).to_df()


@query("SELECT hr, etype, total FROM E WHERE day = DATE '2024-01-05' AND hr % 6 = 0")
def sel_where_labels(spark, sf):
    return events(spark, sf)["total"].sel(day=datetime.date(2024, 1, 5), hr=Where(lambda h: h % 6 == 0)).to_df()


@query(
    """SELECT k AS week, etype, round(sum(total), 2) AS total FROM (SELECT CAST(floor(date_diff('day', (SELECT min(day) FROM E), day) / 7) AS INT) AS k, etype, total FROM E)
    WHERE (SELECT min(day) FROM E) + 7 * k <= DATE '2024-01-17' AND (SELECT min(day) FROM E) + 7 * (k + 1) >= DATE '2024-01-09' GROUP BY 1, 2"""
)
def sel_overlap(spark, sf):
    e = events(spark, sf)["total"]
    first, week = e.day.values[0], datetime.timedelta(days=7)
    count = -(-len(e.day) // 7)
    weeks = window.moving_intervals(e.reduce("sum", "hr"), "day", [IntervalLabel(first + k * week, first + (k + 1) * week, "left") for k in range(count)], "sum", labels="interval")
    found = weeks.sel(day=Touches(datetime.date(2024, 1, 9), datetime.date(2024, 1, 17)))
    return found.df.select((F.datediff(F.col("day.left"), F.lit(first)) / 7).cast("int").alias("week"), "etype", F.round("total", 2).alias("total"))


@query("SELECT mon, status, qty, price FROM L WHERE flag = 'A'")
def ds_subset_multi(spark, sf):
    return next(iter(lines(spark, sf).sel(flag=At("A")).grouped().values())).select("mon", "status", "qty", "price")


@query("SELECT mon, flag, status, qty AS q, price AS pr FROM L")
def ds_var_prefix(spark, sf):
    found = lines(spark, sf)[["q", "pr"]]
    return align.dataset_table(found).select("mon", "flag", "status", "q", "pr")


@query("SELECT segment AS seg, nation, yr, total FROM S")
def rename_permute(spark, sf):
    return sales(spark, sf).rename({"segment": "seg"}).permute("seg", "nation", "yr").to_df()


@query("SELECT nation, segment, total FROM S WHERE yr = 1997")
def dropdims_slice(spark, sf):
    return sales(spark, sf).sel(yr=At([1997])).dropdims("yr").to_df()


@query("SELECT CAST(date_diff('month', (SELECT min(mon) FROM L), mon) + 1 AS BIGINT) AS month_no, flag, status, qty FROM L")
def relabel_axis(spark, sf):
    q = lines(spark, sf)["qty"]
    return q.rename({"mon": Axis("month_no", range(1, len(q.mon) + 1))}).to_df()


@query("SELECT nation, yr, segment, CASE WHEN nation < 5 AND yr = 1997 THEN 0.0 ELSE total END AS total FROM S")
def where_update(spark, sf):
    return sales(spark, sf).update((F.col("nation") < 5) & (F.col("yr") == 1997), 0.0).to_df()


# element-wise computation and alignment


@query("SELECT nation, yr, segment, round((total + 5) / 2 * 3, 4) AS total FROM S")
def bcast_scalar(spark, sf):
    return _out((sales(spark, sf) + 5) / 2 * 3)


@query("SELECT mon, flag, status, round(qty * price, 2) AS value FROM L")
def bcast_cubes(spark, sf):
    ds = lines(spark, sf)
    wide = ds.grouped()
    return _out(align.same_table(lambda q, p: q * p, next(iter(wide.values())), ds["qty"].axes, "qty", "price"), "value", 2)


@query("SELECT nation, yr, segment, round(total - avg(total) OVER (PARTITION BY yr, segment), 6) AS value FROM S")
def bcast_lower_rank(spark, sf):
    s = sales(spark, sf)
    return _out(s - s.reduce("mean", "nation"), "value", 6)


@query("SELECT hr, etype, round(a * b, 6) AS value FROM (SELECT hr, sum(n) AS a FROM E GROUP BY 1), (SELECT etype, avg(n) AS b FROM E GROUP BY 1)")
def outer_axes(spark, sf):
    n = events(spark, sf)["n"]
    return _out(n.reduce("sum", "day", "etype") * n.reduce("mean", "day", "hr"), "value", 6)


@query("SELECT mon, flag, status, round(qty + price, 2) AS value FROM L")
def map_zip(spark, sf):
    ds = lines(spark, sf)
    return _out(align.zip_map(lambda a, b: a + b, ds["qty"], ds["price"]), "value", 2)


@query("SELECT day, hr, etype, total > 500 AS big FROM E")
def predicate_mask(spark, sf):
    return (events(spark, sf)["total"] > 500).to_df("big")


@query("SELECT nation, yr, segment, round(sqrt(abs(total - 100000)) + ln(total), 4) AS value FROM S")
def elementwise_functions(spark, sf):
    return _out(sales(spark, sf).map(lambda v: F.sqrt(F.abs(v - 100000)) + nulls.safe_ln(v)), "value")


@query("SELECT mon, flag, status, CAST(trunc(price) AS BIGINT) AS price FROM L")
def cast_map(spark, sf):
    return lines(spark, sf)["price"].cast("bigint").to_df()


@query("SELECT nation, yr, segment, CASE WHEN yr <> 1997 THEN yr END AS y FROM S")
def replace_missing(spark, sf):
    s = sales(spark, sf)
    return s.rebuild(F.col("yr")).replace(1997).to_df("y")


# aggregation


@query("SELECT day, etype, CASE WHEN count(total) = 24 THEN round(sum(total), 2) END AS total FROM E GROUP BY 1, 2")
def reduce_sum_strict(spark, sf):
    return _out(events(spark, sf)["total"].reduce("sum", "hr", strict=True), "total", 2)


@query("SELECT day, etype, round(sum(total), 2) AS total FROM E GROUP BY 1, 2")
def reduce_sum_skip(spark, sf):
    return _out(events(spark, sf)["total"].reduce("sum", "hr"), "total", 2)


@query("SELECT mon, round(sum(price), 2) AS price FROM L GROUP BY 1")
def reduce_multi_axis(spark, sf):
    return _out(lines(spark, sf)["price"].reduce("sum", "flag", "status"), "price", 2)


@query("SELECT round(sum(total), 2) AS total FROM S")
def reduce_all(spark, sf):
    return _out(sales(spark, sf).reduce("sum"), "total", 2)


@query("SELECT nation, segment, round(stddev_samp(total), 2) AS sd, round(var_samp(total) / 1e6, 2) AS var FROM S GROUP BY 1, 2")
def reduce_std_var(spark, sf):
    s = sales(spark, sf)
    both = s.df.groupBy("nation", "segment").agg(nulls.skipping("std", s.v).alias("sd"), nulls.skipping("var", s.v).alias("var"))
    return both.select("nation", "segment", F.round("sd", 2).alias("sd"), F.round(F.col("var") / 1e6, 2).alias("var"))


@query("SELECT yr, segment, round(median(total), 3) AS total FROM S GROUP BY 1, 2")
def reduce_median(spark, sf):
    return _out(sales(spark, sf).reduce("median", "nation"), "total", 3)


@query("SELECT hr, bool_or(total > 900) AS any_big, bool_and(total > 1) AS all_small FROM E GROUP BY 1")
def reduce_any_all(spark, sf):
    e = events(spark, sf)["total"]
    a, b = (e > 900).reduce("any", "day", "etype"), (e > 1).reduce("all", "day", "etype")
    return align.cube_table(any_big=a, all_small=b)


@query("SELECT day, etype, CASE WHEN count(total) = 24 THEN round(avg(total), 6) END AS total FROM E GROUP BY 1, 2")
def filter_anymissing(spark, sf):
    return _out(events(spark, sf)["total"].reduce("mean", "hr", filter=nulls.ANY_MISSING), "total", 6)


@query("SELECT day, etype, CASE WHEN count(total) > 22 THEN round(sum(total), 2) END AS total FROM E GROUP BY 1, 2")
def filter_nvalid(spark, sf):
    return _out(events(spark, sf)["total"].reduce("sum", "hr", filter=nulls.n_valid(22)), "total", 2)


@query("SELECT day, etype, CASE WHEN NOT (min(n) = max(n) AND count(n) = 24) THEN CAST(sum(n) AS BIGINT) END AS n FROM E GROUP BY 1, 2")
def filter_stdzero(spark, sf):
    return _out(events(spark, sf)["n"].reduce("sum", "hr", filter=nulls.STD_ZERO), "n", None)


@query("SELECT day, etype, CASE WHEN count(total) > 20 AND max(total) <= 900 THEN round(sum(total), 2) END AS total FROM E GROUP BY 1, 2")
def filter_user(spark, sf):
    skip = nulls.user_filter(lambda v: F.max(v) > 900) | nulls.n_valid(20)
    return _out(events(spark, sf)["total"].reduce("sum", "hr", filter=skip), "total", 2)


@query("SELECT 'min' AS Extrema, nation, min(total) AS total FROM S GROUP BY 2 UNION ALL SELECT 'max', nation, max(total) FROM S GROUP BY 2")
def extrema(spark, sf):
    return reduce.extrema(sales(spark, sf), "yr", "segment").to_df()


@query("SELECT yr, round(avg(total), 6) AS value FROM S GROUP BY 1")
def table_mean_by_axis(spark, sf):
    s = sales(spark, sf)
    return _out(group.table_fit(s.df, "total", {"yr": F.col("yr")}, "mean", axes={"yr": s.yr}), "value", 6)


@query("SELECT CAST(extract(month FROM mon) AS INT) AS Category1, round(avg(price), 6) AS value FROM L GROUP BY 1")
def table_mean_by_fn(spark, sf):
    return _out(group.table_fit(lines(spark, sf)["price"].df, "price", {"Category1": F.month("mon")}), "value", 6)


@query("SELECT etype, round(sum(total * cos(radians(hr * 3))) / sum(cos(radians(hr * 3))), 3) AS value FROM E GROUP BY 1")
def table_weighted_mean(spark, sf):
    return _out(group.table_fit(events(spark, sf)["total"].df, "total", {"etype": F.col("etype")}, "mean", weight=F.cos(F.radians(F.col("hr") * 3))), "value", 3)


@query("SELECT region, yr, round(avg(total), 6) AS value FROM S JOIN M USING (nation) GROUP BY 1, 2")
def table_two_keys(spark, sf):
    t = align.cube_table("inner", total=sales(spark, sf), region=regions(spark, sf))
    return _out(group.table_fit(t, "total", {"region": F.col("region"), "yr": F.col("yr")}), "value", 6)


@query('SELECT r_name AS "Region", CAST(floor(yr / 2) AS BIGINT) AS "Category2", round(avg(total), 6) AS value FROM S JOIN M USING (nation) JOIN region ON r_regionkey = region GROUP BY 1, 2')
def table_labelled_groups(spark, sf):
    names = {r["r_regionkey"]: r["r_name"] for r in _table(spark, sf, "region").collect()}  # one row a region
    mask = regions(spark, sf)
    mask = mask.with_df(mask.df, props={"labels": names, "name": "Region"})
    return _out(group.fit_cubes({"total": sales(spark, sf), "mask": mask}, "total", ["mask", lambda t: F.floor(t["yr"] / 2)]), "value", 6)


@query("SELECT region AS \"group\", yr, segment, round(avg(total), 6) AS total FROM S JOIN M USING (nation) GROUP BY 1, 2, 3")
def group_by_cube(spark, sf):
    return _out(group.group_by_cube(sales(spark, sf), regions(spark, sf)), "total", 6)


@query(
    """SELECT k.g AS "group", y.yr, total FROM (SELECT CAST(unnest(range(7)) AS INT) AS g) k CROSS JOIN (SELECT CAST(unnest(range(1995, 2002)) AS INT) AS yr) y
    LEFT JOIN (SELECT region AS g, yr, round(sum(total), 2) AS total FROM S JOIN M USING (nation) GROUP BY 1, 2) r ON r.g = k.g AND r.yr = y.yr"""
)
def group_expected(spark, sf):
    s = sales(spark, sf).reduce("sum", "segment")
    return _out(group.group_by_cube(s, regions(spark, sf), "sum", expected=range(7)), "total", 2)


@query("SELECT n AS value, count(*) AS count FROM E GROUP BY 1")
def counter(spark, sf):
    return group.counter(events(spark, sf)["n"]).to_df("count")


@query("SELECT CAST(floor(l_quantity / 10) AS INT) AS xbin, CAST(floor(l_extendedprice / 20000) AS INT) AS ybin, sum(l_quantity) AS weight FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 50 AND l_extendedprice >= 0 AND l_extendedprice < 100000 GROUP BY 1, 2")
def fixed_hist_2d(spark, sf):
    t = _table(spark, sf, "lineitem")
    return group.histogram_2d(t, F.col("l_quantity"), F.col("l_extendedprice"), (0, 50, 10), (0, 100000, 20000), F.col("l_quantity"))


@query()
def khist(spark, sf):
    return group.histogram(events(spark, sf)["total"], 10, "etype")


@query()
def average_shifted_hist(spark, sf):
    return group.average_shifted_histogram(events(spark, sf)["total"], 20, 16, "etype")


@query(
    """x AS (SELECT region AS r, total AS v, sum(1.0) OVER (PARTITION BY region ORDER BY total ROWS UNBOUNDED PRECEDING) / sum(1.0) OVER (PARTITION BY region) AS q FROM S JOIN M USING (nation))
    SELECT r AS region, CAST(least(5, ceil(q * 5)) AS INT) AS "Bin", round(avg(v), 3) AS "MidPoints", CAST(count(*) AS DOUBLE) AS "Frequency" FROM x GROUP BY 1, 2"""
)
def weighted_adaptive_hist(spark, sf):
    t = align.cube_table("inner", total=sales(spark, sf), region=regions(spark, sf))
    return group.weighted_histogram(t, F.col("total"), F.lit(1.0), 5, {"region": F.col("region")}).withColumn("MidPoints", F.round("MidPoints", 3))


@query('SELECT CAST(a.comp AS BIGINT) AS "X", CAST(b.comp AS BIGINT) AS "CoX", round(covar_samp(a.x, b.x), 6) AS value FROM V a JOIN V b USING (vec) GROUP BY 1, 2')
def covariance(spark, sf):
    c = group.covariance(vectors(spark, sf), "comp", "vec")
    return c.df.select(F.col("X").cast("long").alias("X"), F.col("CoX").cast("long").alias("CoX"), F.round("value", 6).alias("value"))


@query('SELECT CAST(a.comp AS BIGINT) AS "X", CAST(b.comp AS BIGINT) AS "CoX", round(sum(w * a.x * b.x) / sum(w) - sum(w * a.x) / sum(w) * sum(w * b.x) / sum(w), 6) AS value FROM (SELECT *, 1 + vec % 3 AS w FROM V) a JOIN V b USING (vec) GROUP BY 1, 2')
def covariance_weighted(spark, sf):
    c = group.covariance(vectors(spark, sf), "comp", "vec", 1 + F.col("vec") % 3)
    return c.df.select(F.col("X").cast("long").alias("X"), F.col("CoX").cast("long").alias("CoX"), F.round("value", 6).alias("value"))


_SEASON = "CASE WHEN extract(month FROM mon) IN (12, 1, 2) THEN 'Dec_Jan_Feb' WHEN extract(month FROM mon) < 6 THEN 'Mar_Apr_May' WHEN extract(month FROM mon) < 9 THEN 'Jun_Jul_Aug' ELSE 'Sep_Oct_Nov' END"


@query(f"SELECT flag, status, {_SEASON} AS season, round(avg(qty), 6) AS qty FROM L GROUP BY 1, 2, 3")
def seasons_mean(spark, sf):
    return _out(group.group_labels(lines(spark, sf)["qty"], "mon", group.season("mon"), "mean", name="season"), "qty", 6)


@query(
    f"""x AS (SELECT mon, {_SEASON} AS season, CAST(extract(day FROM last_day(mon)) AS DOUBLE) AS d FROM LM), y AS (SELECT season, sum(d) AS t FROM x GROUP BY 1)
    SELECT flag, status, season, round(sum(qty * (d / t)), 4) AS qty FROM L JOIN x USING (mon) JOIN y USING (season) GROUP BY 1, 2, 3"""
)
def weighted_season(spark, sf):
    q = lines(spark, sf)["qty"]
    days = lambda d: float(((d.replace(day=28) + datetime.timedelta(days=4)).replace(day=1) - d).days)
    return _out(group.weighted_groups(q, "mon", lambda d: group.SEASONS[d.month % 12 // 3], days, name="season"), "qty")


@query("SELECT CAST(extract(month FROM mon) AS INT) AS month, flag, status, round(avg(price), 6) AS price FROM L GROUP BY 1, 2, 3")
def seasonal_cycle(spark, sf):
    return _out(group.seasonal_cycle(lines(spark, sf)["price"], "mon"), "price", 6)


@query("SELECT region AS \"group\", yr, round(sum(total), 2) AS total FROM S JOIN M USING (nation) GROUP BY 1, 2")
def region_vector(spark, sf):
    return _out(group.group_by_cube(sales(spark, sf).reduce("sum", "segment"), regions(spark, sf), "sum"), "total", 2)


@query("SELECT flag, status, round(corr(qty, price), 6) AS value FROM L GROUP BY 1, 2")
def corr_by_pixel(spark, sf):
    ds = lines(spark, sf)
    return _out(group.correlate(ds["qty"], ds["price"], "mon"), "value", 6)


@query("SELECT flag, status, round(regr_slope(price / 1e6, qty / 1e3), 6) AS slope, round(regr_intercept(price / 1e6, qty / 1e3), 6) AS intercept, round(exp(regr_slope(price / 1e6, qty / 1e3)), 6) AS q FROM L GROUP BY 1, 2")
def regression_q10(spark, sf):
    ds = lines(spark, sf)
    found = group.regress(ds["price"] / 1e6, ds["qty"] / 1e3, "mon")
    return found.select("flag", "status", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "q")])


# windows


@query("SELECT day, hr, etype, lag(total, 1, -9999) OVER (PARTITION BY day, etype ORDER BY hr) AS total FROM EG")
def moving_window_lag(spark, sf):
    return window.shift(events(spark, sf)["total"], "hr", -1, -9999.0).to_df()


@query("SELECT day, hr, etype, round(avg(total) OVER (PARTITION BY hr, etype ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS total FROM EG")
def moving_mean(spark, sf):
    return _out(window.moving_mean(events(spark, sf)["total"], "day", 3, 3), "total", 6)


@query("SELECT G.day, G.hr, G.etype, round(avg(E.total), 6) AS total FROM G JOIN E ON E.etype = G.etype AND abs(date_diff('day', E.day, G.day)) <= 1 AND abs(E.hr - G.hr) <= 1 GROUP BY 1, 2, 3")
def moving_window_2d(spark, sf):
    return _out(window.moving(events(spark, sf)["total"], "mean", day=(1, 1), hr=(1, 1)), "total", 6)


@query(
    """x AS (SELECT day, (SELECT min(day) FROM E) AS d0, (SELECT max(day) FROM E) AS d1, CAST(floor(date_diff('day', (SELECT min(day) FROM E), day) / 3) AS INT) AS k, hr, etype, total FROM E)
    SELECT d0 + 3 * k + 1 AS day, hr, etype, round(sum(total), 2) AS total FROM x WHERE d0 + 3 * k + 2 <= d1 GROUP BY 1, 2, 3"""
)
def moving_intervals(spark, sf):
    e = events(spark, sf)["total"]
    spans = window.intervals(e.day, right=e.day.values[2::3], width=datetime.timedelta(days=3))
    return _out(window.moving_intervals(e, "day", spans, "sum"), "total", 2)


@query("SELECT day, hr, etype, round(sum(total) OVER (PARTITION BY day, etype ORDER BY hr ROWS UNBOUNDED PRECEDING), 2) AS total FROM E")
def cumsum(spark, sf):
    return _out(reduce.mapslices("cumsum", events(spark, sf)["total"], "hr"), "total", 2)


@query("SELECT day, hr, etype, round(sum(total) OVER (PARTITION BY day, etype ORDER BY hr DESC ROWS UNBOUNDED PRECEDING), 2) AS total FROM E")
def cumsum_reverse(spark, sf):
    c = events(spark, sf)["total"]
    return _out(reduce.mapslices("cumsum", c.with_df(c.df, [a if a.name != "hr" else Axis("hr", range(23, -1, -1)) for a in c.axes]), "hr"), "total", 2)


@query("SELECT nation, yr, segment, round(total / max(total) OVER (PARTITION BY yr, segment), 6) AS total FROM S")
def slice_normalise(spark, sf):
    return _out(reduce.normalise(sales(spark, sf), "nation"), "total", 6)


@query("SELECT day, hr, etype, round(coalesce(total, avg(total) OVER (PARTITION BY hr, etype)), 6) AS total FROM EG")
def anomaly_gapfill(spark, sf):
    return _out(group.fill_from_cycle(events(spark, sf)["total"], "day"), "total", 6)


@query(
    """x AS (SELECT *, date_diff('day', DATE '2020-01-01', day) AS d FROM EG),
    xx AS (SELECT *, last_value(total IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN total IS NOT NULL THEN d END IGNORE NULLS) OVER b AS d0,
      first_value(total IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN total IS NOT NULL THEN d END IGNORE NULLS) OVER a AS d1 FROM x
      WINDOW b AS (PARTITION BY hr, etype ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY hr, etype ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT day, hr, etype, round(coalesce(total, CASE WHEN d1 <> d0 THEN v0 + (v1 - v0) * (d - d0) / (d1 - d0) END, v0, v1), 4) AS total FROM xx"""
)
def gap_interpolation(spark, sf):
    return _out(window.fill_gaps(events(spark, sf)["total"], "day"))


# resampling


@query("SELECT a.mon + 14 AS mon, a.flag, a.status, round(a.price + (b.price - a.price) * 14 / date_diff('day', a.mon, b.mon), 3) AS price FROM L a JOIN L b ON b.mon = a.mon + INTERVAL 1 MONTH AND a.flag = b.flag AND a.status = b.status")
def interp_linear(spark, sf):
    p = lines(spark, sf)["price"]
    return _out(resample.resample(p, Axis("mon", [m.replace(day=15) for m in p.mon.values])), "price", 3)


@query("SELECT CAST(mon - INTERVAL 1 MONTH AS DATE) + 19 AS mon, flag, status, price FROM L WHERE mon > (SELECT min(mon) FROM L)")
def interp_nearest(spark, sf):
    p = lines(spark, sf)["price"]
    return resample.resample(p, Axis("mon", [m.replace(day=20) for m in p.mon.values]), method="nearest").to_df()


# combining


@query("SELECT mon, flag, status, 'qty' AS \"Variables\", qty AS value FROM L UNION ALL SELECT mon, flag, status, 'price', price FROM L")
def concat_new_axis(spark, sf):
    ds = lines(spark, sf)
    return combine.concatenate({"qty": ds["qty"], "price": ds["price"]}, "Variables").to_df()


@query("SELECT nation, yr, segment, total AS value FROM S WHERE yr <= 1998")
def cat_existing(spark, sf):
    s = sales(spark, sf)
    return combine.cat([s.sel(yr=Interval(1995, 1996)), s.sel(yr=Interval(1997, 1998))], "yr").to_df()


@query("SELECT nation, yr, segment, total FROM S")
def merge_sorted(spark, sf):
    s = sales(spark, sf)
    last = s.yr.values[-1]
    blocks = [Dataset({"total": s.sel(yr=Interval(a, b))}) for a, b in ((1999, last), (1995, 1996), (1997, 1998))]
    return combine.merge_datasets(blocks)["total"].to_df()


@query("SELECT yr, nation, segment, total FROM S WHERE yr IN (1996, 1999)")
def open_mf_new_axis(spark, sf):
    s, base = sales(spark, sf), _scratch(spark)
    paths = {y: f"{base}/{y}" for y in (1996, 1999)}
    for y, path in paths.items():
        store.save_dataset(Dataset({"total": s.sel(yr=y)}), path)
    found = store.open_mf_along(spark, {1996: paths[1996], 1997: None, 1999: paths[1999]}, "yr")["total"]
    return found.df.select(F.col("yr").cast("int").alias("yr"), "nation", "segment", F.col("value").alias("total"))


@query("SELECT mon, status, max(CASE WHEN flag = 'A' THEN qty END) AS a, max(CASE WHEN flag = 'N' THEN qty END) AS n, max(CASE WHEN flag = 'R' THEN qty END) AS r FROM L GROUP BY 1, 2")
def to_dataset_pivot(spark, sf):
    q = lines(spark, sf)["qty"]
    ds = combine.to_dataset(q.with_df(q.df, [Axis("flag", ("A", "N", "R")) if a.name == "flag" else a for a in q.axes]), "flag")
    return next(iter(ds.grouped().values())).select("mon", "status", *[F.col(x).alias(x.lower()) for x in "ANR"])


@query("SELECT mon, flag, status, 'qty' AS \"Variables\", qty AS value FROM L UNION ALL SELECT mon, flag, status, 'price', price FROM L")
def cube_unpivot(spark, sf):
    return combine.to_cube(lines(spark, sf)).to_df()


@query("SELECT c_custkey AS point, S.segment, S.total FROM customer JOIN S ON nation = c_nationkey AND yr = 1995 + c_custkey % 7 WHERE S.segment = c_mktsegment")
def points_extract(spark, sf):
    c = _table(spark, sf, "customer")
    points = c.select(F.col("c_custkey").alias("point"), (F.col("c_nationkey") + 0.3).alias("nation"), (1995 + F.col("c_custkey") % 7 - 0.2).alias("yr"))
    found = select.extract_points(sales(spark, sf), points, "point").to_df()
    return found.join(c.select(F.col("c_custkey").alias("point"), F.col("c_mktsegment").alias("segment")), ["point", "segment"]).select("point", "segment", "total")


# slice functions


@query("SELECT nation, segment, round(regr_slope(total, yr), 5) AS value FROM S GROUP BY 1, 2 HAVING count(*) > 1")
def pixel_udf(spark, sf):
    def slope(x: np.ndarray) -> float:
        ok = ~np.isnan(x)
        return np.polyfit(np.arange(len(x))[ok], x[ok], 1)[0] if ok.sum() > 1 else np.nan

    return _out(slices.map_cube(slope, sales(spark, sf), indims=slices.InDims("yr")), "value", 5)


@query("SELECT nation, yr, segment, round(total, 2) AS total FROM S")
def mapslices_identity(spark, sf):
    return _out(reduce.mapslices(lambda x: x, sales(spark, sf), "yr"), "total", 2)


@query("SELECT nation, yr, segment, round(sum(total) OVER (PARTITION BY nation, segment ORDER BY yr ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS value FROM S")
def moving_window_udf(spark, sf):
    dims = slices.InDims(window={"yr": (1, 1)}, oob=0.0)
    return _out(slices.map_cube(lambda x: np.nansum(x), sales(spark, sf), indims=dims), "value", 2)


@query(
    """x AS (SELECT nation, yr, segment, total, avg(total) OVER (PARTITION BY nation, segment ORDER BY yr RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS slow FROM S)
    SELECT nation, yr, segment, round(slow, 4) AS slow, round(total - slow, 4) AS fast FROM x"""
)
def udf_multi_out(spark, sf):
    s = sales(spark, sf)

    def split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        padded = np.concatenate([[np.nan], x, [np.nan]])
        three = np.stack([padded[:-2], padded[1:-1], padded[2:]])
        n = (~np.isnan(three)).sum(axis=0)
        slow = np.where((n > 0) & ~np.isnan(x), np.nansum(three, axis=0) / np.maximum(n, 1), np.nan)
        return slow, x - slow

    slow, fast = slices.map_cube(split, s, indims=slices.InDims("yr"), outdims=(slices.OutDims("yr"), slices.OutDims("yr")))
    t = align.cube_table("inner", slow=slow, fast=fast)
    return t.select("nation", F.col("yr").cast("int").alias("yr"), "segment", F.round("slow", 4).alias("slow"), F.round("fast", 4).alias("fast"))


@query("SELECT nation, segment, round(sum(total) * 2 + nation, 2) AS value FROM S GROUP BY 1, 2")
def udf_addargs_loopvars(spark, sf):
    fn = lambda x, loop, factor: np.nansum(x) * factor + loop["nation"]
    return _out(slices.map_cube(fn, sales(spark, sf), indims=slices.InDims("yr"), include_loopvars=True, args=(2,)), "value", 2)


@query("SELECT flag, status, round(sum(qty) / sum(price), 8) AS value FROM L GROUP BY 1, 2")
def udf_dataset(spark, sf):
    fn = lambda d: np.nansum(d["qty"]) / np.nansum(d["price"])
    return _out(slices.map_cube(fn, lines(spark, sf), indims=slices.InDims("mon")), "value", 8)


@query("SELECT nation, segment, round(sum(s.total) / max(r.t), 6) AS value FROM S s JOIN (SELECT segment, sum(total) AS t FROM S GROUP BY 1) r USING (segment) GROUP BY 1, 2")
def udf_two_inputs(spark, sf):
    s = sales(spark, sf)
    fn = lambda x, y: np.nansum(x) / np.nansum(y)
    return _out(slices.map_cube(fn, s, s.reduce("sum", "nation"), indims=(slices.InDims("yr"), slices.InDims("yr"))), "value", 6)


@query("SELECT nation, yr, segment, round(sqrt(total), 4) AS value FROM S")
def udf_elementwise(spark, sf):
    return _out(slices.xfunction(np.sqrt)(sales(spark, sf)), "value")


@query("SELECT etype, round(avg(total), 6) AS value FROM E GROUP BY 1")
def custom_statistic(spark, sf):
    fit = lambda state, x: (len(x), float(x.sum()))
    merge = lambda a, b: (a[0] + b[0], a[1] + b[1])
    return slices.partials(events(spark, sf)["total"].df, ["etype"], "total", fit, merge, lambda s: s[1] / s[0]).withColumn("value", F.round("value", 6))


@query()
def pca_dims(spark, sf):
    return slices.pca_dims(sales(spark, sf), "yr", "nation").to_df()


@query("SELECT E.day, E.hr, E.etype, E.total, a.mean_total, b.all_n FROM E JOIN (SELECT hr, etype, round(avg(total), 6) AS mean_total FROM E GROUP BY 1, 2) a USING (hr, etype) JOIN (SELECT etype, CAST(sum(n) AS BIGINT) AS all_n FROM E GROUP BY 1) b USING (etype)")
def zip_cross_table(spark, sf):
    ds = events(spark, sf)
    t = align.cube_table(total=ds["total"], mean_total=ds["total"].reduce("mean", "day"), all_n=ds["n"].reduce("sum", "day", "hr"))
    return t.select("day", "hr", "etype", "total", F.round("mean_total", 6).alias("mean_total"), "all_n")


# stores


@query("SELECT mon, flag, status, qty, price FROM L")
def save_open_roundtrip(spark, sf):
    found = store.save_dataset(lines(spark, sf), _scratch(spark))
    return next(iter(found.grouped().values())).select("mon", "flag", "status", "qty", "price")


@query("SELECT day, hr, etype, total FROM E")
def rechunk_invariance(spark, sf):
    e = events(spark, sf)["total"]
    return store.save_dataset(Dataset({"total": combine.set_chunks(e, {"day": 7, "hr": 12})}), _scratch(spark))["total"].to_df()


@query("SELECT nation, yr, segment, total FROM S")
def skeleton_append(spark, sf):
    s, path = sales(spark, sf), _scratch(spark)
    store.save_dataset(Dataset({"empty": s}), path, skeleton=True)
    found = store.save_dataset(Dataset({"total": s}), path, append=True)
    return align.cube_table(total=found["total"], empty=found["empty"]).where("empty is null").select("nation", "yr", "segment", "total")


# streaming


@query("SELECT date_trunc('hour', ts) AS start, event_type AS etype, count(value) AS n, round(max(value), 4) AS top FROM events GROUP BY 1, 2")
def windowed_stats(spark, sf):
    t = _table(spark, sf, "events")
    out = stats.windowed(t, "ts", "1 hour", {"etype": F.col("event_type")}, {"n": ("count", "value"), "top": ("max", "value")})
    return out.withColumn("top", F.round("top", 4))
