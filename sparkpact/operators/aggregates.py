"""Grouping and aggregates."""

import pandas as pd
from pyspark.sql import functions as F

from .registry import money, query


@query("SELECT count(*) AS n, count(nullif(o_orderstatus, 'F')) AS n_open, min(o_totalprice) AS low, max(o_totalprice) AS high, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total FROM orders")
def global_agg(t):
    return t.orders.agg(F.count("*").alias("n"), F.count(F.nullif("o_orderstatus", F.lit("F"))).alias("n_open"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), money("o_totalprice").alias("total"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS sum_qty,
          CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS sum_price, round(avg(l_discount), 6) AS avg_disc FROM lineitem GROUP BY 1, 2""")
def group_agg(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), money("l_quantity").alias("sum_qty"), money("l_extendedprice").alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def having_agg(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12")


@query("SELECT 1 AS one HAVING 1 > 0")
def having_no_from(t):
    return t.spark.sql("SELECT 1 AS one HAVING 1 > 0")


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderstatus) AS statuses FROM orders GROUP BY 1")
def count_distinct(t):
    return t.orders.groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderstatus").alias("statuses"))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open, count(*) FILTER (WHERE o_totalprice > 100000) AS n_big FROM orders GROUP BY 1")
def agg_filter(t):
    hit = lambda c: F.count(F.when(c, 1))
    return t.orders.groupBy("o_orderpriority").agg(hit(F.col("o_orderstatus") == "O").alias("n_open"), hit(F.col("o_totalprice") > 100000).alias("n_big"))


@query("SELECT n_regionkey, array_to_string(list(n_name ORDER BY n_name DESC), ',') AS names FROM nation GROUP BY 1")
def ordered_collect(t):
    return t.nation.groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name"), asc=False), ",").alias("names"))


@query("SELECT l_shipmode_like, CAST(sum(DISTINCT q) AS DOUBLE) AS distinct_sum FROM (SELECT l_linestatus AS l_shipmode_like, CAST(l_quantity AS DECIMAL(18,4)) AS q FROM lineitem) GROUP BY 1")
def sum_distinct(t):
    return t.lineitem.groupBy(F.col("l_linestatus").alias("l_shipmode_like")).agg(F.sum_distinct(F.col("l_quantity").cast("decimal(18,4)")).cast("double").alias("distinct_sum"))


_SUM = "count(*) AS n"


@query(f"SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS TINYINT) AS g, {_SUM} FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(t):
    return t.sql("SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus) AS g, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", "orders")


@query(f"SELECT o_orderstatus, o_orderpriority, {_SUM} FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup(t):
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query(f"SELECT o_orderstatus, o_orderpriority, {_SUM} FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(t):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(t):
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(t):
    # the largest struct a key: one partial aggregate, where a window would sort every row
    top = t.orders.groupBy("o_custkey").agg(F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("m"))
    return top.select("o_custkey", (-F.col("m.k")).alias("o_orderkey"), "m.o_totalprice")


@query("SELECT o_orderpriority, quantile_cont(o_totalprice, 0.5) AS median FROM orders GROUP BY 1")
def ordered_set_agg(t):
    return t.orders.groupBy("o_orderpriority").agg(F.percentile("o_totalprice", 0.5).alias("median"))


_OF_REGION = "FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"


def _of_region(t):
    n, r = t.nation, t.region
    return n.join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name")


@query(f"SELECT r_name, CAST(to_json(list({{'name': n_name, 'key': n_nationkey, 'odd': nullif(n_nationkey % 2, 0)}} ORDER BY n_name)) AS VARCHAR) AS j {_OF_REGION}")
def json_agg_objects(t):
    from ..functions.json_text import json_array_agg

    row = F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"), F.nullif(F.col("n_nationkey") % 2, F.lit(0)).alias("odd"))
    return _of_region(t).agg(json_array_agg(row).alias("j"))


@query(f"SELECT r_name, CAST(to_json(map_from_entries(list((n_name, n_nationkey) ORDER BY n_name))) AS VARCHAR) AS j {_OF_REGION}")
def json_object_agg(t):
    from ..functions.json_text import json_object_agg as whole

    return _of_region(t).agg(whole(F.col("n_name"), F.col("n_nationkey")).alias("j"))


@query(f"SELECT r_name, CAST(to_json(map_from_entries(list((n_name, n_nationkey) ORDER BY n_name) FILTER (WHERE n_nationkey % 3 > 0))) AS VARCHAR) AS j {_OF_REGION}")
def json_object_agg_strict(t):
    """Pairs with a null value are left out."""
    from ..functions.json_text import json_object_agg as whole

    return _of_region(t).agg(whole(F.col("n_name"), F.when(F.col("n_nationkey") % 3 > 0, F.col("n_nationkey")), strict=True).alias("j"))


@query("SELECT o_orderstatus, max(o_totalprice) - min(o_totalprice) AS span, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def user_aggregate(t):
    """A user-defined aggregate: Arrow batches of the partial extremes, so a group's rows are reduced before Python."""

    @F.pandas_udf("double")
    def span(low: pd.Series, high: pd.Series) -> float:
        return float(high.max() - low.min())

    bucket = F.pmod(F.xxhash64("o_orderkey"), F.lit(64))
    partial = t.orders.groupBy("o_orderstatus", bucket).agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.count("*").alias("n"))
    both = partial.groupBy("o_orderstatus")
    spans = both.agg(span("low", "high").alias("span"))
    return spans.join(both.agg(F.sum("n").alias("n")), "o_orderstatus")


@query("SELECT user_id, CAST(max(n) AS BIGINT) AS longest FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def nested_aggregation(t):
    return t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"))


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def two_phase_distinct(t):
    return t.events.select("event_type", "user_id").distinct().groupBy("event_type").agg(F.count("user_id").alias("users"))


@query("SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def listagg_within_group(t):
    return t.sql("SELECT n_regionkey, listagg(n_name, ';') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", "nation")


@query("SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS every_big, bool_or(o_totalprice > 400000) AS any_huge, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS top FROM orders GROUP BY 1")
def bool_and_max_by(t):
    return t.orders.groupBy("o_orderstatus").agg(F.bool_and(F.col("o_totalprice") > 1000).alias("every_big"), F.bool_or(F.col("o_totalprice") > 400000).alias("any_huge"), F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("top"))
