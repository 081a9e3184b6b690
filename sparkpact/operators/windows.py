"""Window functions; every window has a total order."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import query



def _by():
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


_W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


@query(f"SELECT o_orderkey, count(*) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n, max(o_totalprice) OVER ({_W} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM orders")
def win_rows_frame(t):
    return t.orders.select("o_orderkey", F.count("*").over(_by().rowsBetween(-2, 0)).alias("n"), F.max("o_totalprice").over(_by().rowsBetween(-1, 1)).alias("near"))


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM part")
def win_range_frame(t):
    w = Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(-5, 5)
    return t.part.select("p_partkey", F.count("*").over(w).alias("near"))


@query("""SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS INTEGER) AS rn,
          CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS INTEGER) AS rk, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS INTEGER) AS dr FROM part""")
def win_rank_family(t):
    w = Window.partitionBy("p_brand").orderBy("p_size")
    return t.part.select("p_partkey", F.row_number().over(w.orderBy("p_size", "p_partkey")).alias("rn"), F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dr"))


@query(f"SELECT o_orderkey, lag(o_totalprice) OVER ({_W}) AS before, lead(o_totalprice, 2, -1.0) OVER ({_W}) AS after FROM orders")
def win_lag_lead(t):
    return t.orders.select("o_orderkey", F.lag("o_totalprice").over(_by()).alias("before"), F.lead("o_totalprice", 2, -1.0).over(_by()).alias("after"))


@query("""SELECT c_custkey, CAST(ntile(4) OVER w AS INTEGER) AS tile, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd
          FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)""")
def win_ntile_pct(t):
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    return t.customer.select("c_custkey", F.ntile(4).over(w).alias("tile"), F.round(F.percent_rank().over(w), 9).alias("pr"), F.round(F.cume_dist().over(w), 9).alias("cd"))


_FULL = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"


@query(f"""SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS second
           FROM orders WINDOW w AS ({_W} {_FULL})""")
def win_first_last_nth(t):
    w = _by().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t.orders.select("o_orderkey", F.first("o_orderkey").over(w).alias("f"), F.last("o_orderkey").over(w).alias("l"), F.nth_value("o_orderkey", 2).over(w).alias("second"))


@query("SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) OVER (PARTITION BY o_custkey) AS DOUBLE) AS of_customer FROM orders")
def win_partition_sum(t):
    return t.orders.select("o_orderkey", F.sum(F.col("o_totalprice").cast("decimal(18,4)")).over(Window.partitionBy("o_custkey")).cast("double").alias("of_customer"))


@query("SELECT user_id, event_id, CAST(count(*) FILTER (WHERE event_type = 'click') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS clicks FROM events")
def win_filtered_running(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("user_id", "event_id", F.count(F.when(F.col("event_type") == "click", 1)).over(w).alias("clicks"))


@query("""SELECT c_custkey, CAST(coalesce(sum(n) OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW), 0) AS BIGINT) AS near
          FROM (SELECT *, 1 AS n FROM customer)""")
def win_groups_frame(t):
    """GROUPS frame: dense rank of the peers, then a RANGE frame over it."""
    w = Window.partitionBy("c_nationkey").orderBy("c_mktsegment")
    peers = t.customer.withColumn("g", F.dense_rank().over(w))
    return peers.select("c_custkey", F.count("*").over(Window.partitionBy("c_nationkey").orderBy("g").rangeBetween(-1, 0)).alias("near"))


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS others FROM part")
def win_exclude_current(t):
    return t.part.select("p_partkey", (F.count("*").over(Window.partitionBy("p_brand")) - 1).alias("others"))


_NEAR = "PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING"


def _near(t):
    frame = Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(-5, 5)
    peers = Window.partitionBy("p_brand", "p_size")  # a RANGE frame holds all peers of the current row
    total = lambda w: F.sum("p_partkey").over(w)
    return total(frame), total(peers), F.count("*").over(frame), F.count("*").over(peers)


@query(f"SELECT p_partkey, CAST(sum(p_partkey) OVER ({_NEAR} EXCLUDE GROUP) AS BIGINT) AS keys, count(*) OVER ({_NEAR} EXCLUDE GROUP) AS n FROM part")
def win_exclude_group(t):
    """The frame without the current row's peers; a sum of no rows is null."""
    keys, of_peers, n, n_peers = _near(t)
    return t.part.select("p_partkey", F.when(n > n_peers, keys - of_peers).alias("keys"), (n - n_peers).alias("n"))


@query(f"SELECT p_partkey, CAST(sum(p_partkey) OVER ({_NEAR} EXCLUDE TIES) AS BIGINT) AS keys, count(*) OVER ({_NEAR} EXCLUDE TIES) AS n FROM part")
def win_exclude_ties(t):
    """The frame without the current row's peers, with the row itself."""
    keys, of_peers, n, n_peers = _near(t)
    return t.part.select("p_partkey", (keys - of_peers + F.col("p_partkey")).alias("keys"), (n - n_peers + 1).alias("n"))
