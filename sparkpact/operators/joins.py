"""Join forms. Catalyst picks the physical join from sizes; theta joins stay on tables of fixed size."""

from pyspark.sql import functions as F

from .registry import money, query


@query("SELECT o.o_orderkey, c.c_name, c.c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def inner_join_on(t):
    o, c = t.orders, t.customer
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name", "c_mktsegment")


@query("SELECT a.n_name AS low, b.n_name AS high FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def theta_join(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    on = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return a.join(b, on).select(F.col("a.n_name").alias("low"), F.col("b.n_name").alias("high"))


@query("SELECT r_name, n_name FROM region, nation")
def cross_join(t):
    return t.region.crossJoin(t.nation).select("r_name", "n_name")  # 5 and 25 rows at every scale


@query("SELECT k, r_name, n_name FROM (SELECT r_regionkey AS k, r_name FROM region) r JOIN (SELECT n_regionkey AS k, n_name FROM nation) n USING (k)")
def using_join(t):
    r = t.region.select(F.col("r_regionkey").alias("k"), "r_name")
    return r.join(t.nation.select(F.col("n_regionkey").alias("k"), "n_name"), ["k"]).select("k", "r_name", "n_name")


@query("SELECT n_regionkey, n_name, r_name FROM nation NATURAL JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) r")
def natural_join(t):
    return t.sql("SELECT n_regionkey, n_name, r_name FROM {nation} n NATURAL JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM {region}) r", "nation", "region")


@query("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 250000) o ON o.o_custkey = c.c_custkey")
def left_join(t):
    big = t.orders.where("o_totalprice > 250000")
    c = t.customer
    return c.join(big, big.o_custkey == c.c_custkey, "left").select("c_custkey", "o_orderkey")


@query("SELECT s.s_suppkey, n.n_name FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000")
def right_join(t):
    s, n = t.supplier, t.nation
    return s.join(n, (s.s_nationkey == n.n_nationkey) & (s.s_acctbal > 5000), "right").select("s_suppkey", "n_name")


@query("""SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation WHERE n_nationkey < 15) x
          FULL JOIN (SELECT n_nationkey AS k, n_name AS b FROM nation WHERE n_nationkey > 9) y USING (k)""")
def full_join_using(t):
    x = t.nation.where("n_nationkey < 15").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("a"))
    y = t.nation.where("n_nationkey > 9").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("b"))
    return x.join(y, ["k"], "full").select("k", "a", "b")


_TOP = "SELECT o_orderkey, o_totalprice FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2"


@query(f"SELECT c.c_custkey, x.o_orderkey, x.o_totalprice FROM customer c CROSS JOIN LATERAL ({_TOP}) x")
def lateral_cross(t):
    # top 2 a customer: a ranked window in place of one subquery a row
    return _ranked(t).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")


@query(f"SELECT c.c_custkey, x.o_orderkey, x.o_totalprice FROM customer c LEFT JOIN LATERAL ({_TOP}) x ON true")
def lateral_left(t):
    return t.customer.join(_ranked(t), F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey", "o_totalprice")


def _ranked(t):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.withColumn("r", F.row_number().over(w)).where("r <= 2").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT a.c_custkey AS left_key, b.c_custkey AS right_key FROM customer a JOIN customer b ON a.c_name = b.c_name AND a.c_nationkey = b.c_nationkey")
def self_join(t):
    a, b = t.customer.alias("a"), t.customer.alias("b")
    return a.join(b, (F.col("a.c_name") == F.col("b.c_name")) & (F.col("a.c_nationkey") == F.col("b.c_nationkey"))).select(F.col("a.c_custkey").alias("left_key"), F.col("b.c_custkey").alias("right_key"))


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
def semi_exists(t):
    c, o = t.customer, t.orders.where("o_totalprice > 200000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def semi_in(t):
    return t.sql("SELECT s_suppkey FROM {supplier} WHERE s_suppkey IN (SELECT l_suppkey FROM {lineitem} WHERE l_quantity > 49)", "supplier", "lineitem")


@query("SELECT c_custkey FROM customer WHERE c_custkey = ANY (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_any(t):
    c, o = t.customer, t.orders.where("o_orderstatus = 'P'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def anti_not_exists(t):
    c, o = t.customer, t.orders
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 1) FROM orders)")
def anti_not_in_null(t):
    return t.sql("SELECT count(*) AS n FROM {customer} WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 1) FROM {orders})", "customer", "orders")


@query("""SELECT c.c_mktsegment, n.n_name, count(*) AS n_orders, CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total
          FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY ALL""")
def star_join_agg(t):
    o, c, n = t.orders, t.customer, t.nation
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("n_orders"), money("o_totalprice").alias("total"))


@query("""SELECT c.c_custkey, c.c_name, count(o.o_orderkey) AS order_count, max(o.o_totalprice) AS max_price
          FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey, c.c_name""")
def customer_summary(t):
    """The flagship shape: join, aggregate, unique lookup."""
    # orders are pre-aggregated on the join key, so the join meets one row a customer
    per = t.orders.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"), F.max("o_totalprice").alias("max_price"))
    c = t.customer
    return c.join(per, c.c_custkey == per.o_custkey, "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("order_count"), "max_price")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 7")
def unique_lookup_param(t):
    return t.sql("SELECT c_custkey, c_name, c_mktsegment FROM {customer} WHERE c_custkey = :custkey", "customer", args={"custkey": 7})


@query("""SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o, customer c, nation n
          WHERE o.o_orderkey = 7 AND c.c_custkey = o.o_custkey AND n.n_nationkey = c.c_nationkey""")
def unique_join_closure_param(t):
    text = """SELECT o.o_orderkey, c.c_name, n.n_name FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey
              JOIN {nation} n ON n.n_nationkey = c.c_nationkey WHERE o.o_orderkey = :orderkey"""
    return t.sql(text, "orders", "customer", "nation", args={"orderkey": 7})
