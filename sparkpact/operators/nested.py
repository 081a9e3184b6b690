"""Subqueries, correlation, CTEs."""

from pyspark.sql import functions as F

from .registry import query


@query("SELECT o_orderkey, o_totalprice > (SELECT avg(o_totalprice) FROM orders) AS above FROM orders")
def scalar_subquery(t):
    mean = t.orders.agg(F.avg("o_totalprice").alias("m"))
    return t.orders.join(F.broadcast(mean)).select("o_orderkey", (F.col("o_totalprice") > F.col("m")).alias("above"))


@query("SELECT c_custkey, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS top FROM customer c")
def correlated_scalar(t):
    return t.sql("SELECT c_custkey, (SELECT max(o_totalprice) FROM {orders} o WHERE o.o_custkey = c.c_custkey) AS top FROM {customer} c", "orders", "customer")


@query("SELECT r_name, array_to_string(ARRAY(SELECT n_name FROM nation n WHERE n.n_regionkey = r.r_regionkey ORDER BY n_name), ',') AS names FROM region r")
def array_subquery(t):
    n = t.nation.groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"))
    r = t.region
    return r.join(n, r.r_regionkey == n.n_regionkey, "left").select("r_name", F.coalesce("names", F.lit("")).alias("names"))


@query("SELECT p_partkey FROM part WHERE p_retailprice >= ALL (SELECT p_retailprice FROM part WHERE p_size = 10)")
def all_subquery(t):
    most = t.part.where("p_size = 10").agg(F.max("p_retailprice").alias("most"))
    return t.part.join(F.broadcast(most)).where(F.col("most").isNull() | (F.col("p_retailprice") >= F.col("most"))).select("p_partkey")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P') AS has_p FROM customer c")
def exists_as_value(t):
    keys = t.orders.where("o_orderstatus = 'P'").select("o_custkey").distinct()
    c = t.customer
    return c.join(keys, c.c_custkey == keys.o_custkey, "left").select("c_custkey", F.col("o_custkey").isNotNull().alias("has_p"))


@query("""SELECT c_mktsegment, n FROM (SELECT c_mktsegment, count(*) AS n FROM customer c
          WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49)) GROUP BY 1)""")
def two_level_correlation(t):
    lines = t.lineitem.where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    orders = t.orders.join(lines, "o_orderkey", "left_semi").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(orders, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("WITH big AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 150000 GROUP BY 1) SELECT a.o_custkey, a.n FROM big a JOIN big b ON a.o_custkey = b.o_custkey WHERE b.n > 2")
def cte_plain(t):
    return t.sql("WITH big AS (SELECT o_custkey, count(*) AS n FROM {orders} WHERE o_totalprice > 150000 GROUP BY 1) SELECT a.o_custkey, a.n FROM big a JOIN big b ON a.o_custkey = b.o_custkey WHERE b.n > 2", "orders")


@query("WITH a AS (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1), b AS (SELECT r_name, n FROM a JOIN region ON k = r_regionkey) SELECT * FROM b WHERE n >= 5")
def cte_nested(t):
    return t.sql("WITH a AS (SELECT n_regionkey AS k, count(*) AS n FROM {nation} GROUP BY 1), b AS (SELECT r_name, n FROM a JOIN {region} ON k = r_regionkey) SELECT * FROM b WHERE n >= 5", "nation", "region")


@query("WITH RECURSIVE f(i, a, b) AS (SELECT 1, 0::BIGINT, 1::BIGINT UNION ALL SELECT i + 1, b, a + b FROM f WHERE i < 40) SELECT i, a FROM f")
def recursive_cte(t):
    return t.spark.sql("WITH RECURSIVE f(i, a, b) AS (SELECT 1, 0L, 1L UNION ALL SELECT i + 1, b, a + b FROM f WHERE i < 40) SELECT i, a FROM f")
