"""Order, limits, and set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import query


@query("""SELECT k, r FROM (SELECT o_orderkey AS k, row_number() OVER (ORDER BY nullif(o_orderstatus, 'F') DESC NULLS LAST, o_orderkey) AS r FROM orders) WHERE r <= 20""")
def order_nulls(t):
    ordered = t.orders.orderBy(F.nullif("o_orderstatus", F.lit("F")).desc_nulls_last(), "o_orderkey").limit(20)
    # twenty rows are left, so one task numbers them
    w = Window.orderBy(F.nullif("o_orderstatus", F.lit("F")).desc_nulls_last(), "o_orderkey")
    return ordered.select(F.col("o_orderkey").alias("k"), F.row_number().over(w).cast("long").alias("r"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def limit_topk(t):
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 50")
def offset_page(t):
    return t.orders.orderBy("o_orderkey").offset(50).limit(25).select("o_orderkey")


@query("SELECT r_name FROM region LIMIT ALL")
def limit_all(t):
    return t.sql("SELECT r_name FROM {region} LIMIT ALL", "region")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 3")
def limit_param(t):
    return t.sql("SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT :n", "orders", args={"n": 3})


@query("SELECT p_partkey, p_size FROM (SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 5")
def with_ties_rank(t):
    """FETCH FIRST 5 ROWS WITH TIES: the fifth value bounds the rows, found by a top-k, not by one sorted window."""
    bound = t.part.select("p_size").orderBy(F.desc("p_size")).limit(5).agg(F.min("p_size").alias("least"))
    return t.part.join(F.broadcast(bound), F.col("p_size") >= F.col("least")).select("p_partkey", "p_size")


_A, _B = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 0"


def _sides(t):
    return t.customer.where("c_acctbal > 0").select(F.col("c_nationkey").alias("k")), t.supplier.where("s_acctbal > 0").select(F.col("s_nationkey").alias("k"))


@query(f"{_A} UNION ALL {_B}")
def union_all(t):
    a, b = _sides(t)
    return a.union(b)


@query(f"{_A} UNION {_B}")
def union(t):
    a, b = _sides(t)
    return a.union(b).distinct()


@query(f"{_A} INTERSECT {_B}")
def intersect(t):
    a, b = _sides(t)
    return a.intersect(b)


@query(f"{_A} INTERSECT ALL {_B}")
def intersect_all(t):
    a, b = _sides(t)
    return a.intersectAll(b)


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9900")
def except_distinct(t):
    return t.nation.select(F.col("n_nationkey").alias("k")).subtract(t.customer.where("c_acctbal > 9900").select("c_nationkey"))


@query(f"{_A} EXCEPT ALL {_B}")
def except_all(t):
    a, b = _sides(t)
    return a.exceptAll(b)


@query("(SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region) EXCEPT (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000 INTERSECT SELECT c_nationkey FROM customer)")
def nested_setops(t):
    both = t.supplier.where("s_acctbal > 8000").select("s_nationkey").intersect(t.customer.select("c_nationkey"))
    return t.nation.select(F.col("n_nationkey").alias("k")).union(t.region.select("r_regionkey")).distinct().subtract(both)


@query("SELECT a AS first, b AS second FROM (SELECT n_nationkey AS a, n_regionkey AS b FROM nation UNION ALL SELECT r_regionkey, r_regionkey FROM region)")
def positional_union(t):
    return t.nation.select("n_nationkey", "n_regionkey").union(t.region.select("r_regionkey", F.col("r_regionkey").alias("again"))).toDF("first", "second")
