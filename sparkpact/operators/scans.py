"""Scans, VALUES, projections, predicates."""

from pyspark.sql import functions as F

from .registry import query


@query("SELECT n_nationkey AS nation_key, upper(n_name) AS nation_name, n_regionkey + 100 AS region_code FROM nation")
def scan_project_alias(t):
    return t.nation.select(F.col("n_nationkey").alias("nation_key"), F.upper("n_name").alias("nation_name"), (F.col("n_regionkey") + 100).alias("region_code"))


@query("SELECT * FROM (VALUES (1, 'one'), (2, 'two'), (3, NULL)) AS v(n, word)")
def values_source(t):
    return t.spark.createDataFrame([(1, "one"), (2, "two"), (3, None)], "n int, word string")


@query("SELECT 42 AS answer, 'x' AS label")
def select_no_from(t):
    return t.spark.sql("SELECT 42 AS answer, 'x' AS label")


@query("SELECT r_name AS name, k FROM (SELECT r_name, r_regionkey * 10 AS k FROM region WHERE r_regionkey > 0) s WHERE k < 40")
def derived_table(t):
    inner = t.region.where("r_regionkey > 0").select("r_name", (F.col("r_regionkey") * 10).alias("k"))
    return inner.where("k < 40").select(F.col("r_name").alias("name"), "k")


@query("SELECT x AS n, x * x AS square FROM generate_series(1, 50) g(x)")
def series_source(t):
    return t.spark.range(1, 51).select(F.col("id").alias("n"), (F.col("id") * F.col("id")).alias("square"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_table_source(t):
    return t.events.select("event_id", F.from_json("props", "k bigint").alias("p")).select("event_id", "p.k")


@query("SELECT n_nationkey, CAST(u.k AS INTEGER) AS k, n_name[u.k:u.k] AS letter FROM nation, LATERAL (SELECT unnest(range(1, n_regionkey + 2)) AS k) u")
def user_table_function(t):
    """A user-defined table function, applied to every row of a table."""

    @F.udtf(returnType="k int, letter string")
    class Letters:
        def eval(self, text: str, n: int):
            for k in range(n):
                yield k + 1, text[k]

    name = "sparkpact_letters"
    t.spark.udtf.register(name, Letters)
    return t.sql(f"SELECT n_nationkey, u.k, u.letter FROM {{nation}}, LATERAL {name}(n_name, n_regionkey + 1) u", "nation")


@query("SELECT r_regionkey, n_name AS name, n_nationkey AS key FROM nation JOIN region ON n_regionkey = r_regionkey")
def xml_table(t):
    """A table from the elements of an XML text."""
    element = F.concat(F.lit("<n><name>"), "n_name", F.lit("</name><key>"), F.col("n_nationkey").cast("string"), F.lit("</key></n>"))
    texts = t.nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.concat(F.lit("<r>"), F.array_join(F.collect_list(element), ""), F.lit("</r>")).alias("x"))
    parsed = texts.select("r_regionkey", F.from_xml("x", "n array<struct<name string, key int>>", {"rowTag": "r"}).alias("r"))
    return parsed.select("r_regionkey", F.inline("r.n"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE (o_orderstatus = 'O' OR o_totalprice > 200000) AND NOT (o_orderpriority = '5-LOW')")
def where_and_or_not(t):
    o = F.col
    return t.orders.where(((o("o_orderstatus") == "O") | (o("o_totalprice") > 200000)) & ~(o("o_orderpriority") == "5-LOW")).select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, nullif(o_orderstatus, 'F') IS NULL AS missing, nullif(o_orderstatus, 'F') IS NOT NULL AS present FROM orders")
def is_null_tests(t):
    s = F.nullif("o_orderstatus", F.lit("F"))
    return t.orders.select("o_orderkey", s.isNull().alias("missing"), s.isNotNull().alias("present"))


@query("""SELECT o_orderkey, (x > 100000) IS TRUE AS is_t, (x > 100000) IS FALSE AS is_f, (x > 100000) IS NULL AS is_u
          FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS x FROM orders)""")
def boolean_tests(t):
    x = F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice"))
    big = x > 100000
    return t.orders.select("o_orderkey", big.eqNullSafe(F.lit(True)).alias("is_t"), big.eqNullSafe(F.lit(False)).alias("is_f"), big.isNull().alias("is_u"))


@query("SELECT o_orderkey, nullif(o_orderstatus, 'F') IS DISTINCT FROM nullif(o_orderpriority, '5-LOW') AS differs FROM orders")
def is_distinct_from(t):
    a, b = F.nullif("o_orderstatus", F.lit("F")), F.nullif("o_orderpriority", F.lit("5-LOW"))
    return t.orders.select("o_orderkey", (~a.eqNullSafe(b)).alias("differs"))


@query("SELECT p_partkey FROM part WHERE (p_size, p_brand) < (10, 'Brand#3') OR (p_size, p_brand) = (20, 'Brand#1')")
def row_compare(t):
    pair = F.struct(F.col("p_size").alias("a"), F.col("p_brand").alias("b"))
    bound = lambda n, s: F.struct(F.lit(n).alias("a"), F.lit(s).alias("b"))
    return t.part.where((pair < bound(10, "Brand#3")) | (pair == bound(20, "Brand#1"))).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P')")
def in_list(t):
    return t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~F.col("o_orderstatus").isin("P")).select("o_orderkey")


@query("SELECT p_partkey, p_size = ANY([1, 5, 9]) AS any_hit, p_size <> ALL([1, 5, 9]) AS all_miss FROM part")
def any_array(t):
    sizes = F.array(*map(F.lit, (1, 5, 9)))
    return t.part.select("p_partkey", F.array_contains(sizes, F.col("p_size")).alias("any_hit"), F.forall(sizes, lambda x: x != F.col("p_size")).alias("all_miss"))


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 25 AND p_name LIKE '%a%' AND regexp_matches(p_brand, '^Brand#[1-3]')")
def between_like_regex(t):
    return t.part.where(F.col("p_size").between(5, 25) & F.col("p_name").like("%a%") & F.col("p_brand").rlike("^Brand#[1-3]")).select("p_partkey")


@query("SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS quantity FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' GROUP BY l_returnflag")
def pushed_filter_scan(t):
    from .registry import money

    return t.lineitem.where("l_shipdate < TIMESTAMP_NTZ '1996-01-01'").groupBy("l_returnflag").agg(F.count("*").alias("n"), money("l_quantity").alias("quantity"))


@query(None)
def table_sample(t):
    """A sampling operator: rows vary by seed alone."""
    return t.orders.sample(fraction=0.1, seed=7).select("o_orderkey")
