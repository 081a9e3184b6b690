"""Scalar expressions, arrays, ranges, JSON."""

from pyspark.sql import functions as F

from ..functions import json_text, null_rows, ranges
from .registry import query


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS as_text, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS as_decimal, CAST(p_size AS BIGINT) AS wide, CAST(CAST(p_size AS DOUBLE) AS INTEGER) AS back FROM part")
def cast_family(t):
    c = F.col
    return t.part.select("p_partkey", c("p_size").cast("string").alias("as_text"), c("p_retailprice").cast("decimal(12,2)").cast("double").alias("as_decimal"), c("p_size").cast("long").alias("wide"), c("p_size").cast("double").cast("int").alias("back"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' END AS size_class FROM part")
def case_searched(t):
    return t.part.select("p_partkey", F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "middle").alias("size_class"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS code FROM orders")
def case_simple(t):
    return t.sql("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS code FROM {orders}", "orders")


@query("SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS status, nullif(o_orderpriority, '5-LOW') AS urgent FROM orders")
def coalesce_nullif(t):
    return t.orders.select("o_orderkey", F.coalesce(F.nullif("o_orderstatus", F.lit("F")), F.lit("none")).alias("status"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("urgent"))


@query("SELECT l_orderkey, l_linenumber, greatest(l_discount, l_tax) AS high, least(l_discount, l_tax, 0.05::DOUBLE) AS low FROM lineitem")
def greatest_least(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.greatest("l_discount", "l_tax").alias("high"), F.least("l_discount", "l_tax", F.lit(0.05)).alias("low"))


@query("SELECT p_partkey, CAST(p_size // 7 AS BIGINT) AS quotient, p_size % 7 AS remainder FROM part")
def int_division(t):
    return t.part.select("p_partkey", F.expr("p_size div 7").alias("quotient"), (F.col("p_size") % 7).alias("remainder"))


@query("SELECT n_nationkey, struct_pack(k := n_nationkey, name := n_name).name AS field FROM nation")
def row_constructor_field(t):
    return t.nation.select("n_nationkey", F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))["name"].alias("field"))


@query("SELECT o_orderkey, (a IS NULL AND b IS NULL) AS none, (a IS NOT NULL AND b IS NOT NULL) AS all_set FROM (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS a, nullif(o_orderpriority, '5-LOW') AS b FROM orders)")
def row_null_tests(t):
    row = F.struct(F.nullif("o_orderstatus", F.lit("F")).alias("a"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("b"))
    return t.orders.select("o_orderkey", null_rows.row_is_null(row, ["a", "b"]).alias("none"), null_rows.row_is_not_null(row, ["a", "b"]).alias("all_set"))


_ARR = "[n_nationkey, n_regionkey, n_nationkey + 1]"


@query(f"""SELECT n_nationkey, list_has_any({_ARR}, [3, 4]) AS overlap, list_has_all({_ARR}, [n_regionkey]) AS contains, CAST(coalesce(list_position({_ARR}, n_regionkey), 0) AS BIGINT) AS pos,
           len(list_filter({_ARR}, lambda x: x <> n_regionkey)) AS rest, {_ARR}[2] AS second FROM nation""")
def array_ops(t):
    a = F.array("n_nationkey", "n_regionkey", F.col("n_nationkey") + 1)
    return t.nation.select("n_nationkey", F.arrays_overlap(a, F.array(F.lit(3), F.lit(4))).alias("overlap"), F.array_contains(a, F.col("n_regionkey")).alias("contains"),
                           F.array_position(a, F.col("n_regionkey")).alias("pos"), F.size(F.array_remove(a, F.col("n_regionkey"))).cast("long").alias("rest"), F.element_at(a, 2).alias("second"))


@query("SELECT vec_id, array_to_string(list_transform(list_slice(embedding, 2, 4), lambda x: CAST(round(x * 1000) AS INTEGER)), ',') AS part FROM embeddings")
def array_slice(t):
    part = F.transform(F.slice("embedding", 2, 3), lambda x: F.round(x.cast("float") * F.lit(1000).cast("float")).cast("int").cast("string"))
    return t.embeddings.select("vec_id", F.array_join(part, ",").alias("part"))


@query("SELECT event_id, CAST(CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 11 ELSE floor(value / 10) + 1 END AS BIGINT) AS bucket FROM events")
def width_bucket_q(t):
    return t.events.select("event_id", F.width_bucket("value", F.lit(0.0), F.lit(100.0), F.lit(10)).alias("bucket"))


@query("""SELECT p_partkey, lo < 20 AND hi > 10 AND lo < hi AS overlap, lo >= hi AS empty, lo <= 15 AND hi > 15 AS has_15, lo <= 12 AND hi >= 14 AS has_range, hi = 20 OR lo = 30 AS adjacent_20_30
          FROM (SELECT p_partkey, p_size AS lo, p_size + 10 AS hi FROM part)""")
def range_struct_ops(t):
    r = ranges.make_range(F.col("p_size"), F.col("p_size") + 10)
    fixed = lambda a, b: ranges.make_range(F.lit(a), F.lit(b))
    return t.part.select("p_partkey", ranges.overlaps(r, fixed(10, 20)).alias("overlap"), ranges.is_empty(r).alias("empty"), ranges.contains_value(r, F.lit(15)).alias("has_15"),
                         ranges.contains_range(r, fixed(12, 14)).alias("has_range"), ranges.adjacent(r, fixed(20, 30)).alias("adjacent_20_30"))


@query("""WITH s AS (SELECT user_id, ts AS lo, ts + INTERVAL 1 HOUR AS hi FROM events),
          m AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
          g AS (SELECT *, count(*) FILTER (WHERE reach IS NULL OR lo > reach) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m)
          SELECT user_id, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY user_id, island""")
def range_merge_islands(t):
    spans = t.events.select("user_id", F.col("ts").alias("lo"), F.expr("ts + INTERVAL 1 HOUR").alias("hi"))
    return ranges.merge_islands(spans, ["user_id"], "lo", "hi")


@query("SELECT l_orderkey, l_linenumber, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) AS days, o_orderdate + INTERVAL 30 DAY AS due FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def date_interval_diff(t):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")).alias("days"), F.expr("o_orderdate + INTERVAL 30 DAY").alias("due"))


@query("SELECT n_nationkey, json_extract_string(j, '$.name') AS name, json_extract_string(j, '$.none') IS NULL AS none_is_null, CAST(len(json_keys(j)) AS INTEGER) AS n FROM (SELECT n_nationkey, json_object('name', n_name, 'none', NULL) AS j FROM nation)")
def json_build_object(t):
    j = json_text.json_object(name=F.col("n_name"), none=F.lit(None).cast("string"))
    return t.nation.select("n_nationkey", F.get_json_object(j, "$.name").alias("name"), F.get_json_object(j, "$.none").isNull().alias("none_is_null"), F.size(F.json_object_keys(j)).alias("n"))


@query("SELECT n_nationkey, CAST(json_array_length(json_array(n_nationkey, n_regionkey, 5)) AS INTEGER) AS n, CAST(json_extract(json_array(n_nationkey, n_regionkey, 5), '$[1]') AS INTEGER) AS second FROM nation")
def json_build_array(t):
    j = F.to_json(F.array("n_nationkey", "n_regionkey", F.lit(5)))
    return t.nation.select("n_nationkey", F.json_array_length(j).alias("n"), F.get_json_object(j, "$[1]").cast("int").alias("second"))


@query("SELECT n_name FROM nation WHERE lower(n_name) = lower('NATION_3') OR lower(n_name) = 'nation_7'")
def case_insensitive_text(t):
    folded = F.collate("n_name", "UTF8_LCASE")
    return t.nation.where((folded == "Nation_3") | (folded == "NATION_7")).select("n_name")


@query("SELECT n_nationkey, struct_extract(n, 'n_name') AS name FROM (SELECT n_nationkey, nation AS n FROM nation)")
def whole_row(t):
    return t.nation.select("n_nationkey", F.struct("*").alias("n")).select("n_nationkey", F.col("n.n_name").alias("name"))


@query("SELECT a, b FROM (SELECT n_nationkey, n_name FROM nation) AS s(a, b) WHERE a > 3")
def column_alias_list(t):
    return t.nation.select("n_nationkey", "n_name").toDF("a", "b").where("a > 3")


@query("""SELECT event_id, event_type || '=' || CAST(user_id AS VARCHAR) AS pair, event_type = 'click' AS has_click, CASE WHEN event_type = 'click' THEN CAST(user_id AS VARCHAR) END AS of_click,
          event_type || ',source' AS keys FROM events""")
def map_values(t):
    """Key-value text type as a map."""
    m = F.create_map(F.col("event_type"), F.col("user_id").cast("string"), F.lit("source"), F.lit("web"))
    return t.events.select("event_id", F.concat(F.map_keys(m)[0], F.lit("="), F.element_at(m, F.col("event_type"))).alias("pair"), F.map_contains_key(m, F.lit("click")).alias("has_click"),
                           F.try_element_at(m, F.lit("click")).alias("of_click"), F.array_join(F.map_keys(m), ",").alias("keys"))


@query("""SELECT n_nationkey, array_to_string(list_transform([n_nationkey, n_regionkey, 1], lambda x: CASE WHEN x = 1 THEN 99 ELSE x END), ',') AS replaced,
          array_to_string(list_sort([n_regionkey, n_nationkey, 1]), ',') AS sorted, [n_nationkey, 5] < [n_regionkey, 6] AS less FROM nation""")
def array_replace_sort(t):
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    a = F.array("n_nationkey", "n_regionkey", F.lit(1))
    less = F.array("n_nationkey", F.lit(5)) < F.array("n_regionkey", F.lit(6))
    return t.nation.select("n_nationkey", text(F.transform(a, lambda x: F.when(x == 1, 99).otherwise(x))).alias("replaced"), text(F.array_sort(F.array("n_regionkey", "n_nationkey", F.lit(1)))).alias("sorted"), less.alias("less"))


@query("SELECT p_brand, CASE WHEN max(p_size) < min(p_size + 30) THEN max(p_size) END AS lo, CASE WHEN max(p_size) < min(p_size + 30) THEN min(p_size + 30) END AS hi FROM part GROUP BY p_brand")
def range_intersect_agg(t):
    """Intersection of a group's half-open ranges: the largest lower and the smallest upper bound."""
    got = t.part.groupBy("p_brand").agg(F.max("p_size").alias("a"), F.min(F.col("p_size") + 30).alias("b"))
    r = ranges.make_range(F.col("a"), F.col("b"))
    return got.select("p_brand", ranges.lower_bound(r).alias("lo"), ranges.upper_bound(r).alias("hi"))


@query("SELECT o_orderkey, date_trunc('month', o_orderdate) AS month, CAST(extract(year FROM o_orderdate) AS INTEGER) AS year, lower(o_orderpriority) AS p, abs(o_totalprice - 100000) AS off FROM orders")
def scalar_library(t):
    month = F.date_trunc("month", F.col("o_orderdate")).cast("timestamp_ntz")
    return t.orders.select("o_orderkey", month.alias("month"), F.year("o_orderdate").alias("year"), F.lower("o_orderpriority").alias("p"), F.abs(F.col("o_totalprice") - 100000).alias("off"))


_SIDES = "SELECT p_partkey, p_size AS al, p_size + 10 AS ah, 20 AS bl, 30 AS bh FROM part"


@query(f"""SELECT p_partkey, CASE WHEN ah < bl THEN al || '-' || ah || ',' || bl || '-' || bh WHEN al > bh THEN bl || '-' || bh || ',' || al || '-' || ah
           ELSE least(al, bl) || '-' || greatest(ah, bh) END AS either, CASE WHEN ah <= bl OR al >= bh THEN al || '-' || ah WHEN al < bl AND ah > bh THEN al || '-' || bl || ',' || bh || '-' || ah
           WHEN al < bl THEN al || '-' || bl WHEN ah > bh THEN bh || '-' || ah ELSE '' END AS rest, CASE WHEN al < bh AND bl < ah THEN greatest(al, bl) || '-' || least(ah, bh) END AS both_in,
           (al, ah) < (bl, bh) AS first, ah <= bh AS not_beyond, al >= bl AS not_under FROM ({_SIDES})""")
def range_union_minus(t):
    a, b = ranges.make_range(F.col("p_size"), F.col("p_size") + 10), ranges.make_range(F.lit(20), F.lit(30))
    text = lambda m: F.array_join(F.transform(m, lambda r: F.concat_ws("-", r["lower"].cast("string"), r["upper"].cast("string"))), ",")
    both = ranges.intersection(a, b)
    return t.part.select("p_partkey", text(ranges.union(a, b)).alias("either"), text(ranges.minus(a, b)).alias("rest"), F.when(~both["empty"], text(F.array(both))).alias("both_in"),
                         ranges.before(a, b).alias("first"), ranges.overleft(a, b).alias("not_beyond"), ranges.overright(a, b).alias("not_under"))


@query("""SELECT p_partkey, (p_size >= 5 AND p_size < 10) OR (p_size >= 20 AND p_size <= 25) AS inside, p_size < 10 AND p_size + 3 > 5 OR p_size <= 25 AND p_size + 3 > 20 AS meets,
          CAST((p_size < 10 AND p_size + 3 > 5)::INT + (p_size <= 25 AND p_size + 3 > 20)::INT AS INTEGER) AS n_parts FROM part""")
def multirange_ops(t):
    m = F.array(ranges.make_range(F.lit(5), F.lit(10)), ranges.make_range(F.lit(20), F.lit(25), True, True))
    own = ranges.make_range(F.col("p_size"), F.col("p_size") + 3)
    return t.part.select("p_partkey", ranges.multirange_contains(m, F.col("p_size")).alias("inside"), ranges.multirange_overlaps(m, own).alias("meets"), F.size(ranges.multirange_intersection(m, own)).alias("n_parts"))


@query("SELECT n_nationkey, n_name AS name, n_regionkey AS region, n_name AS again FROM nation")
def xml_values(t):
    """Elements made of columns, read back by path and by schema."""
    x = F.to_xml(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), {"rowTag": "nation"})
    made = t.nation.select("n_nationkey", x.alias("x"))
    parsed = F.from_xml("x", "name string, region int", {"rowTag": "nation"})
    return made.select("n_nationkey", F.xpath_string("x", F.lit("/nation/name")).alias("name"), F.xpath_int("x", F.lit("/nation/region")).alias("region"), parsed["name"].alias("again"))


@query("SELECT n_nationkey, regexp_replace(regexp_replace(n_name, '[A-Z]', 'Q', 'g'), '[0-9]', '#', 'g') AS masked FROM nation")
def named_arguments(t):
    return t.sql("SELECT n_nationkey, mask(n_name, digitChar => '#', upperChar => 'Q') AS masked FROM {nation}", "nation")


@query("SELECT n_nationkey, greatest(n_nationkey, n_regionkey, 4) AS high, concat_ws('-', n_name, CAST(n_regionkey AS VARCHAR)) AS joined FROM nation")
def array_argument(t):
    """An array in place of a list of arguments."""
    return t.nation.select("n_nationkey", F.array_max(F.array("n_nationkey", "n_regionkey", F.lit(4))).alias("high"), F.concat_ws("-", F.array(F.col("n_name"), F.col("n_regionkey").cast("string"))).alias("joined"))
