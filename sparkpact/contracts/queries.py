"""Registered queries of the contract passes: contracts as rows, and what running the statements shows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import testdata_schema
from ..statement import Statement, analyze_all, contract_rows

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Statements that both engines run; columns x and y where a statement has two.
STATEMENTS = {
    "unique_lookup": "SELECT c_name AS x FROM customer WHERE c_custkey = 7",
    "join_closure": "SELECT n.n_name AS x FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE o.o_orderkey = 7",
    "global_count": "SELECT count(*) AS x FROM orders",
    "values_rows": "SELECT * FROM (VALUES (1), (2), (NULL)) v(x)",
    "union_all": "SELECT n_nationkey AS x FROM nation UNION ALL SELECT NULL",
    "limited": "SELECT o_orderkey AS x FROM orders ORDER BY o_orderkey LIMIT 7",
    "left_join": "SELECT o.o_orderkey AS x FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 250000) o ON o.o_custkey = c.c_custkey",
    "not_null_after_filter": "SELECT o.o_orderkey AS x FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 250000) o ON o.o_custkey = c.c_custkey WHERE o.o_orderkey IS NOT NULL",
    "case_without_else": "SELECT CASE WHEN o_orderstatus = 'O' THEN o_orderkey END AS x FROM orders",
    "coalesced": "SELECT coalesce(nullif(o_orderstatus, 'F'), 'none') AS x FROM orders",
    "grouped": "SELECT o_orderstatus AS x FROM orders GROUP BY o_orderstatus",
    "having_none": "SELECT count(*) AS x FROM orders HAVING count(*) < 0",
    "empty_except": "SELECT r_regionkey AS x FROM region EXCEPT SELECT r_regionkey FROM region",
}


#: Statements with parameters; commands are analyzed and never run.
WITH_PARAMETERS = {
    "lookup": "SELECT c_name FROM customer WHERE c_custkey = :id",
    "limited": "SELECT o_orderkey FROM orders LIMIT :n",
    "insert": "-- @nullable s\nINSERT INTO orders (o_custkey, o_orderstatus, o_orderpriority) VALUES (:k, 'F', :s)",
    "insert_select": "INSERT INTO orders (o_custkey) SELECT k FROM (SELECT :k AS k) s",
    "insert_filtered": "INSERT INTO orders (o_custkey) SELECT k FROM (SELECT :k AS k) s WHERE 1 = 0",
    "insert_cast": "INSERT INTO orders (o_orderpriority) SELECT upper(:p)",
    "update": "UPDATE orders SET o_orderstatus = :s WHERE o_orderkey = :k",
    "delete": "DELETE FROM orders WHERE o_orderkey = :k AND o_orderstatus = 'F'",
    "delete_one": "DELETE FROM orders WHERE o_orderkey = :k",
    "merge": "MERGE INTO orders t USING customer s ON t.o_custkey = s.c_custkey WHEN MATCHED THEN UPDATE SET o_orderpriority = :p",
}

#: Statements whose first column shows one fact each.
FACTS = {
    "labels": "SELECT o_orderstatus AS x FROM orders",
    "labels_union": "SELECT o_orderstatus AS x FROM orders UNION ALL SELECT l_returnflag FROM lineitem",
    "labels_intersect": "SELECT o_orderstatus AS x FROM orders INTERSECT SELECT l_linestatus FROM lineitem",
    "labels_lost": "SELECT upper(o_orderstatus) AS x FROM orders",
    "json_object": "SELECT to_json(named_struct('id', c_custkey, 'bal', c_acctbal, 'kind', 'x')) AS x FROM customer",
    "json_array": "SELECT coalesce(to_json(collect_list(c_custkey)), '[]') AS x FROM customer",
    "json_case": "SELECT CASE WHEN c_custkey > 1 THEN to_json(named_struct('a', c_custkey)) WHEN c_custkey > 0 THEN to_json(named_struct('b', c_name)) END AS x FROM customer",
    "json_opaque": "SELECT CASE WHEN c_custkey > 1 THEN to_json(named_struct('a', c_custkey)) ELSE c_name END AS x FROM customer",
    "recursion": "WITH RECURSIVE t(n, a, b) AS (SELECT 1, 1, 1 UNION ALL SELECT n + 1, CAST(NULL AS INT), a FROM t WHERE n < 4) SELECT b AS x FROM t",
    "recursion_sound": "WITH RECURSIVE t(n, a, b) AS (SELECT 1, 1, 1 UNION ALL SELECT n + 1, 5, a FROM t WHERE n < 4) SELECT b AS x FROM t",
    "parameter": "SELECT :a AS x FROM customer WHERE c_acctbal > :a OR :a IS NULL",
    "unused_volatile": "WITH u AS (SELECT rand() AS r) SELECT 1 AS x",
    "volatile": "WITH u AS (SELECT rand() AS r) SELECT r AS x FROM u",
    "alias_of_other": "SELECT nation.o_orderkey AS x FROM orders AS nation WHERE nation.o_custkey = 1",
    "filtered_function": "SELECT upper(c_name) AS x FROM customer WHERE upper(c_name) IS NOT NULL",
}


def shape_text(shape) -> str | None:
    """A JSON shape as text: {name: shape}, [element], a | b, a type, "a text", or json where nothing is known; a field
    that may be null ends in a question mark."""
    if not shape:
        return None
    kind, *rest = shape
    if kind == "object":
        return "{" + ", ".join(f"{n}: {shape_text(x)}{'' if null == 'nonNull' else '?'}" for n, x, null in rest[0]) + "}"
    if kind == "array":
        return f"[{shape_text(rest[0])}]"
    if kind == "union":
        return " | ".join(map(shape_text, rest[0]))
    return "json" if kind == "opaque" else f'"{rest[0]}"' if kind == "stringLiteral" else str(rest[0])


def _views(spark: SparkSession, sf_dir: str) -> None:
    for t in _TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def contracts_of(spark: SparkSession, sf_dir: str):
    _views(spark, sf_dir)
    schema = testdata_schema()
    return analyze_all([Statement(spark, sql, schema, name) for name, sql in STATEMENTS.items()])


def statement_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of each statement, derived without running it; lists as text."""
    rows = contract_rows(spark, contracts_of(spark, sf_dir))
    listed = {c: F.array_join(c, ",").alias(c) for c in ("access_reasons", "check_labels")}
    return rows.select(*(listed.get(c, F.col(c)) for c in rows.columns if c != "json_shape"))


def parameter_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """statement, command, parameter, type, nullable, admission, labels of queries and commands, none of them run."""
    _views(spark, sf_dir)
    schema, rows = testdata_schema(), []
    for name, sql in WITH_PARAMETERS.items():
        c = Statement(spark, sql, schema, name).analyze()
        rows += [(name, c.command, p.name, p.type, p.nullable, p.admission, ",".join(p.labels) if p.labels else None) for p in c.params]
    return spark.createDataFrame(rows, "statement string, command string, parameter string, type string, nullable boolean, admission string, labels string")


def column_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """statement, access, cardinality, null_kind, labels, shape of the first column of each statement."""
    _views(spark, sf_dir)
    schema, rows = testdata_schema(), []
    for name, sql in FACTS.items():
        c = Statement(spark, sql, schema, name).analyze()
        x = c.columns[0]
        rows.append((name, c.access, c.cardinality, x.null.kind, ",".join(x.labels) if x.labels else None, shape_text(x.shape)))
    return spark.createDataFrame(rows, "statement string, access string, cardinality string, null_kind string, labels string, shape string")


def soundness_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """statement, n_rows, n_nulls of each statement, run."""
    _views(spark, sf_dir)
    parts = [spark.sql(sql).agg(F.lit(name).alias("statement"), F.count("*").alias("n_rows"), F.count_if(F.col("x").isNull()).alias("n_nulls")) for name, sql in STATEMENTS.items()]
    return reduce(DataFrame.unionByName, parts)


def declared_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of each declared fact; every count must be 0."""
    _views(spark, sf_dir)
    return testdata_schema().validation_queries(spark)


_SOUND = " UNION ALL ".join(f"SELECT '{name}' AS statement, count(*) AS n_rows, CAST(count(*) FILTER (WHERE x IS NULL) AS BIGINT) AS n_nulls FROM ({sql}) s" for name, sql in STATEMENTS.items())


def _fact_sql() -> str:
    out = []
    for table, facts in sorted(testdata_schema().items()):
        out += [f"SELECT '{table}' AS \"table\", 'not_null:{c}' AS fact, count(*) - count({c}) AS violations FROM {table}" for c in sorted(facts.not_null)]
        for k in facts.keys:
            cols = ", ".join(k.columns)
            out.append(f"SELECT '{table}', 'unique:{k.name}', (SELECT count(*) FROM (SELECT {cols} FROM {table} GROUP BY {cols} HAVING count(*) > 1))")
        for c, labels in facts.allowed.items():
            listed = ", ".join(f"'{v}'" for v in labels)
            out.append(f"SELECT '{table}', 'allowed:{c}', count(*) FILTER (WHERE {c} IS NOT NULL AND {c} NOT IN ({listed})) FROM {table}")
    return " UNION ALL ".join(out)


#: The contracts that the rules of analysis give, written out by hand.
_CONTRACTS = """
SELECT statement, 'select' AS command, 'read' AS access, '' AS access_reasons, cardinality, CAST(rows_min AS BIGINT) AS rows_min, CAST(rows_max AS BIGINT) AS rows_max, rows_proof,
       CAST(0 AS INTEGER) AS col_ordinal, 'x' AS col_name, col_type, null_kind, null_why, source_kind, source_name, check_labels
FROM (VALUES
  ('unique_lookup', 'optional', 0, 1, 'primary_key_equality:customer_pkey', 'string', 'nonNull', 'declared_not_null', 'tableColumn', 'customer.c_name', NULL),
  ('join_closure', 'optional', 0, 1, 'unique_join_closure(primary_key_equality:orders_pkey,primary_key_equality:customer_pkey,primary_key_equality:nation_pkey)', 'string', 'nonNull', 'declared_not_null', 'tableColumn', 'nation.n_name', NULL),
  ('global_count', 'one', 1, 1, 'global_aggregate', 'bigint', 'nonNull', 'count', 'expression', 'AggregateExpression', NULL),
  ('values_rows', 'many', 3, 3, 'values_3_rows', 'int', 'nullable', 'values', 'derivedVar', 'col1', NULL),
  ('union_all', 'many', 1, NULL, 'union_all(unbounded,select_without_from)', 'int', 'nullable', 'constant', 'expression', 'set_operation', NULL),
  ('limited', 'many', 0, 7, 'unbounded+constant_limit_7', 'bigint', 'nonNull', 'declared_not_null', 'tableColumn', 'orders.o_orderkey', NULL),
  ('left_join', 'many', 0, NULL, 'unbounded', 'bigint', 'nullable', 'outer_join', 'tableColumn', 'orders.o_orderkey', NULL),
  ('not_null_after_filter', 'many', 0, NULL, 'unbounded', 'bigint', 'nonNull', 'predicate', 'tableColumn', 'orders.o_orderkey', NULL),
  ('case_without_else', 'many', 0, NULL, 'unbounded', 'bigint', 'nullable', 'missing_else', 'expression', 'CaseWhen', NULL),
  ('coalesced', 'many', 0, NULL, 'unbounded', 'string', 'nonNull', 'coalesce', 'expression', 'Coalesce', NULL),
  ('grouped', 'many', 0, NULL, 'unbounded', 'string', 'nonNull', 'declared_not_null', 'tableColumn', 'orders.o_orderstatus', 'F,O,P'),
  ('having_none', 'optional', 0, 1, 'global_aggregate_with_having', 'bigint', 'nonNull', 'count', 'expression', 'AggregateExpression', NULL),
  ('empty_except', 'many', 0, NULL, 'except(unbounded,unbounded)', 'int', 'nonNull', 'declared_not_null', 'tableColumn', 'region.r_regionkey', NULL)
) v(statement, cardinality, rows_min, rows_max, rows_proof, col_type, null_kind, null_why, source_kind, source_name, check_labels)
"""

_PARAMETERS = """
SELECT * FROM (VALUES
  ('lookup', 'select', 'id', 'bigint', FALSE, 'accepts', NULL),
  ('limited', 'select', 'n', 'int', FALSE, 'rejects', NULL),
  ('insert', 'insert', 'k', 'bigint', FALSE, 'rejects', NULL),
  ('insert', 'insert', 's', 'string', TRUE, 'accepts', NULL),
  ('insert_select', 'insert', 'k', 'bigint', FALSE, 'rejects', NULL),
  ('insert_filtered', 'insert', 'k', 'bigint', FALSE, 'unknown', NULL),
  ('insert_cast', 'insert', 'p', 'unknown', FALSE, 'unknown', NULL),
  ('update', 'update', 's', 'string', FALSE, 'rejects', 'F,O,P'),
  ('update', 'update', 'k', 'bigint', FALSE, 'accepts', NULL),
  ('delete', 'delete', 'k', 'bigint', FALSE, 'unknown', NULL),
  ('delete_one', 'delete', 'k', 'bigint', FALSE, 'accepts', NULL),
  ('merge', 'merge', 'p', 'string', FALSE, 'accepts', NULL)
) v(statement, command, parameter, type, nullable, admission, labels)
"""

_FACTS = """
SELECT * FROM (VALUES
  ('labels', 'read', 'many', 'nonNull', 'F,O,P', NULL),
  ('labels_union', 'read', 'many', 'nullable', 'F,O,P,A,N,R', NULL),
  ('labels_intersect', 'read', 'many', 'nonNull', 'F,O', NULL),
  ('labels_lost', 'read', 'many', 'unknown', NULL, NULL),
  ('json_object', 'read', 'many', 'nonNull', NULL, '{id: long, bal: double?, kind: "x"}'),
  ('json_array', 'read', 'one', 'nonNull', NULL, '[long]'),
  ('json_case', 'read', 'many', 'nullable', NULL, '{a: long} | {b: string}'),
  ('json_opaque', 'read', 'many', 'nonNull', NULL, 'json'),
  ('recursion', 'read', 'many', 'nullable', NULL, NULL),
  ('recursion_sound', 'read', 'many', 'nonNull', NULL, NULL),
  ('parameter', 'read', 'many', 'unknown', NULL, NULL),
  ('unused_volatile', 'read', 'one', 'nonNull', NULL, NULL),
  ('volatile', 'write', 'one', 'unknown', NULL, NULL),
  ('alias_of_other', 'read', 'many', 'nonNull', NULL, NULL),
  ('filtered_function', 'read', 'many', 'nonNull', NULL, NULL)
) v(statement, access, cardinality, null_kind, labels, shape)
"""


def queries() -> dict:
    return {f.__name__: f for f in (statement_contracts, parameter_contracts, column_facts, soundness_rows, declared_facts)}


def oracle_sql() -> dict[str, str]:
    return {"statement_contracts": _CONTRACTS, "parameter_contracts": _PARAMETERS, "column_facts": _FACTS, "soundness_rows": _SOUND, "declared_facts": _fact_sql()}
