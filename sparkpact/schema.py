"""Declared facts of the tables: NOT NULL, keys, allowed values. Parquet gives types only; facts live here.

Facts are declared, then checked against data with ``validation_queries`` before they are trusted.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .contracts.checks import allowed_labels, intersect_labels


@dataclass(frozen=True)
class Key:
    name: str
    columns: tuple[str, ...]
    primary: bool = False

    @property
    def proof(self) -> str:
        return f"{'primary_key_equality' if self.primary else 'unique_index_equality'}:{self.name}"


@dataclass(frozen=True)
class TableFacts:
    not_null: frozenset[str] = frozenset()
    keys: tuple[Key, ...] = ()
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)  # column -> Spark type, in order; empty where only views tell

    def ordered_keys(self) -> list[Key]:
        """Preference: primary, then fewer columns, then name."""
        return sorted(self.keys, key=lambda k: (not k.primary, len(k.columns), k.name))


class Schema(dict):
    """table name -> TableFacts"""

    def declare(self, table: str, not_null: str = "", primary: str = "", unique: tuple[str, ...] = (), **allowed: tuple[str, ...]) -> Schema:
        keys = ([Key(f"{table}_pkey", tuple(primary.split()), True)] if primary else []) + [Key(f"{table}_{'_'.join(u.split())}_key", tuple(u.split())) for u in unique]
        self[table] = TableFacts(frozenset(not_null.split()) | frozenset(primary.split()), tuple(keys), allowed)
        return self

    def check(self, table: str, expression: str) -> Schema:
        """Take up the labels that a CHECK of one column leaves; several CHECKs of a column hold together, and an
        expression that proves no set of labels, or labels that leave nothing, give no fact."""
        facts = self[table]
        for column in facts.types or facts.not_null | set(facts.allowed):
            labels = allowed_labels(expression, column)
            if labels:
                met = intersect_labels([facts.allowed[column], labels]) if column in facts.allowed else labels
                kept = {c: x for c, x in facts.allowed.items() if c != column} | ({column: met} if met else {})
                self[table] = facts = replace(facts, allowed=kept)
        return self

    def column_types(self, spark: SparkSession, table: str) -> dict[str, str]:
        """column -> Spark type in order: as declared, else of the view or table of that name, else nothing."""
        if table in self and self[table].types:
            return dict(self[table].types)
        return dict(spark.table(table).dtypes) if spark.catalog.tableExists(table) else {}

    def register(self, spark: SparkSession, directory: str) -> None:
        """Views of empty Parquet tables under ``directory`` for the tables with declared types: statements can then be
        analyzed by the schema alone."""
        for table, facts in sorted(self.items()):
            if facts.types:
                columns = ", ".join(f"`{c}` {kind if kind != 'unknown' else 'string'}" for c, kind in facts.types.items())
                path = f"{directory.rstrip('/')}/{table}.parquet"
                spark.createDataFrame([], columns).write.mode("overwrite").parquet(path)
                spark.read.parquet(path).createOrReplaceTempView(table)

    def validation_queries(self, spark: SparkSession, names: set[str] | None = None) -> DataFrame:
        """table, fact, violations: rows that break each declared fact; every count must be 0."""
        out = []
        for table, facts in sorted(self.items()):
            if names is not None and table not in names:
                continue
            df = spark.table(table)
            for c in sorted(facts.not_null):
                out.append(df.where(F.col(c).isNull()).agg(F.count("*").alias("violations")).withColumn("fact", F.lit(f"not_null:{c}")).withColumn("table", F.lit(table)))
            for k in facts.keys:
                broken = df.groupBy(*k.columns).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("violations"))
                out.append(broken.withColumn("fact", F.lit(f"unique:{k.name}")).withColumn("table", F.lit(table)))
            for c, labels in facts.allowed.items():
                bad = df.where(F.col(c).isNotNull() & ~F.col(c).isin(*labels)).agg(F.count("*").alias("violations"))
                out.append(bad.withColumn("fact", F.lit(f"allowed:{c}")).withColumn("table", F.lit(table)))
        total = out[0]
        for x in out[1:]:
            total = total.unionByName(x)
        return total.select("table", "fact", "violations")


def testdata_schema() -> Schema:
    s = Schema()
    s.declare("region", "r_name", "r_regionkey", ("r_name",))
    s.declare("nation", "n_name n_regionkey", "n_nationkey", ("n_name",))
    s.declare("customer", "c_name c_nationkey c_mktsegment", "c_custkey", ("c_name",), c_mktsegment=("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))
    s.declare("supplier", "s_name s_nationkey", "s_suppkey")
    s.declare("part", "p_name p_size", "p_partkey")
    s.declare("orders", "o_custkey o_orderstatus o_totalprice", "o_orderkey", o_orderstatus=("F", "O", "P"))
    s.declare("lineitem", "l_orderkey l_linenumber l_quantity", l_returnflag=("A", "N", "R"), l_linestatus=("F", "O"))
    s.declare("events", "ts user_id", "event_id", event_type=("click", "error", "purchase", "signup", "view"))
    return s
