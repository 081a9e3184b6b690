"""Contracts: goldens pin precision, and running the statement shows that each verdict is true."""

from dataclasses import replace

import pytest

from sparkpact.schema import Schema, testdata_schema
from sparkpact.source import SourceError
from sparkpact.statement import ContractError, Statement, analyze_all, contract_rows

SCHEMA = testdata_schema()


def contract(views, sql, schema=SCHEMA):
    return Statement(views, sql, schema).analyze()


BOUNDS = [
    ("select * from (values (1), (2), (3)) v(x)", 3, 3, "values_3_rows"),
    ("select 1 as x", 1, 1, "select_without_from"),
    ("select 1 as x where rand() < 2", 0, 1, "select_without_from_with_qual"),
    ("select c_name from customer where c_custkey = :id", 0, 1, "primary_key_equality:customer_pkey"),
    ("select c_custkey from customer where c_name = 'x' and c_acctbal > 0", 0, 1, "unique_index_equality:customer_c_name_key"),
    ("select c_name from customer where c_custkey > 5", 0, None, "unbounded"),
    ("select c_name from customer where c_custkey = 5 or c_custkey = 6", 0, None, "unbounded"),
    ("select l_quantity from lineitem where l_orderkey = 1 and l_linenumber = 1", 0, None, "unbounded"),
    ("select n_name from orders o join customer c on c.c_custkey = o.o_custkey join nation n on n.n_nationkey = c.c_nationkey where o.o_orderkey = :k", 0, 1, "unique_join_closure(primary_key_equality:orders_pkey,primary_key_equality:customer_pkey,primary_key_equality:nation_pkey)"),
    ("select n_name from orders o left join customer c on c.c_custkey = o.o_custkey join nation n on n.n_nationkey = c.c_nationkey where o.o_orderkey = 1", 0, None, "unbounded"),
    ("select c.c_name from customer c join orders o on o.o_custkey = c.c_custkey where c.c_custkey = 1", 0, None, "unbounded"),
    ("select count(*) as n from orders", 1, 1, "global_aggregate"),
    ("select count(*) as n from orders having count(*) > 5", 0, 1, "global_aggregate_with_having"),
    ("select o_custkey, count(*) as n from orders group by o_custkey", 0, None, "unbounded"),
    ("select o_orderstatus, count(*) as n from orders group by grouping sets ((o_orderstatus), ())", 0, None, "unbounded"),
    ("select o_orderkey from orders limit 7", 0, 7, "unbounded+constant_limit_7"),
    ("select 1 as x limit 0", 0, 0, "select_without_from+constant_limit_0"),
    ("select o_orderkey from orders limit :n", 0, None, "unbounded+dynamic_limit_can_drop_rows"),
    ("select 1 as x union all select 2", 2, 2, "union_all(select_without_from,select_without_from)"),
    ("select 1 as x union select 1", 1, 2, "union(select_without_from,select_without_from)"),
    ("select 1 as x intersect select 1", 0, 1, "intersect(select_without_from,select_without_from)"),
    ("select 1 as x except select 1", 0, 1, "except(select_without_from,select_without_from)"),
    ("select x from (select count(*) as x from orders) s", 1, 1, "subquery_projection:global_aggregate"),
    ("select x from (select count(*) as x from orders) s where x > 1", 0, 1, "subquery_projection:global_aggregate"),
    ("with c as (select count(*) as x from orders) select x from c", 1, 1, "cte_projection:global_aggregate"),
    ("select explode(array(1, 2)) as x", 0, None, "target_srf"),
    ("select row_number() over (order by c_custkey) as r from customer where c_custkey = 1", 0, None, "unbounded"),
]


@pytest.mark.parametrize("sql,low,high,proof", BOUNDS)
def test_row_bounds(views, sql, low, high, proof):
    got = contract(views, sql).bounds
    assert (got.min, got.max, got.proof) == (low, high, proof)
    args = {p: 1 for p in Statement(views, sql, SCHEMA).parameters}
    n = views.sql(sql, args=args).count()
    assert got.min <= n and (got.max is None or n <= got.max)


NULLS = [
    ("select c_custkey as x from customer", "nonNull"),
    ("select c_acctbal as x from customer", "nullable"),
    ("select o.o_custkey as x from customer c left join orders o on o.o_custkey = c.c_custkey", "nullable"),
    ("select c.c_custkey as x from customer c left join orders o on o.o_custkey = c.c_custkey", "nonNull"),
    ("select o.o_custkey as x from customer c left join orders o on o.o_custkey = c.c_custkey where o.o_custkey is not null", "nonNull"),
    ("select o.o_custkey as x from customer c left join orders o on o.o_custkey = c.c_custkey where o.o_custkey is not null or c.c_custkey = 1", "nullable"),
    ("select coalesce(c_acctbal, 0.0) as x from customer", "nonNull"),
    ("select coalesce(c_acctbal, null) as x from customer", "nullable"),
    ("select case when c_acctbal is not null then c_acctbal else 0.0 end as x from customer", "nonNull"),
    ("select case when c_acctbal > 0 then c_acctbal else 0.0 end as x from customer", "nullable"),
    ("select case when c_custkey > 0 then 1 end as x from customer", "nullable"),
    ("select count(*) as x from customer", "nonNull"),
    ("select max(c_custkey) as x from customer", "unknown"),
    ("select c_custkey + 1 as x from customer", "unknown"),
    ("select c_acctbal is null as x from customer", "nonNull"),
    ("select array(c_acctbal) as x from customer", "nonNull"),
    ("select null as x", "nullable"),
    ("select cast(c_nationkey as bigint) as x from customer", "nonNull"),
    ("select exists(select 1 from orders) as x", "nonNull"),
    ("select (select count(*) from orders) as x", "nonNull"),
    ("select (select c_custkey from customer where c_custkey = 1) as x", "unknown"),
    ("select (select 1 limit 0) as x", "nullable"),
    ("select c_custkey as x from customer union all select null", "nullable"),
    ("select c_custkey as x from customer intersect select c_nationkey from customer", "nonNull"),
    ("select c_custkey as x from customer except select 1", "nonNull"),
    ("with recursive r(x) as (select 1 union all select x from r where x < 1) select x from r", "nonNull"),
    ("select row_number() over (order by c_custkey) as x from customer", "unknown"),
]


@pytest.mark.parametrize("sql,kind", NULLS)
def test_nullability(views, sql, kind):
    got = contract(views, sql).columns[0].null
    assert got.kind == kind, got
    if kind == "nonNull":
        assert views.sql(sql).where("x is null").count() == 0


#: (statement, values of its parameters, verdict on the first column); with NULL for every parameter that takes it.
WITH_PARAMETERS = [
    ("select :a as x, c_name from customer where c_acctbal > :a or :a is null", {"a": 5.0}, "unknown"),
    ("select coalesce(:a, :b) as x, c_name from customer where c_name <> :b or :a is null", {"a": None, "b": None}, "unknown"),
    ("select coalesce(c_acctbal > 0, :a) as x from customer", {"a": True}, "unknown"),
    ("select coalesce(:a, false) as x from customer", {"a": True}, "nonNull"),
    ("select :a + cast(1 as decimal(3, 1)) as x, 1 as one from customer limit 1", {"a": 3}, "unknown"),
    ("select 1 as x, cast(:a as decimal(5, 2)) as y from customer", {"a": 1}, "nonNull"),
    ("select :a as x where date '2000-01-01' < :a or :a is null", {"a": None}, "unknown"),
    ("select x from values (:a), (2) as v(x)", {"a": 1}, "unknown"),
    ("select y as x from (select 1 as z, cast(:a as string) as y) s", {"a": "t"}, "unknown"),
]


@pytest.mark.parametrize("sql,args,kind", WITH_PARAMETERS)
def test_nullability_under_parameters(views, sql, args, kind):
    got = contract(views, sql)
    assert got.columns[0].null.kind == kind, got.columns[0]
    if kind == "nonNull":
        for values in (args, dict.fromkeys(args)):
            assert views.sql(sql, args=values).where("x is null").count() == 0


def test_literals_beside_parameters(views):
    """A literal that looks like a bound value is a literal."""
    c = contract(views, "select 'a' as x, :t as t, 1 as one from customer where c_acctbal > :a or c_custkey = 910000000 limit 1")
    assert c.columns[0].labels == ("a",) and c.columns[1].labels is None and c.columns[2].null.kind == "nonNull" and c.bounds.max == 1


RECURSIVE = [
    ("with recursive t(n, a, b) as (select 1, 1, 1 union all select n + 1, cast(null as int), a from t where n < 4) select b as x from t", False),
    ("with recursive t(n, a, b) as (select 1, 1, 1 union all select n + 1, 5, a from t where n < 4) select b as x from t", True),
    ("with recursive t(n, a) as (select 1, cast(null as int) union all select n + 1, 7 from t where n < 4) select a as x from t", False),
]


@pytest.mark.parametrize("sql,proved", RECURSIVE)
def test_recursion(views, sql, proved):
    kind = contract(views, sql).columns[0].null.kind
    assert (kind == "nonNull") == proved and (views.sql(sql).where("x is null").count() == 0) == proved


def test_facts_hold_for_the_bare_relation_only(views):
    whole = views.table("nation")
    try:
        whole.unionByName(whole).createOrReplaceTempView("nation")
        assert views.sql("select n_name from nation where n_nationkey = 1").count() == 2
        assert contract(views, "select n_name from nation where n_nationkey = 1").bounds.max is None
        assert contract(views, "select n.n_name from nation n where n.n_nationkey = 1").bounds.max is None
    finally:
        whole.createOrReplaceTempView("nation")
    assert contract(views, "select n_name from nation where n_nationkey = 1").bounds.max == 1
    assert contract(views, "select n.n_name from nation n where n.n_nationkey = 1").bounds.max == 1
    # another table under a declared name, and a view over the table
    assert contract(views, "select nation.o_orderkey from orders as nation where nation.o_custkey = 1").bounds.max is None
    views.sql("create or replace temporary view few as select * from nation where n_regionkey = 1")
    views.sql("create or replace temporary view twice as select * from nation union all select * from nation")
    assert contract(views, "select n_name from twice where n_nationkey = 1").bounds.max is None
    for sql in ("select n_name from few where n_nationkey = 1", "select f.n_name from few f join customer c on c.c_nationkey = f.n_nationkey where c.c_custkey = 3"):
        got = contract(views, sql).bounds
        assert got.max is None or views.sql(sql).count() <= got.max


def test_unused_definitions_are_not_executed(views):
    assert contract(views, "with u as (select rand() as r) select 1 as x").access == "read"
    assert contract(views, "with u as (select rand() as r), v as (select r from u) select r as x from v").access == "write"
    assert contract(views, "with u as (select uuid() as r), v as (select 1 as y) select y as x from v").access == "read"
    assert contract(views, "with u as (select rand() as r) select 1 as x where exists (select 1 from u)").access == "write"


ENDPOINTS = [
    ("select r.lower as x from spans", "nullable"),
    ("select r.lower as x from spans where r.lower is not null", "nonNull"),
    ("select r.upper as x from spans where r.lower is not null", "nullable"),
    ("select r.lower as x from spans where not r.empty and not (not r.empty and r.lower is null)", "nonNull"),
    ("select r.upper as x from spans where not r.empty and not (not r.empty and r.lower is null)", "nullable"),
    ("select r.lower as x from spans where not r.empty", "nullable"),
    ("select r.lower as x from spans where r.lower is not null or r.upper is not null", "nullable"),
    ("select s.r.lower as x from (select 1 as k) a left join (select 1 as k, r from spans where r.lower is not null) s on s.k = a.k", "nullable"),
    ("select upper(name) as x from spans where upper(name) is not null", "nonNull"),
    ("select lower(name) as x from spans where upper(name) is not null", "unknown"),
]


@pytest.mark.parametrize("sql,kind", ENDPOINTS)
def test_range_endpoints(views, tmp_path_factory, sql, kind):
    from pyspark.sql import functions as F

    from sparkpact.functions import ranges

    folder = f"file://{tmp_path_factory.getbasetemp()}/spans.parquet"
    rows = views.createDataFrame([(1, 5, "a"), (None, 5, "b"), (3, None, None), (7, 7, "c")], "lo int, hi int, name string")
    rows.select(ranges.make_range(F.col("lo"), F.col("hi")).alias("r"), "name").write.mode("overwrite").parquet(folder)
    views.read.parquet(folder).createOrReplaceTempView("spans")
    got = contract(views, sql, Schema().declare("spans", "")).columns[0].null
    assert got.kind == kind, got
    if kind == "nonNull":
        assert views.sql(sql).where("x is null").count() == 0


def test_parameters(views):
    c = contract(views, "select c_name, :tag as tag from customer where c_custkey = :id and c_name <> :name limit :n")
    kinds = {p.name: (p.type, p.admission) for p in c.params}
    assert kinds["id"] == ("bigint", "accepts") and kinds["name"] == ("string", "accepts") and kinds["n"] == ("int", "rejects")
    assert c.columns[1].null.kind == "unknown"


def test_access(views):
    assert contract(views, "select 1 as x").access == "read"
    assert contract(views, "select current_timestamp() as x").access == "read"
    assert contract(views, "select rand() as x").access_reasons == ["volatileExecution"]
    assert contract(views, "select 1 as x where exists (select 1 from orders where rand() < 0.5)").access == "write"
    assert contract(views, "insert into t values (1)").access_reasons == ["definiteDml(insert)"]
    for bad in ("show tables", "explain select 1", "create table t (a int)"):
        with pytest.raises(ContractError):
            contract(views, bad)


def test_allowed_values(views):
    assert contract(views, "select o_orderstatus as s from orders").columns[0].labels == ("F", "O", "P")
    assert contract(views, "select s from (select o_orderstatus as s from orders) q").columns[0].labels == ("F", "O", "P")
    both = contract(views, "select o_orderstatus as s from orders union all select l_returnflag from lineitem").columns[0]
    assert set(both.labels) == {"F", "O", "P", "A", "N", "R"}
    assert contract(views, "select o_orderstatus as s from orders union all select c_name from customer").columns[0].labels is None
    assert contract(views, "select upper(o_orderstatus) as s from orders").columns[0].labels is None


def test_json_shapes(views):
    c = contract(views, "select to_json(named_struct('id', c_custkey, 'bal', c_acctbal)) as j from customer").columns[0]
    assert c.shape == ("object", (("id", ("scalar", "long"), "nonNull"), ("bal", ("scalar", "double"), "nullable")))
    assert contract(views, "select to_json(collect_list(c_custkey)) as j from customer").columns[0].shape == ("array", ("scalar", "long"))
    assert contract(views, "select upper(c_name) as j from customer").columns[0].shape is None
    one, two = ("object", (("a", ("scalar", "long"), "nonNull"),)), ("object", (("b", ("scalar", "string"), "nonNull"),))
    shape = lambda sql: contract(views, sql).columns[0].shape
    case = "select case when c_custkey > 1 then to_json(named_struct('a', c_custkey)) {} end as j from customer"
    assert shape(case.format("")) == one and shape(case.format("else null")) == one
    assert shape(case.format("else to_json(named_struct('b', c_name))")) == ("union", (one, two))
    assert shape(case.format("else c_name")) == ("opaque",)
    assert shape("select to_json(named_struct('a', c_name, 'a', c_custkey)) as j from customer") == one
    assert shape("select to_json(array(named_struct('a', c_custkey), named_struct('a', c_custkey))) as j from customer") == ("array", one)
    assert shape("select (select to_json(named_struct('a', c_custkey)) from customer limit 1) as j") == one
    assert shape("select to_json(named_struct('a', c_custkey)) as j from customer union all select to_json(named_struct('b', c_name)) from customer") == ("union", (one, two))
    assert shape("select coalesce(to_json(collect_list(c_custkey)), '[]') as j from customer") == ("array", ("scalar", "long"))
    assert shape("select coalesce(to_json(named_struct('a', c_custkey)), '{}') as j from customer") == ("opaque",)


def test_gates(views):
    Statement(views, "-- @access read\n-- @column n bigint\nselect count(*) as n from orders", SCHEMA).analyze()
    for text in ("-- @access read\nselect rand() as x", "-- @column n int\nselect count(*) as n from orders", "-- @column m\nselect 1 as n", "-- @nullable n\nselect 1 as x limit :n"):
        with pytest.raises(ContractError):
            Statement(views, text, SCHEMA).analyze()
    with pytest.raises(SourceError):
        Statement(views, "-- @nullable other\nselect :n as x", SCHEMA)


def test_commands(views):
    """Types, labels and NULL admission of a command's parameters, and the gate that reads them."""
    schema = Schema().declare("acc", "email", "id", status=("a", "b"))
    schema["acc"] = replace(schema["acc"], types={"id": "bigint", "email": "string", "display_name": "string", "status": "string"})
    insert = "insert into acc (email, display_name, status) values (:email, :display_name, :status)"
    c = Statement(views, f"-- @nullable display_name\n{insert}", schema).analyze()
    assert (c.access, c.command, c.bounds.max) == ("write", "insert", 0)
    assert [(p.name, p.type, p.nullable, p.admission, p.labels) for p in c.params] == [("email", "string", False, "rejects", None), ("display_name", "string", True, "accepts", None), ("status", "string", False, "accepts", ("a", "b"))]
    with pytest.raises(ContractError, match="@nullable email"):
        Statement(views, f"-- @nullable email\n{insert}", schema).analyze()
    c = Statement(views, "update acc set display_name = :n where id = :i", schema).analyze()
    assert [(p.name, p.type, p.admission) for p in c.params] == [("n", "string", "accepts"), ("i", "bigint", "accepts")]
    c = Statement(views, "update acc set display_name = :n, id = :n", schema).analyze()
    assert [(p.name, p.type) for p in c.params] == [("n", "unknown")]
    merge = "merge into acc t using nation s on t.id = s.n_nationkey when matched then update set status = :s when not matched then insert (id, email) values (s.n_nationkey, :e)"
    assert [(p.name, p.type, p.labels, p.admission) for p in Statement(views, merge, schema).analyze().params] == [("s", "string", ("a", "b"), "accepts"), ("e", "string", None, "unknown")]


LINEAGE = [
    ("insert into acc (email) select e from (select :e as e) s", "rejects"),
    ("insert into acc (email) select s.e from (select :e as e, 1 as k) s", "rejects"),
    ("insert into acc (email) select e from (select cast(:e as string) as e) s", "unknown"),
    ("insert into acc (email) select e from (select :e as e) s where 1 = 0", "unknown"),
    ("insert into acc (email) select :e union all select 'x'", "rejects"),
    ("insert into acc (email) select 'x' union all select e from values (:e), ('y') as v(e)", "rejects"),
    ("insert into acc (email) with c as (select :e as e) select e from c", "rejects"),
    ("insert into acc (email) select distinct :e", "rejects"),
    ("insert into acc (email) select s.e from (select :e as e) s join nation on true", "unknown"),
    ("insert into acc (display_name) select s.e from (select :e as e) s join nation on true", "accepts"),
    ("insert into acc (display_name) select e from (select :e as e group by 1) s", "accepts"),
    ("insert into acc (email) select * from (select :e as e) s", "rejects"),
    ("insert into acc (email) select n_name from nation where n_name = :e", "unknown"),
]


@pytest.mark.parametrize("sql,admission", LINEAGE)
def test_lineage(views, sql, admission):
    schema = Schema().declare("acc", "email", "id")
    schema["acc"] = replace(schema["acc"], types={"id": "bigint", "email": "string", "display_name": "string"})
    assert [p.admission for p in Statement(views, sql, schema).analyze().params] == [admission]


def test_execution(views):
    s = Statement(views, "select c_name from customer where c_custkey = :id", SCHEMA)
    known = views.table("customer").first()
    assert s.one(id=known.c_custkey).c_name == known.c_name
    assert s.optional(id=-1) is None
    with pytest.raises(ContractError):
        s.one(id=-1)
    with pytest.raises(ContractError):
        Statement(views, "select c_name from customer", SCHEMA).optional()
    with pytest.raises(SourceError):
        s.many()


def test_batch(views):
    good, bad = Statement(views, "select 1 as x", SCHEMA, "a"), Statement(views, "select nope as x", SCHEMA, "b")
    worse = Statement(views, "-- @access read\nselect rand() as x", SCHEMA, "c")
    assert [c.statement for c in analyze_all([good, good])] == ["a", "a"]
    with pytest.raises(ContractError, match="(?s)b:.*c:"):
        analyze_all([good, bad, worse])
    assert contract_rows(views, analyze_all([good])).count() == 1


def test_declared_facts_hold(views):
    assert SCHEMA.validation_queries(views).where("violations > 0").collect() == []


def test_undeclared_facts_are_not_used(views):
    assert contract(views, "select c_custkey as x from customer where c_custkey = 1", Schema()).bounds.max is None


def test_udf_volatility(views):
    from pyspark.sql.functions import udf

    views.udf.register("steady", udf(lambda x: x, "int"))
    views.udf.register("shaky", udf(lambda x: x, "int").asNondeterministic())
    assert contract(views, "select steady(c_nationkey) as x from customer").access == "read"
    assert contract(views, "select shaky(c_nationkey) as x from customer").access_reasons == ["volatileExecution"]


def test_zero_columns(views):
    assert views.range(1).select().columns == [] and views.range(1).select().count() == 1


def test_analysis_runs_no_job(views):
    """A contract comes from the plan alone."""
    tracker = views.sparkContext.statusTracker()
    views.sparkContext.setJobGroup("contracts", "analysis")
    contract(views, "select c_name, count(*) as n from customer c join orders o on o.o_custkey = c.c_custkey where c_custkey = :id group by c_name")
    assert list(tracker.getJobIdsForGroup("contracts")) == []
    views.sparkContext.setJobGroup("rest", "")
