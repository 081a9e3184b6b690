import importlib.util
import json

import pytest

from sparkpact.contracts.checks import allowed_labels, intersect_labels
from sparkpact.contracts.dml import admissions, assignments, parsed
from sparkpact.contracts.null_evaluation import evaluate
from sparkpact.generate import class_name, generate, main
from sparkpact.plans.tree import Node
from sparkpact.runtime import MappingError, json_plan, map_json, map_row, row_count
from sparkpact.schema import Schema, testdata_schema
from sparkpact.source import SourceError
from sparkpact.sources import files
from sparkpact.statement import ContractError, Statement

from .conftest import DATA


@pytest.mark.parametrize("expr,labels", [
    ("status = 'a'", ("a",)),
    ("(status = ANY (ARRAY['a'::text, 'b''c'::text]))", ("a", "b'c")),
    ("status IN ('a', 'b') OR status IS NULL", ("a", "b")),
    ("((status)::text = 'a'::text) OR (status = 'b')", ("a", "b")),
    ("status = 'a' AND status = 'b'", None),
    ("status <> 'a'", None),
    ("other = 'a'", None),
    ("upper(status) = 'A'", None),
    ("status = 'a'::citext", None),
    ("status IS NULL", None),
    ("status = ", None),
])
def test_check_labels(expr, labels):
    assert allowed_labels(expr, "status") == labels


def test_checks_meet():
    assert intersect_labels([("a", "b"), ("b", "c")]) == ("b",) and intersect_labels([]) is None


@pytest.mark.parametrize("expr,value", [
    (":p", "NULL"), (":p IS NULL", "TRUE"), (":p IS NOT NULL", "FALSE"), ("x = :p", "NULL"), (":p IS NULL OR x = :p", "TRUE"), ("x = :p AND FALSE", "FALSE"),
    ("NOT (x = :p)", "NULL"), (":q", "UNKNOWN"), ("x", "UNKNOWN"), ("coalesce(:p, 5)", "NONNULL"), ("coalesce(:p, x)", "UNKNOWN"), (":p IN (1, 2)", "NULL"),
    ("CAST(:p AS INT) > 3", "NULL"), (":p <=> NULL", "TRUE"), (":p <=> 3", "FALSE"), ("x = :p OR x = 1", "UNKNOWN"),
])
def test_null_evaluation(views, expr, value):
    e = parsed(views, f"SELECT 1 FROM t WHERE {expr}").fields.get("condition") or next(n.fields["condition"] for n in parsed(views, f"SELECT 1 FROM t WHERE {expr}").walk() if n.kind == "Filter")
    assert isinstance(e, Node) and evaluate(e, "p").value == value


def test_dml(views):
    schema = Schema().declare("acc", "email", "id", status=("a", "b"))
    columns = {"acc": ["id", "email", "status", "note"]}
    found = {(a.param, a.column, a.value_preserving, a.unconditional) for a in assignments(views, "INSERT INTO acc (email, note) VALUES (:e, upper(:n))", columns)}
    assert found == {("e", "email", True, True), ("n", "note", False, False)}
    check = lambda sql: admissions(views, sql, schema, columns)
    assert check("INSERT INTO acc VALUES (1, :e, :s, :n)") == {"e": "rejects", "s": "accepts", "n": "accepts"}
    assert check("INSERT INTO acc (email) SELECT :e") == {"e": "rejects"}
    assert check("INSERT INTO acc (email) SELECT :e FROM other") == {"e": "unknown"}
    assert check("UPDATE acc SET email = :e, note = :n WHERE id = :i") == {"e": "rejects", "i": "accepts", "n": "accepts"}
    # under NULL these write each row as it was
    assert check("UPDATE acc SET note = coalesce(:n, note) WHERE id = 1") == {"n": "accepts"}
    assert check("UPDATE acc SET email = coalesce(:n, email, 'x'), note = note") == {"n": "accepts"}
    assert check("UPDATE acc SET note = CASE WHEN :n IS NOT NULL THEN upper(:n) ELSE note END") == {"n": "accepts"}
    # and these need not
    for kept in ("note = coalesce(:n, note, 'x')", "note = coalesce(:n, status)", "note = coalesce(:n, note), status = 'a'", "note = CASE WHEN id = 1 THEN :n ELSE note END", "note = coalesce(upper(:n), 'x')"):
        assert check(f"UPDATE acc SET {kept}") == {"n": "unknown"}, kept
    assert check("DELETE FROM acc WHERE id = :i") == {"i": "accepts"}
    assert check("DELETE FROM acc WHERE id = :i AND status = 'a'") == {"i": "unknown"}
    assert check("DELETE FROM acc WHERE :i IS NULL OR id = :i") == {"i": "unknown"}
    merged = assignments(views, "MERGE INTO acc t USING src s ON t.id = s.id WHEN MATCHED THEN UPDATE SET note = :n WHEN NOT MATCHED THEN INSERT (id, email) VALUES (s.id, :e)", columns)
    assert {(a.param, a.column, a.action, a.unconditional) for a in merged} == {("n", "note", "merge_update", False), ("e", "email", "merge_insert", False)}


def test_runtime():
    assert map_row((1, "a"), ["x", "__proto__"]) == {"x": 1, "__proto__": "a"}
    with pytest.raises(MappingError):
        map_row((1,), ["a", "b"])
    plan = json_plan(("object", (("a_b", ("array", ("object", (("c_d", ("scalar", "long"), "nonNull"),))), "nonNull"), ("e_f", ("opaque",), "nullable"))), lambda n: n.replace("_", ""))
    assert map_json({"a_b": [{"c_d": 1, "x_y": 2}, None], "e_f": {"g_h": 1}}, plan) == {"ab": [{"cd": 1, "x_y": 2}, None], "ef": {"g_h": 1}}
    with pytest.raises(MappingError):
        map_json({"a_b": 1, "ab": 2}, {"a_b": ("ab", None)})
    assert row_count(3) == 3
    for bad in (-1, 1.0, True, None, "3"):
        with pytest.raises(MappingError):
            row_count(bad)


def test_generate(views, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "node_modules").mkdir()
    one = tmp_path / "sub" / "find_customer.typed.sql"
    one.write_text("-- @access read\nselect c_name, c_mktsegment from customer where c_custkey = :id")
    (tmp_path / "node_modules" / "x.typed.sql").write_text("select nope")
    changed = generate(views, tmp_path, testdata_schema(), tmp_path / "catalog.py")
    assert sorted(p.name for p in changed) == ["catalog.py", "find_customer_statement.py"] and class_name("find_customer") == "FindCustomer"
    spec = importlib.util.spec_from_file_location("made", tmp_path / "sub" / "find_customer_statement.py")
    made = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(made)
    assert made.CONTRACT["cardinality"] == "optional" and "Literal['AUTOMOBILE'" in (tmp_path / "sub" / "find_customer_statement.py").read_text()
    row = made.run(Statement(views, made.SQL, testdata_schema()), id=1)
    assert row.c_name == views.table("customer").where("c_custkey = 1").first().c_name
    assert generate(views, tmp_path, testdata_schema(), tmp_path / "catalog.py") == []
    one.rename(tmp_path / "other.typed.sql")
    assert sorted(p.name for p in generate(views, tmp_path, testdata_schema())) == ["find_customer_statement.py", "other_statement.py"]
    assert not (tmp_path / "sub" / "find_customer_statement.py").exists()
    (tmp_path / "bad.typed.sql").write_text("-- @access read\nselect rand() as x")
    with pytest.raises(ContractError):
        generate(views, tmp_path, testdata_schema())
    assert not (tmp_path / "bad_statement.py").exists()
    (tmp_path / "bad.typed.sql").unlink()
    (tmp_path / "o-ther.typed.sql").write_text("select 1 as x")
    (tmp_path / "o_ther.typed.sql").write_text("select 1 as x")
    with pytest.raises(SourceError):
        generate(views, tmp_path, testdata_schema())


def test_command_line(views, tmp_path, capsys):
    (tmp_path / "n.typed.sql").write_text("select count(*) as n from nation")
    main(["--root", str(tmp_path), "--tables", DATA])
    assert capsys.readouterr().out.strip().endswith("n_statement.py")


def test_command_line_with_schema(spark, tmp_path, capsys):
    (tmp_path / "s.sql").write_text("create table acc (id bigint primary key, email text not null, kind text check (kind in ('a', 'b')))")
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "find.typed.sql").write_text("select email, kind from acc where id = :id")
    (tmp_path / "q" / "add.typed.sql").write_text("-- @nullable kind\ninsert into acc (id, email, kind) values (:id, :email, :kind)")
    (tmp_path / "other.typed.sql").write_text("select nope")
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"root": str(tmp_path), "schema": str(tmp_path / "s.sql"), "include": "q/*", "profile": "conservative"}))
    main(["--config", str(config), "--profile", "standard"])
    assert [x.rpartition("/")[2] for x in capsys.readouterr().out.split()] == ["add_statement.py", "find_statement.py"]
    found, added = ((tmp_path / "q" / f"{n}_statement.py").read_text() for n in ("find", "add"))
    assert "email: str\n" in found and "kind: Literal['a', 'b'] | None" in found and "statement.optional(id=id)" in found
    assert "statement.command(id=id, email=email, kind=kind)" in added and "kind = None" in added
    main(["--config", str(config)])
    assert "email: object" in (tmp_path / "q" / "find_statement.py").read_text()
    config.write_text(json.dumps({"rout": "x"}))
    for bad in (["--config", str(config)], ["--root", "x"]):
        with pytest.raises(SystemExit):
            main(bad)


def test_commands_run(spark, tmp_path):
    spark.sql(f"create table kept (id bigint, note string) using parquet location 'file://{tmp_path}/kept'")
    try:
        s = Statement(spark, "insert into kept (id, note) values (:id, :note)", Schema())
        assert s.analyze().command == "insert" and s.command(id=1, note="a") is None and s.command(id=2, note=None) is None
        assert sorted(map(tuple, Statement(spark, "select id, note from kept", Schema()).many())) == [(1, "a"), (2, None)]
    finally:
        spark.sql("drop table kept")


def test_outputs_roll_back(tmp_path, monkeypatch):
    a, b = tmp_path / "a.py", tmp_path / "b.py"
    a.write_text("old")
    real = files.Path.rename

    def broken(self, target):
        if str(target).endswith("b.py"):
            raise OSError("disk")
        return real(self, target)

    monkeypatch.setattr(files.Path, "rename", broken)
    with pytest.raises(OSError):
        files.commit_outputs({a: "new", b: "new"})
    monkeypatch.undo()
    assert a.read_text() == "old" and sorted(p.name for p in tmp_path.iterdir()) == ["a.py"]
    (tmp_path / "link.py").symlink_to(a)
    with pytest.raises(files.OutputError):
        files.commit_outputs({tmp_path / "link.py": "x"})
    with pytest.raises(files.OutputError):
        files.commit_outputs({a: "x", tmp_path / "." / "a.py": "y"} if (tmp_path / "." / "a.py") != a else {a: "x", tmp_path / "z" / ".." / "a.py": "y"})
