import pytest

from sparkpact.source import SourceError, camel_case, named_parameters, parse_source, unique_names


@pytest.mark.parametrize("sql,names", [
    ("select :a, :b, :a", ["a", "b"]),
    ("select ':a', \"x:b\", `c:d`", []),
    ("select 'it''s :x', :y", ["y"]),
    ("select x::int, :y::text", ["y"]),
    ("select 1 -- :no\n, :yes", ["yes"]),
    ("select /* :a /* :b */ :c */ :d", ["d"]),
    ("select $$ :a $$, $t$ :b $t$, :c", ["c"]),
    ("select a[1:2], a[:lo], a[x:y]", ["lo"]),
    ("select a[:lo:hi]", ["lo"]),
    ("select r'\\\\', :z;", ["z"]),
])
def test_named_parameters(sql, names):
    assert named_parameters(sql) == names


@pytest.mark.parametrize("sql", ["select $1", "select 1; select 2", "select /* open"])
def test_rejected(sql):
    with pytest.raises(SourceError):
        named_parameters(sql)


def test_directives():
    s = parse_source("-- a note\n-- @access write\n-- @nullable a\n-- @column x bigint\nselect :a as x;\n-- @access read")
    assert (s.access, s.nullable, s.columns) == ("write", ["a"], {"x": "bigint"})
    for bad in ("-- @what\nselect 1", "-- @access read\n-- @access read\nselect 1", "-- @nullable a\n-- @nullable a\nselect 1", "-- only"):
        with pytest.raises(SourceError):
            parse_source(bad)


def test_names():
    assert camel_case("order_count") == "orderCount" and camel_case("_x") == "_x" and camel_case("A_b") == "A_b"
    assert unique_names(["a_b"], "camel") == ["aB"]
    with pytest.raises(SourceError):
        unique_names(["a_b", "aB"], "camel")
