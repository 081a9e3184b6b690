"""Facts from schema SQL: CREATE TABLE, CREATE TYPE ... AS ENUM, CREATE DOMAIN, CREATE UNIQUE INDEX and ALTER TABLE ...
ADD.

Only what holds for every row becomes a fact. A key that is deferrable, partial or over expressions proves nothing; a
CHECK counts where it is enforced, validated, inherited, of one column without a collation of its own, and of a form
that ``contracts.checks`` reads. Other statements and clauses are passed over.
"""

from __future__ import annotations

import re
from dataclasses import replace

from ..schema import Key, Schema, TableFacts
from ..source import SourceError

_TOKEN = re.compile(r"""\s+|--[^\n]*|/\*.*?\*/|(?P<part>'(?:[^']|'')*'|"(?:[^"]|"")*"|\$(\w*)\$.*?\$\2\$|[A-Za-z_][\w$]*|\d[\w.]*|::|.)""", re.S)

#: Column types of schema SQL and the Spark types that hold their values.
_TYPES = {
    "bigint": "bigint", "int8": "bigint", "bigserial": "bigint", "integer": "int", "int": "int", "int4": "int", "serial": "int", "smallint": "smallint", "int2": "smallint",
    "text": "string", "varchar": "string", "character varying": "string", "char": "string", "character": "string", "uuid": "string", "json": "string", "jsonb": "string", "string": "string",
    "boolean": "boolean", "bool": "boolean", "double precision": "double", "float8": "double", "double": "double", "real": "float", "float4": "float", "bytea": "binary",
    "numeric": "decimal", "decimal": "decimal", "date": "date", "timestamp": "timestamp_ntz", "timestamp without time zone": "timestamp_ntz",
    "timestamptz": "timestamp", "timestamp with time zone": "timestamp",
}
#: Words that end a column's type.
_CLAUSES = {"NOT", "NULL", "PRIMARY", "UNIQUE", "CHECK", "DEFAULT", "GENERATED", "REFERENCES", "COLLATE", "CONSTRAINT", "DEFERRABLE", "INITIALLY"}


def _tokens(text: str) -> list[str]:
    return [m["part"] for m in _TOKEN.finditer(text) if m["part"]]


def _split(tokens: list[str], at: str) -> list[list[str]]:
    """Parts between separators outside parentheses."""
    out, depth = [[]], 0
    for t in tokens:
        depth += (t in "([") - (t in ")]")
        if t == at and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return [p for p in out if p]


def _group(tokens: list[str], at: int) -> int:
    """The index after the group that opens at ``at``."""
    depth = 0
    for k in range(at, len(tokens)):
        depth += (tokens[k] == "(") - (tokens[k] == ")")
        if not depth:
            return k + 1
    raise SourceError("a parenthesis without end")


def _name(token: str) -> str:
    return token[1:-1].replace('""', '"') if token.startswith('"') else token.lower()


def _relation(tokens: list[str], at: int) -> tuple[str, int]:
    """(last part of a dotted name, the index after it)."""
    while at + 2 < len(tokens) and tokens[at + 1] == ".":
        at += 2
    return _name(tokens[at]), at + 1


def _names(tokens: list[str]) -> tuple[str, ...] | None:
    """Columns of a key; None where one is an expression."""
    parts = _split(tokens, ",")
    return tuple(_name(p[0]) for p in parts) if all(len(p) == 1 for p in parts) else None


def _upper(tokens: list[str]) -> list[str]:
    return [t.upper() for t in tokens]


class _Table:
    def __init__(self, name: str):
        self.name, self.types, self.not_null, self.keys, self.checks = name, {}, set(), [], []
        self.enums: dict[str, tuple[str, ...]] = {}
        self.collated: set[str] = set()

    def key(self, columns, primary: bool, after: list[str]) -> None:
        """``after``: the words behind a key. A deferrable one may be broken for a while, one with NULLs never proves."""
        if columns is None or "DEFERRABLE" in after and after[after.index("DEFERRABLE") - 1] != "NOT":
            return
        stem = "pkey" if primary else f"{'_'.join(columns)}_key"
        self.keys.append(Key(f"{self.name}_{stem}", columns, primary))
        if primary:
            self.not_null |= set(columns)

    def constraint(self, tokens: list[str]) -> bool:
        """A table constraint; False where the tokens are none."""
        if tokens[0].upper() == "CONSTRAINT":
            tokens = tokens[2:]
        words = _upper(tokens)
        if words[:2] == ["PRIMARY", "KEY"] or words[0] == "UNIQUE":
            at = words.index("(")
            end = _group(tokens, at)
            self.key(_names(tokens[at + 1 : end - 1]), words[0] == "PRIMARY", words[end:])  # NULLS NOT DISTINCT is stricter
            return True
        if words[0] == "CHECK":
            end = _group(tokens, 1)
            self.check(tokens[2 : end - 1], words[end:])
            return True
        return words[:2] == ["FOREIGN", "KEY"] or words[0] in ("EXCLUDE", "LIKE")

    def check(self, expression: list[str], after: list[str]) -> None:
        rest = " ".join(after)
        if not re.search(r"\b(NO INHERIT|NOT VALID|NOT ENFORCED)\b", rest):
            self.checks.append(" ".join(expression).replace(":: ", "::").replace(" ::", "::"))

    def column(self, tokens: list[str], enums: dict[str, tuple[str, ...]], domains: dict[str, list[str]]) -> None:
        if len(tokens) > 1 and (whole := domains.get(_name(tokens[_relation(tokens, 1)[1] - 1]))) and tokens[_relation(tokens, 1)[1] :][:1] != ["["]:
            # a column of a domain has the domain's type and constraints, of which VALUE is the column
            own = [tokens[0] if t.upper() == "VALUE" else t for t in whole]
            tokens = [tokens[0], *own, *tokens[_relation(tokens, 1)[1] :]]
        name, at = _name(tokens[0]), 1
        words = _upper(tokens)
        while at < len(tokens) and words[at] not in _CLAUSES:
            at = _group(tokens, at) if tokens[at] == "(" else at + 1
        kind = tokens[1:at]
        opens = kind.index("(") if "(" in kind else len(kind)
        plain = kind[:opens] + (kind[_group(kind, opens) :] if opens < len(kind) else [])
        base = " ".join(map(str.lower, plain))
        is_array = base.endswith("[ ]")
        base = base.removesuffix("[ ]").strip()
        last = _name(base.split(" . ")[-1])
        spark = "string" if last in enums else _TYPES.get(base, "unknown")
        if spark == "decimal":
            spark = f"decimal({''.join(kind[opens + 1 : _group(kind, opens) - 1])})" if opens < len(kind) else "decimal(38,18)"
        self.types[name] = f"array<{spark}>" if is_array and spark != "unknown" else spark
        if last in enums and not is_array:
            self.enums[name] = enums[last]
        while at < len(tokens):
            if words[at : at + 2] == ["NOT", "NULL"]:
                self.not_null.add(name)
                at += 2
            elif words[at : at + 2] == ["PRIMARY", "KEY"]:
                self.key((name,), True, words[at + 2 :])
                at += 2
            elif words[at] == "UNIQUE":
                self.key((name,), False, words[at + 1 :])
                at += 1
            elif words[at] == "CHECK":
                end = _group(tokens, at + 1)
                self.check(tokens[at + 2 : end - 1], words[end : end + 2])
                at = end
            elif words[at] == "COLLATE":
                self.collated.add(name)
                at += 2
            elif words[at] == "GENERATED":  # an identity column never holds NULL
                if "IDENTITY" in words[at:]:
                    self.not_null.add(name)
                at += 1
            else:
                at = _group(tokens, at) if tokens[at] == "(" else at + 1

    def into(self, schema: Schema) -> None:
        schema[self.name] = TableFacts(frozenset(self.not_null), tuple(self.keys), dict(self.enums), dict(self.types))
        for expression in self.checks:
            schema.check(self.name, expression)
        facts = schema[self.name]
        schema[self.name] = replace(facts, allowed={c: x for c, x in facts.allowed.items() if c not in self.collated})


def schema_from_sql(text: str) -> Schema:
    """The facts of all tables that the statements create. A table that is created twice is an error."""
    enums: dict[str, tuple[str, ...]] = {}
    domains: dict[str, list[str]] = {}
    tables: dict[str, _Table] = {}
    for tokens in _split(_tokens(text), ";"):
        words = _upper(tokens)
        if words[:2] == ["CREATE", "TYPE"] and "ENUM" in words:
            name, at = _relation(tokens, 2)
            at = words.index("ENUM") + 1
            enums[name] = tuple(p[0][1:-1].replace("''", "'") for p in _split(tokens[at + 1 : _group(tokens, at) - 1], ","))
        elif words[:2] == ["CREATE", "DOMAIN"]:
            name, at = _relation(tokens, 2)
            domains[name] = tokens[at + (words[at] == "AS") :]
        elif words[0] == "CREATE" and "TABLE" in words[1:3] and "(" in words:
            at = words.index("TABLE") + 1
            at += 3 if words[at : at + 3] == ["IF", "NOT", "EXISTS"] else 0
            name, at = _relation(tokens, at)
            if name in tables:
                raise SourceError(f"table {name} is created twice")
            own = tables[name] = _Table(name)
            for part in _split(tokens[at + 1 : _group(tokens, at) - 1], ","):
                if not (part[0].upper() in ("CONSTRAINT", "PRIMARY", "UNIQUE", "CHECK", "FOREIGN", "EXCLUDE", "LIKE") and own.constraint(part)):
                    own.column(part, enums, domains)
        elif words[:3] == ["CREATE", "UNIQUE", "INDEX"] and "ON" in words:
            name, at = _relation(tokens, words.index("ON") + (2 if words[words.index("ON") + 1] == "ONLY" else 1))
            begin = words.index("(", at - 1)
            end = _group(tokens, begin)
            if name in tables and "WHERE" not in words[end:]:
                tables[name].key(_names(tokens[begin + 1 : end - 1]), False, [])
        elif words[:2] == ["ALTER", "TABLE"] and "ADD" in words:
            at = 2 + 2 * (words[2:4] == ["IF", "EXISTS"])
            at += words[at] == "ONLY"
            name, at = _relation(tokens, at)
            added = tokens[words.index("ADD") + 1 :]
            if name in tables and added[0].upper() in ("CONSTRAINT", "PRIMARY", "UNIQUE", "CHECK"):
                tables[name].constraint(added)
    out = Schema()
    for own in tables.values():
        own.into(out)
    return out
