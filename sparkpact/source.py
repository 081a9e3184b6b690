"""Statement sources: header directives, and the scan for named parameters."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_DIRECTIVES = {"access", "nullable", "column"}


class SourceError(ValueError):
    pass


@dataclass
class Source:
    sql: str
    access: str | None = None
    nullable: list[str] = field(default_factory=list)
    columns: dict[str, str | None] = field(default_factory=dict)


def parse_source(text: str) -> Source:
    """Split the leading ``--`` comment block's directives from the statement.

    ``@access read|write`` once, ``@nullable name`` a parameter, ``@column name [type]`` a column. A directive after
    the first line of SQL, an unknown one, or a repeated one is an error.
    """
    lines, at, out = text.splitlines(), 0, Source("")
    while at < len(lines) and (not lines[at].strip() or lines[at].lstrip().startswith("--")):
        body = lines[at].strip()[2:].strip()
        if body.startswith("@"):
            name, _, rest = body[1:].partition(" ")
            words = rest.split()
            if name not in _DIRECTIVES:
                raise SourceError(f"unknown directive @{name}")
            if name == "access":
                if out.access is not None or len(words) != 1 or words[0] not in ("read", "write"):
                    raise SourceError("@access takes read or write, once")
                out.access = words[0]
            elif name == "nullable":
                if len(words) != 1 or words[0] in out.nullable:
                    raise SourceError("@nullable takes one parameter, once each")
                out.nullable.append(words[0])
            else:
                if not words or words[0] in out.columns:
                    raise SourceError("@column takes a column, once each")
                out.columns[words[0]] = " ".join(words[1:]) or None
        at += 1
    out.sql = "\n".join(lines[at:]).strip().rstrip(";").rstrip()
    if not out.sql:
        raise SourceError("no statement")
    return out


_TOKEN = re.compile(
    r"""--[^\n]*                         # line comment
      | '(?:[^'\\]|\\.|'')*'            # string
      | "(?:[^"\\]|\\.|"")*"            # string or quoted name
      | `(?:[^`]|``)*`                  # quoted name
      | \$(?P<tag>[A-Za-z_]\w*)?\$.*?\$(?(tag)(?P=tag))\$   # dollar quote
      | ::                              # cast
      | (?P<positional>\$\d+)
      | (?P<open>/\*)
      | (?P<bracket>[\[\]])
      | :(?P<name>[A-Za-z_]\w*)
      | [A-Za-z_][\w$]*
      | \d[\w.]*
      | .""",
    re.X | re.S,
)


def named_parameters(sql: str) -> list[str]:
    """Names of ``:name`` parameters in order of first use; a repeated name is one parameter.

    Strings, quoted names, comments (block comments nest), dollar quotes, casts and array slices hold none.
    Positional parameters, and more than one statement, are errors.
    """
    found: list[str] = []
    at, depth, slice_part = 0, 0, False
    ended = False
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if m["open"]:
            at = _comment_end(sql, at)
            continue
        text, at = m[0], m.end()
        if text.isspace() or text.startswith("--"):
            continue
        if ended:
            raise SourceError("more than one statement")
        if text == ";":
            ended = True
        elif m["positional"]:
            raise SourceError(f"positional parameter {text}; use :name")
        elif m["bracket"]:
            depth += 1 if text == "[" else -1
            slice_part = False
        elif m["name"]:
            # inside a subscript ``a[l:u]`` a colon after an operand is the slice delimiter
            if depth and slice_part:
                slice_part = False
                continue
            if m["name"] not in found:
                found.append(m["name"])
            slice_part = True
            continue
        slice_part = depth > 0 and (text[-1].isalnum() or text[-1] in "_)'\"`")
    return found


def _comment_end(sql: str, at: int) -> int:
    depth = 0
    while at < len(sql):
        if sql.startswith("/*", at):
            depth, at = depth + 1, at + 2
        elif sql.startswith("*/", at):
            depth, at = depth - 1, at + 2
            if not depth:
                return at
        else:
            at += 1
    raise SourceError("comment without end")


def camel_case(name: str) -> str:
    """snake_case to camelCase; names of any other form stay."""
    if not re.fullmatch(r"[a-z][a-z0-9]*(_[a-z0-9]+)*", name):
        return name
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


def unique_names(names: list[str], style: str = "preserve") -> list[str]:
    """Public names in a naming style; two names that become one are an error."""
    out = [camel_case(n) if style == "camel" else n for n in names]
    seen: dict[str, str] = {}
    for before, after in zip(names, out):
        if after in seen:
            raise SourceError(f"{before!r} and {seen[after]!r} are both named {after!r}")
        seen[after] = before
    return out
