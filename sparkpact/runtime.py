"""Rows at the client: positional mapping, JSON key mapping, counts."""

from __future__ import annotations

from collections.abc import Mapping


class MappingError(ValueError):
    pass


def map_row(row, names: list[str]) -> dict:
    """A positional row as a mapping; a row of another width is an error."""
    if len(row) != len(names):
        raise MappingError(f"{len(row)} values for {len(names)} columns")
    return dict(zip(names, row))


def map_json(value, plan):
    """Rename keys of nested JSON values by a plan: {old: (new, inner plan)} for objects, [inner] for arrays, None to
    leave a value alone. Keys that the plan doesn't know stay; two keys that become one are an error."""
    if plan is None or value is None:
        return value
    if isinstance(plan, list):
        return [map_json(v, plan[0]) for v in value] if isinstance(value, list) else value
    if not isinstance(value, Mapping):
        return value
    out = {}
    for key, inner in value.items():
        name, below = plan.get(key, (key, None))
        if name in out:
            raise MappingError(f"two keys are named {name!r}")
        out[name] = map_json(inner, below)
    return out


def json_plan(shape, rename) -> object:
    """The plan of an inferred JSON shape; opaque parts and scalars are left alone."""
    if not shape or shape[0] not in ("object", "array"):
        return None
    if shape[0] == "array":
        inner = json_plan(shape[1], rename)
        return None if inner is None else [inner]
    return {name: (rename(name), json_plan(inner, rename)) for name, inner, _ in shape[1]}


def row_count(value) -> int:
    """A count as a nonnegative integer; anything else is an error."""
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise MappingError(f"not a row count: {value!r}")
    return value
