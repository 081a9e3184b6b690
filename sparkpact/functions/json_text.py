"""JSON text with the semantics of a relational server: null fields and null elements stay."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_KEEP = {"ignoreNullFields": "false"}


def json_object(**fields: Column) -> Column:
    """One object; null values stay as null."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())), _KEEP)


def json_array_agg(value: Column) -> Column:
    """Array of a group's values in ascending order; null elements stay, an empty group gives null.

    ``collect_list`` drops nulls, so values travel in a struct; the array is unwrapped before it becomes text.
    """
    packed = F.sort_array(F.collect_list(F.struct(value.alias("v"))))
    return F.when(F.size(packed) > 0, F.to_json(F.transform(packed, lambda x: x["v"]), _KEEP))


def json_object_agg(key: Column, value: Column, strict: bool = False) -> Column:
    """One object of a group's pairs in order of the keys; null values stay, or are left out with ``strict``. Two pairs
    with one key are an error."""
    pair = F.struct(key.alias("k"), value.alias("v"))
    packed = F.sort_array(F.collect_list(F.when(value.isNotNull(), pair) if strict else pair))
    return F.when(F.size(packed) > 0, F.to_json(F.map_from_entries(packed), _KEEP))
