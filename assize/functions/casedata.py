"""Case data of any type: map<string,variant>, of which only texts are sources."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .text import let

DATA = "map<string,variant>"


def case_data(v: Column) -> Column:
    """The fields of a variant object; null, and anything that is no object, has none."""
    none = F.create_map().cast(DATA)
    return F.coalesce(F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v.try_cast(DATA)), none)


def is_text(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def texts(data: Column) -> Column:
    """map<string,string> of the fields that are texts: a case's sources."""
    return F.transform_values(F.map_filter(data, lambda k, v: is_text(v)), lambda k, v: v.cast("string"))


def same_as(data: Column, within: Column, alone: Column) -> Column:
    """64 hexadecimal digits that two data have in common only if they are equal, field by field and in type, and `within` is too.

    A field is told by its name, type and JSON. What a list or an object of mixed or rounded types holds is not told exactly by
    these: data with such a field are equal to no other, by `alone`."""
    field = lambda e: F.struct(e["key"].alias("name"), F.schema_of_variant(e["value"]).alias("type"), F.to_json(e["value"]).alias("json"))

    def told(fields: Column) -> Column:
        unsure = F.exists(fields, lambda f: F.coalesce(f["type"].rlike("^(ARRAY|OBJECT).*(VARIANT|DECIMAL|DOUBLE)"), F.lit(False)))
        return F.concat(F.to_json(F.struct(within.alias("within"), fields.alias("fields"))), F.when(unsure, F.to_json(F.struct(alone.alias("alone")))).otherwise(F.lit("")))

    return F.sha2(let(F.transform(F.map_entries(data), field), told), 256)


@F.pandas_udf(ArrayType(StringType()))
def _written(values: pd.Series) -> pd.Series:
    # Numbers, lists and objects, from JSON to the way the prompt writes them.
    return values.map(lambda row: [None if j is None else str(json.loads(j)) for j in row])


def shown(data: Column, order: tuple[str, ...] = ()) -> Column:
    """array<struct<name,value>> of all fields as a prompt shows them: texts as they are, True, False and None, numbers, and
    lists and objects with single quotes. Fields come in `order`, the others after them by name."""
    keys = F.sort_array(F.map_keys(data))
    if order:
        first = F.array(*map(F.lit, order))
        keys = F.concat(F.filter(first, lambda k: F.map_contains_key(data, k)), F.array_except(keys, first))
    value = lambda k: F.try_element_at(data, k)
    plain = lambda v: F.when(is_text(v), v.cast("string")).when(F.schema_of_variant(v) == "BOOLEAN", F.initcap(v.cast("string"))).when(v.isNull() | (F.schema_of_variant(v) == "VOID"), F.lit("None"))
    other = _written(F.transform(keys, lambda k: F.when(plain(value(k)).isNull(), F.to_json(value(k)))))
    return F.zip_with(keys, other, lambda k, o: F.struct(k.alias("name"), F.coalesce(plain(value(k)), o).alias("value")))


def set_text(key: str, value: str | Column):
    """An update that overwrites one field with a text."""
    text = F.lit(value) if isinstance(value, str) else value
    return lambda data: F.map_concat(F.map_filter(data, lambda k, v: k != key), F.create_map(F.lit(key), text.cast("variant")))
