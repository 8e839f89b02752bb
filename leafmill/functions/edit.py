"""Values as JSON edited in place, as column expressions: keys of dictionaries and elements of arrays.

Elements are variants inside, so each keeps its type; keys come out in their order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _items(value: Column) -> Column:
    return F.parse_json(value).cast("array<variant>")


def _pairs(value: Column) -> Column:
    return F.parse_json(value).cast("map<string,variant>")


def set_key(value: Column, key: str, item: Column) -> Column:
    """The dictionary with the key set to a JSON value, there before or not."""
    return F.to_json(F.map_concat(F.map_filter(_pairs(value), lambda k, v: k != key), F.create_map(F.lit(key), F.parse_json(item))))


def remove_key(value: Column, key: str) -> Column:
    return F.to_json(F.map_filter(_pairs(value), lambda k, v: k != key))


def item_at(value: Column, index: int) -> Column:
    """The element as JSON; null beyond the end."""
    return F.to_json(F.get(_items(value), F.lit(index)))


def append(value: Column, item: Column) -> Column:
    return F.to_json(F.array_append(_items(value), F.parse_json(item)))


def insert_at(value: Column, index: int, item: Column) -> Column:
    """Before the element at the index, counted from 0; an index beyond the end appends."""
    items = _items(value)
    return F.to_json(F.concat(F.slice(items, 1, index), F.array(F.parse_json(item)), F.slice(items, index + 1, 1 << 30)))


def set_at(value: Column, index: int, item: Column) -> Column:
    return F.to_json(F.transform(_items(value), lambda x, i: F.when(i == index, F.parse_json(item)).otherwise(x)))


def remove_at(value: Column, index: int) -> Column:
    return F.to_json(F.filter(_items(value), lambda x, i: i != index))


def resize(value: Column, size: int) -> Column:
    """Cut to the size, or filled up with nulls."""
    items = F.slice(_items(value), 1, size)
    return F.to_json(F.concat(items, F.array_repeat(F.parse_json(F.lit("null")), F.lit(size) - F.size(items))))
