"""Frontmatter with typed values and lists: a map from each key to its value as JSON, and back to text.

A note's front block is cut before each line that begins with a key; what follows a key without a value are its `- item` lines,
up to the first line of another kind. Values are numbers, truth values, null, JSON lists and objects, quoted and plain text.
All of it is column expressions on the row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import strip

_KEY = r"[A-Za-z0-9_-]+"
_NUMBER = r"^-?\d+(\.\d+)?$"


def text_json(value: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def number_json(value: Column) -> Column:
    """Digits as JSON has them: no zeros in front, none at the end of a fraction, and no minus before nought."""
    plain = F.regexp_replace(F.regexp_replace(value, r"^(-?)0+(?=\d)", "$1"), r"(\.\d*?)0+$", "$1")
    return F.regexp_replace(F.regexp_replace(plain, r"\.$", ""), "^-0$", "0")


def scalar_json(value: Column) -> Column:
    """What stands after a key or a bullet, as JSON. What only looks like JSON is text."""
    v = strip(value)
    nested = v.rlike(r"(?s)^(?:\[.*\]|\{.*\})$") & F.try_parse_json(v).isNotNull()
    quoted = (F.length(v) >= 2) & (v.rlike(r'(?s)^".*"$') | v.rlike(r"(?s)^'.*'$"))
    # double quotes are read as JSON where they hold it, so that what was rendered reads back
    read = F.when(v.startswith('"') & F.try_parse_json(v).isNotNull(), v).otherwise(text_json(F.substr(v, F.lit(2), F.length(v) - 2)))
    return F.when(v.isin("true", "false", "null"), v).when(v.rlike(_NUMBER), number_json(v)).when(nested, F.to_json(F.try_parse_json(v))).when(quoted, read).otherwise(text_json(v))


def front_lines(raw: Column) -> Column:
    """The lines of the front block; null where there is none. A block that is not closed runs to the end."""
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), r"\r\n", "\n")
    lines = F.split(text, "\n")
    end = F.array_position(F.slice(lines, 2, F.size(lines)), "---")
    return F.when(text.startswith("---\n"), F.slice(lines, F.lit(2), F.when(end > 0, end.cast("int") - 1).otherwise(F.size(lines))))


def front_values(raw: Column) -> Column:
    """A map from key to JSON of a note's front block, the last of a repeated key; empty where there is no block."""
    block = F.concat(F.lit("\n"), F.array_join(front_lines(raw), "\n"))
    parts = F.filter(F.split(block, rf"\n(?={_KEY}:)"), lambda p: p.rlike(rf"^{_KEY}:"))

    def value(part: Column) -> Column:
        own = F.regexp_extract(part, rf"^{_KEY}:\s*?([^\n]*)", 1)
        below = F.split(part, "\n")
        items = F.slice(below, 2, F.size(below))
        stop = F.array_position(F.transform(items, lambda x: x.rlike(r"^\s*-\s+.*$")), False)
        held = F.slice(items, F.lit(1), F.when(stop > 0, stop.cast("int") - 1).otherwise(F.size(items)))
        listed = F.transform(held, lambda x: scalar_json(F.regexp_replace(x, r"^\s*-\s+", "")))
        return F.when(strip(own) == "", F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]"))).otherwise(scalar_json(own))

    pairs = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, rf"^({_KEY}):", 1).alias("key"), value(p).alias("value")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    last = F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"].alias("value")))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def front_texts(raw: Column, key: str) -> Column:
    """A value as a list of texts: a list's items, one text, or none."""
    value = F.try_element_at(front_values(raw), F.lit(key))
    items = F.from_json(value, "array<string>")
    return F.when(value.startswith("["), items).when(value.isNull() | value.isin("null", '""'), F.array().cast("array<string>")).otherwise(F.array(F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string")["v"]))


def rendered_value(value: Column) -> Column:
    """A JSON value as it stands after its key: text plainly where it reads back as itself, everything else as JSON."""
    text = F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string")["v"]
    plain = value.startswith('"') & text.rlike(r"^[A-Za-z0-9_./:@ -]+$") & ~text.contains(": ") & (text == strip(text)) & ~text.isin("true", "false", "null") & ~text.rlike(_NUMBER)
    return F.when(plain, text).otherwise(value)


def rendered(values: Column) -> Column:
    """A front block from a map of JSON values; `front_values` reads the same map from it."""
    lines = F.transform(F.map_entries(values), lambda e: F.concat(e["key"], F.lit(": "), rendered_value(e["value"])))
    return F.concat(F.lit("---\n"), F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), F.lit("---\n"))
