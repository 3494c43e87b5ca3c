"""JSON text built from Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# The helpers below evaluate their JSON text once: trimming and anchored
# replacement instead of a substring of a measured length.


def json_quote(text: Column) -> Column:
    """Return ``text`` as a quoted JSON string, NULL for NULL."""
    return F.when(text.isNotNull(), F.btrim(F.to_json(F.array(text)), F.lit("[]")))


def json_escape(text: Column) -> Column:
    """Return ``text`` escaped for the inside of a JSON string, without quotes."""
    return F.when(text.isNotNull(), F.regexp_replace(F.to_json(F.array(text)), r'^\["|"\]\z', ""))


def sorted_map(entries: Column) -> Column:
    """Return the map with its keys in byte order."""
    return F.when(F.size(entries) <= 1, entries).otherwise(
        F.map_from_entries(F.sort_array(F.map_entries(entries)))
    )


def object_or_null(entries: Column) -> Column:
    """Return the key-ordered map, or NULL for an empty one so that writers omit it."""
    return F.when(F.size(entries) > 0, sorted_map(entries))


def text_or_null(text: Column) -> Column:
    """Return NULL for an empty string so that writers omit it."""
    return F.nullif(text, F.lit(""))


def unclosed(json: Column) -> Column:
    """Return a JSON object without its closing brace."""
    return F.regexp_replace(json, r"\}\z", "")


def members(struct_column: Column) -> Column:
    """Return the members of a struct's JSON object without braces, NULL when there are none."""
    return F.nullif(F.regexp_replace(F.to_json(struct_column), r"^\{|\}\z", ""), F.lit(""))


def json_object(*fragments: Column) -> Column:
    """Join member fragments into a JSON object; NULL fragments are left out."""
    return F.concat(F.lit("{"), F.concat_ws(",", *fragments), F.lit("}"))
