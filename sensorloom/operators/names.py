"""Text fields of catalogs: sensor types, ids, connector names and file dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of sensor types by canonical code.
TYPES = {"MAINLINE": "ML", "ML": "ML", "ONRAMP": "OR", "OR": "OR", "OFFRAMP": "FR", "FR": "FR"}


def sensor_type(value: Column) -> Column:
    """The canonical code of a sensor type; other texts trimmed and in capitals, empty for null."""
    table, text = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), F.upper(F.trim(value))
    return F.coalesce(F.try_element_at(table, text), text, F.lit(""))


def canonical_id(value: Column) -> Column:
    """Whole numbers in any spelling ('7', '7.0', ' 07') as bigint, else null."""
    text = F.trim(value.cast("string"))
    return F.regexp_replace(text, r"\.0+$", "").try_cast("bigint")


def routes(name: Column) -> Column:
    """Array of (route, direction) in a connector's name, such as '5N TO 805S'."""
    up = F.upper(name)
    pat = r"\b(\d{1,3})\s*-?\s*([NSEW])B?\b"
    return F.zip_with(F.regexp_extract_all(up, F.lit(pat), F.lit(1)), F.regexp_extract_all(up, F.lit(pat), F.lit(2)), lambda r, d: F.struct(r.cast("int").alias("route"), d.alias("direction")))


def file_date(path: Column) -> Column:
    """Date of a file name with yyyy_mm_dd, else null."""
    return F.replace(F.regexp_extract(path, r"(\d{4}_\d{2}_\d{2})", 1), F.lit("_"), F.lit("-")).try_cast("date")
