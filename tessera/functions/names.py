"""Names of files: date keys, safe names, display names, content names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def date_key(name: Column) -> Column:
    """The eight digits of a date before an underscore, null without."""
    return F.nullif(F.regexp_extract(name, r"(20\d{6})_", 1), F.lit(""))


def safe(name: Column) -> Column:
    """The last part of a path without signs that file systems reserve; ``unnamed`` if nothing is left."""
    last = F.element_at(F.split(F.translate(F.coalesce(name, F.lit("")), "\\", "/"), "/"), -1)
    clean = F.trim(F.regexp_replace(last, r'[:*?"<>|]', "_"))
    return F.when((clean == "") | (last == ".."), "unnamed").otherwise(clean)


def display(rank: Column, name: Column, prefix: str = "") -> Column:
    return F.format_string(prefix + "%02d_%s", rank, name)


def by_content(content: Column, name: Column) -> Column:
    """The first eight hexadecimal digits of the content's MD5, with the name's extension in lower case."""
    return F.concat(F.substring(F.md5(content), 1, 8), F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1)))


def cache_key(path: Column) -> Column:
    """The first 16 hexadecimal digits of a path's MD5."""
    return F.substring(F.md5(path), 1, 16)
