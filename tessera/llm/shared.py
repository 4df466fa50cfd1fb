"""What several operators of this subpackage need besides the tables, cuts and components of the package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components, forest
from ..sources.shared import cut, table

__all__ = ["NOT_SPACE", "SPACE", "aside", "components", "constants", "cut", "forest", "restored", "share01", "table"]

#: Java class of the six ASCII white-space characters; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def constants(values: list[int]) -> Column:
    """A constant array of whole numbers, folded once when the query is optimised."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def share01(*cols: Column) -> Column:
    """A uniform number in [0, 1) that depends on the columns' values only."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def aside(docs: DataFrame, *used: str) -> DataFrame:
    """The columns ``used``, and the others as one struct ``_row``: whatever they are called, inner columns clash with none."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*used, F.struct(*(rest or [F.lit(0)])).alias("_row"))


def restored(columns: list[str], new: dict[str, Column], *used: str) -> list[Column]:
    """The columns of a table from what aside() made of it, those named in ``new`` replaced, and the others of ``new`` after them."""
    name = {c.lower(): c for c in new}
    own = lambda c: F.col(c) if c in used else F.col("_row")[c]
    kept = [(new[name[c.lower()]] if c.lower() in name else own(c)).alias(c) for c in columns]
    have = {c.lower() for c in columns}
    return kept + [v.alias(k) for k, v in new.items() if k.lower() not in have]
