"""What is new, what is known, and which of two scores counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DOWNSTREAM


def unseen(items: DataFrame, *known: DataFrame, key: str = "id") -> DataFrame:
    """``items`` that are in none of ``known``."""
    for k in known:
        items = items.join(k.select(key), key, "left_anti")
    return items


def keep_old(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """All rows of ``old``, and those of ``new`` whose key isn't in it."""
    return old.unionByName(unseen(new, old, key=key))


def overwrite(old: DataFrame, new: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """``old`` with ``columns`` from rows of ``new`` that have no error."""
    fresh = new.where("error is null").select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = old.join(fresh, key, "left")
    return joined.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).select(*old.columns)


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows of one key the last along ``order``."""
    late = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    return rows.withColumn("_late", late).where("_late = 1").drop("_late")


def rerun_closure(layers: list[str]) -> set[str]:
    """Layers with all those that depend on them."""
    return set(layers) | {d for layer in layers for d in DOWNSTREAM.get(layer, ())}


def rerun_closures(asked: DataFrame) -> DataFrame:
    """(id, layer): of each id the layers ``asked`` for (id, layer) with all those that depend on them, each once."""
    after = F.create_map(*[x for layer, others in DOWNSTREAM.items() for x in (F.lit(layer), F.array(*map(F.lit, others)))])
    every = F.concat(F.array("layer"), F.coalesce(F.try_element_at(after, F.col("layer")), F.array().cast("array<string>")))
    return asked.where("layer is not null").select("id", F.explode(every).alias("layer")).distinct()
