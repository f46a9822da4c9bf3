"""Duplicate handling and layered scopes: the first copy of a class on a path counts, the first layer that has a class answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first in the order. An aggregate, so map tasks already drop the losers."""
    rest = [c for c in rows.columns if c not in key]
    first = rows.groupBy(*key).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("f"))
    return first.select(*key, *[F.col(f"f.{c}").alias(c) for c in rest]).select(rows.columns)


def crc_first(entries: DataFrame) -> DataFrame:
    """entries (class_name, crc32, path_ord, entry_ord, is_dir, ...): copies of one class with one checksum are read once; directories are exempt."""
    archived = first_wins(entries.where("not is_dir"), ["class_name", "crc32"], ["path_ord", "entry_ord"])
    return archived.unionByName(entries.where("is_dir"))


def layered(*layers: DataFrame) -> DataFrame:
    """Layers of class rows -> one row a class from the first layer that has it, with layer."""
    tagged = [df.withColumn("layer", F.lit(i)) for i, df in enumerate(layers)]
    return first_wins(reduce(DataFrame.unionByName, tagged), ["class_name"], ["layer"])


def owner_refs(refs: DataFrame, classes: DataFrame) -> DataFrame:
    """References to the classes of a library; a bag stays a bag."""
    return refs.join(classes.select(F.col("class_name").alias("owner")).distinct(), "owner", "left_semi").select(refs.columns)


def nest_host(names: DataFrame, graph: DataFrame, scope: DataFrame) -> DataFrame:
    """(class_name, host): the graph's row decides even if its attribute is null, then the scope's; without either the class is its own host."""
    g = graph.select("class_name", F.col("nest_host").alias("g"), F.lit(True).alias("in_graph"))
    s = scope.select("class_name", F.col("nest_host").alias("s"))
    out = names.select("class_name").distinct().join(g, "class_name", "left").join(s, "class_name", "left")
    return out.select("class_name", F.when(F.col("in_graph"), F.coalesce("g", "class_name")).otherwise(F.coalesce("s", "class_name")).alias("host"))
