"""Which scanned classes must have their members at hand, and which names only the platform can explain.

A scanned class that is not wanted exists, but nothing is known of its members; so this choice is part of the verdicts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.flags import OBJECT
from . import structural
from .closure import prefer, reached, reaching


def reference_wanted(refs: DataFrame, old: DataFrame, new: DataFrame, graph: DataFrame) -> DataFrame:
    """refs (owner, name, ...) -> (class_name, escape): what the walk up from the owners of member references meets beside a library.

    Each library's own edges count before the scanned ones. escape false: a scanned class, wanted; true: a name that neither knows. An
    owner of a bare class reference is no walk, but an escape if neither the new library nor the scan knows it.
    """
    scanned = graph.select("class_name").distinct().withColumn("scanned", F.lit(True))
    owners = refs.where("name is not null").select(F.col("owner").alias("class_name")).where(F.col("class_name") != OBJECT).distinct()
    met = []
    for library in (new, old):
        walk = reached(prefer(library, graph), owners)
        met.append(walk.join(library.select("class_name"), "class_name", "left_anti"))
    bare = refs.where("name is null").select(F.col("owner").alias("class_name")).distinct().join(new.select("class_name"), "class_name", "left_anti").join(graph.select("class_name"), "class_name", "left_anti")
    return met[0].union(met[1]).union(bare).distinct().join(scanned, "class_name", "left").select("class_name", F.col("scanned").isNull().alias("escape"))


def final_heirs(old_members: DataFrame, new_members: DataFrame, new: DataFrame, graph: DataFrame) -> DataFrame:
    """(class_name): scanned classes with a superclass whose methods became final. The scanned edges count first."""
    finals = structural.newly_final_methods(old_members, new_members)
    return structural.first_final_ancestor(prefer(graph, new), finals).select("class_name").join(graph.select("class_name"), "class_name", "left_semi").distinct()


def selection_heirs(old: DataFrame, new: DataFrame, old_members: DataFrame, new_members: DataFrame, graph: DataFrame) -> DataFrame:
    """(class_name): scanned classes that inherit a newly abstract or newly default method, and the scanned classes above them."""
    changed = structural.newly_abstract(old, new, old_members, new_members).unionByName(structural.newly_default(old, new, old_members, new_members)).select("class_name").distinct()
    edges, scanned = prefer(new, graph), graph.select("class_name")
    heirs = reaching(edges, changed).join(scanned, "class_name", "left_semi")
    return reached(edges, heirs).join(scanned, "class_name", "left_semi")


def spi_wanted(old_services: DataFrame, new_services: DataFrame, old: DataFrame, new: DataFrame, graph: DataFrame) -> DataFrame:
    """(class_name): still listed providers that are scanned and missing from either library."""
    listed = structural.still_listed(old_services, new_services).select(F.col("provider").alias("class_name")).distinct()
    both = old.select("class_name").join(new.select("class_name"), "class_name", "left_semi")
    return listed.join(graph.select("class_name"), "class_name", "left_semi").join(both, "class_name", "left_anti")


def upgraded_supers(graph: DataFrame, upgraded: DataFrame, new: DataFrame) -> DataFrame:
    """(class_name, escape): direct superclasses of the classes of upgraded sources, as far as the new library does not hold them."""
    supers = graph.join(upgraded.select("source").distinct(), "source", "left_semi").select(F.col("super_name").alias("class_name")).where(F.col("class_name").isNotNull() & (F.col("class_name") != OBJECT)).distinct()
    scanned = graph.select("class_name").distinct().withColumn("scanned", F.lit(True))
    return supers.join(new.select("class_name"), "class_name", "left_anti").join(scanned, "class_name", "left").select("class_name", F.col("scanned").isNull().alias("escape"))


def wanted(refs: DataFrame, old: DataFrame, new: DataFrame, old_members: DataFrame, new_members: DataFrame, graph: DataFrame, old_services: DataFrame, new_services: DataFrame, upgraded: DataFrame) -> DataFrame:
    """(class_name, escape): every scanned class whose members are needed, and every name that is left to the platform."""
    own = lambda df: df.select("class_name").withColumn("escape", F.lit(False))
    out = reference_wanted(refs, old, new, graph).unionByName(upgraded_supers(graph, upgraded, new))
    out = out.unionByName(own(final_heirs(old_members, new_members, new, graph))).unionByName(own(selection_heirs(old, new, old_members, new_members, graph)))
    return out.unionByName(own(spi_wanted(old_services, new_services, old, new, graph))).distinct()
