"""Comparison of an old and a new library: one row per breaking change."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.flags import ABSTRACT, ENUM, FINAL, INTERFACE, PRIVATE, STATIC, has, visibility, visibility_name
from ..plans.scratch import settle
from .closure import resolve_field, resolve_method

COLUMNS = "kind string, class_name string, name string, descriptor string, from_access string, to_access string, replacements array<string>"


def _row(kind: str | Column, *, name="name", descriptor="descriptor", frm=None, to=None) -> list[Column]:
    text = lambda c: F.lit(None).cast("string") if c is None else (F.col(c) if isinstance(c, str) else c)
    return [(F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.col("class_name"), text(name).alias("name"), text(descriptor).alias("descriptor"), text(frm).alias("from_access"), text(to).alias("to_access"), F.lit(None).cast("array<string>").alias("replacements")]


def _class_row(kind, **more) -> list[Column]:
    return _row(kind, name=None, descriptor=None, **more)


def both_classes(old: DataFrame, new: DataFrame) -> DataFrame:
    side = lambda df, s: df.select("class_name", *[F.col(c).alias(f"{s}_{c}") for c in ("access", "permitted", "sealing_unknown")])
    return side(old, "o").join(side(new, "n"), "class_name")


def class_removed(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select("class_name"), "class_name", "left_anti").select(*_class_row("class_removed"))


def class_access_narrowed(old: DataFrame, new: DataFrame) -> DataFrame:
    a, b = visibility("o_access"), visibility("n_access")
    return both_classes(old, new).where(b < a).select(*_class_row("class_access_narrowed", frm=visibility_name(a), to=visibility_name(b)))


def _gained(o: str, n: str, bit: int) -> Column:
    return ~has(o, bit) & has(n, bit)


def class_became_final(old: DataFrame, new: DataFrame) -> DataFrame:
    return both_classes(old, new).where(_gained("o_access", "n_access", FINAL)).select(*_class_row("class_became_final"))


def class_became_sealed(old: DataFrame, new: DataFrame) -> DataFrame:
    open_ = lambda s: ~has(f"{s}_access", ENUM) & ~has(f"{s}_access", FINAL) & ~F.col(f"{s}_sealing_unknown")
    dropped = F.col("o_permitted").isNull() | (F.size(F.array_except("o_permitted", "n_permitted")) > 0)
    return both_classes(old, new).where(open_("o") & open_("n") & F.col("n_permitted").isNotNull() & dropped).select(*_class_row("class_became_sealed"))


def class_kind_flip(old: DataFrame, new: DataFrame) -> DataFrame:
    flip = both_classes(old, new).where(has("o_access", INTERFACE) != has("n_access", INTERFACE))
    return flip.select(*_class_row(F.when(has("n_access", INTERFACE), "class_became_interface").otherwise("interface_became_class")))


def class_became_abstract(old: DataFrame, new: DataFrame) -> DataFrame:
    same = has("o_access", INTERFACE) == has("n_access", INTERFACE)
    return both_classes(old, new).where(same & _gained("o_access", "n_access", ABSTRACT)).select(*_class_row("class_became_abstract"))


KEY = ["class_name", "mkind", "name", "descriptor"]


def both_members(old: DataFrame, new: DataFrame) -> DataFrame:
    """Members that are declared on both sides; private old ones don't count."""
    return old.where(~has("access", PRIVATE)).withColumnRenamed("access", "o_access").join(new.withColumnRenamed("access", "n_access"), KEY)


def _kind(suffix: str) -> Column:
    return F.concat("mkind", F.lit(f"_{suffix}"))


def member_access_narrowed(old: DataFrame, new: DataFrame) -> DataFrame:
    a, b = visibility("o_access"), visibility("n_access")
    return both_members(old, new).where(b < a).select(*_row(_kind("access_narrowed"), frm=visibility_name(a), to=visibility_name(b)))


def method_became_abstract(old: DataFrame, new: DataFrame) -> DataFrame:
    return both_members(old, new).where((F.col("mkind") == "method") & _gained("o_access", "n_access", ABSTRACT)).select(*_row("method_became_abstract"))


def member_static_flip(old: DataFrame, new: DataFrame) -> DataFrame:
    flip = both_members(old, new).where(has("o_access", STATIC) != has("n_access", STATIC))
    return flip.select(*_row(F.when(has("n_access", STATIC), _kind("became_static")).otherwise(_kind("became_instance"))))


def member_became_final(old: DataFrame, new: DataFrame) -> DataFrame:
    return both_members(old, new).where(_gained("o_access", "n_access", FINAL)).select(*_row(_kind("became_final")))


def members_gone(old_members: DataFrame, new: DataFrame, new_members: DataFrame) -> DataFrame:
    """Old members, not private, of classes that are still there, without a declaration in the new class."""
    return old_members.where(~has("access", PRIVATE)).join(new.select("class_name"), "class_name", "left_semi").join(new_members.select(*KEY), KEY, "left_anti")


def replacement_descriptors(gone: DataFrame, new_members: DataFrame) -> DataFrame:
    """(KEY, replacements): sorted other descriptors under the name in the new class."""
    others = new_members.select("class_name", "mkind", "name", F.col("descriptor").alias("other"))
    return gone.join(others, ["class_name", "mkind", "name"]).groupBy(*KEY).agg(F.sort_array(F.collect_set("other")).alias("replacements"))


def member_removed(old_members: DataFrame, new: DataFrame, new_members: DataFrame) -> DataFrame:
    """Gone, and not found by resolution either: inherited members and those out of scope are silent."""
    gone = settle(members_gone(old_members, new, new_members))
    asked = gone.select(F.col("class_name").alias("owner"), "mkind", "name", "descriptor")
    found = resolve_method(new, new_members, asked.where("mkind = 'method'")).withColumn("mkind", F.lit("method")).unionByName(resolve_field(new, new_members, asked.where("mkind = 'field'")).withColumn("mkind", F.lit("field")))
    lost = settle(gone.join(found.where("status = 'not_found'").select(F.col("owner").alias("class_name"), "mkind", "name", "descriptor"), KEY, "left_semi"))
    return lost.join(replacement_descriptors(lost, new_members), KEY, "left").select(*[c for c in _row(_kind("removed"))[:-1]], F.coalesce("replacements", F.array().cast("array<string>")).alias("replacements"))


def diff(old: DataFrame, new: DataFrame, old_members: DataFrame, new_members: DataFrame) -> DataFrame:
    parts = [f(old, new) for f in (class_removed, class_access_narrowed, class_became_final, class_became_sealed, class_kind_flip, class_became_abstract)]
    parts += [f(old_members, new_members) for f in (member_access_narrowed, method_became_abstract, member_static_flip, member_became_final)]
    return reduce(DataFrame.unionByName, [*parts, member_removed(old_members, new, new_members)])


def diff_counts(changes: DataFrame) -> DataFrame:
    """Every change is in one bucket: of a class, a method or a field."""
    bucket = F.when(F.col("kind").startswith("method_"), "method").when(F.col("kind").startswith("field_"), "field").otherwise("class")
    return changes.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
