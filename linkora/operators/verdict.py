"""The verdict on every recorded reference: what resolved on the old side and fails on the new one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.flags import ABSTRACT, FINAL, INTERFACE, STATIC, has, package, visibility
from ..plans.scratch import settle
from .closure import prefer, resolve_rows, subclass
from .scopes import nest_host

REF = ["kind", "owner", "name", "descriptor", "expected_static", "field_write", "instantiated"]


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


# Verdicts travel as numbers: ok, unknown, then broken for these reasons.
OK, UNKNOWN = 0, 1
REASONS = [
    "class removed", "class became abstract", "class access narrowed", "interface became class", "class became interface", "field became static", "method became static", "field became instance",
    "method became instance", "field access narrowed", "method access narrowed", "field became final", "field removed", "method removed",
]


def _facts(refs: DataFrame, old: DataFrame, new: DataFrame, old_members: DataFrame, new_members: DataFrame, graph: DataFrame) -> DataFrame:
    """One row for each distinct (owner, name, descriptor, is_field) of refs: the verdicts that a reference may get, by what it expects.

    gone, on_new (instantiated), as_face and as_class (by kind), as_static and as_instance (by what is expected), rest: the first that applies
    and is not null; else access decides: on_write and if_no, with level and package of the holder. The old side is resolved only for members of
    which the new side does not decide for every reference.
    """
    key = ["owner", "name", "descriptor", "is_field"]
    flags = lambda df, s: df.select(F.col("class_name").alias("owner"), F.col("access").alias(f"{s}_class"))
    asked = settle(refs.groupBy(*key).agg(F.bool_or("expected_static").alias("some_static"), F.bool_or(~F.col("expected_static")).alias("some_instance"), F.bool_or("field_write").alias("some_write")))
    out = asked.join(flags(old, "old"), "owner", "left").join(flags(new, "new"), "owner", "left")
    out = out.join(graph.select(F.col("class_name").alias("owner"), F.lit(True).alias("in_graph")).distinct(), "owner", "left")
    named = F.col("name").isNotNull() & F.col("is_field").isNotNull()
    found = resolve_rows(new, new_members, out.where(named).withColumn("ask", F.lit(True)), "n")
    static, final = has("n_access", STATIC), has("n_access", FINAL)
    doubted = F.coalesce((static & F.col("some_instance")) | (~static & F.col("some_static")), F.lit(False)) | (visibility("n_access") < 3) | F.coalesce(final & F.col("some_write"), F.lit(False))
    found = found.withColumn("ask", (F.col("n_status") == "not_found") | ((F.col("n_status") == "found") & doubted))
    found = resolve_rows(old, old_members, found, "o").drop("ask")
    out = found.unionByName(out.where(~named), allowMissingColumns=True)

    member, field = F.col("name").isNotNull(), F.col("is_field")
    known_old, known_new = F.col("old_class").isNotNull(), F.col("new_class").isNotNull()
    concrete = lambda c: ~has(c, ABSTRACT) & ~has(c, INTERFACE)
    n_found, o_found, o_unknown = F.col("n_status") == "found", F.col("o_status") == "found", F.col("o_status") == "unknown"
    call = ~field & member & known_new
    broken = lambda reason: F.lit(2 + REASONS.index(reason))
    kinds = lambda reason: F.when(field, broken(f"field {reason}")).otherwise(broken(f"method {reason}"))
    since = lambda was, reason: F.when(o_found & was, reason).when(o_unknown, UNKNOWN).otherwise(OK)
    v2 = F.when(~known_old, UNKNOWN).when(concrete("old_class"), broken("class became abstract")).otherwise(OK)
    v3 = F.when(~known_old, UNKNOWN).when(visibility("old_class") > visibility("new_class"), broken("class access narrowed")).otherwise(OK)
    holder, level = F.when(member, F.col("n_at")).otherwise(F.col("owner")), F.when(member, visibility("n_access")).otherwise(visibility("new_class"))
    used = F.when(member, F.col("n_access")).otherwise(F.col("new_class")).isNotNull()
    return out.select(
        *key,
        F.when(~known_new & F.col("in_graph").isNull(), broken("class removed")).alias("gone"),
        F.when(known_new & ~concrete("new_class"), v2).alias("on_new"),
        F.when(call & ~has("new_class", INTERFACE), F.when(~known_old, UNKNOWN).when(has("old_class", INTERFACE), broken("interface became class"))).alias("as_face"),
        F.when(call & has("new_class", INTERFACE), F.when(~known_old, UNKNOWN).when(~has("old_class", INTERFACE), broken("class became interface"))).alias("as_class"),
        F.when(n_found & ~static, since(has("o_access", STATIC), kinds("became instance"))).alias("as_static"),
        F.when(n_found & static, since(~has("o_access", STATIC), kinds("became static"))).alias("as_instance"),
        F.when(~member, F.when(~known_new, OK)).when(n_found, None).when(F.col("n_status") == "unknown", UNKNOWN).otherwise(since(F.lit(True), kinds("removed"))).alias("rest"),
        F.when(member & n_found & final, since(~has("o_access", FINAL), broken("field became final"))).alias("on_write"),
        F.when(member, since(visibility("o_access") > visibility("n_access"), kinds("access narrowed"))).otherwise(v3).alias("if_no"),
        F.when(used, level).alias("level"),
        # Who declares what is used: the member's class, or the owner itself for a bare class reference.
        F.when(used, holder).alias("holder"),
    )


def _can(rows: DataFrame, scope: DataFrame, graph: DataFrame) -> DataFrame:
    """rows (source_class, holder, level, ...), level 0 (private) or 2 (protected) -> the same with can yes/no/unknown: may source_class use what holder declares?"""
    hosts = nest_host(graph.select("class_name").union(scope.select("class_name")), graph, scope).where("host <> class_name")
    out = rows
    for column, name in (("source_class", "host_a"), ("holder", "host_b")):
        out = out.join(hosts.select(F.col("class_name").alias(column), F.lit(0).alias("level"), F.col("host").alias(name)), [column, "level"], "left").withColumn(name, F.coalesce(name, column))
    pairs = rows.where("level = 2").select(F.col("source_class").alias("sub"), F.col("holder").alias("sup")).distinct()
    known = subclass(prefer(graph, scope), pairs).select(F.col("sub").alias("source_class"), F.col("sup").alias("holder"), F.lit(2).alias("level"), F.col("status").alias("sub_status"))
    out = out.join(known, ["source_class", "holder", "level"], "left")
    return out.withColumn("can", F.when(F.col("level") == 0, F.when(_same(F.col("host_a"), F.col("host_b")), "yes").otherwise("no")).otherwise(F.coalesce("sub_status", F.lit("unknown"))))


def verdicts(refs: DataFrame, old: DataFrame, new: DataFrame, old_members: DataFrame, new_members: DataFrame, graph: DataFrame) -> DataFrame:
    """refs (source, source_class, kind, owner, ...) -> the same bag of rows with verdict ok/unknown/broken and reason.

    old, new: what is in scope on either side (library, fetched classes, JDK layer); graph: the classes that were scanned. All that does
    not depend on who refers is found once for each member; then the bag meets that, and only the rows on which access decides, and
    neither the level nor the package tells, are looked up by their own class.
    """
    columns = refs.columns
    refs = refs.withColumn("is_field", F.col("kind") == "field")
    facts = settle(_facts(refs, old, new, old_members, new_members, graph))
    key = ["owner", "name", "descriptor", "is_field"]
    # Every reference has its row, as facts are made of refs; nulls are equal here.
    named = facts.withColumn("pkg", package("holder")).withColumnsRenamed({c: f"f_{c}" for c in key})
    out = refs.join(named.hint("shuffle_hash"), reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in key]))
    level, here = F.col("level"), F.col("source_class")
    by_kind = F.when(F.col("kind") == "interface_method", F.col("as_face")).otherwise(F.col("as_class"))
    by_static = F.when(F.col("expected_static"), F.col("as_static")).when(~F.col("expected_static"), F.col("as_instance"))
    early = F.coalesce("gone", F.when(F.col("instantiated"), F.col("on_new")), by_kind, by_static, "rest")
    if_yes = F.coalesce(F.when(F.col("field_write") & (here != F.col("holder")), F.col("on_write")), F.lit(OK))
    can = F.when(level.isNull() | (level == 3), True).when((level == 0) & _same(here, F.col("holder")), True).when((level != 0) & (package("source_class") == F.col("pkg")), True).when(level == 1, False)
    # Private access is yes or no, never unknown, and often both have one verdict.
    told = F.coalesce("early", F.when(F.col("can") | ((level == 0) & (F.col("if_yes") == F.col("if_no"))), F.col("if_yes")).when(~F.col("can"), F.col("if_no")))
    late = lambda c: F.when(F.col("told").isNull(), F.col(c)).alias(c)
    out = out.select(*columns, early.alias("early"), if_yes.alias("if_yes"), "if_no", "level", "holder", can.alias("can")).withColumn("told", told)
    out = settle(out.select(*columns, "told", *[late(c) for c in ("holder", "level", "if_yes", "if_no")]))
    decided = F.when(F.col("can") == "yes", F.col("if_yes")).when(F.col("can") == "no", F.col("if_no")).otherwise(UNKNOWN)
    asked = out.where("told is null")
    out = out.where("told is not null").select(*columns, "told").unionByName(_can(asked, new, graph).select(*columns, decided.alias("told")))
    verdict = F.when(F.col("told") == OK, "ok").when(F.col("told") == UNKNOWN, "unknown").otherwise("broken")
    return out.select(*columns, verdict.alias("verdict"), F.when(F.col("told") > 1, F.element_at(F.array(*map(F.lit, REASONS)), F.col("told") - 1)).alias("reason"))


def collapsed(rows: DataFrame) -> DataFrame:
    """A reference to a class that is gone is reported as a bare reference to the class."""
    gone = F.col("reason") == "class removed"
    keep = lambda c: F.when(~F.coalesce(gone, F.lit(False)), F.col(c)).alias(c)
    return rows.select(*[keep(c) if c in REF[2:] else (F.when(gone, "class").otherwise(F.col("kind")).alias("kind") if c == "kind" else c) for c in rows.columns])


def counters(rows: DataFrame) -> DataFrame:
    """unknown counts every record, duplicates included."""
    return rows.groupBy("verdict").agg(F.count("*").alias("n"))
