"""What an upgrade changes, which modules it concerns, and which change explains a violation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _versions(artifacts: DataFrame, side: str) -> DataFrame:
    return artifacts.groupBy("group", "name").agg(F.sort_array(F.collect_set("version")).alias(side))


def without_projects(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Coordinates that are built as a project on either side are not dependencies."""
    own = before.unionByName(after).where("project is not null").select("group", "name").distinct()
    return before.join(own, ["group", "name"], "left_anti"), after.join(own, ["group", "name"], "left_anti")


def dependency_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """artifacts (group, name, version, file, project) -> (group, name, kind changed/removed/added, before, after)."""
    a, b = without_projects(before, after)
    both = _versions(a, "before").join(_versions(b, "after"), ["group", "name"], "full_outer")
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
    none = F.array().cast("array<string>")
    return both.withColumn("kind", kind).where("kind is not null").select("group", "name", "kind", F.coalesce("before", none).alias("before"), F.coalesce("after", none).alias("after"))


def jars(changes: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(side, group, name, version, file): versions that went, and for changed coordinates those that came."""
    old = changes.where("kind <> 'added'").select("group", "name", F.explode(F.array_except("before", "after")).alias("version"), F.lit("old").alias("side"))
    new = changes.where("kind = 'changed'").select("group", "name", F.explode(F.array_except("after", "before")).alias("version"), F.lit("new").alias("side"))
    key = ["group", "name", "version"]
    files = lambda df: df.select(*key, "file").distinct()
    return old.join(files(before), key).unionByName(new.join(files(after), key)).select("side", *key, "file")


def _coordinates(artifacts: DataFrame) -> DataFrame:
    return artifacts.where("`group` is not null and name is not null and version is not null")


def module_moves(before: DataFrame, after: DataFrame) -> DataFrame:
    """artifacts of both sides -> (module, side old/new, group, name, version, file): the versions that each module of after lost and got.

    A module that before does not have is compared with what any module had of its coordinates, as it may have been renamed.
    """
    key = ["group", "name", "version"]
    a, b = (_coordinates(x) for x in without_projects(before, after))
    had = _coordinates(before).select("module").distinct()
    paired = a.select("module", *key, "file")
    any_module = a.groupBy(*key).agg(F.min("file").alias("file"))
    renamed = b.join(had, "module", "left_anti").select("module", "group", "name").distinct().join(any_module, ["group", "name"]).select("module", *key, "file")
    of_after = after.select("module").distinct()
    was = paired.join(of_after, "module", "left_semi").unionByName(renamed).groupBy("module", *key).agg(F.min("file").alias("file"))
    now = b.groupBy("module", *key).agg(F.min("file").alias("file"))
    lost = was.join(now.select("module", *key), ["module", *key], "left_anti").withColumn("side", F.lit("old"))
    known = was.select("module", "group", "name").distinct()
    got = now.join(known, ["module", "group", "name"], "left_semi").join(was.select("module", *key), ["module", *key], "left_anti").withColumn("side", F.lit("new"))
    return lost.unionByName(got).select("module", "side", *key, "file")


def module_plan(modules: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """modules (module) of after -> (module, status, old, new): run if the module lost a version, with the files that went and came in order.

    Else unchanged; new if before does not know it; incomplete if before has artifacts of it and after none, which is missing data and not
    the removal of everything.
    """
    order = lambda side: F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("group", "name", "version", "file"))))["file"].alias(side)
    moved = module_moves(before, after).groupBy("module").agg(order("old"), order("new"))
    had, has_ = (_coordinates(x).select("module").distinct().withColumn(c, F.lit(True)) for x, c in ((before, "had"), (after, "has")))
    out = modules.select("module").distinct().join(moved, "module", "left").join(had, "module", "left").join(has_, "module", "left")
    none = F.array().cast("array<string>")
    status = F.when(F.col("had") & F.col("has").isNull(), "incomplete").when(F.size(F.coalesce("old", none)) > 0, "run").when(F.col("had").isNull(), "new").otherwise("unchanged")
    kept = lambda c: F.when(F.col("status") == "run", F.col(c)).otherwise(none).alias(c)
    return out.withColumn("status", status).select("module", "status", kept("old"), kept("new"))


def attribution(classes: DataFrame, changes: DataFrame) -> DataFrame:
    """classes (class_name, file), changes (change_ord, file) -> the first change whose old JARs hold the class."""
    return classes.join(changes, "file").groupBy("class_name").agg(F.min("change_ord").alias("change_ord"))


def coordinates(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, group, name, version): the dump before the upgrade wins."""
    tag = lambda df, n: df.select("file", F.struct(F.lit(n).alias("o"), "group", "name", "version").alias("c"))
    return tag(before, 0).unionByName(tag(after, 1)).groupBy("file").agg(F.min("c").alias("c")).select("file", "c.group", "c.name", "c.version")


def suggestions(violations: DataFrame, owners: DataFrame, changes: DataFrame, files: DataFrame, optional: DataFrame) -> DataFrame:
    """violations -> the same rows with referenced_by, removed_by, before, after and advice, all null where no change explains the owner.

    owners (class_name, change_ord): `attribution`. changes (change_ord, group, name, kind, before, after). files (file, group, name, version):
    `coordinates`. optional (source, group, name): what the POM of a source declares optional. A service violation of the very coordinate
    that moved gets no advice, since it would have to be aligned with itself.
    """
    none = F.array().cast("array<string>")
    c = changes.select("change_ord", F.col("group").alias("c_group"), F.col("name").alias("c_name"), F.coalesce("before", none).alias("c_before"), F.coalesce("after", none).alias("c_after"))
    f = files.select(F.col("file").alias("source"), F.col("group").alias("f_group"), F.concat_ws(":", "group", "name").alias("f_coord"), F.concat_ws(":", "group", "name", "version").alias("referenced_by"))
    o = optional.select("source", F.col("group").alias("c_group"), F.col("name").alias("c_name"), F.lit(True).alias("is_optional")).distinct()
    out = violations.join(owners.select(F.col("class_name").alias("owner"), "change_ord"), "owner", "left").join(c, "change_ord", "left")
    out = out.join(f, "source", "left").join(o, ["source", "c_group", "c_name"], "left")
    coordinate = F.concat_ws(":", "c_group", "c_name")
    text = lambda a: F.when(F.size(a) == 0, "-").otherwise(F.array_join(a, ","))
    moved = lambda a, b: F.when(F.size(F.array_except(a, b)) > 0, F.array_except(a, b)).otherwise(F.col(a))
    user = F.coalesce("referenced_by", F.lit("the artifact that refers to it"))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    gone = F.size("c_after") == 0
    either = say("use a release of ", user, " that is built for ", coordinate, " ", text(moved("c_after", "c_before")), ", or keep ", coordinate, " at ", text(moved("c_before", "c_after")))
    advice = (
        F.when(gone & F.coalesce("is_optional", F.lit(False)), say(coordinate, " is gone; ", user, " declares it optional, so only its optional feature is affected: add ", coordinate, " back to use that feature"))
        .when(gone, say(coordinate, " is gone but ", user, " needs it: use a release of ", user, " without it, or add ", coordinate, " back"))
        .when(F.col("f_group") == F.col("c_group"), say("give all artifacts of ", F.col("c_group"), " the same version; or ", either))
        .otherwise(either)
    )
    own = F.col("reason").startswith("service provider") & F.coalesce(F.col("f_coord") == coordinate, F.lit(False))
    known = F.col("c_name").isNotNull() & ~own
    given = [(n, F.when(known, v)) for n, v in (("referenced_by", F.col("referenced_by")), ("removed_by", coordinate), ("before", text(F.col("c_before"))), ("after", text(F.col("c_after"))), ("advice", advice))]
    return out.select(*[F.col(x) for x in violations.columns], *[v.alias(n) for n, v in given])
