"""Breaks of inheritance edges and dispatch that no recorded reference shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.flags import ABSTRACT, BRIDGE, ENUM, FINAL, INTERFACE, OBJECT, PRIVATE, PUBLIC, STATIC, SYNTHETIC, has, is_object_method
from ..plans.scratch import settle
from .closure import LOCAL_EDGES, assignable, grouped, local_hierarchy, prefer, super_chain, supertype_closure
from .diff import both_classes
from .hierarchy import evidence, selected

MADE = BRIDGE | SYNTHETIC


def newly_final(old: DataFrame, new: DataFrame) -> DataFrame:
    return both_classes(old, new).where(~has("o_access", FINAL) & has("n_access", FINAL)).select("class_name")


def extends_newly_final(graph: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(class_name, super_name): the direct superclass gained final."""
    return graph.join(newly_final(old, new).withColumnRenamed("class_name", "super_name"), "super_name", "left_semi").select("class_name", "super_name")


def newly_final_methods(old_members: DataFrame, new_members: DataFrame) -> DataFrame:
    key = ["class_name", "name", "descriptor"]
    side = lambda df, s: df.where((F.col("mkind") == "method") & ~has("access", MADE)).select(*key, F.col("access").alias(s))
    both = side(old_members, "o").join(side(new_members, "n"), key)
    return both.where(~has("o", FINAL) & ~has("o", PRIVATE) & ~has("o", STATIC) & has("n", FINAL) & ~has("n", PRIVATE)).select(*key)


def first_final_ancestor(graph: DataFrame, finals: DataFrame) -> DataFrame:
    """(class_name, ancestor, depth): the nearest strict superclass with newly final methods."""
    chain = super_chain(graph, graph.select("class_name")).where("depth > 0")
    near = chain.join(finals.select("class_name").distinct(), "class_name", "left_semi")
    return near.groupBy(F.col("start").alias("class_name")).agg(F.min(F.struct("depth", F.col("class_name").alias("a"))).alias("m")).select("class_name", F.col("m.a").alias("ancestor"), F.col("m.depth").alias("depth"))


def overrides_newly_final(graph: DataFrame, members: DataFrame, finals: DataFrame) -> DataFrame:
    """(class_name, ancestor, name, descriptor): a fetched class declares a method that its nearest such ancestor made final."""
    own = members.where((F.col("mkind") == "method") & ~has("access", MADE) & ~has("access", PRIVATE) & ~has("access", STATIC)).select("class_name", "name", "descriptor")
    keys = finals.withColumnRenamed("class_name", "ancestor")
    return first_final_ancestor(graph, finals).join(own, "class_name").join(keys, ["ancestor", "name", "descriptor"]).select("class_name", "ancestor", "name", "descriptor")


def version_lag(graph: DataFrame, upgraded: DataFrame, scope: DataFrame, old: DataFrame) -> DataFrame:
    """(class_name, super_name): a class of a new-version source extends a class that is final in scope, and did not do so before."""
    edges = graph.join(upgraded.select("source").distinct(), "source", "left_semi").select("class_name", "super_name")
    final = scope.where(has("access", FINAL)).select(F.col("class_name").alias("super_name"))
    return edges.join(final, "super_name", "left_semi").join(old.select("class_name", "super_name"), ["class_name", "super_name"], "left_anti").select("class_name", "super_name")


def edge_kind_flip(graph: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(class_name, up, reason): the superclass became an interface, or an interface became a class."""
    flips = both_classes(old, new).where(has("o_access", INTERFACE) != has("n_access", INTERFACE)).select(F.col("class_name").alias("up"), has("n_access", INTERFACE).alias("to_face"))
    supers = graph.select("class_name", F.col("super_name").alias("up"), F.lit(True).alias("needs"))
    faces = graph.select("class_name", F.explode("interfaces").alias("up"), F.lit(False).alias("needs")).distinct()
    hit = supers.unionByName(faces).join(flips, "up").where("needs = to_face")
    return hit.select("class_name", "up", F.when(F.col("to_face"), "class became interface").otherwise("interface became class").alias("reason"))


def sealed_unpermitted(graph: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(class_name, up): a direct supertype is sealed in new without a permit for the class, and was open to it before."""
    open_ = lambda s: ~has(f"{s}_access", ENUM) & ~has(f"{s}_access", FINAL) & ~F.col(f"{s}_sealing_unknown")
    sealed = both_classes(old, new).where(open_("o") & open_("n") & F.col("n_permitted").isNotNull()).select(F.col("class_name").alias("up"), "o_permitted", "n_permitted")
    ups = graph.select("class_name", F.explode(F.concat(F.coalesce("interfaces", F.array().cast("array<string>")), F.array("super_name"))).alias("up")).where("up is not null").distinct()
    hit = ups.join(sealed, "up").where(~F.expr("array_contains(n_permitted, class_name)") & (F.col("o_permitted").isNull() | F.expr("array_contains(o_permitted, class_name)")))
    return hit.select("class_name", "up")


def _methods(classes: DataFrame, members: DataFrame) -> DataFrame:
    return members.where("mkind = 'method'").join(classes.select("class_name", F.col("access").alias("class_access")), "class_name")


def newly_abstract(old: DataFrame, new: DataFrame, old_members: DataFrame, new_members: DataFrame) -> DataFrame:
    """(class_name, name, descriptor): abstract now; absent or concrete before, in a class of both sides."""
    key = ["class_name", "name", "descriptor"]
    now = _methods(new, new_members).where(has("access", ABSTRACT) & ~has("access", MADE)).select(*key)
    before = old_members.where("mkind = 'method'").select(*key, F.col("access").alias("o"))
    out = now.join(old.select("class_name"), "class_name", "left_semi").join(before, key, "left")
    return out.where(F.col("o").isNull() | (~has("o", ABSTRACT) & ~has("o", MADE))).select(*key)


def newly_default(old: DataFrame, new: DataFrame, old_members: DataFrame, new_members: DataFrame) -> DataFrame:
    """(class_name, name, descriptor): a default method of an interface of both sides; absent or abstract before."""
    key = ["class_name", "name", "descriptor"]
    face = _methods(new, new_members).where(has("class_access", INTERFACE))
    now = face.where(~has("access", ABSTRACT) & ~has("access", STATIC) & ~has("access", PRIVATE) & ~has("access", MADE)).select(*key)
    before = old_members.where("mkind = 'method'").select(*key, F.col("access").alias("o"))
    out = now.join(old.where(has("access", INTERFACE)).select("class_name"), "class_name", "left_semi").join(before, key, "left")
    return out.where(F.col("o").isNull() | has("o", ABSTRACT)).select(*key)


def maximally_specific(classes: DataFrame, declaring: DataFrame, most: int = LOCAL_EDGES) -> DataFrame:
    """declaring (start, name, descriptor, class_name): those that no other declaring interface of the same start inherits from."""
    up = supertype_closure(classes, declaring.select("class_name"), most).where("start <> class_name").select(F.col("start").alias("below"), "class_name")
    other = declaring.select("start", "name", "descriptor", F.col("class_name").alias("below"))
    hidden = declaring.join(up, "class_name").join(other, ["start", "name", "descriptor", "below"]).select("start", "name", "descriptor", "class_name")
    return declaring.join(hidden, ["start", "name", "descriptor", "class_name"], "left_anti")


def implementation_status(classes: DataFrame, members: DataFrame, keys: DataFrame, most: int = LOCAL_EDGES) -> DataFrame:
    """keys (start, name, descriptor) -> status concrete/abstract_only/conflict/absent/unknown of what the start class selects."""
    key = ["start", "name", "descriptor"]
    instance = members.where((F.col("mkind") == "method") & ~has("access", STATIC) & ~has("access", PRIVATE)).select("class_name", "name", "descriptor", has("access", ABSTRACT).alias("abstract"))
    if (h := local_hierarchy(classes, most)) is not None and h.tall:
        shared = h.shared
        return grouped(keys.select(*key), instance, lambda a, b: selected(shared.value.tree(), a, b), "start string, name string, descriptor string, status string")
    keys = settle(keys.select(*key).distinct())
    starts = keys.select(F.col("start").alias("class_name")).distinct()
    chain = super_chain(classes, starts, most)
    hits = keys.join(chain, "start").join(instance, ["class_name", "name", "descriptor"], "left").where(F.col("abstract").isNotNull() | ~F.col("in_scope"))
    one = hits.groupBy(*key).agg(F.min(F.struct("depth", F.coalesce("abstract", F.lit(False)).alias("abs"), "in_scope")).alias("e"))
    first = one.select(*key, F.when(~F.col("e.in_scope"), "unknown").when(F.col("e.abs"), "abstract_only").otherwise("concrete").alias("first"))
    faces = classes.where(has("access", INTERFACE)).select("class_name", F.lit(True).alias("face"))
    closure = supertype_closure(classes, starts, most)
    seen = settle(keys.join(closure.where("start <> class_name").join(faces, "class_name", "left").where("face or not in_scope"), "start").join(instance, ["class_name", "name", "descriptor"], "left"))
    two = seen.groupBy(*key).agg(F.bool_or(~F.col("in_scope")).alias("out"), F.bool_or(F.col("abstract")).alias("abs"), F.bool_or(~F.col("abstract")).alias("con"))
    top = maximally_specific(classes, seen.where("abstract = false").select(*key, "class_name"), most).groupBy(*key).agg(F.count("*").alias("tops"))
    out = keys.join(first, key, "left").join(two, key, "left").join(top, key, "left")
    status = (
        F.when(F.col("first").isNotNull(), F.col("first"))
        .when(is_object_method("name", "descriptor"), "concrete")
        .when(F.coalesce("out", F.lit(False)) | F.coalesce(F.col("abs") & F.col("con"), F.lit(False)), "unknown")
        .when(F.coalesce("abs", F.lit(False)), "abstract_only")
        .when(~F.coalesce("con", F.lit(False)), "absent")
        .when(F.col("tops") > 1, "conflict")
        .otherwise("concrete")
    )
    return out.select(*key, status.alias("status"))


def selection_breaks(old: DataFrame, new: DataFrame, old_members: DataFrame, new_members: DataFrame, subjects: DataFrame) -> DataFrame:
    """subjects (class_name): concrete classes. (class_name, name, descriptor, owner, reason): what dispatch selects turned abstract or ambiguous.

    old, new and their members are the scopes, subjects included.
    """
    keys = newly_abstract(old, new, old_members, new_members).unionByName(newly_default(old, new, old_members, new_members)).distinct()
    up = supertype_closure(new, subjects.select("class_name")).where("start <> class_name")
    asked = settle(up.join(keys, "class_name").groupBy("start", "name", "descriptor").agg(F.min("class_name").alias("owner")))
    was = implementation_status(old, old_members, asked).withColumnRenamed("status", "was")
    now = implementation_status(new, new_members, asked).withColumnRenamed("status", "now")
    hit = asked.join(now, ["start", "name", "descriptor"]).join(was, ["start", "name", "descriptor"]).where("now in ('abstract_only', 'conflict') and was in ('concrete', 'absent')")
    return hit.select(F.col("start").alias("class_name"), "name", "descriptor", "owner", F.when(F.col("now") == "conflict", "conflicting default methods").otherwise("method became abstract").alias("reason"))


def _escapes(closure: DataFrame) -> DataFrame:
    """closure (start, class_name, in_scope) -> (start, other, platform): does a walk leave the scope through a type outside java/, through one of java/?"""
    out, java = ~F.col("in_scope"), F.col("class_name").startswith("java/")
    return closure.groupBy("start").agg(F.bool_or(out & ~java).alias("other"), F.bool_or(out & java).alias("platform"))


def on_dispatch_chain(classes: DataFrame, pairs: DataFrame, most: int = LOCAL_EDGES) -> DataFrame:
    """pairs (class_name, owner): those where a call on owner may run on an instance of class_name: the same, a supertype or a subtype.

    A walk that leaves the scope may hide the other name, so it counts as related; but what is above a type of java/ is of java/ too,
    so leaving through java/ alone hides only names of java/.
    """
    pairs = settle(pairs.select("class_name", "owner").distinct())
    up = supertype_closure(classes, pairs.select("class_name").union(pairs.select("owner")), most).withColumnRenamed("class_name", "up")
    esc = _escapes(up.withColumnRenamed("up", "class_name"))
    side = lambda name, s: esc.select(F.col("start").alias(name), F.col("other").alias(f"{s}_other"), F.col("platform").alias(f"{s}_platform"))
    out = pairs.join(side("class_name", "c"), "class_name").join(side("owner", "o"), "owner")
    edge = up.select("start", "up").distinct().withColumn("is_up", F.lit(True))
    out = out.join(edge.select(F.col("start").alias("class_name"), F.col("up").alias("owner"), F.col("is_up").alias("above")), ["class_name", "owner"], "left")
    out = out.join(edge.select(F.col("start").alias("owner"), F.col("up").alias("class_name"), F.col("is_up").alias("below")), ["class_name", "owner"], "left")
    hides = lambda s, name: F.col(f"{s}_other") | (F.col(f"{s}_platform") & F.col(name).startswith("java/"))
    return out.where(F.coalesce("above", "below", F.lit(False)) | hides("c", "owner") | hides("o", "class_name")).select("class_name", "owner")


def invocation_evidence(breaks: DataFrame, invocations: DataFrame, classes: DataFrame, most: int = LOCAL_EDGES) -> DataFrame:
    """breaks (class_name, name, descriptor, ...) -> invocation_found: is the method called on an owner that is on the class's dispatch chain?

    Over a hierarchy that the tasks can read, no pairs of a break and a call are made.
    """
    key = ["class_name", "name", "descriptor"]
    breaks = settle(breaks)
    if (h := local_hierarchy(classes, most)) is not None and h.tall:
        shared = h.shared
        found = grouped(breaks.select(*key), invocations.select("owner", "name", "descriptor").distinct(), lambda a, b: evidence(shared.value.tree(), a, b), "class_name string, name string, descriptor string")
    else:
        calls = breaks.select(*key).distinct().join(invocations.select("owner", "name", "descriptor").distinct(), ["name", "descriptor"])
        found = calls.join(on_dispatch_chain(classes, calls, most), ["class_name", "owner"], "left_semi").select(*key).distinct()
    found = found.withColumn("f", F.lit(True))
    return breaks.join(found, key, "left").withColumn("invocation_found", F.coalesce("f", F.lit(False))).drop("f")


def instantiable(providers: DataFrame, classes: DataFrame, members: DataFrame, graph: DataFrame, scope_first: bool) -> DataFrame:
    """providers (iface, provider, ...) -> fits yes/no/unknown: public, concrete, with a public constructor without parameters of its own, and a
    subtype of the service.

    A provider without a row in scope is unknown if the graph has it, since only its members are not at hand, and no otherwise.
    scope_first: whose edges count where scope and graph both know a class.
    """
    ctor = members.where("mkind = 'method' and name = '<init>' and descriptor = '()V'").where(has("access", PUBLIC)).select(F.col("class_name").alias("provider"), F.lit(True).alias("made")).distinct()
    flags = classes.select(F.col("class_name").alias("provider"), F.col("access").alias("flags"))
    here = graph.select(F.col("class_name").alias("provider"), F.lit(True).alias("in_graph")).distinct()
    edges = prefer(classes, graph) if scope_first else prefer(graph, classes)
    up = assignable(edges, providers.select(F.col("provider").alias("sub"), F.col("iface").alias("sup"))).select(F.col("sub").alias("provider"), F.col("sup").alias("iface"), F.col("status").alias("is_sub"))
    out = providers.join(flags, "provider", "left").join(here, "provider", "left").join(ctor, "provider", "left").join(up, ["iface", "provider"], "left")
    plain = has("flags", PUBLIC) & ~has("flags", INTERFACE) & ~has("flags", ABSTRACT)
    fits = F.when(F.col("flags").isNull(), F.when(F.col("in_graph"), "unknown").otherwise("no")).when(~plain | F.col("made").isNull(), "no").otherwise(F.col("is_sub"))
    return out.withColumn("fits", fits).drop("flags", "in_graph", "made", "is_sub")


def still_listed(old_services: DataFrame, new_services: DataFrame) -> DataFrame:
    """(iface, provider, source): providers that both sides list for a service, with the source of their first new registration."""
    order = [c for c in ("path_ord", "entry_ord", "ord") if c in new_services.columns]
    first = new_services.groupBy("iface", "provider").agg(F.min(F.struct(*order, "source")).alias("f")).select("iface", "provider", "f.source")
    return first.join(old_services.select("iface", "provider").distinct(), ["iface", "provider"])


def spi_breaks(old_services: DataFrame, new_services: DataFrame, old: DataFrame, new: DataFrame, old_members: DataFrame, new_members: DataFrame, graph: DataFrame) -> DataFrame:
    """(iface, provider, source, reason) of still listed providers that could be made before and provably cannot now.

    old, new: the scopes, whose own edges count first on the old side; on the new side those of the graph do.
    """
    was = instantiable(still_listed(old_services, new_services), old, old_members, graph, True).where("fits = 'yes'").drop("fits")
    hit = instantiable(was, new, new_members, graph, False).where("fits = 'no'").drop("fits")
    here = new.select(F.col("class_name").alias("provider"), F.lit(True).alias("here"))
    return hit.join(here, "provider", "left").select("iface", "provider", "source", F.when(F.col("here"), "service provider not instantiable").otherwise("service provider removed").alias("reason"))
