"""Searches over hierarchies without cycles, which are decided for many classes at once, against the walks by joins (most=0)."""

import random

import numpy as np
import pyarrow as pa
import pytest

from linkora.operators import closure, structural, wanted
from linkora.operators.hierarchy import Hierarchy

CLASS = "class_name string, source string, access int, super_name string, interfaces array<string>, nest_host string, permitted array<string>, sealing_unknown boolean"
MEMBER = "class_name string, mkind string, name string, descriptor string, access int"


@pytest.fixture(scope="module")
def world(spark):
    """Forty graphs: a class is above those of higher numbers only; some names are in no table, some are of java/."""
    rng, classes, members = random.Random(3), [], []
    for g in range(40):
        known = [i for i in range(9) if rng.random() < 0.85]
        name = lambda i: f"java/g{g}/c{i}" if i == 3 else f"g{g}/c{i}"  # noqa: B023, E731
        for i in known:
            sup = name(rng.randrange(i)) if i and rng.random() < 0.7 else rng.choice([None, "java/lang/Object"])
            faces = [name(f) for f in rng.sample(range(i), min(i, rng.randrange(4)))] + ["java/lang/Object"] * (rng.random() < 0.1)
            classes.append((name(i), "s", rng.choice([1, 0x601]), sup, faces, None, None, False))
            for kind, m in (("field", "f"), ("method", "m"), ("method", "k"), ("method", "<init>")):
                members += [(name(i), kind, m, "()V", rng.choice([1, 1, 0x401]))] * (rng.random() < 0.25)
    classes += [(f"two/{x}", "s", a, None, f, None, None, False) for x, a, f in (("I", 0x601, []), ("J", 0x601, []), ("K", 0x601, ["two/I"]), ("c1", 1, ["two/I", "two/J"]), ("c2", 1, ["two/I", "two/K"]))]
    members += [(f"two/{x}", "method", "m", "()V", 1) for x in "IJK"]
    c, m = spark.createDataFrame(classes, CLASS), spark.createDataFrame(members, MEMBER)
    assert closure.local_hierarchy(c, closure.LOCAL_EDGES).tall
    names = sorted({x for r in classes for x in (r[0], *r[4]) if x != "java/lang/Object"}) + ["no/Where", "java/no/Where", "java/lang/Object"]
    return c, m, names


def both(f):
    one, two = (sorted(map(tuple, f(most).collect()), key=repr) for most in (closure.LOCAL_EDGES, 0))
    assert one == two and one
    return one


def refuse(*_, **__):
    raise AssertionError("walks or pairs are listed")


def test_pairs_are_judged_without_listing_closures(spark, world, monkeypatch):
    c, _, names = world
    rng = random.Random(1)
    near = [(a, b) for a in names for b in names if a.split("/c")[0].replace("java/", "") == b.split("/c")[0].replace("java/", "") and rng.random() < 0.4]
    pairs = spark.createDataFrame(near + [(a, "java/lang/Object") for a in names] + [("no/Where", "g1/c1"), ("g1/c1", "no/Where"), (None, "g1/c1"), ("g1/c1", None)], "sub string, sup string")
    want = [{tuple(r) for r in f(c, pairs, most=0).collect()} for f in (closure.assignable, closure.subclass)]
    monkeypatch.setattr(closure, "supertype_closure", refuse)
    monkeypatch.setattr(closure, "super_chain", refuse)
    assert [{tuple(r) for r in f(c, pairs).collect()} for f in (closure.assignable, closure.subclass)] == want
    assert {s for w in want for _, _, s in w} == {"yes", "no", "unknown"}


def test_a_hierarchy_is_small_and_names_are_found_exactly():
    n = 50_000
    name = pa.array([f"p{i % 7}/C{i}" for i in range(n)])
    h = Hierarchy.of(pa.table({"class_name": name, "super_name": pa.array([f"p{i // 2 % 7}/C{i // 2}" if i else None for i in range(n)]), "interfaces": pa.array([[f"out/I{i % 3}"] if i % 9 == 0 else [] for i in range(n)], pa.list_(pa.string()))}))
    assert h.names.nbytes + sum(x.nbytes for x in (h.supers, h.at, h.ups, h.faces, h.height, h.out, h.hashes, h.order)) < 70 * n
    assert (h.codes(name) == np.arange(n)).all() and (h.codes(pa.array(["p1/C", "", None, "p1/C1x"])) == -1).all()


@pytest.mark.parametrize("kind", ["field", "method"])
def test_members_are_resolved_without_listing_places(spark, world, monkeypatch, kind):
    c, m, names = world
    w = spark.createDataFrame([(o, n, d) for o in names for n, d in (("f", "()V"), ("m", "()V"), ("k", "()V"), ("<init>", "()V"), ("notify", "()V"))] + [(None, "m", "()V"), ("g1/c1", None, "()V")], "owner string, name string, descriptor string")
    f = closure.resolve_field if kind == "field" else closure.resolve_method
    want = {tuple(r) for r in f(c, m, w, most=0).collect()}
    monkeypatch.setattr(closure, "field_places", refuse)
    monkeypatch.setattr(closure, "method_places", refuse)
    assert {tuple(r) for r in f(c, m, w).collect()} == want and {r[3] for r in want} == {"found", "not_found", "unknown"}


def test_closures_and_chains_both_ways(spark, world):
    c, _, names = world
    starts = spark.createDataFrame([(x,) for x in names[:-1]], "class_name string")
    for f in (closure.supertype_closure, closure.super_chain):
        both(lambda most: f(c, starts, most))  # noqa: B023
    some = starts.where("class_name like '%5' or class_name like '%Where'")
    for f in (closure.reached, closure.reaching):
        both(lambda most: f(c, some, most))  # noqa: B023


def test_evidence_makes_no_pairs(spark, world, monkeypatch):
    c, _, names = world
    rng = random.Random(2)
    breaks = spark.createDataFrame([(x, f"m{rng.randrange(60)}", "()V") for x in names[:-3] for _ in range(3)] + [("g1/c1", None, "()V")], "class_name string, name string, descriptor string")
    calls = spark.createDataFrame([(rng.choice([*names, "a/B"]), f"m{rng.randrange(60)}", "()V") for _ in range(100)], "owner string, name string, descriptor string")
    want = sorted(map(tuple, structural.invocation_evidence(breaks, calls, c, most=0).collect()), key=repr)
    monkeypatch.setattr(structural, "on_dispatch_chain", refuse)
    got = sorted(map(tuple, structural.invocation_evidence(breaks, calls, c).collect()), key=repr)
    assert got == want and {r[3] for r in got} == {True, False}


def test_implementations_are_judged_without_listing_closures(spark, world, monkeypatch):
    c, m, names = world
    keys = spark.createDataFrame([(x, n, "()V") for x in names[:-1] for n in ("m", "k", "notify", "z")], "start string, name string, descriptor string")
    want = {tuple(r) for r in structural.implementation_status(c, m, keys, most=0).collect()}
    monkeypatch.setattr(structural, "supertype_closure", refuse)
    got = {tuple(r) for r in structural.implementation_status(c, m, keys).collect()}
    assert got == want and {r[3] for r in got} == {"concrete", "abstract_only", "conflict", "absent", "unknown"}


def test_wanted_classes_need_no_closure_of_each(spark, world, monkeypatch):
    c, m, names = world
    lib, graph = c.where("class_name < 'g3'"), c.where("class_name >= 'g2'")
    refs = spark.createDataFrame([(x, "m" if i % 3 else None) for i, x in enumerate(names)], "owner string, name string")

    def old_way(library):
        return {r.class_name for r in closure.supertype_closure(closure.prefer(library, graph), refs.where("name is not null and owner <> 'java/lang/Object'").selectExpr("owner as class_name"), most=0).collect()}

    known, scanned = {r.class_name for r in lib.collect()}, {r.class_name for r in graph.collect()}
    want = (old_way(lib) - known) | {x for i, x in enumerate(names) if i % 3 == 0 and x not in known | scanned}
    monkeypatch.setattr(closure, "supertype_closure", refuse)
    got = wanted.reference_wanted(refs, lib, lib, graph).collect()
    assert {r.class_name: r.escape for r in got} == {x: x not in scanned for x in want}
