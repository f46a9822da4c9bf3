import random

import pytest

from pyspark.sql import functions as F

from linkora.operators import closure, evidence, policy, structural
from linkora.queries import catalog

CLASS = "class_name string, source string, access int, super_name string, interfaces array<string>, nest_host string, permitted array<string>, sealing_unknown boolean"
MEMBER = "class_name string, mkind string, name string, descriptor string, access int"


def random_graph(rng, n=7):
    names = [f"c{i}" for i in range(n)]
    known = {c: (rng.choice([*names, None, "java/lang/Object", "out"]), rng.sample(names, rng.randrange(3))) for c in names if rng.random() < 0.9}
    return known, {c for c in known if rng.random() < 0.3}


def field(known, declares, c, seen):
    """Plain depth-first search: self, interfaces, superclass."""
    if c in seen:
        return None
    seen.add(c)
    if c not in known:
        return ("unknown", None)
    if c in declares:
        return ("found", c)
    sup, faces = known[c]
    for up in [*faces, sup]:
        if up and up != "java/lang/Object" and (r := field(known, declares, up, seen)):
            return r
    return None


def test_field_resolution_against_plain_search(spark):
    rng, classes, members, wanted, want = random.Random(5), [], [], [], {}
    for g in range(25):
        known, declares = random_graph(rng)
        tag = lambda x: x if x in (None, "java/lang/Object") else f"g{g}/{x}"  # noqa: B023, E731
        classes += [(tag(c), "s", 1, tag(s), [tag(f) for f in fs], None, None, False) for c, (s, fs) in known.items()]
        members += [(tag(c), "field", "f", "I", 1) for c in declares]
        for c in known:
            wanted.append((tag(c), "f", "I"))
            status, at = field(known, declares, c, set()) or ("not_found", None)
            want[tag(c)] = (status, tag(at))
    tables = spark.createDataFrame(classes, CLASS), spark.createDataFrame(members, MEMBER), spark.createDataFrame(wanted, "owner string, name string, descriptor string")
    for most in (closure.LOCAL_EDGES, 0):
        assert {r.owner: (r.status, r["at"]) for r in closure.resolve_field(*tables, most=most).collect()} == want


def method(known, declares, c):
    """The superclass chain, then its interfaces depth first."""
    chain, x = [], c
    while x and x != "java/lang/Object" and x not in chain:
        if x not in known:
            return ("unknown", None)
        if x in declares:
            return ("found", x)
        chain.append(x)
        x = known[x][0]
    seen, out = set(), False

    def walk(x):
        nonlocal out
        if x in seen:
            return None
        seen.add(x)
        if x not in known:
            out = True
            return None
        return x if x in declares else next((r for f in known[x][1] if (r := walk(f))), None)

    found = next((r for x in chain for f in known[x][1] if (r := walk(f))), None)
    return ("found", found) if found else ("unknown" if out else "not_found", None)


def test_method_resolution_and_closures_both_ways(spark):
    rng, classes, members, wanted, want = random.Random(9), [], [], [], {}
    for g in range(25):
        known, declares = random_graph(rng)
        tag = lambda x: x if x in (None, "java/lang/Object") else f"g{g}/{x}"  # noqa: B023, E731
        classes += [(tag(c), "s", 1, tag(s), [tag(f) for f in fs], None, None, False) for c, (s, fs) in known.items()]
        members += [(tag(c), "method", "m", "()V", 1) for c in declares]
        for c in known:
            wanted.append((tag(c), "m", "()V"))
            status, at = method(known, declares, c)
            want[tag(c)] = (status, tag(at))
    c, m, w = spark.createDataFrame(classes, CLASS), spark.createDataFrame(members, MEMBER), spark.createDataFrame(wanted, "owner string, name string, descriptor string")
    assert {r.owner: (r.status, r["at"]) for r in closure.resolve_method(c, m, w).collect()} == want
    assert {r.owner: (r.status, r["at"]) for r in closure.resolve_method(c, m, w, most=0).collect()} == want
    starts = c.select("class_name").unionByName(spark.createDataFrame([("no/Where",)], "class_name string"))
    for f in (closure.supertype_closure, closure.super_chain):
        one, two = ({tuple(r) for r in f(c, starts, most=n).collect()} for n in (closure.LOCAL_EDGES, 0))
        assert one == two and any(r[0] == "no/Where" for r in one)
    edges = c.select(F.col("class_name").alias("src"), F.col("super_name").alias("dst")).where("dst is not null")
    one, two = ({r.class_name for r in closure.reachable(edges, c.limit(5), most=n).collect()} for n in (closure.LOCAL_EDGES, 0))
    assert one == two


def test_dispatch_chain_and_platform_types(spark):
    classes = [("A", "s", 1, "B", ["java/io/Serializable"], None, None, False), ("B", "s", 1, "java/lang/Object", [], None, None, False), ("C", "s", 1, "A", [], None, None, False), ("D", "s", 1, "java/lang/Object", ["java/lang/Comparable"], None, None, False), ("E", "s", 1, "lib/Out", [], None, None, False)]
    pairs = [("A", "B"), ("A", "C"), ("A", "D"), ("A", "E"), ("D", "java/util/X"), ("B", "D"), ("A", "A")]
    got = structural.on_dispatch_chain(spark.createDataFrame(classes, CLASS), spark.createDataFrame(pairs, "class_name string, owner string"))
    # D is a sibling: what it leaves the scope through is of java/ and hides nothing of ours. E may be anything.
    assert {tuple(r) for r in got.collect()} == {("A", "B"), ("A", "C"), ("A", "E"), ("D", "java/util/X"), ("A", "A")}


def test_providers_are_judged_in_three_values(spark):
    row = lambda n, a, sup="java/lang/Object", faces=(): (n, "s", a, sup, list(faces), None, None, False)
    classes = [row("P", 1, faces=["S"]), row("Q", 1, "gone/Base"), row("R", 0, faces=["S"]), row("S", 0x601), row("T", 1)]
    members = [(c, "method", "<init>", "()V", 1) for c in "PQRT"]
    graph = spark.createDataFrame([row("OnlyGraph", 1)], CLASS)
    providers = spark.createDataFrame([("S", p) for p in ("P", "Q", "R", "T", "OnlyGraph", "Nowhere")], "iface string, provider string")
    got = structural.instantiable(providers, spark.createDataFrame(classes, CLASS), spark.createDataFrame(members, MEMBER), graph, True)
    assert {r.provider: r.fits for r in got.collect()} == {"P": "yes", "Q": "unknown", "R": "no", "T": "no", "OnlyGraph": "unknown", "Nowhere": "no"}


def test_closure_and_chain_with_cycles(spark):
    rows = [("a", "s", 1, "b", ["i"], None, None, False), ("b", "s", 1, "a", [], None, None, False), ("i", "s", 1, "java/lang/Object", ["x"], None, None, False)]
    c = spark.createDataFrame(rows, CLASS)
    assert {(r.start, r.class_name, r.in_scope) for r in closure.supertype_closure(c, c.where("class_name = 'a'")).collect()} == {("a", "a", True), ("a", "b", True), ("a", "i", True), ("a", "x", False)}
    assert {(r.class_name, r.depth) for r in closure.super_chain(c, c.where("class_name = 'a'")).collect()} == {("a", 0), ("b", 1)}


def test_conflicting_defaults(spark):
    face = 0x601
    classes = [("C", "s", 1, "java/lang/Object", ["I", "J"], None, None, False), ("I", "s", face, None, [], None, None, False), ("J", "s", face, None, [], None, None, False), ("K", "s", face, None, ["I"], None, None, False), ("D", "s", 1, "java/lang/Object", ["I", "K"], None, None, False)]
    members = [("I", "method", "m", "()V", 1), ("J", "method", "m", "()V", 1), ("K", "method", "m", "()V", 1)]
    got = structural.implementation_status(spark.createDataFrame(classes, CLASS), spark.createDataFrame(members, MEMBER), spark.createDataFrame([("C", "m", "()V"), ("D", "m", "()V"), ("C", "toString", "()Ljava/lang/String;"), ("C", "z", "()V")], "start string, name string, descriptor string"))
    assert {(r.start, r.name): r.status for r in got.collect()} == {("C", "m"): "conflict", ("D", "m"): "concrete", ("C", "toString"): "concrete", ("C", "z"): "absent"}


def test_log_blocks():
    log = "[1s][info][class,load] a.B source: x\nJava stack when loading a.C:\n\tat java.lang.ClassLoader.loadClass(C.java:1)\n\t- locked <1>\n[2s][gc,heap] skipped\n\tat java.lang.Class.forName(C.java:9)\n\tat jdk.internal.reflect.M.invoke(X)\n\tat my.App.main(App.java:3)\nplain.Name, and more\nnot a name\n"
    assert list(evidence.parse_log(log)) == [(0, "a/B", False, None), (1, "a/C", False, None), (1, "a/C", True, "java.lang.Class.forName from my.App.main(App.java:3)"), (8, "plain/Name", False, None)]


@pytest.mark.parametrize(
    "log, want",
    [
        ("[1s][class,load,cause,native] Native stack when loading a.B:\n[1s][class,load,cause,native] V  [libjvm.so+0x1]", [("a/B", False, None)]),
        ("[1.0s][info] a.B source: x", [("a/B", False, None)]),
        ("[class,load] a.B: x", [("a/B", False, None)]),
        ("[class,load] Solo x\nSolo x", [("Solo", False, None)]),
        ("[gc,load] a.B x", []),
        ("Java stack when loading a.B\n\tat x.Y.z(Y.java:1)", [("a/B", False, None), ("a/B", True, "x.Y.z(Y.java:1)")]),
        ("Java stack when loading a.B:\n\tat java.base/java.lang.ClassLoader.loadClass(C)\n\tat java.util.ServiceLoader.next(S.java:2)\n\tat x.Y.z(Y)", [("a/B", False, None), ("a/B", True, "java.util.ServiceLoader.next from x.Y.z(Y)")]),
        ("Java stack when loading a.B:\nother text\n\tat x.Y.z(Y)", [("a/B", False, None)]),
        ("été.Ärger\n10.0.0.1\na..b", [("été/Ärger", False, None)]),
        ("a.B " + "x" * evidence.LINE, []),
    ],
)
def test_log_lines(log, want):
    assert [(c, s, t) for _, c, s, t in evidence.parse_log(log)] == want


def test_log_files_and_first_stack(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "b.log").write_text("Java stack when loading a.B:\n\tat java.lang.ClassLoader.loadClass(C)\n")
    (tmp_path / "d" / "c.log").write_text("Java stack when loading a.B:\n\tat x.Y.z(Y)\na.C\n")
    (tmp_path / "d" / "skip.jfr").write_text("a.D\n")
    (tmp_path / "e.log").write_bytes(b"a.E\n" + b"\xff" * 200_000 + b"\na.F")
    got = {r.class_name: (r.stacked, r.trigger) for r in evidence.load_logs(spark, [str(tmp_path / "d"), str(tmp_path / "e.log")]).collect()}
    # The first stack with frames counts though it names nobody.
    assert got == {"a/B": (True, None), "a/C": (False, None), "a/E": (False, None), "a/F": (False, None)}


def test_tiers(spark):
    df = spark.createDataFrame([(False, False, None), (False, True, False), (None, None, None), (True, None, False)], "reachable boolean, observed_loading boolean, invocation_found boolean")
    assert [r.tier for r in df.select(policy.tier().alias("tier")).collect()] == ["unproven", "latent", "breaks", "latent"]


def test_catalogue_has_sql():
    assert set(catalog.SQL) <= set(catalog.QUERIES) and len(catalog.QUERIES) == len(catalog.SQL)
