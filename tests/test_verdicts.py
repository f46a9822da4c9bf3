"""The bag of references is written once, and members resolved with their rows get what they get by joins."""

import random

from linkora.operators import closure, verdict
from linkora.queries import catalog

CLASS = "class_name string, access int, super_name string, interfaces array<string>"
MEMBER = "class_name string, mkind string, name string, descriptor string, access int"
ASKED = "owner string, name string, descriptor string, is_field boolean, ask boolean, more int"


def test_rows_with_their_resolution_against_joins(spark):
    rng = random.Random(3)
    classes, members, rows = [], [], set()
    for i in range(60):
        classes.append((f"p/C{i}", 1, f"p/C{i // 2}" if i > 1 else None, [f"p/C{x}" for x in rng.sample(range(i), min(i, 2))] + ["out/X"] * (i % 9 == 8)))
        members += [(f"p/C{i}", kind, name, "d", rng.choice([1, 2, 8])) for kind in ("field", "method") for name in ("a", "b") if rng.random() < 0.2]
        rows |= {(f"p/C{i}", name, "d", field, rng.random() < 0.8, i) for name in ("a", "b", "c") for field in (False, True)}
    rows |= {("out/Y", "a", "d", False, True, 1), ("p/C1", "a", None, False, True, 2), ("java/lang/Object", "hashCode", "()I", False, True, 3)}
    c, m, r = spark.createDataFrame(classes, CLASS), spark.createDataFrame(members, MEMBER), spark.createDataFrame(list(rows), ASKED)
    one, other = (sorted(closure.resolve_rows(c, m, r, "n", most).collect(), key=str) for most in (closure.LOCAL_EDGES, 0))
    assert len(one) == len(rows) and one == other
    assert {x.n_status for x in one} == {"found", "not_found", "unknown", None} and all((x.n_status is None) != x.ask for x in one)


def test_bag_is_written_once(spark, monkeypatch):
    written, settle = [], verdict.settle
    monkeypatch.setattr(verdict, "settle", lambda df: written.append(df.columns) or settle(df))
    assert catalog.QUERIES["verdict_counters"](spark, "/root/testdata/sf0.001").count() == 3
    assert sum("source" in columns for columns in written) == 1
