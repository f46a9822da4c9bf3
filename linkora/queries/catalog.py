"""One query for each operator, with its equivalent for the other engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.flags import OBJECT_METHODS, pretty_member
from ..operators import closure, diff, evidence, policy, scopes, structural, upgrade, verdict, wanted
from ..plans.scratch import settle
from .universe import frame, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable) -> Callable:
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(lambda n: frame(spark, sf_dir, n))
        if sql is not None:
            SQL[name] = sql
        return f

    return register


# --- diff ---

_BOTH = "old_lib o JOIN new_lib n USING (class_name)"
_VIS = "(CASE WHEN {0} & 1 <> 0 THEN 3 WHEN {0} & 4 <> 0 THEN 2 WHEN {0} & 2 <> 0 THEN 0 ELSE 1 END)"
_NAME = "list_value('private', 'package-private', 'protected', 'public')[{0} + 1]"
vis, vname = _VIS.format, lambda a: _NAME.format(_VIS.format(a))
_CLASS_TAIL = "CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS descriptor"
_NO_ACCESS = "CAST(NULL AS VARCHAR) AS from_access, CAST(NULL AS VARCHAR) AS to_access"


def _class_sql(kind: str, where: str, access: str = _NO_ACCESS) -> str:
    return oracle(["old_lib", "new_lib"], f"SELECT {kind} AS kind, class_name, {_CLASS_TAIL}, {access} FROM {_BOTH} WHERE {where}")


_FROM_TO = f"{vname('o.access')} AS from_access, {vname('n.access')} AS to_access"


def _plain(df: DataFrame) -> DataFrame:
    return df.drop("replacements")


@query(oracle(["old_lib", "new_lib"], f"SELECT 'class_removed' AS kind, class_name, {_CLASS_TAIL}, {_NO_ACCESS} FROM old_lib WHERE class_name NOT IN (SELECT class_name FROM new_lib)"))
def class_removed(t):
    return _plain(diff.class_removed(t("old_lib"), t("new_lib")))


@query(_class_sql("'class_access_narrowed'", f"{vis('n.access')} < {vis('o.access')}", _FROM_TO))
def class_access_narrowed(t):
    return _plain(diff.class_access_narrowed(t("old_lib"), t("new_lib")))


@query(_class_sql("'class_became_final'", "o.access & 16 = 0 AND n.access & 16 <> 0"))
def class_became_final(t):
    return _plain(diff.class_became_final(t("old_lib"), t("new_lib")))


_OPEN = "o.access & 16400 = 0 AND n.access & 16400 = 0 AND NOT o.sealing_unknown AND NOT n.sealing_unknown AND n.permitted IS NOT NULL"


@query(_class_sql("'class_became_sealed'", f"{_OPEN} AND (o.permitted IS NULL OR NOT list_has_all(n.permitted, o.permitted))"))
def class_became_sealed(t):
    return _plain(diff.class_became_sealed(t("old_lib"), t("new_lib")))


@query(_class_sql("CASE WHEN n.access & 512 <> 0 THEN 'class_became_interface' ELSE 'interface_became_class' END", "o.access & 512 <> n.access & 512"))
def class_kind_flip(t):
    return _plain(diff.class_kind_flip(t("old_lib"), t("new_lib")))


@query(_class_sql("'class_became_abstract'", "o.access & 512 = n.access & 512 AND o.access & 1024 = 0 AND n.access & 1024 <> 0"))
def class_became_abstract(t):
    return _plain(diff.class_became_abstract(t("old_lib"), t("new_lib")))


_KEY = "class_name, mkind, name, descriptor"


def _member_sql(kind: str, where: str, access: str = _NO_ACCESS) -> str:
    return oracle(["old_m", "new_m"], f"SELECT {kind} AS kind, class_name, name, descriptor, {access} FROM old_m o JOIN new_m n USING ({_KEY}) WHERE o.access & 2 = 0 AND {where}")


@query(_member_sql("mkind || '_access_narrowed'", f"{vis('n.access')} < {vis('o.access')}", _FROM_TO))
def member_access_narrowed(t):
    return _plain(diff.member_access_narrowed(t("old_m"), t("new_m")))


@query(_member_sql("'method_became_abstract'", "mkind = 'method' AND o.access & 1024 = 0 AND n.access & 1024 <> 0"))
def method_became_abstract(t):
    return _plain(diff.method_became_abstract(t("old_m"), t("new_m")))


@query(_member_sql("mkind || CASE WHEN n.access & 8 <> 0 THEN '_became_static' ELSE '_became_instance' END", "o.access & 8 <> n.access & 8"))
def member_static_flip(t):
    return _plain(diff.member_static_flip(t("old_m"), t("new_m")))


@query(_member_sql("mkind || '_became_final'", "o.access & 16 = 0 AND n.access & 16 <> 0"))
def member_became_final(t):
    return _plain(diff.member_became_final(t("old_m"), t("new_m")))


# --- resolution: recursive SQL over a class table c and a member table m, for starts(owner, name, descriptor) ---


def chain_sql(c: str, starts: str, p: str = "") -> str:
    return f""", {p}chain(start, class_name, depth, here, up) AS (SELECT s.class_name, s.class_name, 0, c.class_name IS NOT NULL, c.super_name FROM (SELECT DISTINCT class_name FROM {starts} WHERE class_name <> 'java/lang/Object') s LEFT JOIN {c} c USING (class_name)
UNION ALL SELECT start, {p}chain.up, depth + 1, c.class_name IS NOT NULL, c.super_name FROM {p}chain LEFT JOIN {c} c ON c.class_name = {p}chain.up WHERE {p}chain.up IS NOT NULL AND {p}chain.up <> 'java/lang/Object')"""


def closure_sql(c: str, starts: str, p: str = "") -> str:
    return f""", {p}ups AS (SELECT class_name AS below, super_name AS up FROM {c} UNION SELECT class_name, unnest(interfaces) FROM {c}),
{p}closure(start, class_name) AS (SELECT DISTINCT class_name, class_name FROM {starts} UNION SELECT start, up FROM {p}closure JOIN {p}ups ON class_name = below WHERE up IS NOT NULL AND up <> 'java/lang/Object')"""


_OBJ = "(" + ", ".join(f"'{a}{d}'" for a, d in OBJECT_METHODS) + ")"


def method_sql(c: str, m: str, wanted: str, p: str) -> str:
    """-> {p}method(owner, name, descriptor, status, at, access)"""
    return f""", {p}mk AS (SELECT DISTINCT owner, name, descriptor FROM {wanted}), {p}ms AS (SELECT DISTINCT owner AS class_name FROM {p}mk){chain_sql(c, p + "ms", p)},
{p}dm AS (SELECT class_name, name, descriptor, min(access) AS access FROM {m} WHERE mkind = 'method' GROUP BY ALL),
{p}h1 AS (SELECT k.owner, k.name, k.descriptor, ch.depth, ch.here, ch.class_name, d.access FROM {p}mk k JOIN {p}chain ch ON k.owner = ch.start LEFT JOIN {p}dm d ON d.class_name = ch.class_name AND d.name = k.name AND d.descriptor = k.descriptor
  WHERE (k.name NOT IN ('<init>', '<clinit>') OR depth = 0) AND (d.access IS NOT NULL OR NOT ch.here) QUALIFY row_number() OVER (PARTITION BY k.owner, k.name, k.descriptor ORDER BY ch.depth) = 1),
{p}r AS (SELECT * FROM {p}mk ANTI JOIN {p}h1 USING (owner, name, descriptor) WHERE name NOT IN ('<init>', '<clinit>') AND name || descriptor NOT IN {_OBJ}),
{p}fp(start, class_name, path) AS (SELECT ch.start, f.face, list_value(ch.depth, f.n - 1) FROM {p}chain ch JOIN (SELECT class_name, unnest(interfaces) AS face, generate_subscripts(interfaces, 1) AS n FROM {c}) f ON f.class_name = ch.class_name
UNION ALL SELECT fp.start, f.face, list_append(fp.path, f.n - 1) FROM {p}fp fp JOIN (SELECT class_name, unnest(interfaces) AS face, generate_subscripts(interfaces, 1) AS n FROM {c}) f ON f.class_name = fp.class_name),
{p}h2 AS (SELECT r.owner, r.name, r.descriptor, bool_or(c.class_name IS NULL) AS out, arg_min(fp.class_name, fp.path) FILTER (d.access IS NOT NULL) AS at, arg_min(d.access, fp.path) FILTER (d.access IS NOT NULL) AS access
  FROM {p}r r JOIN {p}fp fp ON r.owner = fp.start LEFT JOIN {c} c ON c.class_name = fp.class_name LEFT JOIN {p}dm d ON d.class_name = fp.class_name AND d.name = r.name AND d.descriptor = r.descriptor GROUP BY ALL),
{p}method AS (SELECT k.owner, k.name, k.descriptor,
  CASE WHEN h1.owner IS NOT NULL THEN CASE WHEN h1.here THEN 'found' ELSE 'unknown' END WHEN k.name || k.descriptor IN {_OBJ} AND k.name NOT IN ('<init>', '<clinit>') THEN 'found' WHEN h2.at IS NOT NULL THEN 'found' WHEN h2.out THEN 'unknown' ELSE 'not_found' END AS status,
  CASE WHEN h1.owner IS NOT NULL THEN CASE WHEN h1.here THEN h1.class_name END WHEN k.name || k.descriptor IN {_OBJ} THEN 'java/lang/Object' ELSE h2.at END AS at,
  CAST(CASE WHEN h1.owner IS NOT NULL THEN CASE WHEN h1.here THEN h1.access END WHEN k.name || k.descriptor IN {_OBJ} THEN 1 ELSE h2.access END AS INTEGER) AS access
  FROM {p}mk k LEFT JOIN {p}h1 h1 USING (owner, name, descriptor) LEFT JOIN {p}h2 h2 USING (owner, name, descriptor))"""


def field_sql(c: str, m: str, wanted: str, p: str) -> str:
    """-> {p}field(owner, name, descriptor, status, at, access)"""
    ups = f"(SELECT class_name, unnest(list_append(interfaces, super_name)) AS up, generate_subscripts(list_append(interfaces, super_name), 1) - 1 AS n FROM {c})"
    return f""", {p}fk AS (SELECT DISTINCT owner, name, descriptor FROM {wanted}),
{p}pp(start, class_name, path) AS (SELECT DISTINCT owner, owner, CAST([] AS BIGINT[]) FROM {p}fk UNION ALL SELECT start, u.up, list_append(path, u.n) FROM {p}pp pp JOIN {ups} u ON u.class_name = pp.class_name WHERE u.up IS NOT NULL AND u.up <> 'java/lang/Object'),
{p}fe AS (SELECT k.owner, k.name, k.descriptor, c.class_name IS NOT NULL AS here, pp.class_name, d.access FROM {p}fk k JOIN {p}pp pp ON k.owner = pp.start LEFT JOIN {c} c ON c.class_name = pp.class_name LEFT JOIN {m} d ON d.mkind = 'field' AND d.class_name = pp.class_name AND d.name = k.name AND d.descriptor = k.descriptor
  WHERE d.access IS NOT NULL OR c.class_name IS NULL QUALIFY row_number() OVER (PARTITION BY k.owner, k.name, k.descriptor ORDER BY path) = 1),
{p}field AS (SELECT k.owner, k.name, k.descriptor, CASE WHEN e.owner IS NULL THEN 'not_found' WHEN here THEN 'found' ELSE 'unknown' END AS status, CASE WHEN here THEN class_name END AS at, CAST(CASE WHEN here THEN access END AS INTEGER) AS access FROM {p}fk k LEFT JOIN {p}fe e USING (owner, name, descriptor))"""


_GONE = """, gone AS (SELECT o.class_name, o.mkind, o.name, o.descriptor FROM old_m o SEMI JOIN new_lib USING (class_name) ANTI JOIN new_m USING (class_name, mkind, name, descriptor) WHERE o.access & 2 = 0),
gm AS (SELECT class_name AS owner, name, descriptor FROM gone WHERE mkind = 'method'), gf AS (SELECT class_name AS owner, name, descriptor FROM gone WHERE mkind = 'field')"""
_LOST = _GONE + method_sql("new_lib", "new_m", "gm", "x") + field_sql("new_lib", "new_m", "gf", "y") + ", lost AS (SELECT owner AS class_name, 'method' AS mkind, name, descriptor FROM xmethod WHERE status = 'not_found' UNION ALL SELECT owner, 'field', name, descriptor FROM yfield WHERE status = 'not_found')"


@query(oracle(["old_m", "new_m", "new_lib"], _LOST + " SELECT class_name, mkind, name, descriptor FROM lost"))
def member_removed(t):
    out = diff.member_removed(t("old_m"), t("new_lib"), t("new_m"))
    return out.select("class_name", F.regexp_replace("kind", "_removed", "").alias("mkind"), "name", "descriptor")


@query(oracle(["old_m", "new_m", "new_lib"], _GONE + " SELECT g.class_name, g.mkind, g.name, g.descriptor, array_to_string(list_sort(list(DISTINCT n.descriptor)), ',') AS replacements FROM gone g JOIN new_m n ON g.class_name = n.class_name AND g.mkind = n.mkind AND g.name = n.name GROUP BY ALL"))
def replacement_descriptors(t):
    out = diff.replacement_descriptors(diff.members_gone(t("old_m"), t("new_lib"), t("new_m")), t("new_m"))
    return out.withColumn("replacements", F.array_join("replacements", ","))


_ALL = "".join(f", q{i} AS ({SQL[n][SQL[n].rindex(' SELECT') :] if n != 'class_removed' else SQL[n][SQL[n].index(' SELECT ' + chr(39) + 'class_removed') :]})" for i, n in enumerate(["class_removed", "class_access_narrowed", "class_became_final", "class_became_sealed", "class_kind_flip", "class_became_abstract", "member_access_narrowed", "method_became_abstract", "member_static_flip", "member_became_final"]))


@query(oracle(["old_m", "new_m", "new_lib", "old_lib"], _LOST + _ALL + ", k AS (" + " UNION ALL ".join(f"SELECT kind FROM q{i}" for i in range(10)) + " UNION ALL SELECT mkind || '_removed' FROM lost) SELECT CASE WHEN kind LIKE 'method\\_%' ESCAPE '\\' THEN 'method' WHEN kind LIKE 'field\\_%' ESCAPE '\\' THEN 'field' ELSE 'class' END AS bucket, count(*) AS n FROM k GROUP BY 1"))
def diff_counts(t):
    return diff.diff_counts(diff.diff(t("old_lib"), t("new_lib"), t("old_m"), t("new_m")))


# --- scopes ---

_COPIES = ", copies AS (SELECT class_name, access, 2 AS path_ord, 0 AS entry_ord FROM old_lib UNION ALL SELECT class_name, access, 1, 0 FROM new_lib WHERE access % 2 = 1 UNION ALL SELECT class_name, access, 1, 1 FROM old_lib WHERE access % 2 = 1)"


def _copies(t):
    a, b = t("old_lib").select("class_name", "access"), t("new_lib").select("class_name", "access")
    tag = lambda df, p, e: df.withColumn("path_ord", F.lit(p)).withColumn("entry_ord", F.lit(e))
    return tag(a, 2, 0).unionByName(tag(b.where("access % 2 = 1"), 1, 0)).unionByName(tag(a.where("access % 2 = 1"), 1, 1))


@query(oracle(["old_lib", "new_lib"], _COPIES + " SELECT class_name, access, path_ord, entry_ord FROM copies QUALIFY row_number() OVER (PARTITION BY class_name ORDER BY path_ord, entry_ord) = 1"))
def first_wins_classes(t):
    return scopes.first_wins(_copies(t), ["class_name"], ["path_ord", "entry_ord"])


@query(oracle(["old_lib", "new_lib"], _COPIES + " SELECT class_name, access AS crc32, path_ord, entry_ord, path_ord = 2 AS is_dir FROM copies QUALIFY path_ord = 2 OR row_number() OVER (PARTITION BY class_name, access, path_ord = 2 ORDER BY path_ord, entry_ord) = 1"))
def crc_dedup(t):
    return scopes.crc_first(_copies(t).withColumnRenamed("access", "crc32").withColumn("is_dir", F.col("path_ord") == 2))


@query(oracle(["old_lib", "new_lib", "app"], " SELECT class_name, access, layer FROM (SELECT class_name, access, 0 AS layer FROM new_lib UNION ALL SELECT class_name, access, 1 FROM app UNION ALL SELECT class_name, access, 2 FROM old_lib) QUALIFY row_number() OVER (PARTITION BY class_name ORDER BY layer) = 1"))
def scope_layers(t):
    return scopes.layered(*[t(n).select("class_name", "access") for n in ("new_lib", "app", "old_lib")])


@query(oracle(["refs", "old_lib"], " SELECT source, kind, count(*) AS n FROM refs WHERE owner IN (SELECT class_name FROM old_lib) GROUP BY ALL"))
def owner_semi_join(t):
    return scopes.owner_refs(t("refs"), t("old_lib")).groupBy("source", "kind").agg(F.count("*").alias("n"))


@query(oracle(["graph", "old_scope"], " SELECT class_name, CASE WHEN g.class_name IS NOT NULL THEN coalesce(g.nest_host, class_name) ELSE coalesce(s.nest_host, class_name) END AS host FROM old_scope s LEFT JOIN graph g USING (class_name)"))
def nest_host(t):
    return scopes.nest_host(t("old_scope"), t("graph"), t("old_scope"))


# --- closures and resolution ---


@query(oracle(["new_scope", "graph"], closure_sql("new_scope", "graph") + " SELECT start, class_name, class_name IN (SELECT class_name FROM new_scope) AS in_scope FROM closure"))
def supertype_closure(t):
    return closure.supertype_closure(t("new_scope"), t("graph"))


@query(oracle(["new_scope", "graph"], chain_sql("new_scope", "graph") + " SELECT start, class_name, depth, here AS in_scope FROM chain"))
def super_chain(t):
    return closure.super_chain(t("new_scope"), t("graph"))


_MK = ", asked AS (SELECT DISTINCT owner, name, descriptor FROM refs WHERE kind IN ('method', 'interface_method'))"
_FK = ", asked AS (SELECT DISTINCT owner, name, descriptor FROM refs WHERE kind = 'field')"


@query(oracle(["refs", "new_scope", "new_all_m"], _MK + method_sql("new_scope", "new_all_m", "asked", "x") + " SELECT * FROM xmethod"))
def resolve_method(t):
    return closure.resolve_method(t("new_scope"), t("new_all_m"), t("refs").where("kind in ('method', 'interface_method')"))


@query(oracle(["refs", "new_scope", "new_all_m"], _FK + field_sql("new_scope", "new_all_m", "asked", "x") + " SELECT * FROM xfield"))
def resolve_field(t):
    return closure.resolve_field(t("new_scope"), t("new_all_m"), t("refs").where("kind = 'field'"))


@query(oracle(["refs", "old_scope", "old_all_m"], ", asked AS (SELECT DISTINCT owner, '<init>' AS name, '()V' AS descriptor FROM refs)" + method_sql("old_scope", "old_all_m", "asked", "x") + " SELECT * FROM xmethod"))
def resolve_constructor(t):
    return closure.resolve_method(t("old_scope"), t("old_all_m"), t("refs").select("owner", F.lit("<init>").alias("name"), F.lit("()V").alias("descriptor")))


_PAIRS = ", pairs AS (SELECT DISTINCT source_class AS sub, owner AS sup FROM refs), ps AS (SELECT DISTINCT sub AS class_name FROM pairs)"


@query(oracle(["refs", "new_scope"], _PAIRS + chain_sql("new_scope", "ps") + " SELECT sub, sup, CASE WHEN bool_or(class_name = sup) THEN 'yes' WHEN bool_or(NOT here) THEN 'unknown' ELSE 'no' END AS status FROM pairs JOIN chain ON start = sub GROUP BY ALL"))
def is_subclass(t):
    return closure.subclass(t("new_scope"), t("refs").select(F.col("source_class").alias("sub"), F.col("owner").alias("sup")))


@query(oracle(["refs", "new_scope"], _PAIRS + closure_sql("new_scope", "ps") + " SELECT sub, sup, CASE WHEN bool_or(c.class_name = sup) THEN 'yes' WHEN bool_or(s.class_name IS NULL) THEN 'unknown' ELSE 'no' END AS status FROM pairs JOIN closure c ON start = sub LEFT JOIN new_scope s ON s.class_name = c.class_name GROUP BY ALL"))
def is_assignable(t):
    return closure.assignable(t("new_scope"), t("refs").select(F.col("source_class").alias("sub"), F.col("owner").alias("sup")))


def prefer_sql(name: str, first: str, second: str) -> str:
    return f", {name} AS (SELECT class_name, super_name, interfaces FROM {first} UNION ALL SELECT class_name, super_name, interfaces FROM {second} ANTI JOIN {first} USING (class_name))"


_OWNERS = ", ow AS (SELECT DISTINCT owner AS class_name FROM refs WHERE name IS NOT NULL AND owner <> 'java/lang/Object')"
_MET = (
    _OWNERS
    + prefer_sql("en", "new_lib", "graph")
    + prefer_sql("eo", "old_lib", "graph")
    + closure_sql("en", "ow", "wn")
    + closure_sql("eo", "ow", "wo")
    + ", met AS (SELECT class_name FROM wnclosure ANTI JOIN new_lib USING (class_name) UNION SELECT class_name FROM woclosure ANTI JOIN old_lib USING (class_name) UNION SELECT owner FROM refs WHERE name IS NULL AND owner NOT IN (SELECT class_name FROM new_lib) AND owner NOT IN (SELECT class_name FROM graph))"
)


@query(oracle(["refs", "new_lib", "old_lib", "graph"], _MET + " SELECT class_name, class_name NOT IN (SELECT class_name FROM graph) AS escape FROM met"))
def reference_wanted(t):
    return wanted.reference_wanted(t("refs"), t("old_lib"), t("new_lib"), t("graph"))


# --- structural ---


@query(oracle(["graph", "old_lib", "new_lib"], f" SELECT g.class_name, g.super_name FROM graph g JOIN (SELECT class_name FROM {_BOTH} WHERE o.access & 16 = 0 AND n.access & 16 <> 0) f ON g.super_name = f.class_name"))
def extends_newly_final(t):
    return structural.extends_newly_final(t("graph"), t("old_lib"), t("new_lib"))


_FINALS = ", finals AS (SELECT class_name, name, descriptor FROM old_m o JOIN new_m n USING (class_name, mkind, name, descriptor) WHERE mkind = 'method' AND o.access & 4186 = 0 AND o.access & 64 = 0 AND n.access & 16 <> 0 AND n.access & 4162 = 0)"
_NEAR = ", g2 AS (SELECT class_name, super_name, interfaces FROM graph UNION ALL SELECT class_name, super_name, interfaces FROM new_lib)" + chain_sql("g2", "g2") + ", near AS (SELECT start AS class_name, arg_min(class_name, depth) AS ancestor, CAST(min(depth) AS INTEGER) AS depth FROM chain WHERE depth > 0 AND class_name IN (SELECT class_name FROM finals) GROUP BY start)"


def _g2(t):
    cols = ["class_name", "super_name", "interfaces"]
    return t("graph").select(*cols).unionByName(t("new_lib").select(*cols))


@query(oracle(["graph", "new_lib", "old_m", "new_m"], _FINALS + _NEAR + " SELECT class_name, ancestor, depth FROM near"))
def first_final_ancestor(t):
    return structural.first_final_ancestor(_g2(t), structural.newly_final_methods(t("old_m"), t("new_m")))


@query(oracle(["graph", "new_lib", "old_m", "new_m", "new_all_m"], _FINALS + _NEAR + " SELECT m.class_name, ancestor, m.name, m.descriptor FROM near JOIN new_all_m m ON m.class_name = near.class_name AND m.mkind = 'method' AND m.access & 4170 = 0 JOIN finals f ON f.class_name = ancestor AND f.name = m.name AND f.descriptor = m.descriptor"))
def overrides_newly_final(t):
    return structural.overrides_newly_final(_g2(t), t("new_all_m"), structural.newly_final_methods(t("old_m"), t("new_m")))


@query(oracle(["graph", "roots", "new_scope", "old_lib"], " SELECT g.class_name, g.super_name FROM graph g SEMI JOIN roots USING (source) JOIN new_scope s ON s.class_name = g.super_name AND s.access & 16 <> 0 WHERE NOT EXISTS (SELECT 1 FROM old_lib o WHERE o.class_name = g.class_name AND o.super_name = g.super_name)"))
def version_lag(t):
    return structural.version_lag(t("graph"), t("roots"), t("new_scope"), t("old_lib"))


@query(oracle(["graph", "old_lib", "new_lib"], f", flips AS (SELECT class_name AS up, n.access & 512 <> 0 AS face FROM {_BOTH} WHERE o.access & 512 <> n.access & 512) SELECT g.class_name, up, CASE WHEN face THEN 'class became interface' ELSE 'interface became class' END AS reason FROM (SELECT class_name, super_name AS up, TRUE AS needs FROM graph UNION ALL SELECT DISTINCT class_name, unnest(interfaces), FALSE FROM graph) g JOIN flips USING (up) WHERE needs = face"))
def edge_kind_flip(t):
    return structural.edge_kind_flip(t("graph"), t("old_lib"), t("new_lib"))


@query(oracle(["graph", "old_lib", "new_lib"], f", s AS (SELECT class_name AS up, o.permitted AS op, n.permitted AS np FROM {_BOTH} WHERE {_OPEN}) SELECT DISTINCT g.class_name, up FROM (SELECT class_name, unnest(list_append(interfaces, super_name)) AS up FROM graph) g JOIN s USING (up) WHERE NOT list_contains(np, g.class_name) AND (op IS NULL OR list_contains(op, g.class_name))"))
def sealed_unpermitted(t):
    return structural.sealed_unpermitted(t("graph"), t("old_lib"), t("new_lib"))


_ABS = ", na AS (SELECT n.class_name, n.name, n.descriptor FROM new_m n SEMI JOIN new_lib USING (class_name) SEMI JOIN old_lib USING (class_name) LEFT JOIN old_m o ON o.mkind = 'method' AND o.class_name = n.class_name AND o.name = n.name AND o.descriptor = n.descriptor WHERE n.mkind = 'method' AND n.access & 1024 <> 0 AND n.access & 4160 = 0 AND (o.access IS NULL OR o.access & 5184 = 0))"
_DEF = ", nd AS (SELECT n.class_name, n.name, n.descriptor FROM new_m n SEMI JOIN (SELECT class_name FROM new_lib WHERE access & 512 <> 0) USING (class_name) SEMI JOIN (SELECT class_name FROM old_lib WHERE access & 512 <> 0) USING (class_name) LEFT JOIN old_m o ON o.mkind = 'method' AND o.class_name = n.class_name AND o.name = n.name AND o.descriptor = n.descriptor WHERE n.mkind = 'method' AND n.access & 5194 = 0 AND (o.access IS NULL OR o.access & 1024 <> 0))"
_LIB = ["old_lib", "new_lib", "old_m", "new_m"]


@query(oracle(_LIB, _ABS + " SELECT * FROM na"))
def newly_abstract(t):
    return structural.newly_abstract(*[t(n) for n in _LIB])


@query(oracle(_LIB, _DEF + " SELECT * FROM nd"))
def newly_default(t):
    return structural.newly_default(*[t(n) for n in _LIB])


_CHANGED = ", changed AS (SELECT class_name FROM na UNION SELECT class_name FROM nd)"


@query(oracle(["graph", *_LIB], _ABS + _DEF + _CHANGED + prefer_sql("en", "new_lib", "graph") + closure_sql("en", "graph", "h") + ", heir AS (SELECT DISTINCT start FROM hclosure SEMI JOIN changed USING (class_name)) SELECT DISTINCT class_name FROM hclosure SEMI JOIN heir USING (start) WHERE class_name IN (SELECT class_name FROM graph)"))
def wanted_heirs(t):
    return wanted.selection_heirs(*[t(n) for n in _LIB], t("graph"))


@query(oracle(["graph", "new_lib", "old_m", "new_m"], _FINALS + prefer_sql("g3", "graph", "new_lib") + chain_sql("g3", "graph", "f") + " SELECT DISTINCT start AS class_name FROM fchain WHERE depth > 0 AND class_name IN (SELECT class_name FROM finals)"))
def wanted_final_heirs(t):
    return wanted.final_heirs(t("old_m"), t("new_m"), t("new_lib"), t("graph"))


@query(oracle(["services", "old_lib", "new_lib", "graph"], " SELECT DISTINCT provider AS class_name FROM services WHERE provider IN (SELECT class_name FROM graph) AND NOT (provider IN (SELECT class_name FROM old_lib) AND provider IN (SELECT class_name FROM new_lib))"))
def wanted_providers(t):
    return wanted.spi_wanted(t("services"), t("services"), t("old_lib"), t("new_lib"), t("graph"))


@query(oracle(["graph", "roots", "new_lib"], " SELECT DISTINCT super_name AS class_name, super_name NOT IN (SELECT class_name FROM graph) AS escape FROM graph SEMI JOIN roots USING (source) WHERE super_name IS NOT NULL AND super_name <> 'java/lang/Object' AND super_name NOT IN (SELECT class_name FROM new_lib)"))
def wanted_supers(t):
    return wanted.upgraded_supers(t("graph"), t("roots"), t("new_lib"))


def status_sql(c: str, m: str, keys: str, p: str) -> str:
    """-> {p}status(start, name, descriptor, status)"""
    return f""", {p}ks AS (SELECT DISTINCT start AS class_name FROM {keys}){chain_sql(c, p + "ks", p)}{closure_sql(c, p + "ks", p)},
{p}im AS (SELECT class_name, name, descriptor, access & 1024 <> 0 AS abs FROM {m} WHERE mkind = 'method' AND access & 10 = 0),
{p}s1 AS (SELECT k.start, k.name, k.descriptor, CASE WHEN NOT here THEN 'unknown' WHEN i.abs THEN 'abstract_only' ELSE 'concrete' END AS first FROM {keys} k JOIN {p}chain ch USING (start) LEFT JOIN {p}im i ON i.class_name = ch.class_name AND i.name = k.name AND i.descriptor = k.descriptor WHERE i.abs IS NOT NULL OR NOT here QUALIFY row_number() OVER (PARTITION BY k.start, k.name, k.descriptor ORDER BY depth) = 1),
{p}s2 AS (SELECT k.start, k.name, k.descriptor, cl.class_name, x.class_name IS NULL AS out, i.abs FROM {keys} k JOIN {p}closure cl USING (start) LEFT JOIN {c} x ON x.class_name = cl.class_name LEFT JOIN {p}im i ON i.class_name = cl.class_name AND i.name = k.name AND i.descriptor = k.descriptor WHERE cl.class_name <> k.start AND (x.class_name IS NULL OR x.access & 512 <> 0)),
{p}dk AS (SELECT DISTINCT class_name FROM {p}s2 WHERE abs = FALSE){closure_sql(c, p + "dk", p + "d")},
{p}s3 AS (SELECT a.start, a.name, a.descriptor, count(*) AS tops FROM {p}s2 a WHERE abs = FALSE AND NOT EXISTS (SELECT 1 FROM {p}s2 b JOIN {p}dclosure d ON d.start = b.class_name AND d.class_name = a.class_name WHERE b.abs = FALSE AND b.start = a.start AND b.name = a.name AND b.descriptor = a.descriptor AND b.class_name <> a.class_name) GROUP BY ALL),
{p}s4 AS (SELECT start, name, descriptor, bool_or(out) AS out, bool_or(abs) AS abs, bool_or(NOT abs) AS con FROM {p}s2 GROUP BY ALL),
{p}status AS (SELECT k.start, k.name, k.descriptor, CASE WHEN first IS NOT NULL THEN first WHEN k.name || k.descriptor IN {_OBJ} THEN 'concrete' WHEN out OR (abs AND con) THEN 'unknown' WHEN abs THEN 'abstract_only' WHEN NOT coalesce(con, FALSE) THEN 'absent' WHEN tops > 1 THEN 'conflict' ELSE 'concrete' END AS status
  FROM (SELECT DISTINCT start, name, descriptor FROM {keys}) k LEFT JOIN {p}s1 USING (start, name, descriptor) LEFT JOIN {p}s4 USING (start, name, descriptor) LEFT JOIN {p}s3 USING (start, name, descriptor))"""


_SUBJECT = ", subject AS (SELECT class_name FROM app WHERE access & 1536 = 0)" + closure_sql("new_scope", "subject", "z") + ", ak AS (SELECT start, name, descriptor, min(class_name) AS owner FROM zclosure JOIN (SELECT * FROM na UNION SELECT * FROM nd) USING (class_name) WHERE start <> class_name GROUP BY ALL)"
_STATUS_T = ["old_lib", "new_lib", "old_m", "new_m", "app", "new_scope", "old_scope", "new_all_m", "old_all_m"]


def _asked(t, scope):
    lib = [settle(t(n)) for n in _LIB]
    keys = settle(structural.newly_abstract(*lib).unionByName(structural.newly_default(*lib)).distinct())
    up = closure.supertype_closure(scope, t("app").where("access & 1536 = 0")).where("start <> class_name")
    return up.join(keys, "class_name").groupBy("start", "name", "descriptor").agg(F.min("class_name").alias("owner"))


@query(oracle(_STATUS_T, _ABS + _DEF + _SUBJECT + status_sql("new_scope", "new_all_m", "ak", "n") + " SELECT * FROM nstatus"))
def implementation_status(t):
    # One scope, so that its hierarchy is made once.
    scope = settle(t("new_scope"))
    return structural.implementation_status(scope, t("new_all_m"), _asked(t, scope))


@query(oracle(_STATUS_T, _ABS + _DEF + _SUBJECT + status_sql("new_scope", "new_all_m", "ak", "n") + status_sql("old_scope", "old_all_m", "ak", "o") + " SELECT start AS class_name, name, descriptor, owner, CASE WHEN n.status = 'conflict' THEN 'conflicting default methods' ELSE 'method became abstract' END AS reason FROM ak JOIN nstatus n USING (start, name, descriptor) JOIN ostatus o USING (start, name, descriptor) WHERE n.status IN ('abstract_only', 'conflict') AND o.status IN ('concrete', 'absent')"))
def selection_breaks(t):
    return structural.selection_breaks(t("old_scope"), t("new_scope"), t("old_all_m"), t("new_all_m"), t("app").where("access & 1536 = 0"))


_CALLS = ", calls AS (SELECT DISTINCT owner, name, descriptor FROM refs WHERE kind IN ('method', 'interface_method')), br AS (SELECT DISTINCT class_name, name, descriptor FROM na)"


_ESC = ", esc AS (SELECT start, coalesce(bool_or(s.class_name IS NULL AND NOT starts_with(c.class_name, 'java/')), FALSE) AS other, coalesce(bool_or(s.class_name IS NULL AND starts_with(c.class_name, 'java/')), FALSE) AS platform FROM closure c LEFT JOIN new_scope s USING (class_name) GROUP BY start)"
_RELATED = """, pair AS (SELECT DISTINCT b.class_name, c.owner FROM br b JOIN calls c ON c.name = b.name AND c.descriptor = b.descriptor),
related AS (SELECT p.class_name, p.owner FROM pair p JOIN esc x ON x.start = p.class_name JOIN esc y ON y.start = p.owner
  WHERE x.other OR (x.platform AND starts_with(p.owner, 'java/')) OR y.other OR (y.platform AND starts_with(p.class_name, 'java/'))
  OR EXISTS (SELECT 1 FROM closure z WHERE z.start = p.class_name AND z.class_name = p.owner) OR EXISTS (SELECT 1 FROM closure z WHERE z.start = p.owner AND z.class_name = p.class_name))"""


@query(oracle(["refs", "new_scope", *_LIB], _ABS + _CALLS + ", xs AS (SELECT class_name FROM br UNION SELECT owner FROM calls)" + closure_sql("new_scope", "xs") + _ESC + _RELATED + " SELECT b.class_name, b.name, b.descriptor, EXISTS (SELECT 1 FROM calls c JOIN related r ON r.owner = c.owner WHERE c.name = b.name AND c.descriptor = b.descriptor AND r.class_name = b.class_name) AS invocation_found FROM br b"))
def invocation_evidence(t):
    calls = t("refs").where("kind in ('method', 'interface_method')").select("owner", "name", "descriptor")
    return structural.invocation_evidence(structural.newly_abstract(*[t(n) for n in _LIB]).distinct(), calls, t("new_scope"))


def fits_sql(scope: str, members: str, first: str, second: str, p: str) -> str:
    """-> {p}fits(iface, provider, fits yes/no/unknown)"""
    return (
        prefer_sql(f"{p}e", first, second)
        + closure_sql(f"{p}e", "prov", p)
        + f""", {p}sub AS (SELECT iface, provider, CASE WHEN iface = 'java/lang/Object' OR bool_or(c.class_name = iface) THEN 'yes' WHEN bool_or(e.class_name IS NULL) THEN 'unknown' ELSE 'no' END AS st FROM cand JOIN {p}closure c ON c.start = provider LEFT JOIN {p}e e ON e.class_name = c.class_name GROUP BY iface, provider),
{p}fits AS (SELECT iface, provider, CASE WHEN s.class_name IS NULL THEN CASE WHEN g.class_name IS NOT NULL THEN 'unknown' ELSE 'no' END WHEN s.access & 1 = 0 OR s.access & 1536 <> 0 THEN 'no' WHEN m.class_name IS NULL THEN 'no' ELSE st END AS fits
  FROM cand LEFT JOIN {scope} s ON s.class_name = provider LEFT JOIN graph g ON g.class_name = provider LEFT JOIN (SELECT DISTINCT class_name FROM {members} WHERE mkind = 'method' AND name = '<init>' AND descriptor = '()V' AND access & 1 <> 0) m ON m.class_name = provider LEFT JOIN {p}sub USING (iface, provider))"""
    )


_CAND = ", cand AS (SELECT iface, provider, arg_min(source, ord) AS source FROM services GROUP BY ALL), prov AS (SELECT DISTINCT provider AS class_name FROM cand)"


@query(oracle(["services", "old_lib", "new_lib", "graph", "old_m", "new_m"], _CAND + fits_sql("old_lib", "old_m", "old_lib", "graph", "o") + fits_sql("new_lib", "new_m", "graph", "new_lib", "n") + " SELECT o.iface, o.provider, o.fits AS old_fits, n.fits AS new_fits FROM ofits o JOIN nfits n USING (iface, provider)"))
def provider_status(t):
    listed = structural.still_listed(t("services"), t("services")).select("iface", "provider")
    old = structural.instantiable(listed, t("old_lib"), t("old_m"), t("graph"), True).withColumnRenamed("fits", "old_fits")
    return structural.instantiable(old, t("new_lib"), t("new_m"), t("graph"), False).withColumnRenamed("fits", "new_fits")


@query(oracle(["services", "old_scope", "new_scope", "old_all_m", "new_all_m", "graph"], _CAND + fits_sql("old_scope", "old_all_m", "old_scope", "graph", "o") + fits_sql("new_scope", "new_all_m", "graph", "new_scope", "n") + " SELECT iface, provider, cand.source, CASE WHEN s.class_name IS NULL THEN 'service provider removed' ELSE 'service provider not instantiable' END AS reason FROM cand JOIN ofits o USING (iface, provider) JOIN nfits n USING (iface, provider) LEFT JOIN new_scope s ON s.class_name = provider WHERE o.fits = 'yes' AND n.fits = 'no'"))
def spi_breaks(t):
    services, old, new, graph = (settle(t(n)) for n in ("services", "old_scope", "new_scope", "graph"))
    return structural.spi_breaks(services, services, old, new, t("old_all_m"), t("new_all_m"), graph)


# --- verdicts ---

_V = ["refs", "old_scope", "new_scope", "old_all_m", "new_all_m", "graph"]
_VERDICT = (
    _MK.replace("asked", "am")
    + _FK.replace("asked", "af")
    + method_sql("old_scope", "old_all_m", "am", "om")
    + method_sql("new_scope", "new_all_m", "am", "nm")
    + field_sql("old_scope", "old_all_m", "af", "of_")
    + field_sql("new_scope", "new_all_m", "af", "nf_")
    + ", res_o AS (SELECT *, FALSE AS isf FROM ommethod UNION ALL SELECT *, TRUE FROM of_field), res_n AS (SELECT *, FALSE AS isf FROM nmmethod UNION ALL SELECT *, TRUE FROM nf_field)"
    + ", hosts AS (SELECT class_name, CASE WHEN g.class_name IS NOT NULL THEN coalesce(g.nest_host, class_name) ELSE coalesce(s.nest_host, class_name) END AS host FROM new_scope s LEFT JOIN graph g USING (class_name)), rc AS (SELECT DISTINCT source_class AS class_name FROM refs)"
    + chain_sql("new_scope", "rc", "sc")
    + f""", j AS (SELECT r.*, co.access AS oc, cl.access AS nc, g.class_name IS NOT NULL AS in_graph, o.status AS os, o.access AS oa, n.status AS ns, n.at AS nat, n.access AS na,
  CASE WHEN r.name IS NULL THEN cl.access ELSE n.access END AS used, CASE WHEN r.name IS NULL THEN r.owner ELSE n.at END AS holder
  FROM refs r LEFT JOIN old_scope co ON co.class_name = r.owner LEFT JOIN new_scope cl ON cl.class_name = r.owner LEFT JOIN graph g ON g.class_name = r.owner
  LEFT JOIN res_o o ON o.owner = r.owner AND o.name = r.name AND o.descriptor = r.descriptor AND o.isf = (r.kind = 'field') LEFT JOIN res_n n ON n.owner = r.owner AND n.name = r.name AND n.descriptor = r.descriptor AND n.isf = (r.kind = 'field')),
sub AS (SELECT sub, sup, CASE WHEN bool_or(class_name = sup) THEN 'yes' WHEN bool_or(NOT here) THEN 'unknown' ELSE 'no' END AS st FROM (SELECT DISTINCT source_class AS sub, holder AS sup FROM j WHERE holder IS NOT NULL) JOIN scchain ON start = sub GROUP BY ALL),
a AS (SELECT j.*, CASE WHEN used IS NULL THEN NULL WHEN {vis('used')} = 3 THEN 'yes' WHEN {vis('used')} = 0 THEN CASE WHEN source_class = holder OR coalesce(h1.host, source_class) = coalesce(h2.host, holder) THEN 'yes' ELSE 'no' END
  WHEN regexp_extract(source_class, '^(.*)/', 1) = regexp_extract(holder, '^(.*)/', 1) THEN 'yes' WHEN {vis('used')} = 1 THEN 'no' ELSE coalesce(st, 'unknown') END AS can
  FROM j LEFT JOIN hosts h1 ON h1.class_name = source_class LEFT JOIN hosts h2 ON h2.class_name = holder LEFT JOIN sub ON sub = source_class AND sup = holder),
d AS (SELECT a.*, CASE WHEN kind = 'field' THEN 'field' ELSE 'method' END AS mk FROM a),
v AS (SELECT *, CASE WHEN nc IS NULL AND NOT in_graph THEN 'class removed'
  WHEN coalesce(instantiated, FALSE) AND nc & 1536 <> 0 THEN CASE WHEN oc IS NULL THEN '?' WHEN oc & 1536 = 0 THEN 'class became abstract' ELSE '' END
  WHEN name IS NULL AND nc IS NOT NULL AND can <> 'yes' THEN CASE WHEN can = 'unknown' OR oc IS NULL THEN '?' WHEN {vis('oc')} > {vis('nc')} THEN 'class access narrowed' ELSE '' END
  WHEN name IS NULL THEN ''
  WHEN kind <> 'field' AND nc IS NOT NULL AND (kind = 'interface_method') <> (nc & 512 <> 0) AND oc IS NULL THEN '?'
  WHEN kind <> 'field' AND nc IS NOT NULL AND (kind = 'interface_method') <> (nc & 512 <> 0) AND (kind = 'interface_method') = (oc & 512 <> 0) THEN CASE WHEN kind = 'interface_method' THEN 'interface became class' ELSE 'class became interface' END
  WHEN ns = 'found' AND expected_static IS NOT NULL AND (na & 8 <> 0) <> expected_static THEN CASE WHEN os = 'found' AND (oa & 8 <> 0) = expected_static THEN mk || CASE WHEN na & 8 <> 0 THEN ' became static' ELSE ' became instance' END WHEN os = 'unknown' THEN '?' ELSE '' END
  WHEN ns = 'found' AND can = 'unknown' THEN '?'
  WHEN ns = 'found' AND can = 'no' THEN CASE WHEN os = 'found' AND {vis('oa')} > {vis('na')} THEN mk || ' access narrowed' WHEN os = 'unknown' THEN '?' ELSE '' END
  WHEN ns = 'found' AND coalesce(field_write, FALSE) AND na & 16 <> 0 AND source_class <> nat THEN CASE WHEN os = 'found' AND oa & 16 = 0 THEN 'field became final' WHEN os = 'unknown' THEN '?' ELSE '' END
  WHEN ns = 'found' THEN '' WHEN ns = 'unknown' THEN '?'
  ELSE CASE WHEN os = 'found' THEN mk || ' removed' WHEN os = 'unknown' THEN '?' ELSE '' END END AS x FROM d)"""
)
_REF_COLS = "source, source_class, kind, owner, name, descriptor, expected_static, field_write, instantiated"


def _verdicts(t):
    # The scopes are asked for many times, and made of all of lineitem.
    return verdict.verdicts(t("refs"), settle(t("old_scope")), settle(t("new_scope")), t("old_all_m"), t("new_all_m"), settle(t("graph")))


@query(oracle(_V, _VERDICT + f" SELECT {_REF_COLS}, CASE WHEN x = '' THEN 'ok' WHEN x = '?' THEN 'unknown' ELSE 'broken' END AS verdict, CASE WHEN x NOT IN ('', '?') THEN x END AS reason FROM v"))
def verdict_all(t):
    return _verdicts(t)


@query(oracle(_V, _VERDICT + " SELECT CASE WHEN x = '' THEN 'ok' WHEN x = '?' THEN 'unknown' ELSE 'broken' END AS verdict, count(*) AS n FROM v GROUP BY 1"))
def verdict_counters(t):
    return verdict.counters(_verdicts(t))


_BROKEN = _VERDICT + ", viol AS (SELECT source, source_class, CASE WHEN x = 'class removed' THEN 'class' ELSE kind END AS kind, owner, CASE WHEN x <> 'class removed' THEN name END AS name, CASE WHEN x <> 'class removed' THEN descriptor END AS descriptor, CASE WHEN x <> 'class removed' THEN expected_static END AS expected_static, CASE WHEN x <> 'class removed' THEN field_write END AS field_write, CASE WHEN x <> 'class removed' THEN instantiated END AS instantiated, x AS reason FROM v WHERE x NOT IN ('', '?')), dd AS (SELECT DISTINCT * FROM viol)"


def _violations(t):
    broken = verdict.collapsed(_verdicts(t).where("verdict = 'broken'").drop("verdict"))
    return policy.dedup(broken.withColumn("pass_ord", F.lit(0)), ["reason"]).drop("pass_ord")


@query(oracle(_V, _BROKEN + " SELECT * FROM dd"))
def violation_dedup(t):
    return _violations(t)


@query(oracle(_V, _BROKEN + " SELECT kind, owner, name, descriptor, reason, count(*) AS records, array_to_string(list_sort(list(DISTINCT source_class)), ',') AS users FROM dd GROUP BY ALL"))
def broken_symbol_groups(t):
    return policy.symbol_groups(_violations(t)).withColumn("users", F.array_join("users", ","))


_RULES = [(0, "p1/*", None, None, None), (1, "p2/C2", "m1", None, None), (2, None, None, None, "field removed"), (3, "q/none", None, None, None), (4, "p3/*", "m2", "()V", None)]
_RULES_SQL = ", rules(rule_id, r_owner, r_member, r_descriptor, r_kind) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in _RULES) + ")"
_HIT = "(r_owner IS NULL OR d.owner = r_owner OR (r_owner LIKE '%*' AND starts_with(d.owner, r_owner[1:-2]))) AND (r_member IS NULL OR d.name = r_member) AND (r_descriptor IS NULL OR d.descriptor = r_descriptor) AND (r_kind IS NULL OR d.reason = r_kind)"


def _rules(t):
    return t("roots").sparkSession.createDataFrame(_RULES, "rule_id int, owner string, member string, descriptor string, kind string")


@query(oracle(_V, _BROKEN + _RULES_SQL + f" SELECT d.* FROM dd d WHERE NOT EXISTS (SELECT 1 FROM rules WHERE coalesce({_HIT}, FALSE))"))
def exclude_filter(t):
    return policy.exclude(_violations(t), _rules(t))


@query(oracle(_V, _BROKEN + _RULES_SQL + f" SELECT rule_id FROM rules WHERE NOT EXISTS (SELECT 1 FROM dd d WHERE coalesce({_HIT}, FALSE))"))
def exclude_unused(t):
    return policy.unused_rules(_violations(t), _rules(t)).select("rule_id")


# --- reachability, tiers, gate ---

_REACH = ", redges AS (SELECT class_name AS src, unnest(list_append(interfaces, super_name)) AS dst FROM graph UNION SELECT src, dst FROM load_edges UNION SELECT iface, provider FROM services), reach(class_name) AS (SELECT class_name FROM graph SEMI JOIN roots USING (source) UNION SELECT provider FROM services WHERE iface NOT IN (SELECT class_name FROM graph) UNION SELECT dst FROM reach JOIN redges ON class_name = src)"
_R = ["graph", "load_edges", "services", "roots"]


def _reach(t):
    return policy.reach(t("graph"), t("load_edges"), t("services"), t("roots"))


@query(oracle(_R, _REACH + " SELECT class_name FROM reach"))
def reachable_classes(t):
    return _reach(t)


_LABELS = ", spi AS (SELECT iface AS owner, provider AS source_class, 'service provider removed' AS reason FROM services UNION ALL SELECT 'java/spi/none', 'app/A' || n_nationkey * 50, 'service provider removed' FROM nation UNION ALL SELECT 'x/Y' || substr(class_name, 1, length(class_name) - 1), class_name, 'method removed' FROM graph), lab AS (SELECT owner, source_class, reason, CASE WHEN r.class_name IS NOT NULL THEN TRUE WHEN reason LIKE 'service provider%' AND s.iface IS NULL THEN NULL ELSE FALSE END AS reachable FROM spi LEFT JOIN (SELECT DISTINCT class_name FROM reach) r ON r.class_name = source_class LEFT JOIN (SELECT DISTINCT iface, provider FROM services) s ON s.iface = owner AND s.provider = source_class)"


def _labels(t):
    reason = F.lit("service provider removed").alias("reason")
    n = t("services").sparkSession.table("nation").select(F.lit("java/spi/none").alias("owner"), F.concat(F.lit("app/A"), (F.col("n_nationkey") * 50).cast("string")).alias("source_class"), reason)
    rows = t("services").select(F.col("iface").alias("owner"), F.col("provider").alias("source_class"), reason).union(n).union(t("graph").select(F.expr("'x/Y' || substr(class_name, 1, length(class_name) - 1)").alias("owner"), F.col("class_name").alias("source_class"), F.lit("method removed").alias("reason")))
    return policy.label(rows, _reach(t), t("services")).select("owner", "source_class", "reason", "reachable")


@query(oracle(_R, _REACH + _LABELS + " SELECT * FROM lab"))
def reach_labels(t):
    return _labels(t)


_TIERS = ", tiered AS (SELECT *, CASE WHEN reachable = FALSE AND length(source_class) % 3 <> 0 THEN 'unproven' WHEN length(source_class) % 2 = 0 THEN 'latent' ELSE 'breaks' END AS tier FROM lab)"


def _tiered(t):
    n = F.length("source_class")
    rows = _labels(t).withColumn("observed_loading", n % 3 == 0).withColumn("invocation_found", n % 2 != 0)
    return rows.withColumn("tier", policy.tier())


@query(oracle(_R, _REACH + _LABELS + _TIERS + " SELECT tier, count(*) AS n FROM tiered GROUP BY tier"))
def tiers(t):
    return _tiered(t).groupBy("tier").agg(F.count("*").alias("n"))


@query(oracle(_R, _REACH + _LABELS + _TIERS + " SELECT policy, CASE policy WHEN 'never' THEN FALSE WHEN 'reachable' THEN (SELECT count(*) FROM tiered WHERE tier = 'breaks') > 0 ELSE (SELECT count(*) FROM tiered) > 0 END AS fails FROM (VALUES ('never'), ('reachable'), ('any')) p(policy)"))
def gate_counts(t):
    return policy.gate(_tiered(t))


@query(oracle(_R, _REACH + _LABELS + _TIERS + ", sym AS (SELECT owner, reason AS name, 'd' AS descriptor, bool_and(tier = 'unproven') AS ok, list_sort(list(DISTINCT source_class)) AS users FROM tiered GROUP BY ALL) SELECT owner, name, descriptor, array_to_string(users[1:3], ',') AS users, CAST(greatest(len(users) - 3, 0) AS INTEGER) AS more FROM sym WHERE ok"))
def draft_rules(t):
    return evidence.draft_rules(_tiered(t).withColumn("name", F.col("reason")).withColumn("descriptor", F.lit("d"))).withColumn("users", F.array_join("users", ","))


@query(oracle(["refs", "graph"], ", rec AS (SELECT class_name, CASE WHEN length(class_name) % 2 = 0 THEN 'T' || class_name END AS trigger FROM graph WHERE length(super_name) % 2 = 0) SELECT source_class, owner, r.class_name IS NOT NULL AS observed_loading, trigger AS load_trigger FROM (SELECT DISTINCT source_class, owner FROM refs) LEFT JOIN rec r ON r.class_name = source_class"))
def evidence_promotion(t):
    rec = t("graph").where("length(super_name) % 2 = 0").select("class_name", F.when(F.length("class_name") % 2 == 0, F.concat(F.lit("T"), "class_name")).alias("trigger"))
    return evidence.promote(t("refs").select("source_class", "owner").distinct(), rec)


@query(oracle(_R, _REACH + _LABELS + _TIERS + " SELECT tier, count(*) AS n, count(*) FILTER (length(source_class) % 3 = 0) AS observed FROM tiered GROUP BY tier"))
def tier_counts(t):
    return policy.tier_counts(_tiered(t))


@query(oracle(["graph", "old_lib", "new_lib"], f", f AS (SELECT class_name AS super_name FROM {_BOTH} WHERE o.access & 16 = 0 AND n.access & 16 <> 0), k AS (SELECT class_name AS super_name, n.access & 512 <> 0 AS face FROM {_BOTH} WHERE o.access & 512 <> n.access & 512), e AS (SELECT class_name, source, 'class became final' AS reason FROM graph JOIN f USING (super_name) UNION ALL SELECT class_name, source, 'class became interface' FROM graph JOIN k USING (super_name) WHERE face) SELECT class_name AS source_class, source, count(*) AS records, array_to_string(list_sort(list(DISTINCT reason)), ',') AS reasons FROM e GROUP BY ALL"))
def structural_groups(t):
    source = t("graph").select("class_name", "source")
    final = structural.extends_newly_final(t("graph"), t("old_lib"), t("new_lib")).select("class_name", F.lit("class became final").alias("reason"))
    flip = structural.edge_kind_flip(t("graph"), t("old_lib"), t("new_lib")).where("reason = 'class became interface'").select("class_name", "reason")
    rows = final.unionByName(flip).join(source, "class_name").withColumnRenamed("class_name", "source_class")
    return policy.structural_groups(rows).withColumn("reasons", F.array_join("reasons", ","))


# Descriptors of every shape, from the rows of part; the other engine spells the same types out.
_TYPES = [("I", "int"), ("[J", "long[]"), ("Ljava/util/List;", "List"), ("[[Lq/Deep$In;", "Deep$In[][]"), ("Z", "boolean")]


def _pick(i: str, which: int) -> str:
    return f"CASE ({i}) % 5 " + " ".join(f"WHEN {n} THEN '{t[which]}'" for n, t in enumerate(_TYPES)) + " END"


def _symbols(which: str) -> str:
    raw = "'(' || {a} || {b} || ')V'" if which == "raw" else "'(' || {a} || ', ' || {b} || ')'"
    k = 0 if which == "raw" else 1
    return raw.replace("{a}", _pick("p_partkey", k)).replace("{b}", _pick("p_partkey + p_size", k))


@query("SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'p.C' || p_partkey || ' constructor ' || " + _symbols("shown") + " WHEN 1 THEN 'p.C' || p_partkey || '.m' || " + _symbols("shown") + " WHEN 2 THEN 'p.C' || p_partkey || '.f: ' || " + _pick("p_partkey", 1) + " ELSE 'p.C' || p_partkey || '.f broken' END AS shown FROM part")
def pretty_names(t):
    spark = t("roots").sparkSession
    rows = spark.sql("SELECT p_partkey AS id, 'p/C' || p_partkey AS owner, CASE p_size % 4 WHEN 0 THEN '<init>' WHEN 1 THEN 'm' ELSE 'f' END AS name, CASE WHEN p_size % 4 < 2 THEN " + _symbols("raw") + " WHEN p_size % 4 = 2 THEN " + _pick("p_partkey", 0) + " ELSE 'broken' END AS descriptor FROM part")
    return rows.select("id", pretty_member().alias("shown"))


@query("SELECT 'p.C' || p_size || '.m(List)' AS shown, 'r' AS reason, count(DISTINCT p_brand) AS symbols FROM part GROUP BY p_size HAVING count(DISTINCT p_brand) > 1")
def name_collisions(t):
    rows = t("roots").sparkSession.sql("SELECT 'p/C' || p_size AS owner, 'm' AS name, '(L' || translate(p_brand, '#', '_') || '/List;)V' AS descriptor, 'r' AS reason FROM part")
    return policy.name_collisions(rows)


@query(oracle(["refs"], ", runs AS (SELECT source, source_class, kind, owner, name, descriptor, expected_static, field_write, instantiated, 'r' AS reason, CASE length(owner) % 3 WHEN 0 THEN TRUE WHEN 1 THEN NULL ELSE FALSE END AS reachable, length(source) % 2 = 0 AS invocation_found, source AS module FROM refs) SELECT source, source_class, kind, owner, name, descriptor, expected_static, field_write, instantiated, reason, bool_or(invocation_found) AS invocation_found, array_to_string(list_sort(list(DISTINCT module)), ',') AS modules, CASE max(CASE WHEN reachable THEN 2 WHEN reachable IS NULL THEN 1 ELSE 0 END) WHEN 2 THEN TRUE WHEN 0 THEN FALSE END AS reachable FROM runs GROUP BY source, source_class, kind, owner, name, descriptor, expected_static, field_write, instantiated, reason"))
def run_merge(t):
    n = F.length("owner") % 3
    runs = t("refs").withColumn("reason", F.lit("r")).withColumn("reachable", F.when(n == 0, True).when(n == 2, False)).withColumn("invocation_found", F.length("source") % 2 == 0).withColumn("module", F.col("source"))
    return policy.merge_runs(runs).withColumn("modules", F.array_join("modules", ","))


@query(oracle(["refs"], ", m AS (SELECT DISTINCT source, source_class, kind, owner, name, descriptor, expected_static, field_write, instantiated FROM refs) SELECT CAST(CAST(substr(source, 4) AS INTEGER) % 5 AS INTEGER) AS run_id, count(*) AS broken FROM m GROUP BY 1 UNION ALL SELECT 99, 0"))
def run_counts(t):
    rows = t("refs").withColumn("reason", F.lit("r")).withColumn("reachable", F.lit(True)).withColumn("invocation_found", F.lit(True)).withColumn("module", F.col("source"))
    runs = [(r, [f"jar{r + 5 * k}" for k in range(4)]) for r in range(5)] + [(99, ["jar99"])]
    return policy.run_counts(policy.merge_runs(rows), rows.sparkSession.createDataFrame(runs, "run_id int, modules array<string>"))


@query(oracle(_V, _BROKEN + " SELECT *, CAST(row_number() OVER (ORDER BY source, source_class, owner, name NULLS FIRST, descriptor NULLS FIRST, reason, kind, expected_static NULLS FIRST, field_write NULLS FIRST, instantiated NULLS FIRST) AS BIGINT) AS rank FROM dd"))
def canonical_order(t):
    more = [F.asc("kind"), F.asc_nulls_first("expected_static"), F.asc_nulls_first("field_write"), F.asc_nulls_first("instantiated")]
    return policy.ranked(_violations(t), [*policy.canonical_order(None), *more])


# --- upgrade planning ---

_A = ["artifacts_before", "artifacts_after"]
_OWN = ', own AS (SELECT DISTINCT "group", name FROM (SELECT * FROM artifacts_before UNION ALL SELECT * FROM artifacts_after) WHERE project IS NOT NULL), vb AS (SELECT "group", name, list_sort(list(DISTINCT version)) AS b FROM artifacts_before ANTI JOIN own USING ("group", name) GROUP BY ALL), va AS (SELECT "group", name, list_sort(list(DISTINCT version)) AS a FROM artifacts_after ANTI JOIN own USING ("group", name) GROUP BY ALL), ch AS (SELECT "group", name, b, a, CASE WHEN b IS NULL THEN \'added\' WHEN a IS NULL THEN \'removed\' WHEN a <> b THEN \'changed\' END AS kind FROM vb FULL JOIN va USING ("group", name))'


@query(oracle(_A, _OWN + " SELECT \"group\", name, kind, coalesce(array_to_string(b, ','), '') AS \"before\", coalesce(array_to_string(a, ','), '') AS \"after\" FROM ch WHERE kind IS NOT NULL"))
def dependency_diff(t):
    return upgrade.dependency_diff(t("artifacts_before"), t("artifacts_after")).withColumn("before", F.array_join("before", ",")).withColumn("after", F.array_join("after", ","))


@query(oracle(_A, ' SELECT DISTINCT b.module, b."group", b.name, b.version FROM artifacts_before b WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM artifacts_before UNION ALL SELECT * FROM artifacts_after) x WHERE x.project IS NOT NULL AND x."group" = b."group" AND x.name = b.name)'))
def project_exclusion(t):
    return upgrade.without_projects(t("artifacts_before"), t("artifacts_after"))[0].select("module", "group", "name", "version").distinct()


@query(oracle(_A, _OWN + ' SELECT \'old\' AS side, "group", name, version, file FROM (SELECT "group", name, unnest(list_filter(b, lambda x: NOT list_contains(coalesce(a, []), x))) AS version FROM ch WHERE kind IN (\'changed\', \'removed\')) JOIN (SELECT DISTINCT "group", name, version, file FROM artifacts_before) USING ("group", name, version) UNION ALL SELECT \'new\', "group", name, version, file FROM (SELECT "group", name, unnest(list_filter(a, lambda x: NOT list_contains(b, x))) AS version FROM ch WHERE kind = \'changed\') JOIN (SELECT DISTINCT "group", name, version, file FROM artifacts_after) USING ("group", name, version)'))
def changed_jars(t):
    before, after = t("artifacts_before"), t("artifacts_after")
    return upgrade.jars(upgrade.dependency_diff(before, after), before, after)


_MODULES = """, own AS (SELECT DISTINCT "group", name FROM (SELECT * FROM artifacts_before UNION ALL SELECT * FROM artifacts_after) WHERE project IS NOT NULL),
b0 AS (SELECT * FROM artifacts_before ANTI JOIN own USING ("group", name)), a0 AS (SELECT * FROM artifacts_after ANTI JOIN own USING ("group", name)),
was AS (SELECT module, "group", name, version, min(file) AS file FROM b0 WHERE module IN (SELECT module FROM artifacts_after) GROUP BY ALL
  UNION ALL SELECT m.module, m."group", m.name, x.version, x.file FROM (SELECT DISTINCT module, "group", name FROM a0 WHERE module NOT IN (SELECT module FROM artifacts_before)) m JOIN (SELECT "group", name, version, min(file) AS file FROM b0 GROUP BY ALL) x USING ("group", name)),
now AS (SELECT module, "group", name, version, min(file) AS file FROM a0 GROUP BY ALL),
moves AS (SELECT module, 'old' AS side, "group", name, version, file FROM was ANTI JOIN now USING (module, "group", name, version)
  UNION ALL SELECT module, 'new', "group", name, version, file FROM now SEMI JOIN was USING (module, "group", name) ANTI JOIN was USING (module, "group", name, version))"""


@query(oracle(_A, _MODULES + " SELECT * FROM moves"))
def module_moves(t):
    return upgrade.module_moves(t("artifacts_before"), t("artifacts_after"))


@query(oracle(_A, _MODULES + """, mods AS (SELECT DISTINCT module FROM artifacts_after UNION SELECT DISTINCT module FROM artifacts_before), st AS (SELECT module, CASE WHEN module IN (SELECT module FROM artifacts_before) AND module NOT IN (SELECT module FROM artifacts_after) THEN 'incomplete' WHEN module IN (SELECT module FROM moves WHERE side = 'old') THEN 'run' WHEN module NOT IN (SELECT module FROM artifacts_before) THEN 'new' ELSE 'unchanged' END AS status FROM mods),
f AS (SELECT module, list(file ORDER BY "group", name, version, file) FILTER (side = 'old') AS o, list(file ORDER BY "group", name, version, file) FILTER (side = 'new') AS n FROM moves GROUP BY module)
SELECT module, status, CASE WHEN status = 'run' THEN coalesce(array_to_string(o, ','), '') ELSE '' END AS old, CASE WHEN status = 'run' THEN coalesce(array_to_string(n, ','), '') ELSE '' END AS new FROM st LEFT JOIN f USING (module)"""))
def module_plan(t):
    before, after = t("artifacts_before"), t("artifacts_after")
    out = upgrade.module_plan(after.select("module").union(before.select("module")), before, after)
    return out.select("module", "status", F.array_join("old", ",").alias("old"), F.array_join("new", ",").alias("new"))


_ADVICE = _OWN + """, o AS (SELECT *, CAST(row_number() OVER (ORDER BY "group", name) - 1 AS INTEGER) AS change_ord FROM ch WHERE kind IS NOT NULL),
files AS (SELECT file, "group" AS fg, "group" || ':' || name AS fc, "group" || ':' || name || ':' || version AS used FROM (SELECT *, 0 AS z FROM artifacts_before UNION ALL SELECT *, 1 FROM artifacts_after) QUALIFY row_number() OVER (PARTITION BY file ORDER BY z, "group", name, version) = 1),
v AS (SELECT 'c' || a.change_ord AS owner, a.change_ord, f.file AS source, CASE WHEN a.change_ord % 3 = 0 THEN 'service provider removed' ELSE 'method removed' END AS reason FROM (SELECT change_ord FROM o UNION ALL SELECT 1000000) a JOIN files f ON length(f.file) % 2 = a.change_ord % 2),
w AS (SELECT v.owner, v.source, v.reason, o."group" AS g, o."group" || ':' || o.name AS c, fg, fc, used, coalesce(b, []) AS b, coalesce(a, []) AS a, list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x)) AS bx, list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x)) AS ax, contains(v.source, '1') AS opt FROM v LEFT JOIN o ON o.change_ord = v.change_ord JOIN files ON file = v.source),
z AS (SELECT *, c IS NOT NULL AND NOT (starts_with(reason, 'service provider') AND fc = c) AS known, 'use a release of ' || used || ' that is built for ' || c || ' ' || array_to_string(CASE WHEN len(ax) > 0 THEN ax ELSE a END, ',') || ', or keep ' || c || ' at ' || CASE WHEN len(b) = 0 THEN '-' ELSE array_to_string(CASE WHEN len(bx) > 0 THEN bx ELSE b END, ',') END AS either FROM w)
SELECT owner, source, reason, CASE WHEN known THEN used END AS referenced_by, CASE WHEN known THEN c END AS removed_by, CASE WHEN known THEN CASE WHEN len(b) = 0 THEN '-' ELSE array_to_string(b, ',') END END AS "before", CASE WHEN known THEN CASE WHEN len(a) = 0 THEN '-' ELSE array_to_string(a, ',') END END AS "after",
CASE WHEN known THEN CASE WHEN len(a) = 0 AND opt THEN c || ' is gone; ' || used || ' declares it optional, so only its optional feature is affected: add ' || c || ' back to use that feature'
  WHEN len(a) = 0 THEN c || ' is gone but ' || used || ' needs it: use a release of ' || used || ' without it, or add ' || c || ' back'
  WHEN fg = g THEN 'give all artifacts of ' || g || ' the same version; or ' || either ELSE either END END AS advice FROM z"""


def _advised(t):
    before, after = t("artifacts_before"), t("artifacts_after")
    from pyspark.sql import Window

    changes = upgrade.dependency_diff(before, after).withColumn("change_ord", F.row_number().over(Window.orderBy("group", "name")) - 1)
    files = upgrade.coordinates(before, after)
    ords = changes.select("change_ord").unionByName(changes.sparkSession.createDataFrame([(1_000_000,)], "change_ord int"))
    rows = ords.join(files.select(F.col("file").alias("source")), F.length("source") % 2 == F.col("change_ord") % 2)
    rows = rows.select(F.concat(F.lit("c"), F.col("change_ord").cast("string")).alias("owner"), "source", F.when(F.col("change_ord") % 3 == 0, "service provider removed").otherwise("method removed").alias("reason"))
    owners = changes.select(F.concat(F.lit("c"), F.col("change_ord").cast("string")).alias("class_name"), "change_ord")
    optional = changes.where("size(after) = 0").select("group", "name").join(files.where("contains(file, '1')").select(F.col("file").alias("source")), F.lit(True))
    return upgrade.suggestions(rows, owners, changes, files, optional)


@query(oracle(_A, _ADVICE))
def suggestions(t):
    return _advised(t)


_ADV = _ADVICE.replace("\nSELECT owner, source", ", adv AS (SELECT owner, source") + ")"


@query(oracle(_A, _ADV + " SELECT referenced_by, removed_by, \"before\", \"after\", advice, count(*) AS records, array_to_string(list_sort(list(DISTINCT owner)), ',') AS symbols, count(DISTINCT source) AS classes FROM adv WHERE advice IS NOT NULL GROUP BY ALL"))
def fix_groups(t):
    rows = _advised(t).withColumn("name", F.lit(None).cast("string")).withColumn("descriptor", F.lit(None).cast("string")).withColumn("source_class", F.col("source"))
    return policy.fix_groups(rows).withColumn("symbols", F.array_join("symbols", ","))


@query(oracle(["graph"], ", cl AS (SELECT class_name, 'f' || (length(class_name) + length(super_name)) % 7 AS file FROM graph), c(change_ord, file) AS (VALUES (0, 'f3'), (1, 'f5'), (2, 'f3'), (3, 'f0')) SELECT class_name, min(change_ord) AS change_ord FROM cl JOIN c USING (file) GROUP BY class_name"))
def attribution(t):
    cl = t("graph").select("class_name", F.concat(F.lit("f"), ((F.length("class_name") + F.length("super_name")) % 7).cast("string")).alias("file"))
    return upgrade.attribution(cl, cl.sparkSession.createDataFrame([(0, "f3"), (1, "f5"), (2, "f3"), (3, "f0")], "change_ord int, file string"))


@query(oracle(_A, ' SELECT file, "group", name, version FROM (SELECT *, 0 AS o FROM artifacts_before UNION ALL SELECT *, 1 FROM artifacts_after) QUALIFY row_number() OVER (PARTITION BY file ORDER BY o, "group", name, version) = 1'))
def file_coordinates(t):
    return upgrade.coordinates(t("artifacts_before"), t("artifacts_after"))


# --- class-load logs ---

_LOG_SQL = """WITH l AS (SELECT event_id, event_id % 6 AS k, CAST(user_id AS VARCHAR) AS u, event_type AS e FROM events),
r AS (SELECT 'app/A' || u || '/T' || e AS class_name, CAST(NULL AS VARCHAR) AS trigger, FALSE AS stacked FROM l WHERE k = 0
  UNION ALL SELECT 'app/B' || u, CASE WHEN event_id % 4 < 2 THEN 'java.lang.Class.forName from ' ELSE '' END || 'app.M.' || e || '(M.java:7)', TRUE FROM l WHERE k = 1
  UNION ALL SELECT 'app/D' || u, NULL, FALSE FROM l WHERE k = 3
  UNION ALL SELECT 'N' || u, NULL, FALSE FROM l WHERE k = 4
  UNION ALL SELECT 'app/H' || u, NULL, FALSE FROM l WHERE k = 5),
f AS (SELECT 'app/B' || u AS class_name, arg_min(CASE WHEN event_id % 4 < 2 THEN 'java.lang.Class.forName from ' ELSE '' END || 'app.M.' || e || '(M.java:7)', struct_pack(f := event_id % 16, i := event_id)) AS trigger FROM l WHERE k = 1 GROUP BY 1)
SELECT r.class_name, bool_or(stacked) AS stacked, max(f.trigger) AS trigger FROM r LEFT JOIN f USING (class_name) GROUP BY r.class_name"""


@query(_LOG_SQL)
def log_parse(t):
    """Logs of sixteen files written from events, with lines of every form, then parsed back."""
    spark = t("roots").sparkSession
    lines = spark.sql(r"""
    SELECT event_id, event_id % 16 AS file_ord, CASE event_id % 6
      WHEN 0 THEN concat('[1.0s][info][class,load] app.A', user_id, '.T', event_type, ': source: x')
      WHEN 1 THEN concat('[2s][class,load,cause] Java stack when loading app.B', user_id, ':\n\tat java.lang.ClassLoader.loadClass(C.java:1)\n\t- locked <0x1> (a x.Y)\n[3s][gc,heap] app.Z', user_id, '.Y\n\tat my.Own.findClass(O.java:2)\n',
        if(event_id % 4 < 2, '\tat java.lang.Class.forName(Class.java:3)\n\tat java.lang.reflect.Method.invoke(M.java:4)\n', ''), '\tat app.M.', event_type, '(M.java:7)\n\tat app.Main.main(M.java:9)')
      WHEN 2 THEN concat('[1s][gc,heap] app.C', user_id, '.X')
      WHEN 3 THEN concat('app/D', user_id, ', and more words')
      WHEN 4 THEN concat('[1s][class,load,cause,native] Native stack when loading N', user_id, ':\n[1s][class,load,cause,native] V  [lib.so+0x1]')
      ELSE concat('Java stack when loading app.H', user_id, '\nno.1name 7.5 word') END AS line FROM events""")
    files = lines.groupBy("file_ord").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return evidence.load_records(files)
