"""A deterministic API universe over the driver's business tables, in SQL that both engines read, so that operators can be compared.

The engine itself knows nothing of these tables. {LIST}, {ARR}, {EMPTY} are the only words that differ between the dialects.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DIALECT = {
    "spark": {"LIST": "sort_array(collect_list(n))", "ARR": "array", "EMPTY": "CAST(array() AS ARRAY<STRING>)"},
    "duckdb": {"LIST": "list_sort(list(n))", "ARR": "list_value", "EMPTY": "CAST([] AS VARCHAR[])"},
}


def cn(x: str) -> str:
    return f"('p' || CAST(({x}) % 7 AS STRING) || '/C' || CAST(({x}) AS STRING))"


def _flags(*bits: tuple[str, int]) -> str:
    return "CAST(" + " + ".join(f"CASE WHEN {c} THEN {b} ELSE 0 END" for c, b in bits) + " AS INT)"


HALF = "CAST(floor(id / 2) AS BIGINT)"
_SUPER = f"CASE WHEN id % 7 = 0 OR id = 1 THEN 'java/lang/Object' ELSE {cn(HALF)} END"
_OLD = _flags(("id % 5 <> 0", 1), ("id % 11 = 0", 16), ("id % 13 = 0", 1536), ("id % 6 = 0 AND id % 13 <> 0", 1024), ("id % 43 = 0", 16384))
_NEW = _flags(("id % 5 <> 0 AND id % 19 <> 1", 1), ("id % 11 = 0 OR id % 23 = 2", 16), ("(id % 13 = 0) <> (id % 29 = 4)", 512), ("id % 13 = 0 OR id % 6 = 0 OR id % 31 = 5", 1024), ("id % 43 = 0", 16384))
_MEMBER = "('m' || CAST(l_linenumber AS STRING))"
_METHODS = f"SELECT DISTINCT l_partkey AS id, l_linenumber AS ln, {_MEMBER} AS name, CASE WHEN l_suppkey % 2 = 0 THEN '()V' ELSE '(I)V' END AS descriptor FROM lineitem"
_K = "(id + ln)"
_OLD_M = _flags((f"{_K} % 4 = 1", 1), (f"{_K} % 4 = 0 AND {_K} % 3 <> 0", 4), (f"{_K} % 4 = 2", 2), (f"{_K} % 6 = 5", 8), (f"{_K} % 10 = 1", 1024), (f"{_K} % 9 = 4", 16), (f"{_K} % 37 = 6", 4096))
_NEW_M = _flags((f"{_K} % 4 = 1 AND id % 7 <> 2", 1), (f"{_K} % 4 = 0 AND {_K} % 3 <> 0 AND id % 8 <> 1", 4), (f"{_K} % 4 = 2", 2), (f"{_K} % 6 = 5 OR {_K} % 14 = 3", 8), (f"{_K} % 10 = 1 OR {_K} % 21 = 9", 1024), (f"{_K} % 9 = 4 OR {_K} % 25 = 8", 16), (f"{_K} % 37 = 6", 4096))

CTES = {
    "edges": f"SELECT DISTINCT id, {cn('5 * s')} AS n FROM (SELECT l_partkey AS id, min(l_suppkey) AS s FROM lineitem GROUP BY l_partkey UNION ALL SELECT l_partkey, max(l_suppkey) FROM lineitem GROUP BY l_partkey) x WHERE 5 * s < id",
    "faces": "SELECT id, {LIST} AS interfaces FROM edges GROUP BY id",
    "ids": "SELECT p_partkey AS id FROM part",
    "lib": f"SELECT ids.id, {cn('ids.id')} AS class_name, {{SUPER}} AS super_name, coalesce(interfaces, {{EMPTY}}) AS interfaces, CASE WHEN ids.id % 8 = 3 THEN {cn('ids.id - 1')} END AS nest_host, ids.id % 41 = 0 AS sealing_unknown FROM ids LEFT JOIN faces ON ids.id = faces.id".replace("{SUPER}", _SUPER.replace("id", "ids.id")),
    "old_lib": f"SELECT class_name, 'lib' AS source, {_OLD} AS access, super_name, interfaces, nest_host, CASE WHEN id % 27 = 0 THEN {{ARR}}({cn('2 * id')}, {cn('2 * id + 1')}) END AS permitted, sealing_unknown FROM lib",
    "new_lib": f"SELECT class_name, 'lib' AS source, {_NEW} AS access, super_name, interfaces, nest_host, CASE WHEN id % 9 = 0 THEN {{ARR}}({cn('2 * id')}) END AS permitted, sealing_unknown FROM lib WHERE id % 17 <> 3",
    "methods": _METHODS,
    "fields": "SELECT DISTINCT l_partkey AS id, l_linenumber AS ln, 'f' || CAST(l_linenumber AS STRING) AS name, 'I' AS descriptor FROM lineitem WHERE l_linenumber <= 3",
    "old_m": f"SELECT {cn('id')} AS class_name, 'method' AS mkind, name, descriptor, {_OLD_M} AS access FROM methods WHERE {_K} % 19 <> 7 UNION ALL SELECT {cn('id')}, 'field', name, descriptor, {_OLD_M} FROM fields UNION ALL SELECT {cn('id')}, 'method', '<init>', '()V', 1 FROM ids WHERE id % 3 <> 0",
    "new_m": f"SELECT {cn('id')} AS class_name, 'method' AS mkind, name, descriptor, {_NEW_M} AS access FROM methods WHERE id % 17 <> 3 AND ({_K} % 11 <> 4 OR descriptor = '()V') UNION ALL SELECT {cn('id')}, 'field', name, descriptor, {_NEW_M} FROM fields WHERE id % 17 <> 3 AND {_K} % 13 <> 4 UNION ALL SELECT {cn('id')}, 'method', '<init>', '()V', CASE WHEN id % 10 = 1 THEN 2 ELSE 1 END FROM ids WHERE id % 3 <> 0 AND id % 17 <> 3",
    "graph": f"SELECT 'app/A' || CAST(c_custkey AS STRING) AS class_name, 'jar' || CAST(c_custkey % 20 AS STRING) AS source, {cn('1 + c_custkey % 1999')} AS super_name, CASE WHEN c_custkey % 3 = 0 THEN {{ARR}}({cn('13 * (1 + c_custkey % 15)')}) ELSE {{EMPTY}} END AS interfaces, CASE WHEN c_custkey % 50 = 7 THEN {cn('c_custkey')} END AS nest_host FROM customer",
    "app": "SELECT class_name, source, CAST(CASE WHEN length(class_name) % 4 = 0 THEN 1025 ELSE 1 END AS INT) AS access, super_name, interfaces, nest_host, NULL AS permitted, FALSE AS sealing_unknown FROM graph",
    "app_m": f"SELECT 'app/A' || CAST(c_custkey AS STRING) AS class_name, 'method' AS mkind, 'm' || CAST(1 + c_custkey % 4 AS STRING) AS name, '()V' AS descriptor, CAST(1 AS INT) AS access FROM customer",
    "old_scope": "SELECT class_name, source, access, super_name, interfaces, nest_host FROM old_lib UNION ALL SELECT class_name, source, access, super_name, interfaces, nest_host FROM app",
    "new_scope": "SELECT class_name, source, access, super_name, interfaces, nest_host FROM new_lib UNION ALL SELECT class_name, source, access, super_name, interfaces, nest_host FROM app",
    "old_all_m": "SELECT * FROM old_m UNION ALL SELECT * FROM app_m",
    "new_all_m": "SELECT * FROM new_m UNION ALL SELECT * FROM app_m",
    "refs": f"SELECT 'jar' || CAST(o_custkey % 20 AS STRING) AS source, 'app/A' || CAST(o_custkey AS STRING) AS source_class, CASE WHEN l_linenumber % 4 = 0 THEN 'class' WHEN l_linenumber % 4 = 1 THEN 'field' WHEN l_suppkey % 3 = 0 THEN 'interface_method' ELSE 'method' END AS kind, {cn('l_partkey')} AS owner, CASE WHEN l_linenumber % 4 = 0 THEN NULL WHEN l_linenumber % 4 = 1 THEN 'f' || CAST(1 + l_orderkey % 3 AS STRING) ELSE 'm' || CAST(1 + l_orderkey % 7 AS STRING) END AS name, CASE WHEN l_linenumber % 4 = 0 THEN NULL WHEN l_linenumber % 4 = 1 THEN 'I' WHEN l_suppkey % 2 = 0 THEN '()V' ELSE '(I)V' END AS descriptor, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_returnflag = 'R' END AS expected_static, CASE WHEN l_linenumber % 4 = 1 THEN l_linestatus = 'F' END AS field_write, CASE WHEN l_linenumber % 4 = 0 AND l_returnflag = 'A' THEN TRUE END AS instantiated FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "load_edges": "SELECT DISTINCT 'app/A' || CAST(o_custkey AS STRING) AS src, 'app/A' || CAST(CAST(floor(o_custkey / 3) AS BIGINT) + o_orderkey % 5 AS STRING) AS dst FROM orders",
    "roots": "SELECT DISTINCT 'jar' || CAST(c_custkey % 20 AS STRING) AS source FROM customer WHERE c_custkey % 20 < 3",
    "services": f"SELECT CASE WHEN n_nationkey % 2 = 0 THEN {cn('13 * (1 + n_nationkey)')} WHEN n_nationkey % 5 = 1 THEN 'java/lang/Object' ELSE 'java/spi/S' || CAST(n_regionkey AS STRING) END AS iface, CASE WHEN n_nationkey % 3 = 0 THEN 'app/A' || CAST(3 * (14 + n_nationkey) AS STRING) ELSE {cn('26 * (1 + n_nationkey) + 1')} END AS provider, 'jar' || CAST(n_regionkey AS STRING) AS source, CAST(n_nationkey AS INT) AS ord FROM nation UNION ALL SELECT 'java/lang/Object', {cn('p_partkey')}, 'jar' || CAST(p_partkey % 20 AS STRING), CAST(p_partkey AS INT) FROM part",
    "artifacts_before": "SELECT 'mod' || CAST(s_suppkey % 12 AS STRING) AS module, 'g' || CAST(s_nationkey AS STRING) AS \"group\", 'a' || CAST(s_suppkey % 40 AS STRING) AS name, CAST(s_suppkey % 3 AS STRING) || '.0' AS version, 'f' || CAST(s_suppkey AS STRING) || '.jar' AS file, CASE WHEN s_suppkey % 31 = 0 THEN 'p' || CAST(s_suppkey AS STRING) END AS project FROM supplier WHERE s_suppkey % 9 <> 0",
    "artifacts_after": "SELECT 'mod' || CAST(s_suppkey % 12 + CASE WHEN s_suppkey % 12 = 11 THEN 5 ELSE 0 END AS STRING) AS module, 'g' || CAST(s_nationkey AS STRING) AS \"group\", 'a' || CAST(s_suppkey % 40 AS STRING) AS name, CAST(s_suppkey % 3 + CASE WHEN s_suppkey % 4 = 1 AND s_suppkey % 12 <> 5 THEN 1 ELSE 0 END AS STRING) || '.0' AS version, 'g' || CAST(s_suppkey AS STRING) || '.jar' AS file, CASE WHEN s_suppkey % 31 = 0 THEN 'p' || CAST(s_suppkey AS STRING) END AS project FROM supplier WHERE s_suppkey % 11 <> 0 OR s_suppkey % 12 = 5",
}
NEEDS = {k: [n for n in CTES if n != k and re.search(rf"(?:FROM|JOIN) {n}\b", v)] for k, v in CTES.items()}


def _order(names: list[str]) -> list[str]:
    out: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS[n]:
            add(m)
        if n not in out:
            out.append(n)

    for n in names:
        add(n)
    return out


def _sql(name: str, dialect: str) -> str:
    text = CTES[name]
    for k, v in DIALECT[dialect].items():
        text = text.replace("{" + k + "}", v)
    return text


def oracle(names: list[str], body: str) -> str:
    """A DuckDB query: body over the named tables; further CTEs may open the body with a comma."""
    head = ", ".join(f"{n} AS ({_sql(n, 'duckdb')})" for n in _order(names))
    return f"WITH RECURSIVE {head}{'' if body.lstrip().startswith(',') else ' '}{body}"


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table from the files of sf_dir."""
    for t in ("lineitem", "orders", "part", "customer", "supplier", "nation", "region", "events"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    parts = _order([name])
    head = ", ".join(f"{n} AS ({_sql(n, 'spark')})" for n in parts)
    df = spark.sql(f"WITH {head} SELECT * FROM {name}".replace('"group"', "`group`"))
    return df.withColumn("permitted", df["permitted"].cast("array<string>")) if "permitted" in df.columns else df
