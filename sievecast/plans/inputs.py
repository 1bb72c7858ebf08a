"""Inputs that queries derive from the given tables, as expressions that Spark SQL and DuckDB both take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_K = "o_orderkey"
PATH = f"concat('src/m', CAST({_K} % 97 AS STRING), '/f', CAST({_K} AS STRING), CASE {_K} % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.js' WHEN 2 THEN '.py' ELSE '.tsx' END)"
_PARTS = [
    "'// order ', o_orderpriority, ' if while {', chr(10)",
    f"'import {{ a, b as c', CAST({_K} % 3 AS STRING), ' }} from \"mod\";', chr(10)",
    f"'function f', CAST({_K} AS STRING), '(a, b', repeat(', p', CAST({_K} % 9 AS INT)), ') {{', chr(10)",
    f"repeat(concat('  if (a && b) {{', chr(10)), CAST({_K} % 8 AS INT))",
    f"CASE WHEN {_K} % 3 = 0 THEN '    debugger;' ELSE '    x = a ? b : c;' END, chr(10)",
    f"CASE WHEN {_K} % 4 = 1 THEN concat('    console.log(\"', o_orderstatus, ' // {{\");') ELSE '    while (obj?.n ?? a) {{ b(); }}' END, chr(10)",
    f"CASE WHEN {_K} % 5 = 2 THEN concat('    eval (code); obj.eval(1); alert(', chr(39), 'hi', chr(39), ');') ELSE '    /* eval(x) debugger */' END, chr(10)",
    f"CASE WHEN {_K} % 6 = 3 THEN concat('    password = \"', o_orderpriority, ' value\";') ELSE '    api_key: \"short\";' END, chr(10)",
    f"CASE {_K} % 7 WHEN 0 THEN '    try {{ f(); }} catch (e) {{ }}' WHEN 1 THEN '    try {{ f(); }} catch (e) {{ log(e); }}' ELSE '    el.innerHTML = 3500;' END, chr(10)",
    f"CASE {_K} % 13 WHEN 0 THEN '    try {{ g(); }} catch (e) {{ {{}} log(e); }} const exec = 1;' WHEN 1 THEN '    try {{ g(); }} catch (f(x)) {{ {{ }} }} el.outerHTML == 1;' ELSE '' END, chr(10)",
    f"CASE {_K} % 11 WHEN 0 THEN '    debugger; // sievecast-disable-line eval-detected, debugger-statement' WHEN 1 THEN '    // sievecast-disable-next-line' WHEN 2 THEN '# sievecast-disable-file no-alert' ELSE '' END, chr(10)",
    f"CASE WHEN {_K} % 11 < 3 THEN '    debugger; console.warn(2);' ELSE '' END, chr(10)",
    f"repeat('}}', CAST({_K} % 8 AS INT)), chr(10), '}}', chr(10)",
    "repeat(concat('if (q || r) { s(); }', chr(10)), CAST(floor(o_totalprice) AS INT) % 45)",
]
CONTENT = "concat(" + ", ".join(_PARTS) + ")"
#: The same file after an edit: other conditions, and a line more.
BEFORE = f"replace(replace({CONTENT}, 'debugger', 'step'), 'q || r', 'q')"
CODE_SQL = f"code AS (SELECT {PATH} AS file_path, {CONTENT} AS content FROM orders)"
EDITS_SQL = f"edits AS (SELECT {PATH} AS file_path, CASE WHEN {_K} % 10 = 0 THEN '' ELSE {BEFORE} END AS before, {CONTENT} AS after FROM orders)"

#: Diagnostics of line items.
DIAGNOSTIC = {
    "id": "concat(CAST(l_orderkey AS STRING), ':', CAST(l_linenumber AS STRING), ':', CAST(l_partkey AS STRING), ':', CAST(l_suppkey AS STRING))",
    "file_path": "concat('src/f', CAST(l_orderkey AS STRING), '.ts')",
    "line": "CAST(l_linenumber * 10 + l_partkey % 10 AS INT)",
    "col": "CAST(l_suppkey % 80 AS INT)",
    "severity": "CASE l_returnflag WHEN 'R' THEN 'error' WHEN 'A' THEN 'warning' ELSE CASE WHEN l_linestatus = 'F' THEN 'hint' ELSE 'info' END END",
    "rule": "concat('r', CAST(l_partkey % 7 AS STRING))",
    "message": "concat('part ', CAST(l_partkey AS STRING))",
    "has_fix": "l_partkey % 3 = 0",
    "fix_count": "CAST(l_partkey % 4 AS INT)",
    "blast_radius": "CAST(l_suppkey % 13 AS INT)",
    "age": "CAST(l_partkey % 15 AS INT)",
    "touched_start": "CAST(CASE WHEN l_linenumber = 1 THEN -1 ELSE l_suppkey % 60 END AS INT)",
    "touched_end": "CAST(CASE WHEN l_linenumber = 1 THEN -1 ELSE l_suppkey % 60 + 5 END AS INT)",
    "status": "CASE WHEN l_linestatus = 'F' THEN 'resolved' ELSE 'emitted' END",
    "last_seen": "CAST(l_orderkey * 10 + l_linenumber AS BIGINT)",
    "session_id": "CAST(l_suppkey AS STRING)",
}
DIAGNOSTICS_SQL = "d AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in DIAGNOSTIC.items()) + " FROM lineitem)"


def spread(df: DataFrame) -> DataFrame:
    """Narrow rows that texts are about to be made of: dealt over all cores where the file has fewer splits than that, so that the texts are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice"))
    return orders.selectExpr(f"{PATH} AS file_path", f"{CONTENT} AS content")


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice"))
    return orders.selectExpr(f"{PATH} AS file_path", f"CASE WHEN {_K} % 10 = 0 THEN '' ELSE {BEFORE} END AS before", f"{CONTENT} AS after")


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in DIAGNOSTIC.items()])
