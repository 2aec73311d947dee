"""Run registered queries on Spark and their SQL on DuckDB, and compare every row.

``python tests/check_oracles.py [sf_dir] [name ...]``; a name may end with ``*``.
"""

from __future__ import annotations

import fnmatch
import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from packetloom.session import build_session  # noqa: E402
from packetloom.views import TABLES  # noqa: E402


def _cell(value: object) -> object:
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, (list, tuple)):
        return tuple(_cell(item) for item in value)
    if isinstance(value, dict):
        return tuple((key, _cell(item)) for key, item in sorted(value.items()))
    return value


def _rows(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


_FAMILY = {
    "bigint": "long", "hugeint": "HUGEINT", "integer": "int", "varchar": "string", "double": "double",
    "boolean": "boolean", "timestamp": "timestamp", "blob": "binary",
}


def compare(spark: SparkSession, sf_dir: str, name: str, function, sql: str | None) -> tuple[bool, str]:
    started = time.time()
    frame = function(spark, sf_dir)
    rows = [tuple(row) for row in frame.collect()]
    spent = time.time() - started
    if sql is None:
        return bool(rows), f"{name}: rows only, {len(rows)} rows, {spent:.1f}s"
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    started = time.time()
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]).lower() for d in cursor.description}
    expected = cursor.fetchall()
    other = time.time() - started
    note = ""
    for field in frame.schema.fields:
        mine, theirs = field.dataType.simpleString(), types.get(field.name, "missing")
        if _FAMILY.get(theirs, theirs) != {"bigint": "long"}.get(mine, mine):
            note += f" type {field.name}: {mine}/{theirs};"
    if sorted(columns) != sorted(frame.columns):
        return False, f"{name}: columns {sorted(frame.columns)} / {sorted(columns)}"
    mine, theirs = _rows(frame.columns, rows), _rows(columns, expected)
    head = f"{name}: {len(mine)} / {len(theirs)} rows, {spent:.1f}s / {other:.1f}s{note}"
    if mine == theirs:
        return True, head
    missing = [row for row in theirs if row not in set(mine)][:3]
    extra = [row for row in mine if row not in set(theirs)][:3]
    return False, f"{head}\n   columns {sorted(columns)}\n   only spark {extra}\n   only duckdb {missing}"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or ["*"]
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    texts, failed = oracle_sql(), []
    for name, function in queries().items():
        if not any(fnmatch.fnmatch(name, pattern) for pattern in wanted):
            continue
        try:
            ok, message = compare(spark, sf_dir, name, function, texts.get(name))
        except Exception as error:  # a failing query must not stop the others
            ok, message = False, f"{name}: {type(error).__name__}: {str(error)[:1500]}"
        print("ok  " if ok else "FAIL", message, flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
