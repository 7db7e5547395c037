"""Compare registered queries with their SQL, value by value.

    python tests/oracle_check.py /root/testdata/sf0.01 [setting=value ...] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def _cell(value):
    if isinstance(value, float):
        return ("nan",) if math.isnan(value) else value + 0.0
    return value


def _sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    table = [tuple(_cell(row[i]) for i in order) for row in rows]
    return sorted(table, key=lambda row: [(v is None, type(v).__name__, str(v)) for v in row])


_KIND = {
    "string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def differences(df, connection, sql: str) -> list[str]:
    """What differs between a DataFrame and a query: names, types, rows."""
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    found = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} / {sorted(names)}"]
    kinds = {column[0]: str(column[1]) for column in result.description}
    expected = result.fetchall()
    kinds = {
        row[0]: row[1] for row in connection.execute(f"DESCRIBE {sql}").fetchall()
    }
    for name, kind in df.dtypes:
        if _KIND.get(kind, kind) != kinds[name] and kinds[name] != '"NULL"':
            found.append(f"type of {name}: {kind} / {kinds[name]}")
    ours = _sorted_rows(df.columns, [tuple(row) for row in df.collect()])
    theirs = _sorted_rows(names, expected)
    if len(ours) != len(theirs):
        found.append(f"rows {len(ours)} / {len(theirs)}")
    unequal = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if unequal:
        found.append(f"{len(unequal)} rows differ, first {unequal[0][0]} / {unequal[0][1]}")
    return found


def main(sf_dir: str, only: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from quarterline.session import local_session

    settings = dict(word.split("=", 1) for word in only if "=" in word)
    only = [word for word in only if "=" not in word]
    spark = local_session(**settings)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    oracles = oracle_sql()
    failed = 0
    for name, function in queries().items():
        if only and name not in only:
            continue
        begin = time.time()
        if name not in oracles:
            print(f"--    {name}: {function(spark, sf_dir).count()} rows, no SQL", flush=True)
            continue
        try:
            found = differences(function(spark, sf_dir), connection, oracles[name])
        except Exception as error:  # report and go on with the next query
            found = [str(error)[:500]]
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok':5} {name} {time.time() - begin:.1f}s {'; '.join(found)}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
