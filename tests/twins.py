"""Run registered queries next to their SQL twins: python -m tests.twins [sf] [name ...]."""

from __future__ import annotations

import datetime
import decimal
import hashlib
import math
import sys
import time
import traceback

import duckdb

import __spark_entry__ as contract
from trapline.session import build_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def digest(rows) -> str:
    return hashlib.sha256("\n".join(sorted("|".join(r) for r in rows)).encode()).hexdigest()


def spark_rows(df):
    names = sorted(df.columns)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return names, [kinds[n] for n in names], [
        tuple(plain(r[n]) for n in names) for r in df.collect()]


def duck_rows(con, sql):
    cursor = con.execute(sql)
    columns = [(d[0], str(d[1])) for d in cursor.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i][0])
    rows = [tuple(plain(r[i]) for i in order) for r in cursor.fetchall()]
    return [columns[i][0] for i in order], [columns[i][1] for i in order], rows


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN"}


def compare(spark, con, folder: str, name: str) -> tuple[bool, str]:
    started = time.time()
    names, kinds, rows = spark_rows(contract.queries()[name](spark, folder))
    took = time.time() - started
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return bool(rows), f"rows only ({len(rows)}) {took:.1f}s"
    other, other_kinds, other_rows = duck_rows(con, sql)
    note = f"{len(rows)} rows {took:.1f}s (+{time.time() - started - took:.1f}s sql)"
    if names != other:
        return False, f"columns {names} / {other}"
    odd = [f"{n}:{a}/{b}" for n, a, b in zip(names, kinds, other_kinds)
           if KINDS.get(a) != b and not (a == "string" and b in ("str", "STRING"))]
    if odd:
        note += " types " + ",".join(odd)
    if len(rows) != len(other_rows):
        return False, f"rows {len(rows)} / {len(other_rows)}; {note}"
    if digest(rows) != digest(other_rows):
        mine, theirs = sorted(set(rows) - set(other_rows)), sorted(set(other_rows) - set(rows))
        return False, f"{len(mine)} values differ {names} {mine[:2]} / {theirs[:2]}; {note}"
    return True, note


def main() -> None:
    arguments = sys.argv[1:]
    sf = arguments[0] if arguments else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    chosen = arguments[1:] or list(contract.queries())
    bad = 0
    for name in chosen:
        try:
            good, note = compare(spark, con, folder, name)
        except Exception as error:  # noqa: BLE001
            good, note = False, f"{type(error).__name__}: {str(error)[:700]}"
            if len(chosen) < 4:
                traceback.print_exc()
        bad += not good
        print("ok  " if good else "FAIL", name, note, flush=True)
    print(f"{len(chosen) - bad}/{len(chosen)} agree at sf{sf}")
    spark.stop()


if __name__ == "__main__":
    main()
