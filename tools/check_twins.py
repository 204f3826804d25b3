"""Run queries beside their SQL twins: ``python tools/check_twins.py [sf_dir] [name ...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SAME = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "date": "DATE", "array<bigint>": "BIGINT[]",
    "array<int>": "INTEGER[]", "array<double>": "DOUBLE[]", "array<string>": "VARCHAR[]",
}


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, (list, tuple)):
        return [canonical(v) for v in value]
    if isinstance(value, float) and value == 0:
        return "0.0"
    return repr(value)


def compare(spark, con, name, fn, sql, sf) -> str:
    df = fn(spark, sf)
    rows = df.collect()
    if sql is None:
        return f"rows only: {len(rows)}"
    cur = con.execute(sql)
    twin_types = {c[0]: str(c[1]) for c in cur.description}
    twin_rows = cur.fetchall()
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    if set(types) != set(twin_types):
        return f"DIFF columns {sorted(types)} and {sorted(twin_types)}"
    off = {c: (types[c], twin_types[c]) for c in types if SAME.get(types[c]) != twin_types[c]}
    if off:
        return f"DIFF types {off}"
    order = sorted(types)
    mine = sorted(str([canonical(r[c]) for c in order]) for r in rows)
    at = [list(twin_types).index(c) for c in order]
    theirs = sorted(str([canonical(r[i]) for i in at]) for r in twin_rows)
    if mine != theirs:
        a, b = sorted(set(mine) - set(theirs)), sorted(set(theirs) - set(mine))
        return f"DIFF values: {len(mine)} and {len(theirs)} rows\n   {order}\n   {a[:3]}\n   {b[:3]}"
    return f"ok {len(rows)}"


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def main(argv):
    from pyspark.sql import SparkSession

    from roadframes.plans.catalog import QUERIES, TWINS

    sf = "/root/testdata/sf0.01"
    if argv and os.path.isdir(argv[0]):
        sf, argv = argv[0], argv[1:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    bad = 0
    for name, fn in QUERIES.items():
        if argv and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in argv):
            continue
        start = time.time()
        try:
            said = compare(spark, con, name, fn, TWINS.get(name), sf)
        except Exception as error:
            lines = str(error).splitlines()
            said = "FAIL " + type(error).__name__ + ": " + " | ".join(lines[:6] + lines[-3:])[:1500]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += not said.startswith(("ok", "rows"))
        print(f"{name:32s} {time.time() - start:6.1f}s {said}", flush=True)
    print(f"{bad} of {len(QUERIES)} off")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
