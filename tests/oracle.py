"""Compare registered queries with their DuckDB text on the test tables."""
from __future__ import annotations

import math
import sys
import time

import duckdb

from archlens import fixtures, registry, session


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in fixtures.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _norm(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        # queries round what they return, so values must agree to the last bit
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return tuple(_norm(v) for v in value)
    return value


def _sorted(rows):
    return sorted(rows, key=lambda r: [(v is None, str(type(v)), str(v)) for v in r])


def compare(spark, con, key: str, sf_dir: str) -> tuple[bool, str]:
    df = registry.QUERIES[key](spark, sf_dir)
    names = sorted(df.columns)
    got = _sorted([tuple(_norm(r[n]) for n in names) for r in df.collect()])
    if key not in registry.ORACLES:
        return True, f"{len(got)} rows (no SQL)"
    con.execute(registry.ORACLES[key])
    cols = [d[0] for d in con.description]
    if sorted(cols) != names:
        return False, f"columns {names} != {sorted(cols)}"
    types = {d[0]: str(d[1]) for d in con.description}
    odd = [(c, t) for c, t in types.items() if "HUGE" in t or "DECIMAL" in t or t == "FLOAT"]
    at = [cols.index(n) for n in names]
    want = _sorted([tuple(_norm(r[i]) for i in at) for r in con.fetchall()])
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w][:3]
        return False, f"{len(got)} rows != {len(want)}; columns {names}; e.g. {bad}"
    kinds = dict(df.dtypes)
    for c, t in types.items():
        pair = (kinds[c], t)
        if pair not in {("bigint", "BIGINT"), ("double", "DOUBLE"), ("string", "VARCHAR"),
                        ("boolean", "BOOLEAN"), ("int", "INTEGER")}:
            odd.append((c, pair))
    return not odd, f"{len(got)} rows {odd or ''}"


def main() -> int:
    sf_dir = sys.argv[1]
    registry.load()
    keys = [k for k in registry.QUERIES if not sys.argv[2:] or
            any(k == a or k.startswith(a) for a in sys.argv[2:])]
    spark = session.local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = []
    for key in keys:
        start = time.time()
        try:
            ok, note = compare(spark, con, key, sf_dir)
        except Exception as exc:  # report and go on to the next query
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        if not ok:
            failed.append(key)
        print(f"{'ok ' if ok else 'BAD'} {key} {time.time() - start:.1f}s {note[:900]}", flush=True)
    print("failed:", failed)
    return bool(failed)


if __name__ == "__main__":
    raise SystemExit(main())
