"""Run checks in Spark and DuckDB over the same tables and compare the rows.

    python -m checks.compare /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)) and not hasattr(value, "asDict"):
        return tuple(_plain(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(_plain(v) for _, v in sorted(value.asDict().items()))
    if isinstance(value, dict):
        return tuple(_plain(v) for _, v in sorted(value.items()))
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def compare(spark, con, check, sf: str) -> tuple[bool, str]:
    """Whether both engines give the same columns and rows, and a one-line note."""
    started = time.time()
    df = check.run(spark, sf)
    got_columns, got = _rows(df.columns, df.collect())
    spent = time.time() - started
    if check.sql is None:
        return True, f"{len(got)} rows, no SQL, {spent:.1f}s"
    result = con.execute(check.sql)
    want_columns, want = _rows([d[0] for d in result.description], result.fetchall())
    if got_columns != want_columns:
        return False, f"columns {got_columns} != {want_columns}"
    if got != want:
        missing = [r for r in want if r not in set(got)][:2]
        extra = [r for r in got if r not in set(want)][:2]
        return False, f"{len(got)} rows vs {len(want)}\n   want {str(missing)[:700]}\n   got  {str(extra)[:700]}"
    return True, f"{len(got)} rows, {spent:.1f}s"


def main(argv: list[str]) -> int:
    from checks import REGISTRY
    from qaspark.session import local_session

    sf, names = argv[0], argv[1:] or list(REGISTRY)
    spark, con = local_session(8), duck(sf)
    bad = 0
    for name in names:
        try:
            ok, note = compare(spark, con, REGISTRY[name], sf)
        except Exception as exc:  # report and go on with the next check
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name + ": " + note, flush=True)
    print(f"{len(names) - bad} of {len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
