"""Run queries and oracles side by side: python -m checks.compare [sf_dir] [key-prefix ...]

Compares row counts, column names and values (columns sorted by name, rows sorted).
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def rows_of(frame) -> tuple[list[str], list[tuple]]:
    cols = sorted(frame.columns)
    frame = frame[cols]
    rows = [tuple(_plain(v) for v in row) for row in frame.itertuples(index=False, name=None)]
    return cols, sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def _plain(v):
    if pd.isna(v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return float(v) + 0.0
    text = str(v)
    return text[:-9] if text.endswith(" 00:00:00") else text


def compare(spark, con, sf_dir: str, key: str, fn, sql: str | None) -> tuple[bool, str]:
    t0 = time.time()
    got = fn(spark, sf_dir).toPandas()
    t1 = time.time()
    if sql is None:
        return True, f"rows-only {len(got)} ({t1 - t0:.1f}s)"
    want = con.execute(sql).df()
    t2 = time.time()
    (gc, g), (wc, w) = rows_of(got), rows_of(want)
    note = f"{len(g)} rows, spark {t1 - t0:.1f}s duckdb {t2 - t1:.1f}s"
    if gc != wc:
        return False, f"columns {gc} != {wc}"
    kinds = [(c, got[c].dtype.kind, want[c].dtype.kind) for c in gc if got[c].dtype.kind != want[c].dtype.kind]
    if kinds:
        note += f" kinds {kinds}"
    if len(g) != len(w):
        return False, f"{note}; expected {len(w)} rows; spark {g[:2]} duckdb {w[:2]}"
    bad = [(a, b) for a, b in zip(g, w) if a != b]
    return not bad, note + (f"; {len(bad)} differ, e.g. {bad[0]}" if bad else "")


def main() -> None:
    from checks.all_oracles import ORACLES
    from tidemark.plans.registry import QUERIES
    from tidemark.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", shuffle_partitions=8, **{"spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    con = connect(sf_dir)
    failed = []
    for key, fn in QUERIES.items():
        if wanted and not any(key.startswith(w) for w in wanted):
            continue
        try:
            ok, note = compare(spark, con, sf_dir, key, fn, ORACLES.get(key))
        except Exception as error:  # noqa: BLE001
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        if not ok:
            failed.append(key)
        print("ok  " if ok else "FAIL", key, note, flush=True)
    print("missing queries:", [k for k in ORACLES if k not in QUERIES])
    print("failed:", failed)


if __name__ == "__main__":
    main()
