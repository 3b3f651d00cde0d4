"""Runs registered queries next to their SQL and reports differences.

    python tools/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from salesprism.session import local_session  # noqa: E402
from salesprism.workload import ORACLES, QUERIES  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value) if not isinstance(value, bool) else str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    spark = local_session(8)
    con = connect(sf_dir)
    failed = []
    for name in wanted:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            table = df.toArrow()
            got_names, got = rows_of(table.column_names, [tuple(r.values()) for r in table.to_pylist()])
            took = time.time() - start
            if name not in ORACLES:
                print(f"rows  {name:32s} {len(got):8d} rows {took:6.2f}s")
                continue
            ref = con.sql(ORACLES[name]).to_arrow_table()
            ref_names, want = rows_of(ref.column_names, [tuple(r.values()) for r in ref.to_pylist()])
            types = {f.name: str(f.type) for f in table.schema}, {f.name: str(f.type) for f in ref.schema}
            ok = got_names == ref_names and got == want
            note = "" if types[0] == types[1] else f" types {[(k, v, types[1].get(k)) for k, v in types[0].items() if v != types[1].get(k)]}"
            print(f"{'same ' if ok else 'DIFF '} {name:32s} {len(got):8d} rows {took:6.2f}s{note}", flush=True)
            if not ok:
                failed.append(name)
                print("   columns", got_names, ref_names, "rows", len(got), len(want))
                for r in sorted(set(got) - set(want))[:3]:
                    print("   spark ", r)
                for r in sorted(set(want) - set(got))[:3]:
                    print("   sql   ", r)
        except Exception as exc:  # a failing query must not hide the others
            failed.append(name)
            print(f"ERROR {name}: {type(exc).__name__} {str(exc)[:600]}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
