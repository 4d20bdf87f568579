"""Compare queries with their SQL: python -m checks.run SF_DIR [name-prefix ...]"""

from __future__ import annotations

import importlib
import sys
import time
import traceback

import duckdb
import pandas as pd

from checks import MODULES
from checks.fx import REGISTRY
from sparkmos.session import build

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    out = []
    for row in df.itertuples(index=False, name=None):
        out.append(tuple("∅" if v is None or v is pd.NaT or (not isinstance(v, (list, dict)) and pd.isna(v)) else
                         (f"{v:.6f}" if isinstance(v, float) else str(v)) for v in row))
    return sorted(out)


def fetched(df) -> pd.DataFrame:
    """Whole numbers with nulls stay whole numbers."""
    out = df.toPandas()
    whole = [f.name for f in df.schema if f.dataType.typeName() in ("integer", "long") and out[f.name].dtype.kind == "f"]
    return out.astype({c: "Int64" for c in whole})


def main() -> int:
    sf, prefixes = sys.argv[1], sys.argv[2:]
    for m in MODULES:
        importlib.import_module(f"checks.{m}")
    spark = build("checks", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    for name, (fn, sql) in REGISTRY.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            t0 = time.time()
            got = fetched(fn(spark, sf))
            t1 = time.time()
            if sql is None:
                print(f"rows  {name}: {len(got)} rows, {t1 - t0:.1f}s")
                continue
            want = db.execute(sql).df()
            t2 = time.time()
            if sorted(got.columns) != sorted(want.columns):
                print(f"FAIL  {name}: columns {sorted(set(got.columns) ^ set(want.columns))}")
                bad += 1
                continue
            kinds = [(c, str(got[c].dtype), str(want[c].dtype)) for c in got.columns if got[c].dtype.kind != want[c].dtype.kind]
            a, b = canonical(got), canonical(want)
            if a != b:
                bad += 1
                only_a, only_b = set(a) - set(b), set(b) - set(a)
                print(f"FAIL  {name}: {len(a)} vs {len(b)} rows, {len(only_a)}/{len(only_b)} differ")
                cols = sorted(got.columns)
                for x, y in zip(sorted(only_a)[:3], sorted(only_b)[:3]):
                    print("   ", [(c, p, q) for c, p, q in zip(cols, x, y) if p != q][:8], x[:4])
                if not only_b or not only_a:
                    print("   ", cols, sorted(only_a or only_b)[:2])
            else:
                print(f"ok    {name}: {len(a)} rows, spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s{' TYPES ' + str(kinds) if kinds else ''}")
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name}: {str(e)[:700]}")
            if "-v" in sys.argv:
                traceback.print_exc()
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
