"""Helpers to cross-check a Spark query against its DuckDB oracle SQL."""

from __future__ import annotations

import math

import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sql: str, sf_dir: str) -> pd.DataFrame:
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con.execute(sql).fetchdf()


def _norm(v, digits):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, digits)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item(), digits)
        except (ValueError, AttributeError):
            pass
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    return v


def _close(x, y, rel=1e-9) -> bool:
    if rel < 0:             # strict mode: equality after rounding to -rel digits
        d = int(-rel)
        rx = round(float(x), d) if isinstance(x, float) else x
        ry = round(float(y), d) if isinstance(y, float) else y
        return rx == ry
    if isinstance(x, float) and isinstance(y, (float, int)) or isinstance(y, float) and isinstance(x, (float, int)):
        return math.isclose(float(x), float(y), rel_tol=rel, abs_tol=rel)
    return x == y


def compare(spark_df, oracle: pd.DataFrame, digits: int = 6, show: int = 5, rel: float = 1e-9) -> dict:
    """Order-insensitive comparison. Rows are sorted on values rounded to
    ``digits`` decimals; floats then compare with relative tolerance ``rel``."""
    left = spark_df.toPandas() if hasattr(spark_df, "toPandas") else spark_df
    cols_l, cols_r = sorted(left.columns), sorted(oracle.columns)
    res = {"rows_spark": len(left), "rows_oracle": len(oracle),
           "cols_match": cols_l == cols_r, "missing": sorted(set(cols_r) - set(cols_l)),
           "extra": sorted(set(cols_l) - set(cols_r))}
    if not res["cols_match"]:
        res["ok"] = False
        return res

    def key(r):
        out = []
        for x in r:
            if x is None:
                out.append((1, "", 0))
            elif isinstance(x, float):
                out.append((0, "f", round(x, digits)))
            elif isinstance(x, (int,)):
                out.append((0, "f", float(x)))
            else:
                out.append((0, type(x).__name__, str(x)))
        return tuple(out)

    def rows(df):
        recs = [tuple(_norm(v, 15) for v in rec) for rec in df[cols_l].itertuples(index=False, name=None)]
        return sorted(recs, key=key)

    a, b = rows(left), rows(oracle)
    bad = []
    for i, (x, y) in enumerate(zip(a, b)):
        if not all(_close(p, q, rel) for p, q in zip(x, y)):
            diffs = {c: (p, q) for c, p, q in zip(cols_l, x, y) if not _close(p, q, rel)}
            bad.append((i, diffs))
            if len(bad) >= show:
                break
    res["ok"] = len(a) == len(b) and not bad
    res["diffs"] = bad
    return res


def run_checks(names=None, sf_dir: str = "/root/testdata/sf0.01", digits: int = 6,
               verbose: bool = True) -> dict:
    """Run registered queries and their oracles; return name -> result."""
    import time

    from pitwise.plans.registry import ORACLES, QUERIES, load_all
    from pitwise.session import get_session
    load_all()
    spark = get_session("local[8]")
    out = {}
    for name in (names or sorted(QUERIES)):
        t = time.time()
        try:
            sdf = QUERIES[name](spark, sf_dir).toPandas()
            ts = time.time() - t
            if name in ORACLES:
                o = duck(ORACLES[name], sf_dir)
                import os
                strict = os.environ.get("PITWISE_STRICT_DIGITS")
                r = compare(sdf, o, digits=digits, rel=-float(strict) if strict else 1e-9)
            else:
                r = {"ok": None, "rows_spark": len(sdf), "rows_only": True}
            r["sec"] = round(ts, 2)
        except Exception as e:  # report and continue
            r = {"ok": False, "error": f"{type(e).__name__}: {str(e)[:400]}"}
        out[name] = r
        if verbose:
            brief = {k: v for k, v in r.items() if k not in ("diffs",)}
            print(name, brief, flush=True)
            for x in r.get("diffs", [])[:3]:
                print("   ", str(x)[:600], flush=True)
    return out


if __name__ == "__main__":
    import sys
    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    sf = next((a.split("=", 1)[1] for a in sys.argv[1:] if a.startswith("--sf=")), "/root/testdata/sf0.01")
    res = run_checks(args or None, sf_dir=sf)
    bad = [k for k, v in res.items() if v.get("ok") is False]
    print("FAILED:", bad)
