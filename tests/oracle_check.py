"""Compare registered queries with their DuckDB oracles: python tests/oracle_check.py [sf] [name-part ...]"""
import datetime, decimal, math, os, sys, time
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import duckdb
from pyspark.sql import SparkSession


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return ("dec", float(v))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(([norm(r[i]) for i in order] for r in rows), key=lambda r: [(x is None, str(type(x)), str(x)) for x in r])


def session():
    s = (SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    return s


def names_of(modules):
    """Queries registered by the named plan modules."""
    import inspect
    import __spark_entry__ as entry
    return [n for n, f in entry.queries().items() if inspect.getmodule(f).__name__.split(".")[-1] in modules]


def main():
    import __spark_entry__ as entry
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    d = f"/root/testdata/sf{sf}"
    spark = session()
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(d):
        con.execute(f"create view {f[:-8]} as select * from '{d}/{f}'")
    qs, os_ = entry.queries(), entry.oracle_sql()
    bad = 0
    chosen = set(names_of([p[1:] for p in parts if p.startswith("@")]))
    for name, fn in qs.items():
        if parts and not any(p in name for p in parts if not p.startswith("@")) and name not in chosen:
            continue
        try:
            t = time.time()
            df = fn(spark, d)
            got = df.collect()
            ts = time.time() - t
            if name not in os_:
                print(f"rows {name:36s} {len(got):7d} {ts:6.2f}s", flush=True)
                if not got:
                    print("     EMPTY"); bad += 1
                continue
            t = time.time()
            cur = con.execute(os_[name])
            dc = [c[0] for c in cur.description]
            exp = cur.fetchall()
            td = time.time() - t
            a, b = rows_of(df.columns, got), rows_of(dc, exp)
            ok = a == b and sorted(df.columns) == sorted(dc)
            print(f"{'ok  ' if ok else 'FAIL'} {name:36s} {len(got):7d}/{len(exp):7d} {ts:6.2f}s {td:6.2f}s{'  EMPTY' if not got else ''}", flush=True)
            if not ok:
                bad += 1
                print("    cols", sorted(df.columns), sorted(dc))
                n = 0
                for x, y in zip(a, b):
                    if x != y:
                        print("    S", str(x)[:600]); print("    D", str(y)[:600]); n += 1
                        if n >= 3: break
        except Exception as e:
            bad += 1
            print(f"ERR  {name}: {type(e).__name__} {str(e)[:700]}", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main()
