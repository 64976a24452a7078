
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def main() -> None:
    import duckdb

    from gneiss.plans.catalogue import ORACLE_SQL

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    print("| query | DuckDB s |\n|---|---|")
    total = 0.0
    for name, sql in ORACLE_SQL.items():
        c = duckdb.connect(config={"threads": cpus})
        for t in os.listdir(folder):
            c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{t}'")
        best = None
        try:
            for _ in range(2):
                began = time.perf_counter()
                c.execute(sql).fetchall()
                spent = time.perf_counter() - began
                best = spent if best is None else min(best, spent)
        except duckdb.InternalException as e:  # an error of DuckDB's own
            print(f"| {name} | {str(e).splitlines()[0][:60]} |", flush=True)
            continue
        total += best
        print(f"| {name} | {best:.3f} |", flush=True)
    print(f"| all | {total:.1f} |")


if __name__ == "__main__":
    main()
