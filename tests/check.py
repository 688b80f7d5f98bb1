"""Compare chosen (or all) registered queries with their SQL from the shell:
``python -m tests.check 0.01 name name ...``"""

import sys
import time

import __spark_entry__ as entry
from tests.compare import connect, spark_rows, sql_rows
from tests.conftest import make_session


def main() -> None:
    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    spark, con = make_session(), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            names, got = spark_rows(queries[name](spark, sf_dir))
            took = time.time() - start
            if name not in oracles:
                print(f"rows  {name} {sum(got.values())} {took:.2f}s", flush=True)
                continue
            start = time.time()
            sql_names, wanted = sql_rows(con, oracles[name])
            took_sql = time.time() - start
            good = names == sql_names and got == wanted
            print(f"{'ok   ' if good else 'DIFF '} {name} {sum(got.values())} {took:.2f}s sql {took_sql:.2f}s", flush=True)
            if not good:
                print("  ", names, sql_names, sum(got.values()), sum(wanted.values()))
                print("   spark only", str(list((got - wanted).items())[:3])[:1500])
                print("   sql only  ", str(list((wanted - got).items())[:3])[:1500])
        except Exception as error:
            print(f"FAIL  {name} {type(error).__name__} {str(error)[:1500]}", flush=True)


main()
