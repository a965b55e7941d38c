"""python tests/check_all.py [sf_dir] [name ...]: compares registered queries with their SQL, with times."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry
from tallyframe.session import local_session
from tests.oracle import compare, connect

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = []
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, sf)
            built = time.time() - start
            same, n, m, a, b = compare(df, con, entry.oracle_sql()[name])
            ok = same and n == m and not a and not b
            print(f"{'ok  ' if ok else 'FAIL'} {name:36s} rows {n} {m} built {built:.1f}s all {time.time() - start:.1f}s", flush=True)
            if not ok:
                bad.append(name)
                print("   columns", same, "ours", a[:3], "theirs", b[:3], flush=True)
        except Exception as e:
            bad.append(name)
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:1500]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print("failed:", bad)
