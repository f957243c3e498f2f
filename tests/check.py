"""Command line: python tests/check.py [sf] [name-prefix ...]"""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
import harness  # noqa: E402

from tablewise.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    prefixes = tuple(sys.argv[2:]) or ("",)
    spark = local_session("8", "8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = harness.connect(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            if name in sqls:
                diff = harness.compare(spark, con, sf_dir, fn, sqls[name])
            else:
                diff = f"no SQL; {fn(spark, sf_dir).count()} rows"
        except Exception as error:  # noqa: BLE001
            diff = "ERROR " + (str(error)[:1500] if os.environ.get("SHORT") else traceback.format_exc()[-2500:])
        bad += bool(diff)
        print(f"{'ok  ' if not diff else 'DIFF'} {name:28s} spark {harness.TIMES[-1] if harness.TIMES else 0:6.2f}s all {time.time() - start:6.2f}s {diff}", flush=True)
    print("differences:", bad)
