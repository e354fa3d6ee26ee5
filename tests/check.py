"""Command-line run of the comparison: `python tests/check.py [sf_dir] [name ...]`."""

import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
sys.path.insert(0, os.path.dirname(__file__))

import __spark_entry__ as entry  # noqa: E402
from oracle import compare, connect  # noqa: E402

from strataflux.session import build_session  # noqa: E402


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    picked = argv[1:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if picked and not any(p in name for p in picked):
            continue
        t0 = time.time()
        try:
            if name in sqls:
                verdict = compare(spark, con, name, fn, sqls[name], sf_dir)
                note = "ok" if verdict is None else verdict
            else:
                note = f"rows {fn(spark, sf_dir).count()}"
                verdict = None
        except Exception as exc:  # noqa: BLE001
            verdict = note = f"{type(exc).__name__}: {str(exc)[:900]}"
        bad += verdict is not None
        print(f"{name:32s} {time.time() - t0:6.2f}s  {note}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
