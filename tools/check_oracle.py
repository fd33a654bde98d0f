"""Run every registered query against its SQL oracle and print a table.

usage: python tools/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import json
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallyspark import build_session  # noqa: E402
from tallyspark.plans.oracle_sql import oracle_queries  # noqa: E402
from tallyspark.plans.registry import all_queries  # noqa: E402
import tools.compare as cmp  # noqa: E402
from tools.compare import compare, duck  # noqa: E402


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = [a for a in argv[2:] if not a.startswith("--")]
    cmp.EXACT = "--exact" in argv
    extra = {"spark.sql.ansi.enabled": "false"} if "--noansi" in argv else None
    spark = build_session("local[8]", shuffle_partitions=8, extra=extra)
    print("ansi", spark.conf.get("spark.sql.ansi.enabled"))
    con = duck(sf_dir)
    qs, sqls = all_queries(), oracle_queries()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                r = compare(df, con, sqls[name])
                ok = r["columns_match"] and r["values_match"]
            else:
                r = {"spark_rows": df.count(), "oracle": "none"}
                ok = True
        except Exception as e:  # report and continue
            r, ok = {"error": repr(e)[:600]}, False
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {name:28s} {time.time() - t:6.2f}s "
              f"{json.dumps(r, default=str) if not ok else r.get('spark_rows')}", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
