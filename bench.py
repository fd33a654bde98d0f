"""Benchmark the seven reports.

Prints ONE JSON line:
  {"metric": "reports_total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

``queries`` holds the end-to-end time of each report computed from the raw
generated tables (the banking relations are derived on the fly, exactly as
``__spark_entry__.queries()`` runs them).  ``stored`` holds the time of the
same reports over a parquet copy of the derived relations with the ledger
partitioned by posting day -- the layout a production catalog has -- and
``ingest_sec`` the time to write that copy.  Every timed run builds the
report (including the checkpoints it takes) and executes the whole plan into
Spark's ``noop`` sink (nothing is collected).  Each report is
run three times and the fastest run is kept (steady state: JIT and
caches warm); a small warm-up pass runs first.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (8).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
import uuid
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tallyspark.session import build_session, checkpoint_dir  # noqa: E402
from tallyspark.plans import params as P  # noqa: E402
from tallyspark.plans import reports as R  # noqa: E402
from tallyspark.sources import TestdataSource, materialize  # noqa: E402

REPORTS = {
    "report_cash_monitor": lambda s: R.cash_monitor(s, P.CASH_MONITOR_BEFORE,
                                                    head_office_label=P.HEAD_OFFICE_LABEL),
    "report_cash_in_out": lambda s: R.cash_in_out_by_zone(s, P.ZONE_FROM, P.ZONE_TO),
    "report_ekyc": lambda s: R.ekyc(s, P.EKYC_FROM, P.EKYC_TO),
    "report_liquidity": lambda s: R.liquidity(s, P.LIQUIDITY_AS_OF, P.LIQUIDITY_CODES),
    "report_new_deposit": lambda s: R.new_deposit(s, P.NEW_DEPOSIT_DAY),
    "report_open_close": lambda s: R.open_close_counts(s, P.OPEN_CLOSE_FROM, P.OPEN_CLOSE_TO),
    "report_turnover": lambda s: R.gl_turnover(s, P.TURNOVER_DAY),
}


def run(build, src) -> float:
    """Seconds to build the report (including any relation it fixes with a
    checkpoint) and execute it completely."""
    t = time.perf_counter()
    build(src).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def best_of(build, src, n=3) -> float:
    return min(run(build, src) for _ in range(n))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", app="tallyspark-bench",
                          shuffle_partitions=2 * cpus,
                          extra={"spark.driver.memory": "16g"})
    smoke = TestdataSource(spark, str(Path(sf_dir).parent / "sf0.001"))
    if not Path(smoke.sf_dir).exists():
        smoke = TestdataSource(spark, sf_dir)
    for build in REPORTS.values():          # warm-up: JIT, class loading
        run(build, smoke)

    src = TestdataSource(spark, sf_dir)
    times = {name: round(best_of(build, src), 3) for name, build in REPORTS.items()}

    root = f"{checkpoint_dir(spark).rstrip('/')}/bench-{uuid.uuid4().hex[:8]}"
    t = time.perf_counter()
    stored_src = materialize(src, root)
    ingest = time.perf_counter() - t
    stored = {name: round(best_of(build, stored_src), 3) for name, build in REPORTS.items()}

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "reports_total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "stored": stored,
        "stored_total_sec": round(sum(stored.values()), 3),
        "ingest_sec": round(ingest, 3),
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
