"""Run one registered query with Spark's event log on and print the slowest
stages (duration, tasks, name) from the log.

usage: python tools/eventlog.py sf_dir NAME
"""
from __future__ import annotations

import glob
import json
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallyspark import build_session  # noqa: E402
from tallyspark.plans.registry import all_queries  # noqa: E402


def main(argv):
    sf_dir, name = argv[1], argv[2]
    logdir = tempfile.mkdtemp(prefix="run-evlog-")
    spark = build_session("local[8]", shuffle_partitions=16,
                          extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": logdir,
                                 "spark.eventLog.compress": "false"})
    q = all_queries()[name]
    q(spark, sf_dir).write.format("noop").mode("overwrite").save()   # warm
    t0 = time.time() * 1000
    df = q(spark, sf_dir)
    t1 = time.time() * 1000
    df.write.format("noop").mode("overwrite").save()
    t2 = time.time() * 1000
    spark.stop()
    stages = []
    for f in glob.glob(f"{logdir}/**/*", recursive=True):
        if Path(f).is_dir():
            continue
        for line in open(f, errors="ignore"):
            if not line.startswith("{"):
                continue
            ev = json.loads(line)
            if ev.get("Event") == "SparkListenerStageCompleted":
                si = ev["Stage Info"]
                if si.get("Submission Time", 0) >= t1:
                    scopes = []
                    for r in si.get("RDD Info", []):
                        sc = r.get("Scope")
                        if sc:
                            n = json.loads(sc).get("name", "")
                            if n and n not in scopes:
                                scopes.append(n)
                    stages.append((si["Completion Time"] - si["Submission Time"],
                                   si["Number of Tasks"], ",".join(scopes)[:150],
                                   si["Submission Time"] - t1))
    print(f"build {t1 - t0:.0f} ms, run {t2 - t1:.0f} ms, stages {len(stages)}, "
          f"sum of stage ms {sum(s[0] for s in stages)}")
    for s in sorted(stages, reverse=True)[:15]:
        print(f"{s[0]:6d} ms  tasks={s[1]:3d}  start=+{s[3]:6.0f}  {s[2]}")


if __name__ == "__main__":
    main(sys.argv)
