"""Time a registered query and count the Spark jobs/stages/tasks it runs.

usage: python tools/stages.py sf_dir NAME [NAME ...]
"""
from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallyspark import build_session  # noqa: E402
from tallyspark.plans.registry import all_queries  # noqa: E402


def measure(spark, build, group):
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    t = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    dt = time.perf_counter() - t
    st = sc.statusTracker()
    jobs = st.getJobIdsForGroup(group)
    stages = set()
    for j in jobs:
        info = st.getJobInfo(j)
        if info:
            stages.update(info.stageIds)
    tasks = sum((st.getStageInfo(s).numTasks if st.getStageInfo(s) else 0) for s in stages)
    return dt, len(jobs), len(stages), tasks


def main(argv):
    sf_dir = argv[1]
    spark = build_session("local[8]", shuffle_partitions=16)
    qs = all_queries()
    for i, name in enumerate(argv[2:]):
        for rep in range(2):
            dt, j, s, t = measure(spark, lambda: qs[name](spark, sf_dir), f"{name}-{rep}-{i}")
        print(f"{name:26s} {dt:7.2f}s jobs={j} stages={s} tasks={t}", flush=True)


if __name__ == "__main__":
    main(sys.argv)
