"""Print the physical plan of a registered query and a count of its operators.

usage: python tools/plan.py NAME [sf_dir] [--full]
"""
from __future__ import annotations

import re
import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallyspark import build_session  # noqa: E402
from tallyspark.plans.registry import all_queries  # noqa: E402


def main(argv):
    name = argv[1]
    sf_dir = argv[2] if len(argv) > 2 and not argv[2].startswith("--") else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=8)
    df = all_queries()[name](spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    ops = Counter(re.findall(r"(Exchange hashpartitioning|Exchange SinglePartition|Exchange rangepartitioning|"
                             r"BroadcastExchange|ReusedExchange|BroadcastHashJoin|SortMergeJoin|"
                             r"ShuffledHashJoin|BroadcastNestedLoopJoin|FileScan parquet|"
                             r"Subquery|ReusedSubquery|Window|Generate|TakeOrderedAndProject)", plan))
    print(dict(ops))
    if "--full" in argv:
        print(plan)
    else:
        for line in plan.splitlines():
            if re.search(r"FileScan|Join|Exchange|Subquery|Window|Generate", line):
                print(line[:260])


if __name__ == "__main__":
    main(sys.argv)
