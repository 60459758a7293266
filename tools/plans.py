"""Count the expensive parts of every registered query's physical plan.

    python tools/plans.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from zonalis.plans.catalogue import QUERIES  # noqa: E402
from zonalis.session import build_session  # noqa: E402

PARTS = {"scan": r"(?:FileScan|Scan) parquet", "exch": r"(?<!Broadcast)(?<!Reused)Exchange (?:hash|range|Single|Round)",
         "reused": r"ReusedExchange", "single": r"Exchange SinglePartition", "bcast": r"BroadcastExchange",
         "nlj": r"BroadcastNestedLoopJoin|CartesianProduct", "smj": r"SortMergeJoin", "bhj": r"BroadcastHashJoin",
         "window": r"\bWindow \[", "python": r"(?:InPandas|ArrowEval|MapInArrow)"}


def main() -> None:
    args = sys.argv[1:]
    sf = args[0] if args else "/root/testdata/sf0.001"
    spark = build_session("local[4]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.adaptive.enabled", "false")     # static plans show reuse
    print(f"{'query':46s}" + "".join(f"{p:>7s}" for p in PARTS))
    for name, fn in QUERIES.items():
        if args[1:] and not any(name.startswith(p) for p in args[1:]):
            continue
        plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        counts = {p: len(re.findall(rx, plan)) for p, rx in PARTS.items()}
        print(f"{name:46s}" + "".join(f"{c or '.':>7}" for c in counts.values()), flush=True)
        if os.environ.get("SHOW"):
            print(plan)


if __name__ == "__main__":
    main()
