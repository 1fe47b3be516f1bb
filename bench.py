"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up and is then timed once into the noop sink, so
whole results are computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import re
import time

from textsluice.plans.catalog import QUERIES
from textsluice.session import local_session

HEADLINE = ["v_validate_summary", "v_sanitize", "f_redact_text", "f_report", "p_evaluate", "r_limiter",
            "g_verdict", "g_detail", "a_rollup", "c_history", "s_call_log", "c_replay"]


def timed(spark, query, sf: str) -> float:
    begin = time.perf_counter()
    query(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    seconds = {}
    for name in HEADLINE:
        timed(spark, QUERIES[name], sf)
        seconds[name] = round(timed(spark, QUERIES[name], sf), 3)
    found = re.search(r"sf([0-9.]+)", sf)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(found.group(1)) if found else None}))


if __name__ == "__main__":
    main()
