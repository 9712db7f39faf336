"""Run registered queries against their oracles: python tests/check.py [sf] [name…]"""

from __future__ import annotations

import os
import sys
import time

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]

from tabveil.catalog import load
from tabveil.session import build_session
from tests.oracle import compare, connect


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.001"
    sf_dir = f"/root/testdata/{sf}"
    chosen = sys.argv[2:]
    spark = build_session("check", f"local[{os.environ.get('BENCH_CPUS', '8')}]",
                          **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, q in load().items():
        if chosen and not any(name.startswith(c) for c in chosen):
            continue
        if os.environ.get("CHECK_ORACLES_ONLY") and not q.sql:
            continue
        started = time.time()
        try:
            df = q.build(spark, sf_dir)
            problem = compare(df, con, q.sql) if q.sql else None
            note = "" if q.sql else f"{df.count()} rows"
        except Exception as error:  # report and go on
            problem, note = f"{type(error).__name__}: {str(error)[:600]}", ""
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - started:.1f}s {note} {problem or ''}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
