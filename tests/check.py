"""python tests/check.py [folder] [name ...]: compare queries with their SQL, print times and differences."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from sunloom.session import local_session  # noqa: E402


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    # PLAIN=1: Spark's defaults instead of the package's session settings
    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate() \
        if os.environ.get("PLAIN") else local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(folder)
    plans, sql = entry.queries(), entry.oracle_sql()
    failed = []
    for name, plan in plans.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            got = plan(spark, folder).toPandas()
            took = time.time() - start
            problems = oracle.differences(got, con.execute(sql[name]).df()) if name in sql else []
            if len(got) == 0:
                problems = problems + ["(empty)"]
        except Exception as error:  # noqa: BLE001
            took, got = time.time() - start, []
            problems = [str(error)[:900], traceback.format_exc().splitlines()[-1][:300]]
        if problems:
            failed.append(name)
        print(f"{'FAIL' if problems else 'ok  '} {name:28s} {len(got):7d} rows {took:6.2f}s "
              f"{'' if name in sql else '(no SQL)'}", *problems, sep="\n   " if problems else " ", flush=True)
    print(f"{len(failed)} failed: {failed}")
    return len(failed)


if __name__ == "__main__":
    sys.exit(main())
