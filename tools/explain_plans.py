"""Print the formatted physical plan of registered queries.

    python tools/explain_plans.py [sf_dir] [name-substring ...]

Each plan is printed after the query has run, so adaptive execution shows
its final plan (broadcasts chosen, partitions coalesced, skew splits).
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from staylens.plans.catalog import queries  # noqa: E402
from staylens.plans.session import get_spark  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = get_spark()
    for name, fn in queries().items():
        if only and not any(o in name for o in only):
            continue
        df = fn(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        print(f"===== {name}")
        df.explain("formatted")


if __name__ == "__main__":
    main()
