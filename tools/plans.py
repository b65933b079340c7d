"""Scans the physical plans of registered queries for nested-loop or cartesian joins and windows without a partition.

    python tools/plans.py [--sf DIR] [prefix ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quantloom import plans, session


def main(argv) -> int:
    sf = "/root/testdata/sf0.001"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf, argv = argv[i + 1], argv[:i] + argv[i + 2:]
    spark = session.build()
    spark.sparkContext.setLogLevel("OFF")
    bad = 0
    for name, fn in plans.queries().items():
        if name.startswith("r0") or (argv and not any(name.startswith(p) for p in argv)):
            continue
        text = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        found = {k: text.count(k) for k in ("CartesianProduct", "BroadcastNestedLoopJoin") if k in text}
        loose = {m.strip() for m in re.findall(r"Window \[([^\n]*)\], \[[^\]]*\](?=\n)", text) if not re.search(r"\], \[[^\]]*\], \[", m)}
        single = [x for x in re.findall(r"windowspecdefinition\(([a-z_]+)#\d+", text) if x in ("date", "day", "pos", "snap_date")]
        if found or single:
            bad += bool(found)
            print(name, found, sorted(set(single)), len(loose) and "", flush=True)
    print("nested loops:", bad)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
