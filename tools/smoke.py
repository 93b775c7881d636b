"""Run registered queries and print row counts and times: `python tools/smoke.py SF_DIR [name ...]`."""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from voxlake.plans.registry import QUERIES
from voxlake.session import local_session

sf, names = sys.argv[1], sys.argv[2:]
spark = local_session(8)
bad = 0
for name in names or QUERIES:
    t0 = time.time()
    try:
        n = len(QUERIES[name](spark, sf).toArrow())
        print(f"{name:34s} {n:8d} rows {time.time() - t0:6.2f}s", flush=True)
    except Exception as e:
        bad += 1
        text = str(e)
        print(f"{name:34s} FAILED {type(e).__name__}: {text[:500]}", flush=True)
        if not text:
            traceback.print_exc()
print("failed:", bad)
