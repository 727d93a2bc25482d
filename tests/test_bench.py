"""bench.py prints one JSON line the driver can read."""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py"), "duplicates_count",
                          "bar_chart_data"], env=env, capture_output=True, text=True,
                         timeout=600, check=True).stdout.strip().splitlines()
    data = json.loads(out[-1])
    assert data["unit"] == "sec" and data["sf"] == "0.001"
    assert set(data["queries"]) == {"duplicates_count", "bar_chart_data"}
    assert data["value"] == round(sum(data["queries"].values()), 3) or \
        abs(data["value"] - sum(data["queries"].values())) < 1e-6
