"""Slowest stages from a Spark event log folder (written when
PARLEY_EVENT_LOG_DIR is set), zstd-compressed or plain.

    python scripts/stage_times.py <event-log-dir> [n]
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys


def lines(path):
    if path.endswith(".zstd"):
        import zstandard
        with open(path, "rb") as fh:
            reader = zstandard.ZstdDecompressor().stream_reader(fh)
            yield from io.TextIOWrapper(reader, encoding="utf-8")
    else:
        with open(path, encoding="utf-8") as fh:
            yield from fh


def main():
    root, n = sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 10
    files = [f for f in glob.glob(os.path.join(root, "**", "events_*"), recursive=True)]
    stages = {}
    for f in sorted(files):
        for line in lines(f):
            e = json.loads(line)
            if e.get("Event") == "SparkListenerStageCompleted":
                si = e["Stage Info"]
                ms = si.get("Completion Time", 0) - si.get("Submission Time", 0)
                stages[(f, si["Stage ID"])] = (ms, si["Number of Tasks"], si["Stage Name"][:70])
    print(f"{len(stages)} stages, {sum(v[0] for v in stages.values())} ms in total")
    for ms, tasks, name in sorted(stages.values(), reverse=True)[:n]:
        print(f"{ms:8d} ms  {tasks:5d} tasks  {name}")


if __name__ == "__main__":
    main()
