"""Slowest stages from a Spark event log (written with
spark.eventLog.enabled / spark.eventLog.dir to a scratch folder).

usage: python scripts/stage_times.py <event log file or folder> [top]"""

from __future__ import annotations

import json
import os
import sys


def _open(path: str):
    """Event logs are zstd-compressed by default in Spark 4."""
    if path.endswith(".zstd"):
        import io

        import zstandard

        raw = open(path, "rb")
        return io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(raw, closefd=True), encoding="utf-8")
    return open(path, encoding="utf-8")


def stages(path: str):
    if os.path.isdir(path):  # Spark 4 writes rolling logs: eventlog_v2_<app>/events_<n>_<app>
        files = sorted(
            os.path.join(root, f) for root, _, names in os.walk(path) for f in names if not f.startswith(".")
            and not f.startswith("appstatus") and not f.endswith(".crc")
        )
    else:
        files = [path]
    for f in files:
        with _open(f) as fh:
            for line in fh:
                ev = json.loads(line)
                if ev.get("Event") != "SparkListenerStageCompleted":
                    continue
                info = ev["Stage Info"]
                start, end = info.get("Submission Time"), info.get("Completion Time")
                if start is None or end is None:
                    continue
                yield (end - start) / 1000.0, info["Stage ID"], info["Number of Tasks"], info["Stage Name"]


def main():
    path = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 15
    rows = sorted(stages(path), reverse=True)
    print(f"{len(rows)} stages, {sum(r[0] for r in rows):.1f} s in total")
    for sec, sid, tasks, name in rows[:top]:
        print(f"{sec:8.2f} s  stage {sid:5d}  tasks {tasks:5d}  {name[:90]}")


if __name__ == "__main__":
    main()
