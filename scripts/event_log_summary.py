"""Summarise a Spark event log folder: heaviest stages, task time and shuffle volume.

usage: BENCH_EVENT_LOG=/tmp/run-x python bench.py; python scripts/event_log_summary.py /tmp/run-x [top]
Reads the (zstd-compressed) event files Spark writes; no Spark, UI or server needed.
"""

from __future__ import annotations

import collections
import glob
import io
import json
import sys

import zstandard


def lines(path: str):
    with open(path, "rb") as fh:
        if path.endswith(".zstd"):
            stream = zstandard.ZstdDecompressor().stream_reader(fh, read_across_frames=True)
            yield from io.TextIOWrapper(stream, encoding="utf-8")
        else:
            yield from io.TextIOWrapper(fh, encoding="utf-8")


def main() -> None:
    folder, top = sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 15
    stage_job, stage_name = {}, {}
    tasks, run = collections.Counter(), collections.Counter()
    shuf_w, shuf_r, rec_in = collections.Counter(), collections.Counter(), collections.Counter()
    for path in glob.glob(f"{folder}/*/events_*") + glob.glob(f"{folder}/*.zstd"):
        for line in lines(path):
            e = json.loads(line)
            ev = e.get("Event")
            if ev == "SparkListenerJobStart":
                for sid in e["Stage IDs"]:
                    stage_job[sid] = e["Job ID"]
            elif ev == "SparkListenerStageSubmitted":
                info = e["Stage Info"]
                stage_name[info["Stage ID"]] = info["Stage Name"][:40]
            elif ev == "SparkListenerTaskEnd":
                m, sid = e.get("Task Metrics") or {}, e["Stage ID"]
                w, r = m.get("Shuffle Write Metrics") or {}, m.get("Shuffle Read Metrics") or {}
                tasks[sid] += 1
                run[sid] += m.get("Executor Run Time", 0)
                shuf_w[sid] += w.get("Shuffle Bytes Written", 0)
                shuf_r[sid] += r.get("Remote Bytes Read", 0) + r.get("Local Bytes Read", 0)
                rec_in[sid] += (m.get("Input Metrics") or {}).get("Records Read", 0)
    print(f"stages {len(tasks)}  task time {sum(run.values()) / 1e3:.1f}s  "
          f"shuffle written {sum(shuf_w.values()) / 1e6:.1f} MB")
    for sid in sorted(run, key=lambda s: -run[s])[:top]:
        print(f"stage {sid:5d} job {stage_job.get(sid)!s:>5} tasks {tasks[sid]:4d} run {run[sid] / 1e3:7.2f}s "
              f"shuffle w {shuf_w[sid] / 1e6:7.2f} MB r {shuf_r[sid] / 1e6:7.2f} MB in {rec_in[sid]:9d} "
              f"{stage_name.get(sid, '')}")


if __name__ == "__main__":
    main()
