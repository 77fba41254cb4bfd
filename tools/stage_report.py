"""Summarize a Spark event log: per job and stage wall time, task count, input and
shuffle bytes. Usage: python tools/stage_report.py <event log file or dir> [top_n]"""

from __future__ import annotations

import glob
import io
import json
import os
import sys


def _lines(path: str):
    files = sorted(glob.glob(os.path.join(path, "events_*"))) if os.path.isdir(path) else [path]
    for f in files:
        if f.endswith(".zstd"):
            import zstandard
            stream = zstandard.ZstdDecompressor().stream_reader(open(f, "rb"))
            yield from io.TextIOWrapper(stream, encoding="utf-8")
        else:
            yield from open(f, encoding="utf-8")


def report(path: str, top: int = 15) -> None:
    stages, jobs = {}, {}
    for line in _lines(path):
        e = json.loads(line)
        ev = e.get("Event")
        if ev == "SparkListenerJobStart":
            jobs[e["Job ID"]] = [e["Submission Time"], None]
        elif ev == "SparkListenerJobEnd":
            jobs[e["Job ID"]][1] = e["Completion Time"]
        elif ev == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            acc = {a.get("Name"): a.get("Value") for a in si.get("Accumulables", [])}
            stages[si["Stage ID"]] = dict(
                ms=si["Completion Time"] - si["Submission Time"], tasks=si["Number of Tasks"],
                name=si["Stage Name"][:60],
                input=int(acc.get("internal.metrics.input.bytesRead", 0) or 0),
                shuffle_w=int(acc.get("internal.metrics.shuffle.write.bytesWritten", 0) or 0),
                shuffle_r=int(acc.get("internal.metrics.shuffle.read.remoteBytesRead", 0) or 0)
                + int(acc.get("internal.metrics.shuffle.read.localBytesRead", 0) or 0))
    print(f"jobs {len(jobs)}  stages {len(stages)}  tasks {sum(s['tasks'] for s in stages.values())}")
    print(f"input {sum(s['input'] for s in stages.values()):,} B  "
          f"shuffle write {sum(s['shuffle_w'] for s in stages.values()):,} B")
    for sid, s in sorted(stages.items(), key=lambda kv: -kv[1]["ms"])[:top]:
        print(f"stage {sid:5d} {s['ms']:7d} ms {s['tasks']:6d} tasks  in {s['input']:>12,}  "
              f"shuf w {s['shuffle_w']:>10,}  r {s['shuffle_r']:>10,}  {s['name']}")


if __name__ == "__main__":
    report(sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 15)
