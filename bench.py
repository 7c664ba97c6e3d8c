"""Headline queries, timed warm. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from procscope.catalog import base
from procscope.operators import baseline, detect
from procscope.plans.replay import replay
from procscope.session import session
from procscope.sources import synth

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def timed(fn, runs: int = RUNS) -> float:
    times = []
    for _ in range(runs):
        t = time.perf_counter()
        fn().write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - t)
    return round(statistics.median(times), 3)


def main() -> None:
    spark = session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    i = base.inputs(spark, SF_DIR)
    t = time.perf_counter()
    events = i.cap.count()
    landing = round(time.perf_counter() - t, 3)
    # Chunks far smaller than a host, so that the carries between chunks are part of the figure.
    st = detect.Settings(host_mnt_ns=synth.HOST_MNT_NS, chunk=4096)
    half = i.cap.filter("host < 'host-4'")

    # Every run below starts from the capture table; nothing is kept between runs.
    replay(i.cap, st, "low").incidents.write.format("noop").mode("overwrite").save()  # warm-up
    q = {
        "l1_replay": timed(lambda: replay(i.cap, st, "low").incidents),
        "l1_replay_half_the_hosts": timed(lambda: replay(half, st, "low").incidents, 1),
        "l2_baseline": timed(
            lambda: baseline.learn(
                i.cap, detect.signals(i.cap, st), i.states, 1_700_000_000_000
            ).entries,
            1,
        ),
        "e_row_detectors": timed(lambda: detect.detect_rows(i.cap, st)),
    }
    print(
        json.dumps(
            {
                "metric": "replay of a capture into incidents",
                "value": q["l1_replay"],
                "unit": "sec",
                "events": events,
                "events_per_sec": round(events / q["l1_replay"]),
                "landing_sec": landing,
                "queries": q,
                "sf": os.path.basename(SF_DIR),
            }
        )
    )


if __name__ == "__main__":
    main()
