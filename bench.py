"""Headline queries at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import contextlib
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: One query of each kind of the engine's own operators; those of lumisift.llm are added where it is installed.
HEADLINES = [
    "grid_laplacian_variance", "hamming_pairs_banded", "twin_collapse", "neardup_kept", "quality_gate", "cull_top_n", "rule_contributions", "bucket_top6", "staged_greedy_pick",
    "phase_gallery", "quality_percentile", "override_rate", "session_restore_group_key", "decision_fold_undo", "progress_change_only", "reply_parse", "exif_time_parse",
]

#: Sizes of generated folders of 900x900 PNG files that are decoded and culled to 30, as the published baseline does on other hardware.
FOLDERS = (500, 1000)


def culled(spark, n: int) -> float:
    """Seconds from the folder to the keepers' names and reject counts; the files are written before."""
    from concurrent.futures import ThreadPoolExecutor

    from lumisift.functions.png import png
    from lumisift.plans.cull import cull
    from lumisift.sources import demo, frames

    with tempfile.TemporaryDirectory(prefix="lumisift-files-") as folder:

        def write(k: int) -> None:
            with open(f"{folder}/frame_{k:05d}.png", "wb") as f:
                f.write(png(demo.scene(k)))

        with ThreadPoolExecutor(os.cpu_count()) as pool:
            list(pool.map(write, range(n)))
        began = time.perf_counter()
        scanned = frames.with_capture_time(frames.hashed(frames.scan_folder(spark, f"file://{folder}")), spark, f"file://{folder}")
        done = cull(scanned, top_n=30)
        kept, lost = done.keepers.select("name").collect(), done.reject_counts().collect()
        took = time.perf_counter() - began
        done.survivors.unpersist()
        assert len(kept) == 30 and len(kept) + sum(r.n for r in lost) <= n
    return round(took, 3)


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    scratch = tempfile.mkdtemp(prefix="lumisift-bench-")
    from lumisift.session import session

    spark = session(
        "lumisift-bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.log.level": "ERROR", "spark.checkpoint.dir": f"file://{scratch}", "spark.sql.warehouse.dir": f"{scratch}/warehouse",
        },
    )
    from lumisift import catalogue

    chosen = {name: catalogue.QUERIES[name] for name in HEADLINES}
    with contextlib.suppress(ImportError):
        from lumisift.llm.queries import QUERIES

        chosen |= QUERIES
    only = set(sys.argv[1:])
    took: dict[str, float] = {}
    spark.read.parquet(f"{sf_dir}/part.parquet").count()  # start-up is not a query's
    for name, query in chosen.items():
        if only and name not in only:
            continue
        began = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()
    files = {} if only else {f"cull_{n}_files": culled(spark, n) for n in FOLDERS}
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "files": files}))


if __name__ == "__main__":
    main()
