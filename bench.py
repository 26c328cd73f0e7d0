"""Times the stages of an assembly of all documents; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the number of local cores.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import functions as F

from strandweave.operators import abundance, contigs, graph, kmers, mapping, reads, unitigs
from strandweave.session import local_session, save_scratch, spread
from strandweave.sources.text_reads import reads_from_text

K, MIN_COUNT, FLOOR, RELATIVE, MIN_HITS, MIN_LENGTH = 31, 2, 2, 0.05, 3, 100


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, app="bench", **{"spark.driver.extraJavaOptions": "-XX:+UseParallelGC"})
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, run):
        started = time.perf_counter()
        result = run()
        times[name] = round(time.perf_counter() - started, 3)
        return result

    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    every = timed("load", lambda: save_scratch(reads_from_text(docs, "doc_id")))
    stats = timed("read_stats", lambda: reads.read_stats(every).first())
    counts = timed("kmer_count", lambda: save_scratch(kmers.count_reads(every, K, MIN_COUNT)))
    # Counts below MIN_COUNT are gone, so an equal floor has nothing to remove.
    floor = FLOOR if FLOOR > MIN_COUNT else 0
    live = timed("prune", lambda: save_scratch(graph.prune(counts, K, floor, RELATIVE)))
    found = timed("unitigs", lambda: unitigs.compact_unitigs(live, K))
    long = timed("contigs", lambda: contigs.traverse_contigs(found, K, MIN_LENGTH))
    assigned = timed(
        "map_reads", lambda: save_scratch(mapping.map_reads(every, long, k=K, min_hits=MIN_HITS))
    )
    timed("abundance", lambda: abundance.abundance_from_assignments(long, assigned).agg(F.sum("tpm")).first())

    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "assembly_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf.group(1)) if sf else None,
                "cores": int(cpus),
                "reads": stats.n_reads + stats.n_dropped,
                "kmers": counts.count(),
                "unitigs": found.count(),
                "contigs": long.count(),
                "reads_per_sec_mapped": round(stats.n_reads / times["map_reads"]),
            }
        )
    )


if __name__ == "__main__":
    main()
