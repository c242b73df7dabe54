"""Commands: train and write an index, measure it, serve it.

    python -m nearfold index --input references.json.gz --output index --coarse 128 --fine 64
    python -m nearfold bench --index index --n 1000 --k 5
    python -m nearfold serve --index index --normalization normalization.json --mcc-risk mcc_risk.json --port 8080

An index is a folder of Parquet files, or one binary file if its name ends in ``.bin``.
"""

from __future__ import annotations

import argparse
import os
import resource
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from nearfold.functions.features import DIMS
from nearfold.operators import ivf, kmeans, scoring
from nearfold.plans.engine import Engine
from nearfold.serving import server
from nearfold.session import stored, sweep
from nearfold.sources.files import load_resources, random_vectors, read_references


def session(name: str) -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate()


def load(spark: SparkSession, path: str) -> ivf.Index:
    return ivf.from_binary(spark, path, DIMS) if path.endswith(".bin") else ivf.load(spark, path, DIMS)


def memory_mb() -> dict[str, float]:
    """The driver's memory just now and the most it was; executors' are in Spark's metrics."""
    with open("/proc/self/statm", encoding="ascii") as f:
        now = int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6
    return {"now": round(now, 1), "most": round(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1e3, 1)}


def index(spark: SparkSession, source: str, output: str, coarse: int, fine: int, iterations: int, seed: int) -> ivf.Index:
    """Reads references, trains both levels, and writes the index."""
    references = stored(read_references(spark, source), "references")
    centroids = kmeans.two_level(references, DIMS, coarse, fine, iterations, seed=seed)
    made = ivf.build(references, centroids.select("c_id", "centroid"), DIMS)
    ivf.to_binary(made, output) if output.endswith(".bin") else ivf.write(made, output)
    return made


def bench(spark: SparkSession, path: str, n: int, k: int, probes: int, seed: int) -> dict:
    """Seconds of searches for ``n`` random queries, in ten lots, and the labels' recall against all partitions."""
    made = load(spark, path).cache()
    made.lists.count()
    queries = random_vectors(spark, n, DIMS, seed).withColumnRenamed("vec_id", "q_id").cache()
    times = []
    for lot in range(10):
        own = queries.where(F.col("q_id") % 10 == lot)
        began = time.perf_counter()
        ivf.search_labels(own, made, k, probes, strategy="blocks").write.format("noop").mode("overwrite").save()
        times.append((time.perf_counter() - began,))
    stats = scoring.order_statistics(spark.createDataFrame(times, "seconds double"), "seconds").first().asDict()
    everywhere = ivf.search_labels(queries, made, k, made.partition_count(), strategy="blocks")
    recall = scoring.label_recall(everywhere, ivf.search_labels(queries, made, k, probes, strategy="blocks"), k).agg(F.avg("recall")).first()[0]
    made.close()
    return {"queries": n, "lots": 10, "seconds": {a: round(b, 4) for a, b in stats.items()}, "label_recall": recall, "memory_mb": memory_mb()}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="nearfold", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("index")
    for name, default in (("input", None), ("output", None), ("coarse", 128), ("fine", 64), ("iterations", 5), ("seed", 42)):
        p.add_argument(f"--{name}", type=type(default) if default is not None else str, default=default, required=default is None)
    p = commands.add_parser("bench")
    for name, default in (("index", None), ("n", 1000), ("k", 5), ("probes", 0), ("seed", 42)):
        p.add_argument(f"--{name}", type=type(default) if default is not None else str, default=default, required=default is None)
    p = commands.add_parser("serve")
    for name in ("index", "normalization", "mcc-risk"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--port", type=int, default=int(os.environ.get("PORT", "8080")))
    o = parser.parse_args(args)
    spark = session(f"nearfold {o.command}")
    try:
        if o.command == "index":
            made = index(spark, o.input, o.output, o.coarse, o.fine, o.iterations, o.seed)
            print({"partitions": made.partition_count(), "vectors": made.vector_count(), "memory_mb": memory_mb()})
        elif o.command == "bench":
            print(bench(spark, o.index, o.n, o.k, o.probes, o.seed))
        else:
            config, risks = load_resources(spark, o.normalization, o.mcc_risk)
            engine = Engine(load(spark, o.index), config, risks, strategy="blocks").prime()
            server(engine, o.port).serve_forever()
    finally:
        sweep(spark)
        spark.stop()


if __name__ == "__main__":
    main()
