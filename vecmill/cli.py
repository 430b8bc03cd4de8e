"""Cluster the vectors of a file: ``spark-submit vecmill/cli.py -i IN -o OUT [-n CLUSTERS] [-m ITERATIONS]``."""

from __future__ import annotations

import argparse
import logging
import os
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402

from vecmill.operators.kmeans import KMeans  # noqa: E402
from vecmill.plans.session import ship  # noqa: E402
from vecmill.sources.vecs import VecsDataSource, write_matrix  # noqa: E402


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="K-means over an fvecs file")
    parser.add_argument("-i", "--input", required=True, help="fvecs file or folder")
    parser.add_argument("-o", "--output", required=True, help="fvecs file for the centroids")
    parser.add_argument("-n", "--n-cluster", type=int, default=4096)
    parser.add_argument("-m", "--max-iter", type=int, default=25)
    args = parser.parse_args(argv)
    logging.basicConfig(stream=sys.stderr, level=os.environ.get("VECMILL_LOG", "INFO").upper())
    spark = SparkSession.builder.appName("vecmill").getOrCreate()
    ship(spark)
    spark.dataSource.register(VecsDataSource)
    vectors = spark.read.format("vecs").load(args.input)
    model = KMeans(args.n_cluster, args.max_iter, tolerance=0.01).fit(vectors)
    write_matrix(model.centroids, args.output)


if __name__ == "__main__":
    main()
