"""Command line (K7): resources in Parquet to a ranked workbook and CSV."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from .functions import relevance
from .plans import pipeline
from .sources import config, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftwork", description="Ranked opportunity signals of crawled public-sector documents.")
    p.add_argument("-s", "--site", action="append", required=True, help="site name; repeat for several, in order")
    p.add_argument("-S", "--sector", action="append", required=True, help="keyword pack; repeat for several, in order")
    p.add_argument("-o", "--output", default="data/output/signals.xlsx")
    p.add_argument("-c", "--config", default="config", help="folder with sectors.yaml and sites/")
    p.add_argument("-r", "--resources", required=True, help="Parquet table of fetched resources")
    p.add_argument("--max-pages", type=int, help="resources of each site at most")
    p.add_argument("--threshold", type=float, default=relevance.THRESHOLD)
    p.add_argument("--no-llm", action="store_true", help="keep the rules' titles; otherwise titles and notes come from the offline template")
    p.add_argument("--no-merge", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-y", "--yes", action="store_true", help="ask nothing")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("siftwork").getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if args.verbose else "WARN")
    packs = config.sectors(config.load(f"{args.config}/sectors.yaml"))
    unknown = [s for s in args.sector if s not in packs]
    if unknown:
        raise SystemExit(f"unknown sectors: {', '.join(unknown)}")
    every = spark.read.parquet(args.resources)
    frames, areas = [], {}
    for k, name in enumerate(args.site):
        site = config.site(name, args.config)
        rows = every.where(F.col("site") == name)
        if args.max_pages:
            rows = rows.orderBy("resource_no").limit(args.max_pages)
        areas[k] = site.get("neighborhoods") or []
        frames.append(rows.withColumns({"site_no": F.lit(k), "default_agency": F.lit(site.get("default_agency", "")), "default_geography": F.lit(site.get("default_geography", ""))}))
    resources = frames[0]
    for f in frames[1:]:
        resources = resources.unionByName(f)
    seen = Observation("relevance")
    enrich = None if args.no_llm else pipeline.offline_enrichment
    chosen = {s: packs[s] for s in args.sector}
    found = pipeline.run(resources, chosen, args.threshold, not args.no_merge, neighborhoods=areas, enrich=enrich, observation=seen).cache()
    sinks.write_workbook(found, args.output)
    sinks.write_csv(found, sinks.csv_path(args.output))
    if told := relevance.warning(seen.get, args.threshold):
        print(told, file=sys.stderr)


if __name__ == "__main__":
    main()
