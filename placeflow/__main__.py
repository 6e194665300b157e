"""python -m placeflow search|grid|collect|place|reviews: recorded tables in, JSON lines, CSV, text or a collection out."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from placeflow.api import SORTS, Places
from placeflow.functions.geo import in_box
from placeflow.operators import collect, reports
from placeflow.sources import recorded


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="placeflow")
    parser.add_argument("command", choices=("search", "grid", "collect", "place", "reviews"))
    parser.add_argument("--tables", required=True, help="folder of recorded Parquet tables")
    parser.add_argument("--out", required=True)
    parser.add_argument("--format", choices=("json", "csv", "text"), default="json")
    parser.add_argument("--query", default="")
    parser.add_argument("--id", default="")
    parser.add_argument("--bbox", default="", help="min_lat,min_lon,max_lat,max_lon")
    parser.add_argument("--location", default="", help="name of a recorded area, instead of --bbox")
    parser.add_argument("--sort", choices=tuple(SORTS), default="most_relevant")
    parser.add_argument("--enrich", action="store_true", help="merge recorded details")
    parser.add_argument("--contacts", action="store_true", help="take contacts from recorded pages")
    parser.add_argument("--max-contacts", type=int, default=None, help="sites at most; also turns --contacts on")
    parser.add_argument("--cell-size", type=float, default=0.5)
    parser.add_argument("--resume", action="store_true")
    parser.add_argument("--max-results", type=int, default=500)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("placeflow").getOrCreate()

    def table(name: str):
        df = spark.read.parquet(f"{args.tables.rstrip('/')}/{name}.parquet")
        return df.withColumn("response", F.try_parse_json("response")) if "response" in df.columns else df

    budget = args.max_contacts if args.max_contacts is not None else 100 if args.contacts else 0
    need = {"search": ["responses"], "grid": ["grid_pages"], "collect": ["grid_pages"], "place": ["details"], "reviews": ["reviews"]}[args.command]
    need = need + ["details"] * args.enrich + ["pages"] * bool(budget) + ["locations"] * bool(args.location)
    places = Places({name: table(name) for name in need})
    if args.command in ("grid", "collect"):
        box = tuple(places.locate(args.location)["box"]) if args.location else tuple(float(x) for x in args.bbox.split(","))
        inside, settings = in_box(F.col("lat"), F.col("lon"), box), collect.Settings(cell_km=args.cell_size, max_results=args.max_results)
        if args.command == "collect":
            places.collect(args.out, args.query, box, inside, settings, args.resume, args.enrich, budget)
            return
        rows = places.grid_search(box, inside, settings).places
    elif args.command == "search":
        rows = places.search(args.query, max_results=min(20, args.max_results))
    elif args.command == "place":
        rows = places.get(args.id)
    else:
        rows = reports.review_rows(places.reviews(args.id, args.sort, args.max_results))
    if args.command in ("search", "grid"):
        rows = places.enrich(rows) if args.enrich else rows
        rows = places.contacts(rows, args.query, budget) if budget else rows
    write = {"json": recorded.write_json, "csv": recorded.write_csv, "text": recorded.write_text}[args.format]
    if args.command == "reviews" and args.format == "csv":
        rows.write.mode("overwrite").option("header", "true").csv(args.out)
    else:
        write(rows, args.out)


if __name__ == "__main__":
    main()
