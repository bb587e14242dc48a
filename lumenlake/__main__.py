"""python -m lumenlake --catalog FOLDER VERB ...: the catalogue's verbs over Parquet tables.

FOLDER holds photos.parquet, tags.parquet, segments.parquet, members.parquet, faces.parquet,
people.parquet, jobs.parquet, embeddings.parquet; a verb reads those it needs. Results are shown.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.functions import fuzzy
from lumenlake.operators import facets, grouping, jobs, vectors
from lumenlake.plans.query import Catalog, Order, Query, run
from lumenlake.plans.service import Library
from lumenlake.session import SETTINGS
from lumenlake.sources import ingest


def words_of(photos: DataFrame, tags: DataFrame) -> DataFrame:
    columns = [c for c in ("camera_make", "camera_model", "lens", "place_city", "place_country", "file_name", "ai_caption") if c in photos.columns]
    return fuzzy.vocabulary([(tags, "tag"), *[(photos, c) for c in columns]])


def execute(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{args.catalog}/{name}.parquet")
    catalog = lambda: Catalog(read("photos"), read("tags"), read("segments"), read("members"))
    order = Order(args.order)
    match args.verb:
        case "import":
            files, _ = ingest.discover(spark, args.words)
            rows = ingest.photo_rows(files)
            rows.write.mode("append").parquet(f"{args.catalog}/incoming.parquet")
            return ingest.outcomes(read("photos"), rows)
        case "search" | "sort" | "describe":
            q = Query(text=" ".join(args.words) or None, camera=args.camera, city=args.city, country=args.country, object=args.object, min_rating=args.rating, order=order, limit=args.limit, offset=args.offset)
            return run(catalog(), q)
        case "find":
            c = catalog()
            return Library(c, vocabulary=words_of(c.photos, c.tags)).search(Query(text=" ".join(args.words), order=order, limit=args.limit)).hits
        case "vsearch":
            return vectors.similar_to(read("embeddings"), int(args.words[0]), args.limit)
        case "facets":
            return facets.all_facets(read("photos"), read("tags"), read("segments"))
        case "objects":
            return facets.objects(read("segments"))
        case "stats":
            return facets.span_and_busiest(read("photos"))
        case "rail":
            return facets.time_rail(read("photos"))
        case "vocab":
            return words_of(read("photos"), read("tags")).orderBy(F.char_length("term").desc(), "term")
        case "suggest":
            return fuzzy.suggest(args.words[0], words_of(read("photos"), read("tags")))
        case "dupes":
            return grouping.near_duplicate_groups(read("photos"))
        case "people":
            return grouping.people_groups(read("faces"), vectors.FACE_DEFAULT)
        case "faces":
            return read("faces").orderBy(F.desc(F.sqrt("area") * 0.7 + F.col("confidence") * 0.3), "id").limit(args.limit)
        case "who":
            return facets.named_people(read("people"), read("faces"))
        case "albums":
            return facets.facet(read("members"), F.col("collection_id"), "album")
        case "pipeline":
            return jobs.status(read("jobs"))
    raise ValueError(args.verb)


VERBS = ("import", "search", "sort", "describe", "find", "vsearch", "facets", "objects", "stats", "rail", "vocab", "suggest", "dupes", "people", "faces", "who", "albums", "pipeline")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lumenlake", description=__doc__)
    p.add_argument("--catalog", required=True)
    p.add_argument("verb", choices=VERBS)
    p.add_argument("words", nargs="*")
    for name in ("camera", "city", "country", "object"):
        p.add_argument(f"--{name}")
    p.add_argument("--rating", type=int)
    p.add_argument("--order", default=Order.CAPTURED_DESCENDING.value, choices=[o.value for o in Order])
    p.add_argument("--limit", type=int, default=50)
    p.add_argument("--offset", type=int, default=0)
    args = p.parse_args(argv)
    builder = SparkSession.builder.appName("lumenlake")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    execute(builder.getOrCreate(), args).show(args.limit, truncate=60)


if __name__ == "__main__":
    main()
