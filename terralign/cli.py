"""Commands: run, watch, verify-dataset, compare-transforms."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from . import pipeline
from .config import build_config
from .functions import frames as fr
from .operators import matching, mosaic
from .session import bounds, local_session
from .sinks import files
from .sources import images
from .sources.checkpoints import use_checkpoints
from .streaming import settle

AUDIT = ["frame_id", "lat", "lon", "altitude", "yaw", "pitch", "focal_length", "width", "height"]


def verify(spark, folder: str, csv: str | None = None) -> dict:
    """Counts of a folder, its first ten rejections and how many more there are; accepted frames as CSV if asked for."""
    frames = images.read_frames(spark, folder)
    one = frames.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reason").isNull()).alias("ok")).first()
    first = fr.first_rejections(frames, "path").select("path", "reason", "more").orderBy("path").collect()
    if csv:
        files.write_csv(frames.filter("reason IS NULL").orderBy("path").select(*AUDIT), csv)
    return {"total_found": one.n, "accepted": one.ok, "rejected": one.n - one.ok, "rejections": [(r.path, r.reason) for r in first], "more": first[0].more if first else 0}


def compare(spark, folder: str, matcher: str = "sift") -> list[dict]:
    """Affine against homography for each pair of neighbours of a folder, frames turned as their orientation says."""
    use_checkpoints(spark)
    planned = pipeline.plan_frames(images.read_frames(spark, folder).filter("reason IS NULL")).checkpoint()
    pairs = pipeline.plan.neighbor_graph(planned, 6, 80.0, "easting", "northing")
    points = mosaic.match(mosaic.extract(images.upright(images.read_pixels(spark, folder), planned), matcher, 2000, 1000), pairs).checkpoint()
    both = matching.compare_models(matching.pair_transforms(points, "affine"), matching.pair_transforms(points, "homography"))
    return [r.asDict() for r in both.orderBy("source_id", "target_id").collect()]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="terralign", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("run", "watch"):
        c = commands.add_parser(name)
        c.add_argument("--input", required=True)
        c.add_argument("--out", required=True)
        c.add_argument("--profile", default="pi-class")
        c.add_argument("--preset", default="balanced")
        c.add_argument("--matcher")
        c.add_argument("--model")
        c.add_argument("--tile-size", type=int)
        c.add_argument("--no-cog", action="store_true")
        c.add_argument("--no-tiles", action="store_true")
        c.add_argument("--settle", type=float, default=5.0)
    c = commands.add_parser("verify-dataset")
    c.add_argument("folder")
    c.add_argument("--csv")
    c = commands.add_parser("compare-transforms")
    c.add_argument("folder")
    c.add_argument("--matcher", default="sift")
    args = parser.parse_args(argv)
    if args.command == "verify-dataset":
        print(verify(local_session(), args.folder, args.csv))
    elif args.command == "compare-transforms":
        print(*compare(local_session(), args.folder, args.matcher), sep="\n")
    else:
        overrides = {"matcher": args.matcher, "transform_model": args.model, "tile_size": args.tile_size, "generate_cog": False if args.no_cog else None, "generate_tiles": False if args.no_tiles else None}
        config = build_config(args.profile, args.preset, overrides)
        spark = local_session(**bounds(config))
        if args.command == "run":
            print(pipeline.run(spark, args.input, args.out, config).to_json())
        else:
            settle.watch(spark, args.input, lambda n: print(n, pipeline.run(spark, args.input, args.out, config).to_json()), f"{args.out}/_watch", args.settle)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
