"""Whole jobs, read to written, and their command line.

    python -m milepost.jobs overlay --input a.csv --other b.csv --output out.csv
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from .functions.keys import PadRule
from .operators import packed, qc, report
from .operators.dissolve import dissolve
from .operators.locate import locate_points
from .operators.overlay import overlay_events
from .operators.routes import calibrate_routes, display_events
from .plans.schema import LrsSchema, advanced_fields, apply_route_pad, as_of
from .sources.tables import layer_projection, read_events, source_crs, write_events


def _load(spark: SparkSession, path: str, args: argparse.Namespace) -> DataFrame:
    """The table, in effect at the date asked for, route ids padded."""
    df = read_events(spark, path)
    if args.as_of:
        dates = advanced_fields(df.columns)
        df = as_of(df, args.as_of, dates["from_date"], dates["to_date"])
    road = LrsSchema.of(df).roadway
    return apply_route_pad(df, road, PadRule(args.pad, args.pad_width)) if road in df.columns else df


def _crs(spark: SparkSession, args: argparse.Namespace) -> str | None:
    """As named, else as the file says; else it is told from the vertices."""
    return args.crs or source_crs(spark, args.input)


def run_job(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    df = _load(spark, args.input, args)
    other = _load(spark, args.other, args) if args.other else None
    groups = args.groups.split(",") if args.groups else None
    if args.job in ("overlay", "locate") and other is None:
        raise ValueError(f"{args.job} needs --other")
    if args.job == "overlay":
        return overlay_events(df, other, how=args.how, collapse=args.collapse, method=args.method)
    if args.job == "dissolve":
        return dissolve(df, group_cols=groups, require_contiguous=not args.across_gaps)
    if args.job == "locate":
        return locate_points(df, other, how=args.how).located
    if args.job == "validate":
        return qc.validate(df, group_cols=groups).flat()
    if args.job == "calibrate":
        crs = _crs(spark, args)
        if layer_projection(df, crs).kind == "unknown":
            raise ValueError("lengths need a known system: name it with --crs")
        return calibrate_routes(df, crs or "EPSG:4326")
    if args.job == "display":
        return display_events(df, other, drop_empty=not args.keep_empty)
    if args.job == "extract":
        return packed.explode_routes(df, stub_length=args.stub)
    if args.job == "combine":
        return packed.combine_routes(df)
    return packed.inspect_keys(df)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="milepost")
    p.add_argument("job", choices=["overlay", "dissolve", "locate", "validate", "calibrate", "display", "extract", "combine", "inspect"])
    p.add_argument("--input", required=True)
    p.add_argument("--other", help="overlay, segments, or the events to display")
    p.add_argument("--output")
    p.add_argument("--how", default="left", choices=["left", "inner"])
    p.add_argument("--method", default="edges", choices=["edges", "cursor"])
    p.add_argument("--collapse", default="none", choices=["none", "longest"])
    p.add_argument("--groups", help="column names, with commas")
    p.add_argument("--across-gaps", action="store_true")
    p.add_argument("--keep-empty", action="store_true")
    p.add_argument("--stub", type=float, default=0.02)
    p.add_argument("--as-of")
    p.add_argument("--crs", help="of the input: a code or .prj text (else what the file says, else degrees if the vertices can be)")
    p.add_argument("--output-crs", default="wgs84", choices=["wgs84", "source"])
    p.add_argument("--pad", default="numeric", choices=["numeric", "all", "off"])
    p.add_argument("--pad-width", type=int, default=8)
    p.add_argument("--preview", type=int, default=40)
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("milepost").getOrCreate()
    out = run_job(spark, args)
    if args.job == "inspect":
        for level, text in report.report_lines(out):
            print(f"{level:5} {text}")
    if args.output:
        write_events(out, args.output, _crs(spark, args), args.output_crs)
    else:
        out.show(args.preview, truncate=False)


if __name__ == "__main__":
    main()
