"""Command line: weftwork.cli --csv FILE --json FILE --pdf FILE --txt FILE [-o OUT] [-c CONFIG]; --csv-large and --json-lines for large files."""

from __future__ import annotations

import argparse
import logging
import sys

VERSION = "1.0.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftwork", description="Golden records from CSV, JSON, PDF and text files.")
    for name in ("csv", "csv-large", "json", "json-lines", "pdf", "txt"):
        p.add_argument(f"--{name}", action="append", default=[], metavar="FILE", help="may be given more than once")
    p.add_argument("-o", "--output", metavar="FILE", help="a JSON array; with --lines a folder of JSON lines")
    p.add_argument("--lines", action="store_true", help="write JSON lines in parallel")
    p.add_argument("-c", "--config", metavar="FILE", help="pipeline.yaml, or a projection file alone")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--version", action="version", version=VERSION)
    return p


def inputs_of(args: argparse.Namespace) -> list[tuple[str, str]]:
    """In the order csv, json, pdf, txt, each kind of large file after its small one, whatever the order of the flags."""
    kinds = (("csv", args.csv), ("csv_large", args.csv_large), ("json", args.json), ("json_lines", args.json_lines), ("resume_pdf", args.pdf), ("resume_txt", args.txt))
    return [(source, path) for source, paths in kinds for path in paths]


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    inputs = inputs_of(args)
    if not inputs:
        print("Error: at least one input file is required.", file=sys.stderr)
        return 1
    if args.verbose:
        logging.getLogger().setLevel(logging.DEBUG)
    from .config import load, standard
    from .plans import pipeline

    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("weftwork").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    config = load(args.config) if args.config else standard()
    print(f"Processing {len(inputs)} input file(s)...")
    try:
        result = pipeline.run(spark, inputs, config, args.output, lines=args.lines)
        counts = result.metrics()
    except Exception as e:
        print(f"Pipeline error: {e}", file=sys.stderr)
        return 1
    print(f"  Inputs parsed:     {counts['total_inputs']}")
    print(f"  Candidate groups:  {counts['total_groups']}")
    print(f"  Rejected inputs:   {counts['rejected']}")
    if args.output:
        print(f"Output written to: {args.output}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
