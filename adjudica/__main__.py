"""``python -m adjudica QUERY SF_DIR [--format json|quiet|sarif|console|table]``: runs a registered query and prints or renders it."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from . import queries
from .errors import AdjudicaError
from .sinks import report


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="adjudica", description=__doc__)
    parser.add_argument("query", choices=sorted(queries.queries()))
    parser.add_argument("sf_dir")
    parser.add_argument("--format", default="table", choices=["table", *sorted(report.RENDERERS)])
    parser.add_argument("--rows", type=int, default=20, help="rows of the table format")
    parser.add_argument("--output", help="folder to write the rendering to")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("adjudica").getOrCreate()
    try:
        df = queries.queries()[args.query](spark, args.sf_dir)
        if args.format == "table":
            df.show(args.rows, truncate=False)
        elif args.output:
            report.write(df, args.format, args.output)
        else:
            for row in report.render(df, args.format).toLocalIterator():
                print(row["value"])
    except AdjudicaError as e:
        print(e, file=sys.stderr)
        return e.exit_code
    return 0


if __name__ == "__main__":
    sys.exit(main())
