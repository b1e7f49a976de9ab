"""Batch entry point: ``spark-submit opskpi/job.py --tables <dir> --out <dir> [--as-of ...]``.

Reads the ERP relations from Parquet (one dataset per relation under
``--tables``) or, with ``--jdbc``, from a database described by an options
file (see ``opskpi/sources/jdbc.py``); writes the KPI snapshot, tables and CSV exports
for one as-of time.  The checkpoint folder comes from the session's
``spark.checkpoint.dir`` (set it to shared storage on a cluster).
"""

from __future__ import annotations

import argparse
import json
from datetime import datetime

from pyspark.sql import SparkSession

from opskpi.functions.clock import AsOf
from opskpi.plans.snapshot import run_snapshot
from opskpi.session import ensure_checkpoint_dir
from opskpi.sources.driver import RELATIONS
from opskpi.sources.tables import Tables


def main(argv: list[str] | None = None) -> dict[str, str]:
    ap = argparse.ArgumentParser(description=__doc__)
    ap.add_argument("--tables", help="folder with one Parquet dataset per relation")
    ap.add_argument("--jdbc", help="JSON options file: read the relations from a database")
    ap.add_argument("--out", required=True, help="output folder (shared storage)")
    ap.add_argument("--as-of", default=None, help="evaluation time, ISO format (default: now)")
    ap.add_argument("--params", default="{}", help="JSON object of metric parameters")
    ap.add_argument("--no-exports", action="store_true")
    args = ap.parse_args(argv)

    spark = SparkSession.builder.appName("opskpi-snapshot").getOrCreate()
    ensure_checkpoint_dir(spark)
    names = [r.name for r in RELATIONS]
    if args.jdbc:
        from opskpi.sources import jdbc
        tables = jdbc.jdbc_tables(spark, jdbc.load_mapping(spark, args.jdbc), names)
    else:
        if not args.tables:
            ap.error("--tables is required unless --jdbc is given")
        tables = Tables.from_parquet(spark, args.tables, names)
    as_of = AsOf.parse(args.as_of) if args.as_of else AsOf(datetime.now().replace(microsecond=0))
    params = json.loads(args.params)
    for key in ("promised_after", "enquiry_from", "raised_after"):
        if key in params:
            params[key] = datetime.fromisoformat(params[key]).date()
    return run_snapshot(spark, tables, as_of, args.out, params, write_exports=not args.no_exports)


if __name__ == "__main__":
    main()
