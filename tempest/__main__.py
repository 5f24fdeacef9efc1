"""Command-line runs (spark-submit or ``python -m tempest``):

    python -m tempest run --source <landing dir> --base <layer root> [--mode full|incremental|forecast]
                          [--kind historical|forecast] [--cities baku,ganja] [--as-of 2026-04-28]
                          [--start 2024-01-01] [--end 2026-04-28] [--force] [--chunk-rows N]
    python -m tempest publish --base <layer root> [--energy <documents>]

``run`` reads landed ``<city>_<kind>.csv`` files, writes the raw/staging/analytics layers,
runs the quality gates (printed) and appends an audit record; ``publish`` writes the marts.
"""

from __future__ import annotations

import argparse
import datetime as _dt

from tempest.session import drop_scratch, get_spark


def main(argv=None):
    ap = argparse.ArgumentParser(prog="tempest")
    sub = ap.add_subparsers(dest="cmd", required=True)
    run = sub.add_parser("run")
    run.add_argument("--source", required=True)
    run.add_argument("--base", required=True)
    run.add_argument("--mode", default="full", choices=["full", "incremental", "forecast"])
    run.add_argument("--kind", default="historical", choices=["historical", "forecast"])
    run.add_argument("--cities", default="")
    run.add_argument("--as-of", default=None)
    run.add_argument("--start", default=None, help="first date of the rows taken")
    run.add_argument("--end", default=None, help="last date of the rows taken (default: today)")
    run.add_argument("--force", action="store_true", help="incremental: reload from --start whatever is stored")
    run.add_argument("--chunk-rows", type=int, default=None)
    pub = sub.add_parser("publish")
    pub.add_argument("--base", required=True)
    pub.add_argument("--energy", default=None, help="energy documents, one JSON document per line")
    args = ap.parse_args(argv)

    spark = get_spark()
    if args.cmd == "run":
        from tempest.plans.runner import run_layers
        from tempest.sources.files import read_city_csvs

        source = read_city_csvs(spark, args.source, args.kind)
        cities = [c.strip() for c in args.cities.split(",") if c.strip()] or None
        date = lambda x: _dt.date.fromisoformat(x) if x else None
        as_of = date(args.as_of)
        end = date(args.end) or (as_of or _dt.date.today() if args.kind == "historical" else None)
        mode = "forecast" if args.kind == "forecast" else args.mode
        res = run_layers(spark, source, args.base, mode, args.kind, cities, as_of,
                         chunk_rows=args.chunk_rows, start=date(args.start), end=end, force=args.force)
        if res["checks"] is not None:
            res["checks"].orderBy("seq").show(truncate=False)
        res["audit"].show(truncate=False)
    else:
        from tempest.plans.publish import publish_marts

        for name, path in publish_marts(spark, args.base, args.energy).items():
            print(name, path)
    drop_scratch(spark)


if __name__ == "__main__":
    main()
