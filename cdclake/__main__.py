"""Jobs from the command line: spark-submit run_job.py <job> [options], or python -m cdclake."""

import argparse
from dataclasses import fields

from cdclake.plans import jobs
from cdclake.session import get_session, prepare
from cdclake.sinks.tables import write_csv_table
from cdclake.sources.files import tpch_customer
from cdclake.sources.generator import generate_ecommerce


def _generate(spark, cfg, args):
    for name, df in generate_ecommerce(prepare(spark), args.scale, args.seed).items():
        write_csv_table(df, f"{args.path}/{name}")


def _ingest(spark, cfg, args):
    jobs.run_ingest(spark, cfg, once=args.once)


def _maintain(spark, cfg, args):
    jobs.run_maintain(spark, cfg, once=args.once)


def _refresh(spark, cfg, args):
    jobs.run_pipeline(spark, cfg).show(truncate=False)


def _etl(spark, cfg, args):
    count, best = jobs.run_etl(spark, cfg, tpch_customer(spark, args.path))
    print(f"{count} rows", *best, sep="\n")


def _demo(spark, cfg, args):
    count, amount, rows = jobs.demo_events(spark, cfg)
    print(f"{count} rows, amount {amount}")
    rows.show(truncate=False)


JOBS = {"generate": _generate, "ingest": _ingest, "maintain": _maintain, "refresh": _refresh,
        "etl": _etl, "demo": _demo}


def main(argv=None, spark=None):
    parser = argparse.ArgumentParser(prog="cdclake", description=__doc__)
    parser.add_argument("job", choices=JOBS)
    parser.add_argument("--path", help="folder of CSV output, or of the benchmark tables")
    parser.add_argument("--scale", type=float, default=1.0)
    parser.add_argument("--seed", type=int, default=42)
    parser.add_argument("--once", action="store_true", help="ingest what is there, then stop")
    for field in fields(jobs.LakeConfig):
        parser.add_argument(f"--{field.name.replace('_', '-')}", default=field.default)
    args = parser.parse_args(argv)
    cfg = jobs.LakeConfig(**{f.name: getattr(args, f.name) for f in fields(jobs.LakeConfig)})
    JOBS[args.job](spark or get_session(f"cdclake {args.job}"), cfg, args)


if __name__ == "__main__":
    main()
