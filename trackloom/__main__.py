"""A command for each stage: python -m trackloom STAGE --TABLE PATH ... --out PATH [--ARGUMENT VALUE ...]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from trackloom.session import SETTINGS
from trackloom.stages import STAGES, run


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="trackloom", description=__doc__)
    stages = top.add_subparsers(dest="stage", required=True)
    for name, stage in STAGES.items():
        own = stages.add_parser(name, help=stage.run.__doc__)
        for table in stage.reads:
            own.add_argument(f"--{table}", required=True, help="a Parquet table")
        own.add_argument("--out", required=True)
        for argument, given in stage.arguments.items():
            own.add_argument(f"--{argument}", type=type(given), default=given)
    return top


def main(args: list[str] | None = None) -> None:
    got = vars(parser().parse_args(args))
    name, out = got.pop("stage"), got.pop("out")
    builder = SparkSession.builder.appName(f"trackloom {name}")
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    reads = STAGES[name].reads
    run(builder.getOrCreate(), name, {n: got.pop(n) for n in reads}, out, **got)


if __name__ == "__main__":
    main()
