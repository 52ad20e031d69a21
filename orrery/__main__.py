"""Command line: validate a specification, build it, or show what a store holds."""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="orrery")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("validate", "build"):
        command = commands.add_parser(name)
        command.add_argument("spec")
        if name == "build":
            command.add_argument("store")
            command.add_argument("--base")
    commands.add_parser("info").add_argument("store")
    options = parser.parse_args(argv)
    from orrery.plans import config

    if options.command == "validate":
        try:
            with open(options.spec) as file:
                config.parse(config.load_text(file.read()))
        except (ValueError, KeyError, TypeError) as error:
            print(f"invalid: {error}", file=sys.stderr)
            return 1
        print("valid")
        return 0
    from pyspark.sql import SparkSession

    from orrery.sources.store import Store

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark, options.store)
    if options.command == "build":
        with open(options.spec) as file:
            built = config.build(spark, config.parse(config.load_text(file.read())), options.base, store)
        print(json.dumps({n: {"rows": p.calibration.rows, "theta": p.calibration.theta} for n, p in built.items()}))
    else:
        print(json.dumps(store.manifest(), indent=1, sort_keys=True))
    return 0


if __name__ == "__main__":
    sys.exit(main())
