"""Command line: start (stage, train), config (import, list, activate, show), report."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from axisflow.errors import AxisflowError
from axisflow.functions.session import session
from axisflow.operators.groups import Environment
from axisflow.plans import pipeline
from axisflow.sources.config import ConfigStore


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="axisflow")
    p.add_argument("--store", default="axisflow-configs", help="folder of the stored configurations")
    top = p.add_subparsers(dest="command", required=True)
    start = top.add_parser("start", help="run the active configuration").add_subparsers(dest="what", required=True)
    for what in ("stage", "train"):
        start.add_parser(what).add_argument("--out", help="Parquet folder for the result; without it, its schema is shown")
    config = top.add_parser("config", help="manage configurations").add_subparsers(dest="what", required=True)
    add = config.add_parser("import")
    add.add_argument("path"), add.add_argument("name"), add.add_argument("--runtime")
    config.add_parser("list")
    config.add_parser("show")
    config.add_parser("activate").add_argument("name")
    top.add_parser("report", help="what the session has")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or session()
    store = ConfigStore(spark, a.store)
    try:
        if a.command == "report":
            print(Environment.detect(spark).report())
        elif a.command == "config" and a.what == "import":
            with open(a.path, encoding="utf-8") as f:
                store.add(a.name, f.read(), a.runtime)
        elif a.command == "config" and a.what == "list":
            print("\n".join(store.names()))
        elif a.command == "config" and a.what == "show":
            print(store.active())
        elif a.command == "config":
            store.activate(a.name)
        else:
            for tag, df in pipeline.run(spark, store.active(), train=a.what == "train").items():
                if a.out:
                    df.write.mode("overwrite").parquet(f"{a.out}/{tag}")
                else:
                    print(tag)
                    df.printSchema()
    except (AxisflowError, OSError) as e:
        print(f"error: {e}")
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
