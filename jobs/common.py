"""Config, logging and the session of a command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

log = logging.getLogger("nichesearch.jobs")


def config(spark: SparkSession, path: str) -> dict[str, Any]:
    """A JSON file of the driver's, or, by a URI, one that Spark reads."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0] if "://" in path else Path(path).read_text())


def main(name: str, inputs: dict[str, str], run: Callable[..., Any]) -> None:
    """A command line: ``--config``, one option an input, ``--output``; makes the session and stops it."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=run.__doc__)
    for option, told in (inputs | {"output": "folder of the results", "config": "JSON file of the job's settings"}).items():
        parser.add_argument(f"--{option}", required=True, help=told)
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        settings = config(spark, given.pop("config"))
        run(spark, *[given[k] for k in inputs], given["output"], settings)
    finally:
        spark.stop()
