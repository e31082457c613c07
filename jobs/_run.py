"""What the jobs' command lines share: the config file, the session and the log."""

from __future__ import annotations

import argparse
import logging
import tomllib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def main(name: str, run: Callable[..., object]) -> None:
    """Runs a job as its config file says: [job] are the function's arguments, [spark] settings of the session."""
    args = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=run.__doc__)
    args.add_argument("config", help="a TOML file")
    args.add_argument("--set", action="append", default=[], metavar="KEY=VALUE", help="an argument of the job in place of the file's")
    given = args.parse_args()
    with open(given.config, "rb") as f:
        config = tomllib.load(f)
    job = config["job"] | {k: type(config["job"].get(k, ""))(v) for k, _, v in (x.partition("=") for x in given.set)}
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).config(map=config.get("spark", {})).getOrCreate()
    try:
        run(spark, **job)
    finally:
        spark.stop()


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that the job has written, or an empty one before its first run."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def overwrite(df: DataFrame, path: str, *by: str) -> None:
    """Writes the partitions that df has rows of; others stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
