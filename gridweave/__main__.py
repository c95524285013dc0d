"""``python -m gridweave --config run.toml``: a whole run, and what came of it."""

import argparse

from gridweave import config


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="gridweave", description=__doc__)
    parser.add_argument("--config", required=True, help="path of a TOML file")
    own = config.check(config.load(parser.parse_args(arguments).config))

    from pyspark.sql import SparkSession

    from gridweave.plans import pipeline

    spark = SparkSession.builder.appName("gridweave").getOrCreate()
    paths, problems, summary = pipeline.run_and_write(spark, own)
    for table, path in sorted(paths.items()):
        print(f"{table}: {path}")
    problems.show(truncate=False)
    summary.show(1000, truncate=False)


if __name__ == "__main__":
    main()
