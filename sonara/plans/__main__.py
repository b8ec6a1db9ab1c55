"""Command line: ``python -m sonara.plans <job> ...`` with the session's own configuration.

Jobs: ``package ROOT OUT`` builds and publishes a dataset package; ``trials MANIFEST OUT --total N`` writes balanced
trials and their identity; ``cache MANIFEST FEATURES CONFIG OUT`` builds a feature cache; ``report TRIALS EMBEDDINGS OUT`` scores trials; ``final TRIALS EMBEDDINGS OUT`` with either
``--check`` or ``--run`` does the same once for the final test.  Tables are Parquet.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..operators import caches, trials
from ..sources import tables
from . import package


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sonara.plans")
    jobs = top.add_subparsers(dest="job", required=True)
    p = jobs.add_parser("package")
    p.add_argument("root")
    p.add_argument("out")
    p.add_argument("--expected", type=int)
    p = jobs.add_parser("trials")
    p.add_argument("manifest")
    p.add_argument("out")
    p.add_argument("--total", type=int, required=True)
    p = jobs.add_parser("cache")
    for x in ("manifest", "features", "config", "out"):
        p.add_argument(x)
    for name in ("report", "final"):
        p = jobs.add_parser(name)
        for x in ("trials", "embeddings", "out"):
            p.add_argument(x)
    either = p.add_mutually_exclusive_group(required=True)
    either.add_argument("--check", action="store_true")
    either.add_argument("--run", action="store_true")
    return top


def main(words: list[str] | None = None) -> None:
    a = parser().parse_args(words)
    spark = SparkSession.builder.getOrCreate()
    if a.job == "package":
        print(package.create_package(spark, a.root, a.out, a.expected))
    elif a.job == "trials":
        rows = spark.read.parquet(a.manifest).selectExpr("relative_audio_path as path", "speaker_id")
        made = trials.with_trial_ids(trials.genuine_trials(rows, a.total), trials.impostor_trials(rows, a.total), "trial-")
        print(tables.write_exact(made, f"{a.out}/trials"), tables.write_exact(caches.trial_identity(made, rows), f"{a.out}/identity"))
    elif a.job == "cache":
        print(package.build_cache(*(spark.read.parquet(x) for x in (a.manifest, a.features, a.config)), a.out))
    else:
        made, embeddings = spark.read.parquet(a.trials), spark.read.parquet(a.embeddings)
        if a.job == "final":
            package.final_evaluation(made, embeddings, a.out, a.check)
        else:
            tables.write_exact(package.evaluation_report(made, embeddings), a.out)


if __name__ == "__main__":
    main()
