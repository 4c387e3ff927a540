"""Command line: python -m verdictlake.cli score PAIRS RESULTS OUT | report RESULTS PAIRS OUT | rulings JOURNAL OUT."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import guards, journal
from .plans import report
from .sources import readers, sinks


def main(args: list[str]) -> int:
    if len(args) < 3:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("verdictlake").getOrCreate()
    if args[0] == "score":
        pairs = readers.read_pairs(spark, args[1])
        guards.require_ruled(pairs)
        text = report.leaderboard(readers.read_votes(spark, args[2]), pairs, readers.roster(spark, args[2]))
    elif args[0] == "report":
        votes = readers.read_votes(spark, args[1])
        manifests = readers.read_manifests(spark, args[1])
        leg = args[1].rstrip("/").rsplit("/", 1)[-1]
        text = report.scenario(votes, readers.roster(spark, args[1]), None, readers.pair_order(spark, args[2]), leg, manifests=manifests)
    elif args[0] == "rulings":
        records = readers.read_journal(spark, args[1]).withColumn("session", F.lit("all"))
        sinks.export_rulings(journal.replay(records), args[2])
        return 0
    else:
        print(__doc__)
        return 2
    with open(args[3], "w", encoding="utf-8") as out:
        out.write(text)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
