"""The report without ground truth tallies its votes once, whatever it then says of them."""

from pyspark.sql import functions as F

from verdictlake.operators import agreement
from verdictlake.plans import catalog, report
from verdictlake.plans.report_queries import _order
from verdictlake.sources.fixtures import view


def test_votes_are_tallied_once(spark, sf):
    votes, seen = view(spark, sf, "votes"), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(verdict):
        seen.add(1)
        return verdict

    of = lambda v: report.scenario(v, view(spark, sf, "roster"), view(spark, sf, "calls"), _order(view(spark, sf, "pairs")), "s1")
    got = of(votes.withColumn("verdict", counted("verdict")))
    assert seen.value == votes.count()
    assert got == of(votes)


def test_words_are_packed_by_as_many_tasks(spark, sf):
    t, roster = catalog.tallied(spark, sf), view(spark, sf, "roster")
    assert agreement._packed(t, "verdict", 9).rdd.getNumPartitions() == 9
    assert agreement.agreement_matrix(t, roster, tasks=9).exceptAll(agreement.agreement_matrix(t, roster)).isEmpty()
    assert agreement.reason_cross_tab(t, 9).exceptAll(agreement.reason_cross_tab(t)).isEmpty()
