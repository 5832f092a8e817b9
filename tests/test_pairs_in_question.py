"""Running counts of pairs of people are made only where something is asked, and are the same there."""

from pyspark.sql import functions as F

from gossamer.operators import corroborate as C
from gossamer.sources import adapter as A


def test_counts_of_pairs_in_question_only(spark):
    sf = "/root/testdata/sf0.01"
    dm = A.dim_metric(spark)
    asked = A.signals(spark, sf).filter("seq % 3 > 0").withColumn("unsettled", F.col("seq") % 97 == 1).withColumn("weighed", F.col("seq") % 101 == 2)
    every = C.agreements(C.judged_neighbors(asked, dm, ("unsettled", "weighed")))
    some = C.agreements_in_question(asked, dm)
    assert some.count() < every.filter("o_kind IN ('human', 'bot')").count() / 2
    cols = ["seq", "o_seq", "a", "b", "together", "weight", "weighed", "o_unsettled"]
    pick = lambda df: sorted(map(tuple, C.weighted(df, ("weighed", "o_unsettled")).filter("weighed OR o_unsettled").select(*cols).collect()))
    want = pick(every)
    assert pick(some) == want and len(want) > 5
