from pyspark.sql import functions as F

from quotelock.operators import receipts


def test_long_collections_are_valid_unless_a_bound_is_given(spark):
    counts = dict(previous_packet_count=150, next_packet_count=151, appended_packet_count=1, first_sequence=151, last_sequence=151)
    row = spark.range(1).select(*[F.lit(value).alias(name) for name, value in counts.items()])
    found = [receipts.transition_rules(*bound)[1][0] for bound in ((), (100,), (151,))]
    assert list(row.select(*found).first()) == [True, False, True]
