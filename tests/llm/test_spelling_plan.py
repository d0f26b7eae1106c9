"""What the spelling operator sends to the driver."""

from shoalgrid.llm import spelling


def test_parts_of_words_are_not_broadcast(spark):
    """Only the bigrams are, whose number the alphabet bounds; the planner would take a word's parts for small."""
    words = spark.createDataFrame([("spelling",), ("speling",), ("other words",)], "word string")
    near = spelling.near_words(words)
    assert len(near.collect()) == 2
    lines = near._jdf.queryExecution().executedPlan().toString().splitlines()
    joins = [x for x in lines if "BroadcastHashJoin" in x]
    assert joins
    assert all("[gram#" in x for x in joins), joins
