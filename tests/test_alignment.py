"""Names some edits apart, however many there are."""

from lattica.operators.alignment import match_names


def test_rests_of_names_are_not_broadcast(spark):
    people = spark.createDataFrame([("a", "Customer"), ("b", "Costumer"), ("c", None)], "node string, name string")
    external = spark.createDataFrame([("x", "Custmer"), ("y", "Customer"), ("z", None)], "ext_id string, name string")
    found = match_names(people, external)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("a", "x", 1, "fuzzy"), ("a", "y", 0, "exact")]
