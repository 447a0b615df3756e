"""Hard negatives beyond the nearest neighbours."""

from corpusloom.operators import mining


def test_candidates_of_rank_21_to_100_count(spark):
    """50 nearer rows have texts too much alike; only the farthest row passes."""
    near = [(i, i, [1.0, 0.001 * i]) for i in range(51)]
    vectors = spark.createDataFrame([*near, (51, 51, [1.0, 1.0])], "vec_id long, label int, embedding array<double>")
    texts = spark.createDataFrame([*[(i, [1.0, 0.0]) for i in range(51)], (51, [0.0, 1.0])], "vec_id long, text array<double>")
    got = {r.vec_id: (r.negative, r.tier) for r in mining.hard_negatives(vectors, texts).collect()}
    assert got[0] == (51, 1)
