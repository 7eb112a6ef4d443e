"""What is found of some rows doesn't go by how many others there are."""

import numpy as np

from apisieve.llm import lattice

from .test_near import near_pairs


def test_links_do_not_go_by_the_number_of_vectors(spark):
    """Pairs at the threshold, alone and beside as many unlike vectors as took another plan before."""
    rng = np.random.default_rng(12)
    u, v = near_pairs(400, 16, 0.931, rng)
    kind = "vec_id long, embedding array<double>, label long"
    pairs = spark.createDataFrame([(2 * k + j, x[k].tolist(), 1) for k in range(400) for j, x in enumerate((u, v))], kind)
    others = spark.range(10_000, 30_500, 1, 4).selectExpr("id AS vec_id", "transform(sequence(1, 64), k -> hash(id, k) / 2147483648D) AS embedding", "2L AS label")
    alone = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_vectors(pairs).collect()}
    beside = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_vectors(pairs.unionByName(others)).filter("vec_id < 10000").collect()}
    assert len(alone) == 800 and sum(n for n, _ in alone.values()) >= 0.9 * 800
    assert alone == beside
