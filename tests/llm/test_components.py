import random

import pytest

from chronotaxa.llm.components import connected_components
from chronotaxa.llm.shared import Stage

from .brute import roots


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_union_find(spark, seed):
    rng = random.Random(seed)
    links = [(i, i + 1) for i in range(0, 60)] + [(500, k) for k in range(400, 480)] + [(rng.randint(-50, 900), rng.randint(-50, 900)) for _ in range(150)] + [(3, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long"), Stage(spark, "t")).collect()}
    links = [(a, b) for a, b in links if a != b]
    assert got == roots({x for p in links for x in p}, links)
    assert connected_components(spark.createDataFrame([], "a long, b long"), Stage(spark, "t")).count() == 0
