"""Connected components."""

import random

from quarterline.llm import shared


def test_long_chains_in_random_order_settle(spark):
    ids = list(range(1500))
    random.Random(4).shuffle(ids)
    chains = [ids[:1000], ids[1000:1490]]
    edges = [(a, b) for chain in chains for a, b in zip(chain, chain[1:])]
    odd = [(ids[1490], ids[1490]), (None, ids[1491]), (ids[1492], None), (ids[1493], ids[1494]), (ids[1494], ids[1493])]
    table = spark.createDataFrame(edges + edges[:5] + odd, "a long, b long")
    want = {k: min(chain) for chain in (*chains, ids[1493:1495]) for k in chain}
    got = [tuple(r) for r in shared.connected_components(table).collect()]
    assert len(got) == len(want) and dict(got) == want
    assert shared.connected_components(table.where("false")).count() == 0
