import random

from folioscope.llm.groups import components


def test_components_of_long_paths_in_any_order(spark):
    """Paths whose ids fall, or are shuffled, along the way: one label each, whatever their length."""
    rng = random.Random(12)
    falling = [0, *range(399, 0, -1)]
    shuffled = rng.sample(range(1000, 1600), 600)
    edges = [e for path in (falling, shuffled) for e in zip(path, path[1:])]  # noqa: B905
    rng.shuffle(edges)
    got = {r.id: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(falling, 0), **dict.fromkeys(shuffled, 1000)}
