import random

import pytest

from quillon.llm.components import components


@pytest.mark.parametrize("links_a_task", [7, 60, 200_000])
def test_equal_union_find(spark, links_a_task):
    r = random.Random(5)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000, 1000 + i) for i in range(1, 60)] + [(2000 + i, 2001 + i) for i in range(40)] + [(5, 5), (None, 3)]
    links += links[:20]
    comp = {}

    def root(i):
        while comp.setdefault(i, i) != i:
            i = comp[i]
        return i

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            comp[y] = x
    got = components(spark.createDataFrame(links, "a long, b long").repartition(5), links_a_task).collect()
    assert {x.id: x.component for x in got} == {i: root(i) for i in comp} and len(got) == len(comp)


def test_no_links(spark):
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
