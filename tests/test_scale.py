"""Joins and selections that no task or group holds whole."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import containment, metrics


@pytest.mark.parametrize("seed", [1, 2])
def test_containment_equals_all_pairs(spark, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abÉ c", k=r.choice([0, 1, 2, 3, 4, 5, 9])))
    a, b = [None, "", *(word() for _ in range(80))], [None, "", *(word() for _ in range(60))]
    df = lambda x: spark.createDataFrame([(s,) for s in x], "name string")
    want = {(x.lower(), y.lower()) for x in a if x for y in b if y and (x.lower() in y.lower() or y.lower() in x.lower())}
    assert {tuple(x) for x in containment.pairs(df(a), df(b)).collect()} == want
    got = containment.related(df(a), df(b))
    assert sorted(x.name for x in got.collect()) == sorted({x for x, _ in want})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_containment_in_many_partitions_equals_all_pairs(spark, seed):
    r = random.Random(seed)
    word = lambda most: "".join(r.choices("abÉ😀", (4, 3, 1, 1), k=r.randrange(most)))
    df = lambda x: spark.createDataFrame([(s,) for s in x], "name string")
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for most_a, most_b in ((8, 12), (12, 8)):
            # in the second, names are long and hold few of the others
            a, b = [word(most_a) for _ in range(150)], ["ba" * seed + word(most_b) for _ in range(60)]
            want = {x.lower() for x in a for y in b if x and (x.lower() in y.lower() or y.lower() in x.lower())}
            got = [x.name for x in containment.related(df(a), df(b)).collect()]
            assert sorted(got) == sorted(want)
        assert containment.related(df(["a", None]), df([])).collect() == containment.related(df([""]), df(["a"])).collect() == []
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_containment_of_names_that_share_all_grams(spark):
    """Eight grams in all: by its rarest gram a name would meet an eighth of the others at least."""
    letters = lambda c, size: F.translate(F.lpad(F.bin(c), size, "0"), "01", "ab")
    a = spark.range(0, 1 << 18, 3).select(letters(F.col("id") * 4 + 1, 20).alias("name"))
    b = spark.range(0, 1 << 18, 5).select(F.concat(letters(F.col("id") * 4 + 1, 20), F.lit("b")).alias("name"))
    began = time.perf_counter()
    got = {x.name for x in containment.related(a, b).collect()}
    assert time.perf_counter() - began < 60
    held = {x.name for x in a.collect()}
    assert got == {x.name[i : i + 20] for x in b.collect() for i in (0, 1)} & held


def test_citation_precision_among_equals_the_one_with_an_array(spark):
    answers = ["As stated [Source: src1, p. 3].", "See [Ref: SRC12] and [Src: unknown, Article 4].", "Nothing.", "[source: src, p. 1] [Source: ]", None, "[Source: src3, p. 2][Source: other]"]
    names = ["src1", "SRC12", "other", ""]
    df = spark.createDataFrame(list(enumerate(answers)), "id int, answer string")
    want = {x.id: x.p for x in df.select("id", metrics.citation_precision(F.col("answer"), F.array(*map(F.lit, names))).alias("p")).collect()}
    got = {x.id: x.precision for x in metrics.citation_precision_among(df, spark.createDataFrame([(n,) for n in names], "name string"), ["id"]).collect()}
    assert {i: p or 0.0 for i, p in want.items()} == got


def test_percentiles_equal_numpy(spark):
    r = np.random.default_rng(3)
    groups = {"a": r.normal(size=4000), "b": r.integers(0, 5, 900).astype(float), "c": np.array([7.0]), None: r.normal(size=50) * 1e9}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("a", None), ("d", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    shares = [0.0, 0.25, 0.5, 0.95, 0.999, 1.0]
    got = {x.g: x for x in metrics.percentiles(df, "v", ["g"], shares).collect()}
    assert set(got) == {*groups, "d"} and got["d"].n == 0 and got["d"].p is None
    for g, v in groups.items():
        assert got[g].n == len(v) and got[g].p == pytest.approx(np.quantile(v, shares).tolist(), rel=1e-9, abs=1e-12)
    whole = np.concatenate(list(groups.values()))
    assert metrics.percentiles(df, "v", [], shares).first().p == pytest.approx(np.quantile(whole, shares).tolist(), rel=1e-9, abs=1e-9)
    assert metrics.percentiles(df.filter("v > 1e300"), "v", [], shares).collect()[0].n == 0
    one = metrics.latency(df, "v", "g").filter("g = 'b'").first()
    assert (one.p50, one.n) == (np.median(groups["b"]), 900)


def test_edit_distance_by_diagonals_and_bits_equals_the_table():
    r = random.Random(5)
    points = lambda x: np.frombuffer(x.encode("utf-32-le"), np.uint32)

    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for _ in range(300):
        a = "".join(r.choices("abé", k=r.randrange(30)))
        b = "".join(r.choices("abé", k=r.randrange(30))) if r.random() < 0.5 else a[: r.randrange(len(a) + 1)] + r.choice(["", "x", "yy"]) + a[r.randrange(len(a) + 1) :]
        assert metrics.edit_distance(a, b) == table(a, b) == metrics._by_bits(points(a), points(b)) == metrics._by_diagonals(points(a), points(b), 10**9)


def test_edit_distance_of_long_texts_costs_by_their_distance():
    r = random.Random(6)
    a = "".join(r.choices("abcdefgh ", k=10_000_000))
    b = list(a)
    for k, i in enumerate(r.sample(range(len(a)), 100)):
        b[i] = "Z" if k % 3 == 0 else b[i] + "Q" if k % 3 == 1 else ""
    began = time.perf_counter()
    assert metrics.edit_distance(a, "".join(b)) == 100
    assert time.perf_counter() - began < 10


def test_edit_distance_of_many_substitutions_costs_by_the_length():
    r = random.Random(7)
    began = time.perf_counter()
    for head in ("ab", "cd", "ce"):  # bounds meet, or leave one or some diagonals
        a = head + "".join(r.choices("abcde fghé", k=200_000))
        distance = metrics.edit_distance(a, a[2:].replace("e", "c"))
        assert a.count("e", 2) <= distance <= a.count("e", 2) + 2
    assert time.perf_counter() - began < 10
    for _ in range(400):
        a = "".join(r.choices("aceé", k=r.randrange(60)))
        b = a[r.randrange(3) :].replace("e", "c") + r.choice(["", "x", "ca"])
        assert metrics.edit_distance(a, b) == metrics._by_bits(*(np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in (a, b)))
