import os
import types

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.operators import ann, retrieval
from quillon.plans import stored
from quillon.plans.retrieval import QUERIES


def clustered(n, dim=24, groups=80, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dim))
    return (centres[r.integers(0, groups, n)] + 0.25 * r.normal(size=(n, dim))).astype(np.float32)


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, {})[r.doc_id] = (r["rank"], r.score)
    return out


def recall(got, want):
    return sum(len(set(got.get(q, ())) & set(ids)) for q, ids in want.items()) / sum(map(len, want.values()))


def exact(x, asked, k):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(u[asked] @ u.T, 6)
    return {q: sorted(range(len(x)), key=lambda j: (-row[j], j))[:k] for q, row in zip(asked, s, strict=True)}


def test_few_cells_are_read_and_nearly_all_neighbours_found(spark, tmp_path):
    x = clustered(6000)
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    root = f"file://{tmp_path}/index"
    ann.build(v.filter("vec_id < 5000"), root)
    ann.add(v.filter("vec_id >= 5000"), root)
    for asked in ([17], list(range(0, 6000, 300))):
        q = v.filter(F.col("vec_id").isin(asked)).withColumnRenamed("vec_id", "query_id")
        got = found(ann.top(spark, root, q, 10))
        want = exact(x, asked, 10)
        assert recall(got, want) >= 0.95 and all(len(ids) == 10 for ids in got.values())
        assert all(abs(s - float(np.dot(x[a].astype(float), x[d].astype(float)) / np.linalg.norm(x[a].astype(float)) / np.linalg.norm(x[d].astype(float)))) < 2e-6 for a, ids in got.items() for d, (_, s) in ids.items())
    one = ann.top(spark, root, v.filter("vec_id = 17").withColumnRenamed("vec_id", "query_id"), 10)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell#" in plan.split("PartitionFilters: [", 1)[1].split("]")[0]
    index = ann.load(spark, root)
    cells = ann._square(retrieval._unit(x[[17]].astype(float)), index.centroids).argsort(1)[0, : index.probes].tolist()
    codes = ann.versions.read(spark, root, "codes")
    assert codes.filter(F.col("cell").isin(cells)).count() < 0.1 * len(x) and codes.count() == len(x)
    found_twice = found(ann.top(spark, root, v.filter("vec_id % 300 = 0").withColumnRenamed("vec_id", "query_id"), 10, other=True, block=3))
    assert all(q not in ids for q, ids in found_twice.items())


def test_replaced_forgotten_broken_and_strange(spark, tmp_path):
    x = clustered(300, 7, 10)
    schema = "vec_id string, embedding array<double>"
    rows = [(f"v{i:03d}", e.tolist()) for i, e in enumerate(x.astype(float))] + [("null", None), ("zero", [0.0] * 7), ("hole", [None] + [1.0] * 6), ("long", [1.0] * 9), ("nan", [float("nan")] * 7)]
    root = f"file://{tmp_path}/index"
    first = ann.build(spark.createDataFrame(rows, schema), root, k=5)
    ann.add(spark.createDataFrame([("v001", x[7].astype(float).tolist()), ("new", x[8].astype(float).tolist()), ("short", [1.0])], schema), root)
    ann.forget(spark, root, spark.createDataFrame([("v008",)], "vec_id string"))
    asked = spark.createDataFrame([("a", x[7].astype(float).tolist()), ("b", x[8].astype(float).tolist()), ("c", None), ("d", [1.0])], "query_id string, embedding array<double>")
    got = found(ann.top(spark, root, asked, 2, probes=1000))
    assert set(got) == {"a", "b"} and set(got["a"]) == {"v001", "v007"} and got["b"]["new"][0] == 1 and "v008" not in got["b"]
    assert "v008" in found(ann.top(spark, root, asked, 2, at=first))["b"]
    assert ann.top(spark, root, asked.filter("query_id = 'c'"), 2).collect() == []


def test_a_task_holds_the_survivors_of_one_part_alone():
    x = retrieval._unit(clustered(400).astype(float))
    index = ann.fit(x, len(x), 8, 10, 0.97, 3)
    cell, code = ann.encode(index, x)
    read = []

    def batches():
        for part in range(5):
            read.append(part)
            for c in np.unique(cell):
                ids = np.flatnonzero(cell == c)
                asked = pa.array([[{"query_id": q, "question": x[q].tolist()} for q in range(part * 8, part * 8 + 8)]])
                columns = [pa.array([part], pa.int32()), pa.array([int(c)], pa.int32()), pa.array([ids.tolist()]), pa.array([code[ids].tobytes()]), asked]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "cell", "ids", "codes", "asked"])

    seen = {}
    for out in ann._ranked(types.SimpleNamespace(value=index), 5)(batches()):
        q = set(out.column("query_id").to_pylist())
        assert out.num_rows < 8 * 10 and max(q) // 8 >= max(read) - 1  # the part before the one that is read
        for a, d in zip(out.column("query_id").to_pylist(), out.column("vec_id").to_pylist(), strict=True):
            seen.setdefault(a, []).append(d)
    assert set(seen) == set(range(40)) and sum(q in ids for q, ids in seen.items()) > 30 and all(len(ids) >= 5 for ids in seen.values())


def test_no_vectors_and_few(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    ann.build(none, f"file://{tmp_path}/none")
    assert ann.top(spark, f"file://{tmp_path}/none", spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<float>")).collect() == []
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    ann.build(two, f"file://{tmp_path}/two")
    assert found(ann.top(spark, f"file://{tmp_path}/two", two.withColumnRenamed("vec_id", "query_id")))[1] == {1: (1, 1.0), 2: (2, 0.0)}


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
def test_recall_against_the_exact_query(spark):
    got, want = found(stored.ann_topk(spark, SF)), found(QUERIES["dense_topk"](spark, SF))
    assert set(got) == set(want) and recall(got, want) >= 0.95
