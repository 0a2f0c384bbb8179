"""Near vectors at size: clusters need a forest only, and a task holds a tile of angles, not a whole batch."""

import numpy as np
import pyarrow as pa
import pytest

from factloom.operators import dedup, vector_join
from factloom.operators.components import components
from factloom.plans import store


def clusters(df):
    return {(r["node"], r["root"]) for r in components(df, "a", "b").collect()}


@pytest.mark.parametrize("chunk,share", [(4096, 500), (16, 20)])
def test_forest_connects_what_pairs_connect(spark, monkeypatch, chunk, share):
    monkeypatch.setattr(vector_join, "CHUNK", chunk)
    monkeypatch.setattr(vector_join, "ROWS_A_PIVOT", share)
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(40, 8)), 10, axis=0) + 0.2 * rng.normal(size=(400, 8))
    x[200:260] = x[200]  # copies
    df = spark.createDataFrame([(i, [float(a) for a in v], i % 3) for i, v in enumerate(x.astype(np.float32))], "id long, embedding array<float>, k int")
    for least in (0.3, 0.9):
        pairs, forest = vector_join.near(df, ["k"], least), vector_join.near(df, ["k"], least, forest=True)
        assert clusters(forest) == clusters(pairs)
        assert forest.count() < pairs.count()


def test_places_hold_a_tile():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 4)).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(3000, np.int64)), pa.array(np.arange(3000)), pa.array(list(x), pa.list_(pa.float32()))], ["grp", "id", "embedding"])

    class Pivots:
        value = {4: x[:50] / np.linalg.norm(x[:50], axis=1, keepdims=True)}

    out = list(vector_join._places(Pivots, 0.5)([batch]))
    assert sum((~b.column("asks").to_numpy(zero_copy_only=False)).sum() for b in out) == 3000
    assert max(len(set(b.column("id").to_pylist())) for b in out) <= 512


def test_merge_asks_for_a_forest(spark, small, monkeypatch):
    asked = []

    def near(rows, keys, least, forest=False):
        asked.append(forest)
        return vector_join.near(rows, keys, least, forest)

    monkeypatch.setattr(dedup, "near", near)
    assert store.merge_guard(spark, small).count() == 1
    assert asked == [True]
