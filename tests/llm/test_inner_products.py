"""Exact top-k inner products against all pairs."""

import math
import random

import numpy as np
import pytest
from conftest import FOLDER

from check_oracle import compare, connect
from cdclake.llm import inner_products as ip
from cdclake.llm.queries import ORACLES, QUERIES

DDL = "vec_id LONG, embedding ARRAY<DOUBLE>, v STRING, dim STRING, rank STRING, ids STRING"
SMALL = ip.Settings(block=64, asked=8, chunk=16)


def brute(data, k=5, scale=256):
    """From (id, vector) rows, in Python integers."""
    rows = {(i, tuple(math.floor(x * scale) for x in v)) for i, v in data
            if i is not None and v is not None
            and all(x is not None and math.isfinite(x) for x in v)}
    asked = {}
    for i, v in rows:
        if i % 50 == 0:
            asked[i] = max(asked.get(i, (len(v), v)), (len(v), v))
    out = []
    for q, (_, w) in asked.items():
        found = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in rows
                       if i != q and len(v) == len(w))
        out += [(q, rank + 1, i, -score) for rank, (score, i) in enumerate(found[:k])]
    return sorted(out)


def found(spark, data, settings=SMALL):
    df = spark.createDataFrame([(i, v, *("x",) * 4) for i, v in data], DDL)
    got = ip.search(ip.index(df, settings), df.where("vec_id % 50 = 0"), settings)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in got.collect())


def drawn(count, dim, seed, spread=1.0, decay=1.0):
    """Vectors of lengths that differ by `spread`, in directions of falling weight."""
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(count, dim)) * decay ** np.arange(dim)
    x = x @ np.linalg.qr(draw.normal(size=(dim, dim)))[0]
    return [(i, row.tolist()) for i, row in enumerate(x * np.exp(
        spread * draw.normal(size=(count, 1))))]


def test_same_rows_as_sql(spark):
    assert compare(spark, connect(FOLDER), FOLDER, "op11_top_k", QUERIES["op11_top_k"],
                   ORACLES["op11_top_k"]) is None


@pytest.mark.parametrize("spread, decay", [(0.0, 1.0), (1.0, 0.7)])
def test_against_all_pairs(spark, spread, decay):
    data = drawn(1500, 24, 5, spread, decay)
    assert found(spark, data) == brute(data)


def test_ties_copies_and_unusable_vectors(spark):
    draw = random.Random(2)
    data = [(i, [draw.choice([-1, 0, 1]) / 256 for _ in range(4)]) for i in range(400)]
    data += [(400 + i, [0.5, 0.25, -0.5, 0.0]) for i in range(200)] + data[:30]
    data += [(0, [0.9, 0.9, 0.9, 0.9]), (50, [0.0] * 4), (650, [1.0, 2.0]), (651, [2.0, 1.0]),
             (700, None), (None, [1.0] * 4), (750, [1.0, None, 0.0, 0.0]), (800, []),
             (801, [float("nan")] * 4), (802, [float("inf"), 0.0, 0.0, 0.0]), (850, [7.0])]
    draw.shuffle(data)
    assert found(spark, data) == brute(data)


def test_sums_beyond_doubles(spark):
    draw = random.Random(3)
    data = [(i, [draw.randint(-2 ** 21, 2 ** 21) + draw.random() for _ in range(3)])
            for i in range(120)]
    assert found(spark, data) == brute(data)


def test_lengths_and_partial_sums_prune(monkeypatch):
    """On vectors of falling length and weight few pairs are multiplied out."""
    data = drawn(2000, 32, 7, 1.0, 0.6)
    x = np.floor(256 * np.array([v for _, v in data]))
    order = np.argsort(-np.sqrt((x * x).sum(1)), kind="stable")
    rotation = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()
    row = {"dim": 32, "vectors": x[order].tobytes(), "ids": order.astype(np.int64).tobytes(),
           "begins": np.arange(2001).tobytes()}
    settings, counts = ip.Settings(chunk=64), []
    plain = ip.products
    monkeypatch.setattr(ip, "products", lambda left, right, i, j: (
        counts.append((len(i), left.shape[1])), plain(left, right, i, j))[1])
    asked = np.arange(0, 2000, 50)
    ids, found_ids, scores = ip.answer(
        ip.Block(row, rotation, settings.parts), rotation, asked, x[asked],
        np.full(40, -np.inf), settings)
    assert sum(n for n, width in counts if width == 32) < 0.1 * 40 * 2000
    for q in asked.tolist():
        right = sorted((-int(s), i) for i, s in enumerate(x @ x[q]) if i != q)[:5]
        assert sorted((-s, i) for a, i, s in zip(ids, found_ids, scores) if a == q) == right


def test_of_nothing(spark):
    assert found(spark, []) == []
    assert found(spark, [(50, [1.0])]) == []
    assert found(spark, [(1, [1.0]), (2, [1.0])]) == []
