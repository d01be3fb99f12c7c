"""What the language scores mean: calibration, unknown scripts, one answer for any partitions."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from cdclake.llm import language_id as L

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return L.train(L.learnable(docs))


def test_the_temperature_is_inside_its_range(model):
    assert 3 * L.LOWEST < model.temperature < L.HIGHEST / 3


def test_scores_are_as_often_right_as_they_say(docs, model):
    """On held-out texts and short stretches of them."""
    held = docs.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
                      & F.col("lang").isNotNull() & F.col("text").isNotNull()).collect()
    cases = [(part, r["lang"]) for r in held for part in [r["text"], *(
        " ".join(r["text"].split()[i:i + n]) for n, i in ((1, 0), (2, 5), (4, 9), (12, 3)))]
        if L.gram_counts(part, model.settings) is not None]
    langs, scores = L.predict(model, [c[0] for c in cases])
    right = np.array([a == b[1] for a, b in zip(langs, cases)])
    scores = np.array(scores)
    assert (~right).sum() > 10 and scores[~right].mean() < scores[right].mean() - 0.15
    for low, high in ((0.25, 0.6), (0.6, 0.9), (0.9, 1.01)):
        own = (scores >= low) & (scores < high)
        if own.sum() >= 50:
            assert abs(right[own].mean() - scores[own].mean()) < 0.15, (low, own.sum())
    whole = [i for i, c in enumerate(cases) if len(c[0].split()) > 30]
    assert right[whole].mean() > 0.97


def test_texts_of_a_script_never_learned_score_nothing(spark, docs, model):
    strange = ["今天天气很好，我们去公园散步。", "Сегодня хорошая погода", "안녕하세요 여러분"]
    assert L.predict(model, strange)[1] == [0.0, 0.0, 0.0]
    half = L.predict(model, ["the weather 今天天气很好我们去公园散步今天天气很好"])[1][0]
    assert half < 0.5
    table = spark.createDataFrame(list(enumerate(strange)), "doc_id LONG, text STRING")
    assert L.keep_identified(table, model, 0.3).isEmpty()
    assert L.keep_identified(docs, model, 0.3).count() >= 0.99 * docs.where(
        F.col("text").rlike("[A-Za-z]")).count()


def test_the_same_answer_for_any_partitions(docs, model):
    small = L.Settings(per_language=40, epochs=1)
    some = docs.where("doc_id % 5 = 0").select("doc_id", "text", "lang")
    one, seven = L.train(some.coalesce(1), small), L.train(some.repartition(7), small)
    assert (one.weights == seven.weights).all() and one.temperature == seven.temperature
    assert rows(L.identify(some, one)) == rows(L.identify(some, seven))


def test_without_an_error_a_best_temperature_is_there():
    logits = np.array([[2.0, -2.0], [-1.5, 1.5], [3.0, 0.0]])
    assert L.LOWEST * 3 < L.best_temperature(logits, np.array([0, 1, 0])) < L.HIGHEST / 3
    assert L.best_temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0
