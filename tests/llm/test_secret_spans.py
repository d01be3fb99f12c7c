"""Spans of secrets: clipping, masking, long tokens, work that grows with the text, training."""

import random
import time

import numpy as np
import pytest

from cdclake.llm import secrets


def words(rng, n):
    return [f"{rng.choice('aeioubcdst')}{rng.choice(['ran', 'lio', 'mest', 'or'])}"
            for _ in range(n)]


def key(rng, n=32):
    return "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789")
                   for _ in range(n))


def train_texts(n, seed=1):
    rng, out = random.Random(seed), []
    for i in range(n):
        line = words(rng, 40)
        if i % 2:
            line.insert(20, f'{rng.choice(["api_key", "token", "secret"])} = "{key(rng)}"')
        out.append(" ".join(line))
    return out


@pytest.fixture(scope="module")
def model():
    return secrets.fit(train_texts(300))


def plain_outside(text, tagged, base):
    """Code point by code point."""
    covered = set()
    for a, b, _ in base:
        covered.update(range(a, b))
    out = []
    for a, b in tagged:
        run = []
        for i in range(a, b + 1):
            if i < b and i not in covered:
                run.append(i)
            elif run:
                part = text[run[0]:run[-1] + 1]
                if any(c.isalnum() for c in part):
                    lead, trail = (len(part) - len(s) for s in (part.lstrip(), part.rstrip()))
                    out.append((run[0] + lead, run[-1] + 1 - trail, 3))
                run = []
    return out


def test_clipping_equals_a_look_at_every_character():
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice("ab1$ \"") for _ in range(60))
        ends = sorted(rng.sample(range(61), 8))
        tagged = list(zip(ends[::2], ends[1::2]))
        base = sorted((a, min(60, a + rng.randint(1, 15)), rng.randint(0, 2))
                      for a in (rng.randrange(60) for _ in range(rng.randint(0, 6))))
        assert secrets.outside(text, tagged, secrets.joined(base)) == plain_outside(
            text, tagged, base)


def test_the_tail_of_a_secret_beyond_its_pattern_is_masked(monkeypatch):
    text = "login password=pa55w0rd$ecretTail99 and more"
    at = text.index("pa55")
    monkeypatch.setattr(secrets, "tagged_spans", lambda model, texts: [[(at, at + 20)]])
    spans = secrets.find(object(), [text])[0]
    assert spans == [(6, 23, 0), (23, 35, 3)]
    assert secrets.masked(text, spans).replace(secrets.MASK, "") == "login  and more"


def test_secrets_in_forms_no_pattern_knows(model):
    """Other names and signs around the same sort of key: most found, little else."""
    rng, hit, planted, wrong, clean = random.Random(9), 0, 0, 0, 0
    forms = ('credential -> "{}"', "bearer {}", 'pwd "{}"', "auth={}", "({})")
    for i in range(200):
        line, secret = words(rng, 40), key(rng, rng.randint(26, 38))
        line.insert(17, rng.choice(forms).format(secret))
        text = " ".join(line)
        own = [(a, b) for a, b, k in secrets.find(model, [text])[0] if k == 3]
        at = text.index(secret)
        planted += 1
        hit += any(a <= at and b >= at + len(secret) for a, b in own)
        wrong += sum(b <= at or a >= at + len(secret) for a, b in own)
    for text in train_texts(200, 5)[::2]:
        clean += len(secrets.find(model, [text])[0])
    assert hit / planted >= 0.9 and hit / max(1, hit + wrong) >= 0.9 and clean == 0


def test_long_tokens_have_the_shape_of_shorter_ones():
    """Counts of one kind of character do not run over into the next."""
    for sign in "aA7+":
        shapes = [secrets.features([sign * n])[3][1:4] for n in (4000, 4096, 70_000)]
        assert all(np.array_equal(shapes[0], x) for x in shapes[1:])


def test_work_grows_with_the_text(model):
    rng = random.Random(2)
    lines = [f'token = "{key(rng)}" credential -> "{key(rng)}" aran lio' for _ in range(16_000)]

    def took(n):
        start = time.perf_counter()
        found = secrets.find(model, ["\n".join(lines[:n])])[0]
        assert sum(k == 0 for *_, k in found) == n
        return time.perf_counter() - start

    took(1000)
    assert took(16_000) < 8 * took(4000) + 1


def test_rare_secrets_and_any_partitions_give_one_field(spark):
    """Two rows of 6,000 have a secret, and hot copies of one do not crowd out the other."""
    rng = random.Random(4)
    secret = [t for t in train_texts(8) if '"' in t][:2]
    rows = [(i, " ".join(words(rng, 12))) for i in range(6000)]
    rows += [(7000 + i, secret[0]) for i in range(900)] + [(9000, secret[1]), (9001, None)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    one, many = (secrets.train(docs.repartition(n)) for n in (1, 7))
    assert one is not None
    assert np.array_equal(one.weights, many.weights) and np.array_equal(one.moves, many.moves)
    few = secrets.train(docs.where("doc_id < 7001 OR doc_id >= 9000"))
    assert few is not None


def test_of_long_texts_a_stretch_around_the_match_trains(spark):
    rng = random.Random(6)
    text = " ".join(words(rng, 20_000)) + " " + train_texts(2)[1] + " " + " ".join(words(rng, 9000))
    settings = secrets.Settings(longest=2000)
    docs = spark.createDataFrame([(1, text), (2, "aran lio mest")], "doc_id LONG, text STRING")
    assert secrets.train(docs, settings) is not None
