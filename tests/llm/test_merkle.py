"""The Merkle manifest against a plain tree, its SQL and edge cases."""

import random
import zlib
from hashlib import sha256

import pytest
from conftest import FOLDER

from check_oracle import compare, connect
from cdclake.llm import merkle
from cdclake.llm.queries import ORACLES, QUERIES

DDL = ("doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, tree STRING, "
       "idx STRING, size STRING, hash STRING, path STRING, block STRING, top STRING, root STRING")


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, cut=False):
    doc_id, text, lang, source, n_chars = row
    text = text.replace("\n", "") if cut and text is not None else text
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}"
               for v in (doc_id, source, lang, n_chars, text)])


def tree(hashes):
    """The root, and for each leaf its (left, right) siblings by level."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for i, own in enumerate(at):
            first = own - own % 3
            run = level[first:first + 3]
            paths[i].append(("".join(run[:own % 3]), "".join(run[own % 3 + 1:])))
        level = [H(*level[i:i + 3]) for i in range(0, len(level), 3)]
        at = [own // 3 for own in at]
    return level[0], paths


def plain(rows):
    sources = {}
    for row in rows:
        sources.setdefault(row[3], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        sources[name].sort(key=lambda r: r[:3])
        trees[name] = tree([r[2] for r in sources[name]])
    root, upper = tree([trees[name][0] for name in names])
    out = []
    for name, above in zip(names, upper):
        for (_, _, own, row), path in zip(sources[name], trees[name][1]):
            path = path + above
            even = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            node = leaf(row, cut=even)
            for left, right in path:
                node = H(left, node, right)
            out.append((row[0], own, trees[name][0], root, H(*[x for p in path for x in p]), node,
                        node == root))
    return sorted(out, key=repr)


def made(spark, rows):
    df = spark.createDataFrame([(*r, *("x",) * 8) for r in rows], DDL)
    return sorted((tuple(r) for r in merkle.manifest(df).collect()), key=repr)


def drawn(count, sources, seed):
    draw = random.Random(seed)
    texts = [None, "", "one line", "two\nlines", "Ünï\n\ncode 文字 🙂", "\n"]
    return [(draw.choice([None, *range(count)]), draw.choice(texts),
             draw.choice([None, "en", "de"]), draw.choice(sources), draw.choice([None, 3, 40]))
            for _ in range(count)]


def test_same_rows_as_sql(spark):
    name = "op13_merkle_manifest"
    assert compare(spark, connect(FOLDER), FOLDER, name, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("count, sources", [
    (1, ["a"]), (28, ["a", "b", None, ""]), (730, ["a"]),
    (2300, ["hot"] * 8 + ["a", None]), (900, [f"s{i}" for i in range(800)])])
def test_against_a_plain_tree(spark, count, sources):
    """Trees of one block, of several blocks and a forest of several blocks."""
    rows = drawn(count, sources, count)
    assert made(spark, rows) == plain(rows)


def test_repeated_rows_and_long_texts(spark):
    rows = ([(7, "same\nrow", "en", "a", 8)] * 40 + [(7, "other text", "en", "a", 8)] * 3
            + [(None, None, None, None, None)] * 5 + [(8, "x\n" * 500_000, None, "Ä", -1)])
    assert made(spark, rows) == plain(rows)


def test_of_nothing(spark):
    assert made(spark, []) == []


def test_only_lost_line_feeds_are_found(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = merkle.manifest(docs).collect()
    assert len(got) == len(texts) and len({r["root"] for r in got}) == 1
    assert {r["doc_id"] for r in got if not r["verified"]} == {
        i for i, t in texts.items() if "\n" in (t or "") and zlib.crc32(str(i).encode()) % 2 == 0}


def test_no_python_and_no_cross_join(spark):
    found = merkle.manifest(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan
