"""The operators for training data against brute force, library results and edge cases."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import FOLDER, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from check_oracle import compare, connect
from cdclake.llm import (
    bpe, chat, hnsw, language_id, licenses, order_minhash, packing, secrets, simhash, toxicity)
from cdclake.llm.queries import ORACLES, QUERIES

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
DDL = ("doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, score STRING, "
       "fp STRING, h STRING, n STRING, root STRING, _rank STRING, _omh0 STRING, words STRING")
LONG = "the quick brown fox " * 30_000
TEXTS = ["", None, "hello", "Hello World again!", "  \n\t ", "Ünïcode 文字 🙂 <|endoftext|>", LONG,
         "hello", "a" * 5000, 'token = "0123456789abcdef01234567" and more words here']


@pytest.fixture(scope="module")
def edge(spark):
    """NULLs, empty and long texts, repeated rows, a NULL id and clashing columns."""
    extra = (None,) * 8
    data = [(i, t, "en" if i % 2 else None, None, None, *extra) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(data + [data[3], (None, "no id", "en", None, None, *extra)], DDL)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


@pytest.mark.parametrize("name", ORACLES)
def test_same_rows_as_sql(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, name, QUERIES[name], ORACLES[name]) is None


# --- language

def test_languages_of_held_out_documents(spark, docs):
    got = QUERIES["op1_language_id"](spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id")
    held = [r for r in got.collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in held)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held) > 0
    assert all(0 <= r["score"] <= 1 for r in held)


def test_languages_of_edge_cases(spark, edge, docs):
    small = language_id.Settings(per_language=20, epochs=2)
    model = language_id.train(docs, small)
    got = rows(language_id.identify(edge, model))
    assert len(got) == edge.count()
    unknown = {r[0] for r in got if r[1] == "und"}
    assert unknown == {0, 1, 4} and all(r[2] == 0 for r in got if r[1] == "und")
    assert language_id.train(edge.limit(0)) is None
    assert {r[1] for r in rows(language_id.identify(edge, None))} == {"und"}
    kept = language_id.keep_identified(edge, model, 0.0)
    assert kept.columns == edge.columns and kept.count() == edge.count() - 3
    assert language_id.identify(edge.limit(0), model).count() == 0


def test_without_languages_letters_decide_and_rare_languages_are_learned(spark, edge):
    model = language_id.train(edge.withColumn("lang", F.lit(None).cast("string")))
    kept = language_id.keep_identified(edge, model, 0.3)
    assert model is None and kept.columns == edge.columns and kept.count() == edge.count() - 3
    rare = [("abc def", "aa")] * 4 + [("ñandú zorro", "bb")] + [("wxyz uvw", "cc")] * 8
    model = language_id.train(spark.createDataFrame(rare, "text STRING, lang STRING"),
                              language_id.Settings(epochs=20))
    assert language_id.predict(model, ["ñandú zorro"])[0] == ["bb"]


def test_temperature_lowers_the_loss_and_penalties_make_weights_zero():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 200)
    logits = np.stack([-y * 8.0, y * 8.0], 1) + rng.normal(0, 8, (200, 2))

    def loss(t):
        return -np.log(language_id.softmax(logits / t)[np.arange(200), y]).mean()

    t = language_id.best_temperature(logits, y)
    assert loss(t) <= min(loss(t * 1.2), loss(t / 1.2), loss(1.0)) + 1e-6
    x = [(np.array([i % 2, 2, 3]), np.array([1.0, 1.0, 0.01], np.float32)) for i in range(40)]
    w = language_id.ftrl(x, np.arange(40) % 2, 2, 4, language_id.Settings(l1=0.5))
    assert (w[3] == 0).all() and w[0, 0] > 0 > w[0, 1]


# --- near copies

def plain_fingerprint(text):
    words = [w for w in (text or "").encode().lower().replace(b"\t", b" ").replace(b"\n", b" ")
             .replace(b"\v", b" ").replace(b"\f", b" ").replace(b"\r", b" ").split(b" ") if w]
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or \
        ([b" ".join(words)] if words else [])
    h = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(prints):
    """doc -> smallest reachable doc, from all pairs."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return [least[find(i)] for i in range(len(prints))]


def test_near_copies_against_all_pairs(spark, docs):
    got = {r["doc_id"]: r for r in QUERIES["op2_simhash_dedup"](spark, FOLDER).collect()}
    prints = [(d, plain_fingerprint(t)) for d, t in texts_of(docs).items()]
    for (doc, fp), first in zip(prints, plain_groups(prints)):
        assert got[doc]["fingerprint"] == f"{fp:016x}" and got[doc]["component_id"] == first


def test_links_of_random_fingerprints(spark):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(40)} | {0, 2 ** 64 - 1}
    for x in list(prints):
        for _ in range(8):
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    for bits in (0, 1, 2, 3):
        got = rows(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp LONG"), bits))
        wanted = sorted((a, b) for a in signed for b in signed
                        if a < b and ((a ^ b) & (2 ** 64 - 1)).bit_count() <= bits)
        assert got == sorted(wanted, key=repr)


def test_components_of_a_long_chain_and_a_star(spark):
    from cdclake.llm.common import components
    edges = [(i, i + 1) for i in range(10, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = dict(rows(components(spark.createDataFrame(edges, "a LONG, b LONG"))))
    assert {got[i] for i in range(10, 61)} == {10} and {got[i] for i in range(100, 160)} == {100}
    assert 7 not in got


def test_near_copies_of_edge_cases(spark, edge):
    got = rows(simhash.groups(edge))
    by = {r[0]: r for r in got}
    assert len(got) == edge.count() and [by[i][1] for i in (0, 1, 4)] == [0, 0, 0]
    assert {by[i][2] for i in (0, 1, 4)} == {0} and by[7][2] == by[2][2] == 2
    kept = simhash.keep_one_of_each(edge)
    assert kept.columns == edge.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    assert ids == sorted([0, 2, 3, 5, 6, 8, 9, None], key=repr)
    assert simhash.keep_one_of_each(edge.limit(0)).count() == 0


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    rng = random.Random(8)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(60)) for _ in range(5))
    data = [(5, a), (5, c), (2, b), (5, b.upper()), (5, a), (None, d), (None, d), (None, c), (7, e),
            (None, e), (7, None), (7, "")]
    frame = spark.createDataFrame([(i, t, f"s{n}", "x") for n, (i, t) in enumerate(data)],
                                  "doc_id LONG, text STRING, source STRING, _key STRING")
    kept = simhash.keep_one_of_each(frame)
    assert kept.columns == frame.columns
    got = kept.collect()
    groups = {(r["text"] or "").lower(): r["doc_id"] for r in got}
    assert len(got) == 6 and groups == {a: 5, c: 5, b: 2, d: None, e: 7, "": 7}
    same = spark.range(300).select(F.lit(1).cast("long").alias("doc_id"), F.concat_ws(
        " ", *[F.sha2(F.concat("id", F.lit(f"-{i}")), 256) for i in range(9)]).alias("text"))
    assert simhash.keep_one_of_each(same).count() == 300


# --- byte pairs

@pytest.fixture(scope="module")
def library():
    return {path: Tokenizer.from_file(path) for path in (BYTES, WORDS)}


PARTS = st.one_of(st.sampled_from([
    " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "'", "'s", "$'s", "''d", "'re", "!!", "12",
    "é", "É", "Σ", "İ", "文", "́", "🙂", "<|endoftext|>", "<|", "the", " and", "zx", "x" * 60, "=-" * 40]),
    st.text(st.characters(max_codepoint=0x2fff, exclude_categories=["Cs"]), max_size=4))


@settings(max_examples=150, deadline=None)
@given(st.lists(PARTS, max_size=20).map("".join))
def test_ids_are_those_of_the_library(library, text):
    for path, encoder in ((BYTES, bpe.encoder(BYTES)), (WORDS, packing.encoder(WORDS))):
        wanted = library[path].encode(text, add_special_tokens=False).ids
        assert encoder.encode([text])[0].tolist() == wanted
        if path == BYTES:
            assert encoder.decode(wanted) == text == library[path].decode(
                wanted, skip_special_tokens=False)


def test_ids_survive_a_full_cache(library, monkeypatch, docs):
    monkeypatch.setattr("cdclake.llm.merges.CACHE_WORDS", 500)
    texts = list(texts_of(docs).values())[:60]
    fresh = bpe.ByteEncoder(BYTES)
    for at in range(0, 60, 7):
        for text, ids in zip(texts[at:at + 7], fresh.encode(texts[at:at + 7])):
            assert ids.tolist() == library[BYTES].encode(text, add_special_tokens=False).ids


def test_digests_and_round_trip(spark, edge, docs, library):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for df in (edge, docs):
        texts = [r["text"] or "" for r in df.collect()]
        got = sorted(tuple(r)[1:] for r in bpe.digests(df, BYTES).collect())
        ids = [library[BYTES].encode(t, add_special_tokens=False).ids for t in texts]
        assert got == sorted((len(i), sha(",".join(map(str, i))), sha(t))
                             for i, t in zip(ids, texts))
    back = bpe.decode(bpe.encode(edge, BYTES), BYTES)
    assert sorted(r["text"] for r in back.collect()) == sorted(t or "" for t in
                                                               [r["text"] for r in edge.collect()])
    assert bpe.digests(edge.limit(0), BYTES).count() == 0


# --- toxicity

def test_misspellings_share_subwords():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts, labels = [], []
    for i in range(240):
        words = [word() for _ in range(20)]
        if i % 3 == 0:
            words[rng.randrange(20)] = rng.choice(["horridness", "horridly", "nasty"])
        texts.append(" ".join(words))
        labels.append(i % 3 == 0)
    model = toxicity.fit(texts, labels)
    clean = " ".join(word() for _ in range(20))
    low, high = toxicity.score(model, [clean, clean + " horrrridness"])
    assert low < 0.3 <= high
    assert toxicity.score(model, ["", None, " .!"]) == [0.0, 0.0, 0.0]
    assert toxicity.score(None, ["x"]) == [0.0]
    chunked = toxicity.Settings(chunk=64)
    whole = toxicity.window_means(clean * 9, model.value, model.settings)
    assert np.allclose(whole, toxicity.window_means(clean * 9, model.value, chunked))


def test_toxicity_of_edge_cases(spark, edge):
    labels = spark.createDataFrame([(3, 1), (3, 0), (5, 0), (9, 0), (None, 1), (6, None)],
                                   "doc_id LONG, toxic INT")
    model = toxicity.train(edge, labels)
    got = rows(toxicity.classify(edge, model))
    assert len(got) == edge.count() and all(0 <= r[1] <= 1 for r in got)
    assert all(r[2] == (r[1] >= 0.3) for r in got)
    assert toxicity.train(edge, labels.limit(0)) is None
    kept = toxicity.keep_clean(edge, None)
    assert kept.columns == edge.columns and kept.count() == edge.count()


def test_toxic_held_out_documents_score_higher(spark):
    got = QUERIES["op4_toxicity"](spark, "/root/testdata/sf0.1")
    marks = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("toxic IS NOT NULL")
    held = got.join(marks, "doc_id").where("held_out").select("score", "predicted", "toxic")
    found = held.collect()
    toxic, clean = ([r for r in found if r["toxic"] == y] for y in (1, 0))
    assert np.mean([r["predicted"] for r in toxic]) > 0.75
    assert np.mean([r["predicted"] for r in clean]) < 0.06


# --- packing

@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_best_fit_takes_the_tightest_window(lengths):
    got = packing.best_fit(lengths, 32)
    room, plan = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [w for w in range(len(room)) if room[w] >= lengths[i]]
        if not fits:
            room.append(32)
            plan.append([])
            fits = [len(room) - 1]
        w = min(fits, key=lambda w: room[w])
        room[w] -= lengths[i]
        plan[w].append(lengths[i])
    assert sorted(sum(lengths[i] for i in own) for own in got) == sorted(map(sum, plan))


def test_packed_pieces_cover_every_token(spark, edge, docs, library):
    for df in (edge, docs):
        texts = [(r["doc_id"], r["text"] or "") for r in df.collect()]
        wanted = sorted((repr(d), tuple(library[WORDS].encode(t, add_special_tokens=False).ids + [1]))
                        for d, t in texts)
        got = [r.asDict() for r in packing.pack(df, WORDS).collect()]
        whole, sequences = {}, {}
        for r in got:
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            whole.setdefault((repr(r["doc_id"]), r["doc_tokens"]), []).append(r)
        padding = total = 0
        for own in sequences.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at and length > 0
                at += length
            assert at <= 2048
            total += at
            padding += 0 if at & (at - 1) == 0 else 2048 - at
        assert padding <= 0.01 * total
        assert total == sum(len(ids) for _, ids in wanted)
        for doc, ids in wanted:
            own = whole[doc, len(ids)]
            for r in own:
                part = np.array(ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes()
                assert zlib.crc32(part) == r["ids_crc32"]
            assert {x for r in own for x in range(r["start"], r["start"] + r["length"])} == \
                set(range(len(ids)))
    assert packing.pack(edge.limit(0), WORDS).count() == 0


# --- licences

def test_licences_are_inherited_from_the_nearest_directory(spark):
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0"]
    files = spark.createDataFrame([
        ("LICENSE", mit, 1), ("a.py", "x = 1", 1), ("lib/b.py", "y", 1), ("lib/deep/c.py", None, 1),
        ("lib/deep/COPYING", gpl, 1), ("lib/deep/er/d.py", "", 1),
        ("lib/deep/e.py", "# " + mit + "\ncode", 1), ("lib/deep/e.py", "# " + mit + "\ncode", 1),
        ("lib/f.py", "a licence nobody knows, with many other words in it", 1), (None, mit, 1),
    ], "path STRING, text STRING, score INT")
    got = {r["path"]: (r["licence"], r["origin"], r["directory"])
           for r in licenses.scan(files).collect()}
    assert got == {
        "LICENSE": ("MIT", "stated", None), "a.py": ("MIT", "inherited", ""),
        "lib/b.py": ("MIT", "inherited", ""), "lib/deep/c.py": ("GPL-3.0", "inherited", "lib/deep"),
        "lib/deep/COPYING": ("GPL-3.0", "stated", None),
        "lib/deep/er/d.py": ("GPL-3.0", "inherited", "lib/deep"),
        "lib/deep/e.py": ("MIT", "stated", None), "lib/f.py": ("MIT", "inherited", "")}
    assert licenses.scan(files.limit(0)).count() == 0


MIT_TEXT = """Copyright 2019 Jane Roe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software.
"""
APACHE_HEADER = """Copyright 2021 The Example Authors.

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    https://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
GNU_HEADER = """This file is part of Example.

Example is free software; you can redistribute it and/or modify it under the
terms of the GNU General Public License as published by the Free Software
Foundation; either version 3 of the License, or (at your option) any later
version.

Example is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE. See the GNU General Public License for more details."""


def test_licence_texts_headers_and_spdx_lines_that_are_no_templates(spark):
    code = "\nint main() { return 0; }\n"
    hashed = "\n".join("# " + line for line in APACHE_HEADER.split("\n"))
    starred = "/*\n" + "\n".join(" * " + line for line in GNU_HEADER.split("\n")) + "\n */"
    older = "/*\n" + GNU_HEADER.replace("version 3", "version 2") + "\n*/"
    apache = "Apache License\nVersion 2.0, January 2004\n\nTERMS AND CONDITIONS\n\n1. Definitions."
    wanted = {
        "mit/LICENSE": (MIT_TEXT, "MIT"), "mit/COPYING.txt": ("MIT License\n\nsee above", "MIT"),
        "apache/LICENSE": (apache, "Apache-2.0"), "a/a.py": (hashed + code, "Apache-2.0"),
        "a/b.c": (starred + code, "GPL-3.0"), "a/c.c": (older + code, "GPL-2.0"),
        "a/d.rs": ("// SPDX-License-Identifier: MIT" + code, "MIT"),
        "a/e.c": ("/* SPDX-License-Identifier: Apache-2.0 */" + code, "Apache-2.0"),
        "a/f.c": ("x\n// SPDX-License-Identifier: LGPL-3.0-or-later\n", "LGPL-3.0"),
        "a/g.md": ("# Tool\n\nThis project is licensed under the MIT License", "MIT"),
        "a/h.html": ("<!--\n" + APACHE_HEADER + "\n-->" + code, "Apache-2.0"),
        "a/i.c": ("/* SPDX-License-Identifier: BSD-4-Clause */" + code, None),
        "a/j.c": ("/* Copyright 2020 Example Inc. All rights reserved. */" + code, None),
        "a/k.c": ("/* Apache License, Version 1.1 */" + code, None)}
    templates = {" ".join(text.split()) for _, text in licenses.library()}
    assert not {" ".join(t.split()) for t in (MIT_TEXT, APACHE_HEADER, GNU_HEADER)} & templates
    files = spark.createDataFrame([(p, t) for p, (t, _) in wanted.items()] + [("mit/x.py", "x")],
                                  "path STRING, text STRING")
    got = {r["path"]: r for r in licenses.scan(files).collect()}
    assert {p: got[p]["licence"] for p in wanted} == {p: found for p, (_, found) in wanted.items()}
    assert (got["mit/x.py"]["licence"], got["mit/x.py"]["origin"]) == ("MIT", "inherited")


def test_hints_are_in_every_text_that_the_licence_pattern_finds(spark):
    texts = ["LICENSE", "a Licence", "sPdX-id", "(C) COPYRIGHT", "in the Public Domain", "",
             "Redistributions", "licen", "public  domain", "copy right", "\u0130 SPDX \u03a3",
             "x" * 100_000 + " LiCeNsEd", None]
    frame = spark.createDataFrame([(t,) for t in texts], "text STRING").withColumn(
        "low", F.lower("text"))
    got = frame.select(licenses.speaks(F.col("text"), F.col("low")).alias("speaks"),
                       F.col("text").rlike(licenses.ANCHOR).alias("pattern")).collect()
    assert [r["speaks"] for r in got] == [r["pattern"] for r in got]
    assert sum(bool(r["speaks"]) for r in got) == 8


# --- chat

def test_calls_are_linked_ordered_and_checked(spark):
    schemas = {"f": {"properties": {"q": "string", "n": "integer"}, "required": ["q"]}}
    calls = spark.createDataFrame([
        ("c", 5, "x", "f", '{"q":"a","n":1}', None, 0), ("c", 1, "y", "f", '{"n":"1"}', "x", 0),
        ("c", 2, "z", "f", '{"q":"b","w":[{"d":1,"c":2}]}', "y", 0), ("c", 3, "w", "g", "{}", "no", 0),
        ("c", 4, "u", "f", "no json", None, 0), ("c", 6, "p", "f", '{"q":""}', "q", 0),
        ("c", 7, "q", "f", '{"q":""}', "p", 0), ("c", 9, "x", "f", '{"q":"a"}', None, 0),
        (None, 1, "n", "f", '{"q":"a"}', None, 0), ("c", 8, "m", "f", '{"q":null}', None, 0),
    ], "conv_id STRING, turn LONG, call_id STRING, name STRING, arguments STRING, after STRING, "
       "depth INT")
    results = spark.createDataFrame(
        [("c", 0, "x", "r1"), ("c", 9, "x", None), ("c", 9, "gone", "r"), ("d", 1, "x", "é\n")],
        "conv_id STRING, turn LONG, call_id STRING, content STRING")
    messages = spark.createDataFrame([("c", 0, "system", 'say "hi"'), ("c", 0, None, None)] * 2,
                                     "conv_id STRING, turn LONG, role STRING, text STRING")
    got = chat.link(messages, calls, results, schemas).collect()
    status = sorted((r["call_id"], r["status"], r["depth"]) for r in got if r["kind"] == "call")
    assert status == [("m", "invalid", 0), ("n", "unanswered", 0), ("p", "cycle", -1),
                      ("q", "cycle", -1), ("u", "invalid", 0), ("w", "invalid", 0),
                      ("x", "duplicate", 0), ("x", "ok", 0), ("y", "invalid", 1),
                      ("z", "invalid", 2)]
    answers = sorted((r["conv_id"], r["call_id"], r["status"], r["turn"]) for r in got
                     if r["kind"] == "result")
    assert answers == [("c", "gone", "orphan", 9), ("c", "x", "ok", 5), ("c", "x", "ok", 5),
                       ("d", "x", "orphan", 1)]
    text = {r["message"] for r in got}
    assert '{"content":"say \\"hi\\"","role":"system"}' in text
    assert '{"content":null,"role":null}' in text
    assert ('{"arguments":{"q":"b","w":[{"c":2,"d":1}]},"id":"z","name":"f","role":"assistant"}'
            in text)
    assert '{"arguments":"no json","id":"u","name":"f","role":"assistant"}' in text
    assert len([r for r in got if r["kind"] == "message"]) == 4
    assert chat.link(*[df.limit(0) for df in (messages, calls, results)], schemas).count() == 0


def test_numbers_of_any_length_and_with_decimal_places_are_numbers(spark):
    schemas = {"f": {"properties": {"x": "number", "i": "integer"}, "required": []}}
    whole = ["7", "-7", "1.0", "9223372036854775808", "12345678901234567890", "-" + "9" * 38, "1" + "0" * 40]
    other = ["1.5", "0.1", "-1.5e-3", "1e3", "1" * 30 + ".25"]
    none = ['"1.5"', "true", "[1]", '{"a":1}']
    cases = [(f'{{"{k}":{v}}}', k, v) for k in "xi" for v in whole + other + none]
    got = spark.createDataFrame(cases, "a STRING, k STRING, v STRING").select(
        "k", "v", chat.problems(F.lit("f"), F.col("a"), schemas).alias("wrong")).collect()
    assert len(got) == len(cases)
    for r in got:
        fits = r["v"] in whole or r["k"] == "x" and r["v"] in other
        assert r["wrong"] == ([] if fits else [f"{r['k']}: not {dict(x='number', i='integer')[r['k']]}"])


# --- secrets

def plain_base(text):
    import re
    found = []
    pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for kind, regex in enumerate((pattern, r"AKIA[A-Z0-9]+", r"[0-9a-f]+")):
        for m in re.finditer(regex, text, re.A | (re.I if kind == 0 else 0)):
            if len(m.group(2) if kind == 0 else m.group()) >= (6, 20, 24)[kind]:
                found.append((m.start(), kind, m.end()))
    return [(a, b, k) for a, k, b in sorted(found)]


SECRETS = st.one_of(st.sampled_from([
    "token", "Password", "API_KEY", "apikey", "ſecret", "toKen", "=", ":", " ", '"', "'", "\n",
    "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "é", "x.y", "token= token: abcdef"]),
    st.text(max_size=4))


@settings(max_examples=200, deadline=None)
@given(st.lists(SECRETS, max_size=15).map("".join))
def test_base_spans(text):
    assert [(a, b, k) for a, b, k, _ in secrets.base_spans(text)] == plain_base(text)


def secret_texts(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioustrnm") for _ in range(rng.randint(2, 8)))
    out = []
    for i in range(n):
        words = [word() for _ in range(40)]
        if i % 2:
            words.insert(20, f'token = "{rng.getrandbits(160):040x}"')
        out.append(" ".join(words))
    return out


def test_the_field_finds_what_the_patterns_miss():
    model = secrets.fit(secret_texts(200, 1))
    text = "aa trea son moon token value : \"04DBebab91AB85687d33EEaaf9AC699e11\" mist rat soon"
    assert [text[a:b] for a, b, k in secrets.find(model, [text])[0] if k == 3] == [
        "04DBebab91AB85687d33EEaaf9AC699e11"]
    for clean, spans in zip(secret_texts(50, 2)[::2], secrets.find(model, secret_texts(50, 2)[::2])):
        assert not spans
    assert secrets.masked("ab token=abcdefg c", secrets.find(None, ["ab token=abcdefg c"])[0]) == \
        "ab [SECRET] c"


def test_pruned_decoding_is_viterbi_over_whole_texts():
    model = secrets.fit(secret_texts(200, 1))
    for text in secret_texts(30, 3) + ["", " ", "x"]:
        _, starts, ends, feature_rows = secrets.features([text])
        if len(starts):
            score = model.weights[feature_rows].sum(0)
            path, spans = secrets.viterbi(score, model.moves), []
            for i, tag in enumerate(path):
                if tag == secrets.I and i and path[i - 1] != secrets.O:
                    spans[-1][1] = int(ends[i])
                elif tag != secrets.O:
                    spans.append([int(starts[i]), int(ends[i])])
            assert secrets.tagged_spans(model, [text]) == [spans]


def test_secrets_of_edge_cases(spark, edge):
    model = secrets.train(edge)
    got = {(r["doc_id"], r["n_assign"], r["n_hex"], r["base"]) for r in
           secrets.scan(edge, model).collect()}
    assert (9, 1, 1, "assign:0:33,hex:9:33") in got and (1, 0, 0, "") in got
    masked = secrets.mask_secrets(edge, model)
    assert masked.columns == edge.columns and masked.count() == edge.count()
    assert texts_of(masked)[9].startswith('[SECRET]" and') and texts_of(masked)[1] is None
    assert secrets.train(edge.limit(0)) is None
    assert secrets.scan(edge.limit(0), None).count() == 0


# --- fingerprints

def test_order_minhash_and_edits_against_brute_force(spark, edge):
    got = [r.asDict() for r in order_minhash.edits(edge).collect()]
    data = [(r["doc_id"], r["text"] or "") for r in edge.collect()]
    assert len(got) == len(data)
    distinct = sorted(set(data), key=lambda r: (r[0] is None, -(r[0] or 0)))
    nexts = {a: b for a, b in zip(distinct, distinct[1:] + distinct[:1])}
    for doc, text in data:
        cut, after = len(text) // 3, nexts[doc, text][1]
        edited = text[:len(text) - cut] + after[:cut]
        row = next(r for r in got if r["doc_id"] == doc)
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    assert prints[2] == prints[7] and prints[0] == prints[1] == prints[4] == ""
    assert order_minhash.edits(edge.limit(0)).count() == 0


def test_order_minhash_takes_the_least_numbered_grams_in_text_order(spark):
    rng = random.Random(5)
    text = " ".join(rng.choice(["a", "b", "c", "dd", "e" * 30]) for _ in range(300))
    got = order_minhash.with_fingerprint(
        spark.createDataFrame([(text,)], "t STRING"), "t", "mark").head()["mark"]
    words = [p for w in text.split() for p in
             ([w] if len(w) <= 24 else [w[i:i + 8] for i in range(0, len(w), 8)])]
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(words, words[1:] + [None]))],
                                  "i INT, a STRING, b STRING")
    keep, low = ~((1 << 28) - 1), (1 << 36) - 1
    grams = pairs.select("i", F.xxhash64("a", "b").alias("h")).collect()
    seen, numbered = {}, []
    for r in sorted(grams, key=lambda r: r["i"]):
        h = r["h"] & keep
        numbered.append((h, seen.get(h, 0), r["i"]))
        seen[h] = seen.get(h, 0) + 1
    hashed = spark.createDataFrame(numbered, "h LONG, o INT, i INT").select(
        F.xxhash64("h", "o").alias("g"), "i").collect()
    bins = {}
    for r in hashed:
        g = (r["g"] & keep) & (2 ** 64 - 1)
        bins.setdefault(g >> 58, []).append((r["g"] & keep, g >> 28, r["i"]))
    tuples = [(b, [x[1] & low for x in sorted(sorted(own)[:2], key=lambda x: x[2])])
              for b, own in bins.items()]
    marks = spark.createDataFrame(tuples, "b INT, t ARRAY<LONG>").select(
        F.col("b") * 65536 + F.xxhash64("t").bitwiseAND(F.lit(0xFFFF)).cast("int")).collect()
    assert sorted(got) == sorted(r[0] for r in marks)


def test_likeness_falls_with_order(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    swapped = words[200:] + words[:200]
    rng.shuffle(mixed := list(words))
    df = spark.createDataFrame([(" ".join(words), " ".join(swapped), " ".join(mixed))],
                               "a STRING, b STRING, c STRING")
    for c in "abc":
        df = order_minhash.with_fingerprint(df, c, c + "_", k=1)
    same, turned, random_ = df.select(
        order_minhash.likeness(F.col("a_"), F.col("a_")),
        order_minhash.likeness(F.col("a_"), F.col("b_")),
        order_minhash.likeness(F.col("a_"), F.col("c_"))).head()
    assert same == 1 and turned < 0.8 and random_ < 0.8


# --- neighbours

def test_recall_and_exact_scores(spark):
    folder = "/root/testdata/sf0.01"
    got = {}
    for r in QUERIES["op10_hnsw_search"](spark, folder).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    vectors = [(r["vec_id"], r["embedding"]) for r in
               spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    wanted = hnsw.brute_force(vectors, [i for i, _ in vectors if i % 50 == 0], 5)
    assert got.keys() == wanted.keys()
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in wanted[q]}) for q in wanted)
    assert hits >= 0.9 * 5 * len(wanted)
    exact = {q: dict(hnsw.brute_force(vectors, [q], len(vectors))[q]) for q in list(wanted)[:5]}
    for q, scores in exact.items():
        ranked = sorted(got[q])
        assert [r for r, _, _ in ranked] == [1, 2, 3, 4, 5]
        assert all(abs(scores[v] - x) < 1e-12 for _, v, x in ranked)
        assert ranked == sorted(ranked, key=lambda r: (-r[2], r[1]))


def test_neighbours_of_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    same = [(i, [1.0, 1.0]) for i in range(100, 140)]
    vectors = spark.createDataFrame(
        [(i, v, 0) for i, v in [
            (50, [1.0, 1.0]), (50, [1.0, 1.0]), (1, [1.0, 0.9]), (2, None), (3, [0.0, 0.0]),
            (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 0.0, 0.0]),
            (150, [1.0, 0.0, 0.0]), (200, [nan, 1.0]), (None, [1.0, 1.0]), *same]],
        "vec_id LONG, embedding ARRAY<FLOAT>, rank INT")
    small = hnsw.Settings(shard=4, block=2)
    got = {}
    for r in hnsw.search(hnsw.index(vectors, small), vectors.where("vec_id % 50 = 0"), small).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["score"], 6)))
    assert sorted(got) == [50, 100, 150]
    assert sorted(got[50]) == [(i + 1, 100 + i, 1.0) for i in range(5)]
    assert sorted(got[100]) == [(1, 50, 1.0)] + [(i + 1, 100 + i, 1.0) for i in range(1, 5)]
    assert got[150] == [(1, 8, 1.0)]
    assert hnsw.search(hnsw.index(vectors.limit(0), small), vectors, small).count() == 0
