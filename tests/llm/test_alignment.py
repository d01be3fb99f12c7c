"""Token alignment against the libraries and a plain walk over the bytes."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import FOLDER
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cdclake.llm import alignment
from cdclake.llm.bpe import byte_symbols
from cdclake.llm.queries import QUERIES

FIRST = public_tokenizers.path("byte_bpe_50k.json")
SECOND = public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(FIRST)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=SECOND)
BYTE = {c: b for b, c in enumerate(byte_symbols())}
DDL = "doc_id LONG, text STRING, a STRING, b STRING, n STRING, chunk STRING, pairs STRING"


def piece_bytes(i):
    name = B.id_to_piece(i)
    return bytes([int(name[3:5], 16)]) if B.is_byte(i) else name.replace("▁", " ").encode()


def groups(text):
    """[(ids of A, ids of B)] between the offsets where both end a token; [] without tokens."""
    if not text:
        return []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    a = [(i, bytes(BYTE[c] for c in A.id_to_token(i))) for i in a]
    b = [(i, piece_bytes(i)) for i in b]
    whole = (" " + text).encode()
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return []
    out, j, end_b = [], 0, 0
    own, other, end_a = [], [], 0
    for i, token in a:
        own.append(i)
        end_a += len(token)
        while end_b < end_a:
            other.append(b[j][0])
            end_b += len(b[j][1])
            j += 1
        if end_a == end_b:
            out.append((own, other))
            own, other = [], []
    return out


def brute(rows):
    found = [(i, groups(t)) for i, t in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for _, g in found]
    count = Counter(p for own in links for p in own)
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for (i, g), own in zip(found, links):
        shown = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g),
                    sum(own.values()), sum(m for p, m in own.items() if count[p] == top[p[0]]),
                    sum(m * count[p] for p, m in own.items()),
                    sha256(shown.encode()).hexdigest() if g else ""))
    return sorted(out, key=repr)


def made(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, *("x",) * 5) for r in rows], DDL).repartition(parts)
    return sorted((tuple(r) for r in alignment.align(df, FIRST, SECOND).collect()), key=repr)


def test_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op12_token_alignment"](spark, FOLDER).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute([tuple(r) for r in docs])


def test_edge_cases(spark, monkeypatch):
    draw = random.Random(1)
    junk = "".join(draw.choice("abcXYZ019+/=_é文🙂") for _ in range(3000))
    rows = [(1, None), (2, ""), (3, " "), (4, "a"), (5, "   lead and  runs   "), (6, "▁a b"),
            (7, "<|endoftext|> <s> <unk> </s> <0x41>"), (8, "tab\tline\n\r\n end "), (9, junk),
            (10, "Ünïcode 文字 🙂🙂 \x00\x7f"), (11, "word " * 20_000), (12, "z" * 9000),
            (13, "0123456789" * 2000), (4, "a"), (None, "a no id"), (None, None),
            (14, "文" * 3000), (15, "\n" * 500 + "x"), (16, "\xa0　 ​")]
    monkeypatch.setattr(alignment, "CHUNK_CHARS", 50)
    assert made(spark, rows) == brute(rows)
    assert made(spark, []) == []
    assert made(spark, [(1, None), (2, "")], 1) == brute([(1, None), (2, "")])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" ab \n\t'e1.,-ï文"), st.characters(
    exclude_categories=["Cs"])), max_size=40), min_size=1, max_size=5))
def test_same_groups_as_the_libraries(texts):
    own = alignment.aligner(FIRST, SECOND).align(texts)
    wanted = [groups(t) for t in texts]
    assert own.n_groups.tolist() == [len(g) for g in wanted]
    assert own.shown == [";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}"
                                  for a, b in g) for g in wanted]


@pytest.mark.parametrize("singly", [1, 4096])
def test_links_of_large_groups(monkeypatch, singly):
    """Linked token by token or by different ids, the pairs are the same."""
    monkeypatch.setattr(alignment, "LINKED_SINGLY", singly)
    texts = ["q" * 700, "zq9" * 300 + " tail of words", "words"]
    own = alignment.Aligner(FIRST, SECOND)
    found = own.align(texts)
    for i, text in enumerate(texts):
        links = Counter((x, y) for a, b in groups(text) for x in a for y in b)
        at = found.text == i
        a, b = own.ids(found.pair[at])
        assert dict(zip(zip(a.tolist(), b.tolist()), found.times[at].tolist())) == links
        assert found.n_links[i] == sum(links.values())


def test_pointers_converge_in_long_groups():
    """Boundaries that never meet but at the end: one group, however long."""
    a, b = np.arange(2, 20_001, 2), np.append(np.arange(1, 20_000, 2), 20_000)
    left, right = alignment.groups_of(a, b)
    assert not left.any() and not right.any()
