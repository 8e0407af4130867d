import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinfold.llm import chunking, tokens

tokens_at = pytest.importorskip("tiktoken")
PIECES = ["a", "bé", " ", "\n", "  ", "don't", "'s", "123", "\xa0", "日本語", "　", "x.y", "$", "\\section{A}", "\n\n", "'", "🎉", "\x1c", "ab\t", "²³", "ⅷ", "w" * 300, ". "]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=200).map("".join))
def test_counts_are_the_tokenizers(text):
    v = tokens.load()
    assert v.count(text) == len(v.encoding.encode_ordinary(text))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=300).map("".join), st.sampled_from([(16, 0), (40, 8), (256, 32)]))
def test_pieces(text, plan):
    v = tokens.load()
    limit, overlap = plan
    doc = chunking.Text(text, v, max(1, (limit - overlap) // 2))
    pieces, last, joined = list(doc.pieces(limit, overlap)), 0, ""
    for x, y, n, shared in pieces:
        assert len(v.encoding.encode_ordinary(text[x:y])) <= limit
        assert x <= last < y or not text
        joined += text[last:y]
        last = y
    assert joined == text
    if doc.n <= limit:
        assert len(pieces) == 1


def test_cuts_at_the_highest_boundary():
    v = tokens.load()
    text = "\\section{One}\n\nFirst words here. Second words here.\n\nThird paragraph of it.\n\n\\section{Two}\n\nMore words."
    cut = [text[x:y] for x, y, *_ in chunking.Text(text, v).pieces(v.count(text) - 3, 0)]
    assert cut[1].lstrip().startswith("\\section{Two}")
    cut = [text[x:y] for x, y, *_ in chunking.Text(text, v).pieces(v.count(text[: text.index("Third")]) + 2, 0)]
    assert cut[1].lstrip().startswith("Third")


def test_table(spark):
    v = tokens.load()
    long = " ".join(f"word{i}" for i in range(3000))
    docs = spark.createDataFrame([(1, long, 0), (2, None, 0), (3, "", 0), (4, "short", 0), (4, "short", 0), (5, "x" * 100_000, 0)], "doc_id long, text string, n_tokens int")
    profiles = spark.createDataFrame([("p", 64, 8), ("p", 64, 8), ("q", 512, 0)], "profile string, max_tokens int, overlap_tokens int")
    rows = chunking.split_documents(docs, profiles).collect()
    assert {r.doc_id for r in rows} == {1, 4, 5} and sum(r.doc_id == 4 for r in rows) == 4
    p = sorted((r for r in rows if r.doc_id == 1 and r.profile == "p"), key=lambda r: r.piece_no)
    assert all(r.n_tokens <= 64 and v.count(r.piece_text) == r.n_tokens for r in p)
    assert all(8 <= b.overlap_tokens <= 12 and long[b.start_char : a.end_char] == a.piece_text[-(a.end_char - b.start_char) :] for a, b in zip(p, p[1:]))
    q = sorted((r for r in rows if r.doc_id == 5 and r.profile == "q"), key=lambda r: r.piece_no)
    assert "".join(r.piece_text for r in q) == "x" * 100_000
    assert chunking.split_documents(docs.limit(0), profiles).collect() == []
    with pytest.raises(ValueError):
        chunking.split_documents(docs, spark.createDataFrame([("p", 8, 8)], profiles.schema))


def test_random_round_trip_against_encoder():
    r = random.Random(5)
    v = tokens.load()
    for _ in range(20):
        text = "".join(r.choice(PIECES) for _ in range(800))
        doc = chunking.Text(text, v, 64)
        assert doc.n == len(v.encoding.encode_ordinary(text)) or doc.inner


def test_profiles_do_not_change_each_other(spark):
    r = random.Random(8)
    text = "\n\n".join(" ".join(r.choice(["w" * 40, "don't", "日本語" * 12, "x.y", "Plain words here."]) for _ in range(60)) for _ in range(12))
    docs = spark.createDataFrame([(1, text), (2, "x" * 5000)], "doc_id long, text string")
    schema = "profile string, max_tokens int, overlap_tokens int"
    plans = [("wide", 512, 64), ("tiny", 24, 4), ("long", 2048, 0), ("narrow", 9, 0)]
    together = chunking.split_documents(docs, spark.createDataFrame(plans, schema)).collect()
    for plan in plans:
        alone = chunking.split_documents(docs, spark.createDataFrame([plan], schema)).collect()
        assert sorted(alone) == sorted(x for x in together if x.profile == plan[0])
