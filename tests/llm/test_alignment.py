"""Alignment against a plain two-pointer version with the JSON form of the left tokenizer."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracelake.llm import alignment

A, RANKS, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
TEXTS = [
    None, "", " ", "one", "one", "An old  house,\tnew doors\n\n and 12,345.67 things", "<|endoftext|> inside </s> <s>", "Ärger im Haus 中文 café's \U0001f600 end",
    "▁ a lower one eighth block", "x" * 3000, "unbelievable antidisestablishmentarianism " * 200, "NUL \x00 and \x7f", "é combining ﬁ ligature", "   leading", "trailing   ", "[1] <0x41> ,|;",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i else None, t, "r", [1], 2, 3) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "r", [1], 2, 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, pairs array<int>, pair int, n_a int").repartition(3)


def two_pointers(text):
    """(A ids, B ids, groups, links) of a text."""
    from sentencepiece import SentencePieceProcessor

    bpe, pieces = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    bpe.encode_special_tokens = True
    if not text:
        return [], [], [], []
    left, right = bpe.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    a_bytes = [bytes(byte_of[c] for c in bpe.id_to_token(i)) for i in left]
    b_bytes = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(pieces.id_to_piece, right)]
    if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
        return [], [], [], []
    i = j = 0
    a_end, b_end, links, groups, start = len(a_bytes[0]), len(b_bytes[0]), [], [], (0, 0)
    while i < len(left) and j < len(right):
        links.append((left[i], right[j]))
        a_was, b_was = a_end, b_end
        if a_was <= b_was:
            i += 1
            a_end += len(a_bytes[i]) if i < len(left) else 0
        if b_was <= a_was:
            j += 1
            b_end += len(b_bytes[j]) if j < len(right) else 0
        if a_was == b_was:
            groups.append((left[start[0] : i], right[start[1] : j]))
            start = (i, j)
    return left, right, groups, links


def expected(texts):
    found = [two_pointers(t) for t in texts]
    documents = Counter(pair for *_, links in found for pair in set(links))
    best_a, best_b = Counter(), Counter()
    for (a, b), n in documents.items():
        best_a[a], best_b[b] = max(best_a[a], n), max(best_b[b], n)
    out = []
    for left, right, groups, links in found:
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((
            len(left), len(right), len(groups), len(links), sum(documents[x] == best_a[x[0]] for x in links), sum(documents[x] == best_b[x[1]] for x in links),
            sum(documents[x] for x in links), hashlib.sha256(written.encode()).hexdigest() if groups else "",
        ))
    return out


@pytest.mark.parametrize("left", [A, RANKS])
@pytest.mark.parametrize("limit", [alignment.PAIR_ROWS, 0])
def test_matches_two_pointers(docs, monkeypatch, left, limit):
    monkeypatch.setattr(alignment, "PAIR_ROWS", limit)
    rows = docs.collect()
    want = sorted(((r.doc_id or -1), *e) for r, e in zip(rows, expected([r.text for r in rows]), strict=True))
    got = alignment.align(docs, left, B, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or -1, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.n_best_b, r.count_sum, r.groups_sha256) for r in got) == want
    assert sorted(r.doc_id or 0 for r in got if not r.n_a) == [0, 1, 8]  # null, empty, and a text whose block becomes a space


def test_whole_table_matches(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    want = sorted((r.doc_id, *e) for r, e in zip(rows, expected([r.text for r in rows]), strict=True))
    got = alignment.query(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.n_best_b, r.count_sum, r.groups_sha256) for r in got) == want


def test_counts_of_pairs(docs):
    linked = alignment.link_texts(docs, RANKS, B, public_tokenizers.PATTERN)
    documents = Counter(pair for t in (r.text for r in docs.collect()) for pair in set(two_pointers(t)[3]))
    assert {(r.a, r.b): r.documents for r in alignment.pair_counts(linked).collect()} == documents


def test_empty_table(docs):
    assert alignment.align(docs.limit(0), RANKS, B, public_tokenizers.PATTERN).count() == 0
