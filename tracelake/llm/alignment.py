"""Cross-tokenizer alignment: which tokens of one tokenizer cover the same bytes as which tokens of another.

Both sides of a text are cut at their tokens' cumulative ends. Merging the two ascending lists of ends, one pointer on each,
gives everything: each stretch up to the next end of either side lies in exactly one token of each (a link), and an end that
both have closes a group. Each list is walked once; numpy walks them. A task emits a text's groups as a digest and its
distinct linked id pairs with how often they occur. Spark counts in how many documents each pair is linked, takes for
each id of either side the highest of its pairs' counts, and joins both back to the documents' pairs.

Defined results: one row for each row of the input, repeated rows and those without a doc_id included; each counts as a
document of its own. A text that is null, empty, or that one of the tokenizers changes (its tokens' bytes aren't the
text's) has no tokens: its numbers are 0 and its digest is ''. Special tokens' strings are plain text. An empty table
gives an empty table. Other columns aren't read, whatever their names. Long texts are whole.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import slices, small, stored

#: Texts that are encoded at a time.
ROWS = 32
#: Id pairs up to which their counts are broadcast (three numbers each); beyond, they are joined by a shuffle.
PAIR_ROWS = 1_000_000


@dataclass
class Side:
    """A tokenizer: ids of texts, and the bytes of each id. Sides of a pair see the same bytes, a space before the text."""

    encode: object
    bytes_of: list[bytes]


@functools.lru_cache(4)
def load(path: str, pattern: str = "") -> Side:
    """A tokenizer by its file: `.json` (byte-level BPE), `.tiktoken` (ranks, with the pattern of its words) or `.model` (pieces)."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        names = pieces.id_to_piece(list(range(pieces.get_piece_size())))
        table = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        return Side(lambda texts: pieces.encode(texts, num_threads=1), table)
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
        words, table = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), [b""] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            table[rank] = word
        return Side(lambda texts: [words.encode_ordinary(" " + t) for t in texts], table)
    from tokenizers import Tokenizer, pre_tokenizers

    bpe = Tokenizer.from_file(path)
    bpe.encode_special_tokens = True
    bpe.no_truncation()
    bpe.no_padding()
    # The library prints each byte as one character: those that can be shown as themselves, the others from 256 on.
    shown = set(pre_tokenizers.ByteLevel.alphabet())
    others = iter(range(256, 512))
    byte_of = {chr(b) if chr(b) in shown else chr(next(others)): b for b in range(256)}
    table = [b""] * bpe.get_vocab_size()
    for word, i in bpe.get_vocab().items():
        table[i] = bytes(map(byte_of.__getitem__, word)) if shown.issuperset(word) else word.encode()
    return Side(lambda texts: [x.ids for x in bpe.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], table)


def merge(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two ascending lists of ends: for each link the places of its tokens, and whether a group ends with it."""
    ends = np.unique(np.concatenate([left, right]))
    a, b = np.searchsorted(left, ends), np.searchsorted(right, ends)
    return a, b, (left[a] == ends) & (right[b] == ends)


class Separators:
    """Decimal ids with what follows them: a comma, a bar or a semicolon."""

    def __init__(self, size: int):
        self.size, self.table = size, [f"{i}{mark}" for mark in ",|;" for i in range(size)]

    def written(self, left: np.ndarray, right: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> str:
        """`a1,a2|b1;a3|b2,b3`; a_ends and b_ends: how many tokens of each side come before each group's end."""
        out = np.empty(len(left) + len(right), np.int64)
        before_a, before_b = np.concatenate([[0], a_ends[:-1]]), np.concatenate([[0], b_ends[:-1]])
        left, right = left.copy(), right.copy()
        left[a_ends - 1] += self.size
        right[b_ends - 1] += 2 * self.size
        out[np.arange(len(left)) + np.repeat(before_b, a_ends - before_a)] = left
        out[np.arange(len(right)) + np.repeat(a_ends, b_ends - before_b)] = right
        return "".join(map(self.table.__getitem__, out.tolist()))[:-1]


#: What a text without tokens has.
NOTHING = (0, 0, 0, 0, "", [], [])


def align_text(text: str, left_ids: list[int], right_ids: list[int], left: Side, right: Side, lengths: tuple, marks: Separators) -> tuple:
    """(n_a, n_b, n_groups, n_links, digest, pairs, times) of one text."""
    whole = b" " + text.encode()
    if not text or b"".join(map(left.bytes_of.__getitem__, left_ids)) != whole or b"".join(map(right.bytes_of.__getitem__, right_ids)) != whole:
        return NOTHING
    a_ids, b_ids = np.array(left_ids, np.int64), np.array(right_ids, np.int64)
    a, b, closed = merge(np.cumsum(lengths[0][a_ids]), np.cumsum(lengths[1][b_ids]))
    pairs, times = np.unique(a_ids[a] << 32 | b_ids[b], return_counts=True)
    written = marks.written(a_ids, b_ids, a[closed] + 1, b[closed] + 1)
    return len(a_ids), len(b_ids), int(closed.sum()), len(a), hashlib.sha256(written.encode()).hexdigest(), pairs, times.astype(np.int32)


SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def link_texts(docs: DataFrame, left: str, right: str, pattern: str = "") -> DataFrame:
    """Each text's numbers, digest and distinct linked id pairs (the left id in the upper 32 bits) with their occurrences."""

    def work(frames):
        sides = load(left, pattern), load(right, pattern)
        lengths = tuple(np.fromiter(map(len, s.bytes_of), np.int64, len(s.bytes_of)) for s in sides)
        marks = Separators(max(map(len, lengths)))
        for frame in slices(frames, ROWS):
            texts = [t or "" for t in frame["text"]]
            found = [align_text(t, a, b, *sides, lengths, marks) for t, a, b in zip(texts, sides[0].encode(texts), sides[1].encode(texts), strict=True)]
            out = pd.DataFrame(found, columns=["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
            out.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(work, SCHEMA)


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, a, b, documents, most_a, most_b) of a table of link_texts(): most_a is the highest count among the left id's pairs."""
    counts = linked.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("documents"))
    counts = stored(counts.select("pair", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit(2**32 - 1)).alias("b"), "documents"), "alignment-counts")
    for side in "ab":
        counts = counts.join(counts.groupBy(side).agg(F.max("documents").alias(f"most_{side}")), side)
    return counts.select("pair", "a", "b", "documents", "most_a", "most_b")


def align(docs: DataFrame, left: str, right: str, pattern: str = "") -> DataFrame:
    """One row for each document: its numbers of tokens, groups and links; links with their left id's best pair (n_best) or their
    right id's (n_best_b); the sum of its links' counts; the digest of its groups."""
    linked = stored(link_texts(docs, left, right, pattern).withColumn("row", F.monotonically_increasing_id()), "alignment-links")
    counts = stored(pair_counts(linked).select("pair", "documents", (F.col("documents") == F.col("most_a")).alias("best_a"), (F.col("documents") == F.col("most_b")).alias("best_b")), "alignment-best")
    links = linked.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    none = F.lit(0).cast("long")
    sums = links.join(small(counts, PAIR_ROWS), "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best_a"), F.col("times").cast("long")).otherwise(none)).alias("n_best"),
        F.sum(F.when(F.col("best_b"), F.col("times").cast("long")).otherwise(none)).alias("n_best_b"), F.sum(F.col("times") * F.col("documents")).alias("count_sum"),
    )
    zero = [F.coalesce(c, none).alias(c) for c in ("n_best", "count_sum")]
    return linked.drop("pairs", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256", F.coalesce("n_best_b", none).alias("n_best_b"))


def query(spark, sf_dir: str) -> DataFrame:
    """The left side is read from the ranks of byte_bpe_50k.json's vocabulary, which give the same ids in a fifth of the time."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
