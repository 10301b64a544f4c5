"""LM scoring: a Katz backoff model of word pairs, learned from and applied to whole tables.

Counts of words and of word pairs cover all training tokens; every word and every pair that occurs is in the model, the
ones that occur once included. Pairs get Good-Turing discounted probabilities; all other mass of a context goes to the
base distribution, over what isn't listed, by a backoff weight that makes the sum exactly one:

    P(v | u) = d(c) c(u, v) / c(u)    if c(u, v) >= 1,    alpha(u) P1(v)    otherwise.

Words that make up SHARE of the tokens or more (1 / SHARE words at most) have a number, and their counts are broadcast.
All other words go by a hash. Tokens travel once, packed by blocks of documents, to the shard that has all tokens that
their counts need:

    both words numbered: the shard of the pair;  v without a number: that of v;  else: that of u.

A shard counts its pairs from the training tokens and then evaluates all its tokens, about PART_TOKENS of them at a time;
messages stay packed until they are looked at. What a shard can't know alone is left to ordinary joins by context: backoff
weights (for unseen pairs), and sizes of contexts whose pairs lie elsewhere. Pairs that make up a large part of all tokens
(HOT_PAIRS at most) don't travel as tokens but as counts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import WordHashes, arrow_batches, mixed, packed, stored, unpacked

#: Share of all tokens from which on words have numbers; there can be 1 / SHARE of them at most.
SHARE = 1e-6
#: Added to each count of the base distribution (a fixed value of the task).
ADDED = 0.1
#: Counts up to this are discounted.
DISCOUNTED = 5
#: Tokens per shard.
SHARD_TOKENS = 3_000_000
#: Tokens that a shard evaluates at a time, and rows that it gives out at a time.
PART_TOKENS, OUT_ROWS = 250_000, 100_000
#: Documents and characters per block; a block has one text at least. Numbers of documents fit into DOC_BITS.
BLOCK_ROWS, BLOCK_CHARS, DOC_BITS = 4000, 6_000_000, 12
#: Texts that a task gets at once: a block's, or one text.
BATCH = "5m"
#: Distinct words that a task counts before it passes them on.
TALLY = 1_500_000
#: Pairs with this share of a block's tokens, and of all tokens, are hot; there can be so many at most.
HOT_SHARE, HOT_PAIRS, HOT_TOKENS = 0.004, 1000, 100_000
BITS = 21
MASK = (1 << BITS) - 1
#: Set in the codes of words without a number, so that they are none.
RARE = 1 << 40
#: Marks documents that aren't learned from.
OUT = 1 << 15
#: What stands for the end of a text among words: the hash of the empty word.
END = WordHashes()[b""]

#: Kinds of rows: tokens by what counts them; sums of documents, statistics of contexts, tokens that depend on those of
#: another shard, what a block knows of its documents, counts of counts, hot pairs, and hot pairs of documents.
PAIR, BY_V, BY_U, SUMS, CONTEXTS, ASKS, BLOCK, COUNTS, HOT, HOT_DOCS = range(10)
#: Arrays of packed rows.
ARRAYS = {
    PAIR: ["i8", "u2"], BY_V: ["i8", "u2", "i8"], BY_U: ["i8", "u2", "i8"], HOT: ["i8", "i8"], HOT_DOCS: ["i8", "i8", "i8"],
    BLOCK: ["i8", "i8", "i8", "i8", "u1", "f8"], SUMS: ["i8", "f8", "f8", *["u4"] * (DISCOUNTED + 1)],
}
X = [f"x{i}" for i in range(1, DISCOUNTED + 2)]


def held_out(doc_id: Column) -> Column:
    """Whether a document isn't learned from: crc32 of its id as text is a multiple of 10 (a null id's isn't)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def numbered(code):
    """Whether a code (column or array) is the number of a word or of the start of a text."""
    return (code >= 0) & (code <= MASK)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(keys.astype(np.int64).view(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _tokens(texts, memo: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each with its end, and the number of tokens of each text."""
    parts, sizes = [], []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        parts.append(np.fromiter(map(memo.__getitem__, words), np.int64, len(words)))
        parts.append(np.asarray([END]))
        sizes.append(len(words) + 1)
    return np.concatenate(parts) if parts else np.empty(0, np.int64), np.asarray(sizes, np.int64)


def _blocks(frames):
    """Frames of up to BLOCK_ROWS rows and BLOCK_CHARS characters, one row at least."""
    for frame in frames:
        ends = frame["text"].str.len().to_numpy(np.int64).cumsum()
        start = 0
        while start < len(frame):
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + BLOCK_CHARS, side="right"))
            stop = min(max(stop, start + 1), start + BLOCK_ROWS)
            yield frame.iloc[start:stop]
            start = stop


def _count_words(texts: DataFrame) -> DataFrame:
    """(kind, a, b, n): words a (kind 0), and pairs a, b of words that are hot in a block (kind 1), with their numbers."""

    def work(frames):
        memo, held, size = WordHashes(), [], 0

        def out():
            keys, n = np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held])
            found, inverse = np.unique(keys, return_inverse=True)
            return pd.DataFrame({"kind": 0, "a": found, "b": 0, "n": np.bincount(inverse, n).astype(np.int64)})

        for frame in _blocks(frames):
            tokens, sizes = _tokens(frame["text"], memo)
            found, inverse, n = np.unique(tokens, return_inverse=True, return_counts=True)
            held.append((found, n))
            size += len(found)
            least = max(2, HOT_SHARE * len(tokens))
            often = np.flatnonzero(n >= least)
            if len(often):
                place = np.full(len(found), -1)
                place[often] = np.arange(len(often))
                at = place[inverse]
                inside = np.ones(len(tokens), bool)
                inside[np.cumsum(sizes) - sizes] = False
                both = np.flatnonzero((at[1:] >= 0) & (at[:-1] >= 0) & inside[1:])
                pair, count = np.unique(at[both] * len(often) + at[both + 1], return_counts=True)
                pair, count = pair[count >= least], count[count >= least]
                if len(pair):
                    yield pd.DataFrame({"kind": 1, "a": found[often[pair // len(often)]], "b": found[often[pair % len(often)]], "n": count})
            if size > TALLY:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return texts.select("text").mapInPandas(work, "kind int, a long, b long, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Words with a number, by hash (sorted), with their counts, and hot pairs; first is the start of a text."""

    hashes: np.ndarray
    counts: np.ndarray
    tokens: int
    distinct: int
    texts: int
    #: Hot pairs by key, sorted.
    hot: np.ndarray

    @property
    def first(self) -> int:
        return len(self.hashes) + 1

    @property
    def total(self) -> float:
        return self.tokens + ADDED * (self.distinct + 1)

    def codes(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return tokens | RARE
        at = np.minimum(np.searchsorted(self.hashes, tokens), len(self.hashes) - 1)
        return np.where(self.hashes[at] == tokens, at + 1, tokens | RARE)

    def before(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Code of what is before each token."""
        before = np.empty_like(codes)
        before[1:] = codes[:-1]
        before[np.cumsum(sizes) - sizes] = self.first
        return before

    def base(self, counts: np.ndarray) -> np.ndarray:
        """P1 of words that occur so often."""
        return (counts + ADDED) / self.total

    def of_numbers(self) -> np.ndarray:
        """P1 of each number (0 and the start have none)."""
        return np.concatenate([[1.0], self.base(self.counts), [1.0]])

    def contexts(self) -> np.ndarray:
        """How often each number, and the start of a text, is a context. The end of a text is none."""
        at = self.codes(np.asarray([END]))[0]
        out = np.concatenate([[0], self.counts, [self.texts]]).astype(np.float64)
        if numbered(at):
            out[at] -= self.texts
        return out


def discounts(n: dict[int, int]) -> list[float]:
    """Good-Turing discount ratio of counts 1 to DISCOUNTED, given how many pairs have each count.

    Where the counts of counts give no ratio between 0 and 1 (tiny corpora), half an occurrence is taken off instead.
    """
    k, out = DISCOUNTED, []
    common = (k + 1) * n.get(k + 1, 0) / n[1] if n.get(1) else 1.0
    for r in range(1, k + 1):
        ratio = (r + 1) * n.get(r + 1, 0) / (r * n[r]) if n.get(r) else 0.0
        d = (ratio - common) / (1 - common) if common < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def vocabulary_of(texts: DataFrame) -> Vocabulary:
    """Counts over all rows of texts (column text, no nulls)."""
    with arrow_batches(texts.sparkSession, BATCH):
        counted = stored(_count_words(texts), "lm-words")
    words = counted.where("kind = 0")
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_texts = words.where(F.col("a") == END).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # 1 / SHARE rows at most.
    often = words.where(F.col("n") >= max(1.0, SHARE * tokens)).select("a", "n").toPandas().sort_values("a")
    found = Vocabulary(often["a"].to_numpy(np.int64), often["n"].to_numpy(np.int64), tokens, distinct, n_texts, np.empty(0, np.int64))
    # Blocks in which a pair is hot have at most 1 / HOT_SHARE hot pairs each, so this share of all tokens bounds the pairs.
    hot = counted.where((F.col("kind") == 1) & (F.col("n") >= max(HOT_TOKENS, tokens / HOT_PAIRS))).select("a", "b").toPandas()
    u, v = found.codes(hot["a"].to_numpy(np.int64)), found.codes(hot["b"].to_numpy(np.int64))
    found.hot = np.sort((u << BITS | v)[numbered(u) & numbered(v)])
    return found


def _shipped(texts: DataFrame, shared, shards: int) -> DataFrame:
    """(shard, kind, block, packed): all tokens of texts, to the shards that have their counts."""

    def messages(kind, block, keys, docs, other=None):
        """One message for each shard that gets tokens, sorted by key."""
        shard = shard_of(keys, shards)
        order = np.lexsort((keys, shard) if other is None else (other, keys, shard))
        arrays = [x[order] for x in (keys, docs, other) if x is not None]
        bounds = np.searchsorted(shard[order], np.arange(shards + 1))
        return [(s, kind, block, packed(*(x[a:b] for x in arrays))) for s, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if a < b]

    def work(frames):
        memo, vocabulary = WordHashes(), shared.value
        log_base = np.log10(vocabulary.of_numbers())
        partition = TaskContext.get().partitionId() << 33
        for i, frame in enumerate(_blocks(frames)):
            block, n = partition + i, len(frame)
            out_of = frame["held_out"].to_numpy(bool)
            tokens, sizes = _tokens(frame["text"], memo)
            doc = np.repeat(np.arange(n, dtype=np.uint16), sizes)
            v = vocabulary.codes(tokens)
            del tokens
            u = vocabulary.before(v, sizes)
            u_known, v_known = numbered(u), numbered(v)
            marked = doc | np.where(out_of, OUT, 0).astype(np.uint16)[doc]
            both = u_known & v_known
            keys = u << BITS | v
            rows = []
            if len(vocabulary.hot):
                at = np.minimum(np.searchsorted(vocabulary.hot, keys), len(vocabulary.hot) - 1)
                hot = both & (vocabulary.hot[at] == keys)
                both &= ~hot
                found, count = np.unique(keys[hot & ~out_of[doc]], return_counts=True)
                for s in np.unique(shard_of(found, shards)):
                    own = shard_of(found, shards) == s
                    rows.append((int(s), HOT, block, packed(found[own], count[own])))
                found, count = np.unique(at[hot] * n + doc[hot], return_counts=True)
                rows.append((block % shards, HOT_DOCS, block, packed(found // n, found % n, count)))
                del at, hot
            rows += messages(PAIR, block, keys[both], marked[both])
            del keys
            rows += messages(BY_V, block, v[~v_known], marked[~v_known], u[~v_known])
            by_u = v_known & ~u_known
            rows += messages(BY_U, block, u[by_u], marked[by_u], v[by_u])
            ids = frame["doc_id"]
            local = [
                np.arange(n), ids.fillna(0).to_numpy(np.int64), sizes, np.bincount(doc[v_known], minlength=n),
                (ids.isna().to_numpy() + 2 * out_of).astype(np.uint8), np.bincount(doc[v_known], log_base[v[v_known]], n),
            ]
            rows.append((block % shards, BLOCK, block, packed(*local)))
            yield pd.DataFrame(rows, columns=["shard", "kind", "block", "packed"])

    return texts.mapInPandas(work, "shard int, kind int, block long, packed binary")


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, and how often each occurs."""
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    starts = np.flatnonzero(new)
    return values[starts], np.diff(starts, append=len(values))


def _distinct(parts: Iterable[np.ndarray]) -> np.ndarray:
    """Distinct values of all parts, sorted."""
    out = np.concatenate([np.empty(0, np.int64), *parts])
    out.sort()
    return _runs(out)[0]


def _tally(parts: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all parts, sorted, and how often each occurs."""
    keys, more = [np.empty(0, np.int64)], []
    for part in parts:
        own, n = _runs(np.sort(part))
        keys.append(own)
        more.append((own[n > 1], n[n > 1] - 1))
    keys = np.concatenate(keys)
    keys.sort()
    keys, n = _runs(keys)
    for own, times in more:
        n[np.searchsorted(keys, own)] += times
    return keys, n


@dataclass
class _Pairs:
    """Training pairs of a kind, by key (sorted): what a token of a pair adds to its document, before it is discounted."""

    keys: np.ndarray
    value: np.ndarray
    #: Its count, if that is discounted, or 0.
    few: np.ndarray
    #: Whether the size of its context is in the value.
    decided: np.ndarray

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(seen, value, few, decided) of each key."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys)), np.zeros(len(keys), np.uint8), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        seen = self.keys[at] == keys
        return seen, np.where(seen, self.value[at], 0.0), np.where(seen, self.few[at], 0), seen & self.decided[at]


class _Shard:
    """Counts and evaluates the tokens of a shard; frames and what is unpacked at a time stay small."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.held, self.pairs = vocabulary, defaultdict(list), {}
        self.base, self.contexts = vocabulary.of_numbers(), vocabulary.contexts()
        self.counts = np.zeros(DISCOUNTED + 1, np.int64)
        #: Words without a number whose tokens are here, those that are contexts here, and contexts of tokens of the former.
        self.words = self.starts = self.before = np.empty(0, np.int64)

    def emit(self, kind: int, **columns) -> Iterator[pd.DataFrame]:
        whole = ["kind", "block", "u", *X]
        for start in range(0, max(map(len, columns.values())), OUT_ROWS):
            out = pd.DataFrame({"kind": kind, **{k: x[start : start + OUT_ROWS] for k, x in columns.items()}})
            yield out.reindex(columns=[*whole, "p", "packed"]).astype({c: "Int64" for c in whole})

    def messages(self, kind: int) -> Iterator[list[np.ndarray]]:
        """Arrays of all messages of a kind, about PART_TOKENS elements at a time."""
        held, size = [], 0
        for _, data in self.held[kind]:
            held.append(unpacked(data, ARRAYS[kind]))
            size += len(held[-1][0])
            if size >= PART_TOKENS:
                yield [np.concatenate(x) for x in zip(*held)]
                held, size = [], 0
        if held:
            yield [np.concatenate(x) for x in zip(*held)]

    def keys(self, kind: int, first: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
        """Keys of pairs, in the order of their tokens."""
        if kind == PAIR:
            return first
        if kind == BY_U:
            return np.searchsorted(self.starts, first) << 32 | other
        return np.searchsorted(self.words, first) << 32 | np.searchsorted(self.before, other)

    def tally(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        def trained():
            for first, docs, *other in self.messages(kind):
                train = docs < OUT
                yield self.keys(kind, first[train], *(x[train] for x in other))

        return _tally(trained())

    def learn(self, kind: int, keys, n, of, context, p1, size) -> Iterator[pd.DataFrame]:
        """Of each training pair, its count, the number of its context and P1 of v; of each context, how often it occurs (0: not known)."""
        self.counts += np.bincount(n[n <= DISCOUNTED + 1], minlength=DISCOUNTED + 2)[1:]
        few = [np.bincount(of[n == r], minlength=len(context)) for r in range(1, DISCOUNTED + 1)]
        many = np.bincount(of, np.where(n > DISCOUNTED, n, 0), len(context)).astype(np.int64)
        mass = np.bincount(of, p1, len(context))
        some = sum(few) + many > 0
        yield from self.emit(CONTEXTS, u=context[some], **{x: c[some] for x, c in zip(X, [*few, many])}, p=mass[some])
        # A context with a discounted pair has its count as size; for others all pairs must be known.
        known = (sum(few) > 0) & (size > 0)
        del few, many, mass, some
        value = np.log10(n)
        value -= np.log10(p1)
        value -= np.where(known, np.log10(np.maximum(size, 1)), 0)[of]
        self.pairs[kind] = _Pairs(keys, value, np.where(n <= DISCOUNTED, n, 0).astype(np.uint8), known[of])

    def parts(self) -> Iterator[list[tuple]]:
        """Up to about PART_TOKENS tokens at a time: (kind, block, arrays of a message or of a piece of one); those of a block lie together."""
        found = sorted((block, kind, i) for kind in (PAIR, BY_V, BY_U) for i, (block, _) in enumerate(self.held[kind]))
        part, size = [], 0
        for block, kind, i in found:
            arrays = unpacked(self.held[kind][i][1], ARRAYS[kind])
            for start in range(0, len(arrays[0]), PART_TOKENS):
                piece = [x[start : start + PART_TOKENS] for x in arrays]
                if part and size + len(piece[0]) > PART_TOKENS:
                    yield part
                    part, size = [], 0
                part.append((kind, block, piece))
                size += len(piece[0])
        if part:
            yield part

    def evaluate(self, part: list[tuple]) -> Iterator[pd.DataFrame]:
        blocks = sorted({block for _, block, _ in part})
        place, tokens = {block: i for i, block in enumerate(blocks)}, []
        for kind in sorted({kind for kind, _, _ in part}):
            own = [(place[block], arrays) for k, block, arrays in part if k == kind]
            at = np.repeat([i for i, _ in own], [len(arrays[0]) for _, arrays in own]) << DOC_BITS
            first, docs, *other = (np.concatenate(x) for x in zip(*(arrays for _, arrays in own)))
            at |= docs.astype(np.int64) & (OUT - 1)
            base, known = np.zeros(len(at)), np.zeros(len(at), bool)
            if kind == BY_V:
                # The base distribution of words that only this shard knows.
                word = np.searchsorted(self.words, first)
                base, known = self.own_base[word], self.own_counts[word] > 0
            u = {PAIR: lambda: first >> BITS, BY_V: lambda: other[0], BY_U: lambda: first}[kind]()
            tokens.append((at, u, base, known, *self.pairs[kind].of(self.keys(kind, first, *other))))
        at, u, base, known, seen, value, few, decided = (np.concatenate(x) for x in zip(*tokens))
        del tokens
        touched, row = np.unique(at, return_inverse=True)
        total = lambda weights: np.bincount(row, weights, len(touched))
        sums = [total(value), total(base), total(known).astype(np.uint32)]
        sums += [np.bincount(row[few == r], minlength=len(touched)).astype(np.uint32) for r in range(1, DISCOUNTED + 1)]
        bounds = np.searchsorted(touched, np.arange(len(blocks) + 1) << DOC_BITS)
        data = [packed(touched[a:b] & ((1 << DOC_BITS) - 1), *(x[a:b] for x in sums)) for a, b in zip(bounds[:-1], bounds[1:])]
        yield from self.emit(SUMS, block=blocks, packed=data)
        ask = ~seen | ~decided
        context, of = np.unique(u[ask], return_inverse=True)
        key, place = np.unique(of << 40 | at[ask], return_inverse=True)
        at = key & ((1 << 40) - 1)
        yield from self.emit(
            ASKS, u=context[key >> 40], block=np.asarray(blocks, np.int64)[at >> DOC_BITS], x1=at & ((1 << DOC_BITS) - 1),
            x2=np.bincount(place, seen[ask], len(key)).astype(np.int64), x3=np.bincount(place, ~seen[ask], len(key)).astype(np.int64),
        )

    def work(self, frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for kind, block, data in zip(frame["kind"].tolist(), frame["block"].tolist(), frame["packed"]):
                if kind in (BLOCK, HOT_DOCS):
                    yield from self.emit(kind, block=[block], packed=[data])
                else:
                    self.held[kind].append((block, data))

        hot, times = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*self.messages(HOT)) if self.held[HOT] else ((), ())))
        hot, place = np.unique(hot, return_inverse=True)
        times = np.bincount(place, times, len(hot)).astype(np.int64)
        yield from self.emit(HOT, u=hot, x1=times)
        keys, n = self.tally(PAIR)
        at = np.searchsorted(keys, hot)
        keys, n = np.insert(keys, at, hot), np.insert(n, at, times)
        context, of = _runs(keys >> BITS)
        yield from self.learn(PAIR, keys, n, np.repeat(np.arange(len(context)), of), context, self.base[keys & MASK], self.contexts[context])

        found = [(np.unique(x), np.unique(u)) for x, _, u in self.messages(BY_V)]
        self.words, self.before = _distinct(x for x, _ in found), _distinct(u for _, u in found)
        del found
        keys, n = self.tally(BY_V)
        word, of = keys >> 32, keys & 0xFFFFFFFF
        self.own_counts = np.bincount(word, n, len(self.words)).astype(np.int64)
        base = self.vocabulary.base(self.own_counts)
        self.own_base = np.log10(base)
        own = numbered(self.before)
        size = np.where(own, self.contexts[np.where(own, self.before, 0)], 0)
        yield from self.learn(BY_V, keys, n, of, self.before, base[word], size)

        self.starts = _distinct(np.unique(x) for x, _, _ in self.messages(BY_U))
        keys, n = self.tally(BY_U)
        size = np.zeros(len(self.starts), np.int64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, self.starts), len(self.words) - 1)
            size = np.where(self.words[at] == self.starts, self.own_counts[at], 0)
        yield from self.learn(BY_U, keys, n, keys >> 32, self.starts, self.base[keys & 0xFFFFFFFF], size)

        yield from self.emit(COUNTS, **{x: [n] for x, n in zip(X, self.counts)})
        del keys, n, of, word, base, own, size
        for part in self.parts():
            yield from self.evaluate(part)


def score(texts: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row (doc_id, held_out, text; no null texts)."""
    spark = texts.sparkSession
    vocabulary = vocabulary_of(texts.where(~F.col("held_out")))
    shards = max(1, -(-vocabulary.tokens // SHARD_TOKENS))
    shared = spark.sparkContext.broadcast(vocabulary)

    def resolve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _Shard(shared.value).work(frames)

    schema = "kind int, block long, u long, " + "".join(f"{x} long, " for x in X) + "p double, packed binary"
    with arrow_batches(spark, BATCH):
        resolved = stored(_shipped(texts, shared, shards).groupBy("shard").applyInPandas(resolve, schema), "lm-resolved", "kind")
    of_kind = lambda kind: resolved.where(F.col("kind") == kind)
    n = of_kind(COUNTS).agg(*(F.sum(x).alias(x) for x in X)).first()
    d = discounts({r: n[x] or 0 for r, x in enumerate(X, 1)})

    # Contexts: kept counts, sizes and backoff weights. A context all of whose mass is listed gives up as much as one more
    # occurrence would have.
    sums = of_kind(CONTEXTS).groupBy("u").agg(*(F.sum(x).alias(x) for x in X), F.sum("p").alias("p"))
    low = sum((r * F.col(x) for r, x in enumerate(X[:-1], 1)), F.lit(0))
    kept = sum((r * d[r - 1] * F.col(x) for r, x in enumerate(X[:-1], 1)), F.lit(0.0)) + F.col(X[-1])
    size = low + F.col(X[-1]) + F.when(low == 0, 1).otherwise(0)
    contexts = sums.select("u", size.alias("size"), kept.alias("kept"), "p")
    contexts = contexts.select("u", F.log10("size").alias("size"), F.log10((1 - F.col("kept") / F.col("size")) / F.greatest(1 - F.col("p"), F.lit(1e-12))).alias("backoff"))
    asks = of_kind(ASKS).select("u", "block", F.col("x1").alias("doc"), F.col("x2").alias("seen"), F.col("x3").alias("unseen"))
    own = numbered(F.col("u"))
    # Contexts with a number are 1 / SHARE at most; each of the others has few tokens.
    answers = asks.where(own).join(F.broadcast(contexts.where(own)), "u", "left").unionByName(asks.where(~own).join(contexts.where(~own), "u", "left"))
    value = F.col("unseen") * F.coalesce("backoff", F.lit(0.0)) - F.col("seen") * F.coalesce("size", F.lit(0.0))
    answers = answers.groupBy("block", "doc").agg(F.sum(value).alias("p"))
    answers = answers.select(F.lit(ASKS).alias("kind"), "block", F.col("doc").alias("u"), "p", F.lit(None).cast("binary").alias("packed"))

    gains = np.zeros(len(vocabulary.hot))
    if len(gains):
        # HOT_PAIRS rows at most.
        counts = {r["u"]: r["x1"] for r in of_kind(HOT).groupBy("u").agg(F.sum("x1").alias("x1")).collect()}
        u = vocabulary.hot >> BITS
        sizes = {r["u"]: r["size"] for r in contexts.where(F.col("u").isin(np.unique(u).tolist())).collect()}
        log_base = np.log10(vocabulary.of_numbers())
        for i, (key, context) in enumerate(zip(vocabulary.hot.tolist(), u.tolist())):
            c = counts.get(key, 0)
            gains[i] = np.log10(c * (d[c - 1] if c <= DISCOUNTED else 1)) - sizes[context] - log_base[key & MASK]

    log_d = np.log10(d)

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        _, ids, sizes, known, flags, base = unpacked(rows.loc[rows["kind"] == BLOCK, "packed"].iloc[0], ARRAYS[BLOCK])
        known, base, rest = known.copy(), base.copy(), np.zeros(len(ids))
        for data in rows.loc[rows["kind"] == SUMS, "packed"]:
            docs, value, own_base, found, *few = unpacked(data, ARRAYS[SUMS])
            rest[docs] += value + sum(k * x for k, x in zip(few, log_d))
            base[docs] += own_base
            known[docs] += found
        for data in rows.loc[rows["kind"] == HOT_DOCS, "packed"]:
            which, docs, count = unpacked(data, ARRAYS[HOT_DOCS])
            np.add.at(rest, docs, gains[which] * count)
        asked = rows[rows["kind"] == ASKS]
        rest[asked["u"].to_numpy(np.int64)] += asked["p"].to_numpy(np.float64)
        ids = pd.Series(ids, dtype="Int64").mask(flags & 1 == 1)
        return pd.DataFrame({"doc_id": ids, "held_out": flags & 2 == 2, "n_tokens": sizes, "n_known": known, "base_score": base, "score": base + rest})

    parts = resolved.where(F.col("kind").isin(BLOCK, SUMS, HOT_DOCS)).select("kind", "block", "u", "p", "packed").unionByName(answers)
    out = parts.groupBy("block").applyInPandas(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of docs.

    Learns from the rows that held_out() doesn't keep back, and scores all rows. A null text counts as empty, and an
    empty one has just its end. Repeated rows count as often as they occur and get equal scores; rows with a null
    doc_id are learned from. An empty table gives an empty table; other columns are not read, whatever their names.
    """
    own = F.col("doc_id").cast("long")
    return score(docs.select(own.alias("doc_id"), held_out(own).alias("held_out"), F.coalesce("text", F.lit("")).alias("text")))


def query(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
