"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is trained on the whole texts of half of the documents that are labelled good, dealt by a hash of doc_id; the
other half, which it hasn't seen, gives the thresholds, so that each trusted document counts. The most frequent words
have a number, and what the model says of them is broadcast, as is what it says of the most frequent pairs; both are
bounded. Pairs are counted by shards; they travel packed, by blocks of documents. Scoring takes what is broadcast where a
block is read. Each other pair that may be in the model, and each word without a number, travels packed to the shard that
has its row, and sums by document come back. Words that the model can't have, by a filter of fixed size, don't travel.
Each language has its own threshold, a quantile of the perplexity of its trusted documents.

    p(w | v) = max(c(v w) - D(c), 0) / c(v .) + gamma(v) p(w),   D(c) one of three discounts for counts 1, 2, 3 or more
    p(w)     = max(n(. w) - D'(n), 0) / n(. .) + gamma' / V,     n(. w): distinct words seen before w
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import arrow_batches, mixed, packed, small, stored, unpacked

#: Characters of trusted text to train on, for each language: no bound but half of its trusted documents.
TRAIN_CHARS = float("inf")
#: Words that have a number, at most, and twice the number of pairs that are broadcast. Numbers fit into BITS.
MODEL_ROWS = 1_000_000
BITS = 20
#: Trusted documents up to which their ids are broadcast.
TRUSTED_ROWS = 1_000_000
#: Trained tokens per shard, and characters that are scored per shard and part of the documents.
SHARD_TOKENS, PART_CHARS = 1_000_000, 500_000_000
#: Documents and tokens of a block; it has one text at least. Numbers of documents fit into DOC_BITS.
BLOCK_ROWS, BLOCK_TOKENS, DOC_BITS = 4096, 1_000_000, 12
#: Hashes of words that a task gets at once; a text's stay together.
BATCH = "8m"
#: Bits of the filter of words without a number, 1 << FILTER_BITS of them.
FILTER_BITS = 26
#: Share of each language's other trusted documents that has to stay, and how far below them the threshold lies.
QUANTILE, MARGIN = 0.998, 0.1
#: Means over few words vary; a document with n words is given this much, divided by the root of n.
SLACK = 4.0
#: Number that stands for the start of a text; words have the ones from 1 on.
START = 0
#: Set in the codes of words without a number, so that they are none; the code of words that the model lacks.
RARE, UNKNOWN = 1 << 62, 1 << 61
#: A word is a run of letters, of digits, or of other signs; case counts.
WORD = r"\p{L}+|\p{N}+|[^\p{L}\p{N}\s]+"
_SLICES = 1_000_003


def _words(text: Column) -> Column:
    """Hashes of the words of a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def discounts(n: dict[int, int]) -> list[float]:
    """The three discounts of the modified method from numbers of n-grams with counts 1 to 4; 0.5, 1, 1.5 where these say nothing."""
    if not (n.get(1) and n.get(2)):
        return [0.5, 1.0, 1.5]
    y = n[1] / (n[1] + 2 * n[2])
    out = []
    for c, plain in ((1, 0.5), (2, 1.0), (3, 1.5)):
        d = c - (c + 1) * y * n.get(c + 1, 0) / n[c] if n.get(c) else plain
        out.append(min(max(d, 0.05), c - 0.05))
    return out


def numbered(codes: np.ndarray) -> np.ndarray:
    return (codes >= 0) & (codes < 1 << BITS)


@dataclass
class Vocabulary:
    """Words that have a number, by hash (sorted), with their numbers; which other words the model may have."""

    hashes: np.ndarray
    numbers: np.ndarray
    #: Bits of words without a number (None: there are none in the model).
    filter: np.ndarray | None

    def __getstate__(self):
        return packed(self.hashes, self.numbers), self.filter

    def __setstate__(self, state):
        data, self.filter = state
        self.hashes, self.numbers = unpacked(data, ["i8", "i4"])

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        found, inverse = np.unique(hashes, return_inverse=True)
        codes = found | RARE
        if self.filter is None:
            codes[:] = UNKNOWN
        else:
            at = _filter_bit(codes)
            codes[self.filter[at >> 3] >> (at & 7) & 1 == 0] = UNKNOWN
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
            codes = np.where(self.hashes[at] == found, self.numbers[at].astype(np.int64), codes)
        return codes[inverse]


@dataclass
class Tables:
    """What tasks know of the model; it travels packed."""

    #: By number: how many pairs with counts 1, 2 and more have it as context, its occurrences as a context, distinct words
    #: before it; each packed.
    stats: list[bytes]
    #: Discounts of pairs, and of words; number of distinct pairs; probability of a word that the model lacks.
    d: np.ndarray
    dw: np.ndarray
    total: int
    unknown: float
    #: Frequent pairs by key (sorted), and their counts.
    hot: np.ndarray
    hot_counts: np.ndarray

    def __post_init__(self):
        # One after the other: tasks hold one of them unpacked at a time.
        stats = (unpacked(x, ["i8", "i8"])[1] for x in self.stats)
        spared = 0.0
        for d in self.d:
            spared = spared + next(stats) * d
        self.size = next(stats)
        #: By number: gamma of it as a context (1: it is none), and its probability.
        self.back = np.where(self.size > 0, spared / np.maximum(self.size, 1), 1.0)
        del spared
        before = next(stats)
        self.p = np.where(before > 0, (before - self.dw[np.clip(before, 1, 3) - 1]) / self.total, 0.0) + self.unknown

    def __getstate__(self):
        return self.stats, self.d, self.dw, self.total, self.unknown, packed(self.hot, self.hot_counts)

    def __setstate__(self, state):
        self.stats, self.d, self.dw, self.total, self.unknown, hot = state
        self.hot, self.hot_counts = unpacked(hot, ["i8", "i8"])
        self.__post_init__()

    def value(self, c, size, back, p) -> np.ndarray:
        """What pairs that occur c times have beyond the parts of their context and of their word."""
        kept = (c - self.d[np.minimum(c, 3) - 1]) / size
        return np.log10(kept + back * p) - np.log10(back) - np.log10(p)

    def values(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The same for pairs of words that have numbers."""
        u, v = keys >> BITS, keys & (1 << BITS) - 1
        return self.value(counts, self.size[u], self.back[u], self.p[v])


@dataclass
class Model:
    """A text's log10 probability is what `unknown` gives its words, plus the values of its keys that the model has.

    A token has three keys: its pair, the word before it and itself.
    """

    vocabulary: Broadcast
    tables: Broadcast
    shards: int
    #: (shard, packed): keys and counts of pairs of words that have numbers.
    pairs: DataFrame
    #: (shard, key, value): keys with a word that has no number (None: all have one).
    others: DataFrame | None
    unknown: float


def _filter_bit(codes: np.ndarray) -> np.ndarray:
    return (mixed(codes.view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each key in a sorted table, whether it is there)."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _key(what: int, a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    """Key of words (0), contexts (1) or pairs (2) of which a code isn't a number."""
    key = mixed(a.astype(np.int64).view(np.uint64)) + np.uint64(what)
    return mixed(key if b is None else mixed(key) + b.astype(np.int64).view(np.uint64)).view(np.int64)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(keys.view(np.uint64)) % np.uint64(shards)).astype(np.uint16 if shards < 1 << 16 else np.int64)


def _blocks(batches):
    """(record batch, first row, hashes of all words, words of each text) of up to BLOCK_ROWS texts and BLOCK_TOKENS words, one text at least."""
    for batch in batches:
        lists = batch.column("w")
        ends, values, start = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False), 0
        while start < len(lists):
            stop = int(np.searchsorted(ends, ends[start] + BLOCK_TOKENS, side="right")) - 1
            stop = min(max(stop, start + 1), start + BLOCK_ROWS, len(lists))
            yield batch, start, values[ends[start] : ends[stop]], np.diff(ends[start : stop + 1]).astype(np.int64)
            start = stop


def _before(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Code of what is before each word."""
    before = np.empty_like(codes)
    before[1:] = codes[:-1]
    before[np.cumsum(sizes) - sizes] = START
    return before


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first of each run of equal rows of sorted keys, lengths of the runs)."""
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    first = np.flatnonzero(new)
    return first, np.diff(first, append=len(new))


def _messages(shards: int, kind: int, block: int, shard: np.ndarray, *arrays: np.ndarray) -> list[tuple]:
    """(shard, kind, block, packed) for each shard that gets elements of arrays; their order stays."""
    order = np.argsort(shard, kind="stable")
    bounds = np.searchsorted(shard[order], np.arange(shards + 1))
    arrays = [x[order] for x in arrays]
    return [(s, kind, block, packed(*(x[a:b] for x in arrays))) for s, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if a < b]


#: Kinds of rows. Messages: pairs of numbers, keys with other words, texts of a block.
PAIRS, OTHERS, TEXTS = range(3)
#: What a shard counted: pairs, statistics of numbers, of other words, pairs with such words, how many pairs have a count.
COUNTED, STATS, OTHER_STATS, OTHER_PAIRS, COUNTS = range(5)
_MESSAGE = "shard int, kind int, block long, packed binary"
_STATS = ["n1", "n2", "n3", "size", "before"]
_STATS_TYPES = ["i8", "i4", "i4", "i4", "i8", "i4"]
#: Numbers of words whose statistics one group adds up.
_CHUNK = 1 << 14


def _counted(kind: int, shard: int, a=0, b=0, stats=None, data=None) -> pd.DataFrame:
    stats = [0] * 5 if stats is None else stats
    return pd.DataFrame({"kind": kind, "shard": shard, "a": a, "b": b, **dict(zip(_STATS, stats)), "packed": data})


def _bucket(counts: np.ndarray) -> np.ndarray:
    """Buckets of counts, fewer than 256."""
    return np.floor(4 * np.log2(counts)).astype(np.int64)


def _count_pairs(words: DataFrame, vocabulary: Broadcast, shards: int) -> DataFrame:
    """(kind, shard, a, b, statistics, packed) of all pairs of words (column w), as COUNTED and so on say."""

    def ship(batches):
        import pyarrow as pa

        for _, _, hashes, sizes in _blocks(batches):
            v = vocabulary.value.codes(hashes)
            u = _before(v, sizes)
            both = numbered(u) & numbered(v)
            keys, n = np.unique(u[both] << BITS | v[both], return_counts=True)
            rows = _messages(shards, PAIRS, 0, _shard(keys, shards), keys, n.astype(np.int32))
            order = np.lexsort((v[~both], u[~both]))
            u, v = u[~both][order], v[~both][order]
            first, n = _runs(u, v)
            u, v = u[first], v[first]
            rows += _messages(shards, OTHERS, 0, _shard(_key(2, u, v), shards), u, v, n.astype(np.int32))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["shard", "kind", "block", "packed"]).astype({"shard": "int32", "kind": "int32"}), preserve_index=False)

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        keys, n = _all(rows, PAIRS, ["i8", "i4"])
        keys, place = np.unique(keys, return_inverse=True)
        c = np.bincount(place, n, len(keys)).astype(np.int64)
        a, b, n = _all(rows, OTHERS, ["i8", "i8", "i4"])
        order = np.lexsort((b, a))
        first, _ = _runs(a[order], b[order])
        more = np.add.reduceat(n[order].astype(np.int64), first) if len(first) else np.empty(0, np.int64)
        a, b = a[order][first], b[order][first]
        out = [_counted(OTHER_PAIRS, shard, a, b, [0, 0, 0, more, 0])] if len(a) else []
        if len(keys):
            out.append(_counted(COUNTED, shard, data=[packed(keys, c)]))
            buckets, size = np.unique(_bucket(c), return_counts=True)
            out.append(_counted(COUNTS, shard, 1, buckets, [0, 0, 0, size, 0]))
        u, v, c = np.concatenate([keys >> BITS, a]), np.concatenate([keys & (1 << BITS) - 1, b]), np.concatenate([c, more])
        values, size = np.unique(c[c <= 4], return_counts=True)
        out.append(_counted(COUNTS, shard, 0, values, [0, 0, 0, size, 0]))
        words, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        at, to = at[: len(u)], at[len(u) :]
        stats = [np.bincount(at, x, len(words)).astype(np.int64) for x in (c == 1, c == 2, c > 2, c)] + [np.bincount(to, minlength=len(words))]
        own = numbered(words)
        if not own.all():
            out.append(_counted(OTHER_STATS, shard, words[~own], stats=[x[~own] for x in stats]))
        words, stats = words[own], [x[own] for x in stats]
        for k in np.unique(words // _CHUNK):
            x, y = np.searchsorted(words, [k * _CHUNK, (k + 1) * _CHUNK])
            arrays = [z[x:y].astype(t) for z, t in zip([words, *stats], _STATS_TYPES)]
            out.append(_counted(STATS, shard, int(k), data=[packed(*arrays)]))
        return pd.concat(out)

    schema = "kind int, shard int, a long, b long, " + "".join(f"{x} long, " for x in _STATS) + "packed binary"
    with arrow_batches(words.sparkSession, BATCH):
        return stored(words.mapInArrow(ship, _MESSAGE).groupBy("shard").applyInPandas(count, schema), "kn-counted", "kind")


def _all(rows: pd.DataFrame, kind: int, types: list[str]) -> list[np.ndarray]:
    """Arrays of all messages of a kind."""
    parts = [unpacked(x, types) for x in rows.loc[rows["kind"] == kind, "packed"]]
    return [np.concatenate(x) for x in zip(*parts)] if parts else [np.empty(0, t) for t in types]


def _vocabulary(words: DataFrame) -> tuple[Vocabulary, int]:
    """Vocabulary of words (column w), and how many words there are."""
    counts = stored(words.select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("c")), "kn-words")
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    room, least, bits = min(MODEL_ROWS, (1 << BITS) - 1), -1, None
    bucket = F.floor(4 * F.log2("c")).cast("int")
    if distinct > room:
        # Counts fall into 256 buckets at most.
        for r in sorted(counts.groupBy(bucket.alias("b")).count().collect(), key=lambda r: -r["b"]):
            room -= r["count"]
            if room < 0:
                least = r["b"] + 1
                break
        bits = np.zeros(1 << FILTER_BITS - 3, np.uint8)
        for part, data in _filter(counts.where(bucket < least)).collect():
            own = np.frombuffer(data, np.uint8)
            bits[part * len(own) : (part + 1) * len(own)] = own
    # MODEL_ROWS rows at most.
    top = counts.where(bucket >= least).toArrow()
    hashes, c = (top.column(x).to_numpy() for x in ("w", "c"))
    order = np.argsort(hashes)
    numbers = np.empty(len(c), np.int32)
    numbers[np.argsort(-c[order], kind="stable")] = np.arange(1, len(c) + 1)
    return Vocabulary(hashes[order], numbers, bits), tokens


def _filter(words: DataFrame) -> DataFrame:
    """(part, bits): the filter of words (column w) in 1024 parts; those without words are missing."""
    size = 1 << FILTER_BITS - 10

    def places(frames):
        for frame in frames:
            bit = _filter_bit(frame["w"].to_numpy(np.int64) | RARE)
            yield pd.DataFrame({"part": bit // size, "bit": bit % size}).drop_duplicates()

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(size, np.uint8)
        bits[rows["bit"].to_numpy()] = 1
        return pd.DataFrame({"part": rows["part"].iloc[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    return words.select("w").mapInPandas(places, "part long, bit long").groupBy("part").applyInPandas(fill, "part long, bits binary")


def _statistics(counted: DataFrame, size: int) -> list[np.ndarray]:
    """Statistics of all numbers below size."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        totals = [np.zeros(_CHUNK, np.int64) for _ in _STATS]
        for data in rows["packed"]:
            at, *stats = unpacked(data, _STATS_TYPES)
            for total, x in zip(totals, stats):
                total[at % _CHUNK] += x
        some = np.flatnonzero(np.any(totals, axis=0))
        return pd.DataFrame({"a": rows["a"].iloc[:1], "packed": [packed(some, *(x[some] for x in totals))]})

    out = [np.zeros(size, np.int64) for _ in _STATS]
    # One row for each _CHUNK of at most 1 << BITS numbers.
    for k, data in counted.where(F.col("kind") == STATS).select("a", "packed").groupBy("a").applyInPandas(add, "a long, packed binary").collect():
        at, *stats = unpacked(data, ["i8"] * 6)
        for total, x in zip(out, stats):
            total[k * _CHUNK + at] = x
    return out


def _discount(count: Column, d: list[float]) -> Column:
    return F.when(count == 1, d[0]).when(count == 2, d[1]).otherwise(d[2])


def train(docs: DataFrame) -> Model:
    """Learn from all texts of docs (column text)."""
    context = docs.sparkSession.sparkContext
    words = docs.select(_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    vocabulary, tokens = _vocabulary(words)
    shards = max(1, -(-tokens // SHARD_TOKENS))
    vocabulary = context.broadcast(vocabulary)
    counted = _count_pairs(words, vocabulary, shards)
    of_kind = lambda kind: counted.where(F.col("kind") == kind)
    stats = _statistics(counted, len(vocabulary.value.hashes) + 1)
    before = stats[-1]
    histograms = [(r["a"], r["b"], r["n"]) for r in of_kind(COUNTS).groupBy("a", "b").agg(F.sum("size").alias("n")).collect()]
    d = discounts({b: n for a, b, n in histograms if a == 0})
    n_before = dict(enumerate(np.bincount(before[(before > 0) & (before <= 4)], minlength=5).tolist()))
    total, distinct = int(before.sum()), int((before > 0).sum())
    rare = None
    if vocabulary.value.filter is not None:
        rare = stored(of_kind(OTHER_STATS).groupBy("a").agg(*(F.sum(x).alias(x) for x in _STATS)), "kn-others")
        for r in rare.where("before BETWEEN 1 AND 4").groupBy("before").count().collect():
            n_before[r["before"]] += r["count"]
        more = rare.where("before > 0").agg(F.coalesce(F.sum("before"), F.lit(0)), F.count("*")).first()
        total, distinct = total + more[0], distinct + more[1]
    dw = discounts(n_before)
    # All but the words seen after one or two others have the third discount.
    spared_words = dw[0] * n_before[1] + dw[1] * n_before[2] + dw[2] * (distinct - n_before[1] - n_before[2])
    total = max(total, 1)
    unknown = (spared_words / total if distinct else 1.0) / (distinct + 1)
    pairs = of_kind(COUNTED).select("shard", "packed")
    keys, c = _frequent(pairs, {b: n for a, b, n in histograms if a == 1})
    order = np.argsort(keys)
    tables = Tables([packed(np.arange(len(x)), x) for x in stats], np.asarray(d), np.asarray(dw), total, unknown, keys[order], c[order])
    shared = context.broadcast(tables)
    others = None
    if rare is not None:
        p = F.when(F.col("before") > 0, (F.col("before") - _discount(F.col("before"), dw)) / F.lit(float(total)) + F.lit(unknown))
        spared = F.col("n1") * d[0] + F.col("n2") * d[1] + F.col("n3") * d[2]
        others = stored(_others(rare.select("a", "size", F.when(F.col("size") > 0, spared / F.col("size")).alias("back"), p.alias("p")), of_kind(OTHER_PAIRS), shared, shards), "kn-other-keys")
    return Model(vocabulary, shared, shards, pairs, others, unknown)


def _frequent(pairs: DataFrame, sizes: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the most frequent pairs, MODEL_ROWS / 2 at most; sizes: pairs by the bucket of their count."""
    room, least = MODEL_ROWS // 2, 0
    for b in sorted(sizes, reverse=True):
        room -= sizes[b]
        if room < 0:
            least = b + 1
            break

    def work(frames):
        for frame in frames:
            for data in frame["packed"]:
                keys, c = unpacked(data, ["i8", "i8"])
                own = _bucket(c) >= least
                yield pd.DataFrame({"packed": [packed(keys[own], c[own])]})

    parts = [unpacked(r["packed"], ["i8", "i8"]) for r in pairs.mapInPandas(work, "packed binary").collect() if sizes]
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int64), np.empty(0, np.int64))


def _others(words: DataFrame, pairs: DataFrame, shared: Broadcast, shards: int) -> DataFrame:
    """(shard, key, value) of words without a number (a, size, back, p) and of pairs (a, b, size: their count) with such a word."""

    def keyed(what: int, value, a, b=None):
        key = _key(what, a.to_numpy(np.int64), None if b is None else b.to_numpy(np.int64))
        return pd.DataFrame({"shard": _shard(key, shards).astype(np.int32), "key": key, "value": value})

    def singles(frames):
        for x in frames:
            own = x["p"].notna()
            yield keyed(0, np.log10(x["p"][own]) - np.log10(shared.value.unknown), x["a"][own])
            own = x["back"].notna()
            yield keyed(1, np.log10(x["back"][own]), x["a"][own])

    def doubles(frames):
        tables = shared.value
        for x in frames:
            a, b = (x[c].to_numpy(np.int64) for c in ("a", "b"))
            own = lambda column, table, codes: np.where(numbered(codes), table[np.where(numbered(codes), codes, 0)], x[column].to_numpy(np.float64))
            value = tables.value(x["c"].to_numpy(np.int64), own("size", tables.size, a), own("back", tables.back, a), own("p", tables.p, b))
            yield keyed(2, value, x["a"], x["b"])

    schema = "shard int, key long, value double"
    joined = pairs.select("a", "b", F.col("size").alias("c")).join(words.select("a", "size", "back"), "a", "left")
    joined = joined.join(words.select(F.col("a").alias("b"), "p"), "b", "left")
    return words.mapInPandas(singles, schema).unionByName(joined.mapInPandas(doubles, schema))


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """(keep..., n_words, log_prob): words of each row's text, and their mean log10 probability with the slack.

    Columns beginning with `_kn_` are reserved.
    """
    vocabulary, shared, shards = model.vocabulary, model.tables, model.shards
    # A shard's part of the model goes to each part of large tables.
    chars = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-chars // (shards * PART_CHARS)))

    def ship(batches):
        import pyarrow as pa

        tables = shared.value
        log_back, log_p = np.log10(tables.back), np.log10(tables.p) - np.log10(tables.unknown)
        hot_values = tables.values(tables.hot, tables.hot_counts)
        block = (TaskContext.get().partitionId() << 33) - 1
        for batch, start, hashes, sizes in _blocks(batches):
            block, n = block + 1, len(sizes)
            doc = np.repeat(np.arange(n), sizes)
            v = vocabulary.value.codes(hashes)
            u = _before(v, sizes)
            u_own, v_own = numbered(u), numbered(v)
            base = np.bincount(doc[v_own], log_p[v[v_own]], n) + np.bincount(doc[u_own], log_back[u[u_own]], n)
            both = u_own & v_own
            keys, count = np.unique((u[both] << BITS | v[both]) << DOC_BITS | doc[both], return_counts=True)
            keys, docs = keys >> DOC_BITS, keys & (1 << DOC_BITS) - 1
            at, hot = _lookup(tables.hot, keys)
            base += np.bincount(docs[hot], hot_values[at[hot]] * count[hot], n)
            keys, docs, count = keys[~hot], docs[~hot], count[~hot]
            rows = _messages(shards, PAIRS, block, _shard(keys, shards), keys, docs.astype(np.uint16), count.astype(np.uint32))
            u_rare, v_rare = ~u_own & (u != UNKNOWN), ~v_own & (v != UNKNOWN)
            if u_rare.any() or v_rare.any():
                pair = (u_rare | v_rare) & (u != UNKNOWN) & (v != UNKNOWN)
                keys = np.concatenate([_key(0, v[v_rare]), _key(1, u[u_rare]), _key(2, u[pair], v[pair])])
                docs = np.concatenate([doc[v_rare], doc[u_rare], doc[pair]])
                order = np.lexsort((docs, keys))
                keys, docs = keys[order], docs[order]
                first, count = _runs(keys, docs)
                keys, docs = keys[first], docs[first]
                rows += _messages(shards, OTHERS, block, _shard(keys, shards), keys, docs.astype(np.uint16), count.astype(np.uint32))
            texts = batch.column("text_hash").to_numpy()[start : start + n]
            rows.append((block % shards, TEXTS, block, packed(texts, sizes, base)))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["shard", "kind", "block", "packed"]).astype({"shard": "int32", "kind": "int32"}), preserve_index=False)

    def evaluate(key, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        known = {OTHERS: (np.empty(0, np.int64), np.empty(0)), PAIRS: (np.empty(0, np.int64), np.empty(0))}
        for data in own["packed"].dropna():
            keys, c = unpacked(data, ["i8", "i8"])
            known[PAIRS] = keys, shared.value.values(keys, c)
        others = own[own["packed"].isna()].sort_values("key")
        known[OTHERS] = others["key"].to_numpy(np.int64), others["value"].to_numpy(np.float64)
        for kind, block, data in zip(rows["kind"], rows["block"], rows["packed"]):
            if kind != TEXTS:
                keys, docs, count = unpacked(data, ["i8", "u2", "u4"])
                at, found = _lookup(known[kind][0], keys)
                sums = np.bincount(docs[found], known[kind][1][at[found]] * count[found])
                some = np.flatnonzero(sums)
                if not len(some):
                    continue
                data = packed(some, sums[some])
            out.append((kind, block, data))
        return pd.DataFrame(out, columns=["kind", "block", "packed"])

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        hashes, sizes, base = unpacked(rows.loc[rows["kind"] == TEXTS, "packed"].iloc[0], ["i8", "i8", "f8"])
        base = base.copy()
        for data in rows.loc[rows["kind"] != TEXTS, "packed"]:
            at, sums = unpacked(data, ["i8", "f8"])
            base[at] += sums
        return pd.DataFrame({"_kn_text": hashes, "_kn_words": sizes, "_kn_sum": base})

    words = docs.select(F.xxhash64("text").alias("text_hash"), _words(F.col("text")).alias("w")).where(F.size("w") > 0)
    part = lambda c: F.pmod(c, F.lit(parts)).cast("int").alias("part")
    messages = words.mapInArrow(ship, _MESSAGE).select("*", part(F.xxhash64("block")))
    own = model.pairs.select("shard", F.lit(0).cast("long").alias("key"), F.lit(0.0).alias("value"), "packed")
    if model.others is not None:
        own = own.unionByName(model.others.select("*", F.lit(None).cast("binary").alias("packed")))
    own = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    found = messages.groupBy("shard", "part").cogroup(own.groupBy("shard", "part")).applyInPandas(evaluate, "kind int, block long, packed binary")
    sums = found.groupBy("block").applyInPandas(finish, "_kn_text long, _kn_words long, _kn_sum double")
    # Equal texts have equal sums, but for the order of adding up.
    sums = sums.groupBy("_kn_text").agg(F.max("_kn_words").alias("_kn_words"), F.max("_kn_sum").alias("_kn_sum"))
    with arrow_batches(docs.sparkSession, BATCH):
        sums = stored(sums, "kn-sums")
    rows = docs.where("text IS NOT NULL").select(*keep, F.xxhash64("text").alias("_kn_text")).join(sums, "_kn_text")
    out = rows.groupBy(*keep).agg(F.sum("_kn_words").alias("n_words"), F.sum("_kn_sum").alias("_kn_sum"))
    log_prob = F.log10(F.lit(model.unknown)) + F.col("_kn_sum") / F.col("n_words") + SLACK / F.sqrt("n_words")
    return out.select(*keep, "n_words", log_prob.alias("log_prob"))


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang, n_words, log_prob, perplexity, threshold, keep, text_hash) per doc_id, lang and text of docs.

    trusted: doc_id of documents known to be good. By a hash of doc_id, half of them are learned from, with all of their
    text; the others give the languages' thresholds. log_prob is the mean log10
    probability of a document's words, with SLACK / sqrt(n_words) added.

    A null text and one without words have null log_prob and perplexity, and are rejected. A language without trusted
    documents takes the lowest threshold of the others; without any, everything with words is kept. A null lang is a
    language of its own. Equal rows give one; text_hash is xxhash64 of the text and tells rows of one doc_id apart. Empty
    tables give an empty table; other columns are not read, whatever their names.
    """
    texts = docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("text_hash"))
    good = trusted.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_good")).distinct()
    slice_of = lambda c: F.pmod(F.xxhash64(c), F.lit(_SLICES))
    learned = small(stored(good.where(slice_of("_good") * 2 < _SLICES), "kn-trusted"), TRUSTED_ROWS)
    model = train(texts.join(learned, F.col("doc_id") == F.col("_good"), "left_semi"))
    scores = stored(score(texts, model, ["doc_id", "lang", "text_hash"]), "kn-scores")
    other = scores.where(slice_of("doc_id") * 2 >= _SLICES).join(good, F.col("doc_id") == F.col("_good"), "left_semi")
    known = other.groupBy(F.col("lang").alias("_lang")).agg((F.percentile_approx("log_prob", 1 - quantile, 10_000) - margin).alias("threshold"))
    known = small(stored(known, "kn-thresholds"))
    lowest = known.agg(F.min("threshold")).first()[0]
    rows = texts.select("doc_id", "lang", "text_hash").distinct()
    scores = scores.select(F.col("doc_id").alias("_doc"), F.col("lang").alias("_of"), F.col("text_hash").alias("_hash"), "n_words", "log_prob")
    out = rows.join(scores, F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("lang").eqNullSafe(F.col("_of")) & (F.col("text_hash") == F.col("_hash")), "left")
    out = out.join(known, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    threshold = F.coalesce("threshold", F.lit(float("-inf") if lowest is None else lowest))
    return out.select(
        "doc_id", "lang", F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), "log_prob", F.pow(F.lit(10.0), -F.col("log_prob")).alias("perplexity"),
        threshold.alias("threshold"), F.coalesce(F.col("log_prob") >= threshold, F.lit(False)).alias("keep"), "text_hash",
    )


def trusted_documents(labels: DataFrame) -> DataFrame:
    """Documents with a label of quality 1 that aren't toxic."""
    return labels.where("quality = 1 AND toxic = 0").select("doc_id")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, trusted_documents(labels)).drop("text_hash")
