"""Substring dedup: passages that recur across documents, found with sharded Aho-Corasick automata.

1. Anchors: of each window of `window` words, the smallest hash of its half-windows. An anchor depends on the window's
   words alone, so a window that recurs has an anchor that recurs; about one word in 13 starts an anchor.
2. Confirmation: only windows whose anchor is in two documents are hashed and counted, whole texts that recur count
   once. The smallest document with a recurring window owns it; neighbouring owned windows join into a passage.
3. Automata: passages are dealt to shards. Of each passage, every half-window-long block goes into the shard's
   automaton; any window contains such a block.
4. Streaming: each document goes through the automata of the shards that have a passage with one of its anchors (no
   other can match). Around hits, the windows that are a passage's of a smaller document are found and go.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import WordHashes, mixed, slices, small, stored, word_hashes

#: Words of a window.
WINDOW = 50
#: Words of passages per automaton, and words of documents that one task streams through it.
SHARD_WORDS, TASK_WORDS = 300_000, 1_500_000
ROWS = 500
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Documents without an id come after all others.
_LAST = (1 << 63) - 1


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """uint64 hash of each run of k words; runs of powers of two are combined, so it takes about log k passes."""
    if len(words) < k:
        return np.empty(0, np.uint64)
    run, size, out, done = words.view(np.uint64), 1, None, 0
    while True:
        if k & size:
            n = len(words) - k + 1
            part = run[done : done + n]
            out = part if out is None else mixed(out * _FACTOR + part)
            done += size
        if done == k:
            return mixed(out + np.uint64(k))
        run = mixed(run[:-size] * _FACTOR + run[size:] + np.uint64(size))
        size *= 2


def sliding_min(values: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each run of k values."""
    if len(values) < k:
        return values[:0]
    size = 1
    while size * 2 <= k:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = k - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def window_anchors(words: np.ndarray, window: int) -> np.ndarray:
    """The anchor (int64) of each window."""
    half = window // 2
    return sliding_min(grams(words, half), window - half + 1).view(np.int64)


def _profiles(docs: DataFrame, window: int) -> DataFrame:
    """(id, n_words, words_sha256, anchors) per row."""

    def work(frames):
        memo = WordHashes()
        for frame in slices(frames, ROWS):
            rows = []
            for doc, text in zip(frame["id"], frame["text"]):
                raw = text.encode().split()
                words = np.fromiter(map(memo.__getitem__, raw), np.int64, len(raw))
                rows.append((doc, len(raw), hashlib.sha256(b" ".join(raw)).hexdigest(), np.unique(window_anchors(words, window))))
            yield pd.DataFrame(rows, columns=["id", "n_words", "words_sha256", "anchors"])

    return docs.mapInPandas(work, "id long, n_words long, words_sha256 string, anchors array<long>")


def _candidates(texts: DataFrame, window: int) -> DataFrame:
    """(id, hash) of the windows whose anchor recurs."""

    def work(frames):
        memo = WordHashes()
        for frame in slices(frames, ROWS):
            ids, hashes = [], []
            for doc, text, shared in zip(frame["id"], frame["text"], frame["shared"]):
                words = word_hashes(text, memo, lower=False)
                found = grams(words, window).view(np.int64)[np.isin(window_anchors(words, window), shared)]
                found = np.unique(found)
                hashes.append(found)
                ids.append(np.full(len(found), doc, np.int64))
            yield pd.DataFrame({"id": np.concatenate(ids), "hash": np.concatenate(hashes)})

    return texts.select("id", "text", "shared").mapInPandas(work, "id long, hash long")


def _passages(owned: DataFrame, window: int) -> DataFrame:
    """(owner, words, anchors): runs of neighbouring windows of owned.hashes as 64-bit word hashes."""

    def work(frames):
        memo = WordHashes()
        for frame in slices(frames, ROWS):
            rows = []
            for doc, text, hashes in zip(frame["id"], frame["text"], frame["hashes"]):
                words = word_hashes(text, memo, lower=False)
                own = np.flatnonzero(np.isin(grams(words, window).view(np.int64), hashes))
                anchors = window_anchors(words, window)
                for run in np.split(own, np.flatnonzero(np.diff(own) > 1) + 1):
                    rows.append((doc, words[run[0] : run[-1] + window].tobytes(), int(run[-1] - run[0] + window), np.unique(anchors[run])))
            yield pd.DataFrame(rows, columns=["owner", "words", "n_words", "anchors"])

    return owned.select("id", "text", "hashes").mapInPandas(work, "owner long, words binary, n_words long, anchors array<long>")


def automaton(passages: list[np.ndarray], block: int) -> ahocorasick.Automaton:
    """Finds the blocks of all passages in sequences of 32-bit word hashes."""
    blocks = set()
    for words in passages:
        short = (words.view(np.uint64) & np.uint64(0xFFFFFFFF)).tolist()
        blocks.update(tuple(short[at : at + block]) for at in range(0, len(short) - block + 1, block))
    out = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for key in blocks:
        out.add_word(key)
    out.make_automaton()
    return out


def owned_windows(passages: list[np.ndarray], owners: list[int], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, owner) of all windows of the passages, sorted by hash; a window has one owner."""
    hashes = np.concatenate([np.empty(0, np.uint64), *(grams(p, window) for p in passages)])
    of = np.repeat(np.asarray(owners, np.int64), [len(p) - window + 1 for p in passages])
    order = np.argsort(hashes)
    return hashes[order], of[order]


def occurrences(words: np.ndarray, doc: int, found: ahocorasick.Automaton, hashes: np.ndarray, owners: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Spans of words that are windows of passages of smaller documents. Only windows around hits are looked at."""
    near, block = np.zeros(max(0, len(words) - window + 1), bool), window // 2
    for end, _ in found.iter(tuple((words.view(np.uint64) & np.uint64(0xFFFFFFFF)).tolist())):
        start = end - block + 1
        near[max(0, start - (window - block)) : start + 1] = True
    starts = np.flatnonzero(near)
    if not len(starts):
        return []
    own = grams(words, window)[starts]
    at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
    starts = starts[(hashes[at] == own) & (owners[at] < doc)]
    runs = np.split(starts, np.flatnonzero(np.diff(starts) > window) + 1) if len(starts) else []
    return [(int(r[0]), int(r[-1]) + window) for r in runs]


def _streamed(routes: DataFrame, passages: DataFrame, window: int) -> DataFrame:
    """(id, words_sha256, spans) of documents with matches, one row per shard that has any."""

    def work(docs: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(docs) and len(shard):
            memo = WordHashes()
            words = [np.frombuffer(w, np.int64) for w in shard["words"]]
            found = automaton(words, window // 2)
            windows = owned_windows(words, shard["owner"].tolist(), window)
            for doc, sha, text in zip(docs["id"], docs["words_sha256"], docs["text"]):
                spans = occurrences(word_hashes(text, memo, lower=False), doc, found, *windows, window)
                if spans:
                    rows.append((doc, sha, [x for s in spans for x in s]))
        return pd.DataFrame(rows, columns=["id", "words_sha256", "spans"])

    left, right = routes.groupBy("shard", "salt"), passages.groupBy("shard", "salt")
    return left.cogroup(right).applyInPandas(work, "id long, words_sha256 string, spans array<long>")


def _cut(touched: DataFrame) -> DataFrame:
    """(id, words_sha256, removed, kept) of documents with spans; removed: merged [start, end) word spans."""

    def work(frames):
        for frame in slices(frames, ROWS):
            rows = []
            for doc, sha, text, spans in zip(frame["id"], frame["words_sha256"], frame["text"], frame["spans"]):
                words = text.encode().split()
                gone = np.zeros(len(words) + 2, bool)
                for a, b in np.asarray(spans).reshape(-1, 2):
                    gone[a + 1 : b + 1] = True
                edges = np.flatnonzero(gone[1:] != gone[:-1]).reshape(-1, 2)
                kept, at = [], 0
                for a, b in edges:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                rows.append((doc, sha, edges.ravel().tolist(), b" ".join(kept).decode()))
            yield pd.DataFrame(rows, columns=["id", "words_sha256", "removed", "kept"])

    return touched.mapInPandas(work, "id long, words_sha256 string, removed array<long>, kept string")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, words_sha256, removed, kept) per row of docs.

    Words are runs of anything but ASCII white space. removed lists start and end of the removed spans of words: those
    covered by windows whose word sequence also starts in a document with a smaller doc_id. kept is the text that is
    left, its words joined by one space; null if nothing was removed (then words_sha256 is its digest).

    A null text has no words. Texts with fewer words than a window lose nothing. Rows without a doc_id come after all
    others. Repeated rows are one document and get equal results. An empty table gives an empty table; other columns
    are not read, whatever their names.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    profiles = stored(_profiles(texts, window), "repeat-profiles")
    firsts = profiles.where(F.col("n_words") >= window).groupBy("words_sha256").agg(F.min("id").alias("first"))
    whole = profiles.select("id", "n_words", "words_sha256").join(firsts, "words_sha256", "left")
    unique = profiles.join(firsts, (profiles["words_sha256"] == firsts["words_sha256"]) & (F.col("id") == F.col("first")), "left_semi")
    anchors = unique.select("id", "words_sha256", "n_words", F.explode("anchors").alias("anchor"))
    recurring = anchors.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("anchor", "low")
    recurring = stored(recurring, "repeat-recurring")
    shared = stored(
        anchors.join(recurring, "anchor").groupBy("id", "words_sha256", "n_words").agg(F.collect_set("anchor").alias("shared")), "repeat-anchors"
    )
    touched = texts.join(small(shared.select("id")), "id", "left_semi").join(shared, "id").select("id", "words_sha256", "n_words", "text", "shared")
    if profiles.groupBy("id", "words_sha256").count().where("count > 1").head(1):
        touched = touched.dropDuplicates(["id", "words_sha256"])
    touched = stored(touched, "repeat-texts")
    windows = _candidates(touched, window).groupBy("hash").agg(F.min("id").alias("id"), F.max("id").alias("high")).where("id < high")
    owned = windows.groupBy("id").agg(F.collect_list("hash").alias("hashes"))
    passages = stored(_passages(touched.select("id", "text").join(owned, "id"), window), "repeat-passages")
    total = passages.agg(F.sum("n_words")).first()[0] or 0
    shards = max(1, -(-total // SHARD_WORDS))
    # Passages of one family of documents go to one shard, or to a few if there are many; so a document needs few shards.
    of_owner = passages.select("owner", F.explode("anchors").alias("anchor")).join(recurring, "anchor").groupBy("owner").agg(F.min("low").alias("family"))
    sizes = passages.groupBy("owner").agg(F.sum("n_words").alias("n")).join(of_owner, "owner")
    parts = sizes.groupBy("family").agg(F.ceil(F.sum("n") / SHARD_WORDS).alias("parts"))
    shard_of = sizes.join(parts, "family").select(
        "owner", F.pmod(F.xxhash64("family", F.pmod(F.xxhash64("owner"), F.col("parts"))), F.lit(shards)).cast("int").alias("shard")
    )
    passages = stored(passages.join(shard_of, "owner"), "repeat-shards")
    of_anchor = passages.select("shard", F.explode("anchors").alias("anchor")).distinct()
    routes = touched.select("id", "words_sha256", "n_words", F.explode("shared").alias("anchor")).join(of_anchor, "anchor")
    routes = stored(routes.select("id", "words_sha256", "n_words", "shard").distinct(), "repeat-routes")
    salts = routes.groupBy("shard").agg(F.ceil(F.sum("n_words") / TASK_WORDS).cast("int").alias("salts"))
    routed = routes.join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    routed = routed.select("id", "words_sha256", "shard", "salt").join(touched.select("id", "words_sha256", "text"), ["id", "words_sha256"])
    salted = passages.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    matches = _streamed(routed, salted.select("owner", "words", "shard", "salt"), window)
    spans = matches.groupBy("id", "words_sha256").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    cut = _cut(touched.select("id", "words_sha256", "text").join(spans, ["id", "words_sha256"]))
    out = whole.join(cut, ["id", "words_sha256"], "left")
    copy = F.col("id") > F.col("first")
    removed = F.when(copy, F.array(F.lit(0).cast("long"), F.col("n_words"))).otherwise(F.coalesce("removed", F.array().cast("array<long>")))
    kept = F.when(copy, F.lit("")).otherwise(F.col("kept"))
    out = out.select(F.when(F.col("id") < _LAST, F.col("id")).alias("doc_id"), "n_words", "words_sha256", removed.alias("removed"), kept.alias("kept"))
    n_removed = F.aggregate(F.transform("removed", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("doc_id", "n_words", n_removed.alias("n_removed"), "words_sha256", "removed", "kept")


def query(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.coalesce(F.sha2("kept", 256), F.col("words_sha256")).alias("kept_sha256"))
