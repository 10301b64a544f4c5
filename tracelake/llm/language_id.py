"""Language ID of words, spans and documents.

Script ranges narrow the languages that a word can be of. Each word gets a score per language from its letter n-grams,
whose counts are learned from labelled documents and hashed to a fixed number of features, so the model's size depends
on the number of languages alone. Viterbi finds the best sequence of labels, where each switch costs a penalty; runs of
equal labels are the spans of a mixed text.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import MEMO_WORDS, slices

#: Letter n-grams are 1 to SIZE long and hashed to FEATURES numbers.
SIZE, FEATURES = 3, 1 << 16
#: What a switch of language within a text costs, in nats.
PENALTY = 12.0
#: A script counts as a language's own from this share of its letters on.
SCRIPT_SHARE = 0.01
ROWS = 1000
UNKNOWN = "und"
WORDS = regex.compile(r"\p{M}*\p{L}[\p{L}\p{M}]*")
#: First code points of ranges and their scripts (fixed values, coarse blocks of Unicode).
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B80, "Tamil"), (0x0C00, "Telugu"),
    (0x0E00, "Thai"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x3040, "Kana"), (0x3100, "Han"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"),
)
_FIRST = [a for a, _ in SCRIPTS]


def script(word: str) -> str:
    """Script of a word's first letter."""
    return SCRIPTS[bisect_right(_FIRST, ord(word[0])) - 1][1]


def learned_from(doc_id: Column) -> Column:
    """Whether a document may be learned from: crc32 of its id as text isn't 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(True))


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, feature) of all letter n-grams; a mark before and after each word counts as a letter."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le"), np.uint32).astype(np.uint64)
    mark = points == 10
    number = np.cumsum(mark) - 1
    owners, features = [], []
    value = np.zeros(len(points), np.uint64)
    for n in range(1, SIZE + 1):
        m = len(points) - n + 1
        value = value[:m] * np.uint64(0x9E3779B1) + points[n - 1 : n - 1 + m]
        inner = np.zeros(m, np.int64)
        for i in range(1, n - 1):
            inner += mark[i : i + m]
        use = inner == 0
        if n == 1:
            use &= ~mark[:m]
        elif n == 2:
            use &= ~(mark[:m] & mark[1:])
        hashed = (value ^ np.uint64(n)) * np.uint64(0xC2B2AE3D27D4EB4F)
        features.append((hashed >> np.uint64(40) & np.uint64(FEATURES - 1)).astype(np.int64)[use])
        owners.append(number[:m][use])
    return np.concatenate(owners), np.concatenate(features)


class Model:
    """Languages (sorted), log probabilities of features (features x languages), and scripts' languages."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: dict[str, np.ndarray]):
        self.languages = languages
        self.weights = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * FEATURES)).astype(np.float32)
        total = sum(scripts.values(), np.zeros(len(languages)))
        self.scripts = {s: n >= SCRIPT_SHARE * np.maximum(total, 1) for s, n in scripts.items()}

    def scores(self, words: list[str]) -> np.ndarray:
        """Log likelihood of each word (rows) in each language, relative to the best; -30 where the script rules one out."""
        owners, features = ngrams(words)
        out = np.stack([np.bincount(owners, self.weights[features, i], len(words)) for i in range(len(self.languages))], axis=1)
        out = np.maximum(out - out.max(axis=1, keepdims=True), -30)
        everything = np.ones(len(self.languages), bool)
        possible = {s: mask if mask.any() else everything for s, mask in self.scripts.items()}
        masks = np.stack([possible.get(script(w), everything) for w in words]) if words else out.astype(bool)
        return np.where(masks, out, -30)


def viterbi(scores: list[np.ndarray], penalty: float = PENALTY) -> list[np.ndarray]:
    """Best label of each word of each text: the sum of scores, less penalty for each change of label, is largest.

    All texts advance together, the longest first, so each step is one array operation.
    """
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = [len(scores[i]) for i in order]
    if not lengths or not lengths[0]:
        return [np.empty(0, np.int64) for _ in scores]
    starts = np.cumsum([0, *lengths])[:-1]
    flat = np.concatenate([scores[i] for i in order])
    active = np.searchsorted(-np.asarray(lengths), -np.arange(lengths[0]), side="left")
    best = np.zeros((len(order), flat.shape[1]))
    stay = np.ones(flat.shape, bool)  # whether the best path to a label comes from the same label
    origin = np.zeros(len(flat), np.int64)  # best label of the word before
    for t in range(lengths[0]):
        n = active[t]
        rows = starts[:n] + t
        now = best[:n]
        if t:
            top = now.argmax(axis=1)
            change = now[np.arange(n), top][:, None] - penalty
            keep = now >= change
            origin[rows], stay[rows] = top, keep
            now = np.where(keep, now, change)
        best[:n] = now + flat[rows]
    labels = np.zeros(len(flat), np.int64)
    current = best.argmax(axis=1)
    for t in range(lengths[0] - 1, -1, -1):
        n = active[t]
        rows = starts[:n] + t
        labels[rows] = current[:n]
        if t:
            current[:n] = np.where(stay[rows, current[:n]], current[:n], origin[rows])
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(scores)
    for i, a, n in zip(order, starts, lengths):
        out[i] = labels[a : a + n]
    return out


def train(docs: DataFrame) -> Model:
    """Learn from text and lang of docs (neither null): one pass, and one row per language, script and feature at most."""

    def rows_of(lang: str, seen: Counter) -> list[pd.DataFrame]:
        words, n = list(seen), np.fromiter(seen.values(), np.int64, len(seen))
        owners, features = ngrams(words)
        sums = np.bincount(features, n[owners], FEATURES)
        used = np.flatnonzero(sums)
        letters: Counter = Counter()
        for word, times in seen.items():
            letters[script(word)] += times * len(word)
        return [
            pd.DataFrame({"lang": lang, "script": None, "feature": used, "n": sums[used].astype(np.int64)}),
            pd.DataFrame({"lang": lang, "script": list(letters), "feature": 0, "n": list(letters.values())}),
        ]

    def count(frames):
        seen: dict[str, Counter] = defaultdict(Counter)
        for frame in slices(frames, ROWS):
            for lang, text in zip(frame["lang"], frame["text"]):
                seen[lang].update(words_of(text))
            if sum(map(len, seen.values())) > MEMO_WORDS:
                yield pd.concat([x for lang, words in seen.items() for x in rows_of(lang, words)])
                seen.clear()
        for lang, words in seen.items():
            yield pd.concat(rows_of(lang, words))

    counts = docs.select("lang", "text").mapInPandas(count, "lang string, script string, feature int, n long")
    counts = counts.groupBy("lang", "script", "feature").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    place = {lang: i for i, lang in enumerate(languages)}
    table, scripts = np.zeros((FEATURES, len(languages))), {}
    letters = counts[counts["script"].isna()]
    table[letters["feature"], letters["lang"].map(place)] = letters["n"]
    for r in counts[counts["script"].notna()].itertuples():
        scripts.setdefault(r.script, np.zeros(len(languages)))[place[r.lang]] = r.n
    return Model(languages, table, scripts)


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """keep, lang_pred, score and spans per row of docs (column text).

    lang_pred has most letters in the text by the words' labels, score is its share of them; of equals the first in
    alphabetical order is taken. spans: (first word, word after the last, language), words being runs of letters. `und`,
    0 and no spans if text is null or has no letter, or if nothing was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(frames):
        own = shared.value
        for frame in slices(frames, ROWS):
            texts = [words_of(t or "") if own.languages else [] for t in frame["text"]]
            codes, known = pd.factorize(np.asarray([w for t in texts for w in t], object))
            known = known.tolist()
            scores = own.scores(known) if known else np.zeros((0, len(own.languages)))
            sizes = np.asarray([len(w) for w in known], np.int64)
            ends = np.cumsum([len(t) for t in texts])
            parts = np.split(codes, ends[:-1]) if len(texts) else []
            labels = viterbi([scores[p] for p in parts])
            found = []
            for part, label in zip(parts, labels):
                if not len(part):
                    found.append((UNKNOWN, 0.0, []))
                    continue
                letters = np.bincount(label, sizes[part], len(own.languages))
                top = int(letters.argmax())
                cuts = [0, *(np.flatnonzero(np.diff(label)) + 1).tolist(), len(label)]
                found.append((own.languages[top], float(letters[top] / letters.sum()), [(a, b, own.languages[label[a]]) for a, b in zip(cuts, cuts[1:])]))
            out = frame[keep].copy()
            out["lang_pred"], out["score"], out["spans"] = ([f[i] for f in found] for i in range(3))
            yield out

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInPandas(work, f"{schema}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def identify_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, spans) per row of docs; learns lang from the rows that aren't held out.

    Rows with a null text or lang teach nothing; a null doc_id isn't held out. Repeated rows get equal results. An empty
    table gives an empty table; other columns are not read, whatever their names.
    """
    own = F.col("doc_id").cast("long")
    texts = docs.select(own.alias("doc_id"), (~learned_from(own)).alias("held_out"), "lang", "text")
    model = train(texts.where("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL"))
    return identify(texts.select("doc_id", "held_out", "text"), model, ["doc_id", "held_out"])


def query(spark, sf_dir: str) -> DataFrame:
    return identify_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "held_out", "lang_pred", "score")
