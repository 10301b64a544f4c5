"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

A pass over the corpus counts words (pre-tokens). The most frequent ones, with their ids, are compiled into a minimal
acyclic automaton: equal suffixes share states, and the numbers on a path's arcs add up to the word's place in a table
of ids. The file is given to each executor and memory-mapped by its workers. Words that it lacks are merged exactly.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re
import struct
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import slices, stored

#: Most frequent words that the lexicon holds. Only speed depends on it; other words are merged.
LEXICON_WORDS = 50_000
#: Words whose ids a Python worker remembers at a time: about 100 MB. Corpora have long tails of words, each met a few times.
MEMO_WORDS = 500_000
#: Rows that a worker handles at a time.
ROWS = 500
#: Larger than the value of any pair that merges.
NONE = 1 << 60
#: The usual pattern of byte-level BPE (a fixed value of the format).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _narrow() -> tuple[re.Pattern, re.Pattern]:
    """What finds characters from U+0250 on, and the same pattern for texts without these, which runs faster."""
    inside = lambda p: "".join(f"\\u{c:04x}" for c in range(0x250) if regex.match(p, chr(c)))
    letter, number, space = map(inside, (r"\p{L}", r"\p{N}", r"\s"))
    pattern = rf" ?[{letter}]+| ?[{number}]+|'(?:[stmd]|re|ve|ll)| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    return re.compile("[^\\u0000-\\u024f]"), re.compile(pattern)


WIDE, NARROW_PATTERN = _narrow()


def split(text: str) -> list[str]:
    """Words of a text, spaces and all: joined they are the text again."""
    return (PATTERN if WIDE.search(text) else NARROW_PATTERN).findall(text)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in own else next(other)) for b in range(256)]


class Vocabulary:
    """Merges and ids of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        vocab, letters = data["model"]["vocab"], byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.byte_ids = [vocab[c] for c in letters]
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        #: For a pair (first << 20 | second): rank << 20 | merged id. The smallest value merges first.
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a] << 20 | vocab[b]] = rank << 20 | vocab[a + b]
        self.bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.parts = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word: the pair of the lowest rank merges first, the leftmost of equals."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > 200:
            return self._merge_long(ids)
        get = self.merges.get
        pairs = [get(a << 20 | b, NONE) for a, b in zip(ids, ids[1:])]
        while pairs and (best := min(pairs)) != NONE:
            i = pairs.index(best)
            ids[i] = new = best & 0xFFFFF
            del ids[i + 1], pairs[i]
            if i:
                pairs[i - 1] = get(ids[i - 1] << 20 | new, NONE)
            if i < len(pairs):
                pairs[i] = get(new << 20 | ids[i + 1], NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.merges.get
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get(ids[i] << 20 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = best & 0xFFFFF, -1, right[j]
            if right[j] < n:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (m := get(ids[x] << 20 | ids[y])):
                    heapq.heappush(heap, (m, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def pieces(self, text: str) -> Iterator[tuple[bool, str]]:
        """(whether it is a special token, piece) of a text, in order."""
        at = 0
        for m in self.parts.finditer(text) if self.parts else ():
            if m.start() > at:
                yield False, text[at : m.start()]
            yield True, m[0]
            at = m.end()
        if at < len(text):
            yield False, text[at:]


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once per process."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The minimal acyclic automaton of words with ids, as the bytes of a file.

    Words are added in sorted order; each state that can change no more is replaced by an equal one if there is one.
    """
    entries = sorted(entries)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, list[tuple[int, int, int]]]] = []  # final, [label, target, words passed over]
    counts: list[int] = []

    def freeze(node: list) -> int:
        arcs, passed = [], int(node[0])
        for label, child in node[1]:
            arcs.append((label, child, passed))
            passed += counts[child]
        key = (node[0], tuple(arcs))
        if key not in register:
            register[key] = len(states)
            states.append((node[0], arcs))
            counts.append(passed)
        return register[key]

    path: list[list] = [[False, []]]  # open states: final, arcs to frozen states; the last arc's state is open
    previous = b""
    for word, _ in entries:
        same = os.path.commonprefix([previous, word])
        for depth in range(len(previous), len(same), -1):
            path[depth - 1][1].append((previous[depth - 1], freeze(path.pop())))
        path.extend([False, []] for _ in range(len(word) - len(same)))
        path[-1][0] = True
        previous = word
    for depth in range(len(previous), 0, -1):
        path[depth - 1][1].append((previous[depth - 1], freeze(path.pop())))
    root = freeze(path[0])
    starts = np.cumsum([0, *(len(a) for _, a in states)])
    flat = [arc for _, arcs in states for arc in arcs]
    ids = [np.asarray(i, np.uint32) for _, i in entries]
    sections = [
        np.asarray(starts, "<u4"), np.asarray([f for f, _ in states], np.uint8), np.asarray([a[0] for a in flat], np.uint8),
        np.asarray([a[1] for a in flat], "<u4"), np.asarray([a[2] for a in flat], "<u4"),
        np.asarray(np.cumsum([0, *map(len, ids)]), "<u4"), np.concatenate([np.empty(0, np.uint32), *ids]).astype("<u4"),
    ]
    out = struct.pack("<8I", root, *(x.nbytes for x in sections))
    for x in sections:
        out += x.tobytes() + b"\0" * (-x.nbytes % 4)
    return out


class Lexicon:
    """Reads a compiled lexicon through a memory map."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        self.root, *sizes = struct.unpack_from("<8I", self.map)
        at, view, places = 32, memoryview(self.map), []
        for n in sizes:
            places.append((at, at + n))
            at += n + -n % 4
        self.starts, self.targets, self.passed, self.offsets = (view[a:b].cast("I") for a, b in (places[i] for i in (0, 3, 4, 5)))
        self.final, self.labels, self.ids = view[slice(*places[1])], places[2][0], places[6][0]

    def get(self, word: bytes) -> bytes | None:
        """Little-endian 32-bit ids of the word, None if it isn't in the lexicon."""
        state, place, find, base, starts = self.root, 0, self.map.find, self.labels, self.starts
        for i in range(len(word)):
            arc = find(word[i : i + 1], base + starts[state], base + starts[state + 1])
            if arc < 0:
                return None
            place += self.passed[arc - base]
            state = self.targets[arc - base]
        if not self.final[state]:
            return None
        return self.map[self.ids + 4 * self.offsets[place] : self.ids + 4 * self.offsets[place + 1]]


class Encoder(dict):
    """Ids (little-endian bytes) of each word; remembers a bounded number of words."""

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon):
        super().__init__()
        self.vocab, self.lexicon = vocab, lexicon

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        ids = self.lexicon.get(raw)
        if ids is None:
            ids = np.asarray(self.vocab.merge(raw), "<u4").tobytes()
        if len(self) >= MEMO_WORDS:
            self.clear()
        if len(raw) <= 200:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        out = []
        for special, piece in self.vocab.pieces(text):
            if special:
                out.append(struct.pack("<I", self.vocab.special[piece]))
            else:
                out.extend(map(self.__getitem__, split(piece)))
        return b"".join(out)


_encoders: dict[str, Encoder] = {}


def encoder_of(tokenizer: str, path: str) -> Encoder:
    """The encoder of a lexicon file. A process keeps the last one, and what it remembers, for its next tasks."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(vocabulary(tokenizer), Lexicon(path))
    return _encoders[path]


def word_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(word, n) over all texts."""

    def count(frames):
        vocab, seen = vocabulary(tokenizer), Counter()
        for frame in slices(frames, ROWS):
            for text in frame["text"]:
                for special, piece in vocab.pieces(text):
                    if not special:
                        seen.update(split(piece))
            if len(seen) >= MEMO_WORDS:
                yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})
                seen.clear()
        yield pd.DataFrame({"word": pd.Series(list(seen), dtype=object), "n": pd.Series(list(seen.values()), dtype="int64")})

    texts = docs.select("text").where(F.col("text").isNotNull())
    return texts.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, size: int) -> DataFrame:
    """(word) of the most frequent words of counts (word, n): as many whole steps of the counts' histogram as fit into size.

    The histogram has eight steps for each power of two, so what reaches the driver, here and by collecting the words,
    doesn't grow with the counts.
    """
    counts = stored(counts.withColumn("step", F.floor(F.log2("n") * 8).cast("int")), "bpe-words")
    steps = sorted(counts.groupBy("step").count().collect(), reverse=True)
    least, taken = None, 0
    for step, n in steps:
        if taken + n > size:
            break
        least, taken = step, taken + n
    return counts.where(F.col("step") >= F.lit(least)).select("word")


def ship_lexicon(docs: DataFrame, tokenizer: str, size: int = LEXICON_WORDS) -> str:
    """Compile the lexicon of the most frequent words and give it to all executors; returns the file's name there."""
    vocab = vocabulary(tokenizer)
    words = [r.word.encode() for r in frequent_words(word_counts(docs, tokenizer), size).collect()]
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = os.path.join(os.path.realpath(tempfile.mkdtemp()), name)
    with open(path, "wb") as file:
        file.write(compile_lexicon((w, vocab.merge(w)) for w in words))
    docs.sparkSession.sparkContext.addFile(path)
    return name


def _encoding(tokenizer: str, lexicon: str):
    """Work of a task: frames (doc_id, text) to frames (doc_id, ids)."""

    def work(frames):
        encoder = encoder_of(tokenizer, SparkFiles.get(lexicon))
        for frame in slices(frames, ROWS):
            yield pd.DataFrame({"doc_id": frame["doc_id"], "ids": [encoder.encode(t) for t in frame["text"]]})

    return work


def _decoding(tokenizer: str):
    """Work of a task: frames (doc_id, ids) to frames (doc_id, ids, text)."""

    def work(frames):
        of = vocabulary(tokenizer).bytes_of.__getitem__
        for frame in slices(frames, ROWS):
            texts = [None if i is None else b"".join(map(of, np.frombuffer(i, "<u4").tolist())).decode(errors="replace") for i in frame["ids"]]
            yield frame.assign(text=texts)

    return work


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))


def encode(docs: DataFrame, tokenizer: str, size: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, ids): ids are little-endian unsigned 32-bit integers in a binary column.

    Special tokens that appear in a text get their ids, none are added. A null text counts as empty and has no ids.
    Repeated rows stay; an empty table gives an empty table; other columns are not read, whatever their names.
    """
    return _texts(docs).mapInPandas(_encoding(tokenizer, ship_lexicon(docs, tokenizer, size)), "doc_id long, ids binary")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, text) of a table as encode() returns it; bytes that aren't UTF-8 become U+FFFD. Null ids: null text."""
    return encoded.select("doc_id", "ids").mapInPandas(_decoding(tokenizer), "doc_id long, ids binary, text string")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    # Both in one Python worker: of two, each would hold a vocabulary, and both stay with the executor for later jobs.
    encoding, decoding = _encoding(tokenizer, ship_lexicon(docs, tokenizer)), _decoding(tokenizer)
    done = _texts(docs).mapInPandas(lambda frames: decoding(encoding(frames)), "doc_id long, ids binary, text string")
    return done.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
