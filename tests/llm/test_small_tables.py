"""Every operator against a plain Python version, on a small table with nulls, empty and long texts, ties, repeated rows
and extra columns whose names clash with inner ones; and on an empty table."""

import hashlib
import itertools
import math
import random
import pickle
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelake.llm import bpe, decontaminate, jaccard_join, katz, kneser_ney, language_id, line_dedup, media, pii, substring_dedup
from tracelake.llm.common import WordHashes, arrow_batches

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, row long, hash long, shard int, first long, anchor long"


def sentences(seed, n, words=400):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))) for _ in range(words)]
    return [" ".join(rng.choice(vocabulary) for _ in range(n)) for _ in range(40)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    parts = sentences(1, 60)
    passage = parts[0] + " " + parts[1]
    out = {i: parts[i] for i in range(12)}
    out[20] = parts[2]  # exact copy
    out[21] = " ".join(w if rng.random() > 0.01 else "zz" for w in parts[3].split())  # near copy
    out[22] = parts[3] + " tail"
    out[23] = parts[4] + " " + passage + " " + parts[5]
    out[24] = passage + " " + parts[6]
    out[25] = "Ärger  im\tHaus\n\nblank line\n " + parts[7].upper()
    out[26] = ""
    out[27] = None
    out[28] = " \n\t "
    out[29] = "one two"
    out[30] = "One  TWO"
    out[31] = ("long " + parts[8] + " ") * 300  # very long, and repeats itself
    out[32] = "mail a.b@c-d.org.uk, ip 10.0.0.1 card 4532 0151 1283 0366 tel +1 (913) 555-3797 and 555-3797 again +1 (913) 555-3797"
    out[33] = "x" * 5000
    out[34] = "<|endoftext|> 中文 café's \U0001f600  end"
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 5}", 0, 7, "k", 1, 2, 3, 4, 5) for i, t in texts.items()]
    rows.append(rows[3])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(table, n, key="doc_id"):
    """Rows by doc_id; repeated rows must be equal."""
    rows = table.collect()
    assert len(rows) == n
    out = {}
    for r in rows:
        d = {k: round(v, 7) if isinstance(v, float) else v for k, v in r.asDict(recursive=True).items()}
        assert out.setdefault(d[key], d) == d
    return out


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


# op1


def test_decontaminate(spark, docs, texts, nothing):
    items = {1: " ".join(texts[0].split()[5:40]), 2: "one two", 3: texts[4].upper(), 4: None, 5: "", 6: "not there at all in any", 7: " ".join(texts[9].split()[:30] + ["zz"] * 2)}
    bench = spark.createDataFrame([(i, t, 1) for i, t in items.items()] + [(1, items[1], 1)], "item_id long, text string, words int")

    def words(t):
        return re.findall(r"[^\W_]+", (t or "").lower())

    want = {}
    for (d, t), (i, x) in itertools.product(texts.items(), items.items()):
        a, b = words(t), words(x)
        k, w = min(5, len(b)), len(b)
        if not b or len(a) < k:
            continue
        grams = lambda s: Counter(tuple(s[j : j + k]) for j in range(len(s) - k + 1))  # noqa: E731, B023
        target, best = grams(b), None
        for s in range(max(1, len(a) - w + 1)):
            own = grams(a[s : s + w])
            both = sum((own & target).values())
            sim = both / (sum(own.values()) + sum(target.values()) - both)
            if sim >= 0.8 and (best is None or sim > best[0] + 1e-12):
                best = (sim, s, len(a[s : s + w]))
        if best:
            want[d, i] = (best[1], best[2], round(best[0], 6))
    got = {(r.doc_id, r.item_id): (r.start, r.n_words, round(r.similarity, 6)) for r in decontaminate.find_copies(docs, bench).collect()}
    assert got == want and len(want) > 5
    assert decontaminate.find_copies(nothing, bench).count() == 0
    assert decontaminate.find_copies(docs, bench.limit(0)).count() == 0


# op2


def test_media(docs, texts, nothing):
    stored = media.store_texts(docs)
    rows = by_id(media.digests(stored), len(texts) + 1)
    for i, t in texts.items():
        raw = (t or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert rows[2]["media_sha256"] == rows[20]["media_sha256"] and rows[2]["feature"] == rows[20]["feature"]
    frames = media.frames_of(stored)
    assert frames.where("doc_id = 0").count() == 1 and frames.where("frame > 0").count() >= 0
    assert media.digests(media.store_texts(nothing)).count() == 0


@pytest.mark.parametrize("size", [192, 192 * 4097])
def test_media_roundtrip(size):
    data = np.random.default_rng(size).integers(0, 256, size, np.uint8).tobytes()
    frames = list(media.read_frames(media.write_gif(data)))
    assert b"".join(f.indices.tobytes() for f in frames) == data and all(f.delay_ms == 100 for f in frames)


def gif(width, height, frames, palette):
    out = media.struct.pack("<6sHHBBB", b"GIF89a", width, height, 0x80 | 1, 0, 0) + bytes(v for c in palette for v in c)
    for box, samples, disposal, transparent, interlaced in frames:
        out += media.struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (transparent is not None), 5, transparent or 0, 0)
        out += media.struct.pack("<BHHHHBB", 0x2C, *box, 0x40 * interlaced, 2) + media._blocks(media.lzw_encode(bytes(samples), 2))
    return out + b"\x3b"


def test_gif_rules():
    red, green, blue, white = palette = [(255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 255)]
    data = gif(2, 2, [((0, 0, 2, 2), [0] * 4, 1, None, 0), ((0, 0, 2, 1), [1, 3], 2, 3, 0), ((1, 1, 1, 1), [2], 3, None, 0), ((0, 1, 1, 1), [3], 1, None, 0)], palette)
    shown = [[tuple(int(v) for v in p[:3]) if p[3] else None for p in f.canvas.reshape(-1, 4)] for f in media.read_frames(data)]
    assert shown == [[red] * 4, [green, red, red, red], [None, None, red, blue], [None, None, white, red]]
    rows = [[y] for y in range(9)]
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    frame = next(media.read_frames(gif(1, 9, [((0, 0, 1, 9), [rows[y][0] % 4 for y in order], 0, None, 1)], palette)))
    assert frame.indices.ravel().tolist() == [y % 4 for y in range(9)]
    for broken in (b"", b"GIF", data[:40]):
        with pytest.raises(ValueError):
            list(media.read_frames(broken))


# op3


def kneser_ney_log_probs(train, text):
    words = lambda t: re.findall(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+", t or "")
    pairs = Counter()
    for t in train:
        w = words(t)
        pairs.update(zip(["<s>", *w], w))
    before = Counter(w for _, w in pairs)
    d, dw = (kneser_ney.discounts(Counter(c.values())) for c in (pairs, before))
    cut = lambda c, d: d[min(c, 3) - 1]
    total = sum(before.values())
    rest = sum(cut(n, dw) for n in before.values()) / total
    size, spared = Counter(), Counter()
    for (v, _), c in pairs.items():
        size[v] += c
        spared[v] += cut(c, d)
    one = lambda w: (max(before[w] - cut(before[w], dw), 0) / total if before[w] else 0) + rest / (len(before) + 1)

    def p(v, w):
        kept = (pairs[v, w] - cut(pairs[v, w], d)) / size[v] if pairs[v, w] else 0.0
        return kept + (spared[v] / size[v] if size[v] else 1.0) * one(w)

    vocabulary = [*before, "<unknown>"]
    for v in ["<s>", *list(before)[:3]]:
        assert math.isclose(sum(p(v, w) for w in vocabulary), 1, rel_tol=1e-9)
    w = words(text)
    return len(w), sum(math.log10(p(*x)) for x in zip(["<s>", *w], w)) / len(w) + kneser_ney.SLACK / math.sqrt(len(w)) if w else None


def test_kneser_ney(docs, texts, nothing):
    train = [texts[i] for i in range(8)]
    model = kneser_ney.train(docs.where("doc_id < 8").dropDuplicates(["doc_id"]))
    got = by_id(kneser_ney.score(docs.dropDuplicates(["doc_id"]), model, ["doc_id"]), len([t for t in texts.values() if t and t.strip()]))
    for i, r in got.items():
        n, value = kneser_ney_log_probs(train, texts[i])
        assert r["n_words"] == n and math.isclose(r["log_prob"], value, rel_tol=1e-6)
    rows = by_id(kneser_ney.classify(docs, docs.where("doc_id < 12").select("doc_id")), len(texts))
    assert all(rows[i]["keep"] for i in range(12)) and not any(rows[i]["keep"] for i in (26, 27, 28))
    assert kneser_ney.classify(nothing, nothing.select("doc_id")).count() == 0


# op4


@pytest.mark.parametrize(("share", "hot"), [(1e-6, 100_000), (0.003, 3), (0.003, 100_000), (0.5, 1)])
def test_katz(spark, docs, texts, nothing, monkeypatch, tmp_path, share, hot):
    """Plain Katz; which words have numbers, which pairs are hot and how blocks are cut makes no difference."""
    monkeypatch.setattr(katz, "SHARE", share)
    monkeypatch.setattr(katz, "HOT_TOKENS", hot)
    monkeypatch.setattr(katz, "BLOCK_CHARS", 3000)
    monkeypatch.setattr(katz, "SHARD_TOKENS", 500)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = by_id(katz.query(spark, str(tmp_path)), len(texts) + 1)
    of = {i: [*lowered(t).encode().split(), None] for i, t in texts.items()}
    out = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    train = [w for i, w in of.items() if not out(i)] + [of[3]] * (not out(3))
    c = Counter(x for w in train for x in w)
    n = sum(c.values())
    p1 = lambda w: (c[w] + 0.1) / (n + 0.1 * (len(c) + 1))
    pairs = Counter(x for w in train for x in zip(["start", *w], w))
    d = katz.discounts(Counter(pairs.values()))
    kept, listed, size = Counter(), Counter(), Counter()
    for (u, v), k in pairs.items():
        kept[u] += k * (d[k - 1] if k <= 5 else 1)
        listed[u] += p1(v)
        size[u] += k
    for u in size:
        size[u] += size[u] - kept[u] < 1e-9

    def p(u, v):
        k = pairs[u, v]
        if k:
            return k * (d[k - 1] if k <= 5 else 1) / size[u]
        return ((1 - kept[u] / size[u]) / max(1 - listed[u], 1e-12) if u in kept else 1) * p1(v)

    assert any(out(i) and any(pairs[x] == 1 for x in zip(w, w[1:])) for i, w in of.items())
    for u in kept:
        assert math.isclose(sum(p(u, v) for v in [*c, "unknown"]), 1, rel_tol=1e-9)
    for i, w in of.items():
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out(i), len(w), sum(x in c for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10(p1(x)) for x in w), rel_tol=1e-7)
        assert math.isclose(r["score"], sum(math.log10(p(*x)) for x in zip(["start", *w], w)), rel_tol=1e-7)
    assert katz.score_documents(nothing).count() == 0


def test_katz_single_pairs(spark, tmp_path):
    """A pair seen once has its discounted count: half an occurrence where counts of counts say nothing."""
    spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    scores = {r.doc_id: r.score for r in katz.query(spark, str(tmp_path)).collect()}
    assert all(math.isclose(scores[i], math.log10(0.5 / 2 * 0.5 * 0.5)) for i in (1, 2))


def test_katz_takes_little_memory(spark, monkeypatch):
    """A shard unpacks and evaluates parts of its tokens, gives out small frames, and tasks get small batches of texts."""
    rng, n, words = np.random.default_rng(1), 100_000, 500
    hashes = np.sort(rng.integers(-(2**62), 2**62, words))
    vocabulary = katz.Vocabulary(hashes, rng.integers(1000, 5000, words), 40 * n, 10 * words, n // 100, np.empty(0, np.int64))
    rare = rng.integers(-(2**62), 2**62, 10 * words) | katz.RARE
    tokens, messages = Counter(), []
    for block, kind in itertools.product(range(8), (katz.PAIR, katz.BY_V, katz.BY_U)):
        docs = rng.integers(0, 1900, n).astype(np.uint16)
        tokens.update((block, d) for d in docs.tolist())
        docs |= np.where(docs % 10 == 0, katz.OUT, 0).astype(np.uint16)
        u, v = (1 + (words * rng.random(n) ** 2).astype(np.int64) for _ in range(2))
        arrays = (u << katz.BITS | v, docs) if kind == katz.PAIR else (rare[(10 * words * rng.random(n) ** 2).astype(int)], docs, v)
        order = np.lexsort((arrays[-1], arrays[0]))
        messages.append((0, kind, block, katz.packed(*(x[order] for x in arrays))))
    rows = pd.DataFrame(messages, columns=["shard", "kind", "block", "packed"])
    monkeypatch.setattr(katz, "OUT_ROWS", 20_000)
    size, asked, seen = 0, 0, 0
    tracemalloc.start()
    for frame in katz._Shard(vocabulary).work(iter([rows])):
        size = max(size, len(frame))
        asks = frame[frame["kind"] == katz.ASKS]
        asked += (asks["x2"] + asks["x3"]).sum()
        seen += (frame["kind"] == katz.SUMS).sum()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 < size <= 20_000 and seen >= 8 and 0 < asked <= sum(tokens.values()) == 24 * n
    assert peak < 32 * 24 * n

    conf, found, stored = "spark.sql.execution.arrow.maxBytesPerBatch", {}, katz.stored
    monkeypatch.setattr(katz, "stored", lambda df, name, *a: found.update({name: spark.conf.get(conf)}) or stored(df, name, *a))
    before = spark.conf.get(conf)
    docs = spark.createDataFrame([(i, f"a b c own{i}") for i in range(20)], "doc_id long, text string")
    assert katz.score_documents(docs).count() == 20
    assert found == {"lm-words": katz.BATCH, "lm-resolved": katz.BATCH} and spark.conf.get(conf) == before


@pytest.mark.parametrize(("part", "rows"), [(1, 1), (50, 7)])
def test_katz_parts_make_no_difference(spark, docs, texts, monkeypatch, part, rows):
    """However a shard's tokens and rows are cut, scores are the same."""
    monkeypatch.setattr(katz, "SHARE", 0.003)
    monkeypatch.setattr(katz, "HOT_TOKENS", 3)
    few = docs.where("doc_id NOT IN (31, 33)")
    want = by_id(katz.score_documents(few), len(texts) - 1)
    monkeypatch.setattr(katz, "PART_TOKENS", part)
    monkeypatch.setattr(katz, "OUT_ROWS", rows)
    monkeypatch.setattr(katz, "SHARD_TOKENS", 900)
    assert by_id(katz.score_documents(few), len(texts) - 1) == want


# op5


@pytest.mark.parametrize(("k", "percent", "members"), [(3, 90, 200), (3, 90, 2), (5, 80, 3), (1, 60, 4)])
def test_jaccard_join(docs, texts, nothing, monkeypatch, k, percent, members):
    monkeypatch.setattr(jaccard_join, "REGION_MEMBERS", members)
    monkeypatch.setattr(jaccard_join, "LARGE", 1)
    rows = by_id(jaccard_join.link_documents(docs, k, percent), len(texts) + 1)
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(lowered(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in rows.items()} == {i: (len(s), find(i)) for i, s in sets.items()}
    if members == 200:
        assert jaccard_join.link_documents(nothing, k, percent).count() == 0


def test_signatures_find_all_links():
    rng = np.random.default_rng(0)
    for percent, n in itertools.product((90, 80, 60), (5, 9, 10, 17, 40, 300, 2000)):
        for _ in range(10):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            for drop, add in itertools.product(range(0, n // 4 + 1, max(1, n // 12)), repeat=2):
                b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, add).astype(np.uint64)]))
                shared = len(np.intersect1d(a, b))
                if (drop or add) and jaccard_join.linked(shared, len(a) + len(b), percent):
                    keys, family, of = jaccard_join.signatures(np.concatenate([a, b]), np.asarray([0, len(a), len(a) + len(b)]), percent)
                    common = Counter(family[of == 0][np.isin(keys[of == 0], keys[of == 1])].tolist())
                    slack = {f: 0 if f & 255 == jaccard_join.LAST_SEED else jaccard_join.parts_of(f >> 8, percent)[2] for f in common}
                    assert any(n > slack[f] for f, n in common.items())


# op6

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    digits = lambda s: [int(c) for c in s if c in "0123456789"]
    luhn = lambda d: sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0
    good = {
        "email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s)), "phone": lambda s: 9 <= len(digits(s)) <= 15,
    }
    return [(k, *m.span()) for k, p in KINDS.items() for m in re.finditer(p, text) if good[k](m[0])]


def test_base_spans():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice([*"aB12345678900..--@@++ ()%_é \n", "1.2.3.4", "@a.b", "+12345678901", "4532015112830366", "256.1.1.1"]) for _ in range(rng.randint(0, 40)))
        base = pii.base_spans(text)
        assert [(pii.KINDS[k], *s) for k, spans in enumerate(base) for s in spans] == plain_spans(text)
        pii.tokens_of(text, base)


def test_field_is_exact_on_trees():
    rng = np.random.default_rng(1)
    field = pii.Field(rng.normal(size=(6, 5)), rng.normal(size=(2, 5, 5)))
    field.edge = field.edge + field.edge.transpose(0, 2, 1)
    shapes, edges = np.arange(4), np.array([[0, 1, 0], [1, 2, 1], [1, 3, 0]])
    weights = {}
    for y in itertools.product(range(5), repeat=4):
        weights[y] = math.exp(sum(field.node[s, a] for s, a in zip(shapes, y)) + sum(field.edge[k, y[a], y[b]] for a, b, k in edges))
    want = np.array([[sum(w for y, w in weights.items() if y[i] == a) for a in range(5)] for i in range(4)]) / sum(weights.values())
    assert np.allclose(field.marginals(shapes, edges), want, atol=1e-3)


def test_personal_data(docs, texts, nothing):
    rows = by_id(pii.find_personal_data(docs), len(texts) + 1)
    for i, t in texts.items():
        base = [(s["kind"], s["start"], s["end"]) for s in rows[i]["base"]]
        assert base == plain_spans(t or "")
        for s in rows[i]["added"]:
            assert not any(s["start"] < b and a < s["end"] for _, a, b in base)
    assert len(rows[32]["base"]) == 5
    assert pii.find_personal_data(nothing).count() == 0


def test_skip_edge_adds_span(spark):
    """A part of a phone number that is repeated on its own: only the edge to the equal token tells it from other numbers."""
    phone, other = "+1 (913) 555-3797", ["730", "884", "917", "662"]
    texts = {i: f"call {phone} and then {phone} end" for i in range(12)}
    texts |= {i: f"about {other[i % 4]} {other[(i + 1) % 4]} of {other[i % 4]}" for i in range(20, 40)}
    texts[90] = f"call {phone} but again 913 here and 459 there"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    added = {r.doc_id: [(s.kind, s.start, s.end) for s in r.added] for r in pii.find_personal_data(docs).collect()}
    start = texts[90].rindex("913")
    assert added == {**{i: [] for i in texts}, 90: [("phone", start, start + 3)]}


def test_values_side_by_side_stay_apart(spark):
    """A card number twice in a row is two values, and so is one beside a secret; the parts of one value are one."""
    card, key = "4465758382889437", "a1B2c3D4e5F6g7H8i9J0kLmN"
    texts = {i: f"pay {card[:4]} {card[4:8]} {card[8:12]} {card[12:]} now, {card}. token {key} end" for i in range(30)}
    texts[90] = f"and {card} {card} too"
    texts[91] = f"key {key} {key} end"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    added = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.added] for r in pii.find_personal_data(docs).collect()}
    assert added[90] == [("card", card)] * 2 and added[91] == [("secret", key)] * 2 and added[0] == [("secret", key)]


# op7


def test_bpe(docs, texts, nothing):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.default_tokenizer()
    real = tokenizers.Tokenizer.from_file(path)
    rows = by_id(bpe.digests(docs, path), len(texts) + 1)
    vocab = bpe.vocabulary(path)
    for i, t in texts.items():
        ids = real.encode(t or "", add_special_tokens=False).ids
        text = real.decode(ids, skip_special_tokens=False)
        assert (rows[i]["n_tokens"], rows[i]["ids_sha256"]) == (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
        assert rows[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    rng = random.Random(4)
    odd = [*"ab 's'té\n\t\x0b\x0c\x1c\x1f\x85\xa0᠎ 　中１ɐɏ²...!?'ll'", "<|endoftext|>", "  ", "hello world"]
    for _ in range(2000):
        text = "".join(rng.choice(odd) for _ in range(rng.randint(0, 50)))
        mine = [i for special, piece in vocab.pieces(text) for i in ([vocab.special[piece]] if special else [x for w in bpe.split(piece) for x in vocab.merge(w.encode())])]
        assert mine == real.encode(text, add_special_tokens=False).ids
    assert bpe.digests(nothing, path).count() == 0


def test_lexicon(tmp_path):
    rng = random.Random(5)
    words = {bytes(rng.choice(b"abc\xc3") for _ in range(rng.randint(1, 7))): [rng.randint(0, 50000) for _ in range(rng.randint(0, 4))] for _ in range(500)}
    path = tmp_path / "lexicon"
    path.write_bytes(bpe.compile_lexicon(words.items()))
    lexicon = bpe.Lexicon(str(path))
    for w, ids in words.items():
        assert np.frombuffer(lexicon.get(w), "<u4").tolist() == ids
    assert lexicon.get(b"abcabcabcabc") is None and lexicon.get(b"zz") is None
    plain = len({w[:i] for w in words for i in range(len(w) + 1)})
    assert len(lexicon.final) < plain  # suffixes are shared


# op8


def test_viterbi():
    rng = np.random.default_rng(0)
    scores = [rng.normal(size=(n, 3)) * 5 for n in (0, 1, 4, 6, 3)]
    value = lambda s, y: sum(s[i, a] for i, a in enumerate(y)) - 3.0 * sum(a != b for a, b in zip(y, y[1:]))
    for s, y in zip(scores, language_id.viterbi(scores, 3.0)):
        assert len(y) == len(s)
        if len(s):
            assert math.isclose(value(s, y), max(value(s, z) for z in itertools.product(range(3), repeat=len(s))))


def test_language_id(spark, nothing):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = language_id.identify_documents(real).join(real.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    model = language_id.train(real.where("lang IS NOT NULL"))
    langs = [real.where(F.col("lang") == x).orderBy(F.desc("n_chars")).first().text[:900] for x in ("fr", "en")]
    mixed = spark.createDataFrame([(1, " ".join(langs)), (2, None), (3, "123 --"), (4, "привет")], "doc_id long, text string")
    out = by_id(language_id.identify(mixed, model, ["doc_id"]), 4)
    assert [s["lang"] for s in out[1]["spans"]] == ["fr", "en"]
    assert out[2]["lang_pred"] == out[3]["lang_pred"] == "und" and out[4]["lang_pred"] in model.languages
    assert language_id.identify_documents(nothing).count() == 0


# op9


@pytest.mark.parametrize("shard_words", [300_000, 60])
def test_substring_dedup(docs, texts, nothing, monkeypatch, shard_words):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(substring_dedup, "TASK_WORDS", 5 * shard_words)
    rows = by_id(substring_dedup.remove_repeats(docs), len(texts) + 1)
    words = {i: WORD.findall(t or "") for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][j : j + 50]), i)
    total = 0
    for i, w in words.items():
        gone = set()
        for j in range(len(w) - 49):
            if first[tuple(w[j : j + 50])] < i:
                gone.update(range(j, j + 50))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        r = rows[i]
        assert (r["n_words"], r["n_removed"]) == (len(w), len(gone))
        assert (r["kept"] if r["kept"] is not None else " ".join(w)) == kept
        total += len(gone)
    assert total > 200
    if shard_words > 60:
        assert substring_dedup.remove_repeats(nothing).count() == 0


def test_grams():
    words = WordHashes()
    hashed = np.asarray([words[w] for w in b"a b c d a b c d e".split()], np.int64)
    for k in (1, 2, 3, 4, 7):
        g = substring_dedup.grams(hashed, k)
        assert len(g) == len(hashed) - k + 1 and (g[0] == g[4 : 5 + 0][0] if k <= 4 else True)
    assert substring_dedup.sliding_min(np.array([3, 1, 2, 5, 4]), 3).tolist() == [1, 1, 2]


# op10


@pytest.mark.parametrize("least", [2, 3])
def test_line_dedup(spark, nothing, least):
    texts = {
        1: ("a", "head\nown one\nhead\n\nfoot"), 2: ("b", " head \nown two\nfoot"), 3: ("c", "head\nown one"), 4: ("c", "foot\n\n"), 5: (None, "head\nx"), 6: ("d", None), 7: ("e", ""), 8: ("a", "head"),
    }
    rows = [(i, s, t, "own") for i, (s, t) in texts.items()] + [(2, *texts[2], "own")]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string, key string")
    sites, owner = {}, {}
    for i, (s, t) in sorted(texts.items()):
        for line in (t or "").split("\n"):
            if line.strip(" "):
                sites.setdefault(line.strip(" "), set()).update({s} - {None})
                owner.setdefault(line.strip(" "), i)
    bad = {x for x, s in sites.items() if len(s) >= least}
    got = by_id(line_dedup.remove_boilerplate(table, "source", least), len(rows))
    for i, (_, t) in texts.items():
        kept, seen = [], set()
        for line in t.split("\n") if t is not None else []:
            k = line.strip(" ")
            if k not in bad or owner[k] == i and k not in seen:
                kept.append(line)
            seen.add(k)
        n = len(t.split("\n")) if t is not None else 0
        assert (got[i]["n_lines"], got[i]["n_removed"], got[i]["text"]) == (n, n - len(kept), "\n".join(kept) if t is not None else None)
    assert line_dedup.remove_boilerplate(nothing).count() == 0


def test_join_lets_go_of_chance_agreement(spark):
    """Texts that share a passage but aren't linked have too few common signatures: none of them travels. Linked ones do."""
    rng = np.random.default_rng(5)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    passage, near = words(40), words(200)
    rows = [(i, " ".join([*words(160), *passage])) for i in range(30)] + [(100, " ".join(near)), (101, " ".join([*near[:-2], "x", "y"]))]
    texts = spark.createDataFrame(rows, "id long, text string")
    found = jaccard_join._recurring_signatures(texts, 5, 80, 3).withColumnRenamed("label", "id")
    assert found.select("id").distinct().count() > 20
    assert jaccard_join._enough(found, 80).select("id").distinct().count() == 2
    got = {r.id: r.component for r in jaccard_join.link_sets(texts, 5, 80).collect()}
    assert got == {i: i for i in range(30)} | {100: 100, 101: 100}


def test_pieces_are_bounded():
    """Long texts don't add up: runs end at so many rows or characters; a text above the bound is alone."""
    lengths = np.asarray([5, 5, 5, 50, 1, 1, 1, 1, 0])
    assert list(jaccard_join.pieces(lengths, 3, 12)) == [(0, 2), (2, 3), (3, 4), (4, 7), (7, 9)]
    assert list(jaccard_join.pieces(lengths[:0], 3, 12)) == []
    long = "a b c e f g h i j k l m n"
    texts = pd.Series([long, long, "", long + " o p q"])
    whole = jaccard_join._own_signatures(texts, 2, 80, jaccard_join.WordHashes())
    assert len(whole[0]) == 2 and set(whole[3]) == {0, 1}


def test_kneser_ney_learns_from_all_text(spark, monkeypatch):
    """A language's trusted text beyond 2.5 million characters counts; rows of the model beyond what is broadcast are joined by a shuffle."""
    monkeypatch.setattr(kneser_ney, "MODEL_ROWS", 6)
    ids = [i for i in range(40)]
    docs = spark.createDataFrame([(i, "en", f"a b c a b own{i} " + "pad " * 120_000) for i in ids] + [(99, "en", "a b c a b")] * 2, "doc_id long, lang string, text string")
    trained, train = [], kneser_ney.train
    monkeypatch.setattr(kneser_ney, "train", lambda d: trained.append(sorted(r.doc_id for r in d.select("doc_id").collect())) or train(d))
    trusted = spark.range(40).withColumnRenamed("id", "doc_id")
    rows = {r.doc_id: r for r in kneser_ney.classify(docs, trusted).collect()}
    half = spark.range(40).where(F.pmod(F.xxhash64("id"), F.lit(kneser_ney._SLICES)) * 2 < kneser_ney._SLICES)
    assert trained == [sorted(r.id for r in half.collect())] and len(trained[0]) * 480_000 > 2_500_000
    texts = [r.text for r in docs.where(F.col("doc_id").isin(trained[0])).collect()]
    n, want = kneser_ney_log_probs(texts, "a b c a b")
    assert rows[99].n_words == 2 * n and rows[99].log_prob - kneser_ney.SLACK / np.sqrt(2 * n) == pytest.approx(want - kneser_ney.SLACK / np.sqrt(n), abs=1e-9)


def test_kneser_ney_travels_packed(spark, monkeypatch):
    """A shard's pairs are one row, what is broadcast takes few bytes a word; small blocks, shards, parts and bounds change no value."""
    texts = [" ".join(f"w{(i * i + 7 * j * j + i * j) % 400}" for j in range(100)) + f" own{i}" for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    learned = docs.where("doc_id < 20")
    model = kneser_ney.train(learned)
    assert model.pairs.count() == model.shards == 1 and model.others is None
    words = len(model.vocabulary.value.hashes)
    assert len(pickle.dumps(model.tables.value)) + len(pickle.dumps(model.vocabulary.value)) < 2000 + 24 * words
    want = {i: kneser_ney_log_probs(texts[:20], t) for i, t in enumerate(texts)}
    for name, value in (("MODEL_ROWS", 50), ("SHARD_TOKENS", 1000), ("PART_CHARS", 2000), ("BLOCK_TOKENS", 500), ("BLOCK_ROWS", 3)):
        monkeypatch.setattr(kneser_ney, name, value)
    few = kneser_ney.train(learned)
    assert few.shards > 1 and few.others is not None and len(few.vocabulary.value.hashes) <= 50
    for m in (model, few):
        got = {r.doc_id: r for r in kneser_ney.score(docs, m, ["doc_id"]).collect()}
        assert len(got) == 30
        for i, (n, value) in want.items():
            assert got[i].n_words == n and got[i].log_prob == pytest.approx(value, abs=1e-9)


def test_kneser_ney_tasks_hold_little(spark, monkeypatch):
    """Words reach tasks in small batches; a task's copy of the model is made array by array and keeps no more than scores take."""
    n = 300_000
    stats = [kneser_ney.packed(np.arange(n), np.arange(n) * k % 97) for k in (1, 3, 5, 7, 11)]
    tables = kneser_ney.Tables(stats, np.asarray([0.5, 1.0, 1.5]), np.asarray([0.4, 0.9, 1.4]), 10**6, 1e-9, np.arange(3), np.arange(1, 4))
    data = pickle.dumps(tables)
    packed = sum(map(len, stats))
    tracemalloc.start()
    copy = pickle.loads(data)
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert all((x == y).all() for x, y in ((copy.size, tables.size), (copy.back, tables.back), (copy.p, tables.p), (copy.hot, tables.hot)))
    assert kept < 28 * n + packed and peak < 70 * n + packed
    conf, seen, stored = "spark.sql.execution.arrow.maxBytesPerBatch", {}, kneser_ney.stored
    monkeypatch.setattr(kneser_ney, "stored", lambda df, name, *a: seen.update({name: spark.conf.get(conf)}) or stored(df, name, *a))
    before = spark.conf.get(conf)
    docs = spark.createDataFrame([(i, "en", f"a b c own{i}") for i in range(20)], "doc_id long, lang string, text string")
    assert kneser_ney.classify(docs, docs.select("doc_id")).count() == 20
    assert (seen["kn-counted"], seen["kn-sums"], seen["kn-scores"]) == (kneser_ney.BATCH, kneser_ney.BATCH, before) and spark.conf.get(conf) == before
    sizes = docs.sparkSession.range(200, numPartitions=1).select(F.sequence(F.lit(0).cast("long"), F.lit(999).cast("long")).alias("w"))
    with arrow_batches(spark, "100k"):
        rows = sizes.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    assert sum(r.n for r in rows) == 200 and max(r.n for r in rows) < 20


def test_bpe_digests_take_one_worker(spark):
    """Texts are encoded and decoded in one Python node: two in a task leave an executor with twice as many workers."""
    texts = ["a b", None, "", "caf\u00e9 \U0001f600  x", "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    done = bpe.digests(docs, bpe.default_tokenizer())
    assert done._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    plain = bpe.decode(bpe.encode(docs, bpe.default_tokenizer()), bpe.default_tokenizer())
    want = {(r.doc_id, hashlib.sha256(r.ids).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()) for r in plain.collect()}
    assert {(r.doc_id, r.ids_sha256, r.decoded_sha256) for r in done.collect()} == want and len(want) == 5
    assert {r.text for r in plain.collect()} == {t or "" for t in texts}
