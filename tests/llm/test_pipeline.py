"""The pipeline stage by stage against plain Python, over all of the smallest tables."""

import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_small_tables import WORD, kneser_ney_log_probs, lowered
from tracelake.llm import bpe, kneser_ney
from tracelake.llm.line_dedup import MIN_SITES

SF = "/root/testdata/sf0.001"


def plain_quality(spark, docs, labels):
    ids = spark.createDataFrame([(i,) for i in docs], "i long").select("i", F.pmod(F.xxhash64("i"), F.lit(kneser_ney._SLICES)).alias("s")).collect()
    slot = {r.i: r.s for r in ids}
    good = {r.doc_id for r in labels if r.quality == 1 and r.toxic == 0}
    chars = Counter()
    for i, d in docs.items():
        if i in good:
            chars[d["lang"]] += len(d["text"])
    limit = {lang: min(0.5, kneser_ney.TRAIN_CHARS / max(n, 1)) * kneser_ney._SLICES for lang, n in chars.items()}
    train = [d["text"] for i, d in docs.items() if i in good and slot[i] * 2 < kneser_ney._SLICES and slot[i] < limit[d["lang"]]]
    scores = plain_scores(train, docs)
    low = {}
    for lang in {d["lang"] for d in docs.values()}:
        own = [(scores[i],) for i, d in docs.items() if d["lang"] == lang and i in good and slot[i] * 2 >= kneser_ney._SLICES and scores[i] is not None]
        if own:
            low[lang] = spark.createDataFrame(own, "x double").agg(F.percentile_approx("x", 1 - kneser_ney.QUANTILE, 10_000)).first()[0] - kneser_ney.MARGIN
    least = min(low.values(), default=float("-inf"))
    return {i: d for i, d in docs.items() if scores[i] is not None and scores[i] >= low.get(d["lang"], least) - 1e-9}


def plain_scores(train, docs):
    joined = {i: kneser_ney_log_probs(train, d["text"]) for i, d in docs.items()}
    return {i: x[1] if x else None for i, x in joined.items()}


def plain_lines(docs):
    sites, owner = {}, {}
    for i, d in sorted(docs.items()):
        for line in d["text"].split("\n"):
            if line.strip(" "):
                sites.setdefault(line.strip(" "), set()).add(d["source"])
                owner.setdefault(line.strip(" "), i)
    bad, out = {x for x, s in sites.items() if len(s) >= MIN_SITES}, {}
    for i, d in docs.items():
        kept, seen = [], set()
        for line in d["text"].split("\n"):
            k = line.strip(" ")
            if k not in bad or owner[k] == i and k not in seen:
                kept.append(line)
            seen.add(k)
        text = "\n".join(kept)
        if text == d["text"] or text.strip(" "):
            out[i] = {**d, "text": text, "n_chars": len(text)}
    return out


def plain_duplicates(docs, k=5, percent=80):
    sets = {}
    for i, d in docs.items():
        w = WORD.findall(lowered(d["text"]))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i: d for i, d in docs.items() if find(i) == i}


def plain_clean(docs, items):
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    targets = []
    for x in items:
        b = words(x)
        k = min(5, len(b))
        targets.append((len(b), k, Counter(tuple(b[j : j + k]) for j in range(len(b) - k + 1))))
    out = {}
    for i, d in docs.items():
        a, copy = words(d["text"]), False
        grams = {k: [tuple(a[j : j + k]) for j in range(len(a) - k + 1)] for k in {t[1] for t in targets}}
        for w, k, target in targets:
            if not any(g in target for g in grams[k]):
                continue
            for s in range(max(1, len(a) - w + 1)):
                own = Counter(grams[k][s : s + w - k + 1])
                both = sum((own & target).values())
                copy |= both >= 0.8 * (sum(own.values()) + sum(target.values()) - both) - 1e-9
        if not copy:
            out[i] = d
    return out


def test_pipeline(spark):
    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {r.doc_id: r.asDict() for r in docs.collect()}
    plain = [lambda d: plain_quality(spark, d, labels), plain_lines, plain_duplicates, lambda d: plain_clean(d, items)]
    for (name, stage), function in zip(corpus_pipeline.STAGES, plain):
        want = function(want)
        found = stage(spark, docs, SF)
        assert found.columns == docs.columns
        assert {r.doc_id: r.asDict() for r in found.collect()} == want, name
        docs = spark.createDataFrame([tuple(d.values()) for d in want.values()], docs.schema)
    real = tokenizers.Tokenizer.from_file(bpe.default_tokenizer())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    for i, d in want.items():
        ids = real.encode(d["text"], add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(d["text"].encode()).hexdigest())
    assert got == want


def test_stages_take_odd_rows(spark):
    """Nulls, empty texts and repeated rows go through every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    odd = spark.createDataFrame([(9001, None, "en", "s", None), (9002, "", None, None, 0), (None, "some text here", "en", "s", 1), (9003, "x", "en", "s", 1), (9003, "x", "en", "s", 1)], docs.schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs.unionByName(odd), docs.limit(0)):
            assert stage(spark, table, SF).columns == docs.columns
