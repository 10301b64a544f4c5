"""Language ID against a plain version: labels, scores and spans of whole tables, ties and repeated rows."""

import math
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracelake.llm import language_id

SF = "/root/testdata/sf0.001"


def words(text):
    """Runs of letters and marks that have a letter; marks before the first letter belong to it."""
    out, run = [], ""
    for c in text.lower() + " ":
        if unicodedata.category(c)[0] in "LM":
            run += c
        else:
            if any(unicodedata.category(x)[0] == "L" for x in run):
                out.append(run)
            run = ""
    return out


def features(word):
    out, points = [], [10, *map(ord, word), 10]
    for n in range(1, language_id.SIZE + 1):
        for i in range(len(points) - n + 1):
            part = points[i : i + n]
            if part == [10] or 10 in part[1:-1]:
                continue
            value = 0
            for p in part:
                value = (value * 0x9E3779B1 + p) % 2**64
            out.append(((value ^ n) * 0xC2B2AE3D27D4EB4F % 2**64) >> 40 & language_id.FEATURES - 1)
    return out


def plain(rows):
    """{(doc_id, text): (language, score, spans)} of rows (doc_id, lang, text)."""
    held_out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    counts, letters = defaultdict(Counter), defaultdict(Counter)
    for i, lang, text in rows:
        if not held_out(i) and lang is not None and text is not None:
            for w in words(text):
                counts[lang].update(features(w))
                letters[language_id.script(w)][lang] += len(w)
    languages = sorted(counts)
    sums = {g: sum(counts[g].values()) for g in languages}
    all_letters = Counter()
    for own in letters.values():
        all_letters.update(own)
    log = lambda g, f: float(np.float32(math.log((counts[g][f] + 0.5) / (sums[g] + 0.5 * language_id.FEATURES))))

    def score(word):
        raw = [sum(log(g, f) for f in features(word)) for g in languages]
        known = letters.get(language_id.script(word), {})
        able = [known.get(g, 0) >= language_id.SCRIPT_SHARE * max(all_letters[g], 1) for g in languages]
        able = able if known and any(able) else [True] * len(languages)
        return [max(x - max(raw), -30) if ok else -30 for x, ok in zip(raw, able, strict=True)]

    memo, out = {}, {}
    for i, _, text in rows:
        w = words(text or "") if languages else []
        if not w:
            out[i, text] = ("und", 0.0, [])
            continue
        best, back = None, []
        for word in w:
            own = memo[word] = memo.get(word) or score(word)
            if best is None:
                best = own
            else:
                top = max(range(len(best)), key=lambda j: best[j])
                came = [j if best[j] >= best[top] - language_id.PENALTY else top for j in range(len(best))]
                best = [(best[j] if came[j] == j else best[top] - language_id.PENALTY) + own[j] for j in range(len(best))]
                back.append(came)
        label = [max(range(len(best)), key=lambda j: best[j])]
        for came in reversed(back):
            label.append(came[label[-1]])
        label.reverse()
        size = [sum(len(x) for x, y in zip(w, label, strict=True) if y == j) for j in range(len(languages))]
        top = max(range(len(languages)), key=lambda j: size[j])
        cuts = [0, *(k for k in range(1, len(label)) if label[k] != label[k - 1]), len(label)]
        out[i, text] = (languages[top], size[top] / sum(size), [(a, b, languages[label[a]]) for a, b in zip(cuts, cuts[1:], strict=False)])
    return out


def compare(got, rows):
    want = plain(rows)
    assert len(got) == len(rows)
    for r in got:
        lang, score, spans = want[r.doc_id, r.whole]
        assert (r.lang_pred, [tuple(s) for s in r.spans]) == (lang, spans), r.doc_id
        assert math.isclose(r.score, score, abs_tol=1e-12) and 0 <= r.score <= 1


def found(docs):
    """identify_documents() with the texts, in the order of the rows."""
    rows = [(r.doc_id, r.lang, r.text) for r in docs.select("doc_id", "lang", "text").collect()]
    model = language_id.train(docs.where(language_id.learned_from(docs.doc_id) & docs.lang.isNotNull() & docs.text.isNotNull()))
    return language_id.identify(docs.select("doc_id", docs.text.alias("whole"), "text"), model, ["doc_id", "whole"]).collect(), rows


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got, rows = found(docs)
    compare(got, rows)
    assert sum(len(r.spans) > 1 for r in got) >= 1
    of = {r.doc_id: r for r in got}
    for r in language_id.query(spark, SF).collect():
        assert (r.lang_pred, r.score) == (of[r.doc_id].lang_pred, of[r.doc_id].score) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


@pytest.mark.parametrize("order", [1, -1])
def test_ties_scripts_and_repeated_rows(spark, order):
    """Two languages that are learned from the same text tie on every word: the first in alphabetical order is taken."""
    same = "the quick brown fox jumps over the lazy dog " * 3
    learned = iter(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2)
    texts = [("bb", same), ("aa", same), ("ru", "съешь же ещё этих мягких французских булок " * 3), (None, "nothing is learned from this"), ("aa", ""), ("bb", "\u0301\u0302 123"), ("ru", None)]
    rows = [(next(learned), *t) for t in texts] + [(None, "aa", None)]
    rows += [(500 + i, None, t) for i, t in enumerate([same, "fox " + "мягких булок ещё " * 4 + "dog fox quick brown", "été ́a", "漢字 fox", "x", same])]
    rows += [rows[2], rows[-1]]
    docs = spark.createDataFrame(rows[::order], "doc_id long, lang string, text string").repartition(2)
    got, given = found(docs)
    compare(got, given)
    assert {r.lang_pred for r in got if r.whole == same} == {"aa"}
    assert any({s.lang for s in r.spans} == {"aa", "ru"} for r in got)
