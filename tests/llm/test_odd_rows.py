"""Rows that are odd: no doc_id, one doc_id with several texts, clashing columns, files that are broken, long and empty texts."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import bpe, decontaminate, jaccard_join, katz, kneser_ney, language_id, line_dedup, media, pii, substring_dedup

WORDS = [f"w{i}" for i in range(60)]
PASSAGE = " ".join(WORDS)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None, "no id here " + PASSAGE), (None, "another without id"), (None, None), (1, "same id, one text"), (1, "same id, other text " + PASSAGE), (1, "same id, one text"), (2, None), (3, ""), (4, " \n "), (5, "́̂"), (6, "x " * 3000)]
    data = [(i, t, "en", "s", 0, 1, "k", 2, 3, 4) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, row long, key string, label long, hash long, block long")


def ids(rows):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in rows)


EXPECTED = sorted([(True, 0)] * 3 + [(False, 1)] * 3 + [(False, i) for i in range(2, 7)])


@pytest.mark.parametrize("name", ["media", "katz", "join", "pii", "bpe", "language", "substrings", "lines"])
def test_every_row_has_a_result(spark, odd, name):
    run = {
        "media": lambda d: media.digests(media.store_texts(d)), "katz": katz.score_documents, "join": jaccard_join.link_documents, "pii": pii.find_personal_data,
        "bpe": lambda d: bpe.digests(d, bpe.default_tokenizer()), "language": language_id.identify_documents, "substrings": substring_dedup.remove_repeats,
        "lines": line_dedup.remove_boilerplate,
    }[name]
    assert ids(run(odd).select("doc_id").collect()) == EXPECTED
    assert run(odd.limit(0)).count() == 0


def test_join_judges_rows_by_their_text(odd):
    rows = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_join.link_documents(odd, 3, 50).collect()}
    # The passage makes most of two texts; one of them has no id, so the other's id is the smallest.
    assert rows[(None, 61)] == 1 and rows[(1, 62)] == 1 and rows[(1, 2)] == 1 and rows[(None, 1)] is None and rows[(2, 0)] == 2


def test_decontaminate_keeps_rows_apart(spark):
    docs = spark.createDataFrame([(1, "nothing of note"), (1, "before " + PASSAGE + " after"), (None, PASSAGE), (2, "x")], "doc_id long, text string")
    items = spark.createDataFrame([(7, PASSAGE), (None, PASSAGE)], "item_id long, text string")
    found = decontaminate.find_copies(docs, items).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.start, r.similarity) for r in found) == [(0, 7, 0, 1.0), (1, 7, 1, 1.0)]
    texts = {r.h: r.text for r in docs.select(F.xxhash64("text").alias("h"), "text").collect()}
    assert {texts[r.text_hash] for r in found} == {"before " + PASSAGE + " after", PASSAGE}
    assert decontaminate.find_copies(docs.limit(0), items).count() == 0 and decontaminate.find_copies(docs, items.limit(0)).count() == 0


def test_simhash_counts_beyond_two_bytes(spark):
    """A weight of 70,000 isn't lost in the counters."""
    rows = spark.createDataFrame([(1, -1, 70_000), (1, 0, 69_999)], "id long, feature long, weight long")
    assert decontaminate.simhash_blocks(rows, ["id"]).first().blocks == [255] * 8


def test_broken_media(spark):
    good = media.write_gif(media.padded(b"abc"))
    short = bytearray(good)
    short[8:10] = (1000).to_bytes(2, "little")
    at = good.index(b"\x2c", 13 + 768)  # the frame's own size
    short[at + 7 : at + 9] = (1000).to_bytes(2, "little")
    table = spark.createDataFrame([(1, good), (1, good[:-9]), (1, None), (1, b"no"), (2, bytes(short))], "doc_id long, media binary")
    assert [(r.doc_id, r.frame) for r in media.frames_of(table).collect()] == [(1, 0)]
    with pytest.raises(ValueError, match="too short"):
        list(media.read_frames(bytes(short)))


def test_features_of_media(spark):
    """Feature and sizes against a plain count of the payload's bytes, a grey palette's levels."""
    text = "aé" * 500
    row = media.digests(media.store_texts(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    payload = np.frombuffer(media.padded(text.encode()), np.uint8)
    level = payload.astype(int) * media.LEVELS >> 8
    counts = np.bincount((level * media.LEVELS + level) * media.LEVELS + level)
    told = ",".join(f"{i}:{n}" for i, n in enumerate(counts) if n)
    assert row.feature.endswith("colours=" + told) and row.feature.startswith("frames=1;")
    file = media.write_gif(payload.tobytes())
    assert (row.media_bytes, row.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
    frames = media.frames_of(media.store_texts(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (frames.at_ms, frames.delay_ms) == (0, 100) and sum(frames.histogram) == len(payload)


def test_lines_clashing_columns_and_sure_sketches(spark):
    rows = [(i, f"own {i}\n stamp \nmore", f"site{i}", 9, 9) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines long, n_removed long")
    out = line_dedup.remove_boilerplate(docs)
    assert out.columns == ["doc_id", "text", "source", "n_lines", "n_removed"]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in out.collect()}
    # Far above the threshold the sketch alone decides.
    assert got[0] == ("own 0\n stamp \nmore", 3, 0) and all(got[i] == (f"own {i}", 3, 2) for i in range(1, 400))


def test_quality_rows_of_one_id(spark):
    good = [(i, " ".join(f"word{(i * j) % 40}" for j in range(1, 120)), "en") for i in range(60)]
    docs = spark.createDataFrame([*good, (None, good[0][1], "en"), (None, "☃ ☄ " * 40, "en"), (0, None, None)], "doc_id long, text string, lang string")
    trusted = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id")
    rows = kneser_ney.classify(docs, trusted).collect()
    assert sorted(r.keep for r in rows if r.doc_id is None) == [False, True] and sum(r.doc_id == 0 for r in rows) == 2


def test_secrets_and_batches(spark):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    texts = {i: f'here "{key}" and no more' for i in range(8)} | {i: f"word number {i} and {i + 1} text" for i in range(20, 60)}
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.added] for r in pii.find_personal_data(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert all(found[i] == ([("secret", 6, 46)] if i < 8 else []) for i in texts)
    field = pii.Field(np.random.default_rng(0).normal(size=(6, 5)), np.random.default_rng(1).normal(size=(2, 5, 5)))
    field.edge = field.edge + field.edge.transpose(0, 2, 1)
    one, ring = np.array([[0, 1, 0]]), np.array([[0, 1, 0], [1, 2, 1], [2, 3, 0], [0, 3, 1]])
    alone = field.marginals(np.arange(2), one)
    together = field.marginals(np.array([0, 1, 2, 3, 4, 5]), np.concatenate([one, ring + [2, 2, 0]]), np.array([0, 0, 1, 1, 1, 1]))
    assert np.array_equal(alone, together[:2])


def test_join_ends_soon_on_large_families(spark, monkeypatch):
    """Copies of one text, each with many edits of its own: the centre keeps what the pivot lacks from coming back round after round."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(150):
        words = [w if rng.random() > 0.02 * (1 + i % 4) else f"e{rng.integers(10**6)}" for w in base]
        texts.append((i, " ".join(words)))
    monkeypatch.setattr(jaccard_join, "REGION_MEMBERS", 20)
    monkeypatch.setattr(jaccard_join, "LARGE", 5)
    rounds = []
    plain = jaccard_join._distances
    monkeypatch.setattr(jaccard_join, "_distances", lambda *a: rounds.append(1) or plain(*a))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.link_documents(docs, 5, 80).collect()}
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(116)} for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    assert got == {i: find(i) for i in sets} and len(set(got.values())) > 5
    assert len(rounds) <= 6


def test_join_ends_regions_in_one_pass(spark, monkeypatch):
    """Copies of copies, each with edits of its own that its copies keep: texts reach the regions once and the shells once, whatever they share."""
    rng = np.random.default_rng(7)
    texts = [[f"b{i}" for i in range(90)]]
    for _ in range(139):
        words = list(texts[int(rng.integers(len(texts)))])
        for at in rng.integers(0, 90, 1 + len(texts) % 2):
            words[at] = f"e{rng.integers(10**6)}"
        texts.append(words)
    sets = [{tuple(w[j : j + 5]) for j in range(86)} for w in texts]
    want, shared = list(range(140)), lambda a, b: len(sets[a] & sets[b])
    for a in range(140):
        for b in range(a):
            if want[a] != want[b] and 100 * shared(a, b) >= 80 * (172 - shared(a, b)):
                low, high = sorted((want[a], want[b]))
                want = [low if x == high else x for x in want]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    plain, tables = jaccard_join.stored, []
    keep = lambda df, name, *a: tables.append(name) or plain(df, name, *a)
    monkeypatch.setattr(jaccard_join, "stored", keep)
    monkeypatch.setattr(jaccard_join, "LARGE", 5)
    for members, shingles in ((16, None), (320, 5)):  # so many members, or members that weigh as much
        monkeypatch.setattr(jaccard_join, "REGION_MEMBERS", members)
        if shingles:
            monkeypatch.setattr(jaccard_join, "MEMBER_SHINGLES", shingles)
        tables.clear()
        assert [r.component_id for r in jaccard_join.link_documents(docs, 5, 80).orderBy("doc_id").collect()] == want and 5 < len(set(want)) < 130
        assert [tables.count(f"join-{x}") for x in ("distances", "shells", "closed")] == [1, 1, 1]


def test_join_windows_keep_linked_pairs(spark, monkeypatch):
    """Shells of a region whose distances to the pivot differ by more than linked sets can aren't joined; nor are those of the pivot's links."""
    monkeypatch.setattr(jaccard_join, "REGION_MEMBERS", 8)
    members = [(i, 100, d, d > 20) for i, d in enumerate([0, 3, 9, 15, 20, 20, 30, 31, 40, 44, 60, 70, 95, 96, 140, 150, 180, 181, 182, 183])]
    rows = spark.createDataFrame([(1, *m) for m in members], "pivot long, id long, n long, d long, open boolean")
    groups = {}
    for r in jaccard_join._shells(rows, 80).collect():
        groups.setdefault((r.key.x, r.key.y), ([], []))[r.side].append(r.id)
    joined = {tuple(sorted((a, b))) for (x, y), (left, right) in groups.items() for a in left for b in (left if x == y else right) if a != b}
    wanted = {(a, b) for a, _, da, oa in members for b, _, db, ob in members if a < b and (oa or ob) and abs(da - db) <= 200 / 9}
    assert wanted <= joined and all(oa or ob for a, _, _, oa in members for b, _, _, ob in members if (a, b) in joined)
    assert len(joined) < 120 and max(len(left) + len(right) for left, right in groups.values()) <= 16
