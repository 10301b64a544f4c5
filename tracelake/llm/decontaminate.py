"""Benchmark decontamination: item-sized windows of documents that are similar to benchmark items.

1. Texts are words (letters and digits, in lower case); their features are runs of five words, weighted by how often
   they occur. A window that is similar enough has most of an item's features, and the best window of a document starts
   at one of them (moving a window's start on to the next feature of the item drops nothing that counts). So the
   windows to look at start where a feature of an item starts.
2. Each such window gets a 64-bit SimHash of its weighted features, as does each item. The 64 bits are cut into eight
   blocks. Two fingerprints within RADIUS differ in some block by RADIUS // 8 bits at most, so an index of all such
   variants of the items' blocks gives every item within the radius. A window probes the index for the items whose
   features it has enough of; at this similarity fingerprints alone would let too many others through.
3. The weighted Jaccard similarity of what is found is computed exactly.

Everything runs as DataFrame expressions. Hot passages add windows in proportion to their occurrences, no pairs of
documents are made, and the benchmark's tables are only broadcast up to a checked number of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import small, stored

#: Words of a feature; weighted Jaccard similarity from which on a window counts as a copy.
SHINGLE, SIMILARITY = 5, 0.8
#: Bits of two fingerprints that may differ. Features of similarity 0.8 differ in about 10 of 64 bits, with a deviation
#: of about 3; beyond this radius are fewer than one in 100,000 of them.
RADIUS = 23
BLOCKS, BLOCK_BITS = 8, 8
LANES = 32  # bits per counter when the bits of many features are counted at a time
LANE_MASK = 0x0000000100000001


def words_of(text: Column) -> Column:
    """Letters and digits in lower case, as words; null and blank texts have none."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _runs(words: Column, k: int) -> Column:
    """Array of structs of k consecutive words each."""
    n = F.greatest(F.size(words) - (k - 1), F.lit(0))
    return F.arrays_zip(*(F.slice(words, i + 1, n).alias(f"w{i}") for i in range(k)))


def _features(table: DataFrame, keep: list[str], k: int, words: str = "words") -> DataFrame:
    """(keep..., pos, feature): the runs of k words of each row, hashed to 64 bits."""
    rows = table.where(F.size(words) >= k).select(*keep, F.posexplode(_runs(F.col(words), k)).alias("pos", "run"))
    return rows.select(*keep, "pos", F.xxhash64(F.lit(k), *(F.col(f"run.w{i}") for i in range(k))).alias("feature"))


def simhash_blocks(features: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:
    """(keys..., blocks): array of eight 8-bit blocks of the SimHash of each group's weighted features.

    A bit is set if the features that have it weigh more than those that don't. Two bits' weights are summed at a time,
    in the halves of a long (groups weigh less than 2 ** 32).
    """
    lanes = [F.sum(F.shiftrightunsigned("feature", j).bitwiseAND(F.lit(LANE_MASK)) * F.col(weight)).alias(f"s{j}") for j in range(LANES)]
    sums = features.groupBy(*keys).agg(F.sum(weight).alias("total"), *lanes)

    def bit(i: int) -> Column:
        votes = F.shiftrightunsigned(F.col(f"s{i % LANES}"), i - i % LANES).bitwiseAND(F.lit(0xFFFFFFFF))
        return (2 * votes > F.col("total")).cast("int")

    blocks = [reduce(lambda a, b: a + b, (bit(BLOCK_BITS * i + j) * (1 << j) for j in range(BLOCK_BITS))) for i in range(BLOCKS)]
    return sums.select(*keys, F.array(*blocks).alias("blocks"))


def _variants() -> list[int]:
    """All values that differ from a block in no more bits than the radius allows one block."""
    return [x for x in range(1 << BLOCK_BITS) if x.bit_count() <= RADIUS // BLOCKS]


def _distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def find_copies(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity, text_hash): the best window of each document that copies an item.

    start counts words from 0; of equally similar windows the first is given. An item with fewer words than a feature is
    one feature as a whole. A document shorter than an item is one window. Null or blank texts and items copy nothing,
    and neither do items without an id. Rows with one doc_id, or none, and different texts are documents of their own;
    text_hash is xxhash64 of the text and tells them apart. Repeated rows are one document or item. Empty tables give an
    empty result; other columns are not read, whatever their names.
    """
    items = benchmark.where("item_id IS NOT NULL").select("item_id", words_of(F.col("text")).alias("words"))
    items = items.where(F.size("words") > 0).dropDuplicates().select("item_id", "words", F.size("words").alias("w"))
    items = stored(items.select("*", F.least(F.col("w"), F.lit(shingle)).alias("k")), "decon-items")
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # numbers from 1 to shingle
    if not sizes:
        sizes = [shingle]
    parts = [_features(items.where(F.col("k") == k), ["item_id", "w", "k"], k) for k in sizes]
    item_features = reduce(DataFrame.unionByName, parts).groupBy("item_id", "w", "k", "feature").agg(F.count("*").alias("weight"))
    item_features = stored(item_features, "decon-item-features")
    # A document goes by two hashes, which are there whether it has an id or not.
    doc = ["h1", "h2"]
    texts = docs.where("text IS NOT NULL").select(
        "doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("doc"), F.col("doc_id"), F.col("text")).alias("h2"), words_of(F.col("text")).alias("words")
    ).withColumn("size", F.size("words"))

    # Where features of items start in documents.
    wanted = small(stored(item_features.select("k", "feature").distinct(), "decon-features"))
    hits = [
        _features(texts, ["doc_id", *doc, "size"], k).join(wanted.where(F.col("k") == k).drop("k"), "feature").withColumn("k", F.lit(k)) for k in sizes
    ]
    per_doc = reduce(DataFrame.unionByName, hits).distinct().join(small(item_features.drop("weight")), ["k", "feature"])
    share = similarity / (1 + similarity)
    per_doc = per_doc.groupBy("doc_id", *doc, "size", "item_id", "w", "k").agg(F.sort_array(F.collect_set("pos")).alias("places"))
    in_window = F.least("w", "size") - F.col("k") + 1
    need = F.greatest(F.ceil(share * (in_window + F.col("w") - F.col("k") + 1) - 1e-9), F.lit(1)).cast("int")
    dense = F.filter(
        F.transform("places", lambda p, i: F.struct(p.alias("at"), F.get(F.col("places"), i + F.col("need") - 1).alias("last"))),
        lambda x: x["last"] - F.least(x["at"], F.greatest(F.col("size") - F.col("w"), F.lit(0))) <= F.col("w") - F.col("k"),
    )
    starts = F.array_distinct(F.transform(dense, lambda x: F.least(x["at"], F.greatest(F.col("size") - F.col("w"), F.lit(0)))))
    # One row per window and item that it may copy.
    window_keys = [*doc, "start", "w", "k"]
    asked = stored(per_doc.withColumn("need", need).select("doc_id", *doc, "w", "k", "item_id", F.explode(starts).alias("start")), "decon-windows")

    # Weighted features and fingerprints of windows.
    windows = small(stored(asked.select(*window_keys).distinct(), "decon-window-keys"))
    cut = texts.drop("doc_id", "size").join(windows, doc).select(*window_keys, F.slice("words", F.col("start") + 1, F.col("w")).alias("words")).dropDuplicates(window_keys)
    features = reduce(DataFrame.unionByName, [_features(cut.where(F.col("k") == k), window_keys, k) for k in sizes])
    features = stored(features.groupBy(*window_keys, "feature").agg(F.count("*").alias("weight")), "decon-window-features")
    item_prints = simhash_blocks(item_features, ["item_id", "w", "k"])
    window_prints = simhash_blocks(features, window_keys)
    variants = F.array(*map(F.lit, _variants()))
    index = item_prints.select("item_id", "w", "blocks", F.posexplode("blocks").alias("block", "value"), variants.alias("flips"))
    index = index.select("item_id", "w", F.col("blocks").alias("item_blocks"), "block", F.explode(F.transform("flips", lambda f: f.bitwiseXOR(F.col("value")))).alias("value"))
    probes = window_prints.join(asked.select(*window_keys, "item_id"), window_keys).select(*window_keys, "item_id", "blocks", F.posexplode("blocks").alias("block", "value"))
    near = probes.join(small(stored(index.drop("w"), "decon-index")), ["item_id", "block", "value"])
    near = near.where(_distance(F.col("blocks"), F.col("item_blocks")) <= RADIUS).select(*window_keys, "item_id").distinct()

    # Exact similarity of the candidates.
    weights = features.join(near, window_keys)
    of_item = item_features.select("item_id", "feature", F.col("weight").alias("item_weight"))
    shared = weights.join(small(of_item), ["item_id", "feature"], "left").groupBy(*window_keys, "item_id").agg(
        F.sum("weight").alias("n"), F.sum(F.least("weight", F.coalesce("item_weight", F.lit(0)))).alias("shared")
    )
    ratio = F.col("shared") / (F.col("n") + F.col("w") - F.col("k") + 1 - F.col("shared"))
    found = shared.withColumn("similarity", ratio).where(F.col("similarity") >= similarity - 1e-12)
    best = F.max_by(F.struct("start", (F.col("n") + F.col("k") - 1).cast("long").alias("n_words"), "similarity"), F.struct("similarity", -F.col("start")))
    found = found.groupBy(*doc, "item_id").agg(best.alias("best")).join(asked.select("doc_id", *doc).distinct(), doc)
    return found.select(
        "doc_id", "item_id", F.col("best.start").cast("long").alias("start"), "best.n_words", F.round("best.similarity", 6).alias("similarity"), F.col("h1").alias("text_hash")
    )


ORACLE = f"""
WITH dw AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\\pL\\pN]+') AS a FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, a, len(a) AS w, least(len(a), {SHINGLE}) AS k FROM
  (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\\pL\\pN]+') AS a FROM benchmark) WHERE len(a) > 0),
ks AS (SELECT DISTINCT k FROM iw),
df AS (SELECT doc_id, k, len(a) AS size, unnest(generate_series(0, len(a) - k)) AS pos, a FROM dw, ks WHERE len(a) >= k),
ds AS (SELECT doc_id, k, size, pos, list_slice(a, pos + 1, pos + k) AS f FROM df),
itf AS (SELECT item_id, w, k, unnest(generate_series(0, w - k)) AS pos, a FROM iw),
its AS (SELECT item_id, w, k, list_slice(a, pos + 1, pos + k) AS f, count(*) AS c FROM itf GROUP BY ALL),
hit AS (SELECT ds.doc_id, its.item_id, its.w, its.k, ds.size, ds.pos, ds.f, its.c FROM ds JOIN its ON ds.k = its.k AND ds.f = its.f),
win AS (SELECT DISTINCT doc_id, item_id, w, k, size, least(pos, greatest(size - w, 0)) AS start FROM hit),
cnt AS (SELECT win.doc_id, win.item_id, win.w, win.k, win.size, win.start, hit.f, least(count(*), any_value(hit.c)) AS m
  FROM win JOIN hit ON win.doc_id = hit.doc_id AND win.item_id = hit.item_id AND hit.pos BETWEEN win.start AND win.start + win.w - win.k GROUP BY ALL),
sim AS (SELECT doc_id, item_id, start, least(w, size) AS n_words, sum(m) / (least(w, size) - k + 1 + w - k + 1 - sum(m)) AS s FROM cnt GROUP BY doc_id, item_id, w, k, size, start)
SELECT doc_id, item_id, arg_max(start, (s, -start))::BIGINT AS start, arg_max(n_words, (s, -start))::BIGINT AS n_words, round(max(s), 6) AS similarity
FROM sim WHERE s >= {SIMILARITY} - 1e-12 GROUP BY doc_id, item_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    return find_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_hash")
