"""N-gram Jaccard join in the metric space of shingle sets: pivots, regions, triangle-inequality windows.

Documents with the same set form a class, and classes are joined. The Jaccard distance is a metric, but sets of
unrelated texts are all about 1 apart, so regions around freely chosen pivots would hold everything. Pivots are
therefore found by signatures: the universe of shingles is dealt into more parts than two linked sets can differ in
elements, so linked sets agree on a whole part. Per part and content, the class that agrees with most others is the
pivot of a region, and the classes with that part are its members (a class can be in several regions). Two linked
classes have a common signature, so they share its pivot's region: no link is lost. Signatures travel once, packed, to
shards that tell which of them recur; most don't. There are more parts than need be, so linked sets agree on several: a
set with fewer signatures that recur is linked with nothing and goes before any text travels (a passage that many texts
share gives all of them some common signatures, but few). Others can do without as many of their signatures: those that
most classes have are left out.

Small regions are joined at once. In a large one, each member's distance to the pivot is computed: the number of elements
that the two sets don't share. Members are dealt into shells by that distance, those that are linked with the pivot apart
from the others. By the triangle inequality, two sets differ in the difference of their distances at least, so a shell is
only joined with those within the window that linked sets of their sizes leave, and linked members of the pivot aren't
joined with each other, as they are connected. That ends each region in one pass, however alike its members are.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.llm.common import WordHashes, arrow_batches, mixed, packed, shingles, slices, small, stored, unpacked, word_hashes

#: Members that a single task joins by itself, of a region or of two of its shells. A set counts as a member for every so many shingles begun.
REGION_MEMBERS, MEMBER_SHINGLES = 1000, 1000
#: Classes with a signature from which on it is left out where that is allowed.
LARGE = 50
ROWS = 500
#: Texts whose signatures are packed together, and shingles of all texts per shard.
BLOCK_ROWS, SHARD_SHINGLES = 2000, 2_500_000
#: Characters of texts whose sets are made at a time (one text at least), and of a block.
CHARS, BLOCK_CHARS = 1_000_000, 6_000_000
#: Bytes of texts that reach a Python task at a time.
BATCH = "6m"
#: Bits of a signature that travel to its shard. What agrees by chance, a few pairs per shard, is compared for nothing.
KEY_BITS = 40
#: Marks signatures that recur in their own block.
MARK = 1 << 15
#: Signatures that a set can do without, as a share of those it needs; the seed of families that can do without none.
SLACK, LAST_SEED = 0.4, 255
_LAST = (1 << 63) - 1


def shingle_sets(texts, k: int, memo: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of the runs of k words of each text, A-Z in lower case, one after the other; of fewer
    words, one of all. Second, where each text's set starts, and the end of the last.
    """
    words = [word_hashes(t, memo, lower=True) for t in texts]
    sizes = np.asarray([len(w) for w in words], np.int64)
    every = np.concatenate([np.empty(0, np.int64), *words])
    doc = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(every))  # words up to the end of the text
    whole = np.flatnonzero(left >= k)
    hashed = shingles(every, k)[whole] if len(whole) else np.empty(0, np.uint64)
    few = np.flatnonzero((sizes > 0) & (sizes < k))
    values = np.concatenate([hashed, *(shingles(words[i], k) for i in few)])
    doc = np.concatenate([doc[whole], few])
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    return values[new], np.searchsorted(doc[new], np.arange(len(words) + 1))


def linked(shared: int | np.ndarray, total: int | np.ndarray, percent: int):
    """Whether sets with so many shared elements, of so many in both lists, are similar enough."""
    return 100 * shared >= percent * (total - shared)


@lru_cache
def bands(percent: int, limit: int = 1 << 40) -> np.ndarray:
    """Smallest set size of each band: sets that can be linked are in the same band or in neighbouring ones."""
    out = [1]
    while out[-1] < limit:
        out.append(out[-1] * 100 // percent + 1)
    return np.asarray(out)


@lru_cache
def parts_of(band: int, percent: int) -> tuple[int, int, int]:
    """For pairs whose smaller set is in the band: the number of parts, how many of them a set may leave empty, and slack.

    Linked sets that leave no more than that empty agree on slack + 1 parts with something in them at least.
    """
    low, high = bands(percent)[band : band + 2]
    differ = int(high - 1) * (100 - percent) // percent
    if not differ:
        return 0, 0, 0
    slack = int(np.ceil(SLACK * (differ + 1)))
    spare = int(np.ceil(1.5 * (differ + 1 + slack) * np.exp(-low / (differ + 1 + slack))))
    return differ + 1 + slack + spare, spare, slack


def signatures(values: np.ndarray, starts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of sets as shingle_sets() gives them, the family of each, and the number of its set.

    Linked sets that aren't equal have slack + 1 signatures of some family in common. A family's number is its band times
    256 plus a seed; LAST_SEED stands for families without slack.
    """
    sizes = np.diff(starts)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    own = np.searchsorted(bands(percent), sizes, side="right") - 1
    out = [(np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.int64))]
    for below in (0, 1):
        band = own - below
        rules = {b: parts_of(int(b), percent) for b in np.unique(band[band >= 0])}
        parts, spare = (np.asarray([rules[b][i] if b in rules else 0 for b in band], np.int64) for i in (0, 1))
        left = parts > 0
        for seed in range(64):
            if not left.any():
                break
            # A pair can only miss if the same parts, more than spare of them, are empty in both; then both go on.
            inside = left[doc]
            of, tag = doc[inside], (np.maximum(band, 0) << 8 | seed).astype(np.uint64)
            scrambled = mixed(values[inside] ^ mixed(tag)[of])
            part = (scrambled >> np.uint64(32)) % parts[of].astype(np.uint64)
            place = of << 40 | part.astype(np.int64)
            order = np.argsort(place, kind="stable")
            place = place[order]
            firsts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            sums = np.add.reduceat(mixed(scrambled[order]), firsts)
            of, part = of[order][firsts], part[order][firsts]
            out.append((mixed(sums + mixed(part + (tag[of] << np.uint64(32)))), tag[of].astype(np.uint32), of))
            left &= parts - np.bincount(of, minlength=len(sizes)) > spare
        lost = np.flatnonzero(left)
        out.append((mixed(band[lost].astype(np.uint64)), (band[lost] << 8 | LAST_SEED).astype(np.uint32), lost))
    return tuple(map(np.concatenate, zip(*out)))


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _profiles(texts: DataFrame, k: int) -> DataFrame:
    """(id, hash, n_shingles, digest, label) of each row (id, hash, text); label is a part of the digest."""

    def work(frames):
        memo = WordHashes()
        for frame in slices(frames, ROWS):
            values, starts = shingle_sets(frame["text"], k, memo)
            digests = [_digest(values[a:b]) for a, b in zip(starts[:-1], starts[1:])]
            labels = [int.from_bytes(d[:8], "little", signed=True) for d in digests]
            yield frame[["id", "hash"]].assign(n_shingles=np.diff(starts), digest=digests, label=labels)

    return texts.mapInPandas(work, "id long, hash long, n_shingles long, digest binary, label long")


def pieces(lengths: np.ndarray, rows: int, chars: int):
    """(start, stop) of runs of texts of these lengths: up to so many rows and characters, one text at least."""
    ends, start = np.cumsum(lengths), 0
    while start < len(lengths):
        before = ends[start - 1] if start else 0
        stop = int(np.searchsorted(ends, before + chars, side="right"))
        stop = min(max(stop, start + 1), start + rows)
        yield start, stop
        start = stop


def _own_signatures(texts: pd.Series, k: int, percent: int, memo: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labels of the classes of a block of texts (empty sets have none); signatures, their families and the numbers of their labels.

    Sets are made of a few texts at a time, and what stays of them is signatures.
    """
    known: dict[int, int] = {}
    out = [(np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.uint16))]
    for start, stop in pieces(texts.str.len().to_numpy(np.int64), ROWS, CHARS):
        values, starts = shingle_sets(texts.iloc[start:stop], k, memo)
        sizes, new, numbers = np.diff(starts), np.zeros(stop - start, bool), []
        for i in np.flatnonzero(sizes):
            label = int.from_bytes(_digest(values[starts[i] : starts[i + 1]])[:8], "little", signed=True)
            if label not in known:
                known[label] = len(known)
                new[i] = True
                numbers.append(known[label])
        keys, family, of = signatures(values[np.repeat(new, sizes)], np.concatenate([[0], np.cumsum(sizes[new])]), percent)
        out.append((keys, family, np.asarray(numbers, np.uint16)[of]))
    return np.fromiter(known, np.int64, len(known)), *map(np.concatenate, zip(*out))


def _recurring_signatures(texts: DataFrame, k: int, percent: int, shards: int) -> DataFrame:
    """(key, label, family): signatures that several classes have."""

    def ship(frames):
        memo, block = WordHashes(), TaskContext.get().partitionId()
        blocks = (frame["text"].iloc[a:b] for frame in frames for a, b in pieces(frame["text"].str.len().to_numpy(np.int64), BLOCK_ROWS, BLOCK_CHARS))
        for block_texts in blocks:
            labels, keys, family, place = _own_signatures(block_texts, k, percent, memo)
            # The shard and some bits are all that is kept of a signature; sorted, each shard's lie together.
            keys = (mixed(keys) % np.uint64(shards) << np.uint64(KEY_BITS) | keys & np.uint64((1 << KEY_BITS) - 1)).view(np.int64)
            order = np.argsort(keys, kind="stable")
            keys, place, family = keys[order], place[order], family[order]
            # Of a key that recurs here one is shipped, marked; the others need no comparison.
            again = np.concatenate([[False], keys[1:] == keys[:-1]])[: len(keys)]
            known = np.concatenate([again[1:], [False]])[: len(keys)]
            rows = [(block % shards, 1, packed(keys[again], family[again]), labels[place[again]].tobytes())] if again.any() else []
            block += 7919
            keys, place, family = keys[~again], place[~again] | np.where(known[~again], MARK, 0).astype(np.uint16), family[~again]
            bounds = np.searchsorted(keys, np.arange(shards + 1) << KEY_BITS)
            for s, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                if a < b:
                    at = place[a:b]
                    own, at_own = np.unique(at & (MARK - 1), return_inverse=True)
                    rows.append((s, 0, packed(keys[a:b], (at_own | at & MARK).astype(np.uint16), family[a:b]), labels[own].tobytes()))
            yield pd.DataFrame(rows, columns=["shard", "ready", "keys", "labels"])

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        parts, out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, bool))], []
        for ready, data, own in zip(rows["ready"], rows["keys"], rows["labels"]):
            own = np.frombuffer(own, np.int64)
            if ready:
                found, family = unpacked(data, ["i8", "u4"])
                out.append(pd.DataFrame({"key": found, "label": own, "family": family.astype(np.int32)}))
                continue
            found, at, family = unpacked(data, ["i8", "u2", "u4"])
            parts.append((found, own[at & (MARK - 1)], family, at >= MARK))
        keys, labels, family, known = map(np.concatenate, zip(*parts))
        order = np.lexsort((labels, keys))
        keys, labels, family, known = keys[order], labels[order], family[order], known[order]
        # A class comes from several blocks if its text is repeated: equal rows once, marked if any is.
        new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (labels[1:] != labels[:-1])])[: len(keys)])
        if len(new):
            keys, labels, family, known = keys[new], labels[new], family[new], np.logical_or.reduceat(known, new)
            same = np.concatenate([[False], keys[1:] == keys[:-1], [False]])
            often = same[1:] | same[:-1] | known
            out.append(pd.DataFrame({"key": keys[often], "label": labels[often], "family": family[often].astype(np.int32)}))
        return pd.concat(out) if out else pd.DataFrame({"key": keys, "label": labels, "family": family.astype(np.int32)})

    shipped = texts.select("text").mapInPandas(ship, "shard int, ready int, keys binary, labels binary")
    return shipped.groupBy("shard").applyInPandas(compare, "key long, label long, family int")


def _weight(size: str = "size") -> Column:
    """Members that a set of so many shingles counts as."""
    return F.greatest(F.lit(1), F.ceil(F.col(size) / MEMBER_SHINGLES)).cast("long")


def _slack(percent: int) -> Column:
    """The slack of a row's family."""
    slacks = F.array(*(F.lit(parts_of(i, percent)[2]) for i in range(len(bands(percent)) - 1)))
    return F.when(F.col("family").bitwiseAND(F.lit(255)) == LAST_SEED, 0).otherwise(F.get(slacks, F.shiftright("family", 8)))


def _enough(recurring: DataFrame, percent: int) -> DataFrame:
    """Distinct rows of recurring (key, id, family) of classes that have more of a family than its slack: linked classes share that many."""
    rows = recurring.repartition("id", "family").distinct()
    own = F.count("*").over(W.partitionBy("id", "family"))
    return rows.withColumn("own", own).where(F.col("own") > _slack(percent)).drop("own")


def _needed(recurring: DataFrame, percent: int) -> DataFrame:
    """(key, id) of recurring (key, id, family) without signatures that a class can do without: of each family as many as its slack, those that most classes have.

    Two linked classes share slack + 1 signatures of a family. The rarest of them is left out in neither, as the others
    are more frequent in both. Only signatures of large regions are left out.
    """
    often = small(stored(recurring.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > LARGE), "join-frequent"))
    rank = F.row_number().over(W.partitionBy("id", "family").orderBy(F.desc("n"), F.desc("key")))
    spared = recurring.join(often, "key").withColumn("rank", rank).where(F.col("rank") <= _slack(percent)).select("key", "id")
    return recurring.join(spared, ["key", "id"], "left_anti").select("key", "id")


def _distances(regions: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """(pivot, id, shared, n, n_pivot) of regions (pivot, id) and members (id, size, text): what large regions' members share with the pivot.

    A region that counts as up to REGION_MEMBERS members is joined at once: its rows (shared is NULL) are links that join
    up what is linked in it. Larger ones are dealt into parts of about that size; the pivot's text goes to each part,
    ahead of the members'.
    """
    sizes = regions.join(members.select("id", _weight().alias("weight")), "id").groupBy("pivot").agg(F.sum("weight").alias("weight")).where(F.col("weight") > REGION_MEMBERS)
    sizes = small(stored(sizes.select("pivot", F.ceil(F.col("weight") / REGION_MEMBERS).cast("int").alias("parts")), "join-sizes"))
    dealt = lambda rows: rows.join(sizes, "pivot", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = dealt(regions).select("pivot", "id", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "parts")
    own = dealt(regions.select("pivot").distinct())
    rows = rows.unionByName(own.select("pivot", F.col("pivot").alias("id"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts"))
    rows = rows.join(members.select("id", "text"), "id").withColumn("member", F.col("id") != F.col("pivot"))

    def work(frames):
        memo, region, ids, sets = WordHashes(), None, [], []

        def joined() -> list[tuple]:
            return [(a, b, None, None, None) for a, b in _linked_up(ids, sets, percent)]

        for frame in slices(frames, ROWS):
            values, starts = shingle_sets(frame["text"], k, memo)
            out = []
            for i, (pivot, doc, part, parts, member) in enumerate(zip(frame["pivot"], frame["id"], frame["part"], frame["parts"], frame["member"])):
                own = values[starts[i] : starts[i + 1]]
                if (pivot, part) != region:
                    out += joined()
                    region, ids, sets = (pivot, part), [], []
                if parts == 1:
                    ids.append(doc)
                    sets.append(own)
                elif member:
                    out.append((pivot, doc, len(np.intersect1d(own, pivot_set, assume_unique=True)), len(own), len(pivot_set)))
                else:
                    pivot_set = own
            yield pd.DataFrame(out, columns=["pivot", "id", "shared", "n", "n_pivot"])
        yield pd.DataFrame(joined(), columns=["pivot", "id", "shared", "n", "n_pivot"])

    schema = "pivot long, id long, shared long, n long, n_pivot long"
    order = ["pivot", "part", "member"]
    return rows.repartition("pivot", "part").sortWithinPartitions(*order).select(*order, "parts", "id", "text").mapInPandas(work, schema)


def _linked_up(ids: list[int], sets: list[np.ndarray], percent: int, others: int = 0) -> list[tuple[int, int]]:
    """Links that join up what is linked among sets. With others, the last so many are a side of their own: only pairs across the sides count."""
    if len(ids) < 2:
        return []
    n = len(ids) - others
    first = sets[:n]
    shared = shared_counts(first, sets[n:] if others else first)
    size = np.asarray([len(x) for x in sets])
    wanted = linked(shared, size[:n, None] + (size[n:] if others else size)[None, :], percent)
    root, rows = {}, []

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = x = root.get(y, y)
        return x

    for i, j in zip(*np.nonzero(wanted)):
        a, b = find(ids[i]), find(ids[n + j] if others else ids[j])
        if a != b:
            root[max(a, b)] = min(a, b)
            rows.append((ids[i], ids[n + j] if others else ids[j]))
    return rows


def shared_counts(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets, by products of 0/1 matrices a slice of columns at a time."""
    same = others is sets
    every = sets if same else [*sets, *others]
    values, column, n = np.unique(np.concatenate([np.empty(0, np.uint64), *every]), return_inverse=True, return_counts=True)
    # What only one set has is shared by none but itself.
    often = n > 1
    place = np.cumsum(often) - 1
    row = np.repeat(np.arange(len(every)), [len(x) for x in every])
    use = often[column]
    column, row = place[column[use]], row[use]
    out = np.zeros((len(sets), len(others)), np.int64)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    width = 4096
    for start in range(0, int(often.sum()), width):
        a, b = np.searchsorted(column, [start, start + width])
        ones = np.zeros((len(every), min(width, int(often.sum()) - start)), np.float32)
        ones[row[a:b], column[a:b] - start] = 1
        out += (ones[: len(sets)] @ (ones if same else ones[len(sets) :]).T).astype(np.int64)
    return out


def _closed(groups: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links that join up what is linked across the two sides of each group (key, side, id, text), or within one of a single side.

    Both sides together count as about REGION_MEMBERS members.
    """

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["side", "id"])
        values, starts = shingle_sets(frame["text"], k, WordHashes())
        sets = [values[a:b] for a, b in zip(starts[:-1], starts[1:])]
        return pd.DataFrame(_linked_up(frame["id"].tolist(), sets, percent, int(frame["side"].sum())), columns=["a", "b"])

    return groups.groupBy("key").applyInPandas(work, "a long, b long")


def _regions_of(recurring: DataFrame, central: DataFrame) -> DataFrame:
    """(pivot, id): the most central member of each key is the pivot of the others. central: (id, rank); small ranks are central."""
    ranked = recurring.select("key", "id").join(central, "id")
    pivots = ranked.groupBy("key").agg(F.min(F.struct("rank", "id")).alias("p")).select("key", F.col("p.id").alias("pivot"))
    return ranked.join(pivots, "key").where("id <> pivot").select("pivot", "id").distinct()


def _shells(rows: DataFrame, percent: int) -> DataFrame:
    """(key, side, id): pairs of shells of which some members may be linked, and single ones; key is (pivot, x, y), equal x and y for a single one.

    rows: (pivot, id, n, d, open), the size of a set, its distance to the pivot and whether it isn't linked with it. Sets
    of x and y elements that are linked differ in share * (x + y) at most.
    """
    share, half = (100 - percent) / (100 + percent), max(1, REGION_MEMBERS // 2)
    # Of a distance that many have, members are spread over as many shells as these fill.
    per_distance = rows.groupBy("pivot", "open", "d").agg(F.sum(_weight("n")).alias("weight"))
    before = F.sum("weight").over(W.partitionBy("pivot", "open").orderBy("d")) - F.col("weight")
    place = F.col("before") + F.pmod(F.xxhash64("id"), F.col("weight"))
    rows = rows.join(per_distance.withColumn("before", before), ["pivot", "open", "d"])
    rows = stored(rows.select("pivot", "id", "n", "d", "open", (F.floor(place / half) * 2 + F.col("open").cast("long")).alias("shell")), "join-shells")
    shells = rows.groupBy("pivot", "shell", "open").agg(F.min("d").alias("near"), F.max("d").alias("far"), F.min("n").alias("least"), F.max("n").alias("most"))
    x, y = (shells.select("pivot", *(F.col(c).alias(f"{c}_{side}") for c in shells.columns[1:])) for side in "xy")
    gap = F.greatest(F.col("near_y") - F.col("far_x"), F.col("near_x") - F.col("far_y"))
    sized = (100 * F.col("most_x") >= percent * F.col("least_y")) & (100 * F.col("most_y") >= percent * F.col("least_x"))
    pairs = x.join(y, "pivot").where((F.col("shell_x") <= F.col("shell_y")) & (F.col("open_x") | F.col("open_y")) & sized & (gap <= share * (F.col("most_x") + F.col("most_y")) + 1e-6))
    sides = F.when(F.col("shell_x") == F.col("shell_y"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    pairs = pairs.select(F.struct("pivot", F.col("shell_x").alias("x"), F.col("shell_y").alias("y")).alias("key"), F.explode(sides).alias("side"))
    pairs = pairs.select("key", "side", F.col("key.pivot").alias("pivot"), F.when(F.col("side") == 0, F.col("key.x")).otherwise(F.col("key.y")).alias("shell"))
    return pairs.join(rows.select("pivot", "shell", "id"), ["pivot", "shell"]).select("key", "side", "id")


def _links(recurring: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): enough links to join up everything that is linked, from recurring keys (key, id) and members (id, size, text)."""
    # A class that agrees with many others is near the middle of its group.
    sizes = recurring.groupBy("key").agg(F.count("*").alias("n"))
    central = stored(recurring.join(sizes, "key").groupBy("id").agg((-F.sum("n")).alias("rank")), "join-central")
    regions = stored(_regions_of(recurring, central), "join-regions")
    distances = stored(_distances(regions, members, k, percent), "join-distances")
    links = distances.where("shared IS NULL").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    large = distances.where("shared IS NOT NULL")
    if not large.head(1):
        return links
    total = F.col("n") + F.col("n_pivot")
    large = large.select("pivot", "id", "n", (total - 2 * F.col("shared")).alias("d"), (~linked(F.col("shared"), total, percent)).alias("open"))
    near = large.where(~F.col("open")).select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    closed = stored(_closed(_shells(large, percent).join(members.select("id", "text"), "id"), k, percent), "join-closed")
    return links.unionByName(near).unionByName(closed)


def components(links: DataFrame) -> DataFrame:
    """(id, component) of each id in links (a, b): the smallest id that it is connected with."""
    edges = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "component-edges")
    labels = stored(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("c")).withColumnRenamed("a", "id"), "component-labels")
    while True:
        offers = edges.join(labels, edges["a"] == labels["id"]).groupBy("b").agg(F.min("c").alias("offer"))
        near = labels.join(offers, labels["id"] == offers["b"]).select("id", F.col("c").alias("was"), F.least("c", "offer").alias("c"))
        near = stored(near, "component-labels")
        far = near.select(F.col("id").alias("c"), F.col("c").alias("far"))
        new = stored(near.join(far, "c").select("id", "was", F.least("c", "far").alias("c")), "component-labels")
        if not new.where("c <> was").head(1):
            return new.select("id", F.col("c").alias("component"))
        labels = new.select("id", "c")


def link_documents(docs: DataFrame, k: int = 3, percent: int = 90, more: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs.

    A document's set holds the distinct runs of k words (runs of anything but ASCII white space, A-Z in lower case) of
    its whole text; with fewer words the whole sequence as one. Two documents are linked if 100 * intersection >=
    percent * union; component_id is the smallest doc_id that can be reached by links, the document's own included.

    A null or blank text has an empty set and is linked with nothing. Repeated rows get equal results; rows with one
    doc_id and different texts are judged each by its own text. A null doc_id counts as larger than all others and stays
    null. An empty table gives an empty table; other columns are not read, whatever their names.

    With more=True also text_hash (xxhash64 of the text, null texts counting as empty) and group, a number of its own for
    all that are connected; null for empty sets.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    out = link_sets(texts, k, percent)
    known = lambda c: F.when(c < _LAST, c)
    columns = [known(F.col("id")).alias("doc_id"), "n_shingles", known(F.col("component")).alias("component_id")]
    return out.select(*columns, *([F.col("hash").alias("text_hash"), "group"] if more else []))


def link_sets(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, hash, n_shingles, component, group) of each row (id, text).

    hash is that of the text, component the smallest id that is reached, group a number of its own for all that are
    connected; null for empty sets.
    """
    with arrow_batches(texts.sparkSession, BATCH):
        return _link_sets(texts.select("id", "text", F.xxhash64("text").alias("hash")), k, percent)


def _link_sets(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """As link_sets(), of (id, text, hash)."""
    profiles = stored(_profiles(texts, k), "join-profiles")
    classes = profiles.where("n_shingles > 0").groupBy("digest", "label").agg(F.min("id").alias("first"), F.min_by("hash", "id").alias("hash"), F.count("*").alias("n"), F.max("n_shingles").alias("size"))
    classes = stored(classes, "join-classes")
    total = profiles.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_SHINGLES))
    recurring = _recurring_signatures(texts, k, percent, shards).withColumnRenamed("label", "id")
    recurring = stored(_enough(recurring, percent), "join-signatures")
    recurring = stored(_needed(recurring, percent), "join-needed")
    # One text of each class that shares a signature with another.
    chosen = classes.join(recurring.select(F.col("id").alias("label")).distinct(), "label", "left_semi")
    chosen = chosen.groupBy("label").agg(F.min("first").alias("_id"), F.min_by("hash", "first").alias("_hash"), F.max("size").alias("size"))
    chosen = small(stored(chosen, "join-members"))
    members = texts.join(chosen, (F.col("id") == F.col("_id")) & (F.col("hash") == F.col("_hash"))).select(F.col("label").alias("id"), "size", "text")
    members = stored(members.dropDuplicates(["id"]), "join-texts")
    reached = stored(components(_links(recurring, members, k, percent)), "join-reached")
    # Labels aren't ids: a component goes by the smallest id of its classes.
    firsts = classes.join(reached, classes["label"] == reached["id"]).select("component", "label", "digest", "first")
    lowest = firsts.groupBy("component").agg(F.min("first").alias("low"))
    joined = firsts.join(lowest, "component").select("digest", "low", F.col("component").alias("group"))
    # Rows that are alone need no entry.
    several = classes.where("n > 1").join(joined, "digest", "left_anti").select("digest", F.col("first").alias("low"), F.col("label").alias("group"))
    groups = small(stored(joined.unionByName(several), "join-groups"))
    out = profiles.join(groups, "digest", "left")
    group = F.when(F.col("n_shingles") > 0, F.coalesce("group", "label"))
    return out.select("id", "hash", "n_shingles", F.coalesce("low", "id").alias("component"), group.alias("group"))


def query(spark, sf_dir: str) -> DataFrame:
    return link_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
