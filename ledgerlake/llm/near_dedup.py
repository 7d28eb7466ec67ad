"""Near-duplicates by order MinHash, verified by banded alignment.

Every distinct text has word k-mers, each labelled with how often it occurred before.  A sketch
samples the `order` labelled k-mers of the smallest hashes and keeps them in the order of the text,
so equal sketches suggest a small edit distance, not just shared words.  A text has `sketches` of
them, and texts with an equal sketch share a bucket.  Short texts, where an edit breaks a large part of
the k-mers, have as many sketches again of shorter ones (SHORTER).

A bucket's members are compared with its leader, the smallest id.  Where all are then of one class (by any links so
far), it is done.  Else the members outside its largest class are compared with every member of another class where the
bucket has at most WHOLE members, and with LEADERS leaders where it has more.  Of these larger buckets, those that still have two
classes are dealt into tiles by text length and salt; a tile compares the bags of words of all members of different
classes, by counts in BINS bins, and hands on each pair that these counts don't rule out, in the first bucket that its texts share.  The bound never rules out a similar pair, so in buckets of any size no link that would join two classes is missed, and no pair is named that a bound can reject.
A pair counts as similar if its word
edit similarity, 1 - distance / longer length, is at least `similarity`; a bag-of-words bound and the
band's width reject most others early.  Classes are the connected components of the links.

Defined cases: null texts are empty; equal texts (by SHA-256) share a class without any comparison; texts shorter
than k words are one k-mer; rows whose ids are null or repeat are told apart by their texts (by a 64-bit hash
of both), and a row without an id has one in its class unless the whole class has none; rows that repeat id
and text are one document; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, stored

WORDS, ORDER, SKETCHES, SIMILARITY = 3, 2, 32, 0.8
# k of further sketches, and the most words of a text that has them
SHORTER = ((2, 80), (1, 20))
LEADERS = 4
WHOLE = 32
BINS = 2048
COARSE, MIDDLE = 64, 256  # bins that first bounds look at
TILE = 1024  # members of a side of a tile, about
TILE_CELLS = 1 << 22
CELL_BYTES = 16_000_000
BATCH_CELLS = 4_000_000
SKETCH_CELLS = 1 << 19
CACHED_WORDS = 150_000


# ---- sketches ------------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word -> 64-bit hash, emptied when large."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def labelled_kmers(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-mers in text order, each mixed with the number of its earlier occurrences."""
    if len(words) == 0:
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    with np.errstate(over="ignore"):
        h = np.zeros(n, dtype=np.uint64)
        for i in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
        h = _mix(h)
        order = np.argsort(h, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        if len(start) < n:
            seen = np.empty(n, dtype=np.uint64)
            seen[order] = (np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))).astype(np.uint64)
            # a first occurrence keeps its hash, whatever else the text repeats
            late = seen > 0
            h[late] = _mix(h[late] + seen[late] * np.uint64(0xD6E8FEB86659FD93))
    return h


def order_minhash(kmers: np.ndarray, order: int, seeds: np.ndarray) -> np.ndarray:
    """One hash a seed: of its `order` smallest k-mers in the order of the text."""
    if len(kmers) == 0:
        return _mix(seeds.copy())
    order, out = min(order, len(kmers)), []
    block = max(1, SKETCH_CELLS // len(kmers))
    with np.errstate(over="ignore"):
        for at in range(0, len(seeds), block):
            some = seeds[at : at + block, None]
            x = (kmers ^ (some >> np.uint64(7))) * (some | np.uint64(1))
            x ^= x >> np.uint64(32)
            least = []
            for _ in range(order):
                least.append(x.argmin(axis=1))
                x[np.arange(len(x)), least[-1]] = np.uint64(2**64 - 1)
            h = some[:, 0]
            for place in np.sort(np.stack(least), axis=0):
                h = h * np.uint64(0x9E3779B97F4A7C15) + kmers[place]
            out.append(h)
    return _mix(np.concatenate(out))


def text_sketches(words: np.ndarray, k: int, order: int, seeds: np.ndarray) -> np.ndarray:
    """The sketches of one text by hashes of its words: of k-mers, and of each shorter kind that texts of its length have."""
    kinds = [k, *(n for n, most in SHORTER if n < k and len(words) <= most)]
    return np.concatenate([order_minhash(labelled_kmers(words, n), order, seeds) for n in kinds])


def bag(words: np.ndarray) -> bytes:
    """How many words fall into each bin, as BINS bytes; counts beyond 255 stay there, which only weakens the bound."""
    counts = np.bincount((words % np.uint64(BINS)).astype(np.int64), minlength=BINS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def sketch_texts(texts: DataFrame, k: int, order: int, sketches: int) -> DataFrame:
    """id, digest, s array<long>."""
    seeds = _mix(np.arange(1, sketches + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    kind = dict(texts.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for t in batch.column("text").to_pylist():
                words = t.split()
                hashed = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
                rows.append(text_sketches(hashed, k, order, seeds))
            flat = np.concatenate(rows).view(np.int64) if rows else np.empty(0, dtype=np.int64)
            bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), lists], ["id", "digest", "s"])

    return texts.mapInArrow(run, f"id {kind}, digest string, s array<long>")


def bags_of(texts: DataFrame) -> DataFrame:
    """The rows with n_words and bag instead of text."""
    others = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                words = [np.fromiter(map(hashes.__getitem__, w), dtype=np.uint64, count=len(w)) for w in map(str.split, some.column("text").to_pylist())]
                columns = [*map(some.column, others), pa.array(map(len, words), type=pa.int32()), pa.array(map(bag, words), type=pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [*others, "n_words", "bag"])

    kinds = dict(texts.dtypes)
    return texts.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in others), "n_words int, bag binary"]))


# ---- verification --------------------------------------------------------------------------------------


def _trim(a: list[str], b: list[str]) -> tuple[list[str], list[str]]:
    """Without the words that both begin and end with; that leaves the distance as it is."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    a, b = a[n:], b[n:]
    m = 0
    for x, y in zip(reversed(a), reversed(b)):
        if x != y:
            break
        m += 1
    return (a[: len(a) - m], b[: len(b) - m]) if m else (a, b)


def _numbered(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    names: dict[str, int] = {}
    return tuple(np.fromiter((names.setdefault(w, len(names)) for w in x), dtype=np.int32, count=len(x)) for x in (a, b))


def within(pairs: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Whether each pair's edit distance is at most its limit; banded alignment of many pairs at once.

    A pair leaves when its last row is done, or when its whole band is beyond its limit.
    """
    limits = np.asarray([p[2] for p in pairs], dtype=np.int32)
    la, lb = np.asarray([len(p[0]) for p in pairs]), np.asarray([len(p[1]) for p in pairs])
    width, rows, n = int(limits.max()), int(la.max()), len(pairs)
    a = np.full((n, rows), -1, dtype=np.int32)
    b = np.full((n, max(rows, int(lb.max())) + 2 * width + 2), -2, dtype=np.int32)
    for i, (x, y, _) in enumerate(pairs):
        a[i, : len(x)] = x
        b[i, width : width + len(y)] = y
    # band[d] is the distance at column row + d - width
    far, d = np.int32(1 << 29), np.arange(2 * width + 1, dtype=np.int32)
    band = np.broadcast_to(np.where(d >= width, d - width, far).astype(np.int32), (n, 2 * width + 1)).copy()
    new, alive = np.empty_like(band), np.arange(n)
    result = np.where(la == 0, lb, far)
    ends = set(la.tolist())
    for i in range(1, rows + 1):
        np.add(band, b[:, i - 1 : i + 2 * width] != a[:, i - 1 : i], out=new)
        band += 1
        np.minimum(new[:, :-1], band[:, 1:], out=new[:, :-1])
        if i <= width:
            new[:, : width - i] = far
            new[:, width - i] = i
        new -= d
        np.minimum.accumulate(new, axis=1, out=new)
        new += d
        if i <= width:
            new[:, : width - i] = far
        band, new = new, band
        if i in ends:
            done = np.flatnonzero(la[alive] == i)
            at = lb[alive[done]] - i + width
            inside = (at >= 0) & (at <= 2 * width)
            result[alive[done[inside]]] = band[done[inside], at[inside]]
        if i % 8 == 0:
            stays = (la[alive] > i) & (band.min(axis=1) <= limits[alive])
            if stays.sum() < 0.75 * len(alive):
                if not stays.any():
                    break
                alive, band, a, b = alive[stays], band[stays], a[stays], b[stays]
                new = np.empty_like(band)
    return result <= limits


# Most pairs are settled by a part of the band.
PARTS = (0.1, 0.35, 1.0)


def similar(texts: list[tuple[str, str]], similarity: float) -> np.ndarray:
    """Whether each two texts have at least that word edit similarity; texts that come again are split once."""
    answer, open_ = np.zeros(len(texts), dtype=bool), []
    known: dict[str, tuple[list[str], Counter]] = {}

    def split(text: str) -> tuple[list[str], Counter]:
        if text not in known:
            known[text] = (words := text.split(), Counter(words))
        return known[text]

    for i, (s, t) in enumerate(texts):
        (a, some), (b, others) = split(s), split(t)
        longer = max(len(a), len(b))
        limit = int((1 - similarity) * longer + 1e-9)
        if abs(len(a) - len(b)) > limit or longer - sum(min(n, others[w]) for w, n in some.items() if w in others) > limit:
            continue
        a, b = _trim(a, b)
        if max(len(a), len(b)) <= limit:
            answer[i] = True
        elif a and b:
            open_.append((i, *_numbered(a, b), limit))
    for part in PARTS:
        open_.sort(key=lambda x: (x[3], len(x[1])))
        at, left = 0, []
        while at < len(open_):
            limit = max(1, int(open_[at][3] * part))
            n = max(1, BATCH_CELLS // ((2 * limit + 1) * 8))
            some = open_[at : at + n]
            while len(some) > 1 and some[-1][3] > 2 * some[0][3] + 8:
                some = some[: max(1, len(some) // 2)]
            close = within([(a, b, max(1, int(limit * part))) for _, a, b, limit in some])
            for x, ok in zip(some, close, strict=True):
                answer[x[0]] |= ok
            left += [x for x, ok in zip(some, close, strict=True) if not ok]
            at += len(some)
        open_ = left
    return answer


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (id, leader) that are similar; texts: id, text.

    Pairs are dealt into cells by a hash of either id, and a cell gets each of its texts once, whatever
    the number of its pairs; a leader's pairs lie in as many cells as there are hashes of ids.  There are so many
    hashes that the texts of one hold about CELL_BYTES.
    """
    kind = dict(texts.dtypes)["id"]
    needed = pairs.select("id").unionByName(pairs.select(F.col("leader").alias("id"))).distinct()
    size = texts.select("id", F.octet_length("text").alias("size")).join(needed, "id", "left_semi").agg(F.sum("size")).first()[0] or 0
    sides = max(1, -(-size // CELL_BYTES))
    side = lambda c: F.pmod(F.xxhash64(c), F.lit(sides))
    dealt = pairs.select("id", "leader", side("id").alias("a"), side("leader").alias("b"))
    wanted = dealt.select("id", "a", "b").unionByName(dealt.select(F.col("leader").alias("id"), "a", "b")).distinct()
    held = wanted.hint("merge").join(texts, "id").select(F.col("id").alias("of"), "text", F.col("a").alias("x"), F.col("b").alias("y"))

    def run(some: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        text = dict(zip(words["of"], words["text"], strict=True))
        ok = similar([(text[x], text[y]) for x, y in zip(some["id"], some["leader"], strict=True)], similarity)
        return some.loc[ok, ["id", "leader"]]

    return dealt.groupBy("a", "b").cogroup(held.groupBy("x", "y")).applyInPandas(run, f"id {kind}, leader {kind}")


# ---- links and classes ---------------------------------------------------------------------------------


def shared(rows: DataFrame) -> DataFrame:
    """The rows (id, j, key) of buckets with two texts or more."""
    ends = rows.groupBy("j", "key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
    return rows.join(ends.select("j", "key"), ["j", "key"], "left_semi")


def led(rows: DataFrame) -> DataFrame:
    """j, key, leaders (array of id and class c) of the buckets with two classes or more: the smallest id of each of LEADERS shares of a bucket."""
    shares = rows.groupBy("j", "key", F.pmod(F.xxhash64("id"), F.lit(LEADERS)).alias("share")).agg(F.min(F.struct("id", "c")).alias("leader"), F.min("c").alias("low"), F.max("c").alias("high"))
    whole = shares.groupBy("j", "key").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.collect_list("leader").alias("leaders"))
    return whole.filter("low < high").select("j", "key", "leaders")


def _ordered(x: str, y: str) -> list:
    return [F.greatest(x, y).alias("id"), F.least(x, y).alias("leader")]


def apart_pairs(seen: DataFrame, bounds: DataFrame) -> DataFrame:
    """Pairs (id, the smaller one as leader) of members outside their bucket's largest class: in a bucket of at most WHOLE members with every member of another class, else with the leaders."""
    known = seen.join(bounds, ["j", "key"])
    small = known.filter(F.col("n") <= WHOLE).select("id", "c", "j", "key", "main")
    apart = small.filter("c <> main").select(F.col("id").alias("x"), F.col("c").alias("cx"), "j", "key")
    all_of_them = small.join(apart, ["j", "key"]).filter("c <> cx").select(*_ordered("id", "x"))
    led_ones = known.filter((F.col("n") > WHOLE) & (F.col("c") != F.col("main"))).select("id", F.explode("leaders.id").alias("x")).filter("id <> x").select(*_ordered("id", "x"))
    return all_of_them.unionByName(led_ones).distinct()


def left_by_bags(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (row of x, row of y; bags and n words) that their bags don't rule out: words that one has more of than the other have to be edited."""
    longer, shift = np.maximum(nx[:, None], ny[None, :]), np.abs(nx[:, None] - ny[None, :])
    left = 2 * ((1 - similarity) * longer + 1e-9).astype(np.int32) - shift
    fold = lambda bags, bins: bags.reshape(len(bags), -1, bins).sum(axis=1, dtype=np.int16)
    apart = np.zeros(left.shape, dtype=np.int32)
    for a, b in zip(np.ascontiguousarray(fold(x, COARSE).T), np.ascontiguousarray(fold(y, COARSE).T), strict=True):
        apart += np.abs(a[:, None] - b[None, :])
    i, j = np.nonzero(apart <= left)
    for bins in (MIDDLE, BINS):
        some, others, step = fold(x, bins), fold(y, bins), max(1, (1 << 20) // bins)
        kept = [np.abs(some[i[at : at + step]] - others[j[at : at + step]]).sum(axis=1, dtype=np.int32) for at in range(0, len(i), step)]
        fine = np.concatenate(kept) <= left[i, j] if kept else np.zeros(0, dtype=bool)
        i, j = i[fine], j[fine]
    return i, j


def earlier_buckets(buckets: list, own: str) -> np.ndarray:
    """Bits of each member that say in which of the buckets before `own` it lies, of those that have two members here."""
    count = Counter(b for some in buckets for b in some if b < own)
    number = {b: i for i, b in enumerate(b for b, n in count.items() if n > 1)}
    bits = np.zeros((len(buckets), -(-max(1, len(number)) // 8)), dtype=np.uint8)
    for row, some in enumerate(buckets):
        for at in (number[b] for b in some if b in number):
            bits[row, at >> 3] |= 1 << (at & 7)
    return bits


def bagged(large: DataFrame, texts: DataFrame) -> DataFrame:
    """id, c, buckets (names), n_words, bag: one row a text of the members (id, j, key, c), written once; so members themselves are joined with no text or bag."""
    named = large.groupBy("id", "c").agg(F.collect_list(F.concat_ws(":", "j", "key")).alias("buckets"))
    return stored(bags_of(texts.select("id", "text").join(named, "id")), "near-bags")


def cells_of(members: DataFrame) -> DataFrame:
    """bucket, g, cell, sides, own: the cells where the members (bucket, g, c) of a length class belong.

    A cell holds the class of its number and the next longer one; only those with two classes of texts count.  That comes from counts
    of the length classes, so no member is there twice for it.
    """
    counts = members.groupBy("bucket", "g").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("c").alias("high"))
    both = counts.withColumn("cell", F.explode(F.array("g", F.col("g") - 1))).withColumn("own", F.col("cell") == F.col("g"))
    cells = both.groupBy("bucket", "cell").agg(F.ceil(F.sum("n") / TILE).cast("int").alias("sides"), F.min("low").alias("low"), F.max("high").alias("high"), F.bool_or("own").alias("any_own"))
    cells = cells.filter("low < high and any_own").select("bucket", "cell", "sides")
    return cells.select("bucket", F.explode(F.array("cell", F.col("cell") + 1)).alias("g"), "cell", "sides").withColumn("own", F.col("cell") == F.col("g"))


def tile_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (id, the smaller one as leader) of members of different classes that their bags leave; rows: as `bagged` has them.

    Texts of a similar pair differ in length by the factor `similarity` at most, so they lie in one length
    class or in two neighbours.  A cell holds the members of a class and of the next longer one, and
    is cut into tiles of about TILE members a side, which are dealt out one by one.  Which bucket of a pair's buckets is the first is
    the same in all tiles, as each text has the names of its buckets with it.
    """
    kind = dict(rows.dtypes)["id"]
    size_class = F.floor(F.log(F.greatest(F.col("n_words"), F.lit(1)).cast("double")) / F.lit(-np.log(similarity)) + 1e-9).cast("int") if similarity < 1 else F.col("n_words")
    members = rows.withColumn("g", size_class).withColumn("bucket", F.explode("buckets"))
    cells = stored(cells_of(members), "near-cells")
    placed = members.join(cells, ["bucket", "g"]).withColumn("side", F.pmod(F.xxhash64("id"), F.col("sides")).cast("int"))
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    tiles = tiles.select("cell", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"), "side", "own", "id", "c", "n_words", "bag", "bucket", "buckets")

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        ids, classes, n = tile["id"].to_numpy(), tile["c"].to_numpy(), tile["n_words"].to_numpy(dtype=np.int32)
        bags = np.frombuffer(b"".join(tile["bag"]), dtype=np.uint8).reshape(len(tile), BINS)
        own, side, a, b = tile["own"].to_numpy(), tile["side"].to_numpy(), int(tile["a"].iloc[0]), int(tile["b"].iloc[0])
        first, second, found = np.flatnonzero(side == a), np.flatnonzero(side == b), []
        before = earlier_buckets(tile["buckets"].tolist(), tile["bucket"].iloc[0])
        step = max(1, TILE_CELLS // max(1, len(second)))
        for at in range(0, len(first), step):
            rows = first[at : at + step]
            i, j = left_by_bags(bags[rows], n[rows], bags[second], n[second], similarity)
            x, y = rows[i], second[j]
            new = (classes[x] != classes[y]) & (own[x] | own[y])
            x, y = x[new], y[new]
            some = max(1, (1 << 22) // before.shape[1])
            new = np.concatenate([np.zeros(0, dtype=bool), *(~(before[x[k : k + some]] & before[y[k : k + some]]).any(axis=1) for k in range(0, len(x), some))])
            found.append(pd.DataFrame({"id": np.maximum(ids[x], ids[y])[new], "leader": np.minimum(ids[x], ids[y])[new]}))
        return pd.concat(found).drop_duplicates() if found else pd.DataFrame({"id": ids[:0], "leader": ids[:0]})

    # by the tile: Spark would be content with the rows as they lie by bucket or cell, and give one task all tiles of a large one
    return tiles.repartition("bucket", "cell", "a", "b").groupBy("bucket", "cell", "a", "b").applyInPandas(run, f"id {kind}, leader {kind}").distinct()


def links(members: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """id, leader: verified links between different texts, the smaller id second; members: id, s; texts: id, text.

    The links connect the classes; links between texts that others connect already may be left out.
    """
    rows = stored(shared(members.select("id", F.posexplode("s").alias("j", "key"))), "near-shared").withColumn("c", F.col("id"))
    state = stored(rows.join(led(rows), ["j", "key"]), "near-buckets")
    # texts that share no bucket are not needed further
    texts = stored(texts.join(state.select("id").distinct().hint("merge"), "id", "left_semi"), "near-texts")
    found, tried = None, None

    def classed(at: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The buckets' members with their classes by now, and the buckets that still have two."""
        seen = stored(at.drop("c").join(components(found), "id", "left").withColumn("c", F.coalesce("class_id", "id")).drop("class_id"), "near-seen")
        counts = seen.groupBy("j", "key", "c").agg(F.count(F.lit(1)).alias("n"))
        bounds = counts.groupBy("j", "key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes"), F.max(F.struct("n", "c")).alias("top")).filter("classes > 1").select("j", "key", "n", F.col("top.c").alias("main"))
        return seen, stored(bounds, "near-bounds")

    each = state.select("id", "c", F.array_min("leaders").alias("x")).filter("c <> x.c").select("id", F.col("x.id").alias("x"))
    for step in range(3):
        if step == 0:
            pairs = each.select(*_ordered("id", "x")).distinct()
        elif step == 1:
            seen, bounds = classed(state)
            pairs = apart_pairs(seen, bounds)
        else:
            seen, bounds = classed(seen.join(bounds.filter(F.col("n") > WHOLE).select("j", "key"), ["j", "key"], "left_semi"))
            large = seen.select("id", "j", "key", "c").join(bounds.select("j", "key"), ["j", "key"], "left_semi")
            pairs = tile_pairs(bagged(large, texts), similarity)
        pairs = stored(pairs if tried is None else pairs.join(tried, ["id", "leader"], "left_anti"), "near-pairs")
        good = stored(verified(pairs, texts, similarity), "near-links")
        found = good if found is None else found.unionByName(good)
        tried = pairs if tried is None else tried.unionByName(pairs)
    return found


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """id, class_id (smallest id that is connected) of all ids with an edge.

    Every id moves to its smallest neighbour, and on along the way; edges follow, and those inside a
    class go, so each round works on fewer edges.  The smallest id of a class never moves.
    """
    left = stored(edges.select(F.col("id").alias("a"), F.col("leader").alias("b")).filter("a <> b").distinct(), "near-edges")
    labels = left.select(F.col("a").alias("id")).unionByName(left.select(F.col("b").alias("id"))).distinct().withColumn("class_id", F.col("id"))
    for _ in range(rounds):
        if not left.limit(1).count():
            return labels
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("to")), "near-moves")
        for _ in range(2):
            further = moves.select(F.col("a").alias("to"), F.col("to").alias("far"))
            moves = moves.join(further, "to").select("a", F.col("far").alias("to"))
        moves = stored(moves, "near-moves")
        moved = left.join(moves.withColumnRenamed("to", "x"), "a").join(moves.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        left = stored(moved.select(F.col("x").alias("a"), F.col("y").alias("b")).filter("a <> b").distinct(), "near-edges")
        labels = stored(labels.join(moves.select(F.col("a").alias("class_id"), "to"), "class_id", "left").select("id", F.coalesce("to", "class_id").alias("class_id")), "near-labels")
    raise ValueError("components did not settle")


def _of_unique_ids(named: DataFrame, k: int, order: int, sketches: int, similarity: float) -> DataFrame:
    """id, class_id, n_links, class_size of rows (id, text) whose ids are neither null nor repeated."""
    signed = stored(sketch_texts(named.withColumn("digest", F.sha2("text", 256)), k, order, sketches), "near-sketches")
    # equal texts: the smallest id stands for all
    texts = stored(signed.groupBy("digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "near-digests")
    members = stored(signed.select("id", "s").join(texts.select("id"), "id", "left_semi"), "near-members")
    edges = stored(links(members, named, similarity), "near-edges")
    classes = components(edges)
    degree = edges.select("id").unionByName(edges.select(F.col("leader").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    known = texts.join(classes, "id", "left").join(degree, "id", "left").select("digest", "n", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    known = stored(known, "near-classes")
    size = known.groupBy("class_id").agg(F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("texts"))
    total, distinct = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    sized = spread_join(known, size, ["class_id"], "texts", distinct, F.col("digest")).drop("texts")
    members = spread_join(signed.select("id", "digest"), sized, ["digest"], "n", total, F.col("id"))
    return members.select("id", "class_id", "n_links", "class_size")


def _numbered_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, text, number: a hash of both, for tables whose ids are null or repeat."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("id"), whole.alias("text"), F.xxhash64(F.col(key), whole).alias("number"))


def _unique(docs: DataFrame, key: str) -> bool:
    rows, there = docs.agg(F.count(F.lit(1)), F.count(key)).first()
    return rows == there == docs.select(key).distinct().count()


def _classes_of_numbers(docs: DataFrame, key: str, text: str, options: tuple) -> DataFrame:
    """id, number, class_number, n_links of every row, where ids are null or repeat."""
    rows = _numbered_rows(docs, key, text)
    one = rows.select(F.col("number").alias("id"), "text").dropDuplicates(["id"])
    found = _of_unique_ids(one, *options).select(F.col("id").alias("number"), F.col("class_id").alias("class_number"), "n_links")
    return stored(rows.select("id", "number").join(found, "number"), "near-rows")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS, order: int = ORDER, sketches: int = SKETCHES, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: key, class_id (smallest id of its class), n_links (texts that its text was found like; not all where its class is known without), class_size."""
    options = (k, order, sketches, similarity)
    if _unique(docs, key):
        named = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        return _of_unique_ids(named, *options).withColumnRenamed("id", key)
    rows = _classes_of_numbers(docs, key, text, options)
    classes = rows.groupBy("class_number").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    joined = spread_join(rows, classes, ["class_number"], "class_size", rows.count(), F.col("number"))
    return joined.select(F.col("id").alias(key), "class_id", "n_links", "class_size")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS, order: int = ORDER, sketches: int = SKETCHES, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stand for their class (the smallest id; a null one only if there is no other), columns as they were."""
    options = (k, order, sketches, similarity)
    if _unique(docs, key):
        stays = near_duplicates(docs, key, text, *options).filter(F.col(key) == F.col("class_id")).select(F.col(key).alias("__id"))
        return docs.join(stays, docs[key] == stays["__id"], "left_semi")
    first = F.min(F.struct(F.col("id").isNull(), "id", "number")).alias("first")
    stays = _classes_of_numbers(docs, key, text, options).groupBy("class_number").agg(first).select(F.col("first.number").alias("__number"))
    number = F.xxhash64(docs[key], F.coalesce(docs[text], F.lit("")))
    return docs.join(stays, number == stays["__number"], "left_semi")
