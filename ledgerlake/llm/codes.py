"""Product codes of vectors, with nearest entries found in geometric near-neighbour access trees (GNAT).

Components become integers, floor(scale * x).  A vector is cut into `parts` consecutive parts, and each
part position has a codebook of `entries` entries.  Every round assigns each part to its codebook's nearest
entry and moves the entries to the floor of their parts' mean; sums are taken in the tasks, then by
Spark, so one row for each component of an entry reaches the driver.

Nearest entries: a tree over a codebook's entries has split points, far apart from each other, and every
other entry belongs to its nearest split point.  Of each (split point, child) the smallest and the largest
distance are kept.  A query's distance to a split point then rules out each child whose range lies
further than the best entry so far, strictly, so no entry that ties is lost: roots are rounded away from
ruling out.  What is left is compared as integers, ties to the smaller index.

The first entries are those of the smallest ids (nulls last; equal ids by vector).  With fewer vectors than `entries`
a codebook has as many entries as there are vectors; equal entries stay apart, the first takes all.

Defined cases: vectors that are null or hold null or non-finite components drop out; vectors of other
lengths have codebooks of their own (if a length doesn't divide by `parts`, the first parts are one longer; an
empty part is 00); integers beyond 2**62 count as 2**62, errors beyond a long as its largest; rows that repeat an id are
rows of their own; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spread_join, stored

DEGREE = 4
SLACK = 1e-12  # relative; far above the error of a square root of a rounded integer
FAST = 1 << 24  # components up to this have distances that fit 64 bits
FAST_WIDTH = 1 << 12
MOST = 1 << 62
LONG_MAX = (1 << 63) - 1

Books = dict[int, list[np.ndarray]]


# ---- the tree ------------------------------------------------------------------------------------------


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to one point, exact: in 64 bits where they fit, else of Python's integers."""
    d = x - c
    return (d * d).sum(axis=1) if d.dtype != object else np.asarray([sum(v * v for v in row) for row in d], dtype=object).reshape(len(x))


def _roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


class Gnat:
    """Split points (rows of `points`), the entries below each, and ranges of squared distances."""

    def __init__(self, points: np.ndarray, members: np.ndarray) -> None:
        self.points, chosen = points, [int(members[0])]
        near = _squares(points[members], points[members[0]])
        while len(chosen) < min(DEGREE, len(members)):
            rest = [i for i, m in enumerate(members) if int(m) not in chosen]
            far = max(rest, key=lambda i: (near[i], -i))
            chosen.append(int(members[far]))
            near = np.minimum(near, _squares(points[members], points[members[far]]))
        self.splits = chosen
        to = [_squares(points[members], points[c]) for c in chosen]
        owner = [min(range(len(chosen)), key=lambda s: (to[s][i], s)) for i in range(len(members))]
        groups = [np.asarray([m for i, m in enumerate(members) if owner[i] == s and int(m) not in chosen], dtype=np.int64) for s in range(len(chosen))]
        place = {int(m): i for i, m in enumerate(members)}
        self.low, self.high = np.zeros((len(chosen), len(chosen))), np.zeros((len(chosen), len(chosen)))
        for i in range(len(chosen)):
            for j, group in enumerate(groups):
                # a split point's range to its own child leaves the point itself out
                held = [to[i][place[int(m)]] for m in group] + ([to[i][place[chosen[j]]]] if i != j else [])
                r = _roots(np.asarray(held or [0]))
                self.low[i, j], self.high[i, j] = r.min() * (1 - SLACK), r.max() * (1 + SLACK)
        self.children = [Gnat(points, g) if len(g) else None for g in groups]

    def visit(self, x: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> int:
        """Improves best (squared distance) and index of the rows; returns how many distances that took."""
        m, n = len(self.splits), 0
        point, child = np.ones((len(rows), m), dtype=bool), np.ones((len(rows), m), dtype=bool)
        for i, split in enumerate(self.splits):
            at = np.flatnonzero(point[:, i])
            mine = rows[at]
            d = _squares(x[mine], self.points[split])
            n += len(mine)
            closer = (d < best[mine]) | ((d == best[mine]) & (split < index[mine]))
            best[mine[closer]], index[mine[closer]] = d[closer], split
            root, reach = _roots(d), _roots(best[mine]) * (1 + SLACK)
            least = np.maximum(root[:, None] * (1 - SLACK) - self.high[i], self.low[i] - root[:, None] * (1 + SLACK)) * (1 - SLACK)
            out = least > reach[:, None]
            child[at] &= ~out
            out[:, i] = False
            point[at] &= ~out
        for j, below in enumerate(self.children):
            if below is not None and child[:, j].any():
                n += below.visit(x, rows[child[:, j]], best, index)
        return n


def nearest(tree: Gnat, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of each row's nearest entry, and how many distances were taken."""
    exact = x.dtype == object
    best = np.full(len(x), LONG_MAX if not exact else 1 << 200, dtype=object if exact else np.int64)
    index = np.full(len(x), len(tree.points), dtype=np.int64)
    n = tree.visit(x, np.arange(len(x)), best, index) if len(x) else 0
    return index, best, n


# ---- vectors -------------------------------------------------------------------------------------------


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), in 64 bits where distances fit, else as Python's integers."""
    v = np.floor(x * float(scale))
    if not v.size or (np.abs(v).max() <= FAST and v.shape[1] <= FAST_WIDTH):
        return v.astype(np.int64)
    whole = [max(-MOST, min(MOST, int(c))) if np.isfinite(c) else (MOST if c > 0 else -MOST) for c in v.ravel()]
    return np.asarray(whole, dtype=object).reshape(v.shape)


def bounds(width: int, parts: int) -> list[int]:
    """Where the parts begin, and the end."""
    size, more = divmod(width, parts)
    return [i * size + min(i, more) for i in range(parts + 1)]


def sound_rows(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """id, v array<double>, label of the rows whose vectors take part."""
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("label")).filter(F.coalesce(sound, F.lit(False)))


def by_width(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, row numbers, components) of the batch's vectors."""
    v = batch.column("v")
    flat, widths = v.flatten().to_numpy(zero_copy_only=False), v.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(widths)])
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        whole = flat if len(at) == len(widths) else flat[(starts[at][:, None] + np.arange(width)).ravel()]
        yield int(width), at, whole.reshape(len(at), int(width))


def first_books(vectors: DataFrame, entries: int, parts: int, scale: int) -> Books:
    """Width -> the codebook of each part position, from the vectors of the smallest ids."""
    smallest = Window.partitionBy("width").orderBy(F.asc_nulls_last("id"), "v")
    found = vectors.select("id", "v", F.size("v").alias("width")).withColumn("n", F.row_number().over(smallest)).filter(F.col("n") <= entries)
    books: Books = {}
    for r in sorted(found.select("width", "n", "v").collect(), key=lambda r: (r["width"], r["n"])):
        books.setdefault(r["width"], []).append(r["v"])
    cut = {w: bounds(w, parts) for w in books}
    wholes = {w: whole_numbers(np.asarray(x, dtype=np.float64).reshape(len(x), w), scale) for w, x in books.items()}
    return {w: [x[:, a:b] for a, b in zip(cut[w], cut[w][1:])] for w, x in wholes.items()}


def matched(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both of 64 bits, or both of Python's integers."""
    return (x, book) if x.dtype == book.dtype else (x.astype(object), book.astype(object))


class Coder:
    """Codebooks by width with their trees, which are built when first met."""

    def __init__(self, books: Books, scale: int) -> None:
        self.books, self.scale = books, scale
        self.trees: dict[tuple[int, int, bool], Gnat] = {}

    def parts(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(width, row numbers, part, its components, codes, squared distances) for all parts of the batch's vectors."""
        for width, at, raw in by_width(batch):
            whole, a = whole_numbers(raw, self.scale), 0
            for p, book in enumerate(self.books[width]):
                x, points = matched(whole[:, a : (a := a + book.shape[1])], book)
                name = width, p, points.dtype == object
                if name not in self.trees:
                    self.trees[name] = Gnat(points, np.arange(len(points)))
                codes, errors, _ = nearest(self.trees[name], x)
                yield width, at, p, x, codes, errors


def moved(vectors: DataFrame, books: Books, scale: int) -> Books:
    """The codebooks after a round; entries without parts stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sums = Coder(books, scale), {}
        for batch in batches:
            for width, _, p, x, codes, _ in coder.parts(batch):
                for code in np.unique(codes):
                    mine = x[codes == code]
                    had = sums.setdefault((width, p, int(code)), [0, np.zeros(x.shape[1], dtype=object)])
                    had[0] += len(mine)
                    had[1] = had[1] + mine.sum(axis=0).astype(object)
        flat = [(*name, i, n, str(total)) for name, (n, totals) in sums.items() for i, total in enumerate(totals)]
        if flat:
            kinds = pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*flat), kinds, strict=True)], ["width", "part", "entry", "place", "n", "total"])

    found = vectors.select("v").mapInArrow(run, "width int, part int, entry int, place int, n long, total string")
    sums = found.groupBy("width", "part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    after = {w: [b.astype(object) for b in book] for w, book in books.items()}
    for r in sums.collect():
        after[r["width"]][r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return {w: [narrow(b) for b in book] for w, book in after.items()}


def narrow(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64) if book.shape[1] <= FAST_WIDTH and all(abs(c) <= FAST for c in book.ravel()) else book


def digest(book: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(c)) for part in book for entry in part for c in entry).encode()).hexdigest()


def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """key, code, error, label_error, codebooks_sha256 of the rows whose vectors take part.

    Each round reads the vectors again, its tasks send one row for each component of an entry.
    """
    vectors = sound_rows(rows, key, vector, label)
    books = first_books(vectors, entries, parts, scale)
    for _ in range(rounds if books else 0):
        books = moved(vectors, books, scale)
    coded = stored(coded_rows(vectors, books, scale), "codes")
    sums = coded.groupBy("no_label", "label_text").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), F.count(F.lit(1)).alias("n"))
    whole = sums.select("no_label", "label_text", "n", F.least("total", F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long").alias("label_error"))
    joined = spread_join(coded, whole, ["no_label", "label_text"], "n", coded.count(), F.struct("id", "code"))
    return joined.select(F.col("id").alias(key), "code", "error", "label_error", "codebooks_sha256")


def coded_rows(vectors: DataFrame, books: Books, scale: int) -> DataFrame:
    """id, label_text, no_label, code, error, codebooks_sha256."""
    kind, digests = dict(vectors.dtypes)["id"], {w: digest(b) for w, b in books.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(books, scale)
        for batch in batches:
            codes, names = (np.full(batch.num_rows, "", dtype=object) for _ in range(2))
            errors = np.zeros(batch.num_rows, dtype=object)
            for width, at, _, _, found, squares in coder.parts(batch):
                codes[at] += np.asarray([f"{c:02x}" for c in found.tolist()], dtype=object)
                errors[at] += squares.astype(object)
                names[at] = digests[width]
            made = pa.array(codes, type=pa.string()), pa.array([min(int(e), LONG_MAX) for e in errors], type=pa.int64()), pa.array(names, type=pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label_text", "no_label")), *made], ["id", "label_text", "no_label", "code", "error", "codebooks_sha256"])

    shown = vectors.select("id", "v", F.coalesce(F.col("label").cast("string"), F.lit("")).alias("label_text"), F.col("label").isNull().alias("no_label"))
    return shown.mapInArrow(run, f"id {kind}, label_text string, no_label boolean, code string, error long, codebooks_sha256 string")
