"""Fill-in-middle: a text is cut at two code points and its parts are told in another order.

The code points of a text begin at a set of byte offsets.  The set is kept in containers of 2**16
offsets each, every container in the smallest of three forms (a list of offsets, a bitmap, or runs),
with the running count of offsets before it.  The k-th code point is found by a search over these
counts and a select inside one container, so both cuts become byte offsets without decoding; the parts
are then taken as bytes by Spark's own functions.

The cuts and the form come from a SHA-256 of seed and id, so they don't depend on partitions or order.

Defined cases: null texts are empty; a text that is empty or holds one of the marks stays plain;
a null id hashes as the empty text; rows that repeat an id are cut alike if their texts are equal; an
empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import key_text

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SPAN = 1 << 16  # offsets of a container


class ArrayContainer:
    """Offsets in order."""

    def __init__(self, offsets: np.ndarray) -> None:
        self.offsets = offsets.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.offsets[k])


class BitmapContainer:
    """One bit an offset, in words of 64, with the bits before each word counted."""

    def __init__(self, flags: np.ndarray) -> None:
        self.words = np.packbits(np.pad(flags, (0, -len(flags) % 64)), bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        bits = np.unpackbits(self.words[at : at + 1].view(np.uint8), bitorder="little")
        return 64 * at + int(np.flatnonzero(bits)[k - int(self.before[at])])


class RunContainer:
    """First offsets of runs, with the offsets before each run counted."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray) -> None:
        self.starts, self.before = starts, np.concatenate([[0], np.cumsum(lengths)])

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[at]) + k - int(self.before[at])


def container(flags: np.ndarray) -> tuple[int, ArrayContainer | BitmapContainer | RunContainer]:
    """Cardinality and the smallest container of the offsets whose flag is set."""
    n = int(np.count_nonzero(flags))
    steps = np.flatnonzero(np.diff(flags, prepend=False, append=False))
    starts, ends = steps[::2], steps[1::2]
    sizes = 4 * len(starts), 2 * n, SPAN // 8
    if sizes[0] == min(sizes):
        return n, RunContainer(starts, ends - starts)
    return n, ArrayContainer(np.flatnonzero(flags)) if sizes[1] <= sizes[2] else BitmapContainer(flags)


class BoundarySet:
    """Offsets at which the code points of UTF-8 bytes begin; a stray continuation byte belongs to what is before it."""

    def __init__(self, text: bytes) -> None:
        self.n_bytes, self.containers, self.before = len(text), [], [0]
        data = np.frombuffer(text, dtype=np.uint8)
        for at in range(0, len(data), SPAN):
            begins = (data[at : at + SPAN] & 0xC0) != 0x80
            if at == 0:
                begins[0] = True
            n, held = container(begins)
            self.containers.append(held)
            self.before.append(self.before[-1] + n)

    def __len__(self) -> int:
        return self.before[-1]

    def select(self, k: int) -> int:
        """Offset of the k-th code point, counted from 0; that of the end for k = n."""
        if k >= len(self):
            return self.n_bytes
        at = bisect_right(self.before, k) - 1
        return SPAN * at + self.containers[at].select(k - self.before[at])


CUTS = "n long, first long, second long, first_byte int, second_byte int"


def _cuts(texts: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for text, x, y in zip(texts.to_pylist(), a.to_pylist(), b.to_pylist(), strict=True):
        begins = BoundarySet(text)
        n = len(begins)
        first, second = sorted((x % (n + 1), y % (n + 1)))
        out.append((n, first, second, begins.select(first), begins.select(second)))
    columns = [pa.array(x, type=t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))] if out else [pa.array([], type=t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())]
    return pa.StructArray.from_arrays(columns, names=["n", "first", "second", "first_byte", "second_byte"])


def key_hashes(key: str, seed: str) -> list[Column]:
    """The first four 32-bit numbers of the SHA-256 of seed, a colon and the key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key_text(key), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = "1", changed: int = 90, suffix_first: int = 20) -> DataFrame:
    """key, n, form (plain, psm or spm), prefix_chars, middle_chars, output.

    Of 100 texts about `changed` are cut, and of 100 of these about `suffix_first` begin with their suffix (spm).
    """
    cut = F.arrow_udf(_cuts, CUTS)
    h1, h2, h3, h4 = key_hashes(key, seed)
    whole = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("key"), whole.alias("bytes"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4")).withColumn("cut", cut("bytes", "h1", "h2"))
    string = F.col("bytes").cast("string")
    plain = (F.col("cut.n") == 0) | F.contains(string, F.lit(PREFIX)) | F.contains(string, F.lit(SUFFIX)) | F.contains(string, F.lit(MIDDLE)) | (F.col("h3") % 100 >= changed)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    part = lambda start, end: F.substring("bytes", start + 1, end - start).cast("string")
    a, b = F.col("cut.first_byte"), F.col("cut.second_byte")
    prefix, middle, suffix = part(F.lit(0), a), part(a, b), part(b, F.octet_length("bytes"))
    told = F.when(F.col("form") == "plain", string).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    shown = rows.withColumn("form", form)
    cut_only = lambda c: F.when(F.col("form") != "plain", c)
    return shown.select(F.col("key").alias(key), F.col("cut.n").alias("n"), "form", cut_only(F.col("cut.first")).alias("prefix_chars"), cut_only(F.col("cut.second") - F.col("cut.first")).alias("middle_chars"), told.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of fill_in_middle was made of; each mark is there once, as texts that hold one stay plain."""
    before = lambda c, mark: F.split_part(c, F.lit(mark), F.lit(1))
    after = lambda c, mark: F.split_part(c, F.lit(mark), F.lit(2))
    head, middle = before(output, MIDDLE), after(output, MIDDLE)
    psm = F.concat(before(after(head, PREFIX), SUFFIX), middle, after(head, SUFFIX))
    spm = F.concat(after(head, PREFIX), middle, before(after(head, SUFFIX), PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
