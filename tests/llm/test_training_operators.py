"""The ten operators against brute force, on small tables with every odd case."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import bpe, exact_dedup, near_dedup, packing, pii, quality, repeats, sharding, topk, toxicity
from ledgerlake.llm.registry import QUERIES, SURROGATE_KEY, tokenizer_path

KIND = "doc_id long, text string, id string, h string, data string, norm string, slot string, n string"
LONG = "The quick brown fox jumps over the lazy dog. " * 3000
TEXTS = [
    (0, "Hello world"), (1, "hello WORLD"), (2, None), (3, ""), (4, "Ärger über Öl"), (5, "ärger über öl"), (6, LONG), (7, LONG), (8, "x" * 70_000), (9, "a  b \n c  "), (10, "ends <|endoftext|> here"),
    (11, "naïve space　wide 日本語 🙂 é́"), (12, "word " * 7), (13, "It's we'll don't 12 345 !!"), (14, "Hello world"), (None, "no id"), (16, "Hello world"), (16, "Hello world"), (2**60, "far"), (18, "ẞTRASSE İstanbul ΣΑΣ"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, *["clash"] * 6) for i, t in TEXTS], KIND).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("options", [{}, {"hash_bits": 2, "capacity": 2}, {"capacity": 1}])
def test_exact_groups(docs, options):
    got = exact_dedup.exact_groups(docs, **options).collect()
    groups = collections.defaultdict(list)
    for i, t in TEXTS:
        groups[lower(t)].append(i)
    want = collections.Counter()
    for i, t in TEXTS:
        keep = max((x for x in groups[lower(t)] if x is not None), default=None)
        want[(i, keep, len(groups[lower(t)]), i == keep, hashlib.sha256(lower(t).encode()).hexdigest())] += 1
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
    assert sorted(r.doc_id or -1 for r in exact_dedup.drop_copies(docs, **options).collect()) == sorted(k[0] or -1 for k, n in want.items() if k[3] for _ in range(n))


def test_directory_splits_only_what_overflows(spark):
    cells = spark.createDataFrame([(i, 1) for i in range(64)] + [(40_000, 1)], "cell long, n long")
    out = {(r.d, r.p) for r in exact_dedup.double_directory(cells, 20).collect()}
    sizes = [sum(1 for c in [*range(64), 40_000] if c >> (exact_dedup.MAX_DEPTH - d) == p) for d, p in out]
    assert max(sizes) <= 20 and sum(sizes) == 65
    assert sum(2.0**-d for d, _ in out) == 1.0  # the buckets cover all slots once
    assert (1, 1) in out  # the sparse half was never split again


def winner(key, n, weights=None):
    def score(s):
        u = (int(hashlib.md5(f"{key}#{s}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        return math.log(u) / (weights[s] if weights else 1)

    return max(range(n), key=lambda s: (score(s), -s))


def test_sharding(docs, spark):
    got = sharding.shard_rows(docs, 5, rows_per_block=2).collect()
    key = lambda i: "" if i is None else str(i)
    want = collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), winner(key(i), 5), winner(key(i), 6)) for i, t in TEXTS)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 5)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    w = [1.0, 1.0, 2.0]
    rows = sharding.shard_rows(many, 3, weights=w).collect()
    assert all(r.shard == winner(str(r.doc_id), 3, w) for r in rows)
    share = collections.Counter(r.shard for r in rows)
    assert 0.45 < share[2] / 4000 < 0.55


def test_bpe_matches_the_library(docs):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids, r.decoded) for r in bpe.encode_texts(docs, path, long_chars=2_000, segment_chars=500).collect())
    want = collections.Counter()
    for i, t in TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), np.asarray(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False))] += 1
    assert {k: (bytes(k[2]), v) for k, v in got.items()} == {k: (bytes(k[2]), v) for k, v in want.items()}


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh", "the ", "1234567890", "!?.,'s", "äöüß", "日本🙂", " \n\t", "aA1 '!\n<|endoftext|>"])
def test_tree_joins_cuts_anywhere(alphabet):
    path = tokenizer_path("byte_bpe_50k.json")
    library = bpe.encoder(path).library
    rng = np.random.default_rng(len(alphabet))
    for size in (40, 100, 333):
        text = "".join(rng.choice(list(alphabet), 2_000))
        places = list(range(0, len(text), size))
        parts = [library.encode(text[a : a + size], add_special_tokens=False).ids for a in places]
        assert bpe.join_tree(parts, [True] * len(parts), path) == library.encode(text, add_special_tokens=False).ids
        split = bpe.segments(text, size)
        assert "".join(s for s, _ in split) == text
        assert bpe.join_tree([library.encode(s, add_special_tokens=False).ids for s, _ in split], [h for _, h in split], path) == library.encode(text, add_special_tokens=False).ids


def test_packing(docs):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack(docs, path).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert all(r.length == 1 << r.bucket <= 2048 and r.offset == 0 for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i, t in TEXTS:
        if i == 16:
            continue  # there twice
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by[i], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in pieces) == np.asarray(ids, "<u4").tobytes()
        assert [r.start for r in pieces] == list(np.cumsum([0, *(r.length for r in pieces[:-1])]))
        assert {r.doc_tokens for r in pieces} == {len(ids)}
    assert packing.piece_lengths(5000) == [2048, 2048, 512, 256, 128, 8]


def test_run_length_index_finds_all_repeats():
    rng = np.random.default_rng(3)
    for _ in range(60):
        base = rng.integers(97, 99, 200).astype(np.uint8)
        cuts = [base[rng.integers(0, 80) : rng.integers(90, 200)].copy() for _ in range(rng.integers(1, 6))]
        length = int(rng.integers(3, 50))
        count = collections.Counter(bytes(c[i : i + length]) for c in cuts for i in range(len(c) - length + 1))
        want = [[i for i in range(len(c) - length + 1) if count[bytes(c[i : i + length])] > 1] for c in cuts]
        assert [x.tolist() for x in repeats.repeated_starts(cuts, length)] == want


def covered(texts, length):
    count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                mark[i : i + length] = True
        out.append(mark)
    return out


@pytest.mark.parametrize(("most_cuts", "cut_starts"), [(1_000, 4_096), (1, 4_096), (1_000, 7)])
def test_repeats_against_brute_force(spark, docs, monkeypatch, most_cuts, cut_starts):
    monkeypatch.setattr(repeats, "CUT_STARTS", cut_starts)
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdé 🙂"), n))
    shared = [word(60) for _ in range(4)]
    rows = [(i, word(30) + shared[i % 4][i % 9 :] + word(20) + shared[(i + 1) % 4] + ("zz" * 40 if i % 5 == 0 else "")) for i in range(30)]
    rows += [(40, None), (41, ""), (42, "short"), (None, rows[0][1]), (3, rows[3][1]), (3, "other " + shared[0])]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=40, anchor=15, group_bytes=500, most_cuts=most_cuts).collect()
    texts = [(t or "").encode() for _, t in rows]
    want = collections.Counter()
    for (i, _), t, mark in zip(rows, texts, covered(texts, 40), strict=True):
        kept = np.frombuffer(t, np.uint8)[~mark].tobytes()
        want[(i, len(t), int(mark.sum()), int((np.diff(np.concatenate([[0], mark.astype(int)])) == 1).sum()), kept)] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want


@pytest.mark.parametrize(("most_cuts", "cut_starts", "group_bytes"), [(1_000, 4_096, 500), (1_000, 4_096, 1 << 20), (1, 4_096, 500), (1_000, 7, 1 << 20), (1, 7, 500)])
def test_shorter_passages_are_found_beside_the_removed_ones(spark, monkeypatch, most_cuts, cut_starts, group_bytes):
    monkeypatch.setattr(repeats, "CUT_STARTS", cut_starts)
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("abcdé 🙂"), n))
    shared, short = [word(60) for _ in range(4)], [word(n) for n in (14, 18, 22)]
    rows = [(i, word(30) + short[i % 3] + word(25) + (shared[i % 4][i % 9 :] if i % 2 else "") + ("zz" * 40 if i % 5 == 0 else "") + word(9 * (i % 3)) + short[(i + 1) % 3][: 9 + i % 9]) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "short"), (None, rows[0][1]), (3, rows[3][1]), (3, "other " + shared[0]), (53, short[2]), (54, "a" * 90)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=60, anchor=8, group_bytes=group_bytes, most_cuts=most_cuts, passage=25).collect()
    texts = [(t or "").encode() for _, t in rows]
    want = collections.Counter((i, int(a.sum()), np.frombuffer(t, np.uint8)[~a].tobytes(), int(b.sum())) for (i, _), t, a, b in zip(rows, texts, covered(texts, 60), covered(texts, 25), strict=True))
    assert collections.Counter((r.doc_id, r.n_removed, bytes(r.kept), r.n_repeated) for r in got) == want
    assert any(n == 0 < m for _, n, _, m in want)


def test_op7_reports_passages_of_over_50_words(spark, tmp_path):
    rng = np.random.default_rng(9)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))
    passage = words(52)
    assert repeats.PASSAGE < len(passage) < repeats.LENGTH
    rows = [(1, f"{words(60)} {passage} {words(40)}"), (2, f"{words(9)} {passage}"), (3, words(150)), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op7_run_length_index"](spark, str(tmp_path)).collect()}
    assert [got[i].n_repeated for i in (3, 4)] == [0, 0] and all(len(passage) <= got[i].n_repeated <= len(passage) + 4 for i in (1, 2))
    assert all(r.n_removed == 0 and r.text == (t or "") for (i, t) in rows for r in [got[i]])  # the contract's rule of 400 bytes


@pytest.mark.parametrize("period", [1, 2, 10, 97, 300])
def test_cuts_of_periodic_text_are_bounded(period):
    rng = np.random.default_rng(period)
    text = bytes(rng.integers(97, 123, period).astype(np.uint8)) * (1_000_000 // period)
    _, lo, hi, twice = repeats.cut_text(text, 400, 128)
    assert (hi - lo).max() <= repeats.CUT_STARTS + 400 and lo[0] == 0 and hi[-1] == len(text)
    assert (lo[1:] == hi[:-1] - 399).all()  # every start lies in one cut
    assert len({text[a:b] for a, b in zip(lo, hi)}) <= 2 * period + 2


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        at = int(rng.integers(0, max(1, len(out))))
        [lambda: out.insert(at, f"w{rng.integers(99)}"), lambda: out.pop(at) if out else None, lambda: out.__setitem__(at, "new") if out else None][rng.integers(3)]()
    return out


def test_banded_alignment():
    rng = np.random.default_rng(7)
    pairs = []
    for _ in range(300):
        a = [f"w{x}" for x in rng.integers(0, 20, rng.integers(0, 40))]
        pairs.append((a, edited(rng, a, int(rng.integers(0, 12)))))
    want = [1 - distance(a, b) / max(1, len(a), len(b)) >= 0.8 - 1e-12 for a, b in pairs]
    assert near_dedup.similar([(" ".join(a), " ".join(b)) for a, b in pairs], 0.8).tolist() == want


def test_near_duplicates(spark, docs):
    rng = np.random.default_rng(11)
    bases = [[f"w{x}" for x in rng.integers(0, 5000, 120)] for _ in range(6)]
    line = [f"common{i}" for i in range(12)]
    rows, group = [], {}
    for g, base in enumerate(bases):
        for c in range(5):
            group[g * 10 + c] = g
            rows.append((g * 10 + c, " ".join(edited(rng, base, 4 if c else 0))))
    for i in range(40):  # unlike texts that share a passage
        rows.append((1000 + i, " ".join([*line, *(f"u{x}" for x in rng.integers(0, 10**6, 14))])))
    rows += [(2000, None), (2001, ""), (2002, "one"), (2003, "one")]
    got = {r.doc_id: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].class_id == group[i] * 10 for i in group)
    assert all(got[1000 + i].class_size == 1 for i in range(40))
    assert got[2001].class_id == 2000 and got[2003].class_id == 2002 and got[2003].n_links == 0
    kept = sorted(r.doc_id for r in near_dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == sorted([*(10 * g for g in range(6)), *range(1000, 1040), 2000, 2002])
    # ids that are null or repeat with other texts
    odd = [*rows, (None, "no id"), (None, rows[7][1]), (0, "quite another text"), (0, rows[0][1])]
    df = spark.createDataFrame(odd, "doc_id long, text string")
    found = [(r.doc_id, r.class_id, r.class_size) for r in near_dedup.near_duplicates(df).collect()]
    assert len(found) == len(odd) and found.count((0, 0, 6)) == 2 and (0, 0, 1) in found and (None, None, 1) in found and (None, 10, 6) in found
    kept = [(r.doc_id, r.text) for r in near_dedup.one_of_each(df).collect()]
    assert (None, "no id") in kept and (0, "quite another text") in kept and (None, rows[7][1]) not in kept and len(kept) == 6 + 40 + 2 + 2 + 1
    assert near_dedup.near_duplicates(docs).count() == len(TEXTS)


@pytest.mark.parametrize(("n", "edits"), [(5, 1), (10, 2), (15, 2), (15, 3), (30, 6), (80, 16), (100, 15), (100, 20), (400, 80)])
def test_most_pairs_at_the_threshold_share_a_sketch(spark, n, edits):
    rng, rows = np.random.default_rng(n + edits), []
    for i in range(300):
        words = [f"w{x}" for x in rng.integers(0, 10**6, n)]
        rows.append((2 * i, " ".join(words), ""))
        for at in rng.choice(n, edits, replace=False):
            words[at] = f"n{at}"
        rows.append((2 * i + 1, " ".join(words), ""))
    df = spark.createDataFrame(rows, "id long, text string, digest string")
    s = {r.id: r.s for r in near_dedup.sketch_texts(df, near_dedup.WORDS, near_dedup.ORDER, near_dedup.SKETCHES).collect()}
    recall = np.mean([any(a == b for a, b in zip(s[2 * i], s[2 * i + 1], strict=True)) for i in range(300)])
    print(n, edits, recall)
    assert recall >= 0.97


@pytest.mark.parametrize(("tile", "cell"), [(near_dedup.TILE, near_dedup.CELL_BYTES), (25, 5_000)])
def test_drifting_copies_keep_every_link_between_classes(spark, monkeypatch, tile, cell):
    monkeypatch.setattr(near_dedup, "TILE", tile)
    monkeypatch.setattr(near_dedup, "CELL_BYTES", cell)
    rng = np.random.default_rng(5)
    texts = [[f"w{x}" for x in rng.integers(0, 10**6, 100)]]
    while len(texts) < 400:
        new = list(texts[rng.integers(0, len(texts))])
        for at in rng.choice(100, 12, replace=False):
            new[at] = f"n{len(texts)}_{at}"
        texts.append(new)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    signed = near_dedup.sketch_texts(df.select(F.col("doc_id").alias("id"), "text", F.lit("").alias("digest")), near_dedup.WORDS, near_dedup.ORDER, near_dedup.SKETCHES)
    buckets = collections.defaultdict(set)
    for r in signed.collect():
        for j, key in enumerate(r.s):
            buckets[j, key].add(r.id)
    pairs = sorted({(a, b) for b_ in buckets.values() for a in b_ for b in b_ if a < b})
    like = near_dedup.similar([(" ".join(texts[a]), " ".join(texts[b])) for a, b in pairs], 0.8)
    want = list(range(len(texts)))
    for a, b in (p for p, ok in zip(pairs, like, strict=True) if ok):
        low, high = sorted((want[a], want[b]))
        want = [low if x == high else x for x in want]
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()} == dict(enumerate(want))


def test_copies_that_gain_a_repeat_are_found(spark):
    # an earlier form gave all k-mers of a text new hashes once one of them was there twice
    rng, rows = np.random.default_rng(17), []
    for i in range(20):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 200)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:120], *words[10:13], *words[120:]]))]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(40)}


def test_near_duplicates_of_the_small_table_against_all_pairs(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    first = {}
    for r in sorted(docs.collect()):
        first.setdefault(r.text or "", r.doc_id)
    texts = sorted(first, key=lambda t: len(t.split()))
    want = {i: i for i in first.values()}
    pairs = [(s, t) for n, s in enumerate(texts) for t in texts[n + 1 :] if len(s.split()) >= 0.8 * len(t.split()) - 1]
    for (s, t), ok in zip(pairs, near_dedup.similar(pairs, 0.8), strict=True):
        if ok:
            low, high = sorted((want[first[s]], want[first[t]]))
            want = {i: low if c == high else c for i, c in want.items()}
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert {i: got[i] for i in want} == want


def test_bags_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(19)
    texts = [[f"w{x}" for x in rng.integers(0, 60, rng.integers(1, 90))] for _ in range(60)]
    texts += [edited(rng, t, int(rng.integers(0, 1 + len(t) // 4))) for t in texts] + [["same"] * 400, ["same"] * 450]
    hashes = near_dedup.WordHashes()
    bags = np.stack([np.frombuffer(near_dedup.bag(np.asarray([hashes[w] for w in t], dtype=np.uint64)), dtype=np.uint8) for t in texts])
    n = np.asarray([len(t) for t in texts], dtype=np.int32)
    left = set(zip(*(x.tolist() for x in near_dedup.left_by_bags(bags, n, bags, n, 0.8)), strict=True))
    pairs = [(i, j) for i in range(len(texts)) for j in range(len(texts))]
    like = near_dedup.similar([(" ".join(texts[i]), " ".join(texts[j])) for i, j in pairs], 0.8)
    assert {p for p, ok in zip(pairs, like, strict=True) if ok} <= left
    assert len(left) < 0.5 * len(pairs)


def test_components(spark):
    pairs = [(i + 1, i) for i in range(40)] + [(101, 100), (102, 101)]
    got = {r.id: r.class_id for r in near_dedup.components(spark.createDataFrame(pairs, "id long, leader long")).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 44


def test_top_k(spark):
    rng = np.random.default_rng(13)
    base = rng.normal(size=(120, 8)).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(base)] + [(200, base[0]), (201, base[0]), (202, None), (203, [1.0, None] * 4), (204, [float("nan")] * 8), (205, [float("inf")] * 8), (206, [1.0, 2.0]), (207, [3.0, 4.0]), (208, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.top_k(df, F.col("id") % 2 == 0, k=5, block_rows=40, group_rows=25).orderBy("query_id", "rank").collect()]
    clean = [(i, np.floor(64 * np.asarray(v, dtype=np.float64))) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, v in clean:
        if i % 2 == 0:
            best = sorted((-int(v @ w), j) for j, w in clean if j != i and len(w) == len(v))[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == want
    assert topk.top_k(df.limit(0), F.col("id") % 2 == 0).count() == 0


PEOPLE = [
    (0, "mail Ann.Lee22@mail.example.com or ann.lee22@MAIL.example.com, call +1 (614) 555-8001."), (1, "ann.lee22@mail.example.com at 10.20.30.40 with 4111 1111 1111 1111 and 4111111111111111"), (2, "4111111111111112 and 1.2.3.4.5 and 999.1.1.1 stay"),
    (3, 'token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B" 9233a8ecf7c5b09fe5949719b6b82bc439e9329b'), (4, "Frau Müller met Herr Müller, Mr. John Smith and г-жа Иванова."), (5, None), (6, ""), (7, "nothing here"), (8, "ab@x.org cd@x.org"),
]


def test_surrogates(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in PEOPLE], "doc_id long, text string, kind string")
    got = {r.doc_id: r for r in pii.replace_entities(df, SURROGATE_KEY).collect()}
    assert len(got) == len(PEOPLE) and got[5].text is None and got[6].text == "" and got[7].text == "nothing here" and got[2].text == PEOPLE[2][1]
    assert "Ann" not in got[0].text and "555-" in got[0].text and "+1 (" in got[0].text and "8001" not in got[0].text
    mails = [w for i in (0, 1) for w in got[i].text.replace(",", "").split() if "@" in w]
    assert len({m.lower() for m in mails}) == 1 and mails[0].endswith("example.com")
    cards = got[1].text.split(" with ")[1].split(" and ")
    assert cards[0].replace(" ", "") == cards[1] and cards[1].startswith("4") and cards[1] != "4111111111111111"
    digits = [int(c) for c in cards[1]][::-1]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    ip = got[1].text.split(" at ")[1].split()[0]
    assert all(0 < int(x) < 256 for x in ip.split(".")) and ip != "10.20.30.40"
    upper, low = got[3].text.split('"')[1], got[3].text.split()[-1]
    assert upper == low.upper() and upper != PEOPLE[3][1].split('"')[1]
    names = got[4].text
    assert names.startswith("Frau ") and " Herr " in names and "Müller" not in names and "Smith" not in names and "г-жа " in names
    assert all("а" <= c <= "я" for c in names.split("г-жа ")[1].rstrip(".").lower())
    assert names.split()[1] != names.split()[4].rstrip(",")  # one name, two genders
    assert pii.replace_entities(df, "another key").filter("doc_id = 0").first().text != got[0].text
    assert pii.replace_entities(df.limit(0), SURROGATE_KEY).count() == 0


def test_colliding_surrogates_are_resolved(spark):
    # two-letter mailboxes: 676 surrogates for 300 entities meet often
    rows = [(i, f"{chr(97 + i // 26)}{chr(97 + i % 26)}@x.org") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = [r.text for r in pii.replace_entities(df, "k").collect()]
    assert len(set(out)) == 300 and not set(out) & {t for _, t in rows}
    raw = pii.with_surrogates(df.select(F.lit("email").alias("kind"), F.col("text").alias("canon"), F.lit(None).cast("string").alias("gender"), F.lit(0).alias("attempt")), "k")
    assert raw.select("surrogate").distinct().count() < 300


def test_names_keep_coreference_and_columns_may_clash(spark):
    rows = [
        (0, "Mr. John Smith left. Later Mr. Smith and Mr. John-Paul Jones met Dr. Smith.", "a", 1),
        (1, "Mr. Smith, call (743) 555-3824 or 743 555 3824, not 12743 555 3824x.", "b", 2),
        (2, "Mrs. John Smith", None, 3),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, found string, row long").withColumns({"between": F.lit("x"), "moved": F.lit("y"), "doc": F.lit("z"), "n": F.lit(7), "__entities": F.lit("old")})
    got = {r.doc_id: r for r in pii.replace_entities(df, "k").collect()}
    full, short, double, doctor = re.fullmatch(r"Mr\. (\w+ \w+) left\. Later Mr\. (\w+) and Mr\. (\w+-\w+ \w+) met Dr\. (\w+)\.", got[0].text).groups()
    assert full.split()[1] == short != doctor and double.startswith(full.split()[0] + "-") and not {"John", "Smith", "Paul", "Jones"} & set(re.findall(r"\w+", got[0].text))
    assert got[1].text.startswith(f"Mr. {short}, call (7") and got[2].text.split()[2] != short
    a, b = re.search(r"call (\(7\d\d\) 555-\d{4}) or (7\d\d 555 \d{4}), not 12743 555 3824x\.", got[1].text).groups()
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != "7435553824"
    assert [got[i]["__entities"] for i in range(3)] == [4, 3, 1]
    assert [(r.found, r.row, r.between, r.moved, r.doc, r.n) for r in (got[i] for i in range(3))] == [("a", 1, "x", "y", "z", 7), ("b", 2, "x", "y", "z", 7), (None, 3, "x", "y", "z", 7)]


def test_surrogates_outgrow_a_full_format(spark, monkeypatch):
    monkeypatch.setitem(pii.SYLLABLES, "latin", ["ba", "de"])
    letters = "abcdefghijklmnopqrstuvwxyz"
    mails = [("email", f"{a}{b}@{host}.org", None) for a in letters for b in letters for host in ("one", "two")]
    names = [("name", f"Smith{c}", "male") for c in letters]
    df = spark.createDataFrame(mails + names, "kind string, canon string, gender string")
    got = pii.resolve(df, "key").collect()
    assert len(got) == len({(r.kind, r.surrogate) for r in got}) == len(mails) + len(names)
    assert all(r.surrogate.endswith("example.org") for r in got if r.kind == "email")
    assert not {r.canon for r in got} & {r.surrogate for r in got}


def test_toxicity_learns_and_locates(spark):
    rng = np.random.default_rng(17)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(800):
        sentences = [" ".join(rng.choice(words, 8)) for _ in range(5)]
        bad = i % 3 == 0
        if bad:
            sentences[2] += " " + rng.choice(["vileness", "vileworm", "scoundrel"])
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(bad)))
    labels += [(0, None), (9999, 1)]
    rows += [(5000, None), (5001, ""), (None, "word1 vileness")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == (i % 3 == 0) for i in held]) > 0.97
    assert got[5000].score == got[5001].score == 0 and got[None].predicted == 1
    found = toxicity.offending_sentences(docs.filter("doc_id = 3"), model).collect()
    assert len(found) == 1 and "vile" in found[0].sentence or "scoundrel" in found[0].sentence
    assert rows[3][1][found[0].start : found[0].start + found[0].length] == found[0].sentence
    p = 1 - np.prod([1 - 1 / (1 + math.exp(-model.logit(s))) for s in toxicity.SENTENCE.findall(rows[4][1])])
    assert got[4].score == pytest.approx(p, abs=1e-6)
    untaught = toxicity.train(docs, marks.filter("toxic = 0"))
    assert {r.score for r in toxicity.score(docs, untaught).collect()} == {0.0}


def test_toxicity_counts_features_over_all_labelled_documents(spark):
    rows = [(i, f"plain words here{' wickedest' if i % 20 == 0 else ' vile' if i % 2 == 0 else ''}.", int(i % 2 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    model = toxicity.train(df, df, max_rows=40)
    assert model.weights[toxicity.bucket("vile")] > 0
    assert model.weights[toxicity.bucket("wickedest")] > 0  # few of a sample of 40 hold it
    assert toxicity.MAX_ROWS == 4_000
    free = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    got = {r.bucket: (r.clean, r.toxic) for r in toxicity.feature_counts(df.filter(F.col("doc_id").isin([r[0] for r in free])).withColumnRenamed("toxic", "y"), "text").collect()}
    assert got[-1] == (sum(not r[2] for r in free), sum(r[2] for r in free))
    assert got[toxicity.bucket("wickedest")] == (0, sum("wickedest" in r[1] for r in free))


def test_expectation_maximisation_finds_the_accuracies():
    rng = np.random.default_rng(19)
    bad = rng.random(20_000) < 0.3
    votes = np.zeros((len(bad), 4), dtype=np.int64)
    for j, (hit, false) in enumerate(((0.9, 0.02), (0.6, 0.05), (0.8, 0.01), (0.5, 0.1))):
        says = np.where(bad, rng.random(len(bad)) < hit, rng.random(len(bad)) < false)
        votes[:, j] = np.where(rng.random(len(bad)) < 0.2, 0, np.where(says, 2, 1))
    pattern, n = np.unique(quality.patterns(votes), return_counts=True)
    model = quality.expectation_maximisation(pattern, n.astype(float), 4)
    assert model.prior == pytest.approx(0.3, abs=0.02)
    assert model.rates[1, :, 1] == pytest.approx([0.9, 0.6, 0.8, 0.5], abs=0.04)
    assert model.rates[0, :, 1] == pytest.approx([0.02, 0.05, 0.01, 0.1], abs=0.03)


def test_quality_keeps_clean_and_drops_junk(spark):
    rng = np.random.default_rng(23)
    vocabulary = [f"{a}{b}" for a in ("tele", "micro", "photo", "bio", "geo") for b in ("graph", "scope", "logy", "meter", "sphere", "gram")] + ["the", "of", "and", "in"] * 6
    clean = lambda: ". ".join(" ".join(rng.choice(vocabulary, 12)).capitalize() for _ in range(6)) + "."
    junk = [lambda: " | ".join(rng.choice(vocabulary, 60)), lambda: " ".join(w + "$$$" for w in rng.choice(vocabulary, 60)), lambda: " ".join(w.upper() + "!!" for w in rng.choice(vocabulary, 60)), lambda: "\n".join([clean()[:60]] * 30)]
    rows = [(i, clean() if i % 4 else junk[i // 4 % 4]()) for i in range(400)] + [(1000, None), (1001, ""), (None, clean())]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    found = quality.described(docs)
    model = quality.train(found)
    got = {r.doc_id: r for r in quality.score(found, model).collect()}
    assert all(got[i].keep for i in range(400) if i % 4) and got[1000].keep and got[1001].keep and got[None].keep
    assert np.mean([got[i].keep for i in range(0, 400, 4)]) < 0.1
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.keep for r in got.values())


@pytest.mark.parametrize("run", [lambda d: exact_dedup.exact_groups(d), lambda d: exact_dedup.drop_copies(d), lambda d: sharding.shard_rows(d, 4), lambda d: bpe.encode_texts(d, tokenizer_path("byte_bpe_50k.json")), lambda d: packing.pack(d, tokenizer_path("word_bpe_49k.json")), lambda d: repeats.remove_repeats(d), lambda d: near_dedup.near_duplicates(d), lambda d: pii.replace_entities(d, "k"), lambda d: quality.score(f := quality.described(d), quality.train(f)), lambda d: quality.keep_good(d, quality.train(quality.described(d))), lambda d: toxicity.score(d, toxicity.train(d, d.select("doc_id", F.lit(1).alias("toxic"))))])
def test_empty_tables(none, run):
    assert run(none).count() == 0


def test_odd_rows_do_not_break(docs):
    n = len(TEXTS)
    assert pii.replace_entities(docs, "k").count() == n
    found = quality.described(docs)
    assert quality.score(found, quality.train(found)).count() == n
    assert repeats.remove_repeats(docs).count() == n
    assert toxicity.score(docs, toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic")))).count() == n


def test_bags_rule_out_long_texts_that_share_a_passage():
    rng = np.random.default_rng(23)
    passage, hashes = [f"p{x}" for x in range(490)], near_dedup.WordHashes()
    texts = [passage + [f"t{i}_{x}" for x in rng.integers(0, 10**6, 210)] for i in range(20)]
    bags = np.stack([np.frombuffer(near_dedup.bag(np.asarray([hashes[w] for w in t], dtype=np.uint64)), dtype=np.uint8) for t in texts])
    n = np.asarray([len(t) for t in texts], dtype=np.int32)
    i, j = near_dedup.left_by_bags(bags, n, bags, n, 0.8)
    assert (i == j).all() and len(i) == len(texts)


def test_a_pair_is_left_to_its_first_shared_bucket():
    buckets = [["1:5", "2:7", "3:9"], ["2:7", "3:9"], ["3:9"], ["1:5", "3:9", "4:0"]]
    common = lambda own: [(i, j) for bits in [near_dedup.earlier_buckets(buckets, own)] for i in range(4) for j in range(i) if not (bits[i] & bits[j]).any()]
    assert common("1:5") == [(i, j) for i in range(4) for j in range(i)]
    assert common("3:9") == [(2, 0), (2, 1), (3, 1), (3, 2)]


def test_tiles_join_members_with_no_text_and_are_dealt_one_by_one(spark, monkeypatch):
    # an earlier form joined every member with its text's bag, its buckets and again for counts, and gave one task all tiles of a cell
    monkeypatch.setattr(near_dedup, "TILE", 25)
    rng = np.random.default_rng(29)
    texts = [" ".join([*(f"p{x}" for x in range(90)), *(f"t{x}" for x in rng.integers(0, 40, 10 + i % 40))]) for i in range(120)]
    words = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    members = spark.createDataFrame([(i, j, 7 - j, i - i % 3) for i in range(120) for j in range(1 + i % 2)], "id long, j int, key long, c long")
    rows = near_dedup.bagged(members, words)
    assert rows.count() == 120 and sorted(map(len, (r.buckets for r in rows.collect()))) == [1] * 60 + [2] * 60
    found = near_dedup.tile_pairs(rows, 0.8)
    plan = found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    joins = [x for x in plan.split("\n") if "Join" in x]
    assert len(joins) == 1 and "bucket" in joins[0] and "MapInArrow" not in plan
    assert re.search(r"hashpartitioning\(bucket#\d+, cell#\d+, a#\d+, b#\d+, \d+\), REPARTITION_BY_COL", plan)
    got = [(r.id, r.leader) for r in found.collect()]
    hashes = near_dedup.WordHashes()
    bags = np.stack([np.frombuffer(near_dedup.bag(np.asarray([hashes[w] for w in t.split()], dtype=np.uint64)), dtype=np.uint8) for t in texts])
    n = np.asarray([len(t.split()) for t in texts], dtype=np.int32)
    left = zip(*near_dedup.left_by_bags(bags, n, bags, n, 0.8), strict=True)
    assert sorted(got) == sorted((i, j) for i, j in left if i > j and i // 3 != j // 3) and len(got) > 1000


def test_caches_of_a_worker_stay_small():
    # a worker keeps what a cache took: in the pipeline the tokenizer's could hold two million entries, those of quality and sketches half a million
    import corpus_pipeline
    from ledgerlake.llm.tokens import Encoder
    from ledgerlake.llm.words import Chunks

    kept, encoder = 0, Encoder(tokenizer_path("word_bpe_49k.json"), corpus_pipeline.CACHED_CHUNKS)
    for at in range(0, 600_000, 30_000):
        encoder.encode([" ".join(f"{x:x}," for x in range(at, at + 30_000))])
        kept = max(kept, len(encoder.cache) + len(encoder.before))
    assert 400_000 < kept < 1_000_000
    chunks, most = Chunks(quality.describe, 8, quality.CACHED_CHUNKS), 0
    for at in range(0, 400_000, 20_000):
        codes, _ = chunks.rows([" ".join(f"{x:x}" for x in range(at, at + 20_000))])
        most = max(most, len(chunks))
        assert chunks.figures[codes[-1]].tolist() == list(map(float, quality.describe(f"{at + 19_999:x}")))
    assert most < 200_000 and chunks.figures.nbytes < 20_000_000
    hashes = near_dedup.WordHashes()
    assert len([hashes[f"{x}"] for x in range(400_000)]) == 400_000 and len(hashes) < 200_000
