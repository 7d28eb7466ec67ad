"""Vector codes, fill-in-middle and line frequency against brute force, with every odd case."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import codes, infill, line_frequency

# ---- vector codes --------------------------------------------------------------------------------------


def coded(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Brute force in Python's integers over (id, vector, label) of one width."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], None
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    size, more = divmod(len(first[0][1]), parts)
    at = [i * size + min(i, more) for i in range(parts + 1)]
    cut = lambda v: [v[a:b] for a, b in zip(at, at[1:])]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]
    best = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        held = collections.defaultdict(list)
        for _, v, _ in kept:
            for p, x in enumerate(cut(v)):
                held[p, best(x, books[p])[1]].append(x)
        for (p, k), xs in held.items():
            books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    out = []
    for i, v, label in kept:
        found = [best(x, books[p]) for p, x in enumerate(cut(v))]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    by = collections.Counter()
    for _, label, _, d in out:
        by[label] += d
    name = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted((repr(i), code, d, by[label], name) for i, label, code, d in out), name


def compressed(spark, rows, kind="vec_id long, embedding array<double>, label int", **options):
    # columns of the caller that clash with those used inside
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], f"{kind}, code string, v int, no_label string").repartition(3)
    return sorted((repr(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in codes.compress(df, **options).collect())


def clustered(n, width, seed, step=None):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    x = centres[rng.integers(12, size=n)] + 0.02 * rng.normal(size=(n, width))
    return np.round(x / step) * step if step else x


def test_codes_against_brute_force(spark):
    x = clustered(200, 16, 1)
    rows = [(i * 3 % 200, v.tolist(), None if i % 7 == 0 else i % 4) for i, v in enumerate(x)]
    rows += [(1000, None, 1), (1001, [None, *[0.0] * 15], 1), (1002, [math.nan, *[0.0] * 15], 1), (1003, [math.inf, *[0.0] * 15], None), (5, x[0].tolist(), 2), (5, x[0].tolist(), 2), (None, x[1].tolist(), None)]
    assert compressed(spark, rows) == coded(rows)[0]


def test_ties_go_to_the_smaller_entry(spark):
    # a coarse grid: many parts lie as near to two entries, and entries coincide
    rows = [(i, v.tolist(), 0) for i, v in enumerate(clustered(150, 16, 2, step=0.5))] + [(200 + i, [0.5] * 16, 1) for i in range(60)]
    assert compressed(spark, rows) == coded(rows)[0]


def test_widths_few_vectors_and_large_numbers(spark):
    assert compressed(spark, []) == []
    few = [(3, [0.25, -0.25, 1.0], 1), (1, [0.5, 0.5, 0.5], None)]
    assert compressed(spark, few) == coded(few)[0]
    large = [(i, [1e5 * (i % 5), -3e4 * i, 0.1, 7.0], i % 2) for i in range(40)]
    assert compressed(spark, large) == coded(large)[0]
    both = compressed(spark, few + [(i + 10, [float(i), 0.0], 1) for i in range(20)])
    narrow = coded([(i + 10, [float(i), 0.0], 1) for i in range(20)])[0]
    assert {(i, c, e, name) for i, c, e, _, name in both} == {(i, c, e, name) for i, c, e, _, name in [*coded(few)[0], *narrow]}
    assert compressed(spark, [(0, [], 1)]) == [("0", "00" * 8, 0, 0, hashlib.sha256(b"").hexdigest())]
    huge = compressed(spark, [(0, [1e300], 1), (1, [-1e300], 1)], entries=1)
    assert [r[2] for r in huge][0] <= codes.LONG_MAX and len(huge) == 2


@pytest.mark.parametrize("spread", [0.0, 0.02, 1.0])
def test_tree_finds_the_nearest_and_rules_out_subtrees(spread):
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, size=(16, 8))
    points = np.concatenate([c + (spread * rng.normal(size=(16, 8)) * 500).astype(np.int64) for c in centres])
    x = centres[rng.integers(16, size=4000)] + rng.integers(-60, 60, size=(4000, 8))
    index, best, n = codes.nearest(codes.Gnat(points, np.arange(len(points))), x)
    d = ((x[:, None] - points[None]) ** 2).sum(axis=2)
    assert (best == d.min(axis=1)).all() and (index == d.argmin(axis=1)).all()
    assert n < (0.35 if spread < 1 else 1.0) * d.size
    exact = codes.nearest(codes.Gnat(points.astype(object), np.arange(len(points))), x[:50].astype(object))
    assert (exact[0] == index[:50]).all() and (exact[1] == best[:50]).all()


def test_tree_keeps_ties_under_rounding():
    # distances beyond 2**53 that differ by one, and equal ones
    big = 1 << 23
    points = np.asarray([[big, 0], [-big, 0], [0, big], [0, -big], [big, 1], [big, 0], [1 - big, 0], [0, 1 - big]])
    x = np.asarray([[0, 0], [1, 0], [0, 1], [-1, -1], [big, 0], [-big, 0], [5, 5]])
    index, best, _ = codes.nearest(codes.Gnat(points, np.arange(len(points))), x)
    d = ((x[:, None] - points[None]) ** 2).sum(axis=2)
    assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


# ---- fill in the middle --------------------------------------------------------------------------------

LONG = "Grüße, 世界! 🙂 plain words follow here. " * 6000
TEXTS = [(0, "Hello world"), (1, None), (2, ""), (3, "x"), (4, "naïve 日本語 🙂 é́"), (5, LONG), (6, "a" * 200_000), (7, "holds <P> a mark"), (8, "and <S>"), (9, "<M>"), (10, "almost < P> <S <M"), (None, "no id"), (12, "twice"), (12, "twice"), (-5, "日" * 70_000), (14, "a日" * 50_000)]
TEXTS += [(100 + i, "The quick brown fox — jumps. " * (i % 9)) for i in range(150)]


def told(key, text):
    t = text or ""
    s = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(s[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h[2] % 100 >= 90:
        return key, len(t), "plain", None, None, t
    if h[3] % 100 < 20:
        return key, len(t), "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return key, len(t), "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def test_infill_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, "c", 1, "d") for i, t in TEXTS], "doc_id long, text string, cut string, n int, bytes string").repartition(3)
    out = infill.fill_in_middle(df)
    got = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", infill.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert collections.Counter(tuple(r)[:6] for r in got) == collections.Counter(told(i, t) for i, t in TEXTS)
    assert collections.Counter((r.doc_id, r.back) for r in got) == collections.Counter((i, t or "") for i, t in TEXTS)
    assert {"plain", "psm", "spm"} == {r.form for r in got}
    assert infill.fill_in_middle(df.limit(0)).collect() == []
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_each_container_selects_every_offset():
    rng = np.random.default_rng(5)
    kinds = {}
    for flags in (np.ones(5000, dtype=bool), rng.random(65536) < 0.5, rng.random(65536) < 0.01, np.arange(65536) % 3 == 0, np.repeat(rng.random(64) < 0.5, 1024), np.arange(130) == 129):
        n, held = infill.container(flags)
        kinds[type(held).__name__] = True
        assert n == flags.sum() and [held.select(k) for k in range(n)] == np.flatnonzero(flags).tolist()
    assert len(kinds) == 3
    for text in (LONG, "a日" * 50_000, "🙂" * 40_000, "", "x"):
        begins, data = infill.BoundarySet(text.encode()), text.encode()
        starts = [i for i, b in enumerate(data) if b & 0xC0 != 0x80] + [len(data)]
        assert len(begins) == len(text) and [begins.select(k) for k in range(0, len(text) + 1, 7)] == starts[::7]


# ---- line frequency ------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def judged(rows, most_docs, most_share, least_left=0.5):
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    norm = lambda line: " ".join(WORD.findall(lower(line)))
    docs, held = collections.defaultdict(set), collections.defaultdict(set)
    for _, t, host in rows:
        docs[host].add(t or "")
        for line in (t or "").split("\n"):
            held[host, norm(line)].add(t or "")
    out = collections.Counter()
    for i, t, host in rows:
        t = t or ""
        words, lines = WORD.findall(t), t.split("\n")
        windows = collections.defaultdict(list)
        for at in range(len(words) - 4):
            windows[tuple(words[at : at + 5])].append(at)
        covered = {at + k for places in windows.values() if len(places) > 1 for at in places for k in range(5)}
        full = [x for x in lines if WORD.search(x)]
        bad = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        gone = [k for k, x in enumerate(lines) if norm(x) and len(held[host, norm(x)]) > most_docs and len(held[host, norm(x)]) > most_share * len(docs[host])]
        left = len(words) - sum(len(WORD.findall(lines[k])) for k in gone)
        out[i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(covered), bad, tuple(gone), left, not bad and left >= least_left * len(words)] += 1
    return out


def pages():
    menu, foot = "Home | About | Contact us today", "All rights\treserved ©  Example  "
    own = lambda i: "\n".join(" ".join(f"w{i}x{j}y{k}" for k in range(8)) for j in range(3))
    rows = [(i, f"{menu}\n{own(i)}\n{foot.upper() if i % 2 else foot}", "a" if i % 3 else "b") for i in range(60)]
    rows += [(100 + i, f"{menu}\nonly this little line\n{foot} and more words here for all {i}", "a") for i in range(5)]
    rows += [(150 + i, f"{menu}\n{foot}\nlast {i}", "a") for i in range(3)]
    rows += [(200 + i, f"{own(7000)}\n", "a") for i in range(40)]  # copies count once
    rows += [(300, None, "a"), (301, "", None), (302, " \n\n\t", "b"), (303, own(1), None), (304, own(2) + "\n" + own(2), None), (None, own(3), "b"), (306, "a b c d e " * 30_000, "c"), (306, own(5), "c"), (306, own(5), "c"), (307, "x y z   # * <> 1 2 3 4 5 6\r\nx y", "c"), (308, "one two three four five six one two three four five six seven eight nine ten eleven twelve", "c")]
    return rows


@pytest.mark.parametrize("few_lines", [line_frequency.FEW_LINES, 0])
def test_line_verdicts_against_brute_force(spark, few_lines):
    rows = pages()
    df = spark.createDataFrame([(*r, "h", 1, "k") for r in rows], "doc_id long, text string, source string, host string, row int, kept string").repartition(4)
    got = line_frequency.line_verdicts(df, most_docs=4, most_share=0.1, few_lines=few_lines).collect()
    assert collections.Counter((*tuple(r)[:7], tuple(r.removed), r.words_left, r.kept) for r in got) == judged(rows, 4, 0.1)
    assert line_frequency.line_verdicts(df.limit(0)).collect() == []


def test_frequent_lines_leave_the_texts(spark):
    rows = pages()
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], "doc_id long, text string, source string, host string, row int").repartition(4)
    out = line_frequency.without_frequent_lines(df, most_docs=4, most_share=0.1)
    assert out.columns == df.columns
    verdicts = judged(rows, 4, 0.1)
    gone = {(k[0], k[1]): k[7] for k in verdicts if k[9]}
    want = collections.Counter()
    for i, t, host in rows:
        key = i, len(WORD.findall(t or ""))
        if key in gone:
            want[i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[key]), host] += 1
    assert collections.Counter((r.doc_id, r.text, r.source) for r in out.collect()) == want
    assert any(k[7] and not k[9] and not k[6] for k in verdicts)  # some are depleted


def test_repeated_windows():
    assert line_frequency.repeated_words([]) == 0
    assert line_frequency.repeated_words(b"a b c d e a b c d e".split()) == 10
    assert line_frequency.repeated_words(b"a a a a a a".split()) == 6
    assert line_frequency.repeated_words(b"a b c d e f a b c d x".split()) == 0
