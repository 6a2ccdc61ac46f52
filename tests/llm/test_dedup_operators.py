"""Exact, substring and near dedup against brute force, with the awkward rows of each."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from logloom.llm import exact_dedup, simhash, substring_dedup
from logloom.llm.components import components
from logloom.llm.fm_index import FMIndex, repeated_windows

#: Extra columns share names that the operators use inside.
CLASHING = "doc_id long, text string, label string, fp string, norm int, row int, kept string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2, "z") for i, t in rows], CLASHING)


LONG = " ".join(f"w{k}" for k in range(30_000))
AWKWARD = [(1, "a b c"), (1, "a b c"), (2, "a\tbc"), (None, "a b c "), (3, None), (4, ""), (5, " \n "), (6, LONG),
           (7, LONG + "\n"), (8, "d"), (9, "é\u00a0x"), (10, "éx")]


def blankless(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def exact_by_hand(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[blankless(text)].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = Counter()
    for doc_id, text in rows:
        norm = blankless(text)
        best = min(groups[norm])
        out[doc_id, best[3], len(groups[norm]), hashlib.sha256(norm.encode()).hexdigest()] += 1
    return out, len(groups)


@pytest.mark.parametrize("options", [
    {}, {"salts": 3},
    {"digest": lambda norm: F.char_length(norm).cast("long")},
    {"identity": lambda norm: F.substring(norm, 1, 1)},
])
def test_exact_dedup_compares_whole_texts(spark, options):
    rows = AWKWARD + [(20, "abx"), (21, "aby"), (22, "a b y"), (23, "aby")]
    found = exact_dedup.exact_verdicts(frame(spark, rows), **options).collect()
    want, n_groups = exact_by_hand(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == want
    assert sum(r.kept for r in found) == n_groups
    assert all(r.doc_id == r.keep_id for r in found if r.kept)

    kept = exact_dedup.keep_one(frame(spark, rows), **options)
    assert kept.columns == frame(spark, []).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in found if r.kept)


def windows_by_hand(rows, window):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k:k + window]) for _, w in split for k in range(len(w) - window + 1))
    out = Counter()
    for doc_id, words in split:
        gone = {k + j for k in range(len(words) - window + 1) if seen[tuple(words[k:k + window])] > 1
                for j in range(window)}
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out[doc_id, len(words), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


def passages(n_docs, seed):
    rnd = random.Random(seed)
    pool = [[f"p{rnd.randrange(40)}" for _ in range(rnd.randrange(5, 60))] for _ in range(6)]
    rows = []
    for k in range(n_docs):
        words = []
        for _ in range(rnd.randrange(0, 5)):
            words += rnd.choice(pool) if rnd.random() < 0.6 else [f"u{rnd.randrange(10 ** 6)}" for _ in range(20)]
        if k % 9 == 0:
            words += ["and"] * rnd.randrange(30, 90)
        rows.append((k, rnd.choice([" ", "\n", " \t"]).join(words)))
    return rows


@pytest.mark.parametrize("options", [{}, {"chunk": 2, "shard_words": 500}])
def test_substring_dedup_is_the_brute_force_result(spark, options):
    rows = passages(70, 1) + AWKWARD + [(7, None), (500, LONG[:4000]), (500, LONG[100:5000])]
    found = substring_dedup.remove_repeats(frame(spark, rows), window=35, **options).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == windows_by_hand(rows, 35)
    for r in found:
        assert sum(s["end"] - s["first"] for s in r.spans) == r.n_removed
        assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256


def test_backward_search_counts_windows():
    rng = np.random.default_rng(0)
    for _ in range(60):
        window, n_symbols = int(rng.integers(2, 7)), int(rng.integers(2, 5))
        parts = [rng.integers(1, n_symbols + 1, int(rng.integers(1, 34))) for _ in range(int(rng.integers(1, 14)))]
        text = np.concatenate([np.append(p, 0) for p in parts])
        lengths = np.array([len(p) for p in parts])
        starts = np.cumsum(lengths + 1) - lengths - 1
        runs = repeated_windows(FMIndex(text, n_symbols + 1, 64), text, starts, lengths, window)
        got = {(int(who), k) for who, a, b in zip(*runs) for k in range(a, b)}
        seen = Counter(tuple(p[k:k + window]) for p in parts for k in range(len(p) - window + 1))
        assert got == {(i, k) for i, p in enumerate(parts) for k in range(len(p) - window + 1)
                       if seen[tuple(p[k:k + window])] > 1}


def prints_by_hand(rows):
    out = []
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[k:k + 3]) for k in range(max(len(words) - 2, 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        out.append((doc_id, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))))
    return out


def groups_by_hand(prints, radius=3):
    distinct = sorted({p for _, p in prints})
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for k, a in enumerate(distinct):
        for b in distinct[k + 1:]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for doc_id, p in prints:
        if doc_id is not None:
            least[find(p)] = min(least.get(find(p), doc_id), doc_id)
    return Counter((i, f"{p:016x}", least.get(find(p))) for i, p in prints), len({find(p) for p in distinct})


def near_copies(seed):
    rnd = random.Random(seed)
    rows = []
    for k in range(12):
        words = [f"t{rnd.randrange(500)}" for _ in range(400)]
        for _ in range(rnd.randrange(1, 7)):
            copy = list(words)
            copy[rnd.randrange(400)] = "changed"
            rows.append((len(rows) + 1000, " ".join(copy)))
    return rows


@pytest.mark.parametrize("chunk", [16_384, 2])
def test_simhash_groups_are_the_brute_force_result(spark, chunk):
    rows = near_copies(2) + AWKWARD + [(None, "only null ids"), (None, "only NULL ids")]
    want, n_groups = groups_by_hand(prints_by_hand(rows))
    found = simhash.near_duplicates(frame(spark, rows), chunk=chunk).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == want
    kept = simhash.keep_one(frame(spark, rows), chunk=chunk)
    assert kept.columns == frame(spark, []).columns and kept.count() == n_groups
    heads = {c for _, _, c in want if c is not None}
    assert {r.doc_id for r in kept.collect()} - {None} == heads


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 8])
def test_bit_slices_measure_distances(radius):
    rng = np.random.default_rng(radius)
    sizes, parts = [], []
    for n in (1, 2, 63, 64, 65, 200):
        base = rng.integers(0, 2 ** 63, 3, dtype=np.uint64)
        values = base[rng.integers(0, 3, n)]
        for _ in range(radius + 2):
            values = values ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        parts.append(np.unique(values))
        sizes.append(len(parts[-1]))
    found = simhash.forest(np.concatenate(parts), np.array(sizes), radius)
    root = {}

    def find(p):
        while root.setdefault(p, p) != p:
            p = root[p]
        return p

    for a, b in zip(*(c.to_numpy().view(np.uint64).tolist() for c in found.columns)):
        root[find(a)] = find(b)
    for part in parts:
        values = part.tolist()
        want, _ = groups_by_hand([(k, v) for k, v in enumerate(values)], radius)
        label = {v: c for _, h, c in want for v in [int(h, 16)]}
        for a in values:
            for b in values:
                assert (find(a) == find(b)) == (label[a] == label[b])


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(5, 5), (129, 200)]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    labels = {r.node: r.label for r in found}
    assert labels == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 130)}, 200: 100}


def test_empty_tables(spark):
    none = frame(spark, [])
    assert exact_dedup.exact_verdicts(none).count() == 0 and exact_dedup.keep_one(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0
