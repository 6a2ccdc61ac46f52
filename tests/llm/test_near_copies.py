"""The pipeline's near dedup against the Jaccard similarity of all pairs."""

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from logloom.llm import components, near_copies
from logloom.llm.simhash import table_masks

SF = "/root/testdata/sf0.01"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k:k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()


def groups_of_all_pairs(rows):
    """Smallest id of each row's group, and the pairs of different sets that link."""
    sets = {i: frozenset(shingles(t)) for i, t in rows}
    group, pairs, seen = {i: i for i in sets}, [], {}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                pairs.append((a, b))
    for a, b in pairs:
        old, new = max(group[a], group[b]), min(group[a], group[b])
        if old != new:
            group = {i: new if g == old else g for i, g in group.items()}
    for a, b in pairs:
        if sets[a] != sets[b]:
            seen[sets[a], sets[b]] = (a, b)
    return group, list(seen.values())


def made_up():
    rnd, rows = random.Random(5), []
    passage = [f"common{k}" for k in range(40)]
    for base in range(60):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(60, 200))]
        if base % 3 == 0:
            words = passage + words
        rows.append(" ".join(words))
        for _ in range(rnd.randrange(5)):
            copy = list(words)
            for _ in range(rnd.randrange(1, 4)):
                copy[rnd.randrange(len(copy))] = f"new{rnd.randrange(10**6)}"
            rows.append(" ".join(copy))
    for n in range(40):  # one large group of near copies
        rows.append(" ".join(passage[:30] + [f"tail{k}" for k in range(60)] + [f"own{n}"]))
    for n in range(40):  # a passage in unlike texts
        rows.append(" ".join(passage + [f"other{n}x{k}" for k in range(40)]))
    rows += ["one two", "One  TWO", "", None, " ", "one three"]
    rnd.shuffle(rows)
    return list(enumerate(rows))


def found_groups(rows, nodes):
    return {r.doc_id: r.head for r in rows.join(nodes, "node").collect()}


@pytest.mark.parametrize("chunk", [16_384, 5])
def test_groups_of_made_up_texts(spark, chunk):
    rows = made_up()
    want, pairs = groups_of_all_pairs(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = found_groups(*near_copies.groups(docs, chunk=chunk))
    linked = sum(got[a] == got[b] for a, b in pairs)
    assert len(pairs) > 100 and linked >= 0.95 * len(pairs)
    assert all(want[a] == want[b] for a in got for b in [got[a]])  # nothing is joined that all pairs keep apart
    assert sorted(r.doc_id for r in near_copies.keep_one(docs, chunk=chunk).collect()) == sorted(set(got.values()))


def test_recall_on_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, pairs = groups_of_all_pairs(rows)
    got = found_groups(*near_copies.groups(docs))
    assert len(pairs) >= 5 and sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)
    assert all(want[a] == want[got[a]] for a in got)
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_tables_find_all_pairs_within_the_radius():
    rng = np.random.default_rng(3)
    for radius in (3, 7, 10):
        for rows in (100, 10 ** 5, 10 ** 8):
            masks = table_masks(near_copies.block_count(rows, radius), radius)
            for _ in range(50):
                flipped = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
                assert any(flipped & m == 0 for m in masks)


def test_tables_of_open_texts_find_all_pairs_within_the_radius():
    rng = np.random.default_rng(13)
    for rows in (100, 10 ** 5, 10 ** 8):
        masks = table_masks(near_copies.block_count(rows, 10, key_bits=1), 10)
        for _ in range(50):
            flipped = sum(1 << int(b) for b in rng.choice(64, 10, replace=False))
            assert any(flipped & m == 0 for m in masks)


def test_nearest_earlier_rows():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    values = np.array([base[k % 3] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)))
                       for k in range(400)], np.uint64)
    sizes, counts = np.array([1, 70, 200, 129]), rng.integers(80, 120, 400)
    got = set(zip(*(x.tolist() for x in near_copies.nearest(values, np.arange(400), sizes, 6, Fraction(4, 5), counts))))
    want, start = set(), 0
    for size in sizes.tolist():
        for j in range(start, start + size):
            near = [((int(values[i]) ^ int(values[j])).bit_count(), i) for i in range(start, j)
                    if 5 * min(counts[i], counts[j]) >= 4 * max(counts[i], counts[j])]
            near = [(d, i) for d, i in near if d <= 6]
            if near:
                least = min(d for d, _ in near)
                at = [i for d, i in near if d == least]
                want |= {(at[0], j), (at[-1], j)}
        start += size
    assert got == want and len(want) > 300


def test_vote_against_counting():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 3, 50, 1001):
        own = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
        want = sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in own) > n)
        assert near_copies.vote(own) == want


def test_hubs_are_salted(spark):
    sets = spark.createDataFrame([(k, np.arange(10, dtype="<u8").tobytes()) for k in range(30)], "id long, hashes binary")
    pairs = spark.createDataFrame([(0, k) for k in range(1, 30)], "a long, b long")
    assert near_copies.linked(pairs, sets, Fraction(4, 5), salted=4).count() == 29


def test_ids_null_and_repeated_and_nothing(spark):
    rows = [(None, "a b c"), (1, "a b c"), (1, "a b c"), (None, "d"), (None, "D"), (2, None), (3, "")]
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, node int, sha string")
    found = near_copies.keep_one(docs)
    assert found.columns == docs.columns
    assert sorted(((r.doc_id, (r.text or "").lower()) for r in found.collect()), key=str) == [(1, "a b c"), (2, ""), (None, "d")]
    assert near_copies.keep_one(docs.limit(0)).count() == 0


def test_joins_do_not_broadcast(spark):
    """Whatever Spark may broadcast, tables of the texts stay out of the driver."""
    sets = spark.createDataFrame([(k, np.arange(10, dtype="<u8").tobytes()) for k in range(9)], "id long, hashes binary")
    pairs = spark.createDataFrame([(0, k) for k in range(1, 9)], "a long, b long")
    docs = spark.createDataFrame([(1, "a b c", "x" * 64)], "doc_id long, text string, sha string")
    frames = [near_copies.linked(pairs, sets, Fraction(4, 5)), components._large_star(pairs), components._small_star(pairs),
              near_copies.keep_one(docs)]
    for frame in frames:
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def cloud(rnd, name, texts):
    """Texts of one base, many of them about as far from each other as a link allows."""
    words = [f"{name}{k}" for k in range(90)]
    for _ in range(texts):
        copy = list(words)
        for _ in range(rnd.randrange(1, 3)):
            copy[rnd.randrange(len(copy))] = f"new{rnd.randrange(10**9)}"
        yield " ".join(copy)


@pytest.mark.parametrize("chunk, dense", [(16_384, 4), (7, 1)])
def test_every_pair_within_the_radius_counts(spark, chunk, dense):
    """Groups are those of all pairs, also of dense keys whose nearest texts do not link."""
    rnd = random.Random(11)
    texts = [t for k in range(4) for t in cloud(rnd, f"base{k}x", 70)]
    sets = list(near_copies.shingle_sets(pa.array([t.encode() for t in texts]), 5))
    prints = np.array([near_copies.votes(s, 2) for s in sets]).view(np.uint64)
    group, n_links = list(range(len(texts))), 0
    for a in range(len(texts)):
        within = (np.bitwise_count(prints[a] ^ prints[a + 1:]) <= 10).any(axis=1)
        for b in (a + 1 + np.flatnonzero(within)).tolist():
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                n_links += 1
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group] if old != new else group
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = found_groups(*near_copies.groups(docs, chunk=chunk, dense=dense))
    assert n_links > 300 and 8 < len(set(group)) < len(texts)
    assert [got[k] for k in range(len(texts))] == group


def test_open_texts_are_dealt_to_few_tables(spark, monkeypatch):
    """The rows that a dense cloud makes when its texts are compared again: 22 a text, not 132."""
    dealt, items = [], near_copies._items
    monkeypatch.setattr(near_copies, "_items", lambda rows, keys, chunk, *more: (
        dealt.append((rows.count(), bool(more))), items(rows, keys, chunk, *more))[1])
    texts = list(cloud(random.Random(12), "dense", 150))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near_copies.keep_one(docs).collect()
    again = [rows for rows, more in dealt if more]
    assert len(again) == 1 and 100 < again[0] <= 22 * len(texts)


def test_parities_never_rule_out_a_link():
    rng = np.random.default_rng(8)
    for n in (0, 1, 40, 3000):
        one = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        two = np.concatenate([one[:n - n // 10], rng.integers(0, 1 << 63, n // 12, dtype=np.uint64)])
        apart = len(np.setxor1d(one, two))
        assert np.bitwise_count((near_copies.parity(one) ^ near_copies.parity(two)).view(np.uint64)).sum() <= apart
