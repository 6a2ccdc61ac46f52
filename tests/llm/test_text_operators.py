"""Classifiers, token counts, packing, URL rules, decontamination and HTML text."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from logloom.llm import decontamination, html_text, language_id, packing, quality, token_counts, url_rules
from logloom.llm.pretokens import PATTERN
from logloom.llm.shared import crc_mod

BPE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.01"
CLASHING = "doc_id long, text string, label string, score string, item int, hit string, offset int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, "z", 2) for i, t in rows], CLASHING)


LONG = " ".join(f"word{k % 977}" for k in range(30_000))
AWKWARD = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, None), (3, ""), (4, " \n "), (5, LONG),
           (6, "12 % !"), (7, "é\u00a0x  y\n\nz ")]


# quality

def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.learn(docs, labels, usable=lambda i: crc_mod(i, 4) != 2)
    found = {r.doc_id: r for r in quality.score_texts(docs, model).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    right = [found[r.doc_id].predicted == r.quality for r in held]
    assert len(held) > 60 and sum(right) / len(right) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values())


def test_quality_without_usable_labels_and_on_awkward_rows(spark):
    docs = frame(spark, AWKWARD)
    labels = spark.createDataFrame([(1, None, 7), (None, 1, 7), (99, 1, 7), (5, 1, 7)],
                                   "doc_id long, quality int, text int")
    model = quality.learn(docs, labels)
    scores = [r.score for r in quality.score_texts(docs, model).collect()]
    assert len(scores) == len(AWKWARD) and {round(s, 9) for s in scores} == {round(2 / 3, 9)}
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 0)], "doc_id long, quality int")
    rows = quality.score_texts(docs, quality.learn(docs, labels)).collect()
    assert all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 1}) == 1
    kept = quality.keep_good(docs, model, 0.5)
    assert kept.columns == docs.columns and kept.count() == len(AWKWARD)
    assert quality.score_texts(frame(spark, []), model).count() == 0


def test_features_are_sets_of_whole_texts():
    texts = ["a b a b", "", "Ünï, 12!", "x" * 10]
    together = quality.features(pa.array([t.encode() for t in texts]))
    for text, found in zip(texts, together):
        alone = quality.features(pa.array([b"pad", text.encode(), None]))[1]
        assert sorted(found) == sorted(alone) and len(set(found.tolist())) == len(found)
    assert len(together[1]) == 0


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(5)
    sets = [np.flatnonzero(rng.random(12) < 0.4).astype(np.int32) for _ in range(60)]
    labels = np.array([(3 in s) or (rng.random() < 0.2) for s in sets])
    ratios = np.zeros(quality.SPACE)
    ratios[:12] = rng.normal(1, 0.3, 12)
    w, b = quality.fit_hinge(sets, labels, ratios, 1.0, 500)
    rows = np.zeros((60, 13))
    for k, s in enumerate(sets):
        rows[k, s] = ratios[s] / (np.sqrt(np.square(ratios[s]).sum()) or 1)
    rows[:, 12] = 1
    sign, n = np.where(labels, 1, -1), len(labels)
    caps = np.where(labels, n / 2 / labels.sum(), n / 2 / (~labels).sum())

    def loss(v):
        return v @ v / 2 + (caps * np.maximum(0, 1 - sign * (rows @ v))).sum()

    best = np.append(w[:12], b)
    assert all(loss(best) <= loss(best + rng.normal(0, s, 13)) + 1e-2 for s in (0.01, 0.1, 0.5) for _ in range(200))


# language

def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.learn(docs, usable=lambda i: crc_mod(i, 5) != 0, steps=400)
    found = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = [found[r.doc_id].lang_pred == r.lang for r in held]
    assert len(held) > 150 and sum(right) / len(right) > 0.95
    rows = language_id.identify(frame(spark, AWKWARD), model).collect()
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert und == {2, 3, 4, 6} and all(0 <= r.score <= 1 for r in rows)
    assert len({(r.lang_pred, r.score) for r in rows if r.doc_id == 1}) == 1
    assert language_id.identify(frame(spark, []), model).count() == 0


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None), (None, "abc", "en")], "doc_id long, text string, lang string")
    model = language_id.learn(docs)
    assert {r.lang_pred for r in language_id.identify(docs, model).collect()} == {"und"}


def test_lookup_tables_are_the_convolution():
    model = language_id.train([b"abcdef ghi" * 30, b"zyx wvu" * 40], ["a", "b"], steps=3)
    cells, sizes = language_id.windows_of(b"abc zyx" * 50, language_id.WINDOW)
    got = model.probabilities(cells, sizes, model.tables())
    hidden = []
    for width, kernel, offset in zip(language_id.WIDTHS, model.filters, model.offsets):
        best = np.full((len(cells), language_id.FILTERS), -np.inf)
        for w in range(len(cells)):
            for at in range(max(sizes[w] - width + 1, 1)):
                value = sum(model.embedding[cells[w, at + k]] @ kernel[k] for k in range(width))
                best[w] = np.maximum(best[w], value)
        hidden.append(np.maximum(best + offset, 0))
    want = language_id.softmax(np.concatenate(hidden, axis=1) @ model.dense + model.bias)
    assert np.allclose(got, want, atol=1e-4)


# token counts

def best_cut(token, costs):
    best = [(0, 0)] + [None] * len(token)
    for end in range(1, len(token) + 1):
        best[end] = min((best[a][0] + costs[token[a:end]], best[a][1] + 1)
                        for a in range(end) if token[a:end] in costs)
    return best[-1][1]


def test_token_counts_are_best_cuts(spark):
    costs = token_counts.zipf_costs(token_counts.rank_file(RANKS))
    rows = AWKWARD + [(k + 100, r.text) for k, r in
                      enumerate(spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect())]
    found = token_counts.count_tokens(frame(spark, rows), RANKS).collect()
    want = Counter((i, sum(best_cut(t.encode(), costs) for t in PATTERN.findall(s or ""))) for i, s in rows)
    assert Counter((r.doc_id, r.n_tokens) for r in found) == want
    assert token_counts.count_tokens(frame(spark, []), RANKS).count() == 0


def test_a_cleared_trie_counts_the_same():
    trie = token_counts.ScoredTrie({b"a": 5, b"ab": 7, b"b": 5, b"abab": 30})
    assert trie.count(b"abab") == 2 and trie.count(b"aab") == 2
    nodes = len(trie.score)
    assert trie.count(b"aba") == 2 and len(trie.score) == nodes  # its prefix was there
    trie.clear()
    assert trie.count(b"abab") == 2 and trie.count(b"a?") == 2


# packing

def test_cached_ids_are_the_tokenizers():
    plain = Tokenizer.from_file(BPE)
    plain.encode_special_tokens = True
    own = packing.TokenIds(BPE)
    rnd = random.Random(3)
    alphabet = [" ", " ", "  ", "\n", "\t", "a", "Be", "é", "1", "²", "'s", "'", "!", "_", "\u3000", "中", "😀", "\x1c",
                "\x85", "don't", "<|endoftext|>", "\u0308"]
    for _ in range(3000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(14)))
        assert own.encode(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("options", [{}, {"capacity": 64, "open_bins": 3, "look_ahead": 5, "level_tokens": 200}])
def test_packing_places_every_token_once(spark, options):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150).collect()
    rows = AWKWARD + [(k + 100, r.text) for k, r in enumerate(docs)]
    capacity = options.get("capacity", 2048)
    pieces = packing.pack(frame(spark, rows), BPE, with_ids=True, **options)
    found = pieces.collect()
    plain = Tokenizer.from_file(BPE)
    plain.encode_special_tokens = True
    want = Counter()
    for doc_id, text in rows:
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for n, (start, length) in enumerate(packing.cut(len(ids), capacity)):
            want[doc_id, n, start, length, zlib.crc32(ids[start:start + length].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    by_sequence = defaultdict(list)
    for r in found:
        by_sequence[r.sequence_id].append((r.offset, r.length, r.ids))
    for parts in by_sequence.values():
        at = 0
        for offset, length, ids in sorted(parts):
            assert offset == at and len(ids) == 4 * length
            at += length
        assert at <= capacity
    assert len(by_sequence) <= 1.15 * sum(r.length for r in found) / capacity + 2
    whole = {r.sequence_id: r for r in packing.sequences(spark.createDataFrame(found, pieces.schema)).collect()}
    assert all(bytes(whole[k].ids) == b"".join(p[2] for p in sorted(v)) for k, v in by_sequence.items())


def test_packer_takes_the_tightest_and_closes_the_fullest():
    packer = packing.Packer(10, 2)
    assert packer.add(6, "a") is None and packer.add(7, "b") is None
    assert packer.add(3, "c") == ["b", "c"]          # fits both, tightest is full now
    assert packer.add(5, "d") is None
    assert packer.add(9, "e") == ["a"]               # neither holds it: the fullest closes
    assert sorted(map(tuple, packer.rest())) == [("d",), ("e",)]
    assert packing.cut(25, 10) == [(0, 5), (5, 10), (15, 10)] and packing.cut(20, 10) == [(0, 10), (10, 10)]


def test_packing_nothing(spark):
    assert packing.pack(frame(spark, []), BPE).count() == 0


# URL rules

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/")]
URLS = ["http://a.example.net/en/x", "https://EXAMPLE.net/en", "http://net/", "http://xnet/", "http://net", "x", None,
        "http://notexample.com/de/", "http://b.example.com/de/?q=/fr/", "ftp://w.org/fr/#a", "http://w.org/FR/", "",
        "http://a.net?x://b.org/fr/", "http://org/fr/", "http://a.net/?", "http://example.net:80/en/", "://net/a\nb"]


def judge_by_hand(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
    path = rest[end:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))] if path[:1] == "/" else ""
    fits = [(len(h + p), h + p, a) for a, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else "allow"


@pytest.mark.parametrize("rules", [RULES, [], RULES + [("block", "", "/"), ("allow", "a+b.org", "/(x)/")]])
def test_url_rules(spark, rules):
    urls = URLS + ["http://q.a+b.org/(x)/", "http://q.aab.org/x/"]
    pages = spark.createDataFrame([(k, u, "r", "t") for k, u in enumerate(urls + urls)] + [(None, urls[0], "r", "t")],
                                  "page_id long, url string, rule string, token string")
    want = Counter((k % len(urls) if k is not None else 0, *judge_by_hand(u, rules))
                   for k, u in [*enumerate(urls + urls), (None, urls[0])])
    table = url_rules.rule_table(spark, rules)
    for broadcast_rules in (1000, 0):
        found = url_rules.judge_urls(pages, table, broadcast_rules=broadcast_rules).collect()
        got = Counter((r.page_id % len(urls) if r.page_id is not None else 0, r.host, r.path, r.rule, r.verdict)
                      for r in found)
        assert got == want
    assert url_rules.judge_urls(pages.limit(0), table).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    targets = spark.createDataFrame([("a.common.net", "/x"), ("b.common.net", "/x"), ("rare.net", "/")],
                                    "host string, path string")
    rules = url_rules.rule_table(spark, [("block", "rare.net", "/x"), ("block", "common.net", "/unseen/")])
    index = {r.rule: r.token for r in url_rules.rule_index(targets, rules, True).collect()}
    assert index == {"rare.net/x": "rare", "common.net/unseen/": "unseen"}


# decontamination

def tiles_by_hand(item, doc, least):
    used_item, used_doc, out = [0] * len(item), [0] * len(doc), []
    while True:
        best = (0, 0, 0)
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while (a + n < len(item) and b + n < len(doc) and item[a + n] == doc[b + n]
                       and not used_item[a + n] and not used_doc[b + n]):
                    n += 1
                best = max(best, (n, -a, -b))
        n, a, b = best[0], -best[1], -best[2]
        if n < max(least, 1):
            return sorted(out)
        out.append(n)
        for k in range(n):
            used_item[a + k] = used_doc[b + k] = 1


def test_tiling_by_brute_force():
    for seed in range(200):
        rnd = random.Random(seed)
        item = [rnd.randrange(4) for _ in range(rnd.randrange(1, 14))]
        doc = [rnd.randrange(4) for _ in range(rnd.randrange(40))]
        least = rnd.randrange(1, 4)
        assert sorted(n for *_, n in decontamination.tile(item, doc, least)) == tiles_by_hand(item, doc, least)


def test_decontamination(spark):
    rnd = random.Random(8)
    items = [(k, " ".join(f"i{rnd.randrange(300)}" for _ in range(rnd.choice([2, 4, 30, 50])))) for k in range(30)]
    items += [(30, None), (31, ""), (None, "one two three four five six seven"), (32, "Tiny Item")]
    words = items[3][1].split()
    half = len(words) // 2
    rows = AWKWARD + [
        (50, "x y " + items[0][1].upper() + " z"), (51, " ".join(words[half:] + ["gap"] + words[:half])),
        (52, "One, two; THREE-four five six seven."), (53, "a tiny... item b"), (53, "a tiny... item b"),
        (54, " ".join(words[:max(len(words) // 5, 1)])), (55, LONG + " " + items[1][1])]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    want = Counter()
    for doc_id, text in rows:
        have = decontamination.clean(text).split()
        for item_id, item in items:
            own = decontamination.clean(item).split()
            if own and len(have) < 2000:
                n = sum(tiles_by_hand(own, have, min(5, len(own))))
                if n >= 0.5 * len(own):
                    want[doc_id, item_id, round(n / len(own), 9)] += 1
    docs = frame(spark, rows)
    for block_words in (2_000_000, 200):
        found = decontamination.contaminations(docs, bench, block_words=block_words).collect()
        got = Counter((r.doc_id, r.item_id, round(r.coverage, 9)) for r in found)
        assert Counter({k: v for k, v in got.items() if k[0] != 55 and k[0] != 5}) == want
        assert (55, 1) in {(r.doc_id, r.item_id) for r in found}
        clean = decontamination.keep_clean(docs, bench, block_words=block_words)
        assert clean.columns == docs.columns
        flagged = {k[0] for k in got}
        assert Counter(r.doc_id for r in clean.collect()) == Counter(i for i, _ in rows if i not in flagged)
    assert {50, 51, 52, 53, 55} <= flagged and 54 not in flagged
    assert decontamination.contaminations(docs, bench.limit(0)).count() == 0
    assert decontamination.contaminations(docs.limit(0), bench).count() == 0
    assert decontamination.keep_clean(docs, bench.limit(0)).count() == len(rows)


# HTML

@pytest.mark.parametrize("html, text", [
    (None, None), ("", ""), ("plain  text\n here", "plain text here"),
    ("<p>One<p>Two <b>b</b>old", "One\n\nTwo bold"),
    ("a<div>b</div>c<br>d", "a\nb\nc\nd"),
    ("<ul><li>a<li>b<ol start=3><li>c</ol></ul>", "- a\n- b\n  3. c"),
    ("<table><tr><th>Name<th>N<tr><td>long name<td>1</table>", "Name      | N\nlong name | 1"),
    ("<table><tr><td rowspan=2>A<td>1<tr><td>2</table>", "A | 1\n  | 2"),
    ("<table><tr><td><ul><li>x<li>y</ul><td>z</table>", "- x | z\n- y |"),
    ("<pre>\n a\n  b</pre>", " a\n  b"),
    ("x<p style='display: none'>no<p hidden>no<script>a<b</script><p>y", "x\n\ny"),
    ("<div style='visibility:hidden'>no<i style='visibility:visible'>yes</i></div>", "yes"),
    ("<head><title>t</title></head><body>b", "b"), ("<title>t</title>b", "b"),
    ("<details><summary>s</summary>hid</details><details open>seen</details>", "s\nseen"),
    ("</p></div>a &lt;b&gt; &amp; c", "a <b> & c"), ("1 < 2 <!-- no --> 3<!-- open", "1 < 2 3"),
    ("a<img alt='x'>b <a href='q>r'>c</a>", "ab c"), ("a<b", "a"),
    ("a<blockquote>q</blockquote>b", "a\n\n  q\n\nb"),
])
def test_html_layout(html, text):
    assert html_text.extract(html) == text


def test_html_deep_and_long_pages():
    deep = html_text.extract("<div>" * 5000 + "deep" + "<table><tr><td>" * 300 + "x")
    assert "deep" in deep and "x" in deep
    assert html_text.extract("<p>a" * 50_000).count("a") == 50_000
    for odd in ("<a ", '<a href="', "<", "<!--", "a<b "):
        html_text.extract(odd * 50_000)


def test_html_pages(spark):
    rows = [(1, "<p>a", "x"), (1, "<p>a", "x"), (None, "<p>b", "x"), (2, None, "x")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    found = Counter((r.page_id, r.text) for r in html_text.extract_pages(pages).collect())
    assert found == Counter({(1, "a"): 2, (None, "b"): 1, (2, None): 1})
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_html_keeps_every_visible_word(spark):
    """On the given pages the visible words, in order, are those outside head, script and tags."""
    import re
    from html import unescape

    for row in spark.read.parquet(f"{SF}/pages.parquet").limit(60).collect():
        body = re.sub(r"(?s)<head>.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->", " ", row.html)
        if re.search(r"(?i)hidden|display|<noscript|<template|<li|<table", body):
            body = re.sub(r"(?s)<noscript.*?</noscript>|<template.*?</template>", " ", body)
            if re.search(r"(?i)hidden|display", body):
                continue
        want = Counter(unescape(re.sub(r"<[^>]*>", " ", body)).split())
        got = Counter(html_text.extract(row.html).split())
        for mark in ("-", "|"):
            got.pop(mark, None), want.pop(mark, None)
        assert got == want


@pytest.mark.parametrize("html,text", [
    ("Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> end", "Let x=2 end"),
    ("<p>See <svg><title>t</title><desc>d</desc><defs><text>no</text></defs><text>Label</text></svg> here", "See Label here"),
    ("<table><tr><td>" + "w" * 300 + "<td>1<tr><td>short<td>2</table>", "w" * 300 + " | 1\nshort | 2"),
    ("<table><tr><td>a<td>b<td>c<tr><td>d</table>", "a | b | c\nd |"),
])
def test_formulas_drawings_and_wide_tables(html, text):
    assert html_text.extract(html) == text


def test_text_of_a_page_is_a_small_multiple_of_it():
    wide = "<table><tr>" + "<td>x" * 3000 + "</tr>" + "<tr><td>y</tr>" * 3000 + "</table>"
    tall = "<table><tr><td>" + "word " * 9000 + "</td><td>z</td></tr>" + "<tr><td>a<td>b</tr>" * 3000 + "</table>"
    late = "<table><tr>" + "<td>x" * 90 + "</tr>" + "<tr><td colspan=89><td>y</tr>" * 3000 + "</table>"
    steps = "<table>" + "".join(f"<tr><td>{'v' * 99}<td>k" if k == 0 else "<tr><td><td>k" for k in range(3000)) + "</table>"
    for page in (wide, tall, late, steps):
        found = html_text.extract(page)
        assert len(found) <= 12 * len(page) and found.count("\n") >= 2999
    assert html_text.extract(wide).count("x") == 3000 and html_text.extract(tall).count("word") == 9000


def test_a_rare_language_is_learned(spark):
    rows = [(i, f"the quick fox {i} runs over the hill and the dog {i}", "en") for i in range(600)]
    rows += [(1000 + i, f"größer übung {i} straße schön für käse", "de") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs, rows_a_language=20, steps=60)
    assert sorted(model.languages) == ["de", "en"]
