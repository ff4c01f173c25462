"""License scan, byte-level BPE, language model and near-duplicate join against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from walksieve.llm import bpe, components, jaccard_join, licenses, lm
from walksieve.llm import wordhash as H
from walksieve.llm.common import fold

from .fixtures import docs, empty, prose, rows, words


def test_patience_anchors_and_gaps():
    t = "a b c d e f".split()
    assert licenses.patience(t, t) == [(i, i) for i in range(6)]
    assert licenses.patience("x a x b x c x".split(), "a b c".split()) == [(1, 0), (3, 1), (5, 2)]
    # a word that is not unique in the whole is unique in a gap
    assert licenses.patience("k u v k m k".split(), "k u k m".split()) == [(0, 0), (1, 1), (3, 2), (4, 3)]
    assert licenses.patience([], t) == [] and licenses.patience("q r".split(), t) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=25), st.lists(st.sampled_from("abcdefgh"), max_size=25))
def test_patience_is_a_common_subsequence(a, b):
    pairs = licenses.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x < u and y < v for (x, y), (u, v) in zip(pairs, pairs[1:]))


def test_license_scan(spark):
    r = random.Random(3)
    mit, apache = licenses.TEMPLATES["mit"], licenses.TEMPLATES["apache-2.0-notice"]
    edited = mit.replace("without restriction", "with no restriction").replace("persons", "people")
    data = [(1, prose(r, 50) + "\n" + apache + "\n" + prose(r, 3000), "en", "s", 0), (2, apache + "\n" + prose(r, 400) + "\n" + apache, "en", "s", 0),
            (3, prose(r, 30) + edited + prose(r, 30), "en", "s", 0), (4, prose(r, 200) + " license mit", "en", "s", 0), (5, None, None, None, None), (6, "", None, None, None)]
    got = {x.doc_id: x for x in licenses.scan(docs(spark, data + data[:1])).collect()}
    assert [n.license for n in got[2].notices] == ["apache-2.0-notice"] * 2
    assert got[1].notices[0].coverage == 1.0 and data[0][1][got[1].notices[0].start:got[1].notices[0].end] == apache[:-1]
    assert [n.license for n in got[3].notices] == ["mit"] and 0.95 < got[3].notices[0].coverage < 1
    assert not got[4].notices and not got[5].notices and not got[6].notices
    short = {x.doc_id: x for x in licenses.summary(licenses.scan(docs(spark, data))).collect()}
    assert (short[2].n_notices, short[2].licenses, short[4].license, short[4].licenses) == (2, "apache-2.0-notice", None, "")
    assert licenses.summary(licenses.scan(empty(spark))).count() == 0
    assert licenses.scan(docs(spark)).count() == len(rows())


def _found(text, coverage=0.8, templates=None):
    return licenses.scan_text(text, licenses.prepare(templates or licenses.public_templates(), coverage), coverage)


@pytest.mark.parametrize("text, name", [
    ("Released under the BSD License.", "bsd-notice"), ("Licensed under CC BY 4.0", "cc-by-4.0-notice"), ("Licensed under CC BY-SA 4.0.", "cc-by-sa-4.0-notice"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0-notice"), ("This work is licensed under the GNU General Public License, version 2.", "gpl-2.0-notice"),
    ("licensed under the GNU Lesser General Public License, version 2.1", "lgpl-2.1-notice"), ("Released under the MIT License.", "mit-notice"),
    ("Licensed under the Quux License.", None), ("Licensed under the Apache License, Version 7.3.", None)])
def test_short_notices_name_their_license(text, name):
    r = random.Random(1)
    assert [h[0] for h in _found(f"{prose(r, 30)} {text} {prose(r, 30)}")] == [name] * (name is not None)


def test_public_license_texts():
    r = random.Random(2)
    for name in licenses.public_templates():
        text = licenses.public_templates()[name]
        assert [(h[0], h[1]) for h in _found(f"{prose(r, 40)}\n{text}\n{prose(r, 40)}")] == [(name.split("#")[0], 1.0)], name
    assert {"agpl-3.0", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "cc0-1.0", "gpl-3.0", "lgpl-2.1", "unlicense"} <= licenses.public_templates().keys()


def test_repeated_and_interrupted_notices_at_every_offset():
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    inside = "Licensed under the Apache p q r s License, Version 2.0."
    for before in range(40):
        lead = "k " * before
        for n in (1, 2, 3, 4, 7):
            assert [h[0] for h in _found(lead + " ".join([mit] * n))] == ["mit-notice"] * n
        assert [h[0] for h in _found(lead + "x x x " + apache * 3 + " and " + mit * 3)] == ["apache-2.0-notice"] * 3 + ["mit-notice"] * 3
        assert [(h[0], h[4]) for h in _found(lead + inside + " z")] == [("apache-2.0-notice", 8)]
        assert [h[4] for h in _found(lead + "Released or under the MIT License. " + mit)] == [5, 5]
    x = licenses.TEMPLATES["mit"]
    assert [h[0] for h in _found("a b " + f"{x}\n" * 5)] == ["mit"] * 5
    assert sorted(h[0] for h in _found(x.replace("THE SOFTWARE IS PROVIDED", f"{apache} THE SOFTWARE IS PROVIDED"))) == ["apache-2.0-notice", "mit"]


def test_license_places_beside_letters_that_change_length():
    for odd in ("İ", "İ" * 9 + " ", "Kİ ſ"):
        text = f"{odd} İstanbul Released under the MIT License. {odd}"
        (hit,) = _found(text)
        assert text[hit[2]:hit[3]] == "Released under the MIT License"


def test_bpe_round_trip(spark):
    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    enc = bpe.encoding(ranks, public_tokenizers.PATTERN)
    assert isinstance(enc, tiktoken.Encoding)

    def plain(text):  # every match of the pattern alone
        return [i for m in regex.findall(public_tokenizers.PATTERN, text) for i in enc.encode_ordinary(m)]

    want = Counter()
    for i, t, *_ in rows():
        if t is None or "\x1c" not in t:
            ids = np.array(plain(t or ""), "<u4").tobytes()
            want[i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    got = bpe.round_trip(docs(spark), ranks, public_tokenizers.PATTERN, chunk=50).collect()
    assert Counter(tuple(x) for x in got if x.doc_id is None or "\x1c" not in (rows()[x.doc_id // 5][1] or "")) == want
    packed = bpe.encode(docs(spark), ranks, public_tokenizers.PATTERN)
    back = bpe.decode(packed, ranks, public_tokenizers.PATTERN).collect()
    assert Counter((x.doc_id, bytes(x.bytes).decode()) for x in back) == Counter((i, t or "") for i, t, *_ in rows())
    assert bpe.round_trip(empty(spark), ranks, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab1 \n\t'.s  \x1c\x85é😀", max_size=80), st.integers(1, 12))
def test_bpe_boundaries_change_nothing(text, chunk):
    enc = bpe.encoding(bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    assert "".join(bpe.pieces(text, chunk)) == text
    assert bpe.encode_text(enc, text, chunk).tolist() == enc.encode_ordinary(text)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aAbB \t\n\x0b\x0c\ré😀", max_size=20), max_size=6))
def test_word_hashes(texts):
    h, n = H.words([t.encode() for t in texts], chunk=16)
    flat = [w for t in texts for w in words(t)]
    assert n.tolist() == [len(words(t)) for t in texts] and len(h) == len(flat)
    assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))


def _plain_model(data):
    part = {0: 0, 1: 2, 2: 1, 3: 0, 4: 0}
    of = lambda i: part[zlib.crc32(str(i).encode() if i is not None else b"") % 5]
    tokens = [(i, of(i), [None, *words(t), None]) for i, t, *_ in data]

    def counts(parts):
        c1, c2 = Counter(), Counter()
        for _, p, w in tokens:
            if p in parts:
                c1.update(w[1:])
                c2.update(zip(w, w[1:]))
        return c1, c2, sum(c1.values()), len(c1)

    def em(pairs):
        w = 0.5
        for _ in range(200):
            w = (sum(w * r / (w * r + 1 - w) for r in pairs) + 0.5) / (len(pairs) + 1)
        return w

    c1, c2, n, v = counts({0})
    held = [(a, b) for _, p, w in tokens if p == 1 for a, b in zip(w, w[1:])]
    base = em([c1[b] / n * (v + 1) for _, b in held])
    p1 = lambda w, c1, n, v: base * c1[w] / n + (1 - base) / (v + 1)
    by = defaultdict(list)
    for a, b in held:
        if c1[a]:
            by[int(math.log2(c1[a] + 1))].append(c2[a, b] / c1[a] / p1(b, c1, n, v))
    weights, last = {}, 0.0
    for k in range(1, 64):
        last = em(by[k]) if by[k] else last
        weights[k] = min(last, 1 - 1e-6)
    c1, c2, n, v = counts({0, 1})
    out = []
    for i, p, w in tokens:
        total = 0.0
        for a, b in zip(w, w[1:]):
            k = weights.get(int(math.log2(c1[a] + 1)), 0.0)
            total += math.log10((k * c2[a, b] / c1[a] if c1[a] else 0) + (1 - k) * p1(b, c1, n, v))
        base_score = sum(math.log10((c1[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w[1:])
        out.append((-1 if i is None else i, p == 2, len(w) - 1, sum(c1[x] > 0 for x in w[1:]), n, base_score, total))
    return sorted(out)


def _parts():
    at = fold("doc_id", 5)
    return F.when(at == 1, lm.SCORE_ONLY).when(at == 2, lm.FIT).otherwise(lm.TRAIN)


def test_language_model(spark):
    got = sorted((-1 if x.doc_id is None else x.doc_id, x.part == lm.SCORE_ONLY, x.n_tokens, x.n_known, x.train_tokens, x.base_score, x.score)
                 for x in lm.score(docs(spark), part=_parts(), block_bytes=20_000).collect())
    want = _plain_model(rows())
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] == pytest.approx(w[6], rel=5e-3, abs=1e-3)


def test_language_model_without_training(spark):
    assert lm.score(empty(spark), part=_parts()).count() == 0
    got = lm.score(docs(spark, [(1, "a b", None, None, 0)]), part=F.lit(lm.SCORE_ONLY)).first()
    assert (got.n_tokens, got.n_known, got.train_tokens, got.base_score, got.score < 0) == (3, 0, 0, 0.0, True)


def plain_components(data, percent, k=3):
    sets = []
    for _, t, *_ in data:
        w = words(t)
        sets.append(frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    label = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    low = {}
    for i, c in enumerate(label):
        if data[i][0] is not None:
            low[c] = min(low.get(c, data[i][0]), data[i][0])
    return Counter((data[i][0], len(sets[i]), low.get(c)) for i, c in enumerate(label))


def test_jaccard_join(spark):
    got = Counter((x.doc_id, x.n_shingles, x.component_id) for x in jaccard_join.join(docs(spark)).collect())
    assert got == plain_components(rows(), 90)
    assert jaccard_join.join(empty(spark)).count() == 0


def test_jaccard_join_beyond_the_leader(spark):
    """A drifting chain and a large group: members out of the leader's reach still link, in tiles of a few sets."""
    r = random.Random(9)
    w, data = prose(r, 150, 10_000).split(" "), []
    for i in range(60):
        w = list(w)
        w[(7 * i) % 150] = f"n{i}"
        data.append((i, " ".join(w), "en", "s", 0))
    data += [(100 + i, prose(r, 150, 10_000), "en", "s", 0) for i in range(10)]
    rows_ = jaccard_join.profile(docs(spark, data), key="doc_id", text="text", k=3, percent=90)
    found = components.components(jaccard_join.links(rows_, percent=90, tile_sets=8), "a", "b").collect()
    sig = {x.sig: x.doc_id for x in rows_.select("sig", "doc_id").collect()}
    groups = defaultdict(set)
    for x in found:
        groups[x.component].add(sig[x.node])
    want = defaultdict(set)
    for i, _, c in plain_components(data, 90):
        want[c].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), max_size=25), min_size=1, max_size=9), st.sampled_from([50, 80, 90, 100]))
def test_tile_products(sets, percent):
    items = [np.array(sorted(s), np.int64) for s in sets]
    forest = jaccard_join.tile_links(items, percent, columns=4)
    linked = lambda i, j: bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    assert all(linked(i, j) for i, j in forest)

    def classes(pairs):
        label = list(range(len(sets)))
        for i, j in pairs:
            label = [label[j] if x == label[i] else x for x in label]
        return {frozenset(k for k, y in enumerate(label) if y == x) for x in label}

    assert classes(forest) == classes([(i, j) for i in range(len(sets)) for j in range(i) if linked(i, j)])


def test_components_of_paths_and_stars(spark):
    r = random.Random(4)
    names = r.sample(range(1000), 120)
    edges = [(names[i], names[i + 1]) for i in range(59)] + [(names[60], x) for x in names[61:]] + [(5000, 5000), (None, 3)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "lo long, hi long"), "lo", "hi").collect()}
    assert got == {n: min(names[:60]) for n in names[:60]} | {n: min(names[60:]) for n in names[60:]}
