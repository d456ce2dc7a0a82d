"""The prefix trie and ranked search against plain versions, with nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from paperloom.llm import ranking, tries

TURNS = "conv_id long, turn long, role string, text string, node string, depth string, pos string"


def conversations():
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["", None, "a", "é日", "b" * 50])) for c in range(40) for t in range(rng.randint(1, 9)) if c not in (5, 20)]
    rows += [(50, t, "user", "same") for t in range(300)] + [(57, t, "user", "same") for t in range(300)]  # deep
    rows += [(c, 0, "user", "hello") for c in range(60, 120)]  # copies
    rows += [(130, None, "user", "x"), (130, None, "user", "w"), (130, 0, "user", "y"), (130, 0, "assistant", "y"), (130, 0, "assistant", "y")]  # ties, repeated rows
    rows += [(None, 0, "user", "nobody"), (131, 0, "user", "z" * 300_000), (132, 1, "user", "own")]
    return [(*r, "n", "d", "p") for r in rows]


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(x)] for c, x in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(whole.items()):
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children = Counter(node[:-1] for node in members if node)
    leaves, saved = Counter(), Counter()
    for node, held in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(held) - 1) * len(node[-1][1].encode()) if node else 0
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return {(held[0], len(node), members[node[:-1]][0] if node else None, len(held), children[node], leaves[node], saved[node], digest(ends[node])) for node, held in members.items()}


@pytest.mark.parametrize("small", [4096, 40, 1])
def test_trie(spark, small):
    rows = conversations()
    found = tries.trie(spark.createDataFrame(rows, TURNS).repartition(5), small).collect()
    expected = plain_trie(rows)
    assert len(found) == len(expected) and set(map(tuple, found)) == expected


def test_trie_of_nothing(spark):
    assert tries.trie(spark.createDataFrame([], TURNS)).count() == 0
    assert tries.trie(spark.createDataFrame([(None, 1, "user", "a", "", "", "")], TURNS)).count() == 0


def test_prefix_keys_go_on_over_stretches(spark, monkeypatch):
    rows = [(c, t, "user", str(t) if t < 20 + c else "other") for c in (0, 5) for t in range(30)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    expected = {tuple(r) for r in tries.trie(frame).collect()}
    monkeypatch.setattr(tries, "STRETCH", 3)
    assert {tuple(r) for r in tries.trie(frame).collect()} == expected == plain_trie(rows)


def test_splitting_equals_sums_over_subtrees():
    rng = random.Random(9)
    import numpy as np

    for n in (1, 2, 3, 50, 400):
        for reach in (1, 3, n):  # from a chain to a bush
            parent = [-1] + [rng.randint(max(0, v - reach), v - 1) for v in range(1, n)]
            values = np.array([(rng.randint(0, 9), 1) for _ in range(n)], np.int64)
            expected = values.copy()
            for v in range(n - 1, 0, -1):
                expected[parent[v]] += expected[v]
            assert (tries.split(parent, [rng.randint(1, 5) for _ in range(n)], values) == expected).all()


WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, term string, rank string"
DOCS = "doc_id long, text string, docs string, score string, block string, item_id string"


def plain_search(docs, items, most=10):
    fold = str.maketrans(ranking.UPPER, ranking.LOWER)
    counted = [(i, Counter(WORD.findall((t or "").translate(fold)))) for i, t, *_ in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = defaultdict(set)
    for i, t, *_ in items:
        asked[i] |= set(WORD.findall((t or "").translate(fold)))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c, n in counted:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, i is not None, i or 0))
        out += [(item, k + 1, i if known else None, -s) for k, (s, known, i) in enumerate(sorted(scored)[:most])]
    return Counter(out)


def library():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["Éa", "éa", "x9", "K"]
    text = lambda n: " ".join(words[min(int(rng.expovariate(0.08)), 63)] for _ in range(n))
    docs = [(i, text(rng.randint(1, 60))) for i in range(150)]
    docs += [(200 + i, "the Same Copy w50") for i in range(30)]  # ties
    docs += [(300, None), (301, ""), (302, "... !"), (303, text(40_000)), (None, "w55 w56"), (7, docs[7][1]), (7, docs[7][1]), (304, "É-é_K"), (305, "w1W1w1 W1")]
    items = [(1, "w1 w50 copy"), (2, "w55 w56 w57"), (3, None), (4, ""), (5, "nothing here"), (6, "W3 w3 w4, É!"), (6, "w20"), (None, "w10 w11"), (8, docs[3][1]), (9, "K k")]
    return [(*d, "a", "b", "c", "d") for d in docs], [(*i, "t", "r") for i in items]


@pytest.mark.parametrize(("block", "bundle"), [(4096, 256), (7, 2), (1, 1)])
def test_ranked_search(spark, block, bundle):
    docs, items = library()
    found = ranking.search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), block=block, bundle=bundle).collect()
    assert Counter(map(tuple, found)) == plain_search(docs, items)


def test_ranked_search_of_nothing(spark):
    docs, items = library()
    some, none = spark.createDataFrame(docs, DOCS), spark.createDataFrame([], DOCS)
    asked = spark.createDataFrame(items, ITEMS)
    assert ranking.search(none, asked).count() == 0
    assert ranking.search(some, asked.limit(0)).count() == 0
    assert ranking.search(some.filter("doc_id in (300, 301, 302)"), asked).count() == 0
