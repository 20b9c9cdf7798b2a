import re
import random

import numpy as np
import pytest
import xxhash

from tessella.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    prints = [slow_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((doc, f"{prints[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=str)


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdeé", k=r.randint(1, 7)))
    rows = []
    for i in range(40):
        words = [word() for _ in range(r.choice([1, 2, 3, 30, 300]))]
        for _ in range(r.choice([1, 1, 4])):
            rows.append((len(rows), "\n ".join(words).title() if r.random() < 0.5 else "  ".join(words)))
            words[r.randrange(len(words))] = word()
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "a\x00b \x85c d"), (903, "a\x00b \x85c d"), (None, rows[3][1]), (None, "lone text of some words")]
    rows.append((950, " ".join(word() for _ in range(60000))))
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], "doc_id long, text string, fp string, a int, free int").repartition(5)
    got = simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted((tuple(x) for x in got), key=str) == slow_components(rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("group", [16, 4096])
def test_index_finds_every_link(spark, monkeypatch, group):
    """Dense balls of codes, so that groups have to be dealt again."""
    monkeypatch.setattr(simhash, "GROUP", group)
    r = np.random.default_rng(1)
    heads = r.integers(0, 2**63, 20, dtype=np.uint64)
    codes = {int(c) for c in heads}
    for c in heads:
        for _ in range(60):
            for b in r.integers(0, 64, r.integers(1, 6)):
                c = c ^ np.uint64(1 << int(b))
            codes.add(int(c))
    codes = sorted(codes)
    signed = [(int(np.uint64(c).astype(np.int64)),) for c in codes]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"))
    roots = {x["node"]: x["root"] for x in simhash.components(edges).collect()}
    parent = {c: c for (c,) in signed}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    array = np.array([c for (c,) in signed]).view(np.uint64)
    for i in range(len(array)):
        for j in np.flatnonzero(np.bitwise_count(array ^ array[i]) <= 3):
            a, b = root(signed[i][0]), root(signed[j][0])
            parent[max(a, b)] = min(a, b)
    assert {c: roots.get(c, c) for c in parent} == {c: root(c) for c in parent}
