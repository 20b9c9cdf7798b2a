import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa

from tessella.llm import line_dedup


def slow(rows):
    texts = [(i, d, (t or "").split("\n")) for i, (d, t) in enumerate(rows)]
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", x))
    holders = defaultdict(dict)
    for i, d, lines in texts:
        for x in lines:
            if len(key(x)) >= 40:
                holders[key(x)][i] = float("-inf") if d is None else d
    out = []
    for i, d, lines in texts:
        stay = [x for x in lines if not (len(h := holders.get(key(x), {})) >= 5 and h[i] != max(h.values()))]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "CHUNK_BYTES", 20_000)
    r = random.Random(2)
    pool = ["".join(r.choices("abcdé   ", k=n)) for n in (38, 39, 40, 41, 60, 200) for _ in range(8)]
    rows = []
    for i in range(120):
        lines = [r.choice(["", " \t", "\x0b"]) + r.choice(pool).upper() + r.choice(["", " ", "\r"]) if r.random() < 0.7 else "own line %d " % r.randrange(10**9) * 3 for _ in range(r.randint(1, 12))]
        rows.append((i, "\n".join(lines)))
    rows += [(500, None), (501, ""), (502, "\n"), (503, "x" * 300000 + "\n" + pool[-1]), (7, rows[7][1]), (None, rows[8][1]), (None, None), (-5, rows[9][1])]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, chunk int").repartition(4)
    got = line_dedup.marked(docs)
    assert got.columns == ["doc_id", "text", "chunk", "n_lines", "n_dropped", "kept"]
    assert sorted((tuple(x) for x in got.select("doc_id", "n_lines", "n_dropped", "kept").collect()), key=str) == slow(rows)
    assert line_dedup.marked(docs.limit(0)).collect() == []


def test_minimal_perfect_hash():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 1000, 50_000):
        keys = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        assert sorted(line_dedup.MinimalPerfectHash(keys).number(keys).tolist()) == list(range(len(keys)))
    index = line_dedup.LineIndex(keys, ~keys, keys, keys)
    other = r.integers(0, 2**63, 1000, dtype=np.uint64)
    assert not index.probe(other, ~other)[0].any() and (index.probe(keys, ~keys)[0] == keys).all()


def test_lines_that_share_half_a_hash(monkeypatch):
    """Are told apart by the other half: in a chunk, in a shard, and when the chunk drops its lines."""
    whole = line_dedup.xxhash.xxh3_128_digest
    monkeypatch.setattr(line_dedup.xxhash, "xxh3_128_digest", lambda x: bytes([len(x) % 2]) * 8 + whole(x)[8:])
    a, b, c = "a" * 50, "b" * 50, "c" * 51
    rows = [(i, "\n".join([a] * (i < 6) + [b] * (i < 3) + [c])) for i in range(8)]
    part = pa.record_batch([pa.array([d for d, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])
    keys, columns = line_dedup._keys(part, 40)
    assert len(keys) == 3 and len(set(keys.tolist())) == 2 and sorted(columns[1].tolist()) == [3, 6, 8]
    index = line_dedup.LineIndex.of(np.tile(keys, 2), *(np.tile(x, 2) for x in columns))
    held, last = index.probe(keys, columns[0])
    assert (held == 2 * columns[1]).all() and (last == columns[2]).all()
    often = columns[1] >= 5
    out = line_dedup._dropped(part, often, np.where(often, columns[2], 0), 40, ["x", "y", "z"])
    assert out.column(4).to_pylist() == [x[3] for x in sorted(slow(rows))]


def test_clashing_names_keep_theirs(spark):
    docs = spark.createDataFrame([(1, "a", 7, "k")], "doc_id long, text string, N_LINES int, kept string")
    got = line_dedup.marked(docs)
    assert got.columns == ["doc_id", "text", "N_LINES", "kept", "n_lines_1", "n_dropped", "kept_1"]
    assert tuple(got.select("N_LINES", "kept", "n_lines_1", "kept_1").first()) == (7, "k", 1, "a")
