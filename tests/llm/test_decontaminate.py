import hashlib
import random
import re

import pytest

from tessella.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(docs, bench):
    windows = {}
    for item, text in bench:
        w = words_of(text)
        for i in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(tuple(w[i : i + 13]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w = words_of(text)
        hit, items = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    items |= found
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(items), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def tables():
    r = random.Random(3)
    vocabulary = ["".join(r.choices("abcé7", k=r.randint(1, 3))) for _ in range(30)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    bench = [(i, text(r.choice([1, 2, 5, 13, 14, 40, 70]))) for i in range(25)]
    bench += [(30, ""), (31, None), (32, "... !"), (None, text(20)), (5, bench[5][1]), (40, bench[7][1].upper()), (33, "aaa aaa aaa aaa")]
    docs = []
    for i in range(60):
        parts = [text(r.randint(0, 40))]
        for _ in range(r.choice([0, 1, 2])):
            item = r.choice(bench)[1] or ""
            parts += [item if r.random() < 0.6 else " ".join(item.split()[: r.randint(1, 20)]), text(r.choice([0, 30, 900]))]
        docs.append((i, ", ".join(parts).title() if r.random() < 0.3 else "\n".join(parts)))
    docs += [(100, None), (101, ""), (102, "aaa " * 50), (3, docs[3][1]), (None, docs[4][1]), (103, text(30000) + " " + bench[5][1])]
    return docs, bench


def result(found):
    columns = found.select("doc_id", "n_words", decontaminate._n_hit().alias("n_hit"), "items", decontaminate._affected().alias("bad")).collect()
    return sorted(((x[0], x[1], x[2], len(x[3]), hashlib.sha256(",".join(x[3]).encode()).hexdigest(), x[4]) for x in columns), key=str)


@pytest.mark.parametrize("block_bytes", [8 << 20, 300])
def test_matches_brute_force(spark, block_bytes):
    docs, bench = tables()
    d = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, items int").repartition(3)
    b = spark.createDataFrame([(a, b, 1) for a, b in bench], "item_id long, text string, doc_id int")
    want = slow(docs, bench)
    assert result(decontaminate.hits(d, b, block_bytes=block_bytes)) == want
    kept = decontaminate.decontaminated(d, b, block_bytes=block_bytes)
    assert kept.columns == d.columns
    assert sorted((x["doc_id"] for x in kept.collect()), key=str) == sorted((x[0] for x in want if not x[-1]), key=str)


def test_empty_tables(spark):
    docs, bench = tables()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert decontaminate.hits(d.limit(0), b).collect() == []
    assert {x[2] for x in result(decontaminate.hits(d, b.limit(0)))} == {0}
    assert decontaminate.decontaminated(d, b.limit(0)).count() == len(docs)


def test_longest_match(spark):
    d = spark.createDataFrame([(1, "x a b c d e y"), (2, "a b c q")], "doc_id long, text string").coalesce(1)
    b = spark.createDataFrame([(1, "z a b c d w")], "item_id long, text string")
    assert {x["doc_id"]: x["longest"] for x in decontaminate.hits(d, b).collect()}[1] == 4
