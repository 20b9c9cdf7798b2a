import random
import re

from tessella.llm import license_scan as L


def words_of(text):
    return [w for w in re.split(r"[^a-z0-9\x80-\U0010FFFF]+", (text or "").lower()) if w]


def grams(w):
    return [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]


def slow(rows, templates):
    out = {}
    for doc, text in rows:
        here = grams(words_of(text))
        for name, wording in templates:
            n, want = len(words_of(wording)), set(grams(words_of(wording)))
            if not want:
                continue
            width, margin = (4 if n - 4 <= 4 else 16), (n if n - 4 > 16 else 0)
            for start in range(0, len(here), width):
                share = len(want & set(here[max(start - margin, 0) : start + 2 * width + margin])) / len(want)
                if share >= 0.8:
                    out[doc, name] = max(out.get((doc, name), 0), share)
    return out


def test_matches_brute_force(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdé", k=4))
    text = lambda n: " ".join(word() for _ in range(n))
    templates = [*L.TEMPLATES, ("long", text(90)), ("none", "too few words"), ("empty", None)]
    rows = []
    for i in range(120):
        parts = [text(r.choice([0, 3, 40, 200]))]
        for _ in range(r.choice([0, 1, 2])):
            w = (r.choice(templates)[1] or "").split()
            if w and r.random() < 0.4:
                w[r.randrange(len(w))] = word()
            parts += [" ".join(w).upper(), text(r.choice([0, 7, 60]))]
        rows.append((i, "\n".join(parts)))
    rows += [(500, None), (501, ""), (502, "one two"), (3, rows[3][1]), (None, "x"), (503, text(9000) + " " + L.TEMPLATES[1][1])]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, words int")
    frame = spark.createDataFrame(templates, "template_id string, text string")
    got = {(x["doc_id"], x["template_id"]): x["containment"] for x in L.scan(docs, frame).collect()}
    want = slow(rows, templates)
    assert got == want and len(want) > 30
    assert L.scan(docs.limit(0), frame).collect() == [] and L.scan(docs, frame.limit(0)).collect() == []
