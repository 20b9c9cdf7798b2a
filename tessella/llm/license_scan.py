"""License scans, in DataFrame functions only.

Texts are cut into overlapping windows of five-word shingles: short ones of 8 that begin at every 4th, for templates
of up to 4 shingles, and long ones of 32 that begin at every 16th. A longer template is looked for by pieces of
16: where its containment is 0.8, that of some piece is too. So any run that a short template, or a piece, can fill
lies in some window as a whole. A window has `BANDS` MinHash values, each a band of its own; it retrieves what shares
one of them. The Jaccard similarity of a window and what it holds is an eighth at least (one shingle in a short window)
or 0.11 (four of five in a long one), so 64 bands miss it with a probability below 0.0006; half a window's length in full,
below 0.00001. What is retrieved is verified by the exact share of the template's distinct shingles in the window (for a longer
template, in the window and a template's length to both sides).

Minima are plain columns in whole-stage code: a row has the hashes of a stride of shingles, meets each band once,
and each least() of four hashes serves all windows that contain these.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import clean_documents, table

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 64
SHORT, LONG = 4, 16  # a window has two of these strides
STRIDE = 32  # shingles of a row
BLOCK = 64  # templates of a pass

#: Wordings of public licence notices.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once, also where body's inner functions use it for every element."""
    return F.transform(F.array(value), body)[0]



def words_of(text: Column) -> Column:
    """Runs of a-z, 0-9 and all beyond ASCII, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9\x{80}-\x{10FFFF}]+"), lambda w: w != "")


def shingles_of(words: Column) -> Column:
    """Shingles as strings, in order; none of fewer than five words."""
    return F.when(F.size(words) >= SHINGLE, F.transform(F.sequence(F.lit(1), F.size(words) - SHINGLE + 1), lambda i: F.array_join(F.slice(words, i, SHINGLE), " "))).otherwise(F.array().cast("array<string>"))


def hashes_of(words: Column) -> Column:
    """A hash of each shingle."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    each = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*[h[i + j] for j in range(SHINGLE)]))
    return F.when(F.size(words) >= SHINGLE, let(hashed, each)).otherwise(F.array().cast("array<bigint>"))


def _minima(hashes: Column) -> Column:
    """The MinHash values of a few shingle hashes."""
    return F.transform(F.array(*[F.lit(j) for j in range(BANDS)]), lambda j: F.array_min(F.transform(hashes, lambda x: F.xxhash64(x, j))))


def scan(docs: DataFrame, templates: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, template_id, containment (the best window's), n_windows (that reach the bound), first_word (of the first of these).

    One row for each doc_id and template found in it; repeated rows of a doc_id count once,
    and all rows with a null doc_id are one. Texts and templates of
    fewer than five words have no shingles and are not found; null texts neither. Templates of equal id are one each.
    Columns but doc_id, template_id and text are not read.
    """
    docs = clean_documents(docs, "doc_id", "text")
    words = words_of(F.col("text"))
    whole = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil((F.size(words) - SHINGLE + 1) / LONG).cast("int") - 1, F.lit(0))), lambda i: _minima(F.slice(hashes_of(words), i * LONG + 1, LONG)))
    named = templates.select(F.col("template_id").cast("string").alias("template_id"), F.array_distinct(shingles_of(words)).alias("shingles"), F.size(words).alias("n"), whole.alias("pieces"))
    rows = named.where("template_id is not null and size(shingles) > 0").orderBy("template_id", F.xxhash64("shingles")).toLocalIterator()
    parts, block = [], []
    for row in rows:
        block.append(row)
        if len(block) == BLOCK:
            parts, block = [*parts, _scan_block(docs, block, containment)], []
    if block or not parts:
        parts.append(_scan_block(docs, block, containment))
    every = parts[0]
    for other in parts[1:]:
        every = every.unionByName(other)
    # Windows that reach the bound: a text and a template meet in few.
    return every.groupBy("doc_id", "template_id").agg(F.max("containment").alias("containment"), F.count_distinct("first_word").alias("n_windows"), F.min("first_word").alias("first_word"))


def _longs(values: list[int]) -> Column:
    return F.expr("array(" + ", ".join("bigint('-9223372036854775808')" if v == -(2**63) else f"{v}L" for v in values) + ")")


def _strings(shingles: list[str]) -> Column:
    """Shingles hold neither quotes nor backslashes."""
    return F.expr("array(" + ", ".join(f"'{s}'" for s in shingles) + ")")


def _scan_block(docs: DataFrame, block: list, containment: float) -> DataFrame:
    """One scan for a block of templates, which are literals of the plan."""
    if not block:
        return docs.select("doc_id", F.lit("").alias("template_id"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("first_word")).where("false")
    short = lambda r: r["n"] - SHINGLE + 1 <= SHORT
    values = {w: sorted({v for r in block if short(r) == (w == SHORT) for piece in r["pieces"] for v in piece}) for w in (SHORT, LONG)}
    words = docs.where("text is not null").select("doc_id", words_of(F.col("text")).alias("words"))
    hashed = words.select("doc_id", "words", hashes_of(F.col("words")).alias("hashes"))
    count = F.ceil(F.size("hashes") / STRIDE).cast("int")
    rows = hashed.select("doc_id", "words", "hashes", F.explode(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))).alias("row"))
    span = STRIDE + LONG + SHORT
    cells = rows.select("doc_id", "words", "row", *[F.get("hashes", F.col("row") * STRIDE + i).alias(f"h{i}") for i in range(span)])
    banded = cells.select("*", F.explode(F.array(*[F.lit(j) for j in range(BANDS)])).alias("band"))
    one = lambda i: F.when(F.col(f"h{i}").isNotNull(), F.xxhash64(f"h{i}", "band"))
    least = banded.select("doc_id", "words", "row", *[F.least(*[one(i) for i in range(k, k + SHORT)]).alias(f"m{k // SHORT}") for k in range(0, span, SHORT)])
    per_long = LONG // SHORT
    windows = [(SHORT, k * SHORT, F.least(f"m{k}", f"m{k + 1}")) for k in range(STRIDE // SHORT)]
    windows += [(LONG, k * LONG, F.least(*[f"m{i}" for i in range(k * per_long, (k + 2) * per_long) if i < span // SHORT])) for k in range(STRIDE // LONG)]
    least = least.select("doc_id", "words", "row", *[value.alias(f"w{i}") for i, (_, _, value) in enumerate(windows)])
    tests = [(width, at, F.col(f"w{i}"), F.expr(f"w{i} IN ({', '.join(f'{v}L' for v in values[width])})")) for i, (width, at, _) in enumerate(windows) if values[width]]
    any_hit = tests[0][3]
    for t in tests[1:]:
        any_hit = any_hit | t[3]
    named = F.array(*[F.when(hit, F.struct(F.lit(width).alias("width"), (F.col("row") * STRIDE + at).alias("at"), value.alias("value"))) for width, at, value, hit in tests])
    near = least.select("doc_id", "words", F.explode(F.when(any_hit, named)).alias("w")).where("w is not null")
    every = F.array(*[
        F.struct(F.lit(r["template_id"]).alias("template_id"), F.lit(SHORT if short(r) else LONG).alias("width"), _longs(sorted({v for piece in r["pieces"] for v in piece})).alias("minima"),
                 _strings(r["shingles"]).alias("shingles"), F.lit(r["n"] if r["n"] - SHINGLE + 1 > LONG else 0).alias("margin"))
        for r in block
    ])
    retrieved = near.select("doc_id", "words", "w", F.explode(every).alias("t")).where((F.col("t.width") == F.col("w.width")) & F.array_contains("t.minima", F.col("w.value")))
    begin = F.greatest(F.col("w.at") - F.col("t.margin"), F.lit(0))
    window = shingles_of(F.slice("words", begin + 1, F.col("w.at") + 2 * F.col("w.width") + F.col("t.margin") - begin + SHINGLE - 1))
    share = F.size(F.array_intersect(window, F.col("t.shingles"))) / F.size("t.shingles")
    return retrieved.select("doc_id", "t.template_id", share.alias("containment"), F.col("w.at").cast("long").alias("first_word")).where(F.col("containment") >= containment)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = spark.createDataFrame(TEMPLATES, "template_id string, text string")
    return scan(table(spark, sf_dir, "documents"), templates).select("doc_id", "template_id", F.round("containment", 6).alias("containment"))


def oracle_sql() -> str:
    """The exact best containment over all windows, without MinHash."""
    rows = ", ".join("('{}', '{}')".format(*t) for t in TEMPLATES)
    return rf"""
WITH templates AS (SELECT * FROM (VALUES {rows}) AS t(template_id, text)
), all_texts AS (
  SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, text FROM documents UNION ALL SELECT 't', template_id, text FROM templates
), words AS (
  SELECT kind, id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+'), lambda w: w <> '') AS w FROM all_texts
), shingles AS (
  SELECT kind, id, len(w) AS n, unnest(range(0, len(w) - 4)) AS p,
         unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) AS s
  FROM words WHERE len(w) >= 5
), wanted AS (
  SELECT template_id, s, count(*) OVER (PARTITION BY template_id) AS total,
         CASE WHEN n - 4 <= 4 THEN 4 ELSE 16 END AS width, CASE WHEN n - 4 > 16 THEN n ELSE 0 END AS margin
  FROM (SELECT DISTINCT id AS template_id, s, n FROM shingles WHERE kind = 't')
), placed AS (
  SELECT CAST(d.id AS BIGINT) AS doc_id, t.template_id, d.s, t.total,
         unnest(range(greatest(d.p - 2 * t.width - t.margin, 0) // t.width, (d.p + t.margin) // t.width + 1)) * t.width AS start, d.p, t.width, t.margin
  FROM shingles d JOIN wanted t USING (s) WHERE d.kind = 'd'
), shares AS (
  SELECT doc_id, template_id, start, round(count(DISTINCT s) / CAST(any_value(total) AS DOUBLE), 6) AS containment
  FROM placed WHERE p >= start - margin AND p < start + 2 * width + margin GROUP BY doc_id, template_id, start
)
SELECT doc_id, template_id, max(containment) AS containment FROM shares WHERE containment >= 0.8 GROUP BY doc_id, template_id
"""
