"""Benchmark decontamination by winnowing, in DataFrame operations only.

Words are runs of ASCII letters, digits and all non-ASCII characters, A-Z lower-cased. Each text keeps the
smallest hash of K words in every run of WINDOW - K + 1 consecutive ones, so two texts that share WINDOW
words in a row share a fingerprint. Fingerprints of documents and benchmark items are joined; documents
with a match are re-read and extended to the exact windows, compared as text. Items shorter than a window
count as one window of their own length and are matched at every position.

Edge cases: null or empty text has no words and is never hit; a null item_id's words are matched but the id
is not listed; equal item_ids count once; repeated document rows each get their row; an empty benchmark
leaves every document clean; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, gathered, saved, wrapped

WINDOW = 10
K = 5
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(_WORDS), F.lit(0))


def _hashes(words: str, k: int) -> Column:
    """The hash of each run of k words."""
    return F.expr(f"CASE WHEN size({words}) >= {k} THEN transform(sequence(0, size({words}) - {k}), i -> xxhash64({', '.join(f'{words}[i + {j}]' for j in range(k))})) ELSE array() END")


def _winnowed(hashes: str, size: int) -> Column:
    return F.expr(f"CASE WHEN size({hashes}) >= {size} THEN array_distinct(transform(sequence(1, size({hashes}) - {size - 1}), i -> array_min(slice({hashes}, i, {size})))) ELSE array() END")


def _grams(words: str, n: int) -> Column:
    return F.expr(f"CASE WHEN size({words}) >= {n} THEN transform(sequence(0, size({words}) - {n}), i -> named_struct('pos', i, 'len', {n}, 'gram', array_join(slice({words}, i + 1, {n}), ' '))) ELSE array() END")


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document row, and the hit items' ids."""
    return _report(documents, benchmark, window, k).drop("dk")


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """The documents without a hit, columns unchanged."""
    dirty = _hits(documents.select("doc_id", "text"), benchmark, window, k)[1].select(F.col("doc_id").alias("hit_id"), F.col("dk").alias("hit_dk")).distinct()
    dirty = saved(dirty)
    return wrapped(documents).join(dirty, F.col("id_").eqNullSafe(F.col("hit_id")) & (F.col("dk_") == F.col("hit_dk")), "left_anti").select("row_.*")


def _hits(documents: DataFrame, benchmark: DataFrame, window: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Every row's word count, and the occurrences (doc_id, dk, pos, len, item_id) of benchmark windows."""
    items = saved(benchmark.select("item_id", words_of(F.col("text")).alias("w")).where("size(w) > 0").withColumn("n", F.least(F.size("w"), F.lit(window))))
    short = sorted(r.n for r in items.where(f"n < {window}").select("n").distinct().collect())  # fewer than WINDOW values
    prints = items.withColumn("h", _hashes("w", k)).select(F.explode(_winnowed("h", window - k + 1)).alias("f"))
    for n in short:
        prints = prints.unionByName(items.where(f"n = {n}").select(F.explode(_hashes("w", n)).alias("f")))
    most = items.agg(F.coalesce(F.sum(F.size("w")), F.lit(0))).first()[0]
    prints = gathered(prints.distinct(), most)
    windows = items.where(f"n = {window}").select("item_id", F.explode(_grams("w", window)).alias("g"))
    for n in short:
        windows = windows.unionByName(items.where(f"n = {n}").select("item_id", F.explode(_grams("w", n)).alias("g")))
    windows = gathered(windows.select("item_id", F.col("g.len").alias("len"), F.col("g.gram").alias("gram")).distinct(), most)

    keyed = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("dk"), "text")
    own = keyed.select("doc_id", "dk", words_of(F.col("text")).alias("w")).withColumn("h", _hashes("w", k))
    marks = _winnowed("h", window - k + 1)
    if short:
        marks = F.array_distinct(F.concat(marks, *[_hashes("w", n) for n in short]))
    sketch = saved(own.select("doc_id", "dk", F.size("w").cast("long").alias("n_words"), marks.alias("f")))

    # The planner broadcasts the saved fingerprints if their files are small, and shuffles both sides if not.
    suspects = gathered(sketch.select("doc_id", "dk", F.explode("f").alias("f")).join(prints, "f", "left_semi").select("doc_id", "dk").distinct(), sketch.count())
    again = keyed.alias("d").join(suspects.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.dk") == F.col("s.dk")), "left_semi")
    again = again.dropDuplicates(["doc_id", "dk"]).select("doc_id", "dk", words_of(F.col("text")).alias("w"))
    grams = F.concat(*[_grams("w", n) for n in [window, *short]])
    found = again.select("doc_id", "dk", F.explode(grams).alias("g")).select("doc_id", "dk", F.col("g.pos").alias("pos"), F.col("g.len").alias("len"), F.col("g.gram").alias("gram")).join(windows, ["len", "gram"])
    return sketch.select("doc_id", "dk", "n_words"), saved(found.select("doc_id", "dk", "pos", "len", "item_id"))


def _report(documents: DataFrame, benchmark: DataFrame, window: int, k: int) -> DataFrame:
    rows, found = _hits(documents.select("doc_id", "text"), benchmark, window, k)
    spans = found.select("doc_id", "dk", "pos", (F.col("pos") + F.col("len")).alias("end")).distinct()
    before = F.expr("max(end) OVER (PARTITION BY doc_id, dk ORDER BY pos, end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    hit = spans.withColumn("before", F.coalesce(before, F.lit(0))).groupBy("doc_id", "dk").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("pos", "before"))).alias("n_hit"))
    items = found.where("item_id is not null").select("doc_id", "dk", F.col("item_id").cast("string").alias("item")).distinct().groupBy("doc_id", "dk").agg(F.array_sort(F.collect_list("item")).alias("items"))
    both = hit.alias("h").join(items.alias("i"), F.col("h.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("h.dk") == F.col("i.dk")), "left").select(F.col("h.doc_id").alias("hit_id"), F.col("h.dk").alias("hit_dk"), "n_hit", "items")
    both = saved(both)
    none = F.array().cast("array<string>")
    return rows.join(both, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("dk") == F.col("hit_dk")), "left").select(
        "doc_id", "dk", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
ns AS (SELECT DISTINCT n FROM bl),
dg AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hits AS (SELECT rid, i, dg.n, item_id FROM dg JOIN bg ON dg.n = bg.n AND dg.g = bg.g),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
