"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line goes when an equal line, or for lines of MIN_NEAR or more characters one within one edit, comes
earlier (by doc_id, then line number; nulls first), whether or not that earlier line itself stays.
Equal lines are found by a 128-bit hash. Near lines: two lines within one edit share an exact half, so only
lines that share a half with another text emit their deletion neighbourhood, as hashed keys: the text without
its i-th character, tagged with i (equal keys differ by a substitution) or with no position (equal to a whole
line one character shorter). A group's earliest member is its only witness, so a group yields one pair per
line, never all pairs; the edit distance of each pair is verified on the texts.

Edge cases: null or empty texts and lines without a word stay as they are; rows that share doc_id and text
are one document and stay alike; documents whose lines with words all go are dropped by ``drop_lines``;
an empty table gives an empty result; other columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, saved, sized, wrapped

MIN_NEAR = 20


def _lines(documents: DataFrame) -> DataFrame:
    """doc_id, dk, ln and the line, for each line with a word."""
    keyed = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("dk"), "text")
    return keyed.select("doc_id", "dk", F.posexplode(F.split("text", "\n", -1)).alias("ln", "line")).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def _key() -> list:
    return [F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(7), F.col("line")).alias("k2")]


def _halves() -> list:
    """For a line of n characters: its exact halves as a line of n, and as the longer line of a pair of n - 1 and n."""
    out = []
    for i, size in enumerate(("n", "(n - 1)")):
        half = f"(({size}) div 2)"
        out.append(F.expr(f"xxhash64('p', {size}, substr(line, 1, int({half})))").alias(f"p{i}"))
        out.append(F.expr(f"xxhash64('s', {size}, substr(line, int(n - ({size} - {half}) + 1)))").alias(f"s{i}"))
    return out


def dropped_lines(documents: DataFrame, min_near: int = MIN_NEAR) -> DataFrame:
    """doc_id, dk, ln and near of every line that goes (near: no equal line comes earlier, only one within one edit)."""
    documents = documents.select("doc_id", "text")
    lines = _lines(documents).withColumn("n", F.length("line"))
    at = F.struct("doc_id", "dk", "ln")
    ends = [F.when(F.col("n") >= min_near, x).alias(name) for x, name in zip(_halves(), ("p0", "s0", "p1", "s1"), strict=True)]
    firsts = saved(lines.select("doc_id", "dk", "ln", *_key(), *ends).groupBy("k1", "k2").agg(F.min(at).alias("first"), *[F.min(c).alias(c) for c in ("p0", "s0", "p1", "s1")]))

    # Distinct lines that share an exact half with another one, and which half.
    sides = F.array(*[F.struct(F.lit(c[0] == "p").alias("is_prefix"), F.col(c).alias("half")) for c in ("p0", "s0", "p1", "s1")])
    halves = firsts.where("p0 is not null").select("k1", "k2", "first", F.explode(sides).alias("h")).select("k1", "k2", "first", "h.is_prefix", "h.half")
    most = firsts.count()
    shared = gathered(halves.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half"), most)
    suspects = gathered(halves.join(sized(shared), "half", "left_semi").groupBy("k1", "k2", "first").agg(F.bool_or("is_prefix").alias("prefix"), F.bool_or(~F.col("is_prefix")).alias("suffix")), most)

    # The suspects' texts, read again where each line stands first.
    texts = _lines(documents).select("doc_id", "dk", "ln", "line", *_key()).join(sized(suspects), ["k1", "k2"])
    texts = texts.where(F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.dk") == F.col("dk")) & (F.col("first.ln") == F.col("ln")))
    texts = gathered(texts.select("k1", "k2", "first", "prefix", "suffix", "line").dropDuplicates(["k1", "k2"]).withColumn("n", F.length("line")), most)

    # A line emits the deletions in the half that is not shared. side: 0 same length, 1 the longer one, 2 the whole shorter one.
    where = "sequence(IF(suffix, 1, greatest(1, (n - 1) div 2)), IF(prefix, n, least(n, n div 2 + 2)))"
    without = "concat(substr(line, 1, int(i) - 1), substr(line, int(i) + 1))"
    keys = F.expr(f"""concat(transform({where}, i -> named_struct('key', xxhash64('at', i, n, {without}), 'side', 0)),
        transform({where}, i -> named_struct('key', xxhash64('in', {without}), 'side', 1)), array(named_struct('key', xxhash64('in', line), 'side', 2)))""")
    equal = gathered(texts.select("k1", F.explode(keys).alias("v")).groupBy("v.key").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo <> hi").select("key"), most)
    variants = texts.select("k1", "k2", "first", F.explode(keys).alias("v")).select("k1", "k2", "first", "v.key", "v.side")
    variants = gathered(variants.join(sized(equal), "key"), most)
    # Members of a side-0 group are near each other; in the others the whole line is near each longer one. The earliest is the witness.
    who = F.struct("first", "k1", "k2")
    groups = variants.groupBy("key").agg(F.min(F.when(F.col("side") == 2, who)).alias("whole"), F.min(F.when(F.col("side") != 2, who)).alias("rest"))
    witness = F.when(F.col("side") == 1, F.col("whole")).otherwise(F.col("rest"))
    pairs = variants.join(groups, "key").select("k1", "k2", "first", witness.alias("w")).where("w is not null and w.first < first")
    pairs = pairs.select("k1", "k2", F.col("w.k1").alias("w1"), F.col("w.k2").alias("w2")).distinct()
    near = pairs.join(texts.select("k1", "k2", "line"), ["k1", "k2"]).join(texts.select(F.col("k1").alias("w1"), F.col("k2").alias("w2"), F.col("line").alias("other")), ["w1", "w2"])
    near = gathered(near.where(F.levenshtein("line", "other", 1) >= 0).select("k1", "k2", F.lit(True).alias("near")).distinct(), most)

    marked = firsts.select("k1", "k2", "first").join(near, ["k1", "k2"], "left").select("k1", "k2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    every = _lines(documents).select("doc_id", "dk", "ln", *_key()).join(marked, ["k1", "k2"])
    again = ~(F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.dk") == F.col("dk")) & (F.col("first.ln") == F.col("ln")))
    return every.where(again | F.col("near")).select("doc_id", "dk", "ln", (~again).alias("near"))


def _with_drops(documents: DataFrame, min_near: int) -> DataFrame:
    """row_, body, and the numbers of the lines to drop where there are any."""
    drops = dropped_lines(documents.select("doc_id", "text"), min_near).groupBy(F.col("doc_id").alias("drop_id"), F.col("dk").alias("drop_dk")).agg(F.collect_set("ln").alias("drop_ln"), F.count_if("near").alias("drop_near"))
    rows = wrapped(documents).join(drops, F.col("id_").eqNullSafe(F.col("drop_id")) & (F.col("dk_") == F.col("drop_dk")), "left")
    return rows.select("row_", F.col("row_.text").alias("body"), "drop_ln", "drop_near")


_KEPT = "CASE WHEN drop_ln IS NULL THEN body ELSE array_join(filter(split(body, '\\n', -1), (x, i) -> NOT array_contains(drop_ln, i)), '\\n') END"


def dedup_report(documents: DataFrame, min_near: int = MIN_NEAR) -> DataFrame:
    """Per document: lines with a word, how many go (of these, near_lines without an equal earlier line), and the kept text's hash."""
    rows = _with_drops(documents.select("doc_id", "text"), min_near)
    words = F.expr("size(filter(split(coalesce(body, ''), '\\n', -1), x -> regexp_like(x, '[^\\\\x20\\\\x09-\\\\x0D]')))")
    kept = F.expr(f"coalesce({_KEPT}, '')")
    return rows.select("row_.doc_id", words.cast("long").alias("n_lines"), F.coalesce(F.size("drop_ln"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("drop_near", F.lit(0)).cast("long").alias("n_near"), F.sha2(kept, 256).alias("kept_sha256"))


def drop_lines(documents: DataFrame, min_near: int = MIN_NEAR) -> DataFrame:
    """The documents without the lines that go (n_chars follows the text); one that loses all its lines with words goes whole."""
    rows = _with_drops(documents, min_near).withColumn("kept", F.expr(_KEPT))
    rows = rows.where(F.col("drop_ln").isNull() | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("kept"), "n_chars": F.when(F.col("drop_ln").isNotNull(), F.length("kept"))}
    out = []
    for f in documents.schema:
        old = F.col("row_")[f.name]
        out.append((new["text"] if f.name == "text" else F.coalesce(new["n_chars"], old).cast(f.dataType) if f.name == "n_chars" else old).alias(f.name))
    return rows.select(*out)


#: Lines within one edit share a half, so SQL can compare only those; the edit distance decides.
ORACLE = r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents),
l AS (SELECT doc_id, text, unnest(range(len(string_split(text, chr(10))))) AS ln, unnest(string_split(text, chr(10))) AS line FROM d WHERE text IS NOT NULL),
w AS (SELECT doc_id, text, ln, line, length(line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
f AS (SELECT line, n, min(doc_id * 1000000 + ln) AS pos FROM w GROUP BY line, n),
h AS (SELECT line, pos, 'p' AS side, n AS len, substr(line, 1, n // 2) AS half FROM f WHERE n >= 20
      UNION ALL SELECT line, pos, 's', n, substr(line, n // 2 + 1) FROM f WHERE n >= 20
      UNION ALL SELECT line, pos, 'p', n - 1, substr(line, 1, (n - 1) // 2) FROM f WHERE n >= 20
      UNION ALL SELECT line, pos, 's', n - 1, substr(line, n - (n - 1 - (n - 1) // 2) + 1) FROM f WHERE n >= 20),
near AS (SELECT DISTINCT a.line FROM h a JOIN h b ON a.side = b.side AND a.len = b.len AND a.half = b.half AND b.pos < a.pos AND a.line <> b.line WHERE levenshtein(a.line, b.line) <= 1),
m AS (SELECT w.doc_id, w.ln, w.line, w.doc_id * 1000000 + w.ln <> f.pos AS again, near.line IS NOT NULL AS near FROM w JOIN f ON w.line = f.line LEFT JOIN near ON w.line = near.line),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE again OR near) AS n_dropped, count(*) FILTER (WHERE near AND NOT again) AS n_near FROM m GROUP BY doc_id),
k AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.ln) FILTER (WHERE NOT coalesce(m.again OR m.near, false)) AS kept FROM l LEFT JOIN m ON l.doc_id = m.doc_id AND l.ln = m.ln GROUP BY l.doc_id)
SELECT x.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(n_near, 0) AS n_near, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents x LEFT JOIN g ON x.doc_id = g.doc_id LEFT JOIN k ON x.doc_id = k.doc_id
"""
