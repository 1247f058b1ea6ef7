"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

DataFrame operations only. One model is trained on random strings (labelled samples made from hashes: hexadecimal,
base64, base62, upper case with digits), the other on ordinary identifiers (samples made from the words of at most
``TRAIN_DOCS`` labelled documents: single, joined in camel case, by underscores, hyphens and slashes, with numbers). A
token of ``MIN_TOKEN`` or more key characters is a secret when the ratio over its transitions exceeds a threshold in
nats, which is chosen on samples held out from training: the value that one in ``1 / FALSE_ALARMS`` ordinary ones exceeds,
``THRESHOLD`` at least. The ratio adds up over the length, so short tokens must be odder than long ones. A span that a
pattern's span covers wholly is not added. The work is in proportion to the text.

Edge cases: null or empty text has no spans; positions are code points; a null doc_id keeps its row;
repeated rows each get a row; without labels the identifier model is uniform; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved

# The patterns of the contract.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
_ANY_CASE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in k) for k in KEYWORDS)
ASSIGN = rf"""({_ANY_CASE})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
MIN_TOKEN = 12
TOKEN = rf"[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}"
THRESHOLD = 4.0
FALSE_ALARMS = 1e-4
TRAIN_DOCS = 2000
RANDOM_SAMPLES = 12000
_BLOCK = 128
_SPAN = "struct<start:int,kind:int,end:int>"


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _spans(text: str, pattern: str, kind: int, keep: str = "true", group: int = 0) -> Column:
    """start, kind, end of each leftmost match that keep holds for (of x.good, the group's text), from the lengths of the matches and of what lies between them.

    The lengths are added up by blocks of matches, so that no array grows with all of them step by step.
    """
    quoted = _quoted(pattern)
    found, gaps = f"regexp_extract_all({text}, '{quoted}', 0)", f"split({text}, '{quoted}', -1)"
    good = f"regexp_extract_all({text}, '{quoted}', {group})" if group else found
    steps = f"transform(arrays_zip({found}, slice({gaps}, 1, size({found})), {good}), x -> named_struct('gap', length(x.`1`), 'len', length(x.`0`), 'ok', {keep.replace('x.good', 'x.`2`')}))"
    blocks = f"transform(array({steps}), s -> transform(sequence(0, size(s) - 1, {_BLOCK}), i -> slice(s, i + 1, {_BLOCK})))[0]"
    starts = "aggregate(b, named_struct('at', 0, 'out', cast(array() AS array<int>)), (a, x) -> named_struct('at', a.at + aggregate(x, 0, (t, y) -> t + y.gap + y.len), 'out', array_append(a.out, a.at)), a -> a.out)"
    inner = f"""aggregate(zb, named_struct('at', zs, 'out', cast(array() AS array<{_SPAN}>)),
        (a, y) -> named_struct('at', a.at + y.gap + y.len, 'out', IF(y.ok, array_append(a.out, named_struct('start', a.at + y.gap, 'kind', {kind}, 'end', a.at + y.gap + y.len)), a.out)), a -> a.out)"""
    added = f"transform(array({blocks}), b -> flatten(zip_with(b, {starts}, (zb, zs) -> {inner})))[0]"
    return F.expr(f"CASE WHEN regexp_like({text}, '{quoted}') THEN {added} ELSE cast(array() AS array<{_SPAN}>) END")


def _ratio(token: str, ratios: list[float]) -> str:
    """The log-likelihood ratio of a token: its characters once, each pair's value by the place of their codes in one constant array."""
    table = f"cast(split('{','.join(f'{x:.4f}' for x in ratios)}', ',') AS array<double>)"
    return f"aggregate(array(split({token}, '')), 0D, (t, c) -> aggregate(zip_with(slice(c, 1, size(c) - 1), slice(c, 2, size(c) - 1), (p, q) -> {table}[ascii(p) * 128 + ascii(q)]), 0D, (a, r) -> a + r))"


def _class(c: str) -> str:
    return "A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else "-"


def _log_probabilities(counts: dict[str, int], weight: float = 0.05) -> dict[tuple[str, str], float]:
    """Transition probabilities, smoothed towards those between the characters' classes, so that pairs the samples lack are judged by case and digits."""
    total = sum(counts.values())
    classes, single = Counter(), Counter()
    for a in ALPHABET:
        for b in ALPHABET:
            n = counts.get(a + b, 0)
            classes[_class(a), _class(b)] += n + 0.5 / len(ALPHABET)
            single[b] += n + 0.5 / len(ALPHABET)
    size, leaving = Counter(), Counter()
    for b in ALPHABET:
        size[_class(b)] += single[b]
    for (x, _), n in classes.items():
        leaving[x] += n
    out = {}
    for a in ALPHABET:
        row, x = sum(counts.get(a + b, 0) for b in ALPHABET), _class(a)
        more = weight * total / len(ALPHABET) + 5.0
        for b in ALPHABET:
            y = _class(b)
            out[a, b] = math.log((counts.get(a + b, 0) + more * classes[x, y] / leaving[x] * single[b] / size[y]) / (row + more))
    return out


def random_samples(spark: SparkSession, rows: int = RANDOM_SAMPLES) -> DataFrame:
    """s: random strings of MIN_TOKEN to 51 characters in the forms that keys have."""
    h = F.sha2(F.col("id").cast("string"), 256)
    raw = F.concat(F.unhex(h), F.unhex(F.sha2(F.concat(h, F.lit("x")), 256)))
    base64 = F.translate(F.base64(raw), "=\r\n", "")
    forms = F.array(h, base64, F.translate(base64, "+/", "-_"), F.translate(base64, "+/", ""), F.upper(F.translate(base64, "+/", "")))
    size = F.lit(MIN_TOKEN) + F.pmod(F.xxhash64("id"), F.lit(40))
    return spark.range(rows).select(F.explode(forms).alias("s"), size.cast("int").alias("n")).select(F.expr("left(s, n)").alias("s"))


def ordinary_samples(texts: DataFrame) -> DataFrame:
    """s: identifiers made from neighbouring words of the texts, what the patterns find taken out."""
    known = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = texts.select(F.regexp_extract_all(known, F.lit(r"[A-Za-z][A-Za-z0-9]*"), F.lit(0)).alias("w")).where("size(w) > 2")
    run = words.selectExpr("explode(arrays_zip(slice(w, 1, size(w) - 2), slice(w, 2, size(w) - 2), slice(w, 3, size(w) - 2))) AS t").selectExpr("t.`0` AS x", "t.`1` AS y", "t.`2` AS z").withColumn("n", F.expr("pmod(hash(x, y), 1000)"))
    forms = """array(x, x, x, concat(x, '_', y), concat(lower(x), initcap(y), initcap(z)), concat(x, '/', y, '/', z), concat('/', lower(y), '/', lower(z), '_', n), concat(x, '-', y, '-', z),
        concat(upper(x), '_', upper(y)), concat(x, n), concat(initcap(x), initcap(y), n), concat(lower(x), '-', 2000 + pmod(n, 30), '-', lpad(1 + pmod(n, 12), 2, '0'), '-', lower(y)))"""
    return run.selectExpr(f"{forms}[pmod(hash(x, z), 12)] AS s")


def fit(documents: DataFrame, labels: DataFrame) -> dict:
    """ratios (log-likelihood ratios of character pairs, random over ordinary, by the characters' codes), the threshold, and the shares of held-out samples above it.

    At most len(ALPHABET)^2 counts reach the driver for each model. One sample in five is held out.
    """
    spark = documents.sparkSession
    sample = labels.select(F.col("doc_id").alias("label_id")).where("label_id is not null").distinct().orderBy(F.xxhash64("label_id"), "label_id").limit(TRAIN_DOCS)
    texts = documents.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"), "left_semi")
    samples = random_samples(spark).select("s", F.lit(True).alias("random")).union(ordinary_samples(texts).select("s", F.lit(False)))
    samples = saved(samples.withColumn("held", F.pmod(F.xxhash64("s"), F.lit(5)) == 0))
    pairs = samples.where("not held and length(s) > 1").selectExpr("random", "explode(zip_with(slice(split(s, ''), 1, length(s) - 1), slice(split(s, ''), 2, length(s) - 1), (p, q) -> p || q)) AS pair")
    counts: dict[bool, dict[str, int]] = {True: {}, False: {}}
    for r in pairs.groupBy("random", "pair").agg(F.count("*").alias("n")).collect():
        counts[r.random][r.pair] = r.n
    secret, ordinary = (_log_probabilities(counts[x]) for x in (True, False))
    ratios = [0.0] * 128 * 128
    for a in ALPHABET:
        for b in ALPHABET:
            ratios[ord(a) * 128 + ord(b)] = round(secret[a, b] - ordinary[a, b], 4)
    held = saved(samples.where(f"held and length(s) >= {MIN_TOKEN}").select("random", F.expr(_ratio("s", ratios)).alias("r")))
    high = held.where("not random").agg(F.expr(f"percentile_approx(r, {1 - FALSE_ALARMS}, 100000)")).first()[0]
    threshold = max(THRESHOLD, high or 0.0)
    shares = {r.random: r.share for r in held.groupBy("random").agg(F.avg((F.col("r") > threshold).cast("int")).alias("share")).collect()}
    return {"ratios": ratios, "threshold": threshold, "recall": shares.get(True), "false_alarms": shares.get(False)}


def scan(documents: DataFrame, model: dict) -> DataFrame:
    """Counts and spans of every document; a projection without shuffle."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    markov = f"{_ratio('x.good', model['ratios'])} > {model['threshold']}"
    docs = docs.select("doc_id", _spans("body", ASSIGN, 0, "length(x.good) >= 6", 2).alias("s0"), _spans("body", ACCESS, 1).alias("s1"), _spans("body", HEX, 2).alias("s2"), _spans("body", TOKEN, 3, markov).alias("s3"))
    docs = docs.withColumn("base", F.array_sort(F.concat("s0", "s1", "s2")))
    docs = docs.withColumn("more", F.expr("CASE WHEN size(base) > 0 THEN filter(s3, x -> NOT exists(base, b -> b.start <= x.start AND x.end <= b.end)) ELSE s3 END"))
    names = "array('" + "', '".join(KINDS) + "')"
    text = lambda c: F.expr(f"array_join(transform({c}, x -> concat_ws(':', {names}[x.kind], x.start, x.end)), ',')")
    docs = docs.withColumn("all_spans", F.array_sort(F.concat("base", "more")))
    return docs.select(
        "doc_id", *[F.size(c).cast("long").alias(f"n_{k}") for c, k in zip(("s0", "s1", "s2"), KINDS, strict=False)], F.sha2(text("base"), 256).alias("base_sha256"), text("all_spans").alias("spans"), F.size("more").cast("long").alias("n_markov"),
    )
