"""Collocation mining by contiguous pattern growth from frequent prefixes.

Texts become chunks of word codes with a break after each piece, each with its own words, their hashes and their counts;
everything later reads these chunks. Words that are frequent in a language are known first. A pair of frequent words side
by side is a prefix; each chunk counts its pairs, and the sums give the frequent prefixes. Then every occurrence of a
frequent prefix that may grow is projected: what follows it in its piece, as far as all pairs there are frequent, goes to the
prefix's task, equal projections of a chunk as one row with their number. A task sorts its projections; a pattern's
occurrences are then one range of pointers, and the pattern grows to the right depth-first, by splitting its range at the next
word and keeping what is frequent. Prefixes with very many occurrences are split by their third word, which leaves every
count whole: such a prefix's own count is known already.

Whether a word or pair is frequent is asked of a bit table of fixed size, which may say yes by mistake (then a projection is
counted for nothing) and never no. Words are told apart by 63-bit hashes of language and word; the table of all words shows
whether two of them share a hash (expected: words squared over 2e19), and then all is done anew with another seed.

Edge cases: a null or empty text has no words; a null language is ``und``; repeated rows count each time; ties go by phrase;
ids and other columns are ignored, whatever their names; very long texts are cut at piece ends; an empty table gives no row.
Counts must stay below 10**16 for exact scores (38 decimal digits).
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, sized

LEAST = 10
WORDS = (2, 3)
TOP = 2000
CHUNK_WORDS = 1_200_000
SLICE = 4_000_000  # bytes of a long text taken at a time
WORD_BITS, PAIR_BITS = 22, 24
BUCKET_WORDS = 1_000_000  # of the corpus for each bucket of prefixes
HOT = 1_000_000  # occurrences from which a prefix is split by its third word
_BREAK = b"\xff"
#: A-Z to a-z, the ends of pieces to a byte that no UTF-8 text has, tab to blank.
_FOLD = bytes(0xFF if chr(c) in ".,;:!?" or 10 <= c <= 13 else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Codes(dict):
    """Codes of words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) - 1  # the break has an entry too
        return n


def _slices(text: str) -> Iterator[bytes]:
    data = text.encode("utf-8", "surrogatepass").translate(_FOLD)
    at = 0
    while at < len(data):
        end = data.find(_BREAK, at + SLICE)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end


def chunks(documents: DataFrame, seed: int) -> DataFrame:
    """lang, words with hashes and counts, and the codes of all words in order, -1 for a break; one row for each language and chunk."""

    def row(lang: str, codes: _Codes, seen: array) -> tuple:
        c = np.frombuffer(seen, dtype=np.int32)
        words = [w for w in codes if w != _BREAK]
        head = lang.encode("utf-8", "surrogatepass") + b"\0"
        hashes = np.array([xxhash.xxh3_64_intdigest(head + w, seed) | 1 for w in words], dtype=np.uint64).view(np.int64)
        return lang, [w.decode("utf-8", "surrogatepass") for w in words], hashes, np.bincount(c[c >= 0], minlength=len(words)), zlib.compress(c.tobytes(), 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, n = {}, 0
        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                codes, seen = open_.setdefault(lang, (_Codes({_BREAK: -1}), array("i")))
                for part in _slices(text):
                    words = part.replace(_BREAK, b" \xff ").split()
                    seen.extend([codes[w] for w in words])
                    seen.append(-1)
                    n += len(words) + 1
                    if n > CHUNK_WORDS:
                        yield from ends(open_)
                        n = 0
                        codes, seen = open_.setdefault(lang, (_Codes({_BREAK: -1}), array("i")))
        yield from ends(open_)

    def ends(open_: dict) -> Iterator[pd.DataFrame]:
        while open_:
            lang, (codes, seen) = open_.popitem()
            if len(codes) > 1:
                yield pd.DataFrame([row(lang, codes, seen)], columns=["lang", "words", "hashes", "counts", "codes"])

    texts = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(run, "lang string, words array<string>, hashes array<long>, counts array<long>, codes binary")


def pair_place(a, b):
    """Where a pair's bit is, of its words' hashes: the same on columns and on arrays."""
    if isinstance(a, Column):
        return a.bitwiseXOR(F.shiftleft(b, 23)).bitwiseXOR(F.shiftrightunsigned(b, 41))
    a, b = a.view(np.uint64), b.view(np.uint64)
    return (a ^ (b << np.uint64(23)) ^ (b >> np.uint64(41))).view(np.int64)


def bit_table(df: DataFrame, place: Column, bits: int) -> np.ndarray:
    """A table of 2**bits bits that has one wherever a row is: at most 2**(bits - 6) rows of it reach the driver."""
    at = place.bitwiseAND(F.lit((1 << bits) - 1))
    rows = df.select(F.shiftright(at, 6).alias("at"), F.expr("1L").alias("one"), at.bitwiseAND(F.lit(63)).cast("int").alias("bit")).groupBy("at").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("some")).toArrow()
    table = np.zeros(1 << (bits - 6), dtype=np.int64)
    table[rows["at"].to_numpy()] = rows["some"].to_numpy()
    return table.view(np.uint8)


def _look(packed: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The bits at these places."""
    at = places.view(np.uint64) & np.uint64(8 * len(packed) - 1)
    return (packed[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _opened(hashes: np.ndarray, codes: bytes, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, codes and whether a pair of maybe frequent words begins at each place."""
    h, c = np.asarray(hashes, dtype=np.int64), np.frombuffer(zlib.decompress(codes), dtype=np.int32).astype(np.int64)
    keep = np.append(_look(words, h >> 1), False)  # the last one is for breaks
    ok = keep[c]
    return h, c, ok[:-1] & ok[1:]


def count_pairs(texts: DataFrame, words: np.ndarray) -> DataFrame:
    """w0, w1 and n: the pairs of each chunk, counted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for hashes, codes in zip(b.hashes, b.codes, strict=True):
                h, c, starts = _opened(hashes, codes, words)
                at = np.flatnonzero(starts)
                key, n = np.unique(c[at] * len(h) + c[at + 1], return_counts=True)
                for k in range(0, len(key), 500_000):
                    part = key[k : k + 500_000]
                    yield pd.DataFrame({"w0": h[part // len(h)], "w1": h[part % len(h)], "n": n[k : k + 500_000]})

    return texts.select("hashes", "codes").mapInPandas(run, "w0 long, w1 long, n long")


def project(texts: DataFrame, words: np.ndarray, pairs: np.ndarray, hot: dict, most: int, buckets: int) -> DataFrame:
    """bucket, w0 .. w(most - 1), n: what follows each frequent pair, 0 where the piece or the frequent pairs end."""
    names = [f"w{k}" for k in range(most)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for hashes, codes in zip(b.hashes, b.codes, strict=True):
                h, c, starts = _opened(hashes, codes, words)
                at = np.flatnonzero(starts)
                starts[at] = _look(pairs, pair_place(h[c[at]], h[c[at + 1]]))
                at = np.flatnonzero(starts[:-1] & starts[1:])  # pairs that a frequent pair follows: those that may grow
                last = len(h)  # stands for the end
                group = c[at] * (last + 1) + c[at + 1]
                columns, live = [c[at], c[at + 1]], np.ones(len(at), dtype=bool)
                for k in range(2, most):
                    place = at + k - 1
                    live &= place < len(starts)
                    live[live] = starts[place[live]]
                    nxt = np.full(len(at), last)
                    nxt[live] = c[place[live] + 1]
                    columns.append(nxt)
                    group = np.unique(group, return_inverse=True)[1] * (last + 1) + nxt
                _, first, n = np.unique(group, return_index=True, return_counts=True)
                full = np.append(h, 0)
                w = [full[x[first]] for x in columns]
                mix = pair_place(w[0], w[1]).view(np.uint64)
                if hot:
                    split = np.array([hot.get(p, 1) for p in zip(w[0].tolist(), w[1].tolist(), strict=True)], dtype=np.uint64)
                    mix = mix + np.uint64(0x9E3779B97F4A7C15) * (w[2].view(np.uint64) % split)
                bucket = (mix >> np.uint64(16)) % np.uint64(buckets)
                for k in range(0, len(n), 250_000):
                    part = slice(k, k + 250_000)
                    yield pd.DataFrame({"bucket": bucket[part].astype(np.int32)} | {name: x[part] for name, x in zip(names, w, strict=True)} | {"n": n[part]})

    return texts.select("hashes", "codes").mapInPandas(run, "bucket int, " + "".join(f"{x} long, " for x in names) + "n long")


def grow(words: list[np.ndarray], n: np.ndarray, least: int) -> list[tuple[list[int], int]]:
    """Frequent phrases of three words and more, from projections (one array for each place, 0 for the end) and their numbers."""
    order = np.lexsort(words[::-1])
    words, n = [w[order] for w in words], n[order]
    found: list[tuple[list[int], int]] = []

    def runs(col: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        cut = np.flatnonzero(col[lo + 1 : hi] != col[lo : hi - 1]) + 1
        return np.concatenate(([0], cut)) + lo, np.append(cut, hi - lo) + lo

    def extend(prefix: list[int], lo: int, hi: int) -> None:
        """Grow the pattern whose occurrences are lo to hi by one word, and what comes of it further."""
        depth = len(prefix)
        begin, end = runs(words[depth], lo, hi)
        total = np.add.reduceat(n[lo:hi], begin - lo)
        for k in np.flatnonzero(total >= least):
            word = int(words[depth][begin[k]])
            if word:
                found.append(([*prefix, word], int(total[k])))
                if depth + 1 < len(words):
                    extend([*prefix, word], int(begin[k]), int(end[k]))

    if len(n):
        turn = np.flatnonzero(np.append(True, (words[0][1:] != words[0][:-1]) | (words[1][1:] != words[1][:-1])))
        for lo, hi, total in zip(turn, np.append(turn[1:], len(n)), np.add.reduceat(n, turn), strict=True):
            if total >= least:
                extend([int(words[0][lo]), int(words[1][lo])], int(lo), int(hi))
    return found


def frequent_phrases(documents: DataFrame, least: int = LEAST, most: int = WORDS[1], hot_from: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent phrases of 2 to ``most`` words (ws, a), frequent words (h, lang, word, a) and all words of each language (lang, n)."""
    seed = 0
    while True:
        texts = saved(chunks(documents, seed))
        all_words = texts.select("lang", F.explode(F.arrays_zip("words", "hashes", "counts")).alias("w")).groupBy(F.col("w.hashes").alias("h")).agg(
            F.sum("w.counts").alias("a"), F.min(F.struct("lang", "w.words")).alias("one"), F.max(F.struct("lang", "w.words")).alias("other"))
        all_words = saved(all_words)
        if all_words.where("one != other").isEmpty():
            break
        seed += 1
    known = all_words.select("h", F.col("one.lang").alias("lang"), F.col("one.words").alias("word"), "a")
    totals = saved(known.groupBy("lang").agg(F.sum("a").alias("n")))
    words = saved(known.where(F.col("a") >= least))
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    of_words = bit_table(words, F.shiftright("h", 1), WORD_BITS)
    pairs = saved(count_pairs(texts, of_words).groupBy("w0", "w1").agg(F.sum("n").alias("a")).where(F.col("a") >= least))
    phrases = pairs.select(F.array("w0", "w1").alias("ws"), "a")
    if most > 2:
        of_pairs = bit_table(pairs, pair_place(F.col("w0"), F.col("w1")), PAIR_BITS)
        hot_from = max(hot_from, n_words // 65_536)  # so there are 65,536 hot prefixes at most
        hot = {(r.w0, r.w1): -(-r.a // hot_from) for r in pairs.where(F.col("a") > hot_from).collect()}
        buckets = max(2 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_words // BUCKET_WORDS))

        def mine(b: pd.DataFrame) -> pd.DataFrame:
            found = grow([b[f"w{k}"].to_numpy() for k in range(most)], b.n.to_numpy(), least)
            return pd.DataFrame({"ws": [w for w, _ in found], "a": np.array([a for _, a in found], dtype=np.int64)})

        longer = project(texts, of_words, of_pairs, hot, most, buckets).groupBy("bucket").applyInPandas(mine, "ws array<long>, a long")
        phrases = phrases.unionByName(longer)
    return saved(phrases), words, totals


def collocations(documents: DataFrame, least: int = LEAST, words: tuple[int, int] = WORDS, top: int = TOP, cover: int = 50, hot_from: int = HOT) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    fewest, most = words
    if not 2 <= fewest <= most:
        raise ValueError("phrases have two words or more")
    phrases, known, totals = frequent_phrases(documents, least, most, hot_from)
    size = F.size("ws")
    # what a longer candidate has for the most part is dropped
    inside = phrases.where(size > fewest).select(F.col("a").alias("longer"), F.explode(F.flatten(F.transform(
        F.sequence(F.lit(fewest), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("ws", i, m))))).alias("ws")).groupBy("ws").agg(F.max("longer").alias("longer"))
    kept = phrases.where(size >= fewest).join(inside, "ws", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a"))).drop("longer")
    counts = phrases.select("ws", "a", F.lit(None).cast("string").alias("lang")).unionByName(known.select(F.array("h").alias("ws"), "a", "lang"))
    part = lambda name: counts.select(F.col("ws").alias(f"{name}s"), F.col("a").alias(name))
    cuts = kept.select("ws", "a", F.posexplode(F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.struct(F.slice("ws", F.lit(1), k).alias("ls"), F.slice("ws", k + 1, size - k).alias("rs")))).alias("k", "p"))
    cuts = cuts.select("ws", "a", "k", "p.ls", "p.rs").join(part("l").join(counts.select(F.col("ws").alias("ls"), "lang"), "ls"), "ls").join(part("r"), "rs")
    exact = lambda c: f"cast({c} as decimal(16, 0))"
    score = F.expr(f"(cast(1000000 as decimal(7, 0)) * ({exact('a')} * {exact('a')})) div ({exact('l')} * {exact('r')})")
    scored = cuts.groupBy("ws", "a").agg(F.max("lang").alias("lang"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")).select("ws", "a", "lang", "cut.score", "cut.l", "cut.r")
    first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = saved(scored.withColumn("rank", F.rank().over(first)).where(F.col("rank") <= top).drop("rank"))
    spelt = near.select("ws", F.posexplode("ws").alias("pos", "h")).join(sized(known.select("h", "word")), "h").groupBy("ws").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x.word)).alias("phrase"))
    ranked = near.join(spelt, "ws").withColumn("rank", F.row_number().over(first.orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals) if totals.limit(10_001).count() <= 10_000 else totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, doc_id, unnest(generate_series(1, len(p))) as i, unnest(p) as piece
  from (select lang, doc_id, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as p from documents)
), ws as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), at1 as (
  select lang, w, unnest(generate_series(1, len(w))) as i from ws where len(w) > 0
), f as (
  select lang, len, phrase, count(*) as a from (
    select lang, 1 as len, w[i:i] as phrase from at1
    union all select lang, 2, w[i:i + 1] from at1 where i + 1 <= len(w)
    union all select lang, 3, w[i:i + 2] from at1 where i + 2 <= len(w)
  ) group by all
), n as (select lang, sum(a)::bigint as n from f where len = 1 group by lang
), c as (select * from f where len > 1 and a >= 10
), kept as (
  select * from c where not exists (
    select 1 from c as d where d.lang = c.lang and d.len = 3 and c.len = 2 and (d.phrase[1:2] = c.phrase or d.phrase[2:3] = c.phrase) and 100 * d.a >= 50 * c.a)
), cut as (
  select k.lang, k.phrase, k.a, s.k, l.a as l, r.a as r, ((1000000::hugeint * k.a * k.a) // (l.a::hugeint * r.a))::bigint as score
  from kept as k join (select unnest([1, 2]) as k) as s on s.k < k.len
  join f as l on l.lang = k.lang and l.phrase = k.phrase[1:s.k] join f as r on r.lang = k.lang and r.phrase = k.phrase[s.k + 1:k.len]
), best as (
  select * from cut qualify row_number() over (partition by lang, phrase order by score, k) = 1
)
select best.lang, row_number() over (partition by best.lang order by score desc, a desc, array_to_string(phrase, ' ')) as rank, array_to_string(phrase, ' ') as phrase, a, l, r, n, score
from best join n using (lang) qualify rank <= 2000
"""
