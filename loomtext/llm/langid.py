"""Language identification by word-first backoff.

Known words score by their per-language log frequency; for a word that no training row has, its character
n-grams do, from the longest length downwards, each position falling back to shorter ones.
The counts cover all training rows, all their words and all n-grams of those, in all languages; the model is never held whole.
Texts are read once, in chunks: a chunk keeps its texts as places in its list of distinct words, and sends the list, with the
training rows' counts, to buckets by hash. A bucket adds up and numbers its words; unseen ones ask for their n-grams,
each distinct n-gram of a bucket once. What a bucket answers for a word is sparse: a share of each kind of base value (of a
language that lacks the word or n-gram), and what the languages that have it add, in single precision; a chunk gets it in the order it asked.

Edge cases: null text, or text without a letter, gives ``und`` with score 0; without any training row
everything is ``und``; a null doc_id is not held out; repeated rows each get a row; equal scores go to the first language by
name; very long texts are read in slices, so that only their distinct words are held; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, saved

ORDERS = (5, 4, 3, 2, 1)
CHUNK_CHARS = 12_000_000
BUCKET_CHARS = 24_000_000
_FLUSH = 400_000
_SLICE = 3_000_000
_SPACE = re.compile(r"\s")
# Letters by Unicode category: word characters that are no digits, numerals (such as ² or Ⅷ) or underscores.
_NUMERALS = "".join(c for c in map(chr, range(0x20000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_LETTERS = re.compile(rf"[^\W\d_{_NUMERALS}]+")
#: Kinds of values by number: 0 a known word, 1 to 5 an n-gram of that length, from 6 on what a language adds.
_KINDS = 6


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def _slices(texts: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Lower-cased runs between white space, some _SLICE characters at a time: the runs, the texts they are of and how many each has. Long texts are cut at white space."""
    runs, texts_at, many, size = [], [], [], 0
    for i, text in enumerate(texts):
        text, at = text.lower(), 0
        while at < len(text):
            cut = _SPACE.search(text, at + _SLICE) if len(text) - at > _SLICE else None
            end = cut.start() if cut else len(text)
            part = text[at:end].split()
            runs += part
            texts_at.append(i)
            many.append(len(part))
            size, at = size + end - at, end
            if size > _SLICE:
                yield runs, np.array(texts_at), np.array(many)
                runs, texts_at, many, size = [], [], [], 0
    if runs:
        yield runs, np.array(texts_at), np.array(many)


def _spread(first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows first[i] to first[i] + many[i] - 1 for every i, and that i beside each."""
    of = np.repeat(np.arange(len(many)), many)
    return np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + first[of], of


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(keys, return_inverse=True)
    return keys, np.bincount(back, weights=weights, minlength=len(keys))


def _pack(x: np.ndarray) -> bytes:
    """Numbers by planes of bytes, compressed; whole ones in as few bytes as the largest needs."""
    x = x if x.dtype.kind == "f" else x.astype(np.min_scalar_type(int(x.max(initial=0))))
    return x.dtype.str.encode() + zlib.compress(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    kind, planes = np.dtype(blob[:3].decode()), zlib.decompress(blob[3:])
    x = np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()
    return x.astype(np.float64 if kind.kind == "f" else np.int64)


def _pairs(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of texts, and for each text and word of it: text, word (by number) and how often."""
    numbers: dict[str, int] = {}
    keys, counts = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
    for runs, texts_at, many in _slices(texts):
        code, distinct = pd.factorize(np.array(runs, dtype=object))
        at, size = [], np.empty(len(distinct), dtype=np.int64)
        for i, run in enumerate(distinct):
            before = len(at)
            for w in _LETTERS.findall(run):
                at.append(numbers.setdefault(w, len(numbers)))
            size[i] = len(at) - before
        row, of = _spread((np.cumsum(size) - size)[code], size[code])
        key, n = np.unique(np.repeat(texts_at, many)[of] << 32 | np.array(at, dtype=np.int64)[row], return_counts=True)
        keys.append(key)
        counts.append(n)
    key, n = _summed(np.concatenate(keys), np.concatenate(counts))
    return list(numbers), key >> 32, key & 0xFFFFFFFF, n.astype(np.int64)


_COLUMNS = ["chunk", "bucket", "ids", "words", "a", "b", "c"]
_READ = "chunk long, bucket long, ids array<string>, words binary, a binary, b binary, c binary"


def _reader(langs: list[str], buckets: int, chunk_chars: int):
    number = {lang: i for i, lang in enumerate(langs)}

    def chunk(of: int, rows: list[tuple]) -> pd.DataFrame:
        words, text, word, n = _pairs([r[2] or "" for r in rows])
        bucket = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets for w in words), dtype=np.int64, count=len(words))
        order = np.lexsort((np.argsort(np.argsort(np.array(words, dtype=object))), bucket)) if words else np.zeros(0, dtype=np.int64)
        place = np.empty(len(words), dtype=np.int64)
        place[order] = np.arange(len(words))
        key = np.sort(text << 32 | place[word])
        tf = n[np.lexsort((place[word], text))]
        at, size = key & 0xFFFFFFFF, np.bincount(key >> 32, minlength=len(rows))
        first = (np.cumsum(size) - size)[size > 0]
        step = np.diff(at, prepend=0)
        step[first] = at[first]
        out = [(of, -1, [r[0] for r in rows], None, _pack(size), _pack(step), _pack(tf))]
        lang = np.array([number.get(r[1], -1) for r in rows], dtype=np.int64)[key >> 32]
        seen, counts = _summed(at[lang >= 0] * len(langs) + lang[lang >= 0], tf[lang >= 0])
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in range(buckets):
            lo, hi = cuts[b], cuts[b + 1]
            if lo < hi:
                part = slice(*np.searchsorted(seen, (lo * len(langs), hi * len(langs))))
                text_of = "\n".join([words[i] for i in order[lo:hi]]).encode("utf-8", "surrogatepass")
                at_of = seen[part] // len(langs) - lo
                out.append((of, b, None, zlib.compress(text_of), _pack(at_of), _pack(seen[part] % len(langs)), _pack(counts[part].astype(np.int64))))
        return pd.DataFrame(out, columns=_COLUMNS)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, rows, size = TaskContext.get().partitionId() << 33, [], 0
        for b in batches:
            for row in zip(b.doc_id, b.lang, b.text, strict=True):
                rows.append(row)
                size += len(row[2] or "") + 50
                if size > chunk_chars:
                    yield chunk(of, rows)
                    of, rows, size = of + 1, [], 0
        if rows:
            yield chunk(of, rows)

    return read


def _words(blob: bytes) -> list[str]:
    return zlib.decompress(blob).decode("utf-8", "surrogatepass").split("\n")


def _read(documents: DataFrame, langs: list[str], buckets: int, train, chunk_chars: int) -> DataFrame:
    rows = documents.select(F.col("doc_id").cast("string"), F.when(train, F.col("lang")).alias("lang"), "text")
    return saved(rows.mapInPandas(_reader(langs, buckets, chunk_chars), _READ))


def fit(documents: DataFrame, held_out: int = 1, mod: int = 3, chunk_chars: int = CHUNK_CHARS, bucket_chars: int = BUCKET_CHARS) -> dict:
    """The model: the languages of the training rows, and the chunks of the documents with the training rows' counts."""
    train = (fold("doc_id", mod) != held_out) & F.col("lang").isNotNull()
    langs = sorted(r.lang for r in documents.where(train).select("lang").distinct().collect())
    if not langs:
        return {"langs": langs}
    buckets = (documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bucket_chars + 1
    return {"langs": langs, "buckets": buckets, "of": documents, "read": _read(documents, langs, buckets, train, chunk_chars)}


def _tally(asked: pd.DataFrame) -> pd.DataFrame:
    """A bucket's words, numbered, with their counts by language (chunk -1), and for each chunk the numbers of the words it asks for."""
    lists = [_words(x) for x in asked.words]
    code, distinct = pd.factorize(np.array([w for x in lists for w in x], dtype=object))
    ends = np.cumsum([len(x) for x in lists])
    at = np.concatenate([_unpack(a) + e - len(x) for a, e, x in zip(asked.a, ends, lists, strict=True)])
    lang = np.concatenate([_unpack(x) for x in asked.b])
    key, n = _summed(code[at] << 20 | lang, np.concatenate([_unpack(x) for x in asked.c]))
    bucket = asked.bucket.iat[0]
    out = [(-1, bucket, None, zlib.compress("\n".join(distinct).encode("utf-8", "surrogatepass")), _pack(key >> 20), _pack(key & 0xFFFFF), _pack(n.astype(np.int64)))]
    out += [(chunk, bucket, None, None, _pack(x), None, None) for chunk, x in zip(asked.chunk, np.split(code, ends[:-1]), strict=True) if chunk >= 0]
    return pd.DataFrame(out, columns=_COLUMNS)


def _flushed(counts: dict[int, Counter]) -> Iterator[pd.DataFrame]:
    for lang, one in counts.items():
        if one:
            yield pd.DataFrame({"gram": list(one), "lang": lang, "n": np.fromiter(one.values(), dtype=np.int64, count=len(one))})
    counts.clear()


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """n-grams and how often training rows have them; the empty one counts all words, and as language -1 the distinct ones."""
    counts: dict[int, Counter] = defaultdict(Counter)
    for b in batches:
        for blob, *packed in zip(b.words, b.a, b.b, b.c, strict=True):
            words, (code, langs, n) = _words(blob), map(_unpack, packed)
            counts[-1][""] += len(np.unique(code))
            for k, lang, m in zip(code.tolist(), langs.tolist(), n.tolist(), strict=True):
                one = counts[lang]
                one[""] += m
                for order in ORDERS:
                    grams = grams_of(words[k], order)
                    if m == 1:
                        one.update(grams)
                    else:
                        for g in grams:
                            one[g] += m
                if len(one) > _FLUSH:
                    yield from _flushed(counts)
    yield from _flushed(counts)


def _unseen(words: list[str], code: np.ndarray) -> np.ndarray:
    return np.setdiff1d(np.arange(len(words)), code)


def _ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The distinct n-grams of a bucket's unseen words."""
    for b in batches:
        for bucket, blob, packed in zip(b.bucket, b.words, b.a, strict=True):
            words = _words(blob)
            grams = {g for k in _unseen(words, _unpack(packed)) for n in ORDERS for g in grams_of(words[k], n)}
            if grams:
                yield pd.DataFrame({"bucket": bucket, "gram": list(grams)})


def _back_off(words: list[str], answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries (word, kind, value) of unseen words: at each position the longest known n-gram; the mean keeps one word one vote."""
    answers = answers.sort_values("gram")
    gram, lang = answers.gram.to_numpy(), answers.lang.to_numpy(dtype=np.int64)
    first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))) if len(gram) else np.zeros(0, dtype=np.int64)
    known = dict(zip(gram[first].tolist(), range(len(first)), strict=True))
    many = np.diff(np.append(first, len(gram)))
    sizes = np.fromiter((len(g) for g in known), dtype=np.int64, count=len(known))
    at, votes = [], []
    for w in words:
        w, before = f"^{w}$", len(at)
        for i in range(len(w)):
            for n in ORDERS:
                k = known.get(w[i : i + n])
                if k is not None:
                    at.append(k)
                    break
        votes.append(len(at) - before)
    at, votes = np.array(at, dtype=np.int64), np.array(votes, dtype=np.int64)
    word, weight = np.repeat(np.arange(len(votes)), votes), np.repeat(1.0 / np.maximum(votes, 1), votes)
    row, of = _spread(first[at], many[at])
    keys = np.concatenate((word << 20 | sizes[at], word[of] << 20 | (_KINDS + lang[row])))
    added = np.log((answers.n.to_numpy(dtype=np.float64)[row] + 0.1) / 0.1)
    keys, values = _summed(keys, np.concatenate((weight, weight[of] * added)))
    return keys >> 20, keys & 0xFFFFF, values


def _answer(tally: pd.DataFrame, grams: pd.DataFrame) -> pd.DataFrame:
    """For each chunk, in the order it asked: how many entries each word has, and their kinds and values."""
    own = tally[tally.chunk < 0].iloc[0]
    words, (code, lang, n) = _words(own.words), map(_unpack, own[["a", "b", "c"]])
    unseen, seen = _unseen(words, code), np.unique(code)
    word, kind, value = _back_off([words[k] for k in unseen], grams)
    word = np.concatenate((seen, code, unseen[word]))
    kind = np.concatenate((np.zeros(len(seen), dtype=np.int64), lang + _KINDS, kind))
    value = np.concatenate((np.ones(len(seen)), np.log((n + 0.1) / 0.1), value))
    order = np.lexsort((kind, word))
    many = np.bincount(word, minlength=len(words))
    first, kind, value = np.cumsum(many) - many, kind[order], value[order]
    out = []
    for chunk, blob in zip(tally.chunk, tally.a, strict=True):
        if chunk >= 0:
            asked = _unpack(blob)
            row, _ = _spread(first[asked], many[asked])
            out.append((chunk, own.bucket, _pack(many[asked]), _pack(kind[row]), _pack(value[row].astype(np.float32))))
    return pd.DataFrame(out, columns=["chunk", "bucket", "a", "b", "c"])


def identify(documents: DataFrame, model: dict, held_out: int = 1, mod: int = 3, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the winner's posterior) of every whole text."""
    held = (fold("doc_id", mod) == held_out).alias("held_out")
    if not model["langs"]:
        return documents.select("doc_id", held, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    langs, rows = model["langs"], model["read"]
    asked = rows.where("bucket >= 0")
    if documents is not model["of"]:  # the model's own chunks only bring their counts
        rows = _read(documents, langs, model["buckets"], F.lit(False), chunk_chars)
        asked = rows.where("bucket >= 0").union(asked.withColumn("chunk", F.lit(-1).cast("long")))
    tally = saved(asked.groupBy("bucket").applyInPandas(_tally, _READ))
    known = tally.where("chunk < 0")
    grams = saved(known.mapInPandas(_count_grams, "gram string, lang int, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")))
    size = F.length("gram").alias("size")
    sums = {(r["size"], r["lang"]): r["n"] for r in grams.groupBy(size, "lang").agg(F.sum("n").alias("n")).collect()}
    kinds = {r["size"]: r["kinds"] for r in grams.groupBy(size).agg(F.count_distinct("gram").alias("kinds")).collect()} | {0: sums.get((0, -1), 0)}
    base = np.array([[np.log(0.1 / (max(sums.get((k, i), 0), 1) + 0.1 * (kinds.get(k, 0) + 1))) for i in range(len(langs))] for k in range(_KINDS)])
    none = np.array([(0, i) not in sums for i in range(len(langs))])  # languages whose training rows have no letter
    found = known.mapInPandas(_ask, "bucket long, gram string").join(grams.where("lang >= 0"), "gram")
    answers = tally.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInPandas(_answer, "chunk long, bucket long, a binary, b binary, c binary")

    def add_up(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        answers, own = answers.sort_values("bucket"), texts.iloc[0]
        size, step, tf = map(_unpack, own[["a", "b", "c"]])
        many, kind, value = (np.concatenate([np.zeros(0, dtype=np.int64), *map(_unpack, answers[x])]) for x in "abc")
        at = np.cumsum(step)
        first = np.cumsum(size) - size
        at -= np.repeat(np.concatenate(([0], at))[first], size)  # places count from each text's start
        row, of = _spread((np.cumsum(many) - many)[at], many[at])
        wide = _KINDS + len(langs)
        sums = np.bincount(np.repeat(np.arange(len(size)), size)[of] * wide + kind[row].astype(np.int64), weights=tf[of] * value[row], minlength=len(size) * wide).reshape(len(size), wide)
        scores = sums[:, _KINDS:] + sums[:, :_KINDS] @ base
        scores[:, none] = -np.inf
        lettered = (size > 0) & ~none.all()
        share = 1.0 / np.exp(np.where(lettered[:, None], scores - scores.max(axis=1, keepdims=True), 0.0)).sum(axis=1)
        pred = np.array(langs, dtype=object)[scores.argmax(axis=1)]
        pred[~lettered] = "und"
        return pd.DataFrame({"doc_id": list(own.ids), "lang_pred": pred, "score": np.where(lettered, share, 0.0)})

    texts = rows.where("bucket < 0").select(F.col("chunk").alias("part"), "ids", "a", "b", "c")
    out = texts.groupBy("part").cogroup(answers.groupBy("chunk")).applyInPandas(add_up, "doc_id string, lang_pred string, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast(documents.schema["doc_id"].dataType)).select("doc_id", held, "lang_pred", "score")
