"""Language-model scoring with a weighted backoff automaton over words.

A state stands for the last two words read, for the last one, or (the top) for none; a state exists where training
rows have its words. It has an arc for each word that follows it there, weighted by the word's probability smoothed
towards the next shorter state, and a failure arc to that state, weighted by what its arcs leave. The top state has an
arc for every word and one for unknown words (the base score). A text starts in the state of the end token and is read
once from left to right: at each token the state's arc is taken if there is one, else failure arcs first; log10
probabilities add up. With the count c of the state's words, the share of an n-gram seen n times is
(n + PRIOR * lower) / (c + PRIOR), so arcs and failure arc add up to one in every state.

Counts cover every training row and all n-grams, those seen once too; the automaton is never held whole. Texts are dealt
into chunks of about CHUNK_BYTES, and each chunk asks for the counts of its distinct n-grams: their hashes go to buckets
by range, each bucket adds up what the chunks count in training rows and answers each chunk in the order it asked. A
chunk then has the part of the automaton that its texts can reach. So a frequent n-gram is one row of each chunk at most, no
group grows with a word, and what is shuffled is the texts twice, the hashes once and small counts.

Edge cases: a null text is empty and scores its end token alone; a null doc_id belongs to the training
fold; repeated rows are scored one by one (and counted as often in training); with no training rows every
token is unknown; other columns are ignored; any character but white space, U+0000 too, is part of a word. Words are
told apart by 63 bits of hashes, longer n-grams by 40 bits within a bucket, which holds a million or so.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

ORDER = 3
PRIOR = (0.0, 300.0, 10.0)  # of one-word and of two-word states; chosen by held-out score
CHUNK_BYTES = 12_000_000
BUCKET_BYTES = 4_000_000
_M = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[bytes]:
    """Words of the text in UTF-8, A-Z lower-cased; the end token is implied."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class _Hashes(dict):
    """Hashes of words; the end token is the empty word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _even(x: np.ndarray) -> np.ndarray:
    return x & ~np.uint64(1)


def ngrams(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the n-grams that end at each token, by order, and how many tokens each text has.

    The first token's word pair starts with the end token; it has no longer n-gram (its place holds a hash that no n-gram has).
    """
    own, parts, sizes = _Hashes(), [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        h = [own[w] for w in tokens(text)]
        h.append(own[b""])
        sizes[i] = len(h)
        parts.append(np.array(h, dtype=np.uint64))
    word = _even(np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64))
    first = np.cumsum(sizes) - sizes
    before = np.roll(word, 1)
    before[first] = np.uint64(own[b""] & ~1)
    pair = _even(_mix(before * _M + word))
    out = [word, pair]
    for k in range(2, ORDER):
        longer = _even(_mix(np.roll(out[-1], 1) * _M + word + np.uint64(k)))
        for skip in range(k - 1):  # no n-gram reaches over a text's start
            longer[(first + skip)[skip < sizes]] = 0
        out.append(longer)
    return out, sizes


def _small(n: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as packed bytes; those of 255 and more are 255 there and whole in the second part."""
    return zlib.compress(np.minimum(n, 255).astype(np.uint8).tobytes(), 1), n[n >= 255].astype("<i8").tobytes()


def _whole(small: bytes, large: bytes) -> np.ndarray:
    n = np.frombuffer(zlib.decompress(small), dtype=np.uint8).astype(np.int64)
    n[n == 255] = np.frombuffer(large, dtype="<i8")
    return n


def _packed(place: np.ndarray) -> bytes:
    """Ascending places of 40 bits as their 32-bit differences where these are small enough, else as 5 bytes each."""
    step = np.diff(place, prepend=np.uint64(0))
    if len(place) > 64 and step[1:].max() < 2**32:
        return place[:1].tobytes() + step[1:].astype("<u4").tobytes()
    return place.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    if len(blob) == 5 * n:
        out = np.zeros((n, 8), dtype=np.uint8)
        out[:, :5] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, 5)
        return out.view("<u8").ravel()
    return np.cumsum(np.concatenate((np.frombuffer(blob[:8], dtype="<u8"), np.frombuffer(blob[8:], dtype="<u4"))), dtype=np.uint64)


def _starts(x: np.ndarray) -> np.ndarray:
    """Where the values of a sorted array begin."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, dtype=np.int64)


def _ask(texts: pd.DataFrame, buckets: int) -> Iterator[tuple]:
    """bucket, its distinct n-grams of each order (words by hash, longer ones by their 40-bit place in the bucket) and how many, and their counts in the training rows."""
    grams, sizes = ngrams(texts.text.tolist())
    train = np.repeat(~texts.held_out.to_numpy(dtype=bool), sizes).astype(np.uint64)
    words, places, counts, cuts = None, [], [], []
    for k, x in enumerate(grams):
        if k:
            live = x != 0
            x, flag = x[live], train[live]
        else:
            flag = train
        x = np.sort(x | flag)  # the lowest bit tells training rows
        start = _starts(x >> np.uint64(1))
        every = x[start] & ~np.uint64(1)
        counts.append(np.add.reduceat((x & np.uint64(1)).astype(np.int64), start) if len(start) else np.zeros(0, dtype=np.int64))
        high, low, n = every >> np.uint64(32), every & np.uint64(0xFFFFFFFF), np.uint64(buckets)
        place = ((high * n) << np.uint64(8)) + ((low * n) >> np.uint64(24))  # the hash over all buckets of 40 bits each
        cuts.append(np.searchsorted(place >> np.uint64(40), np.arange(buckets + 1, dtype=np.uint64)))
        places.append(place & np.uint64(2**40 - 1))
        words = every if k == 0 else words
    for b in range(buckets):
        one, two, three = (slice(c[b], c[b + 1]) for c in cuts)
        if any(p.start < p.stop for p in (one, two, three)):
            yield b, words[one].tobytes(), _packed(places[1][two]), _packed(places[2][three]), one.stop - one.start, two.stop - two.start, three.stop - three.start, *_small(np.concatenate((counts[0][one], counts[1][two], counts[2][three])))


_ASKED = ["k1", "k2", "k3", "m1", "m2", "m3", "small", "large"]


def _totals(asked: pd.DataFrame, orders: int = ORDER) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """By order the counts over all chunks of a bucket's n-grams, as asked row after row; how many each row asks for; of order 1 the counts of distinct words."""
    sizes = [asked[f"m{k}"].to_numpy(dtype=np.int64) for k in range(1, ORDER + 1)]
    counts = [_whole(a, b) for a, b in zip(asked.small, asked.large, strict=True)]
    ends = np.cumsum(np.stack(sizes, axis=1), axis=1)
    out, words = [], None
    for k in range(orders):
        n = np.concatenate([c[e[k] - s : e[k]] for c, e, s in zip(counts, ends, sizes[k], strict=True)])
        blobs = asked[f"k{k + 1}"]
        hashes = np.concatenate([_unpacked(x, m) for x, m in zip(blobs, sizes[k], strict=True)]) if k else np.frombuffer(b"".join(blobs), dtype="<u8")
        order = np.argsort(hashes)
        start = _starts(hashes[order])
        total = np.add.reduceat(n[order], start) if len(start) else np.zeros(0, dtype=np.int64)
        back = np.empty(len(n), dtype=np.int64)
        back[order] = np.repeat(total, np.diff(np.append(start, len(n))))
        out.append(back)
        words = total if words is None else words
    return out, sizes, words


def probabilities(counts: list[np.ndarray], sizes: np.ndarray, n: int, v: int) -> tuple[np.ndarray, np.ndarray]:
    """log10 of each token's base probability and of its probability in the automaton."""
    first = np.cumsum(sizes) - sizes
    p = (counts[0] + 0.5) / (n + 0.5 * (v + 1))
    base = np.log10(p)
    smooth, states = [p], []
    for k in range(1, len(counts)):  # the state of the k tokens before; its arc is smoothed towards the state below
        state = np.roll(counts[k - 1], 1)
        if k == 1:
            state[first] = counts[0][np.cumsum(sizes) - 1]  # a text starts in the end token's state
        else:
            for skip in range(k - 1):
                state[(first + skip)[skip < sizes]] = 0
        states.append(state)
        smooth.append((counts[k] + PRIOR[k] * smooth[-1]) / (state + PRIOR[k]))
    score, todo = np.zeros(len(p)), np.arange(len(p))
    for k in range(len(counts) - 1, 0, -1):
        arc = counts[k][todo] > 0
        score[todo[arc]] += np.log10(smooth[k][todo[arc]])
        todo = todo[~arc]
        score[todo] += np.log10(PRIOR[k] / (states[k - 1][todo] + PRIOR[k]))  # the failure arc
    score[todo] += base[todo]
    return base, score


_RESULT = "doc_id bigint, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(documents: DataFrame, held_out: int = 1, mod: int = 5, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Learn from the rows outside the held-out fold, then score every row."""
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets = size // chunk_bytes + 1, size // bucket_bytes + 1
    # rows are dealt in turn, so that copies of a row are dealt evenly too
    texts = documents.select("doc_id", (fold("doc_id", mod) == held_out).alias("held_out"), "text", F.pmod(F.monotonically_increasing_id(), F.lit(chunks)).alias("chunk")).repartition("chunk")

    def ask(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *x) for x in _ask(group, buckets)], columns=["chunk", "bucket", *_ASKED])

    def answer(key: tuple, asked: pd.DataFrame) -> pd.DataFrame:
        found, sizes, _ = _totals(asked)
        parts = [np.split(x, np.cumsum(s)[:-1]) for x, s in zip(found, sizes, strict=True)]
        rows = [(chunk, key[0], *[y for x in row for y in _small(x)]) for chunk, *row in zip(asked.chunk, *parts, strict=True)]
        return pd.DataFrame(rows, columns=["chunk", "bucket", "s1", "l1", "s2", "l2", "s3", "l3"])

    def add_up(asked: pd.DataFrame) -> pd.DataFrame:
        words = _totals(asked, 1)[2]
        return pd.DataFrame({"n": [int(words.sum())], "v": [int((words > 0).sum())]})

    def read(group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        answers = answers.sort_values("bucket")
        grams, sizes = ngrams(group.text.tolist())
        counts = []
        for k, x in enumerate(grams, 1):
            known = np.concatenate([_whole(a, b) for a, b in zip(answers[f"s{k}"], answers[f"l{k}"], strict=True)])
            live = np.flatnonzero(x) if k > 1 else np.arange(len(x))
            x = x[live]
            order = np.argsort(x)
            start = _starts(x[order])
            count = np.zeros(int(sizes.sum()), dtype=np.int64)
            count[live[order]] = np.repeat(known, np.diff(np.append(start, len(live))))
            counts.append(count)
        n, v = int(answers.n.iat[0]), int(answers.v.iat[0])
        base, full = probabilities(counts, sizes, n, v)
        first = np.cumsum(sizes) - sizes
        return pd.DataFrame({
            "doc_id": group.doc_id.astype("Int64"), "held_out": group.held_out, "n_tokens": sizes, "n_known": np.add.reduceat((counts[0] > 0).astype(np.int64), first), "train_tokens": n,
            "base_score": np.add.reduceat(base, first), "score": np.add.reduceat(full, first),
        })

    asked = texts.groupBy("chunk").applyInPandas(ask, "chunk long, bucket long, k1 binary, k2 binary, k3 binary, m1 int, m2 int, m3 int, small binary, large binary").repartition("bucket")
    totals = asked.groupBy("bucket").applyInPandas(add_up, "n long, v long").agg(F.struct(F.sum("n").alias("n"), F.sum("v").alias("v")).alias("totals"))
    answers = asked.groupBy("bucket").applyInPandas(answer, "chunk long, bucket long, s1 binary, l1 binary, s2 binary, l2 binary, s3 binary, l3 binary")
    answers = answers.withColumn("totals", totals.scalar()).select("*", "totals.n", "totals.v").drop("totals")
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(read, _RESULT)
