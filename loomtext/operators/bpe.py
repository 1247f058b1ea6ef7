"""Byte-pair encoding: as a fold of literal replacements, or as a helper over the distinct pre-tokens of Arrow batches."""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import LOWER_BAR, byte_encoded

OPEN, CLOSE = "⟨", "⟩"
WORD_END = "</w>"
STRETCH = 500_000  # pre-tokens worked on at once


def pairs(symbols: Column) -> Column:
    """The distinct adjacent pairs of a symbol array."""
    n = F.size(symbols)
    shorter = F.greatest(n - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(symbols, 1, shorter), F.when(n > 1, F.slice(symbols, 2, shorter)).otherwise(F.slice(symbols, 1, 0)), lambda a, b: F.struct(a.alias("left"), b.alias("right"))))


def check_fold(merges: Sequence[tuple[str, str]], alphabet: Sequence[str]) -> None:
    """A fold in rank order equals lowest-rank-first when every product has one merge and parts exist before they merge."""
    known = set(alphabet)
    for left, right in merges:
        if left not in known or right not in known or left + right in known:
            raise ValueError(f"merge {left!r} {right!r} cannot be folded in order")
        known.add(left + right)


def fold_tokens(word: Column, merges: Sequence[tuple[str, str]], end: str = "") -> Column:
    """Sub-words of one pre-token, for small merge tables: all in the JVM."""
    wrapped = F.regexp_replace(word, r"(?s)(.)", f"{OPEN}$1{CLOSE}")
    if end:
        wrapped = F.regexp_replace(wrapped, f"(?s){CLOSE}$", f"{end}{CLOSE}")
    table = F.array(*[F.struct(F.lit(f"{OPEN}{a}{CLOSE}{OPEN}{b}{CLOSE}").alias("a"), F.lit(f"{OPEN}{a}{b}{CLOSE}").alias("b")) for a, b in merges])
    merged = F.aggregate(table, wrapped, lambda w, m: F.replace(w, m["a"], m["b"])) if merges else wrapped
    return F.filter(F.split(F.regexp_replace(merged, f"^{OPEN}|{CLOSE}$", ""), f"{CLOSE}{OPEN}"), lambda x: x != "")


def merge_word(word: str, ranks: dict[tuple[str, str], int], end: str = "") -> list[str]:
    """Lowest rank first, leftmost first; all occurrences of a pair merge before the next rank. A heap over a linked list."""
    symbols = [*word[:-1], word[-1] + end] if word else []
    n = len(symbols)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if symbols[i] else -1
        if j < 0 or symbols[i] != a or symbols[j] != b:
            continue
        symbols[i], symbols[j] = a + b, ""
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right >= 0 and (r := ranks.get((symbols[left], symbols[right]))) is not None:
                heapq.heappush(heap, (r, left, symbols[left], symbols[right]))
    return [s for s in symbols if s]


def subwords(words: Column, one: Callable[[str], list[str]], vocab: dict[str, int] | None = None, unk_id: int | None = None) -> Column:
    """The tokens of arrays of pre-tokens, or with a vocabulary their ids: each row by itself, in one narrow pass.

    An Arrow batch is worked on in stretches of rows of about ``STRETCH`` pre-tokens, so that arrays of positions stay small. A stretch's pre-tokens are
    dictionary-encoded, so ``one`` splits each distinct one once, and a worker keeps its results, side by side in one array, between stretches.
    A null row stays null; an unknown token takes unk_id, without one it is an error.
    """
    cache: dict[str, int] = {}
    parts, begins = array("i"), array("q", [0])
    names: dict[str, int] = {}

    def number(token: str) -> int:
        if vocab is None:
            return names.setdefault(token, len(names))
        i = vocab.get(token, unk_id)
        if i is None:
            raise ValueError(f"unknown token: {token}")
        return i

    def part(rows: pa.Array) -> pa.Array:
        if len(begins) > 300_000:
            cache.clear()
            names.clear()
            del parts[:], begins[1:]
        null = rows.is_null().to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = rows.flatten().dictionary_encode()
        place = np.empty(len(flat.dictionary), dtype=np.int64)
        for i, word in enumerate(flat.dictionary.to_pylist()):
            k = cache.get(word)
            if k is None:
                k = cache[word] = len(begins) - 1
                parts.extend([number(t) for t in one(word)])
                begins.append(len(parts))
            place[i] = k
        table, bounds = np.array(parts, dtype=np.int32), np.array(begins, dtype=np.int64)
        starts, lengths = bounds[place], bounds[place + 1] - bounds[place]
        word = flat.indices.to_numpy() if len(flat) else np.zeros(0, dtype=np.int64)
        n = lengths[word]
        token = table[np.repeat(starts[word] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        ends = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(sizes)))]
        values = pa.array(token) if vocab is not None else pa.array(list(names), pa.string()).take(pa.array(token))
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values, mask=pa.array(null))

    @F.arrow_udf("array<string>" if vocab is None else "array<int>")
    def run(rows: pa.Array) -> pa.Array:
        upto = np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        found, at = [], 0
        while at < len(rows) or not found:
            end = max(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STRETCH, "right")), at + 1)
            found.append(part(rows.slice(at, end - at)))
            at = end
        return found[0] if len(found) == 1 else pa.concat_arrays(found)

    return run(words)


def merged_words(words: Column, ranks: dict[tuple[str, str], int], end: str = "", vocab: dict[str, int] | None = None, unk_id: int | None = None, raw: bool = False) -> Column:
    """The tokens, or ids, of arrays of pre-tokens by a merge table; raw ones are put in the byte alphabet first, each distinct one once."""
    return subwords(words, lambda w: merge_word(byte_encoded(w) if raw else w, ranks, end), vocab, unk_id)


def piece_tokens(text: str, scores: dict[str, float], unknown: str = "<unk>") -> list[str]:
    """Scored pieces: the adjacent pair whose union scores highest merges first, leftmost on ties; unknown characters fall back to bytes."""
    symbols = list(text)
    n = len(symbols)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]

    def offer(i: int) -> None:
        j = after[i]
        if j >= 0 and (s := scores.get(symbols[i] + symbols[j])) is not None:
            heapq.heappush(heap, (-s, i, symbols[i], symbols[j]))

    heap: list = []
    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != a or j < 0 or symbols[j] != b:
            continue
        symbols[i], symbols[j] = a + b, ""
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    out: list[str] = []
    for s in symbols:
        if not s:
            continue
        if s in scores:
            out.append(s)
            continue
        fallback = [f"<0x{b:02X}>" for b in s.encode()]
        out += fallback if all(x in scores for x in fallback) else [unknown]
    return out


def piece_units(scores: dict[str, float]) -> re.Pattern:
    """What a text can be cut into before merging: words with their lower bars in front, unless some piece goes on over a blank."""
    crosses = any(re.search(f"[^{LOWER_BAR}]{LOWER_BAR}", x) for x in scores)
    return re.compile("(?s).+" if crosses else f"{LOWER_BAR}+[^{LOWER_BAR}]*|[^{LOWER_BAR}]+")


def piece_column(text: Column, scores: dict[str, float], vocab: dict[str, int] | None = None, unk_id: int | None = None) -> Column:
    """The tokens, or ids, of texts by scored pieces."""
    pattern = piece_units(scores).pattern
    return subwords(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda w: piece_tokens(w, scores), vocab, unk_id)
