"""Token counts by overlap resynchronisation.

Texts of up to ``chunk`` characters are counted where they lie: a text is the sum of its runs between ASCII white space
(white space never enters a token), and each task asks the library once for each distinct run. Longer texts are cut into
chunks that overlap by ``overlap`` characters, one row each, dealt evenly over all tasks and encoded with offsets. Two
neighbours are spliced behind a token that both give with the same id and the same place. Such a boundary is proven:

* byte-pair merging is local: a sequence of tokens is the encoding of its text if each pair of neighbours is the encoding
  of its own text. Left of the shared token all pairs come from the left chunk, right of it from the right one, and the
  token itself is in both, so every pair of the spliced sequence has been made by the library;
* an id tells whether its token ends a word, so the token ends a pre-token in both chunks or in neither; in the second
  case the pre-token must be longer than any contraction, hence a run of letters or of symbols, which ends at the same
  place in both; the places are at least MARGIN characters away from the ends of both chunks, further than the pattern
  and any special string look;
* the character behind the boundary is neither a mark nor a Hangul jamo, so Unicode composition does not cross it.

The count is the last chunk's plus, for each splice, the tokens before it in the left chunk less those in the right one.
Texts with a pair of chunks that share no such token are cut anew with wider chunks and overlaps, until a chunk holds the
whole text.

Edge cases: a null or empty text has no token; rows that share an id or a text, repeated rows and rows without an id keep
one result each; a text of any length is encoded in bounded chunks, unless it holds no boundary at all (then whole); other
columns are ignored, whatever their names; an empty table gives an empty one. Nothing is trained.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

MAX_TOKENS = 2048
CHUNK = 49_152
OVERLAP = 1024
MARGIN = 32
LONGEST_CONTRACTION = 3
MEMO = 1_000_000  # runs a worker remembers; past that it starts anew
TRAIL, LEAD = ".,;:!?", '"(['
_STATE: dict = {}


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str):
    """The library's tokenizer and this worker's memo of counts."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _STATE:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        _STATE[path] = own, {}
    return _STATE[path]


def parts_of(run: str) -> tuple[str, str, str]:
    """A run without white space as leading signs, core and trailing signs, cut only where a letter A-Z meets a sign that no contraction and no special string has: pre-tokens end there."""
    core = run.rstrip(TRAIL)
    trail = run[len(core) :]
    if not core or not (core[-1].isascii() and core[-1].isalpha()):
        core, trail = run, ""
    inner = core.lstrip(LEAD)
    if not inner or not (inner[0].isascii() and inner[0].isalpha()):
        inner = core
    return core[: len(core) - len(inner)], inner, trail


def _learn(own, memo: dict, runs: list[str]) -> None:
    """Counts of runs that the memo lacks. Plain words are encoded side by side in one text, as one pre-token each."""
    split = [parts_of(r) for r in runs]
    need = {p for parts in split for p in parts if p and p not in memo}
    words = [p for p in need if p.isascii() and p.isalpha()]
    lower = list({w.lower() for w in words})
    for at in range(0, len(lower), 4096):
        some = lower[at : at + 4096]
        counts = np.bincount(np.array(own.encode(" ".join(some), add_special_tokens=False).word_ids), minlength=len(some))
        memo.update(zip(some, counts.tolist(), strict=True))
    memo.update((w, memo[w.lower()]) for w in words)
    rest = [p for p in need if p not in memo]
    memo.update(zip(rest, map(len, own.encode_batch_fast(rest, add_special_tokens=False)), strict=True))
    memo.update((r, sum(memo[p] for p in parts if p)) for r, parts in zip(runs, split, strict=True))


def count_in_place(texts: list[str], path: str) -> list[int]:
    """Tokens of each text, as the library gives them."""
    own, memo = encoder(path)
    split = [_runs(t) for t in texts]
    if len(memo) > MEMO:
        memo.clear()
    memo.setdefault("", 0)
    new = list({r for s in split for r in s if r not in memo})
    if new:
        _learn(own, memo, new)
    return [sum(map(memo.__getitem__, s)) for s in split]


def _runs(text: str) -> list[str]:
    """Runs between ASCII white space; other white space stays inside a run, where the library removes it."""
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    return text.split(" ")


def stable(text: str, first: bool, last: bool, own) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
    """Ids, starts and ends of a chunk's tokens, and the numbers of those that may be a splice in its head and in its tail."""
    e = own.encode(text, add_special_tokens=False)
    if not e.ids:
        return [], [], [], [], []
    at = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
    start, end, word = at[:, 0], at[:, 1], np.array([-1 if w is None else w for w in e.word_ids], dtype=np.int64)
    follows = np.append(start[1:], len(text))  # the next token must begin behind this one: bytes of one character stay together
    # extent of each token's pre-token
    turn = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    group = np.repeat(np.arange(len(turn)), np.diff(np.append(turn, len(word))))
    width = (np.maximum.reduceat(end, turn) - np.minimum.reduceat(start, turn))[group]
    closes = np.append(word[1:] != word[:-1], True)
    fits = (follows >= end) & (closes | (width > LONGEST_CONTRACTION)) & (end >= MARGIN) & (end <= len(text) - MARGIN)
    inert = lambda c: unicodedata.category(c)[0] != "M" and not "ᄀ" <= c <= "ᇿ" and not "ힰ" <= c <= "퟿"
    some = [int(k) for k in np.flatnonzero(fits) if inert(text[end[k]])]
    return e.ids, start.tolist(), end.tolist(), some if not first else [], some if not last else []


TOKEN = "array<struct<s:long,e:long,id:long,k:long>>"


def count_long(texts: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Tokens of the distinct long texts of (key, text): key and n_tokens. Cuts, encodes, splices, and repeats with wider overlaps what did not align."""
    done = None
    while True:

        def cut(batches: Iterator[pd.DataFrame], chunk: int = chunk, overlap: int = overlap) -> Iterator[pd.DataFrame]:
            for b in batches:
                for key, text in zip(b.key, b.text, strict=True):
                    starts = list(range(0, max(1, len(text) - overlap), chunk))
                    for i in range(0, len(starts), 64):
                        yield pd.DataFrame([(key, i + j, s, text[s : s + chunk + overlap] if s != starts[-1] else text[s:], s == starts[-1]) for j, s in enumerate(starts[i : i + 64])], columns=["key", "i", "at", "text", "last"])

        def encode(batches: Iterator[pd.DataFrame], chunk: int = chunk, overlap: int = overlap) -> Iterator[pd.DataFrame]:
            own, _ = encoder(path)
            for b in batches:
                out = []
                for key, i, at, text, last in zip(b.key, b.i, b["at"], b.text, b["last"], strict=True):
                    ids, start, end, head, tail = stable(text, i == 0, last, own)
                    show = lambda ks: [{"s": at + start[k], "e": at + end[k], "id": ids[k], "k": k} for k in ks]  # noqa: B023, E731
                    out.append((key, i, len(ids), last, show([k for k in head if end[k] <= overlap]), show([k for k in tail if end[k] >= chunk])))
                yield pd.DataFrame(out, columns=["key", "i", "n", "last", "head", "tail"])

        # equal texts have equal keys, so one chunk of each place is enough
        chunks = texts.mapInPandas(cut, "key string, i int, at long, text string, last boolean").groupBy("key", "i").agg(F.first("at").alias("at"), F.first("text").alias("text"), F.first("last").alias("last"))
        spans = saved(chunks.mapInPandas(encode, f"key string, i int, n long, last boolean, head {TOKEN}, tail {TOKEN}"))
        left = spans.where(~F.col("last")).select("key", (F.col("i") + 1).alias("i"), "tail")
        right = spans.where("i > 0").select("key", "i", "head")
        place = lambda c: F.transform(c, lambda t: F.struct(t.s, t.e, t.id))
        at = F.get(F.array_intersect(place("tail"), place("head")), F.lit(0))
        number = lambda c: F.get(F.filter(c, lambda t: (t.s == F.col("at.s")) & (t.e == F.col("at.e")) & (t.id == F.col("at.id"))), F.lit(0))["k"]
        splices = left.join(right, ["key", "i"]).withColumn("at", at).select("key", (number("tail") - number("head")).alias("n"), F.col("at").isNull().alias("apart"))
        ends = spans.where("last").select("key", "n", F.lit(False).alias("apart"))
        sums = saved(splices.unionByName(ends).groupBy("key").agg(F.sum("n").alias("n_tokens"), F.max("apart").alias("apart")))
        whole = sums.where("not apart").drop("apart")
        done = whole if done is None else done.unionByName(whole)
        apart = sums.where("apart").select("key")
        if apart.isEmpty():
            return done
        texts = texts.join(apart, "key", "left_semi")
        chunk, overlap = chunk * 8, overlap * 16


def token_counts(documents: DataFrame, path: str | None = None, most: int = MAX_TOKENS, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``most``) of each row of (doc_id, text)."""
    if not 2 * MARGIN < overlap < chunk:
        raise ValueError("the overlap must be over twice the margin and smaller than a chunk")
    path = path or vocabulary_path()
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    is_long = F.length("text") > chunk

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b.text.tolist()
            counts = [n for at in range(0, len(texts), 512) for n in count_in_place(texts[at : at + 512], path)]
            yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64"), "n_bytes": b.n_bytes, "n_tokens": counts})

    schema = "doc_id bigint, n_bytes long, n_tokens long"
    short = rows.where(~is_long).select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes")).mapInPandas(run, schema)
    keyed = rows.where(is_long).withColumn("key", F.sha2("text", 256))
    counts = count_long(keyed.select("key", "text"), path, chunk, overlap)
    long = keyed.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes")).join(counts, "key").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(long).withColumn("over_limit", F.col("n_tokens") > most)
