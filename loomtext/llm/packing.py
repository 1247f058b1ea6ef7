"""Best-fit packing of tokenized documents into training sequences.

Documents become token ids plus one separator; only those longer than a sequence are cut. Pieces are
dealt into blocks of bounded size, and each block is packed by vector best-fit: pieces in decreasing
size take, among the open sequences in which every capacity (tokens, documents, attention cost in whole
tiles) still holds, the one whose residual vector after the placement, each part a share of its capacity,
has the smallest weighted norm. A sequence holds MAX_DOCS pieces at most, and as many tiles as one full piece.

Edge cases: a null or empty text is one piece of one token (the separator); a null doc_id keeps its rows;
repeated rows are packed one by one; ties go to the sequence opened first; an empty table gives none.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

MAX_TOKENS = 2048
SEPARATOR = 0
MAX_DOCS = 32
TILE = 16
WEIGHTS = (1.0, 0.1, 0.1)  # of the residual tokens, documents and attention tiles, as shares of their capacities
BLOCK = 16_384
_ENCODERS: dict = {}


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str):
    """Byte-level BPE over the public vocabulary's ranks: the same ids as its ``byte_bpe_50k.json``, several times faster."""
    import public_tokenizers
    import tiktoken

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _ENCODERS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    return _ENCODERS[path]


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """Start and length of each piece: whole when it fits, else full pieces after a first one that takes the rest."""
    if n <= most:
        return [(0, n)]
    first = n % most
    return [(0, first)] * bool(first) + [(at, most) for at in range(first, n, most)]


PIECES = "doc_id bigint, piece int, start long, length long, ids_crc32 long"


def pieces(documents: DataFrame, path: str | None = None, most: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece, in one narrow pass; with_ids adds the ids themselves."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(path)
        for b in batches:
            out = []
            for doc_id, text in zip(b.doc_id, b.text, strict=True):
                # lone surrogates cannot come from Parquet, so every text has a UTF-8 form
                ids = own.encode_to_numpy(text or "", allowed_special="all").astype("<u4")
                ids = np.append(ids, np.uint32(SEPARATOR)).astype("<u4")
                for k, (at, n) in enumerate(cut(len(ids), most)):
                    part = ids[at : at + n]
                    out.append((doc_id, k, at, n, zlib.crc32(part.tobytes()), *([part.tolist()] if with_ids else [])))
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])
            frame["doc_id"] = frame.doc_id.astype("Int64")
            yield frame

    return documents.select("doc_id", "text").mapInPandas(run, PIECES + (", ids array<long>" if with_ids else ""))


def attention_cost(length: np.ndarray | int, tile: int = TILE) -> np.ndarray:
    """Attention tiles of a piece: tiles are square and whole, so a short piece costs more than its share."""
    return np.ceil(np.asarray(length) / tile) ** 2


def place(lengths: np.ndarray, max_tokens: int, max_docs: int, max_cost: float, tile: int = TILE, weights: tuple = WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """Vector best-fit: the sequence and offset of each piece."""
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    capacity, weights = np.array([max_tokens, max_docs, max_cost], dtype=np.float64), np.array(weights)
    needs = np.stack([lengths, np.ones(len(lengths)), attention_cost(lengths, tile)], axis=1)
    if (needs > capacity).any():
        raise ValueError(f"a piece of {lengths.max()} tokens exceeds the capacities {capacity.tolist()}")
    left = np.zeros((len(lengths), 3))
    where = np.zeros(len(lengths), dtype=np.int64)  # open sequences, in order of opening
    n_open = opened = 0
    smallest = needs.min(axis=0) if len(lengths) else capacity
    for i in order:
        rest = left[:n_open] - needs[i]
        fits = (rest >= 0).all(axis=1)
        if fits.any():
            k = int(np.where(fits, ((rest / capacity) ** 2) @ weights, np.inf).argmin())
        else:
            k = n_open
            where[k], left[k] = opened, capacity
            opened, n_open = opened + 1, n_open + 1
        sequence[i], offset[i] = where[k], max_tokens - int(left[k, 0])
        left[k] -= needs[i]
        if (left[k] < smallest).any():  # nothing fits any more
            where[k : n_open - 1], left[k : n_open - 1] = where[k + 1 : n_open].copy(), left[k + 1 : n_open].copy()
            n_open -= 1
    return sequence, offset


def pack(parts: DataFrame, max_tokens: int = MAX_TOKENS, max_docs: int = MAX_DOCS, max_cost: float | None = None, block: int = BLOCK) -> DataFrame:
    """Add sequence_id and offset to pieces. Full pieces take a sequence each; the rest is dealt evenly into blocks of about ``block``."""
    max_cost = float(attention_cost(max_tokens)) if max_cost is None else max_cost
    parts = saved(parts)
    n = parts.where(F.col("length") < max_tokens).count()
    blocks = max(1, round(n / block))
    # the content's checksum and the id deal copies and hot sources alike; equal rows may share a block
    rest = parts.where(F.col("length") < max_tokens).withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)).cast("long"))

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        sequence, offset = place(b.length.to_numpy(), max_tokens, max_docs, max_cost)
        return b.drop(columns="block").assign(sequence_id=(int(key[0]) << 32) + sequence, offset=offset)

    out = rest.groupBy("block").applyInPandas(run, f"{PIECES}, sequence_id long, offset long")
    full = parts.where(F.col("length") >= max_tokens).withColumns({"sequence_id": F.monotonically_increasing_id() + F.lit(1 << 60), "offset": F.lit(0).cast("long")})
    return out.unionByName(full)
