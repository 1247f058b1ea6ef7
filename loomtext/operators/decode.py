"""Ids back to text."""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LOWER_BAR, byte_alphabet, byte_decode_lossy, cleanup_spaces
from ..plans.options import Family
from .vocab import id_tokens


_BYTES = {c: b for b, c in enumerate(byte_alphabet())}
_ONE_BYTE = re.compile("<0x([0-9A-F]{2})>")


def token_bytes(token: str, family: Family) -> bytes:
    """What a token adds to its run's text: bytes of the byte alphabet, or text in which <0xNN> alone is one byte."""
    if family == Family.PIECES:
        one = _ONE_BYTE.fullmatch(token)
        return bytes([int(one[1], 16)]) if one else token.replace(LOWER_BAR, " ").encode("utf-8", "surrogatepass")
    if family == Family.WORD_END and token.endswith("</w>"):
        return token_bytes(token[:-4], Family.BYTE_LEVEL) + b" "
    return bytes(_BYTES[c] for c in token) if all(c in _BYTES for c in token) else token.encode("utf-8", "surrogatepass")


def _finished(text: Column, family: Family) -> Column:
    return F.trim(text) if family == Family.WORD_END else F.regexp_replace(text, "^ ", "") if family == Family.PIECES else text


def text_of(ids: Column, vocab: dict[str, int], family: Family, skip: Sequence[int] = ()) -> Column:
    """Text of arrays of ids: each id's bytes once, side by side, in one Arrow pass; broken UTF-8 becomes U+FFFD. Ids in skip are left out, a missing id is an error."""
    pairs = sorted(vocab.items(), key=lambda x: x[1])
    known, blobs = np.array([i for _, i in pairs], dtype=np.int64), [token_bytes(t, family) for t, _ in pairs]
    length = np.array([len(b) for b in blobs], dtype=np.int64)
    table, begin = np.frombuffer(b"".join(blobs), dtype=np.uint8), np.cumsum(length) - length
    left_out = np.array(sorted(skip), dtype=np.int64)

    @F.arrow_udf("binary")
    def run(rows: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        kept = ~np.isin(flat, left_out)
        at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        if (bad := kept & (known[at] != flat)).any():
            raise ValueError(f"no token has id {flat[bad][0]}")
        n = np.where(kept, length[at], 0)
        ends = np.concatenate(([0], np.cumsum(n)))
        data = table[np.repeat(begin[at] - ends[:-1], n) + np.arange(int(ends[-1]))]
        offsets = ends[np.concatenate(([0], np.cumsum(sizes)))].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])

    return _finished(F.make_valid_utf8(run(F.coalesce(ids, F.array()).cast("array<int>")).cast("string")), family)


def tokens_text(tokens: Column, family: Family) -> Column:
    """Text of a run of model tokens."""
    if family == Family.BYTE_LEVEL:
        return byte_decode_lossy(F.array_join(tokens, ""))
    if family == Family.WORD_END:
        return F.trim(F.replace(byte_decode_lossy(F.array_join(tokens, "")), F.lit("</w>"), F.lit(" ")))
    if family == Family.PIECES:
        byte = lambda t: F.when(t.rlike("^<0x[0-9A-F]{2}>$"), F.substring(t, 4, 2)).otherwise(F.hex(F.encode(F.replace(t, F.lit(LOWER_BAR), F.lit(" ")), "UTF-8")))
        return _finished(F.make_valid_utf8(F.unhex(F.array_join(F.transform(tokens, byte), "")).cast("string")), family)
    return F.array_join(tokens, " ")


def run_text(tokens: Sequence[str], family: Family) -> str:
    """The same of one run, for rows in which added tokens part the runs."""
    if family not in (Family.BYTE_LEVEL, Family.WORD_END, Family.PIECES):
        return " ".join(tokens)
    text = b"".join(token_bytes(t, family) for t in tokens).decode("utf-8", "replace")
    return text.strip(" ") if family == Family.WORD_END else text.removeprefix(" ") if family == Family.PIECES else text


def runs_text(rows: Column, family: Family, added: Sequence[str], spaces_between: bool = True, vocab: dict[str, int] | None = None, skip: Sequence[int] = ()) -> Column:
    """Runs of model tokens are detokenized together, added tokens stand alone. rows: arrays of tokens, or with a vocabulary of their ids, of which those in
    skip are left out and a missing one is an error. A worker holds one row's tokens at a time, beside the batch's ids and texts."""
    alone, blank = frozenset(added), " " if spaces_between else ""
    names, left_out = None if vocab is None else {i: t for t, i in vocab.items()}, frozenset(skip)

    def tokens_of_row(row: pa.Array) -> list[str]:
        if names is None:
            return row.to_pylist()
        try:
            return [names[i] for i in row.to_numpy(zero_copy_only=False).tolist() if i not in left_out]
        except KeyError as e:
            raise ValueError(f"no token has id {e.args[0]}") from None

    def text(row: list[str]) -> str:
        parts = [p for is_added, ts in itertools.groupby(row, alone.__contains__) for p in (ts if is_added else [run_text(list(ts), family)])]
        return blank.join(p for p in parts if p)

    @F.arrow_udf("string")
    def run(batch: pa.Array) -> pa.Array:
        values, n = batch.flatten(), pc.list_value_length(batch).to_pylist()
        ends = itertools.accumulate(n)
        return pa.array((text(tokens_of_row(values.slice(end - k, k))) for end, k in zip(ends, n, strict=True)), pa.string(), size=len(batch))

    return run(rows)


def decode(
    df: DataFrame, key: Sequence[str], ids: str, vocab: DataFrame | dict[str, int], family: Family = Family.BYTE_LEVEL, skip_ids: Sequence[int] = (), added: Sequence[str] = (),
    clean_up: bool = False, spaces_between: bool = True,
) -> DataFrame:
    """key and text, one row for each row. Runs of model tokens are detokenized together; added tokens stand alone; parts are joined by a blank if asked."""
    if isinstance(vocab, dict) and not added and family in (Family.BYTE_LEVEL, Family.WORD_END, Family.PIECES):
        text = text_of(F.col(ids), vocab, family, skip_ids)
        return df.select(*key, (cleanup_spaces(text) if clean_up else text).alias("text"))
    if isinstance(vocab, dict) and added:
        text = runs_text(F.coalesce(ids, F.array()).cast("array<int>"), family, added, spaces_between, vocab, skip_ids)
        return df.select(*key, (cleanup_spaces(text) if clean_up else text).alias("text"))
    tokens = id_tokens(df, key, ids, vocab, skip_ids)
    text = runs_text(F.col("tokens"), family, added, spaces_between) if added else tokens_text(F.col("tokens"), family)
    return tokens.select(*key, (cleanup_spaces(text) if clean_up else text).alias("text"))
