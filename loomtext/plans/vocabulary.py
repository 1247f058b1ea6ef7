"""The vocabulary of the registered queries: bytes, the first merges of a public merge table, special tokens."""

from __future__ import annotations

from functools import cache

from ..functions.text import byte_alphabet
from ..operators.bpe import check_fold
from ..sources.files import read_tokenizer_json

MERGES = 200
UNK, BOS, EOS, PAD = "<unk>", "<|startoftext|>", "<|endoftext|>", "<pad>"


def public_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def public_vocabulary(path: str | None = None) -> tuple[dict[str, int], dict[tuple[str, str], int]]:
    vocab, merges = read_tokenizer_json(path or public_file())
    return vocab, {m: r for r, m in enumerate(merges)}


@cache
def small_merges(path: str | None = None, n: int = MERGES) -> tuple[tuple[str, str], ...]:
    merges = tuple(read_tokenizer_json(path or public_file())[1][:n])
    check_fold(merges, byte_alphabet())
    return merges


@cache
def small_vocab(path: str | None = None, n: int = MERGES) -> dict[str, int]:
    tokens = [*byte_alphabet(), *(a + b for a, b in small_merges(path, n)), UNK, BOS, EOS, PAD]
    return {t: i for i, t in enumerate(tokens)}
