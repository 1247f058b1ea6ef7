"""Quality rules: a linear-chain conditional random field marks each line as content or boilerplate.

Fixed rules give the base verdict; for what passes them, Viterbi decoding labels the lines and the
share of words in content lines decides. The field is trained here, on all lines of a bounded sample of
labelled documents (``TRAIN_DOCS`` of them, copies once). Labels come by line: a line of a bad document is
boilerplate, one of a good document is content unless it stands in ``REPEATED`` or more different documents of
the sample (documents that consist mostly of such lines are near copies and don't count). Each bad document is
also joined to a good one at a known place, so that the field learns where labels change. Whether a line is one of
the sample's repeated lines is a feature. Scoring covers every line.

Edge cases: a null or empty text has no words and fails the base rule; a null doc_id keeps its row;
repeated rows each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_DOCS = 1200
REPEATED = 3
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
FEATURES = 14


def line_hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.strip()) - 2**63


def line_features(lines: list[str], known: frozenset = frozenset()) -> np.ndarray:
    """One row per line that has a word: shape, case, symbol, repetition and punctuation shares, and whether it is a known repeated line."""
    rows, seen = [], set()
    for line in lines:
        words = _WORD.findall(line)
        if not words:
            continue
        n, chars = len(words), len(line)
        upper = sum(map(str.isupper, words))
        symbols = chars - len(line.translate(_DROP))
        rows.append((
            1.0, min(n, 60) / 60, min(chars / n, 20) / 20, upper / n, symbols / chars * 5, 1.0 if symbols else 0.0,
            line.count("!") / n, len(set(words)) / n, 1.0 if line in seen else 0.0, 1.0 if line[-1] in ".?" else 0.0,
            1.0 if line[0].isupper() else 0.0, sum(map(line.count, "0123456789")) / chars, 1.0 if n < 4 else 0.0,
            1.0 if known and line_hash(line) in known else 0.0,
        ))
        seen.add(line)
    return np.array(rows, dtype=np.float64).reshape(len(rows), FEATURES)


_DROP = str.maketrans("", "", SYMBOLS)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def forward_backward(emit: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of padded sequences: each label's probability at each line, the expected number of each label pair, and log Z."""
    n, t = mask.shape
    alpha, beta = np.zeros((n, t, 2)), np.zeros((n, t, 2))
    alpha[:, 0] = emit[:, 0]
    for k in range(1, t):
        nxt = _lse(alpha[:, k - 1, :, None] + trans[None], 1) + emit[:, k]
        alpha[:, k] = np.where(mask[:, k, None] > 0, nxt, alpha[:, k - 1])
    for k in range(t - 2, -1, -1):
        nxt = _lse(trans[None] + (emit[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
        beta[:, k] = np.where(mask[:, k + 1, None] > 0, nxt, 0.0)
    z = _lse(alpha[:, -1], 1)
    node = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
    edge = np.exp(alpha[:, :-1, :, None] + trans[None, None] + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
    return node, edge.sum(axis=(0, 1)), z


def _padded(sequences: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features, mask and labels of sequences of like length together."""
    out, groups = [], {}
    for x, y in sequences:
        groups.setdefault(int(len(x)).bit_length(), []).append((x, y))
    for group in groups.values():
        t = max(len(x) for x, _ in group)
        x, mask, gold = np.zeros((len(group), t, FEATURES)), np.zeros((len(group), t)), np.zeros((len(group), t, 2))
        for i, (rows, labels) in enumerate(group):
            x[i, : len(rows)], mask[i, : len(rows)] = rows, 1
            gold[i, np.arange(len(rows)), labels] = 1
        out.append((x, mask, gold))
    return out


def train_crf(sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = 60, rate: float = 0.15, l2: float = 1e-3) -> dict:
    """Maximum likelihood of the label sequences by gradient ascent (Adam) with forward-backward sums."""
    sequences = [(x, y) for x, y in sequences if len(x)]
    w, trans = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    if not sequences:
        w[0, 1] = 1.0  # without labels every line counts as content
        return {"w": w, "trans": trans}
    batches = _padded(sequences)
    total, params = sum(m.sum() for _, m, _ in batches), [w, trans]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        grads = [-l2 * w, -l2 * trans]
        for x, mask, gold in batches:
            node, edge, _ = forward_backward((x @ w) * mask[:, :, None], mask, trans)
            grads[0] += np.einsum("ntf,nty->fy", x, gold - node) / total
            grads[1] += (np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:]) - edge) / total
        for p, g, a, b in zip(params, grads, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return {"w": w, "trans": trans}


def repeated_lines(docs: list[np.ndarray]) -> frozenset:
    """Hashes of lines in REPEATED or more documents, leaving out documents of which half of the lines or more are such lines."""
    counts = Counter(h for d in docs for h in set(d.tolist()))
    partial = [d for d in docs if len(d) and sum(counts[h] >= REPEATED for h in d.tolist()) < 0.5 * len(d)]
    counts = Counter(h for d in partial for h in set(d.tolist()))
    return frozenset(h for h, c in counts.items() if c >= REPEATED)


def training_sequences(docs: list[tuple[int, np.ndarray, np.ndarray]], known: frozenset) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and line labels of labelled documents (label, features, line hashes), and of bad ones set into good ones."""
    out: dict[int, list] = {0: [], 1: []}
    for label, x, hashes in docs:
        x = x.copy()
        x[:, -1] = [h in known for h in hashes.tolist()]
        out[label].append((x, np.where(x[:, -1] > 0, 0, label)))
    joined = []
    for i, (x, y) in enumerate(out[0]):
        if out[1]:
            gx, gy = out[1][i % len(out[1])]
            at = (i * 7919) % (len(gx) + 1)
            joined.append((np.concatenate((gx[:at], x, gx[at:])), np.concatenate((gy[:at], y, gy[at:]))))
    return out[0] + out[1] + joined


def viterbi(emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best 0/1 label sequence; a tie goes to content (1)."""
    (t00, t01), (t10, t11) = trans.tolist()
    s0 = s1 = 0.0
    back = []
    for k, (e0, e1) in enumerate(emit.tolist()):
        if k:
            f0, f1 = s1 + t10 >= s0 + t00, s1 + t11 >= s0 + t01
            s0, s1 = (s1 + t10 if f0 else s0 + t00) + e0, (s1 + t11 if f1 else s0 + t01) + e1
            back.append((f0, f1))
        else:
            s0, s1 = e0, e1
    state = s1 >= s0
    labels = [state]
    for step in reversed(back):
        state = step[state]
        labels.append(state)
    return np.array(labels[::-1], dtype=bool)


def repeated_words(words: list[str], width: int = 8) -> int:
    """Words inside windows of ``width`` words that occur twice or more, the first occurrence included."""
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered = end = 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered += i + width - max(i, end)
            end = i + width
    return covered


def assess(text: str | None, model: dict) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_content_lines, content_share."""
    text = text or ""
    words = _WORD.findall(text)
    n, lines = len(words), [x for x in text.split("\n") if _WORD.search(x)]
    repeat = repeated_words(words)
    failed = n < 20 or 100 * repeat > 30 * n
    labels = viterbi(line_features(lines, model["known"]) @ model["w"], model["trans"]) if lines else np.zeros(0, dtype=bool)
    sizes = np.array([len(_WORD.findall(x)) for x in lines], dtype=np.float64)
    share = float(sizes[labels].sum() / sizes.sum()) if lines else 0.0
    kept = not failed and share >= model["share"]
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat, failed, kept, len(lines), int(labels.sum()), share


SCHEMA = "doc_id bigint, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_content_lines long, content_share double"
_OUT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_content_lines", "content_share"]


def fit(documents: DataFrame, labels: DataFrame, min_share: float = 0.5) -> dict:
    """Train the field on TRAIN_DOCS labelled documents, chosen by the hash of their ids."""
    sample = (
        labels.select(F.col("doc_id").alias("label_id"), F.col("quality").alias("label"))
        .where("label_id is not null and label is not null")
        .groupBy("label_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("label_id"), "label_id").limit(TRAIN_DOCS)
    )
    texts = documents.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).where("text is not null").select("doc_id", "text", "label")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lines = [[x for x in t.split("\n") if _WORD.search(x)] for t in b.text]
            yield pd.DataFrame({"doc_id": b.doc_id, "label": b.label, "x": [line_features(x).ravel().tolist() for x in lines], "h": [list(map(line_hash, x)) for x in lines], "name": [xxhash.xxh3_64_intdigest(t) - 2**63 for t in b.text]})

    got = texts.mapInPandas(features, "doc_id bigint, label int, x array<double>, h array<long>, name long").orderBy("doc_id", "name").collect()
    docs = {r.name: (int(r.label > 0), np.array(r.x).reshape(-1, FEATURES), np.array(r.h, dtype=np.int64)) for r in got}
    known = repeated_lines([h for _, _, h in docs.values()])
    return train_crf(training_sequences(list(docs.values()), known)) | {"share": min_share, "known": known}


def quality_rules(documents: DataFrame, model: dict) -> DataFrame:
    """One row of measures and the verdict per document; one narrow pass, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([assess(x, model) for x in b.text], columns=_OUT)
            out.insert(0, "doc_id", b.doc_id.to_numpy())
            yield out

    return documents.select("doc_id", "text").mapInPandas(run, SCHEMA)


def keep_good(documents: DataFrame, model: dict) -> DataFrame:
    """The documents that the verdict keeps, columns unchanged; the filter runs beside each row, without a join."""

    @F.pandas_udf("boolean")
    def verdict(texts: pd.Series) -> pd.Series:
        return pd.Series([assess(x, model)[6] for x in texts], dtype=bool)

    return documents.where(verdict(F.col("text")))
