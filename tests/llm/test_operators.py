"""Each operator against a brute-force version, and on nulls, empties, repeats, clashing columns and empty tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import string
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomtext.llm import common, decontam, hard_negatives, html_text, langid, line_dedup, lm_score, ngram_join, packing, phrases, quality, secret_scan, suffix_dedup, token_count

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, lang="en"):
    rows = [(i if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1], lang, "s", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def written(spark, make):
    """The part files of each table that make() leaves in the shared folder, on a session whose shuffles keep all their partitions."""
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, had = set(root.iterdir()), {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        out = make()
    finally:
        for k, v in had.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return out, [len(list(p.glob("part-*.parquet"))) for p in set(root.iterdir()) - before]


def sentence(rng, n):
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ne", "ru", "ta", "so"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


EDGE = [None, "", " \n\t ", "word", "word", (7, "same row"), (7, "same row"), (7, "other text of the row"), (None, "no id"), (None, None), "x" * 5000, "é ñ 中文 😀 end", "a\n\nb\na\n"]


@pytest.fixture(scope="module")
def edge(spark):
    names = "id_ key key_ k1 k2 first line n dk sig row_ dk_ hit_id keep_id drop_ln kept pos word_ label label_id h f w a b".split()
    return frame(spark, EDGE).select("*", *[F.lit("clash").alias(x) for x in names])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(6)] + [(None, 1, 0), (3, None, 0), (3, 1, 0)], "doc_id bigint, quality int, toxic int")


def ids(df):
    return sorted((r.doc_id for r in df.collect()), key=str)


ALL_IDS = sorted((i if not isinstance(t, tuple) else t[0] for i, t in enumerate(EDGE)), key=str)


# --- op1 -------------------------------------------------------------------------------------------------------

def test_suffix_array_sorts():
    rng = random.Random(5)
    for _ in range(400):
        s = [rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(1, 40))] + [0]
        assert suffix_dedup.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), dtype=bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(r, dtype=np.uint8)[~gone])
        out.append((len(r), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1500, 2])
def test_suffix_dedup_is_exact(spark, hot):
    rng = random.Random(hot)
    shared = [sentence(rng, 80) for _ in range(3)]
    texts = [sentence(rng, rng.randint(5, 60)) + rng.choice(["", *shared]) + rng.choice("xyz") + rng.choice(["", *shared])[rng.randint(0, 60) :] + sentence(rng, 20) for _ in range(60)]
    texts += [texts[0], texts[0], "a" * 900, None, "", "ab" * 300, shared[0][:399], shared[1][:400], shared[1][:200] + "é" + shared[1][200:]]
    got = suffix_dedup.suffix_dedup(frame(spark, texts), hot=hot).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute_repeats(texts, 400)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.starts) == r.n_spans for r in got)


def test_shared_passages_shorter_than_the_cut_are_told(spark):
    passage = " ".join(["on"] * 51)
    texts = [f"a\n{passage}\nb", f"c\n{passage}", f"{passage}\n{passage}x", "d\n" + " ".join(["on"] * 50), "e\n" + " ".join(["on"] * 50), None, ""]
    rows = suffix_dedup.suffix_dedup(frame(spark, texts)).orderBy("doc_id").collect()
    assert [r.repeats for r in rows] == [True, True, True, False, False, False, False] and not any(r.n_removed for r in rows)


def test_shared_passages_within_lines_are_told(spark):
    """A passage of 51 words that is no line of its own, over a line break in one text and doubled spaces in another, counts; 50 words do not, nor does a text's own repetition."""
    rng = random.Random(51)
    words = [f"w{i}" for i in range(51)]
    fill = ["".join(rng.choice(string.ascii_lowercase) for _ in range(5)) for _ in range(600)]
    p, a = " ".join(words), lambda i: " ".join(fill[i * 60 : i * 60 + 60])
    own = " ".join(fill[540:595])
    texts = [f"{a(0)} {p} tail", f"{a(1)} " + "\n".join(words), f"{a(2)} {'  '.join(words[1:])} x", f"{own}\n{own}", (4, f"{a(4)} row"), (4, f"{a(4)} row"), None]
    rows = suffix_dedup.suffix_dedup(frame(spark, texts)).orderBy("doc_id").collect()
    assert [r.repeats for r in rows] == [True, True, False, False, False, False, False]
    assert not any(r.n_removed for r in rows)


def test_shared_passages_equal_brute_force(spark):
    rng = random.Random(8)
    pool = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(40, 70))] for _ in range(30)]
    texts = [" ".join(w for _ in range(rng.randint(1, 2)) for w in [*rng.choice(pool)[rng.randint(0, 30) :], f"own{i}"]) for i in range(60)]
    runs = [{tuple(w[i : i + 51]) for i in range(len(w) - 50)} for w in map(str.split, texts)]
    want = {i for i, own in enumerate(runs) if any(own & runs[j] for j in range(60) if j != i)}
    keyed = frame(spark, texts).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("dk"))
    got = suffix_dedup.repeated_passages(keyed).join(keyed, F.col("passage_dk") == F.col("dk"))
    assert 0 < len(want) < 60 and ids(got) == sorted(want, key=str)


def test_narrow_tables_of_suffix_dedup_have_few_files_whatever_the_partitions(spark):
    """Anchors, segments and lists of some hundred rows had a file for each partition of a shuffle; several frames of a batch keep every row."""
    rng = random.Random(40)
    shared = sentence(rng, 200)
    texts = [sentence(rng, 300) + shared + sentence(rng, 300) for _ in range(400)] + [None, ""]
    rows, files = written(spark, lambda: suffix_dedup.suffix_dedup(frame(spark, texts).coalesce(1)).orderBy("doc_id").collect())
    assert [r.doc_id for r in rows] == list(range(402)) and [r.n_bytes for r in rows] == [len(t or "") for t in texts]
    assert all(r.repeats and r.n_removed >= len(shared) and hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in rows[:400])
    assert sum(n > 8 for n in files) <= 2  # bodies and spans, which hold bytes and whole suffix arrays


def test_suffix_dedup_joins_texts_once_for_all_it_asks_of_them(spark, monkeypatch):
    """Segments' bytes and runs of words were asked for by two joins with the texts, the second one in a shuffle on large tables alone, so that disk outgrew the input."""
    plans = []
    monkeypatch.setattr(suffix_dedup, "saved", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or common.saved(df))
    rng = random.Random(23)
    shared, passage = sentence(rng, 90), " ".join(rng.choice("abcdefgh") for _ in range(60))
    texts = [f"{sentence(rng, 70)} {shared} {sentence(rng, 9)}", f"{sentence(rng, 80)} {shared}", f"x {passage} y", f"{sentence(rng, 30)} {passage[8:]}", None, ""]
    twice = (1, texts[1])  # a row that stands twice with its id
    rows = suffix_dedup.suffix_dedup(frame(spark, [*texts, twice])).orderBy("doc_id").collect()
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)
    assert got == sorted(brute_repeats([*texts, texts[1]], 400)) and [r.repeats for r in rows] == [True] * 5 + [False] * 2
    assert sum("Join" in p and "text#" in p for p in plans) == 1


def test_words_of_bytes_have_hashes_by_their_content():
    rng = random.Random(77)
    texts = ["".join(rng.choice(["a", "b", "é", "中", " ", "\n", "\v", "\x85", "\u00a0", "\t "]) for _ in range(rng.randint(0, 60))).encode() for _ in range(300)] + [b"", b" ", b"z" * 700, b"z" * 700 + b" ", b"a" * 200_000]
    sizes, h = suffix_dedup.word_hashes(texts)
    words = [w for t in texts for w in t.split()]
    assert sizes.tolist() == [len(t.split()) for t in texts] and len(set(zip(words, h.tolist(), strict=True))) == len(set(words)) == len(set(h.tolist()))
    of, window, anchor, _ = suffix_dedup.passage_windows(texts, 5)
    runs = [(n, tuple(w[i : i + 5])) for n, w in enumerate(map(bytes.split, texts)) for i in range(len(w) - 4)]
    assert of.tolist() == [n for n, _ in runs]
    distinct = {r for _, r in runs}
    assert len({(r, w, a) for (_, r), w, a in zip(runs, window.tolist(), anchor.tolist(), strict=True)}) == len(distinct) == len(set(window.tolist()))


def test_equal_windows_have_equal_anchors_wherever_they_stand():
    rng = random.Random(32)
    window = "".join(rng.choice("ab") for _ in range(600)).encode()
    places = set()
    for lead in (0, 1, 999, 70_000):
        text = "".join(rng.choice("ab") for _ in range(lead)).encode() + window + b"tail" * rng.randint(0, 9)
        pos, h = suffix_dedup.anchors(np.frombuffer(text, dtype=np.uint8))
        at = pos[lead : lead + 201]
        assert all(i <= p <= i + 368 for i, p in zip(range(lead, lead + 201), at.tolist(), strict=True))
        places.add((*(at - lead).tolist(), *h[at].tolist()))
    assert len(places) == 1


def test_suffix_dedup_edges(spark, edge):
    assert ids(suffix_dedup.suffix_dedup(edge)) == ALL_IDS
    assert suffix_dedup.suffix_dedup(edge.limit(0)).count() == 0


# --- op2 -------------------------------------------------------------------------------------------------------

def test_lm_score_base_and_model(spark):
    rng = random.Random(2)
    texts = [sentence(rng, rng.randint(0, 30)).title() for _ in range(80)] + [None, "zzz unseen Ünseen", "a b\n c"]
    got = {r.doc_id: r for r in lm_score.score(frame(spark, texts)).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))}
    tokens = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for t in texts]
    c = Counter(w for i, t in enumerate(tokens) if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(tokens):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        assert r.score < 0


def test_lm_beats_the_base_on_held_out_documents(spark):
    got = lm_score.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_automaton_equals_the_formula_and_sums_to_one(spark):
    rng = random.Random(5)
    texts = [sentence(rng, rng.randint(0, 12)) for _ in range(120)] + ["so so so ka", None, "so\x00so so \x00", "so\x00so so \x00"]
    train = [WORD.findall(t or "") + [""] for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    one = Counter(w for t in train for w in t)
    two = Counter(p for t in train for p in zip(["", *t], t, strict=False))
    three = Counter(p for t in train for p in zip(["", *t], t, t[1:], strict=False))
    n, v = sum(one.values()), len(one)

    def p(u, h, w):
        top = (one[w] + 0.5) / (n + 0.5 * (v + 1))
        low = (two[h, w] + lm_score.PRIOR[1] * top) / (one[h] + lm_score.PRIOR[1])
        return low if u is None else (three[u, h, w] + lm_score.PRIOR[2] * low) / (two[u, h] + lm_score.PRIOR[2])

    for u, h in [*list(two)[:20], (None, "so"), ("never", "so"), ("so", "never")]:
        if h:
            assert sum(p(u, h, w) for w in [*one, "unseen"]) == pytest.approx(1)
    for settings in ({}, {"chunk_bytes": 300, "bucket_bytes": 100}):  # the same in one chunk and in many
        for r in lm_score.score(frame(spark, texts), **settings).collect():
            t = WORD.findall(texts[r.doc_id] or "") + [""]
            want = sum(math.log10(p(u, h, w)) for u, h, w in zip([None, "", *t], ["", *t], t, strict=False))
            assert r.score == pytest.approx(want)
            assert r.n_known == sum(one[w] > 0 for w in t)


def test_lm_counts_above_one_byte(spark):
    rows = lm_score.score(frame(spark, ["aa bb " * 400, "aa bb", "cc"] * 9), chunk_bytes=2000).collect()
    held = sum(zlib.crc32(str(i).encode()) % 5 != 1 for i in range(27))
    assert rows[0].train_tokens > 255 and held and all(r.n_known == r.n_tokens for r in rows)


def test_lm_edges(spark, edge):
    assert ids(lm_score.score(edge)) == ALL_IDS
    assert lm_score.score(edge.limit(0)).count() == 0


# --- op3 -------------------------------------------------------------------------------------------------------

def test_packing_pieces_and_bins(spark):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    texts = [sentence(rng, rng.choice([3, 50, 400, 2500])) for _ in range(40)] + [None, "", "<|endoftext|> x", "é中😀"]
    df = frame(spark, texts)
    got = packing.pack(packing.pieces(df)).orderBy("doc_id", "piece").collect()
    lib = Tokenizer.from_file(packing.vocabulary_path("byte_bpe_50k.json"))
    by, bins = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        want = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        assert sum(r.length for r in by[i]) == len(want)
        at = 0
        for k, r in enumerate(by[i]):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(np.array(want[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert all(r.length == 2048 for r in by[i][1:]) and (len(by[i]) == 1 or by[i][0].length <= 2048)
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r.length for r in got)
    assert len(bins) <= 1.1 * total / 2048 + 1


def test_vector_capacities_hold():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 700, 400)
    seq, off = packing.place(lengths, 1000, 4, 600_000.0, tile=1)
    for s in np.unique(seq):
        own, at = lengths[seq == s], off[seq == s]
        assert own.sum() <= 1000 and len(own) <= 4 and (own.astype(float) ** 2).sum() <= 600_000
        order = np.argsort(at)
        assert (at[order] == np.cumsum(own[order]) - own[order]).all()


def test_each_production_capacity_binds(spark):
    def sequences(lengths):
        found = packing.pack(spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], packing.PIECES))
        return sorted(r["count"] for r in found.groupBy("sequence_id").count().collect())

    assert sequences([1024, 1025]) == [1, 1]  # tokens
    assert sequences([1] * 40) == [8, 32]  # documents
    assert sequences([2040, 3]) == [1, 1]  # attention: 2040 tokens fill all tiles
    assert sequences([2000, 3]) == [2]


def test_ids_are_those_of_the_named_library(spark):
    """The ids come from another library over the same vocabulary: hold them against the named one on texts of all kinds."""
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(12)
    alphabets = ["ab ", "  \n\t\r\x0b\x0c\u00a0\u2003\u3000", "don't we'll I'M 'S 'd ", "0123456789 ,.", "éüßñçÀ ", "中文日本語한국어 ", "😀👍🏽\u200d\ufe0f ", "\x00\x01\x7f\x80\x85\ufffd\ufeff ", "e\u0301\u0327 ", "ⅧⅷⅠ²½٣९ ", "<|endoftext|> ", "אבג ابج हिन्दी ไทย "]
    texts = ["".join(rng.choice("".join(rng.sample(alphabets, rng.randint(1, 3)))) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["<|endoftext|>", "a<|endoftext|>b <|endoftext|> <|endoftext", " <|endoftext|>\n\n"] + [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    named, own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder(packing.vocabulary_path())
    for text, want in zip(texts, named.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.encode(text, allowed_special="all") == want.ids, repr(text)


def test_vector_capacity_errors():
    with pytest.raises(ValueError):
        packing.place(np.array([900]), 1000, 4, 10.0)


def test_packing_edges(spark, edge):
    assert ids(packing.pack(packing.pieces(edge)).where("piece = 0")) == ALL_IDS
    assert packing.pack(packing.pieces(edge.limit(0))).count() == 0


# --- op4 -------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize(("html", "want"), [
    (None, None), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\n\nb"), ("a<br>b", "a\nb"), ("<div>a</div>b", "a\nb"),
    ("x<script>y</script><style>z</style><span hidden>h</span><b style='display: none'>n</b>w", "xw"),
    ("<ul><li>a<li>b<ol><li>x<li>y</ol><li>c</ul>", "- a\n- b\n  1. x\n  2. y\n- c"), ("<ol start=3><li>a<li>b</ol>", "3. a\n4. b"),
    ("<table><tr><th>Name<th>Q<tr><td>apple<td>3</table>", "Name  | Q\napple | 3"), ("<table><tr><td><p>a</p><p>b</p></table>", "a\n\nb"),
    ("<pre>  k\n   t</pre>", "  k\n   t"), ("a &amp; b&nbsp;c &lt;", "a & b c <"), ("<title>t</title><p>x</p>", "x"), ("<b>bold</b>text <i> it </i>", "boldtext it"), ("</p></div>x<<y", "x<<y"),
    ("<head><title>t</title><body>x", "x"), ("<dl><dt>a<dd>b<dt>c</dl>", "a\nb\nc"),
])
def test_html(html, want):
    assert html_text.extract(html) == want


@pytest.mark.parametrize(("html", "want"), [
    ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> holds</p>", "so x=2 holds"),
    ("a<svg><title>t</title><desc>d</desc><defs><text>n</text></defs>raw<circle r='1'/><text>one</text><text>t<tspan>wo</tspan></text></svg>b", "a one two b"),
    ("<svg><defs/><text>shown</text><text display='none'>n</text><text visibility='hidden'>h</text></svg>", "shown"),
    ("<svg><foreignObject><p>x<br/>y</p></foreignObject></svg>", "x\ny"),
    ("a<div style='visibility:hidden'>b<br><span style='color:red; visibility: visible'>c</span><img alt=d><i>e</i></div>f", "a\nc\nf"),
    ("<div style='display:none'>a<b style='visibility:visible'>b</b></div>c", "c"),
    ("<table><tr><td>a<td>b<tr style='visibility:hidden'><td>c<td>d</table>", "a | b"),
    ("<table style='visibility:collapse'><tr><td>a<td>b<tr><td>c<td style='visibility:visible'>d</table>", " | d"),
])
def test_html_formulas_figures_and_visibility(html, want):
    assert html_text.extract(html) == want


def test_html_deep_and_frames(spark):
    assert html_text.extract("<div>" * 30000 + "x") == "x"
    df = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None)], "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in html_text.extract_text(df).collect()) == sorted([("1", "a", 1), ("1", "a", 1), ("None", None, None)], key=str)
    assert html_text.extract_text(df.limit(0)).count() == 0


# --- op5 -------------------------------------------------------------------------------------------------------

def test_language_id_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.identify(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 30 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_language_id_does_not_depend_on_chunks(spark):
    rng = random.Random(8)
    rows = [(i, sentence(rng, 12) + (" el gato" if i % 2 else " the cat"), ("en", "es")[i % 2], "s", 0) for i in range(60)] + [(60, "gato unseen", None, "s", 0), (61, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = {r.doc_id: (r.lang_pred, pytest.approx(r.score)) for r in langid.identify(docs, langid.fit(docs)).collect()}
    cut = langid.fit(docs, chunk_chars=300, bucket_chars=500)
    other = docs.select("*")  # read again, beside the model's chunks
    for got in (langid.identify(docs, cut), langid.identify(other, cut, chunk_chars=700)):
        assert {r.doc_id: (r.lang_pred, r.score) for r in got.collect()} == want


def test_language_id_of_long_texts(spark, monkeypatch):
    """A text read in slices, one word of many letters, and counts that need more than a byte give what short ones give."""
    rows = [(i, t, x, "s", 0) for i, (t, x) in enumerate([("the cat sat", "en"), ("el gato come", "es")] * 20)]
    rows += [(100, "the cat " * 5000 + "gato", None, "s", 0), (101, "gato " * 200_000, None, "s", 0), (102, "x" * 200_000 + "gat", None, "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert [want[i][0] for i in (100, 101)] == ["en", "es"] and want[101][1] == pytest.approx(1)
    texts = ["Ab cd\x1cé  " * 9 + "y" * 30, "", " ", "ab ab-cd7y", "7"]
    for size in (3_000_000, 7):
        monkeypatch.setattr(langid, "_SLICE", size)
        words, text, word, n = langid._pairs(texts)
        assert Counter({(i, words[w]): c for i, w, c in zip(text, word, n, strict=True)}) == {(i, w): c for i, t in enumerate(texts) for w, c in Counter(langid.words_of(t)).items()}
    for x in (np.zeros(0, dtype=np.int64), np.array([0, 255]), np.array([70_000, 1]), np.array([2**40]), np.array([0.5, -1e300]), np.zeros(0)):
        assert (langid._unpack(langid._pack(x)) == x).all()


def test_language_id_keeps_the_ngrams_of_a_rare_language(spark):
    rng = random.Random(9)
    train = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, sentence(rng, 30), "en", "s", 0) for i in train[:-2]] + [(i, "qxqxq wyqyw", "qq", "s", 0) for i in train[-2:]] + [(1000, "xqxqxqx", None, "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert langid.identify(docs, langid.fit(docs)).where("doc_id = 1000").first().lang_pred == "qq"


def test_letters_are_those_of_unicode():
    import unicodedata

    for c in map(chr, range(0x110000)):
        assert bool(langid.words_of(c)) == any(unicodedata.category(x)[0] == "L" for x in c.lower()), hex(ord(c))


def test_unseen_words_back_off_to_shorter_ngrams(spark):
    """The whole prediction against a plain version: known words by their shares, others by the longest known n-grams."""
    rng = random.Random(9)
    texts = {"xx": [" ".join(rng.choice(["kala", "milo", "sonu"]) for _ in range(6)) for _ in range(30)], "yy": [" ".join(rng.choice(["brot", "trug", "kalt"]) for _ in range(6)) for _ in range(30)]}
    rows = [(i, t, lang, "s", 0) for i, (lang, t) in enumerate((x, t) for x in texts for t in texts[x])] + [(100, "kalami bro zz", None, "s", 0), (101, "trugbrot milos", None, "s", 0)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, SCHEMA), langid.fit(spark.createDataFrame(rows, SCHEMA))).collect()}
    words, grams = defaultdict(Counter), defaultdict(Counter)
    for i, t, lang, *_ in rows:
        if lang and zlib.crc32(str(i).encode()) % 3 != 1:
            words[lang].update(t.split())
    for lang, c in words.items():
        for w, n in c.items():
            for order in langid.ORDERS:
                for g in langid.grams_of(w, order):
                    grams[lang, order][g] += n
    kinds = {o: len({g for x in words for g in grams[x, o]}) for o in langid.ORDERS}
    every = {w for x in words for w in words[x]}

    def share(n, total, kinds):
        return math.log((n + 0.1) / (max(total, 1) + 0.1 * (kinds + 1)))

    def value(w, lang):
        if w in every:
            return share(words[lang][w], sum(words[lang].values()), len(every))
        marked, out = f"^{w}$", []
        for i in range(len(marked)):
            for o in langid.ORDERS:
                g = marked[i : i + o]
                if len(g) == o and any(g in grams[x, o] for x in words):
                    out.append(share(grams[lang, o][g], sum(grams[lang, o].values()), kinds[o]))
                    break
        return sum(out) / len(out) if out else 0.0

    for doc_id, text in ((100, "kalami bro zz"), (101, "trugbrot milos")):
        s = {x: sum(value(w, x) for w in text.split()) for x in words}
        best = max(s, key=s.get)
        assert got[doc_id].lang_pred == best and got[doc_id].score == pytest.approx(1 / sum(math.exp(v - s[best]) for v in s.values()))


def test_language_id_edges(spark, edge):
    got = langid.identify(edge, langid.fit(edge))
    assert ids(got) == ALL_IDS
    assert {r.lang_pred for r in got.where("doc_id in (0, 1, 2)").collect()} == {"und"}
    none = edge.limit(0)
    assert langid.identify(edge, langid.fit(none)).where("lang_pred <> 'und'").count() == 0 and langid.identify(none, langid.fit(none)).count() == 0


# --- op6 -------------------------------------------------------------------------------------------------------

def brute_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w = words(text)
    hit, found = set(), set()
    for item_id, item in items:
        x = words(item)
        n = min(len(x), 10)
        for g in {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else ():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == g:
                    hit |= set(range(i, i + n))
                    found.add(str(item_id))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination_is_exact(spark):
    rng = random.Random(6)
    items = [(i, sentence(rng, rng.choice([1, 3, 9, 10, 11, 25]))) for i in range(12)] + [(12, None), (13, "..."), (3, sentence(rng, 14))]
    texts = [sentence(rng, 30) + rng.choice(" .-") + (items[rng.randrange(12)][1].upper() if rng.random() < 0.7 else "") + ", " + sentence(rng, 10) for _ in range(60)] + [None, "", items[8][1], items[8][1]]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontam.contamination(frame(spark, texts), bench).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got] == [brute_hits(t, items) for t in texts]
    clean = decontam.clean(frame(spark, texts), bench)
    assert sorted(r.doc_id for r in clean.collect()) == [i for i, t in enumerate(texts) if not brute_hits(t, items)[4]]


def test_decontamination_edges(spark, edge):
    bench = spark.createDataFrame([(1, "word"), (None, "no id")], "item_id bigint, text string")
    got = decontam.contamination(edge, bench)
    assert ids(got) == ALL_IDS and {r.n_hit for r in got.where("doc_id in (3, 4)").collect()} == {1}
    assert ids(decontam.clean(edge, bench.limit(0))) == ALL_IDS and decontam.clean(edge, bench).columns == edge.columns
    assert decontam.contamination(edge.limit(0), bench).count() == 0


# --- op7 -------------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_base(text):
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_secret_spans(spark, labels):
    secret = "q7Xz9Lk2Vb5Nc8Wd1Rf4"
    texts = [f'é password = "{"a" * 6}" Token:short api_key=\'x.y-z+1\'', "AKIA" + "A1" * 9 + " AKIAshort", "f" * 30 + " " + "0" * 23, None, "", f"key {secret}{secret} end", "the ordinaryidentifierofwordsthattalk end", "secret: token: abcdefgh", "😀 TOKEN=\"" + "ab" * 20 + '"']
    df = frame(spark, texts)
    train = frame(spark, ["the ordinary identifiers of words that talk about another thing and further matters " * 5] * 6)
    got = secret_scan.scan(df, secret_scan.fit(train, labels)).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        base = brute_base(t)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(filter(None, r.spans.split(",")))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(base.count(k) for k in ("assign", "access", "hex"))
    assert "markov:4:44" in got[5].spans and got[6].spans == ""


def test_secret_edges(spark, edge, labels):
    model = secret_scan.fit(edge, labels)
    assert ids(secret_scan.scan(edge, model)) == ALL_IDS and secret_scan.scan(edge.limit(0), model).count() == 0
    assert secret_scan.fit(edge.limit(0), labels.limit(0))["threshold"] == secret_scan.THRESHOLD


def test_secrets_beyond_the_patterns(spark):
    """Held-out random keys of every length are found, held-out identifiers are not; the ratio is the models' sum over transitions."""
    docs, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = secret_scan.fit(docs, lab)
    assert model["recall"] > 0.99 and model["false_alarms"] < 0.001
    rng = random.Random(21)
    keys = ["".join(rng.choices(string.ascii_letters + string.digits, k=n)) for n in range(secret_scan.MIN_TOKEN, 60)]
    plain = ["thenameofthisfield", "numberOfOpenConnections", "src/main/resources/config", "max_retry_count_2", "long-running-process", "2024-05-17-report", "HTTP_REQUEST_TIMEOUT"]
    for group, share in ((keys, 0.95), (plain, 0.0)):
        text = "start " + " . ".join(group) + " end"
        spans = secret_scan.scan(frame(spark, [text]), model).first().spans
        found = {text[int(s) : int(e)] for _, s, e in (x.split(":") for x in filter(None, spans.split(",")))}
        assert found <= set(group) and len(found) >= share * len(group) and (share or not found)
    token, ratios = keys[9], model["ratios"]
    want = sum(ratios[ord(a) * 128 + ord(b)] for a, b in itertools.pairwise(token))
    assert spark.range(1).select(F.expr(secret_scan._ratio(f"'{token}'", ratios))).first()[0] == pytest.approx(want)


def test_a_wide_span_over_a_base_span_stays_and_a_covered_one_goes(spark, labels):
    model = {"ratios": [1.0] * 128 * 128, "threshold": 4.0}
    run = "0123456789abcdef" * 2
    got = secret_scan.scan(frame(spark, [f"ZZZZ{run}ZZZZ", f"token={run}"]), model).orderBy("doc_id").collect()
    assert got[0].spans == "markov:0:40,hex:4:36" and got[1].spans == "assign:0:38,hex:6:38"


def test_long_tokens_and_many_matches_take_time_in_proportion(spark):
    model = {"ratios": [1.0] * 128 * 128, "threshold": 4.0}
    rows = secret_scan.scan(frame(spark, ["a1B2" * 50_000, "key_ab12CD34ef56 " * 20_000, "password=abcdef " * 20_000]), model).orderBy("doc_id").collect()
    assert [(r.n_assign, r.n_markov) for r in rows] == [(0, 1), (0, 20_000), (20_000, 0)]
    assert rows[2].spans.endswith(f"assign:{16 * 19_999}:{16 * 20_000 - 1}")


# --- op8 -------------------------------------------------------------------------------------------------------

def brute_quality(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    c = Counter(windows)
    rep = len({j for i, x in enumerate(windows) if c[x] > 1 for j in range(i, i + 8)})
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), sum(x in lines[:i] for i, x in enumerate(lines)), rep, len(w) < 20 or 100 * rep > 30 * len(w)


def test_quality_base(spark, labels):
    rng = random.Random(8)
    line = sentence(rng, 9)
    texts = [sentence(rng, 40), "\n".join([line] * 6), "# a | b\n\n" * 12, None, "", " \n ", line + " x " + line, sentence(rng, 25) + " " + line + "\n" + line]
    df = frame(spark, texts)
    got = quality.quality_rules(df, quality.fit(df, labels)).orderBy("doc_id").collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got] == [brute_quality(t) for t in texts]
    assert not any(r.kept and r.base_failed for r in got)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    for _ in range(50):
        emit, trans = rng.normal(size=(5, 2)), rng.normal(size=(2, 2))
        value = lambda p: sum(emit[i, x] for i, x in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        best = max(np.ndindex(2, 2, 2, 2, 2), key=value)
        assert tuple(quality.viterbi(emit, trans).astype(int)) == best


def test_quality_on_labels(spark, sf):
    docs, lab = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, lab)
    got = quality.quality_rules(docs, model).join(lab, "doc_id").where("not base_failed").collect()
    assert sum((r.quality == 1) == r.kept for r in got) / len(got) > 0.95
    assert ids(quality.keep_good(docs, model)) == ids(quality.quality_rules(docs, model).where("kept"))


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(4)
    emit, trans = rng.normal(size=(2, 5, 2)), rng.normal(size=(2, 2))
    mask = np.array([[1.0] * 5, [1.0] * 3 + [0.0] * 2])
    node, edge, z = quality.forward_backward(emit * mask[:, :, None], mask, trans)
    want_edge = np.zeros((2, 2))
    for i, n in enumerate((5, 3)):
        paths = list(itertools.product((0, 1), repeat=n))
        weight = np.array([np.exp(sum(emit[i, k, y] for k, y in enumerate(p)) + sum(trans[a, b] for a, b in itertools.pairwise(p))) for p in paths])
        assert z[i] == pytest.approx(math.log(weight.sum()))
        for p, w in zip(paths, weight / weight.sum(), strict=True):
            for a, b in itertools.pairwise(p):
                want_edge[a, b] += w
        for k in range(n):
            assert node[i, k, 1] == pytest.approx(sum(w for p, w in zip(paths, weight, strict=True) if p[k]) / weight.sum())
    assert edge == pytest.approx(want_edge)


def test_labels_change_within_documents(spark, sf):
    """Repeated lines and bad lines inside good documents are marked, and held-out documents are judged by their labels."""
    docs, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    trained = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(200)
    model = quality.fit(docs, trained)
    good = "The and attion of the ndere in a text. Thand erin to ontion the.\nAnother line of the andere text stands here, and is of some length."
    bad = "BUY!! NOW!! CHEAP!! $$$ CLICK!! HERE!! ### *** NOW!!"
    lines = f"{good}\n{bad}\n{bad} MORE!!\n{good} End."
    rows = quality.line_features(lines.split("\n"), model["known"])
    assert quality.viterbi(rows @ model["w"], model["trans"]).tolist() == [True, True, False, False, True, True]
    got = quality.quality_rules(docs, model)
    assert got.where("n_content_lines > 0 and n_content_lines < n_lines").count() > 50
    held = got.join(lab, "doc_id").join(trained.select("doc_id"), "doc_id", "left_anti").where("not base_failed").collect()
    assert len(held) > 100 and sum((r.quality == 1) == r.kept for r in held) / len(held) > 0.95


def test_repeated_lines_of_copies_are_no_boilerplate():
    copies = [np.arange(10 * i, 10 * i + 10) for i in range(3)] + [np.arange(100, 110)] * 5
    notice = [np.append(d, 7777) for d in copies[:3]]
    assert quality.repeated_lines(notice + copies[3:]) == {7777}


def test_quality_edges(spark, edge, labels):
    model = quality.fit(edge, labels)
    assert ids(quality.quality_rules(edge, model)) == ALL_IDS and quality.keep_good(edge, model).columns == edge.columns
    assert quality.quality_rules(edge.limit(0), quality.fit(edge.limit(0), labels)).count() == 0


# --- op9 -------------------------------------------------------------------------------------------------------

def within_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    i = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def brute_lines(texts, most=20):
    rows = [(d, k, x) for d, t in enumerate(texts) for k, x in enumerate((t or "").split("\n")) if WORD.search(x)]
    out = []
    for d, t in enumerate(texts):
        kept, n, gone, near = [], 0, 0, 0
        for k, x in enumerate((t or "").split("\n")):
            if not WORD.search(x):
                kept.append(x)
                continue
            n += 1
            before = [y for e, j, y in rows if (e, j) < (d, k)]
            first = min((e, j) for e, j, y in rows if y == x)
            nearly = len(x) >= most and any(within_one(x, y) and y != x and len(y) >= most for e, j, y in rows if (e, j) < first)
            if x in before or nearly:
                gone += 1
                near += x not in before
            else:
                kept.append(x)
        out.append((n, gone, near, hashlib.sha256("\n".join(kept).encode()).hexdigest() if t is not None else hashlib.sha256(b"").hexdigest()))
    return out


def test_line_dedup_is_exact(spark):
    rng = random.Random(9)
    base = [sentence(rng, 7) for _ in range(12)]

    def edited(s):
        i, kind = rng.randrange(len(s)), rng.random()
        return s if kind < 0.3 else s[:i] + rng.choice("abé") + s[i + 1 :] if kind < 0.55 else s[:i] + s[i + 1 :] if kind < 0.8 else s[:i] + rng.choice("ab") + s[i:]

    texts = ["\n".join(edited(rng.choice(base)) if rng.random() < 0.8 else rng.choice(["", "short", "ab"]) for _ in range(rng.randint(1, 6))) for _ in range(60)] + [None, "", "aaaaaaaaaaaaaaaaaaaaaaaa\naaaaaaaaaaaaaaaaaaaaaaaaa"]
    got = line_dedup.dedup_report(frame(spark, texts)).orderBy("doc_id").collect()
    assert [(r.n_lines, r.n_dropped, r.n_near, r.kept_sha256) for r in got] == brute_lines(texts)


def test_line_dedup_edges(spark, edge):
    assert ids(line_dedup.dedup_report(edge)) == ALL_IDS
    kept = line_dedup.drop_lines(edge)
    assert kept.columns == edge.columns and kept.schema == edge.schema
    # 4 repeats 3 and goes; equal rows stay alike; texts without words stay
    assert ids(kept) == sorted([i for i in ALL_IDS if i != 4], key=str)
    assert line_dedup.drop_lines(edge.limit(0)).count() == 0


# --- op10 ------------------------------------------------------------------------------------------------------

def brute_components(texts):
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_texts(seed, n=150):
    rng = random.Random(seed)
    base = [sentence(rng, rng.choice([1, 4, 5, 8, 20, 60, 150, 400])).split() for _ in range(25)]
    common = sentence(rng, 30)
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(["zz", "yy", "xx"])
        out.append(" ".join(w) + (" " + common if rng.random() < 0.4 else ""))
    return [*out, None, "", " ", "One TWO", "one two"]


@pytest.mark.parametrize("cold", [24, 2])
def test_ngram_join_is_exact(spark, monkeypatch, cold):
    """With two members as the limit of a cold block, nearly all links must come from stars and sketches."""
    monkeypatch.setattr(ngram_join, "COLD", cold)
    texts = near_texts(cold)
    got = ngram_join.ngram_join(frame(spark, texts)).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in got] == brute_components(texts)


def test_blocks_of_linked_sets_agree():
    rng = np.random.default_rng(7)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        drop = int(rng.integers(0, len(a) // 4 + 1))
        b = np.unique(np.concatenate((a[drop:], rng.integers(0, 2**63, int(rng.integers(0, len(a) // 3 + 1)), dtype=np.uint64))))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            owner, key, _, _ = ngram_join.block_keys([a, b])
            assert len(np.intersect1d(key[owner == 0], key[owner == 1]))
            assert np.bitwise_count((ngram_join.sketch(a) ^ ngram_join.sketch(b)).view(np.uint64)).sum() <= len(a) + len(b) - 2 * both


def test_blocks_of_one_component_come_first_and_what_is_joined_by_block_grows_in_proportion(spark):
    """Class 1 shares two blocks with others, but has more blocks of its own component than the bound, so it meets nobody; class 2 meets in its rarer block."""
    rows = [(1, 1, 9, k, 0, 5, 3) for k in (10, 11, 12, 50, 51)] + [(2, 2, 9, k, 0, 3, 2) for k in (20, 50, 51)] + [(3, 3, 9, 51, 0, 1, 1)] + [(4, 1, 9, k, 0, 1, 1) for k in (12,)]
    keys = spark.createDataFrame(rows, "sig bigint, label bigint, n long, key bigint, step int, emitted long, take long")
    shared = ngram_join._meetings(keys)
    assert sorted((r.sig, r.key, r.members) for r in shared.collect()) == [(1, 50, 2), (1, 51, 3), (2, 50, 2), (2, 51, 3), (3, 51, 3)]
    assert sorted((r.sig, r.key) for r in ngram_join._rarest(shared).collect()) == [(2, 50), (3, 51)]
    assert "Join" not in shared._jdf.queryExecution().optimizedPlan().toString()


def test_ngram_join_edges(spark, edge):
    got = ngram_join.ngram_join(edge)
    assert ids(got) == ALL_IDS
    assert {(r.doc_id, r.component_id) for r in got.where("doc_id in (0, 3, 4)").collect()} == {(0, 0), (3, 3), (4, 3)}
    kept = ngram_join.drop_near_duplicates(edge)
    assert kept.columns == edge.columns and 4 not in ids(kept) and {0, 1, 2, 3} <= set(ids(kept))
    assert ngram_join.ngram_join(edge.limit(0)).count() == 0
    assert ngram_join.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint")).agg(F.max("label")).first()[0] == 0
    assert isinstance(got.toPandas(), pd.DataFrame)


def test_one_row_of_each_component_stays_whatever_its_ids(spark):
    rng = random.Random(12)
    a, b, c, d, e = (sentence(rng, 40) for _ in range(5))
    texts = [(None, a), (None, b), (None, b + " zz"), (5, c), (5, d), (6, e), (6, e), (6, e), (None, e + " zz"), (8, None), (8, None), (None, " ")]
    got = sorted(((r.doc_id, r.text) for r in ngram_join.drop_near_duplicates(frame(spark, texts)).collect()), key=str)
    linked = [x for x in got if x in ((None, b), (None, b + " zz"))]
    assert len(linked) == 1
    assert got == sorted([(None, a), *linked, (5, c), (5, d), (6, e), (8, None), (8, None), (None, " ")], key=str)


def test_small_tables_of_the_join_have_few_files_whatever_the_partitions(spark):
    """A label table of some hundred rows had a file for each partition of a shuffle, in every round."""
    edges = ngram_join.saved(spark.createDataFrame([(i, i + 1) for i in range(0, 300) if i % 10 != 9], "a bigint, b bigint"))
    out, files = written(spark, lambda: ngram_join.components(edges).collect())
    assert {(r.node, r.label) for r in out} == {(i, i - i % 10) for i in range(300)}
    assert max(files) <= 8
    rng = random.Random(5)
    texts = [sentence(rng, 40) for _ in range(200)]
    texts += [f"{t} more" for t in texts]
    rows, files = written(spark, lambda: ngram_join.ngram_join(frame(spark, texts).repartition(40)).collect())
    assert {(r.doc_id, r.component_id) for r in rows} == {(i, i % 200) for i in range(400)}
    assert sum(n > 8 for n in files) <= 2  # the sets' sizes follow the input's partitions, the pairs their buckets


# --- op12 ------------------------------------------------------------------------------------------------------

ODD = ["a", "b", "the", "ing", "'s", "'", "!!", "!", "?", ".", "\u00e9", "e\u0301", "\u4e2d", "\u6587", "\U0001f600", "\u0327\u0301", "\u1100", "\u1161", "7", " ", "  ", "\n", "\t", "<|endoftext|>", "<|startoftext|>", "Q", "\u0130", "\u00a0", "\x1c", "|>", "'re", "ve"]


def library_counts(texts):
    own, _ = token_count.encoder(token_count.vocabulary_path())
    return [len(own.encode(t or "", add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize(("chunk", "overlap"), [(300, 100), (49_152, 1024)])
def test_token_counts_equal_the_library(spark, chunk, overlap):
    """Texts of odd pieces in every order; many chunks share no token, so their overlaps widen, some to the whole text."""
    rng = random.Random(12)
    texts = [None, "", " ", "x" * 5000, "ab" * 3000, "\u4e2d\u6587" * 2000]
    for n, k in [(150, None)] * 400 + [(3000, None)] * 60 + [(3000, 3)] * 60:
        some = rng.sample(ODD, k or rng.randint(2, len(ODD)))
        texts.append("".join(rng.choice(some) for _ in range(rng.randint(0, n))))
    rows = frame(spark, texts).unionByName(frame(spark, texts[-3:] * 2))
    got = defaultdict(list)
    for r in token_count.token_counts(rows, chunk=chunk, overlap=overlap, most=700).collect():
        got[r.doc_id].append((r.n_bytes, r.n_tokens, r.over_limit))
    for i, (t, n) in enumerate(zip(texts, library_counts(texts), strict=True)):
        assert (len((t or "").encode()), n, n > 700) in got[i], (i, t)
    assert sum(map(len, got.values())) == len(texts) + 6


def test_token_counts_of_a_table_and_of_odd_rows(spark, sf, edge):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], library_counts([r.text for r in rows]), strict=True))
    assert {r.doc_id: r.n_tokens for r in token_count.token_counts(docs, chunk=4000, overlap=400).collect()} == want
    assert ids(token_count.token_counts(edge, chunk=200, overlap=80)) == ALL_IDS
    assert token_count.token_counts(edge.limit(0)).collect() == []


def test_a_text_of_a_million_characters(spark):
    text = ("Words and more of them, " * 500 + "longwordwithoutend" * 20) * 80
    assert [r.n_tokens for r in token_count.token_counts(frame(spark, [text, text])).collect()] == library_counts([text, text])


# --- op11 ------------------------------------------------------------------------------------------------------

def brute_collocations(rows, least, most, top, cover=50):
    """All phrases of all pieces, counted in memory."""
    table = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(table)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, most + 1):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in found.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    longest[p[i : i + n]] = max(longest[p[i : i + n]], a)
        scored = []
        for p, a in found.items():
            if 100 * longest[p] < cover * a or not longest[p]:
                score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("least", "most", "top", "hot"), [(10, 3, 2000, 1_000_000), (3, 5, 7, 5), (2, 2, 40, 1_000_000)])
def test_collocations_equal_brute_force(spark, monkeypatch, least, most, top, hot):
    """Random texts in three languages with odd breaks, frequent phrases and ties; hot prefixes split; small chunks and slices in one case."""
    rng = random.Random(11 + most)
    word = ["ka", "Lo", "mi", "NE", "ru", "\u00c9t", "\u0416", "a-b", "x\u00a0y", "so"]
    rows = [(None, None), ("en", ""), ("en", " \t\n"), ("en", "lone"), ("en", ".,;\x0b!?")]
    for i in range(160):
        text = "".join(rng.choice(word[: 3 + i % 8]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0c"]) for _ in range(rng.randint(0, 90)))
        rows += [(rng.choice(["en", "de", None, "und"]), text + " ka Lo mi ne ka lo mi")] * (1 + (i % 9 == 0))
    docs = spark.createDataFrame([(t, lang, "clash", 1) for lang, t in rows], "text string, lang string, h string, a int")
    got = sorted(tuple(r) for r in phrases_of(docs, least, most, top, hot).collect())
    assert got == brute_collocations(rows, least, most, top)


def phrases_of(docs, least, most, top, hot):
    return phrases.collocations(docs, least=least, words=(2, most), top=top, hot_from=hot)


def test_collocations_of_odd_tables(spark, edge):
    assert phrases.collocations(edge.limit(0)).collect() == []
    assert phrases.collocations(edge).count() == 0
    same = edge.where("text is not null").crossJoin(spark.range(12)).drop("id")
    assert {r.a for r in phrases.collocations(same).where("phrase = 'same row'").collect()} == {24}


def test_chunks_cut_long_texts_at_breaks():
    text = "Ab cd, " * 5 + "ef\tgh"
    assert b"".join(phrases._slices(text)) == text.lower().replace(",", "\udcff").replace("\t", " ").encode("utf-8", "surrogateescape")
    small, phrases.SLICE = phrases.SLICE, 3
    try:
        parts = list(phrases._slices(text))
    finally:
        phrases.SLICE = small
    assert len(parts) == 6 and all(p.startswith(b"\xff") for p in parts[1:])


# --- op13 ------------------------------------------------------------------------------------------------------

def brute_negatives(rows, anchor, positives=5, negatives=3):
    """All pairs, in Python's whole numbers."""
    own = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            row = label, [math.floor(256 * float(np.float32(x))) for x in v]
            own[i] = min(own.get(i, row), row)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, v) in own.items():
        if anchor(a):
            scores = sorted((-dot(v, w), i, other == label) for i, (other, w) in own.items() if i != a)
            for s, p, _ in [x for x in scores if x[2]][:positives]:
                fit = [(t, i) for t, i, same in scores if not same and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
                out += [(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(fit)]
    return sorted(out)


VECTORS = "vec_id bigint, label int, embedding array<float>, v int, qid int, cell int, wants string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, label, v, 0, 0, 0, "clash") for i, label, v in rows], VECTORS)


@pytest.mark.parametrize(("labels_", "grid"), [(3, 2), (40, 1), (2, 50)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, labels_, grid):
    """Clustered vectors with many ties and copies, small labels, odd rows; small cells, splits and probes, so that several scans are needed."""
    for name, value in (("CELL_ROWS", 16), ("SIDE", 7), ("PROBE", 8), ("WIDEN", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = random.Random(13)
    centres = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(300):
        c = rng.choice(centres)
        v = [round((x + rng.uniform(-0.2, 0.2)) * grid) / grid for x in c][: rng.choice([6, 6, 6, 4])]
        rows.append((i, rng.randrange(labels_), [0.5, 0.25] if i % 3 == 0 else v))
    rows += [(None, 1, [1.0]), (900, None, [1.0]), (901, 1, None), (902, 1, [1.0, None]), (903, 1, [float("nan")]), (904, 1, [float("inf")]), (5, 0, [0.1]), (905, 1, []), (906, 77, [1.0])]
    anchor = lambda i: i % 4 == 0
    got = hard_negatives.hard_negatives(hard_negatives.usable(vectors(spark, rows)), F.col("vec_id") % 4 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, anchor)


def test_hard_negatives_of_odd_tables(spark):
    assert hard_negatives.mine(vectors(spark, [])).collect() == []
    assert hard_negatives.mine(vectors(spark, [(50, 1, [1.0])])).collect() == []
    assert hard_negatives.mine(vectors(spark, [(50, 1, [1.0]), (51, 1, [1.0])])).collect() == []
    rows = [(50, 1, [1.0]), (51, 1, [1.0]), (52, 2, [0.9]), (56, 1, [0.8])]
    assert sorted(tuple(r) for r in hard_negatives.mine(vectors(spark, rows)).collect()) == [(50, 51, 1, 52, 65536, 58880), (50, 51, 2, 56, 65536, 52224)]


def test_inner_products_of_large_components_are_exact():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(2**30), 2**30, (5, 3)), rng.integers(-(2**30), 2**30, (7, 3))
    want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    assert hard_negatives.inner(a.astype(float), b.astype(float), 2.0**62 - 1).tolist() == want


# --- op4, hostile pages ----------------------------------------------------------------------------------------

@pytest.mark.parametrize("page", ["<div>" * 100_000, "<b>" * 60_000 + "</i>" * 60_000, "<a " * 300_000, "<!--" * 200_000 + ">", '<a x="' * 100_000, "<svg>" + "<g>" * 50_000 + "<a/>" * 50_000, "<div>" * 50_000 + "</p>" * 50_000, "</a " * 200_000 + ">", "<script>" + "</scrip " * 100_000])
def test_html_of_hundreds_of_kilobytes_of_broken_markup_takes_seconds(page):
    began = time.process_time()
    html_text.extract("<p>first</p>" + page)
    assert time.process_time() - began < 20


def test_html_keeps_what_stands_behind_the_last_end_of_a_tag():
    assert html_text.extract("<p>a &amp; b <c d") == "a & b <c d"
    assert html_text.extract("<p>a<script>x < y") == "a"
    assert html_text.extract("no markup &lt;") == "no markup <"
    assert html_text.extract("<p>a<!-- b <!-- c") == "a<!-- b <!-- c"
