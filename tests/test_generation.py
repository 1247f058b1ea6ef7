import math

import pytest
from pyspark.sql import functions as F

from loomtext.operators import beams as B
from loomtext.operators import generation as G
from loomtext.plans.options import GenerationConfig, GenerationMode
from loomtext.sources.shared import saved


def scores(spark, d):
    return spark.createDataFrame([(s, t, float(x)) for s, row in d.items() for t, x in row.items()], "seq_id int, token_id int, score double")


def state(spark, d, prompt=1):
    return spark.createDataFrame([(k, v, prompt, False) for k, v in d.items()], "seq_id int, ids array<int>, prompt_len int, done boolean")


def run(spark, rule, row, ids=(0,), prompt=1):
    out = rule(scores(spark, {1: row}), state(spark, {1: list(ids)}, prompt)).collect()
    return {r.token_id: r.score for r in out}


def kept(d):
    return {k for k, v in d.items() if v > -math.inf}


def softmax(row):
    z = sum(math.exp(x) for x in row.values())
    return {k: math.exp(x) / z for k, x in row.items()}


ROW = {1: 2.0, 2: 1.0, 3: 0.5, 4: -1.0, 5: -3.0}


def test_modes():
    m = G.generation_mode
    assert m(GenerationConfig()) == GenerationMode.GREEDY_SEARCH
    assert m(GenerationConfig(do_sample=True)) == GenerationMode.SAMPLE
    assert m(GenerationConfig(penalty_alpha=0.6, top_k=4)) == GenerationMode.CONTRASTIVE_SEARCH
    assert m(GenerationConfig(num_beams=3)) == GenerationMode.BEAM_SEARCH
    assert m(GenerationConfig(num_beams=3, do_sample=True)) == GenerationMode.BEAM_SAMPLE
    assert m(GenerationConfig(num_beams=4, num_beam_groups=2)) == GenerationMode.GROUP_BEAM_SEARCH
    assert m(GenerationConfig(constraints=("x",))) == GenerationMode.CONSTRAINED_BEAM_SEARCH
    assert m(GenerationConfig(prompt_lookup_num_tokens=3)) == GenerationMode.ASSISTED_GENERATION
    with pytest.raises(ValueError):
        m(GenerationConfig(num_beams=2, dola_layers="high"))


def test_penalties(spark):
    assert run(spark, G.repetition_penalty(2.0), ROW, (1, 4)) == {**ROW, 1: 1.0, 4: -2.0}
    assert run(spark, G.encoder_repetition_penalty(2.0), ROW, (1, 4), prompt=1) == {**ROW, 1: 4.0}
    assert run(spark, G.temperature(0.5), ROW) == {k: v * 2 for k, v in ROW.items()}


def test_cutoffs(spark):
    p = softmax(ROW)
    assert kept(run(spark, G.top_k(2), ROW)) == {1, 2}
    total, want = 0.0, set()
    for k in sorted(p, key=p.get, reverse=True):
        if total < 0.8:
            want.add(k)
        total += p[k]
    assert kept(run(spark, G.top_p(0.8), ROW)) == want
    assert kept(run(spark, G.min_p(0.3), ROW)) == {k for k in p if p[k] >= 0.3 * max(p.values())}
    assert kept(run(spark, G.epsilon_cutoff(0.1), ROW)) == {k for k in p if p[k] >= 0.1}
    h = -sum(x * math.log(x) for x in p.values())
    assert kept(run(spark, G.eta_cutoff(0.2), ROW)) == {k for k in p if p[k] >= min(0.2, math.sqrt(0.2) * math.exp(-h))}
    order, total, want = sorted(p, key=lambda k: abs(-math.log(p[k]) - h)), 0.0, set()
    for k in order:
        if total < 0.5:
            want.add(k)
        total += p[k]
    assert kept(run(spark, G.typical_p(0.5), ROW)) == want


def test_ngrams_and_bans(spark):
    assert kept(run(spark, G.no_repeat_ngram(2), ROW, (1, 2, 1))) == {1, 3, 4, 5}
    assert kept(run(spark, G.encoder_no_repeat_ngram(2), ROW, (1, 2, 3, 1), prompt=2)) == {1, 3, 4, 5}
    assert kept(run(spark, G.no_bad_words([[3], [1, 2]]), ROW, (1,))) == {1, 4, 5}
    assert kept(run(spark, G.suppress([1, 5]), ROW)) == {2, 3, 4}
    assert kept(run(spark, G.suppress_at_begin([1], 1), ROW)) == {2, 3, 4, 5}
    assert kept(run(spark, G.min_length(3, [2]), ROW)) == {1, 3, 4, 5}
    assert kept(run(spark, G.min_new_tokens(1, [2]), ROW)) == {1, 3, 4, 5}
    assert kept(run(spark, G.forced_bos(3), ROW)) == {3}
    assert kept(run(spark, G.forced_eos(4, 2), ROW)) == {4}
    assert kept(run(spark, G.force_tokens({1: 5}), ROW)) == {5}
    allowed = spark.createDataFrame([(1, 2)], "seq_id int, token_id int")
    assert kept(run(spark, G.prefix_constrained(allowed), ROW)) == {2}


def test_values(spark):
    assert run(spark, G.sequence_bias({(2,): 1.0, (0, 3): 2.0, (7, 4): 5.0}), ROW, (0,)) == {**ROW, 2: 2.0, 3: 2.5}
    z = math.log(sum(map(math.exp, ROW.values())))
    assert run(spark, G.log_normalize(), ROW)[1] == pytest.approx(2.0 - z)
    assert run(spark, G.remove_invalid(), {1: math.nan, 2: math.inf, 3: -math.inf}) == {1: 0.0, 2: pytest.approx(3.4e38, rel=0.01), 3: pytest.approx(-3.4e38, rel=0.01)}
    assert run(spark, G.exponential_decay(0, 2.0, [1]), ROW, (0, 0, 0), prompt=1)[1] == 2.0 + 2.0 * 3
    current = spark.createDataFrame([(1, 2), (1, 2)], "seq_id int, token_id int")
    assert run(spark, G.hamming_diversity(current, 0.5), ROW)[2] == 0.0
    other = scores(spark, {1: dict.fromkeys(ROW, 0.0)})
    assert len(run(spark, G.guidance(other, 1.5), ROW)) == 5
    marked = run(spark, G.watermark(2.0, 0.5), ROW)
    assert all(marked[k] - ROW[k] in (0.0, 2.0) for k in ROW)


def test_masks_and_positions(spark):
    df = state(spark, {1: [9, 9, 3, 4]})
    r = df.select(G.attention_mask(F.col("ids"), 9).alias("m"), G.attention_mask(F.col("ids"), 9, [9]).alias("e")).first()
    assert r.m == [0, 0, 1, 1] and r.e == [1, 1, 1, 1]
    p = df.select(G.position_ids(G.attention_mask(F.col("ids"), 9)).alias("p"), G.cache_position(F.col("ids"), 2).alias("c")).first()
    assert p.p == [1, 1, 0, 1] and p.c == [2, 3]
    assert [r.copy for r in G.expand(df, 2).collect()] == [0, 1]


def test_greedy_stops_and_pads(spark):
    table = spark.createDataFrame([(1, 2, 5.0), (1, 3, 5.0), (2, 7, 1.0), (4, 1, 1.0), (7, 1, 1.0)], "prev int, token_id int, score double")
    start = state(spark, {1: [1], 2: [4], 3: [99]})
    out = G.generate(start, G.bigram_scorer(table), GenerationConfig(max_new_tokens=4, eos_token_id=(7,), pad_token_id=0), save=saved)
    got = {r.seq_id: r.ids for r in out.collect()}
    assert got[1] == [1, 2, 7, 0, 0] and got[2] == [4, 1, 2, 7, 0] and got[3][0] == 99


def test_sampling_is_repeatable_and_beams_beat_greedy(spark):
    table = spark.createDataFrame([(1, 2, math.log(0.6)), (1, 3, math.log(0.4)), (2, 4, math.log(0.5)), (2, 5, math.log(0.5)), (3, 6, 0.0)], "prev int, token_id int, score double")
    start = state(spark, {1: [1]})
    c = GenerationConfig(max_new_tokens=2, do_sample=True, top_k=5)
    a, b = (G.generate(start, G.bigram_scorer(table), c, seed=5, save=saved).first().ids for _ in range(2))
    assert a == b and len(a) == 3
    assert B.beam_search(start, G.bigram_scorer(table), GenerationConfig(max_new_tokens=2, num_beams=2), save=saved).first().ids == [1, 3, 6]
