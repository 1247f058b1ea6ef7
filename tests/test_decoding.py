"""Search modes against brute force in plain Python: beams with rules, in groups and under constraints, contrastive search, lookup, stop strings."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomtext.operators import beams as B
from loomtext.operators import generation as G
from loomtext.operators import lookahead as L
from loomtext.plans.options import GenerationConfig
from loomtext.sources.shared import saved


def table(seed, n=9, fan=5):
    """prev -> id -> score; the last id has no continuation."""
    rng = random.Random(seed)
    return {a: {b: round(rng.uniform(-3, 3), 3) for b in rng.sample(range(n), fan)} for a in range(n - 1)}


def frame(spark, t):
    return saved(spark.createDataFrame([(a, b, x) for a, row in t.items() for b, x in row.items()], "prev int, token_id int, score double"))


def prompts(seed, n=9, k=12):
    rng = random.Random(seed)
    return {i: [rng.randrange(n) for _ in range(rng.randint(1, 5))] for i in range(k)} | {99: [n - 1]}


def states(spark, p, wanted=None):
    rows = [(k, v, len(v), False, (wanted or {}).get(k)) for k, v in p.items()]
    return spark.createDataFrame(rows, "seq_id int, ids array<int>, prompt_len int, done boolean, wanted array<array<array<int>>>")


def normal(row):
    top = max(row.values())
    z = math.log(sum(math.exp(x - top) for x in row.values()))
    return {t: x - top - z for t, x in row.items()}


def progress(wanted, met, path, token):
    """The constraint automaton, from its definition."""
    left = [(i, tuple(a)) for i, alts in enumerate(wanted) if i not in met for a in alts]
    grown = (*path, token)
    for k in range(len(grown)):
        if any(a[: len(grown) - k] == grown[k:] for _, a in left):
            won = [i for i, a in left if a == grown[k:]]
            return ((*met, min(won)), ()) if won else (met, grown[k:])
    return met, ()


def brute(ids, t, c, wanted=(), eos=()):
    """The best beam and its value."""
    width, groups = c.num_beams // c.num_beam_groups, c.num_beam_groups
    beams = {g: [(0.0, tuple(ids), False, (), ())] for g in range(groups)}
    limit, longest = len(ids) + c.max_new_tokens, max((len(a) for w in wanted for a in w), default=0)
    for _ in range(c.max_new_tokens):
        chosen = Counter()
        for g in range(groups):
            rows = []
            for total, own, done, met, path in beams[g]:
                row = normal(t[own[-1]]) if not done and t.get(own[-1]) else {}
                if not done and c.repetition_penalty != 1.0:
                    row = {k: (x * c.repetition_penalty if x < 0 else x / c.repetition_penalty) if k in own else x for k, x in row.items()}
                if not done and groups > 1:
                    row = {k: x - c.diversity_penalty * chosen[k] for k, x in row.items()}
                if not done and wanted:
                    for i, alts in enumerate(wanted):
                        for a in alts:
                            if i not in met and tuple(a[: len(path)]) == path and len(a) > len(path):
                                row.setdefault(a[len(path)], B.ABSENT)
                if not row:
                    rows.append((total, own, True, met, path, None))
                for k, x in row.items():
                    m, p = progress(wanted, met, path, k)
                    if not (k in eos and len(m) < len(wanted)):
                        rows.append((total + x, (*own, k), k in eos or len(own) + 1 >= limit, m, p, k))
            rows.sort(key=lambda r: (-r[0], r[1]))
            if wanted:
                turn = Counter()
                ranked = []
                for r in rows:
                    bank = len(r[3]) * (longest + 1) + len(r[4])
                    turn[bank] += 1
                    ranked.append((turn[bank], -bank, r))
                rows = [r for *_, r in sorted(ranked, key=lambda x: x[:2])]
            rows = rows[:width]
            beams[g] = [r[:5] for r in rows]
        # what a group chose counts for later groups of the same step only
            chosen.update(r[5] for r in rows if r[5] is not None)
    best = max(((len(m) == len(wanted), total / max(1, len(own) - len(ids)) ** c.length_penalty, -g, -i), own) for g in beams for i, (total, own, _, m, _) in enumerate(beams[g]))
    return list(best[1]), best[0][1], best[0][0]


@pytest.mark.parametrize("case", [dict(num_beams=3), dict(num_beams=4, repetition_penalty=1.4, length_penalty=0.5, eos_token_id=(2,)), dict(num_beams=6, num_beam_groups=3, diversity_penalty=0.7), dict(num_beams=2, num_beam_groups=2, diversity_penalty=5.0, eos_token_id=(1, 2))])
def test_beams_equal_brute_force(spark, case):
    c, t, p = GenerationConfig(max_new_tokens=4, **case), table(1), prompts(2)
    got = {r.seq_id: r for r in B.beam_search(states(spark, p), G.bigram_scorer(frame(spark, t)), c, save=saved).collect()}
    for k, ids in p.items():
        want, value, _ = brute(ids, t, c, eos=c.eos_token_id or ())
        assert got[k].ids == want and got[k].score == pytest.approx(value), k


def test_constrained_beams_equal_brute_force_and_hold_every_constraint(spark):
    t, p = table(3), prompts(4)
    rng = random.Random(5)
    wanted = {k: [[[rng.randrange(9) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(0, 2))] for k in p}
    wanted[0], wanted[1] = [[[1, 1, 2]], [[1, 2], [3, 4, 5]]], None
    c = GenerationConfig(max_new_tokens=8, num_beams=3, eos_token_id=(2,))
    out = B.beam_search(states(spark, p, wanted), G.bigram_scorer(frame(spark, t)), c, save=saved, constraints="wanted")
    got = {r.seq_id: r for r in out.collect()}
    for k, ids in p.items():
        want, value, whole = brute(ids, t, c, wanted[k] or [], eos=(2,))
        new = got[k].ids[len(ids) :]
        assert got[k].ids == want and got[k].score == pytest.approx(value) and got[k].met == whole, k
        if whole:
            for alts in wanted[k] or []:
                assert any(a == new[i : i + len(a)] for a in alts for i in range(len(new))), (k, alts, new)
    assert sum(r.met for r in got.values()) >= len(p) - 1  # the prompt that ends in an id without continuation may have no room


def test_beam_options_are_checked(spark):
    start, scorer = states(spark, {1: [1]}), G.bigram_scorer(frame(spark, table(1)))
    for bad in (dict(num_beams=3, num_beam_groups=2), dict(num_beams=2, diversity_penalty=1.0), dict(num_beams=2, guidance_scale=1.5), dict(num_beams=2, stop_strings=("a",)), dict(num_beams=2, num_beam_groups=2, do_sample=True)):
        with pytest.raises(ValueError):
            B.beam_search(start, scorer, GenerationConfig(max_new_tokens=2, **bad), save=saved)
    sampled = [B.beam_search(start, scorer, GenerationConfig(max_new_tokens=3, num_beams=3, do_sample=True, top_k=4, top_p=0.9), seed=7, save=saved).first().ids for _ in range(2)]
    assert sampled[0] == sampled[1] and len(sampled[0]) > 1


def test_allowed_ids_and_guidance_in_beams(spark):
    t, p = table(6), prompts(7)
    f = frame(spark, t)
    even = lambda st: st.select("seq_id", F.explode(F.array(*[F.lit(i) for i in range(0, 9, 2)])).alias("token_id"))
    out = B.beam_search(states(spark, p), G.bigram_scorer(f), GenerationConfig(max_new_tokens=3, num_beams=2), save=saved, allowed=even).collect()
    assert all(x % 2 == 0 for r in out for x in r.ids[len(p[r.seq_id]) :])
    c = GenerationConfig(max_new_tokens=3, num_beams=2, guidance_scale=1.5)
    same = B.beam_search(states(spark, p), G.bigram_scorer(f), c, save=saved, unconditional=G.bigram_scorer(f)).collect()
    for r in same:  # the same scorer on both sides changes nothing
        assert r.ids == brute(p[r.seq_id], t, c)[0]


def greedy(ids, t, steps, eos=()):
    out = list(ids)
    for _ in range(steps):
        row = t.get(out[-1])
        if not row:
            break
        out.append(max(row, key=lambda k: (row[k], -k)))
        if out[-1] in eos:
            break
    return out


def test_prompt_lookup_equals_greedy_search_in_fewer_rounds(spark):
    t = {0: {1: 2.0, 3: 1.0}, 1: {2: 2.0, 4: 1.0}, 2: {0: 1.0, 5: 0.5}, 3: {3: 1.0}, 4: {6: 1.0}, 6: {7: 1.0}}
    p = prompts(8, n=8) | {50: [0, 1, 2, 0, 1, 2, 0], 51: [3, 3], 52: [4, 0, 1], 53: [7]}
    f = frame(spark, t)
    c = GenerationConfig(max_new_tokens=9, prompt_lookup_num_tokens=4, max_matching_ngram_size=3)
    got = {r.seq_id: r for r in L.prompt_lookup(states(spark, p), G.bigram_scorer(f), c, save=saved).collect()}
    for k, ids in p.items():
        assert got[k].ids == greedy(ids, t, 9), k
    assert got[50].rounds <= 3 and got[51].rounds <= 5 and got[53].rounds == 1
    ends = GenerationConfig(max_new_tokens=9, prompt_lookup_num_tokens=4, eos_token_id=(7, 2), pad_token_id=-1, repetition_penalty=1.5)
    want = {r.seq_id: r.ids for r in G.generate(states(spark, p), G.bigram_scorer(f), GenerationConfig(max_new_tokens=9, eos_token_id=(7, 2), pad_token_id=-1, repetition_penalty=1.5), save=saved, every=1).collect()}
    assert {r.seq_id: r.ids for r in L.prompt_lookup(states(spark, p), G.bigram_scorer(f), ends, save=saved).collect()} == want


def test_greedy_plan_equals_greedy_search(spark):
    t, p = table(9), prompts(10)
    f = frame(spark, t)
    for eos in ((), (3, 4)):
        c = GenerationConfig(max_new_tokens=6, eos_token_id=eos or None)
        got = {r.seq_id: r.ids for r in L.greedy_plan(states(spark, p), f, c).collect()}
        assert got == {k: greedy(ids, t, 6, eos) for k, ids in p.items()}


def test_greedy_plan_recurs_over_last_ids_whatever_the_number_of_prompts(spark):
    rng = random.Random(6)
    table = {(a, b): rng.randrange(1, 9) for a in range(5) for b in range(5)}
    f = spark.createDataFrame([(a, b, float(n)) for (a, b), n in table.items()], "prev int, token_id int, score double")
    best = {a: min(range(5), key=lambda b: (-table[a, b], b)) for a in range(5)}
    p = spark.range(3000).selectExpr("cast(id as string) as seq_id", "array(9, cast(id % 5 as int)) as ids", "2 as prompt_len", "false as done")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "1000")
    try:
        got = {r.seq_id: list(r.ids) for r in L.greedy_plan(p, f, GenerationConfig(max_new_tokens=6)).collect()}
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert len(got) == 3000
    for i in range(3000):
        want = [9, i % 5]
        for _ in range(6):
            want.append(best[want[-1]])
        assert got[str(i)] == want


def test_contrastive_search_equals_brute_force(spark):
    t, p = table(11), prompts(12)
    rng = random.Random(13)
    vec = {i: [rng.randint(-5, 5) for _ in range(4)] for i in range(8)}  # one id has none
    vec[7] = [0, 0, 0, 0]
    c = GenerationConfig(max_new_tokens=5, top_k=3, penalty_alpha=0.6)

    def cos(a, b):
        na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / (na * nb) if na and nb else 0.0

    def one(ids):
        out = list(ids)
        for _ in range(5):
            if not t.get(out[-1]):
                break
            prob = {k: math.exp(x) for k, x in normal(t[out[-1]]).items()}
            best = []
            for k in sorted(prob, key=lambda k: (-prob[k], k))[:3]:
                near = max((cos(vec[k], vec[i]) for i in out if i in vec), default=0.0) if k in vec else 0.0
                best.append((0.4 * prob[k] - 0.6 * near, -k))
            out.append(-max(best)[1])
        return out

    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vec.items()], "token_id int, vector array<float>")
    got = {r.seq_id: r.ids for r in L.contrastive_search(states(spark, p), G.bigram_scorer(frame(spark, t)), vectors, c, save=saved).collect()}
    assert got == {k: one(ids) for k, ids in p.items()}
    with pytest.raises(ValueError):
        L.contrastive_search(states(spark, p), None, vectors, GenerationConfig(top_k=1, penalty_alpha=0.5), save=saved)


TEXTS = ["a", "b", "ab", "ba", "aab", "c", "", "bca", "é"]


def test_stop_strings_cut_across_tokens(spark):
    """The automaton alone on all splits, then in the loops: the first token whose text ends or holds a stop string is the last."""
    strings = ["abab", "bca", "aa", "cé"]
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "token_id int, text string")
    stop = G.stops(GenerationConfig(stop_strings=tuple(strings)), texts)[0]
    rng = random.Random(14)
    rows = [("".join(rng.choice("abcé") for _ in range(rng.randint(0, 4))), "".join(rng.choice("abcé") for _ in range(rng.randint(0, 6)))) for _ in range(300)]
    df = spark.createDataFrame(rows, "a string, b string").withColumn("at", stop.after(F.lit(0), F.col("a"))["at"])
    for r in df.select("a", "b", stop.after(F.col("at"), F.col("b"))["hit"].alias("hit")).collect():
        assert r.hit == any(s in (r.a + r.b)[max(0, len(r.a) - len(s) + 1) :] for s in strings), r
    t, p = table(15), prompts(16)
    f = frame(spark, t)
    got = {r.seq_id: r.ids for r in G.generate(states(spark, p), G.bigram_scorer(f), GenerationConfig(max_new_tokens=8, stop_strings=tuple(strings), pad_token_id=-1), save=saved, stopping=[stop]).collect()}
    for k, ids in p.items():
        out = list(ids)
        for _ in range(8):
            if not t.get(out[-1]):
                break
            out.append(max(t[out[-1]], key=lambda x: (t[out[-1]][x], -x)))
            had = "".join(TEXTS[i] for i in out[:-1])
            if any(s in (had + TEXTS[out[-1]])[max(0, len(had) - len(s) + 1) :] for s in strings):
                break
        assert [x for x in got[k] if x >= 0] == out, k
    with pytest.raises(ValueError):
        G.generate(states(spark, p), G.bigram_scorer(f), GenerationConfig(max_new_tokens=2, stop_strings=("a",)), save=saved)
    with pytest.raises(ValueError):
        G.stops(GenerationConfig(stop_strings=("a",)))
    beams = B.beam_search(states(spark, p), G.bigram_scorer(f), GenerationConfig(max_new_tokens=8, num_beams=2), save=saved, stopping=[stop]).collect()
    for r in beams:
        had = "".join(TEXTS[i] for i in r.ids[:-1])
        new = r.ids[len(p[r.seq_id]) : -1]
        assert not new or not any(s in had[max(0, len("".join(TEXTS[i] for i in p[r.seq_id])) - len(s) + 1) :] for s in strings)


def test_lists_merge_by_kind():
    own = G.processors(GenerationConfig(repetition_penalty=1.2, no_repeat_ngram_size=2))
    assert [x.kind for x in own] == ["repetition_penalty", "no_repeat_ngram"]
    assert len(G.merged_list(own, [G.suppress([1]), lambda s, st: s])) == 4
    with pytest.raises(ValueError, match="repetition_penalty"):
        G.merged_list(own, [G.repetition_penalty(2.0)])
    with pytest.raises(ValueError, match="MaxTime"):
        G.stops(GenerationConfig(max_time=1.0), custom=[G.MaxTime(2)])


def test_warpers_keep_one_id_more_than_end_ids(spark):
    rows = {1: 3.0, 2: 2.0, 3: 1.0, 4: 0.0}
    s = spark.createDataFrame([(1, k, x) for k, x in rows.items()], "seq_id int, token_id int, score double")
    for rule in (G.min_p(0.99, 3), G.epsilon_cutoff(0.9, 3), G.eta_cutoff(0.9, 3), G.top_p(0.01, 3), G.top_k(1, 3)):
        assert {r.token_id for r in rule(s, None).where(F.col("score") > G.NEVER).collect()} == {1, 2, 3}
    made = G.warpers(GenerationConfig(num_beams=2, eos_token_id=(7, 8), top_k=1, top_p=1.0))
    assert {r.token_id for r in made[0](s, None).where(F.col("score") > G.NEVER).collect()} == {1, 2, 3}


def test_prefix_index_and_healing(spark):
    """The index against every pair of tokens of a public vocabulary's share, and healing against its definition."""
    from loomtext.plans.vocabulary import public_vocabulary

    vocab = {t: i for t, i in public_vocabulary()[0].items() if i % 7 == 0 or len(t) < 3}
    rows = {r.token_id: r for r in L.prefix_index(spark, vocab).collect()}
    for t in random.Random(1).sample(sorted(vocab), 150):
        own = rows[vocab[t]]
        assert {u for u, i in vocab.items() if own.place <= rows[i].place < own.upto} == {u for u in vocab if u.startswith(t)}
    small = {"a": 0, "ab": 1, "abc": 2, "b": 3, "bc": 4, "c": 5, "d": 6, "<s>": 7}
    t = {i: {j: round(random.Random(i * 9 + j).uniform(-4, 0), 3) for j in range(7) if j % 3 != i % 3} for i in range(8)}
    p = prompts(18, n=7, k=20) | {70: [0], 71: []}
    got = {r.seq_id: (r.ids, r.prompt_len) for r in L.heal(states(spark, p), G.bigram_scorer(frame_of(spark, t)), L.prefix_index(spark, small), 7).collect()}
    names = {i: x for x, i in small.items()}
    for k, ids in p.items():
        want = ids
        if ids and sum(x.startswith(names[ids[-1]]) for x in small) > 1:
            cut = ids[:-1] or [7]
            score = {j: x + 10.0 * names[j].startswith(names[ids[-1]]) + 1.0 * (j == ids[-1]) for j, x in t[cut[-1]].items()}
            want = [*cut, max(score, key=lambda j: (score[j], -j))]
        assert got[k] == (want, len(want)), k


def frame_of(spark, t):
    return saved(spark.createDataFrame([(a, b, x) for a, row in t.items() for b, x in row.items()], "prev int, token_id int, score double"))


def test_offsets_equal_the_library(spark):
    """Starts and ends of tokens in characters, with characters cut between tokens, against the named library, raw and trimmed."""
    from tokenizers import Tokenizer as Library
    from tokenizers import pre_tokenizers, processors

    from loomtext.functions import text as T
    from loomtext.operators import bpe
    from loomtext.operators.offsets import byte_level_offsets, trimmed
    from loomtext.plans.vocabulary import public_file, public_vocabulary

    rng = random.Random(19)
    texts = ["", " ", "a", "  two  blanks ", "\u4e2d\u6587 \U0001f600\U0001f600 \u00e9", *["".join(rng.choice(["ab", " ", "  ", "\u00e9", "\u4e2d", "\U0001f680", "\n", ".", "'s", "7"]) for _ in range(rng.randint(1, 40))) for _ in range(150)]]
    lib = Library.from_file(public_file())
    lib.pre_tokenizer, lib.post_processor = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False), processors.ByteLevel(trim_offsets=False)
    _, ranks = public_vocabulary()
    df = saved(spark.createDataFrame([*enumerate(texts), (999, None)], "i int, text string").select("i", "text", bpe.merged_words(T.byte_level_pretokens(F.col("text")), ranks, raw=True).alias("t")))
    out = df.select("i", "text", byte_level_offsets(F.col("text"), F.col("t")).alias("at")).select("i", "at", trimmed(F.col("text"), F.col("at")).alias("cut"))
    for r in out.collect():
        text = texts[r.i] if r.i < 999 else ""
        want = lib.encode(text, add_special_tokens=False).offsets
        assert [(x.start, x.end) for x in r.at] == want, text
        for x, y in zip(r.at, r.cut or [], strict=True):
            own = text[x.start : x.end]
            assert text[y.start : y.end] == (own.lstrip() or own), text


def test_text_added_by_each_token_joins_to_the_text_in_one_pass(spark):
    import time

    from loomtext.operators.offsets import added_text

    rng = random.Random(23)
    rows = [(0, "", []), (1, None, None), (2, "ab", [(0, 1)]), (3, "\u4e2d\U0001f600x", [(0, 1), (0, 1), (1, 2), (1, 3)]), (4, "tail", [(0, 4)]), (5, "none", [])]
    for i in range(6, 60):
        text = "".join(rng.choices("ab \u00e9\u4e2d\U0001f680", k=rng.randint(1, 30)))
        rows.append((i, text, [(0, e) for e in sorted(rng.randint(0, len(text)) for _ in range(rng.randint(0, 9)))]))
    long = "abc\u00e9 " * 60_000
    rows.append((60, long, [(k, k + 1) for k in range(len(long))]))
    df = spark.createDataFrame(rows, "i int, t string, at array<struct<start:int,end:int>>").coalesce(1)
    df.select(added_text("t", "at")).limit(1).collect()
    began = time.monotonic()
    got = {r.i: r.p for r in df.select("i", added_text("t", "at").alias("p")).collect()}
    assert time.monotonic() - began < 60  # a search for each place from the text's start takes minutes
    for i, text, at in rows:
        ends = [0, *(e for _, e in at or [])]
        assert got[i] == [text[a:b] for a, b in zip(ends, ends[1:]) if b > a], i


def test_beams_leave_the_prompt_where_it_is_and_equal_those_scored_as_rows(spark):
    t = table(31)
    p = {k: v * 40 for k, v in prompts(32, k=4).items()}
    wanted = {k: [[[1, 2], [3]], [[4]]] for k in p}
    f = frame(spark, t)
    for case, held in ((dict(num_beams=4, num_beam_groups=2, diversity_penalty=0.4), None), (dict(num_beams=3, repetition_penalty=1.3), None), (dict(num_beams=2, eos_token_id=(2,)), wanted)):
        c, longest = GenerationConfig(max_new_tokens=3, **case), []

        def watched(df):
            longest.append(max([r[0] for r in df.select(F.size("ids")).collect()] or [0]) if {"ids", "beam"} <= set(df.columns) else 0)
            return df

        run = lambda scorer, save: {r.seq_id: (r.ids, round(r.score, 9)) for r in B.beam_search(states(spark, p, held), scorer, c, save=save, constraints="wanted" if held else None).collect()}
        got = run(G.bigram_scorer(f), lambda df: watched(saved(df)))
        assert longest and max(longest) <= 1 + 3
        assert got == run(lambda st: G.bigram_scorer(f)(st), saved)


def test_lookup_scores_each_last_id_once(spark):
    t, p = table(33), prompts(34)
    f, calls = frame(spark, t), []
    inner = G.bigram_scorer(f)

    def counted(st):
        calls.append(1)
        return inner(st)

    counted.last_ids, counted.small = inner.last_ids, False
    got = {r.seq_id: r.ids for r in L.prompt_lookup(states(spark, p), counted, GenerationConfig(max_new_tokens=5, prompt_lookup_num_tokens=3), save=saved).collect()}
    assert got == {k: greedy(ids, t, 5) for k, ids in p.items()} and len(calls) == 1
