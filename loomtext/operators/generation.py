"""Autoregressive decoding as an iterative dataflow.

State is one row per sequence: ``seq_id, prompt_len, ids, done``. A scorer is a function of that state to a long table
``seq_id, token_id, score``; processors and warpers rewrite such a table, and each step picks one id per sequence. State is
written to the shared checkpoint folder every few steps, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator, Sequence
from functools import reduce, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..plans.options import GenerationConfig, GenerationMode

Scorer = Callable[[DataFrame], DataFrame]
Processor = Callable[[DataFrame, DataFrame], DataFrame]
NEVER = float("-inf")


# --- configuration ---------------------------------------------------------------------------------------------

def generation_mode(c: GenerationConfig, assistant: bool = False) -> GenerationMode:
    if c.constraints is not None or c.force_words_ids is not None:
        mode = GenerationMode.CONSTRAINED_BEAM_SEARCH
    elif c.num_beams == 1:
        contrast = c.top_k is not None and c.top_k > 1 and c.penalty_alpha is not None and c.penalty_alpha > 0
        mode = GenerationMode.SAMPLE if c.do_sample else GenerationMode.CONTRASTIVE_SEARCH if contrast else GenerationMode.GREEDY_SEARCH
    elif c.num_beam_groups > 1:
        mode = GenerationMode.GROUP_BEAM_SEARCH
    else:
        mode = GenerationMode.BEAM_SAMPLE if c.do_sample else GenerationMode.BEAM_SEARCH
    plain = mode in (GenerationMode.GREEDY_SEARCH, GenerationMode.SAMPLE)
    for asked, name in ((assistant or c.prompt_lookup_num_tokens is not None, GenerationMode.ASSISTED_GENERATION), (c.dola_layers is not None, GenerationMode.DOLA_GENERATION)):
        if asked:
            if not plain:
                raise ValueError(f"{name} works with greedy search and sampling only")
            mode = name
    return mode


def generation_mode_column(constrained: Column, beams: Column, groups: Column, sample: Column, top_k: Column, alpha: Column, assisted: Column, dola: Column) -> Column:
    """The mode of a table of configurations; null where a combination is not allowed."""
    base = (
        F.when(constrained, "constrained_beam_search")
        .when(beams == 1, F.when(sample, "sample").when((top_k > 1) & (F.coalesce(alpha, F.lit(0.0)) > 0), "contrastive_search").otherwise("greedy_search"))
        .when(groups > 1, "group_beam_search").when(sample, "beam_sample").otherwise("beam_search")
    )
    plain = base.isin("greedy_search", "sample")
    return F.when(dola & plain, "dola_generation").when(assisted & plain & ~dola, "assisted_generation").when(~dola & ~assisted, base)


# --- inputs ----------------------------------------------------------------------------------------------------

def initial_state(df: DataFrame, ids: str | None, seq_id: str, bos_id: int | None = None) -> DataFrame:
    """Prompts; a missing or empty one is the bos id."""
    own = F.col(ids) if ids else F.lit(None).cast("array<int>")
    if bos_id is not None:
        own = F.when(F.coalesce(F.size(own), F.lit(0)) > 0, own).otherwise(F.array(F.lit(bos_id)))
    return df.select(F.col(seq_id).alias("seq_id"), own.alias("ids")).withColumns({"prompt_len": F.size("ids"), "done": F.lit(False)})


def attention_mask(ids: Column, pad_id: int | None, eos_ids: Sequence[int] = ()) -> Column:
    """Ones; zeros on padding where the pad id occurs and is no end id."""
    ones = F.array_repeat(F.lit(1), F.size(ids))
    if pad_id is None or pad_id in eos_ids:
        return ones
    return F.when(F.array_contains(ids, pad_id), F.transform(ids, lambda x: (x != pad_id).cast("int"))).otherwise(ones)


@F.arrow_udf(ArrayType(IntegerType()))
def _running(masks: pa.Array) -> pa.Array:
    null = masks.is_null().to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(masks), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, ends = masks.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(sizes)
    seen = np.concatenate(([0], np.cumsum(flat)))
    found = np.where(flat == 0, 1, seen[1:] - np.repeat(seen[ends - sizes], sizes) - 1)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(found.astype(np.int32)), mask=pa.array(null))


def position_ids(mask: Column) -> Column:
    """Running count of visible positions minus one; masked positions are 1."""
    return _running(mask.cast("array<int>"))


def cache_position(ids: Column, past: Column | int = 0) -> Column:
    start = F.lit(past) if isinstance(past, int) else past
    return F.when(F.size(ids) > start, F.sequence(start, F.size(ids) - 1)).otherwise(F.array().cast("array<int>"))


def expand(df: DataFrame, n: int) -> DataFrame:
    """Each row n times, neighbours together: copy counts from 0."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def lengths(c: GenerationConfig, prompt: Column) -> tuple[Column, Column]:
    """Smallest and largest total length; the counts of new tokens go on top of the prompt."""
    most = prompt + c.max_new_tokens if c.max_new_tokens is not None else F.lit(c.max_length or 20)
    least = prompt + c.min_new_tokens if c.min_new_tokens is not None else F.lit(c.min_length or 0)
    return least, most


def too_long(c: GenerationConfig, prompt: Column) -> Column:
    """True where the prompt leaves no room."""
    return prompt >= lengths(c, prompt)[1]


# --- stopping --------------------------------------------------------------------------------------------------

def eos_stop(ids: Column, eos_ids: Sequence[int]) -> Column:
    return F.coalesce(F.try_element_at(ids, F.lit(-1)).isin(*eos_ids), F.lit(False))


def max_length_stop(ids: Column, n: Column | int) -> Column:
    return F.size(ids) >= n


def max_new_tokens_stop(ids: Column, start: Column | int, n: int) -> Column:
    return F.size(ids) >= (F.lit(start) if isinstance(start, int) else start) + n


def stop_string(text: Column, strings: Sequence[str]) -> Column:
    return any_of([text.contains(s) for s in strings])


def any_of(flags: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags, F.lit(False))


class MaxTime:
    """A wall-clock budget, read between steps."""

    def __init__(self, seconds: float):
        self.end = time.monotonic() + seconds

    def over(self) -> bool:
        return time.monotonic() > self.end


# --- logits: each takes (scores, state) and returns scores -----------------------------------------------------

def rule(factory: Callable[..., Processor]) -> Callable[..., Processor]:
    """Processors carry the name of what made them, so that lists of them can be merged by kind."""

    @wraps(factory)
    def made(*args, **options) -> Processor:
        run = factory(*args, **options)
        run.kind = factory.__name__
        return run

    return made


def _each(run: Processor, each: Callable[[Column, Column, Column], Column]) -> Processor:
    """A rule that looks at one id at a time also has ``each``: from the id, its score and the sequence's ids (distinct ones will do) to the new score."""
    run.each = each
    return run


def _seq(*order: Column) -> Window:
    w = Window.partitionBy("seq_id")
    return w.orderBy(*order) if order else w


def _probability() -> Column:
    """Softmax within a sequence, shifted by its maximum."""
    top = F.max("score").over(_seq())
    return F.exp(F.col("score") - top) / F.sum(F.exp(F.col("score") - top)).over(_seq())


def _drop(scores: DataFrame, bad: Column) -> DataFrame:
    return scores.withColumn("score", F.when(bad, F.lit(NEVER)).otherwise(F.col("score")))


def _with_state(scores: DataFrame, state: DataFrame, **cols: Column) -> DataFrame:
    return scores.join(state.select("seq_id", *[v.alias(k) for k, v in cols.items()]), "seq_id")


@rule
def min_length(n: int, eos_ids: Sequence[int]) -> Processor:
    return lambda s, st: _drop(_with_state(s, st, len=F.size("ids")), (F.col("len") < n) & F.col("token_id").isin(*eos_ids)).drop("len")


@rule
def min_new_tokens(n: int, eos_ids: Sequence[int]) -> Processor:
    return lambda s, st: _drop(_with_state(s, st, new=F.size("ids") - F.col("prompt_len")), (F.col("new") < n) & F.col("token_id").isin(*eos_ids)).drop("new")


@rule
def temperature(t: float) -> Processor:
    if t <= 0:
        raise ValueError("the temperature must be positive")
    return lambda s, st: s.withColumn("score", F.col("score") / t)


def _penalized(s: DataFrame, seen: DataFrame, p: float) -> DataFrame:
    hit = s.join(seen.withColumn("seen", F.lit(True)), ["seq_id", "token_id"], "left")
    x = F.col("score")
    return hit.withColumn("score", F.when(F.col("seen"), F.when(x < 0, x * p).otherwise(x / p)).otherwise(x)).drop("seen")


@rule
def repetition_penalty(p: float) -> Processor:
    return _each(lambda s, st: _penalized(s, st.select("seq_id", F.explode("ids").alias("token_id")).distinct(), p), lambda token, x, ids: F.when(F.array_contains(ids, token), F.when(x < 0, x * p).otherwise(x / p)).otherwise(x))


@rule
def encoder_repetition_penalty(p: float) -> Processor:
    """Rewards ids of the prompt: the inverse penalty."""
    return lambda s, st: _penalized(s, st.select("seq_id", F.explode(F.slice("ids", F.lit(1), F.col("prompt_len"))).alias("token_id")).distinct(), 1 / p)


@rule
def top_k(k: int, min_keep: int = 1) -> Processor:
    def run(s: DataFrame, st: DataFrame) -> DataFrame:
        rank = F.rank().over(_seq(F.desc("score")))  # ties with the last kept one stay
        return _drop(s.withColumn("rank", rank), F.col("rank") > max(k, min_keep)).drop("rank")

    return run


@rule
def top_p(p: float, min_keep: int = 1) -> Processor:
    """Keeps the smallest set of most probable ids whose mass reaches p."""

    def run(s: DataFrame, st: DataFrame) -> DataFrame:
        order = _seq(F.desc("score"), F.asc("token_id"))
        s = s.withColumn("p", _probability()).withColumns({"before": F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, -1)), "rank": F.row_number().over(order)})
        return _drop(s, (F.coalesce("before", F.lit(0.0)) >= p) & (F.col("rank") > min_keep)).drop("p", "before", "rank")

    return run


@rule
def min_p(p: float, min_keep: int = 1) -> Processor:
    return lambda s, st: _keep_best(s, F.col("score") < F.max("score").over(_seq()) + math.log(p), min_keep)


@rule
def typical_p(mass: float, min_keep: int = 1) -> Processor:
    """Keeps the ids whose surprise is nearest the entropy, up to the mass."""

    def run(s: DataFrame, st: DataFrame) -> DataFrame:
        s = s.withColumn("p", _probability())
        s = s.withColumn("h", F.sum(F.when(F.col("p") > 0, -F.col("p") * F.log("p")).otherwise(0.0)).over(_seq()))
        s = s.withColumn("off", F.when(F.col("p") > 0, F.abs(-F.log("p") - F.col("h"))).otherwise(F.lit(float("inf"))))
        order = _seq(F.asc("off"), F.asc("token_id"))
        s = s.withColumns({"before": F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, -1)), "rank": F.row_number().over(order)})
        return _drop(s, (F.coalesce("before", F.lit(0.0)) >= mass) & (F.col("rank") > min_keep)).drop("p", "h", "off", "before", "rank")

    return run


def _keep_best(s: DataFrame, bad: Column, min_keep: int = 1) -> DataFrame:
    """Drop what is bad, but never the best min_keep scores and their ties."""
    if min_keep == 1:
        return _drop(s, bad & (F.col("score") < F.max("score").over(_seq())))
    return _drop(s.withColumns({"bad": bad, "rank": F.rank().over(_seq(F.desc("score")))}), F.col("bad") & (F.col("rank") > min_keep)).drop("bad", "rank")


@rule
def epsilon_cutoff(eps: float, min_keep: int = 1) -> Processor:
    return lambda s, st: _keep_best(s.withColumn("p", _probability()), F.col("p") < eps, min_keep).drop("p")


@rule
def eta_cutoff(eps: float, min_keep: int = 1) -> Processor:
    def run(s: DataFrame, st: DataFrame) -> DataFrame:
        s = s.withColumn("p", _probability())
        s = s.withColumn("h", F.sum(F.when(F.col("p") > 0, -F.col("p") * F.log("p")).otherwise(0.0)).over(_seq()))
        return _keep_best(s, F.col("p") < F.least(F.lit(eps), math.sqrt(eps) * F.exp(-F.col("h"))), min_keep).drop("p", "h")

    return run


def _banned(s: DataFrame, bad: DataFrame) -> DataFrame:
    hit = s.join(bad.select("seq_id", "token_id").distinct().withColumn("bad", F.lit(True)), ["seq_id", "token_id"], "left")
    return _drop(hit, F.coalesce("bad", F.lit(False))).drop("bad")


def _repeats(source: DataFrame, state: DataFrame, n: int) -> DataFrame:
    """The ids that would complete an n-gram of the source again after the state's last n - 1 ids."""
    grams = source.where(F.size("ids") >= n).select("seq_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("ids") - (n - 1)), lambda i: F.slice("ids", i, n))).alias("g"))
    grams = grams.select("seq_id", F.slice("g", 1, n - 1).alias("head"), F.element_at("g", n).alias("token_id"))
    ends = state.where(F.size("ids") >= n - 1).select("seq_id", (F.slice("ids", -(n - 1), n - 1) if n > 1 else F.array().cast("array<int>")).alias("head"))
    return grams.join(ends, ["seq_id", "head"])


@rule
def no_repeat_ngram(n: int) -> Processor:
    return lambda s, st: _banned(s, _repeats(st, st, n))


@rule
def encoder_no_repeat_ngram(n: int) -> Processor:
    return lambda s, st: _banned(s, _repeats(st.select("seq_id", F.slice("ids", F.lit(1), F.col("prompt_len")).alias("ids")), st, n))


@rule
def sequence_bias(bias: dict[tuple[int, ...], float]) -> Processor:
    """Adds a bias to the last id of a sequence when the ids before it are there already; single ids always."""

    def run(s: DataFrame, st: DataFrame) -> DataFrame:
        s = _with_state(s, st, ids=F.col("ids"))
        add = F.lit(0.0)
        for seq, b in bias.items():
            head = list(seq[:-1])
            ready = (F.slice("ids", F.greatest(F.size("ids") - len(head) + 1, F.lit(1)), len(head)) == F.array(*map(F.lit, head))) if head else F.lit(True)
            add = add + F.when(ready & (F.col("token_id") == seq[-1]), b).otherwise(0.0)
        return s.withColumn("score", F.col("score") + add).drop("ids")

    return run


@rule
def no_bad_words(words: Sequence[Sequence[int]], eos_ids: Sequence[int] = ()) -> Processor:
    return sequence_bias({tuple(w): NEVER for w in words if list(w) not in [[e] for e in eos_ids]})


@rule
def prefix_constrained(allowed: DataFrame) -> Processor:
    """allowed(seq_id, token_id): all other ids are banned."""
    return lambda s, st: _drop(s.join(allowed.select("seq_id", "token_id").distinct().withColumn("ok", F.lit(True)), ["seq_id", "token_id"], "left"), F.col("ok").isNull()).drop("ok")


@rule
def hamming_diversity(current: DataFrame, penalty: float) -> Processor:
    """current(seq_id, token_id): what earlier beam groups chose in this step; each choice costs the penalty."""
    counts = current.groupBy("seq_id", "token_id").agg(F.count("*").alias("times"))
    return lambda s, st: s.join(counts, ["seq_id", "token_id"], "left").withColumn("score", F.col("score") - F.coalesce("times", F.lit(0)) * penalty).drop("times")


def _forced(s: DataFrame, now: Column, token_id: int) -> DataFrame:
    return s.withColumn("score", F.when(now, F.when(F.col("token_id") == token_id, 0.0).otherwise(NEVER)).otherwise(F.col("score")))


@rule
def forced_bos(token_id: int) -> Processor:
    return lambda s, st: _forced(_with_state(s, st, len=F.size("ids")), F.col("len") == 1, token_id).drop("len")


@rule
def forced_eos(token_id: int, max_length: int) -> Processor:
    return lambda s, st: _forced(_with_state(s, st, len=F.size("ids")), F.col("len") == max_length - 1, token_id).drop("len")


@rule
def force_tokens(at: dict[int, int]) -> Processor:
    def run(s: DataFrame, st: DataFrame) -> DataFrame:
        s = _with_state(s, st, len=F.size("ids"))
        for step, token_id in at.items():
            s = _forced(s, F.col("len") == step, token_id)
        return s.drop("len")

    return run


@rule
def remove_invalid() -> Processor:
    """NaN becomes 0, infinities the largest finite values."""
    big = 3.4028234663852886e38
    return lambda s, st: s.withColumn("score", F.greatest(F.least(F.nanvl("score", F.lit(0.0)), F.lit(big)), F.lit(-big)))


@rule
def exponential_decay(start: int, factor: float, eos_ids: Sequence[int]) -> Processor:
    def run(s: DataFrame, st: DataFrame) -> DataFrame:
        s = _with_state(s, st, over=F.size("ids") - F.col("prompt_len") - start)
        add = F.abs("score") * (F.pow(F.lit(factor), F.col("over")) - 1)
        return s.withColumn("score", F.when((F.col("over") > 0) & F.col("token_id").isin(*eos_ids), F.col("score") + add).otherwise(F.col("score"))).drop("over")

    return run


@rule
def log_normalize() -> Processor:
    def run(s: DataFrame, st: DataFrame) -> DataFrame:
        top = F.max("score").over(_seq())
        return s.withColumn("score", F.col("score") - top - F.log(F.sum(F.exp(F.col("score") - top)).over(_seq())))

    return run


@rule
def suppress(ids: Sequence[int]) -> Processor:
    return lambda s, st: _drop(s, F.col("token_id").isin(*ids))


@rule
def suppress_at_begin(ids: Sequence[int], begin: int) -> Processor:
    return lambda s, st: _drop(_with_state(s, st, len=F.size("ids")), (F.col("len") == begin) & F.col("token_id").isin(*ids)).drop("len")


@rule
def guidance(unconditional: DataFrame, scale: float) -> Processor:
    """Blends log-normalized scores with those of an unconditional scorer."""

    def run(s: DataFrame, st: DataFrame) -> DataFrame:
        a, b = log_normalize()(s, st), log_normalize()(unconditional, st).withColumnRenamed("score", "other")
        return a.join(b, ["seq_id", "token_id"]).select("seq_id", "token_id", ((F.col("score") - F.col("other")) * scale + F.col("other")).alias("score"))

    return run


@rule
def watermark(bias: float, greenlist_ratio: float = 0.25, key: int = 15485863) -> Processor:
    """Adds the bias to a hash-seeded green share of the vocabulary; the seed is the last id."""

    def run(s: DataFrame, st: DataFrame) -> DataFrame:
        s = _with_state(s, st, last=F.element_at("ids", -1))
        green = F.pmod(F.xxhash64(F.lit(key), "last", "token_id"), F.lit(1_000_000)) < int(greenlist_ratio * 1_000_000)
        return s.withColumn("score", F.when(green, F.col("score") + bias).otherwise(F.col("score"))).drop("last")

    return run


@rule
def prefix_allowed(allowed: Callable[[DataFrame], DataFrame]) -> Processor:
    """As prefix_constrained, with the allowed (seq_id, token_id) made from the state of each step."""
    return lambda s, st: prefix_constrained(allowed(st))(s, st)


@rule
def guided(unconditional: Scorer, scale: float) -> Processor:
    """As guidance, with the unconditional scores made from the state of each step."""
    return lambda s, st: guidance(unconditional(st), scale)(s, st)


def processors(c: GenerationConfig, prompt_len: int = 1, unconditional: Scorer | None = None, current: DataFrame | None = None, allowed: Callable[[DataFrame], DataFrame] | None = None) -> list[Processor]:
    """The processors a configuration asks for, in their published order. unconditional: the scorer that guidance_scale needs;
    current: what earlier beam groups chose in this step; allowed: from a state to the ids that may follow."""
    out: list[Processor] = []
    eos = c.eos_token_id or ()
    if c.guidance_scale not in (None, 1, 1.0):
        if unconditional is None:
            raise ValueError("guidance_scale needs an unconditional scorer")
        out.append(guided(unconditional, c.guidance_scale))
    if c.sequence_bias:
        out.append(sequence_bias({tuple(map(int, k)) if not isinstance(k, str) else tuple(map(int, k.split(","))): v for k, v in c.sequence_bias.items()}))
    if c.diversity_penalty and c.diversity_penalty > 0:
        if c.num_beam_groups < 2:
            raise ValueError("diversity_penalty needs beam groups")
        if current is not None:
            out.append(hamming_diversity(current, c.diversity_penalty))
    if c.encoder_repetition_penalty not in (None, 1.0):
        out.append(encoder_repetition_penalty(c.encoder_repetition_penalty))
    if c.repetition_penalty not in (None, 1.0):
        out.append(repetition_penalty(c.repetition_penalty))
    if c.no_repeat_ngram_size:
        out.append(no_repeat_ngram(c.no_repeat_ngram_size))
    if c.encoder_no_repeat_ngram_size:
        out.append(encoder_no_repeat_ngram(c.encoder_no_repeat_ngram_size))
    if c.bad_words_ids:
        out.append(no_bad_words(c.bad_words_ids, eos))
    if c.min_length and eos:
        out.append(min_length(c.min_length, eos))
    if c.min_new_tokens and eos:
        out.append(min_new_tokens(c.min_new_tokens, eos))
    if allowed is not None:
        out.append(prefix_allowed(allowed))
    if c.forced_bos_token_id is not None:
        out.append(forced_bos(c.forced_bos_token_id))
    if c.forced_eos_token_id is not None and c.max_length is not None:
        out.append(forced_eos(c.forced_eos_token_id, c.max_length))
    if c.remove_invalid_values:
        out.append(remove_invalid())
    if c.exponential_decay_length_penalty is not None:
        out.append(exponential_decay(*c.exponential_decay_length_penalty, eos))
    if c.suppress_tokens:
        out.append(suppress(c.suppress_tokens))
    if c.begin_suppress_tokens:
        out.append(suppress_at_begin(c.begin_suppress_tokens, prompt_len))
    if c.forced_decoder_ids:
        out.append(force_tokens(dict(c.forced_decoder_ids)))
    if c.watermarking_config:
        w = c.watermarking_config
        out.append(watermark(w.get("bias", 2.0), w.get("greenlist_ratio", 0.25), w.get("hashing_key", 15485863)))
    return out


def warpers(c: GenerationConfig) -> list[Processor]:
    """Warpers for sampling, in order; beams keep one id more than there are end ids, so that one of them goes on."""
    keep = len(c.eos_token_id or (0,)) + 1 if c.num_beams > 1 else 1
    out: list[Processor] = []
    if c.temperature not in (None, 1.0):
        out.append(temperature(c.temperature))
    if c.top_k:
        out.append(top_k(c.top_k, keep))
    if c.top_p is not None and c.top_p < 1:
        out.append(top_p(c.top_p, keep))
    if c.min_p is not None:
        out.append(min_p(c.min_p, keep))
    if c.typical_p is not None and c.typical_p < 1:
        out.append(typical_p(c.typical_p, keep))
    if c.epsilon_cutoff and 0 < c.epsilon_cutoff < 1:
        out.append(epsilon_cutoff(c.epsilon_cutoff, keep))
    if c.eta_cutoff and 0 < c.eta_cutoff < 1:
        out.append(eta_cutoff(c.eta_cutoff, keep))
    if c.renormalize_logits:
        out.append(log_normalize())
    return out


def merged_list(own: Sequence, custom: Sequence) -> list:
    """Own rules or stops, then custom ones; a kind that the configuration has made already is an error. Plain functions have no kind."""
    kind = lambda x: getattr(x, "kind", None if callable(x) else type(x).__name__)
    kinds = {kind(x) for x in own} - {None}
    for x in custom:
        if kind(x) in kinds:
            raise ValueError(f"{kind(x)} is set by the configuration already")
    return [*own, *custom]


class StopStrings:
    """An automaton over characters that all stop strings share. A sequence carries its state, each chosen token's text advances it, and a
    string is found wherever it ends, cut across tokens or not; nothing is decoded again.

    tokens has token_id and text; strings and texts are in the same alphabet (for byte-level vocabularies that of bytes).
    """

    kind = "StopStrings"

    def __init__(self, strings: Sequence[str], tokens: DataFrame):
        if not strings or not all(strings):
            raise ValueError("stop strings must not be empty")
        self.tokens, self.longest = tokens.select("token_id", F.col("text").alias("stop_text")), max(map(len, strings))
        heads = sorted({s[:k] for s in strings for k in range(len(s) + 1)}, key=lambda h: (len(h), h))
        place = {h: i for i, h in enumerate(heads)}
        self.ends = [i for h, i in place.items() if h.endswith(tuple(strings))]
        self.moves: dict[str, int] = {}
        for h in heads:  # the longest end of what is read that begins a string
            for ch in sorted(set("".join(strings))):
                to = next(place[(h + ch)[k:]] for k in range(len(h) + 2) if (h + ch)[k:] in place)
                if to:
                    self.moves[f"{place[h]}:{ch}"] = to

    def after(self, at: Column, text: Column) -> Column:
        """struct(at, hit) once the text has been read in state ``at``."""
        moves = F.create_map(*[F.lit(x) for kv in self.moves.items() for x in kv])

        def step(acc: Column, ch: Column) -> Column:
            to = F.coalesce(F.try_element_at(moves, F.concat_ws(":", acc["at"], ch)), F.lit(0))
            return F.struct(to.alias("at"), (acc["hit"] | to.isin(*self.ends)).alias("hit"))

        return F.aggregate(F.filter(F.split(text, ""), lambda ch: ch != ""), F.struct(at.cast("int").alias("at"), F.lit(False).alias("hit")), step)

    def start(self, state: DataFrame) -> DataFrame:
        """seq_id and stop_at after the prompt: a string may begin there, but one that ends there does not count."""
        tail = state.select("seq_id", F.posexplode(F.slice("ids", F.greatest(F.size("ids") - self.longest + 1, F.lit(1)), self.longest)).alias("pos", "token_id"))
        text = tail.join(F.broadcast(self.tokens), "token_id").groupBy("seq_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "stop_text"))), lambda x: x.stop_text), "").alias("text"))
        return state.join(text.select("seq_id", self.after(F.lit(0), F.col("text"))["at"].alias("stop_at")), "seq_id", "left").withColumn("stop_at", F.coalesce("stop_at", F.lit(0)))

    def read(self, chosen: DataFrame) -> DataFrame:
        """Rows with stop_at and token_id: stop_at behind the token, and stop_hit."""
        found = chosen.join(F.broadcast(self.tokens), "token_id", "left").withColumn("stop_", self.after(F.col("stop_at"), F.coalesce("stop_text", F.lit(""))))
        return found.withColumns({"stop_at": F.col("stop_.at"), "stop_hit": F.col("stop_.hit")}).drop("stop_", "stop_text")


def stops(c: GenerationConfig, tokens: DataFrame | None = None, form: Callable[[str], str] = str, custom: Sequence = ()) -> list:
    """The stops of a configuration that are objects: a time budget and stop strings. form turns a string into the alphabet of tokens."""
    own: list = []
    if c.max_time is not None:
        own.append(MaxTime(c.max_time))
    if c.stop_strings:
        if tokens is None:
            raise ValueError("stop_strings need the vocabulary's token texts")
        own.append(StopStrings([form(s) for s in c.stop_strings], tokens))
    return merged_list(own, custom)


# --- loops -----------------------------------------------------------------------------------------------------

def bigram_table(sequences: DataFrame, ids: str) -> DataFrame:
    """prev, token_id and score: how often an id follows another, over all sequences. Stretches of an Arrow batch are counted in place, then counts are summed."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            upto = np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < len(rows):
                end = max(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 2_000_000, "right")), at + 1)
                part = rows.slice(at, end - at)
                flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                follows = np.ones(len(flat), dtype=bool)
                first = upto[at : end - 1] - (upto[at - 1] if at else 0)
                follows[first[first < len(flat)]] = False  # each later row's first id
                pair, n = np.unique((flat[:-1] << 32 | flat[1:])[follows[1:]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((pair >> 32).astype(np.int32)), pa.array((pair & 0xFFFFFFFF).astype(np.int32)), pa.array(n.astype(np.int64))], ["prev", "token_id", "n"])
                at = end

    counted = sequences.select(F.col(ids).cast("array<int>").alias("ids")).mapInArrow(counts, "prev int, token_id int, n long")
    return counted.groupBy("prev", "token_id").agg(F.sum("n").cast("double").alias("score"))


def bigram_scorer(table: DataFrame, small: bool = False) -> Scorer:
    """Scores by the last id alone, and so with ``last_ids``, the ids (token_id) that have some. small: the vocabulary is so small that its scores may go to every task."""

    def scores(state: DataFrame) -> DataFrame:
        return state.select("seq_id", F.element_at("ids", -1).alias("prev")).join(F.broadcast(table) if small else table, "prev").select("seq_id", "token_id", "score")

    scores.last_ids, scores.small = table.select(F.col("prev").alias("token_id")).distinct(), small
    return scores


def of_last_ids(scorer: Scorer) -> DataFrame | None:
    """seq_id, token_id and score: all scores of a scorer that looks at the last id alone, with that id as seq_id; None for other scorers."""
    last = getattr(scorer, "last_ids", None)
    return None if last is None else scorer(last.select(F.col("token_id").alias("seq_id"), F.array(F.col("token_id").cast("int")).alias("ids"), F.lit(1).alias("prompt_len"), F.lit(False).alias("done")))


def best_token(scores: DataFrame) -> DataFrame:
    """The highest score of each sequence, the smallest id on ties."""
    return scores.where(F.col("score") > NEVER).groupBy("seq_id").agg(F.max_by("token_id", F.struct("score", -F.col("token_id"))).alias("token_id"))


def sampled_token(scores: DataFrame, seed: int) -> DataFrame:
    """One id per sequence, by its probability (Gumbel noise from a hash of seed, sequence and id, so a retried task draws the same)."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "seq_id", "token_id"), F.lit(2**52)) + 0.5) / 2.0**52
    noisy = scores.where(F.col("score") > NEVER).withColumn("noisy", F.col("score") - F.log(-F.log(u)))
    return noisy.groupBy("seq_id").agg(F.max_by("token_id", F.struct("noisy", -F.col("token_id"))).alias("token_id"))


def _stop(c: GenerationConfig, cut: Column | int = 0) -> Column:
    """cut: how many ids of the prompt the column leaves out."""
    flags = [F.size("ids") + cut >= lengths(c, F.col("prompt_len"))[1]]
    if c.eos_token_id:
        flags.append(eos_stop(F.col("ids"), c.eos_token_id))
    return any_of(flags)


def generate(
    state: DataFrame, scorer: Scorer, c: GenerationConfig, seed: int = 0, custom: Sequence[Processor] = (), save: Callable[[DataFrame], DataFrame] | None = None, every: int = 4,
    unconditional: Scorer | None = None, allowed: Callable[[DataFrame], DataFrame] | None = None, stopping: Sequence = (),
) -> DataFrame:
    """Greedy search or sampling: seq_id and ids. Finished rows take the pad id while others go on; a context without a score ends.

    stopping: what stops() gives. The number of steps is bounded by the configuration; the loop ends early once no row is open.
    State is saved after every ``every`` steps; a step reads it twice, so steps that are not saved are computed again.
    """
    mode = generation_mode(c)
    if mode not in (GenerationMode.GREEDY_SEARCH, GenerationMode.SAMPLE):
        raise NotImplementedError(mode)
    if c.stop_strings and not any(isinstance(x, StopStrings) for x in stopping):
        raise ValueError("stop_strings are asked for: pass stops(config, tokens) as stopping")
    save = save or (lambda df: df.checkpoint())
    pad = c.pad_token_id if c.pad_token_id is not None else (c.eos_token_id or (0,))[0]
    rules = [*merged_list(processors(c, unconditional=unconditional, allowed=allowed), custom), *(warpers(c) if mode == GenerationMode.SAMPLE else [])]
    limit = next((x for x in stopping if isinstance(x, MaxTime)), MaxTime(c.max_time) if c.max_time else None)
    strings = next((x for x in stopping if isinstance(x, StopStrings)), None)
    steps = c.max_new_tokens if c.max_new_tokens is not None else c.max_length or 20
    state = state.withColumn("done", F.col("done") | too_long(c, F.col("prompt_len")))
    state = save(strings.start(state) if strings else state)
    kept = ["stop_at"] if strings else []
    for step in range(steps):
        live = state.where("not done")
        scores = scorer(live)
        for own in rules:
            scores = own(scores, live)
        chosen = sampled_token(scores, seed + step) if mode == GenerationMode.SAMPLE else best_token(scores)
        both = state.join(chosen, "seq_id", "left")
        both = strings.read(both) if strings else both.withColumn("stop_hit", F.lit(False))
        grown = F.when(F.col("done"), F.when(F.lit(bool(c.eos_token_id or strings)), F.concat("ids", F.array(F.lit(pad)))).otherwise(F.col("ids")))
        grown = grown.when(F.col("token_id").isNull(), F.col("ids")).otherwise(F.concat("ids", F.array(F.col("token_id").cast("int"))))
        ended = F.col("done") | F.col("token_id").isNull() | F.col("stop_hit")
        state = both.select("seq_id", "prompt_len", grown.alias("ids"), ended.alias("done"), *kept)
        state = state.withColumn("done", F.col("done") | _stop(c))
        if (step + 1) % every == 0 or step + 1 == steps or limit:
            state = save(state)
            if (limit and limit.over()) or state.where("not done").limit(1).count() == 0:
                break
    return state.select("seq_id", "ids")
