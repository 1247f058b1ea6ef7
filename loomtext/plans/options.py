"""Options as frozen dataclasses; they decide the plan's shape before Spark sees it."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from enum import StrEnum


class Padding(StrEnum):
    NONE = "none"
    LONGEST = "longest"
    MAX_LENGTH = "max_length"


class Truncation(StrEnum):
    NONE = "none"
    LONGEST_FIRST = "longest_first"
    ONLY_FIRST = "only_first"
    ONLY_SECOND = "only_second"


class Side(StrEnum):
    RIGHT = "right"
    LEFT = "left"


class Family(StrEnum):
    WORD_END = "word_end"  # byte pairs with word ends: bos a eos / bos a eos eos b eos
    BYTE_LEVEL = "byte_level"  # byte pairs with leading blanks: [bos] a [bos] b
    PIECES = "pieces"  # scored pieces: [bos] a [eos] [bos] b [eos]
    PLAIN = "plain"  # no special tokens


class GenerationMode(StrEnum):
    GREEDY_SEARCH = "greedy_search"
    SAMPLE = "sample"
    CONTRASTIVE_SEARCH = "contrastive_search"
    BEAM_SEARCH = "beam_search"
    BEAM_SAMPLE = "beam_sample"
    GROUP_BEAM_SEARCH = "group_beam_search"
    CONSTRAINED_BEAM_SEARCH = "constrained_beam_search"
    ASSISTED_GENERATION = "assisted_generation"
    DOLA_GENERATION = "dola_generation"


@dataclass(frozen=True)
class AddedToken:
    content: str
    id: int | None = None
    single_word: bool = False
    lstrip: bool = False
    rstrip: bool = False
    special: bool = False
    normalized: bool | None = None

    def __post_init__(self):
        if self.normalized is None:
            object.__setattr__(self, "normalized", not self.special)

    @classmethod
    def parse(cls, value, token_id: int | None = None, tagged: bool = False) -> AddedToken | None:
        """A token is a string or an object; tagged objects must say that they are an AddedToken."""
        if value is None:
            return None
        if isinstance(value, str):
            return cls(value, token_id, special=True)
        if tagged and value.get("__type") != "AddedToken":
            raise ValueError(f"not an added token: {value}")
        names = {f.name for f in fields(cls)}
        return cls(**({k: v for k, v in value.items() if k in names} | ({"id": token_id} if token_id is not None else {})))


SLOTS = ("bos_token", "eos_token", "unk_token", "sep_token", "pad_token", "cls_token", "mask_token")


@dataclass(frozen=True)
class TokenizerConfig:
    """Unknown keys of the JSON are ignored; token slots take strings or added-token objects."""

    tokenizer_class: str | None = None
    add_prefix_space: bool = False
    add_bos_token: bool = False
    add_eos_token: bool = False
    added_tokens: tuple[AddedToken, ...] = ()
    additional_special_tokens: tuple[str, ...] = ()
    bos_token: AddedToken | None = None
    eos_token: AddedToken | None = None
    unk_token: AddedToken | None = None
    sep_token: AddedToken | None = None
    pad_token: AddedToken | None = None
    cls_token: AddedToken | None = None
    mask_token: AddedToken | None = None
    do_lower_case: bool = False
    errors: str = "replace"
    legacy: bool = True
    model_input_names: tuple[str, ...] = ("input_ids", "token_type_ids", "attention_mask")
    clean_up_tokenization_spaces: bool = True
    split_special_tokens: bool = False
    model_max_length: int = 2**31 - 1
    padding_side: Side = Side.RIGHT
    truncation_side: Side = Side.RIGHT

    @classmethod
    def from_json(cls, text: str) -> TokenizerConfig:
        raw = json.loads(text)
        names = {f.name for f in fields(cls)}
        out = {k: v for k, v in raw.items() if k in names and v is not None}
        for slot in SLOTS:
            if slot in out:
                out[slot] = AddedToken.parse(out[slot])
        out["added_tokens"] = tuple(AddedToken.parse(v, int(k)) for k, v in (raw.get("added_tokens_decoder") or {}).items())
        for k in ("model_input_names", "additional_special_tokens"):
            if k in out:
                out[k] = tuple(out[k])
        for k in ("padding_side", "truncation_side"):
            if k in out:
                out[k] = Side(str(out[k]).lower())
        if "model_max_length" in out:
            out["model_max_length"] = int(min(out["model_max_length"], 2**31 - 1))
        return cls(**out)

    def special_tokens(self) -> list[str]:
        """All special tokens once, slots first."""
        slots = [getattr(self, s).content for s in SLOTS if getattr(self, s)]
        return list(dict.fromkeys([*slots, *self.additional_special_tokens]))

    def special_tokens_map(self) -> dict[str, str]:
        return {s: getattr(self, s).content for s in SLOTS if getattr(self, s)}


@dataclass(frozen=True)
class EncodeOptions:
    add_special_tokens: bool = True
    padding: Padding = Padding.NONE
    truncation: Truncation = Truncation.NONE
    max_length: int | None = None
    stride: int = 0
    is_split_into_words: bool = False
    pad_to_multiple_of: int | None = None
    return_token_type_ids: bool | None = None
    return_attention_mask: bool | None = None
    return_overflowing_tokens: bool = False
    return_special_tokens_mask: bool = False
    return_length: bool = False
    padding_side: Side = Side.RIGHT
    truncation_side: Side = Side.RIGHT
    model_max_length: int = 2**31 - 1
    model_input_names: tuple[str, ...] = ("input_ids", "token_type_ids", "attention_mask")

    def validate(self, pair: bool) -> None:
        if self.return_token_type_ids and not self.add_special_tokens:
            raise ValueError("token type ids need the special tokens")
        if self.return_overflowing_tokens and self.truncation == Truncation.LONGEST_FIRST and pair:
            raise ValueError("overflowing tokens of a pair have no order under longest_first truncation")


@dataclass(frozen=True)
class ModelConfig:
    """What a scorer's configuration file says; other keys are ignored."""

    vocab_size: int | None = None
    hidden_size: int | None = None
    num_attention_heads: int | None = None
    num_hidden_layers: int | None = None
    architectures: tuple[str, ...] = ()
    is_encoder_decoder: bool = False
    sliding_window: int | None = None
    max_position_embeddings: int | None = None

    @classmethod
    def from_json(cls, text: str) -> ModelConfig:
        names = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text).items() if k in names and v is not None})


@dataclass(frozen=True)
class GenerationConfig:
    """Defaults as published for the generation options; None leaves an option out."""

    max_length: int | None = 20
    max_new_tokens: int | None = None
    min_length: int | None = 0
    min_new_tokens: int | None = None
    early_stopping: str | bool = False
    max_time: float | None = None
    stop_strings: tuple[str, ...] | None = None
    do_sample: bool = False
    num_beams: int = 1
    num_beam_groups: int = 1
    penalty_alpha: float | None = None
    use_cache: bool = True
    temperature: float | None = 1.0
    top_k: int | None = 50
    top_p: float | None = 1.0
    min_p: float | None = None
    typical_p: float | None = 1.0
    epsilon_cutoff: float | None = 0.0
    eta_cutoff: float | None = 0.0
    diversity_penalty: float | None = 0.0
    repetition_penalty: float | None = 1.0
    encoder_repetition_penalty: float | None = 1.0
    length_penalty: float | None = 1.0
    no_repeat_ngram_size: int | None = 0
    bad_words_ids: tuple[tuple[int, ...], ...] | None = None
    force_words_ids: tuple[tuple[int, ...], ...] | None = None
    renormalize_logits: bool = False
    constraints: tuple[str, ...] | None = None
    forced_bos_token_id: int | None = None
    forced_eos_token_id: int | None = None
    remove_invalid_values: bool = False
    exponential_decay_length_penalty: tuple[int, float] | None = None
    suppress_tokens: tuple[int, ...] | None = None
    begin_suppress_tokens: tuple[int, ...] | None = None
    forced_decoder_ids: tuple[tuple[int, int], ...] | None = None
    sequence_bias: dict | None = None
    token_healing: bool = False
    guidance_scale: float | None = None
    low_memory: bool | None = None
    watermarking_config: dict | None = None
    num_return_sequences: int = 1
    output_attentions: bool = False
    output_hidden_states: bool = False
    output_scores: bool = False
    output_logits: bool = False
    return_dict_in_generate: bool = False
    bos_token_id: int | None = None
    eos_token_id: tuple[int, ...] | None = None
    pad_token_id: int | None = None
    encoder_no_repeat_ngram_size: int | None = 0
    decoder_start_token_id: tuple[int, ...] | None = None
    num_assistant_tokens: int | None = 5
    num_assistant_tokens_schedule: str = "heuristic"
    prompt_lookup_num_tokens: int | None = None
    max_matching_ngram_size: int | None = None
    dola_layers: str | tuple[int, ...] | None = None
    cache_implementation: str | None = None
    cache_config: dict | None = None
    return_legacy_cache: bool = False
    transformers_version: str | None = None
    extra: dict = field(default_factory=dict, compare=False)

    @classmethod
    def from_json(cls, text: str) -> GenerationConfig:
        raw = json.loads(text)
        names = {f.name for f in fields(cls)} - {"extra"}
        out = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in names}
        for k in ("eos_token_id", "decoder_start_token_id"):
            if isinstance(out.get(k), int):
                out[k] = (out[k],)
        return cls(**out, extra={k: v for k, v in raw.items() if k not in names})

    def to_json(self) -> str:
        out = asdict(self)
        return json.dumps({k: v for k, v in (out | out.pop("extra")).items() if v is not None}, sort_keys=True)
