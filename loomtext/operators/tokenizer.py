"""A tokenizer as one object: text to tokens, ids and model-ready rows, and back. Every method returns a plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.options import AddedToken, EncodeOptions, Family, TokenizerConfig
from ..sources.files import read_pieces, read_tokenizer_json
from . import decode as D
from . import vocab as V
from .bpe import WORD_END, merge_word, piece_tokens, piece_units, subwords
from .encode import prepare


@dataclass(frozen=True)
class Tokenizer:
    """family decides pre-tokens, templates and decoding. Vocabularies are files of fixed size and live on the driver."""

    family: Family
    vocab: dict[str, int]
    ranks: dict[tuple[str, str], int] = field(default_factory=dict)
    scores: dict[str, float] = field(default_factory=dict)
    config: TokenizerConfig = field(default_factory=TokenizerConfig)
    added: tuple[AddedToken, ...] = ()
    word_end: str = ""

    def __post_init__(self):
        known = [t.content for t in self.added]
        new = [*self.config.added_tokens, *[getattr(self.config, s) for s in ("bos_token", "eos_token", "unk_token", "sep_token", "pad_token", "cls_token", "mask_token") if getattr(self.config, s)], *[AddedToken(x, special=True) for x in self.config.additional_special_tokens]]
        placed = {t.content: t.id for t in new if t.id is not None}
        tokens, _ = V.add_tokens(self.vocab, self.added, [t for t in new if t.content not in known], lower=self.config.do_lower_case)
        object.__setattr__(self, "added", tuple(replace(t, id=placed.get(t.content, t.id)) for t in tokens))
        if self.family == Family.WORD_END and not self.word_end:
            object.__setattr__(self, "word_end", WORD_END)
        if self.config.unk_token:
            V.require(self.whole_vocab(), self.config.unk_token.content)

    @classmethod
    def from_json(cls, path: str, family: Family, config: TokenizerConfig | None = None) -> Tokenizer:
        vocab, merges = read_tokenizer_json(path)
        return cls(family, vocab, {m: r for r, m in enumerate(merges)}, config=config or TokenizerConfig())

    @classmethod
    def from_pieces(cls, path: str, config: TokenizerConfig | None = None) -> Tokenizer:
        scores = read_pieces(path)
        return cls(Family.PIECES, {p: i for i, p in enumerate(scores)}, scores=scores, config=config or TokenizerConfig(add_bos_token=True))

    def whole_vocab(self) -> dict[str, int]:
        """The vocabulary overlaid with the added tokens."""
        return self.vocab | {t.content: t.id for t in self.added}

    def add_tokens(self, tokens: Sequence[str | AddedToken], special: bool = False) -> Tokenizer:
        """A tokenizer that knows more tokens; ids go on from the end."""
        return replace(self, added=tuple(V.add_tokens(self.vocab, self.added, tokens, special, self.config.do_lower_case)[0]))

    def token_id(self, token: AddedToken | None) -> int | None:
        return None if token is None else self.whole_vocab().get(token.content)

    def special_ids(self) -> list[int]:
        v = self.whole_vocab()
        return [v[t] for t in self.config.special_tokens() if t in v]

    def words(self, text: Column) -> Column:
        """The units of merging: pre-tokens; an added token is one unit, marked by a sign in front; so is a unit that begins with the marker itself."""
        if self.family == Family.BYTE_LEVEL:
            text = T.prefix_space(text, self.config.add_prefix_space)
        contents = [t.content for t in self.added]
        if self.config.do_lower_case:
            text = T.protected_lower(text, [t.content for t in self.added if t.special or t.normalized])
        if self.config.split_special_tokens:
            contents = [t.content for t in self.added if not t.special]
        parts = T.split_added(text, contents)
        parts = T.strip_neighbours(parts, [t.content for t in self.added if t.rstrip], [t.content for t in self.added if t.lstrip])
        parts = T.rejoin_single_words(parts, [t.content for t in self.added if t.single_word])

        def units(part: Column) -> Column:
            if self.family == Family.WORD_END:
                return T.word_end_pretokens(part)
            if self.family == Family.BYTE_LEVEL:
                return T.byte_level_pretokens(part)
            return F.array(part)

        own = lambda p: F.transform(units(p), lambda u: F.when(u.startswith(T.MARK), F.concat(F.lit(f"{T.MARK}-"), u)).otherwise(u))
        if not contents:
            return F.flatten(F.transform(parts, own))
        return F.flatten(F.transform(parts, lambda p: F.when(F.array_contains(F.lit(contents), p), F.array(F.concat(F.lit(f"{T.MARK}+"), p))).otherwise(own(p))))

    def _basic(self, text: Column) -> Column:
        """The word-end family works on cleaned, lower-cased words; added tokens are kept whole."""
        if self.family != Family.WORD_END:
            return text
        return F.array_join(T.basic_tokens(text, strip=False, never_split=[t.content for t in self.added]), " ")

    def _subwords(self, text: str, ids: bool) -> Column:
        ranks, scores, end, family = self.ranks, self.scores, self.word_end, self.family
        pattern = piece_units(scores) if family == Family.PIECES else None

        def one(word: str) -> list[str]:
            if word.startswith(T.MARK):
                if word[1] == "+":
                    return [word[2:]]
                word = word[2:]
            if family == Family.PIECES:
                whole = T.LOWER_BAR + word.replace(T.LOWER_BAR, " ").replace(" ", T.LOWER_BAR)
                return [t for unit in pattern.findall(whole) for t in piece_tokens(unit, scores)]
            return merge_word(T.byte_encoded(word), ranks, end)

        return subwords(self.words(self._basic(F.col(text))), one, self.whole_vocab() if ids else None, self.token_id(self.config.unk_token) if ids else None)

    def tokenize(self, df: DataFrame, text: str = "text", out: str = "tokens") -> DataFrame:
        """df with the tokens of a text column: one narrow pass."""
        return df.withColumn(out, self._subwords(text, False))

    def ids_of(self, text: str) -> Column:
        """The ids of a text column, in the same pass; a null text has none. Without an unknown token, a token that has no id is an error."""
        return F.coalesce(self._subwords(text, True), F.array().cast("array<int>"))

    def ids(self, df: DataFrame, key: Sequence[str], text: str = "text", out: str = "ids") -> DataFrame:
        """key and the ids of a text column, one row for each row."""
        return df.select(*key, self.ids_of(text).alias(out))

    def encode(self, df: DataFrame, key: Sequence[str], text: str = "text", pair: str | None = None, target: str | None = None, options: EncodeOptions | None = None, batch: str | None = None) -> DataFrame:
        """Model-ready rows, one for each row; a target column adds its ids as labels."""
        options = options or EncodeOptions(padding_side=self.config.padding_side, truncation_side=self.config.truncation_side, model_max_length=self.config.model_max_length, model_input_names=self.config.model_input_names)
        more = [self.ids_of(column).alias(name) for column, name in ((text, "first_"), (pair, "second_"), (target, "labels")) if column]
        out = df.select(*key, *([batch] if batch and batch not in key else []), *more)
        ids = {"bos_id": self.token_id(self.config.bos_token) or 0, "eos_id": self.token_id(self.config.eos_token) or 0, "pad_id": self.token_id(self.config.pad_token) or 0}
        flags = {} if self.family == Family.WORD_END else {"bos": self.config.add_bos_token, "eos": self.config.add_eos_token}
        return prepare(out, "first_", options, self.family, "second_" if pair else None, batch=batch, **ids, **flags)

    def decode(self, df: DataFrame, key: Sequence[str], ids: str = "input_ids", skip_special: bool = False, clean_up: bool | None = None, spaces_between: bool = True) -> DataFrame:
        special = self.config.special_tokens()
        alone = [t.content for t in self.added if t.content not in special]
        clean = self.config.clean_up_tokenization_spaces if clean_up is None else clean_up
        return D.decode(df, key, ids, self.whole_vocab(), self.family, self.special_ids() if skip_special else (), alone, clean, spaces_between)


#: Tokenizer classes of configuration files and their families.
FAMILIES = {"CLIPTokenizer": Family.WORD_END, "GPT2Tokenizer": Family.BYTE_LEVEL, "LlamaTokenizer": Family.PIECES}


def load(path: str, config: TokenizerConfig) -> Tokenizer:
    """The tokenizer a configuration names, over a vocabulary file."""
    family = FAMILIES.get((config.tokenizer_class or "").removesuffix("Fast"))
    if family is None:
        raise ValueError(f"unknown tokenizer class {config.tokenizer_class!r}")
    return Tokenizer.from_pieces(path, config) if family == Family.PIECES else Tokenizer.from_json(path, family, config)
