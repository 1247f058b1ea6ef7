"""Text functions as Catalyst expressions; Python runs only where Spark has no function (Unicode normal forms)."""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: ASCII symbols count as punctuation beside category P (assumption: the published BERT rules).
PUNCTUATION = r"\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E\p{P}"
#: Control characters besides tab, newline and carriage return, and the two replaced characters.
CONTROL = r"[\p{C}\x{FFFD}&&[^\t\n\r]]"
SPACE = r"[\t\n\r\p{Zs}]"
#: The published pre-token patterns of the two byte-pair families.
WORD_END_PATTERN = r"(?iU)<\|startoftext\|>|<\|endoftext\|>|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_LEVEL_PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What the clean-up of decoded text replaces, in this order.
CLEANUP = ((" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ' ", "'"), (" n't", "n't"), (" 'm", "'m"), (" 's", "'s"), (" 've", "'ve"), (" 're", "'re"))
MARK = "\ue000"
MANY = 100  # words up to which one alternation finds them
LOWER_BAR = "▁"


def byte_alphabet() -> list[str]:
    """The printable character of each byte: itself where it is visible, else the next free one from U+0100."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(free)) for b in range(256)]


_HIDDEN = [(chr(b), c) for b, c in enumerate(byte_alphabet()) if chr(b) != c]
_FROM, _TO = "".join(a for a, _ in _HIDDEN), "".join(b for _, b in _HIDDEN)


def clean_text(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, CONTROL, ""), SPACE, " ")


def _normal(form: str):
    @F.pandas_udf(StringType())
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return normal


def normalize(c: Column, form: str = "NFC") -> Column:
    """Canonical form; plain ASCII text never reaches Python's normalizer as more than null."""
    other = c.rlike(r"[^\x00-\x7F]")
    return F.when(other, _normal(form)(F.when(other, c))).otherwise(c)


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def whitespace_tokens(c: Column) -> Column:
    """Split at every white-space character of the trimmed text; runs give empty tokens."""
    t = trim(c)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"(?U)\s", -1))


def strip_accents(c: Column) -> Column:
    """Canonical decomposition without nonspacing marks; the result stays decomposed."""
    return F.regexp_replace(normalize(c, "NFD"), r"\p{Mn}+", "")


def split_punctuation(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"[{PUNCTUATION}]|[^{PUNCTUATION}]+"), F.lit(0))


def basic_tokens(c: Column, lower: bool = True, strip: bool | None = None, never_split: Sequence[str] = (), chinese: bool = False) -> Column:
    """Clean, normalize, split at white space, fold case and accents, part punctuation; never_split words stay whole."""
    text = normalize(clean_text(c))
    if chinese:
        text = F.regexp_replace(text, r"([\p{IsHan}])", " $1 ")
    fold = (lambda w: strip_accents_later(F.lower(w), strip is not False)) if lower else (lambda w: strip_accents_later(w, strip is True))
    if not never_split:  # folding never makes or removes white space, so it may run on the whole text
        words = whitespace_tokens(text)
        folded = fold(F.array_join(words, " "))
        return F.filter(F.flatten(F.transform(F.split(folded, " ", -1), split_punctuation)), lambda x: x != "")
    keep = [F.lit(x) for x in never_split]
    words = whitespace_tokens(text)
    folded = F.split(fold(F.array_join(words, " ")), " ", -1)
    parts = F.zip_with(words, folded, lambda w, f: F.when(w.isin(*keep), F.array(w)).otherwise(split_punctuation(f)))
    return F.filter(F.flatten(parts), lambda x: x != "")


def strip_accents_later(c: Column, on: bool) -> Column:
    return strip_accents(c) if on else c


def word_end_pretokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD_END_PATTERN), F.lit(0))


def byte_level_pretokens(c: Column) -> Column:
    """Lossless: the pre-tokens joined give the text."""
    return F.regexp_extract_all(c, F.lit(BYTE_LEVEL_PATTERN), F.lit(0))


_BYTE_TABLE = dict(enumerate(byte_alphabet()))


def byte_encode(c: Column) -> Column:
    return F.translate(F.decode(F.encode(c, "UTF-8"), "ISO-8859-1"), _FROM, _TO)


def byte_encoded(word: str) -> str:
    """byte_encode for helpers that see single words."""
    return word.encode("utf-8", "surrogatepass").decode("latin-1").translate(_BYTE_TABLE)


def _bytes_of(c: Column) -> Column:
    """The alphabet's characters back as bytes; translate() reads a NUL as a deletion, so that byte goes by itself."""
    return F.replace(F.translate(c, _TO[1:], _FROM[1:]), F.lit(_TO[0]), F.lit(_FROM[0]))


def byte_decode(c: Column) -> Column:
    """Inverse of byte_encode for whole characters; see byte_decode_lossy for ids that may be cut."""
    return F.decode(F.encode(_bytes_of(c), "ISO-8859-1"), "UTF-8")


@F.pandas_udf(StringType())
def _lossy(s: pd.Series) -> pd.Series:
    table = {ord(c): b for b, c in enumerate(byte_alphabet())}
    return s.map(lambda x: None if x is None else bytes(table[ord(ch)] for ch in x).decode("utf-8", "replace"))


def byte_decode_lossy(c: Column) -> Column:
    """Inverse of byte_encode in which broken UTF-8 becomes U+FFFD; text of single bytes stays in the JVM."""
    plain = c.rlike(f"^[\\x21-\\x7E{_TO[10]}{_TO[32]}]*$")
    return F.when(plain, _bytes_of(c)).otherwise(_lossy(F.when(~plain, c)))


def cleanup_spaces(c: Column) -> Column:
    for a, b in CLEANUP:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def alternation(words: Sequence[str]) -> str:
    """One pattern that matches any of the words, the longest first."""
    return "|".join(re.escape(w) for w in sorted(set(words), key=lambda w: (-len(w), w)))


def _split_few(c: Column, words: Sequence[str]) -> Column:
    """By one alternation. The marker may occur in texts and words: two characters that no word has tell an own one from a mark."""
    used = set("".join(words))
    own, mark = itertools.islice((MARK + chr(i) for i in range(0xE001, 0xF8FF) if chr(i) not in used), 2)
    escaped = F.replace(c, F.lit(MARK), F.lit(own))
    found = F.split(F.regexp_replace(escaped, f"({alternation([w.replace(MARK, own) for w in words])})", f"{mark}$1{mark}"), mark, -1)
    return F.transform(found, lambda x, i: F.struct(F.replace(x, F.lit(own), F.lit(MARK)).alias("text"), (i % 2 == 1).alias("added")))


def _split_many(c: Column, words: Sequence[str]) -> Column:
    """By an automaton over all words, in time proportional to the text whatever their number."""

    @F.pandas_udf("array<struct<text:string,added:boolean>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        known = ahocorasick.Automaton()
        for w in words:
            known.add_word(w, len(w))
        known.make_automaton()
        for texts in batches:
            out = []
            for text in texts:
                parts, at = [], 0
                for end, n in known.iter_long(text) if text else ():
                    parts += [{"text": text[at : end + 1 - n], "added": False}, {"text": text[end + 1 - n : end + 1], "added": True}]
                    at = end + 1
                out.append(None if text is None else [*parts, {"text": text[at:], "added": False}])
            yield pd.Series(out, dtype=object)

    return run(c)


def split_parts(c: Column, words: Sequence[str]) -> Column:
    """struct(text, added) of text and added tokens in order: leftmost, longest match; empty parts are dropped. Every character of the text is kept."""
    words = sorted({w for w in words if w})
    if not words:
        parts = F.array(F.struct(c.alias("text"), F.lit(False).alias("added")))
        return F.when(c.isNotNull(), F.filter(parts, lambda x: x["text"] != ""))
    return F.filter((_split_few if len(words) <= MANY else _split_many)(c, words), lambda x: x["text"] != "")


def split_added(c: Column, words: Sequence[str]) -> Column:
    """The texts of split_parts."""
    return F.transform(split_parts(c, words), lambda x: x["text"])


def strip_neighbours(parts: Column, rstrip: Sequence[str] = (), lstrip: Sequence[str] = ()) -> Column:
    """Next to an added token, text loses white space: on its left after an rstrip token, on its right before an lstrip token."""
    right, left = [F.lit(x) for x in rstrip], [F.lit(x) for x in lstrip]
    if right:
        parts = F.transform(parts, lambda x, i: F.when((i > 0) & F.try_element_at(parts, F.greatest(i, F.lit(1))).isin(*right), F.regexp_replace(x, r"(?U)^\s+", "")).otherwise(x))
    if left:
        whole = parts
        parts = F.transform(whole, lambda x, i: F.when(F.coalesce(F.try_element_at(whole, i + 2).isin(*left), F.lit(False)), F.regexp_replace(x, r"(?U)\s+$", "")).otherwise(x))
    return F.filter(parts, lambda x: x != "")


def rejoin_single_words(parts: Column, single: Sequence[str]) -> Column:
    """A single-word token goes back into a neighbour that touches it with a blank (kept as the inventory describes it)."""
    if not single:
        return parts
    words = [F.lit(x) for x in single]
    is_single = lambda x: F.coalesce(x.isin(*words), F.lit(False))
    blank_end = lambda x: F.coalesce(x.endswith(" "), F.lit(False))

    def joined(p: Column, x: Column, i: Column) -> Column:
        """Whether a part goes onto the one before it; that one ends as the text it stands in does, so two parts back tell."""
        before, earlier = F.get(p, i - 1), F.get(p, i - 2)
        return (is_single(x) & blank_end(before)) | (is_single(before) & ~blank_end(earlier) & x.startswith(" "))

    def rejoined(p: Column) -> Column:
        first = F.filter(F.transform(p, lambda x, i: F.when(joined(p, x, i), -1).otherwise(i)), lambda i: i >= 0)
        return _once(first, lambda at: F.transform(at, lambda i, k: F.array_join(F.slice(p, i + 1, F.coalesce(F.get(at, k + 1), F.size(p)) - i), "")))

    return _once(parts, rejoined)


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value made once for each row however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def protected_lower(c: Column, protected: Sequence[str]) -> Column:
    """Lower-case everything but the protected tokens."""
    if not protected:
        return F.lower(c)
    return F.array_join(F.transform(split_parts(c, protected), lambda x: F.when(x["added"], x["text"]).otherwise(F.lower(x["text"]))), "")


def piece_text(c: Column) -> Column:
    """Text of the piece family: every blank and lower bar is one lower bar, with one in front."""
    return F.concat(F.lit(LOWER_BAR), F.replace(F.replace(c, F.lit(LOWER_BAR), F.lit(" ")), F.lit(" "), F.lit(LOWER_BAR)))


def prefix_space(c: Column, on: bool = True) -> Column:
    return F.concat(F.lit(" "), c) if on else c
