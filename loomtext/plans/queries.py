"""The registered queries of the tokenization engine. Arrays are shown joined, so that engines compare alike."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import beams, bpe, decode, encode, generation, lookahead, offsets, vocab
from ..sources.files import input_json, parse_input_json, read_merges, read_pieces, read_table, read_vocab, write_vocab
from ..sources.shared import saved, shared_dir
from ..streaming.encode import batch_stream
from .options import EncodeOptions, Family, GenerationConfig, Padding, Side, TokenizerConfig, Truncation
from .vocabulary import BOS, EOS, PAD, UNK, public_file, public_vocabulary, small_merges, small_vocab

SEP = "\x1f"
BATCH = 32
ADDED = ("<|user|>", "<|assistant|>", "<|system|>", "<|end|>")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def shown(c: Column | str, sep: str = " ") -> Column:
    return F.array_join((F.col(c) if isinstance(c, str) else c).cast("array<string>"), sep)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


def small_ids(df: DataFrame, *key: str, words: str = "words") -> DataFrame:
    """key, tokens and ids of arrays of pre-tokens, row by row."""
    ranks = {m: r for r, m in enumerate(small_merges())}
    own = F.coalesce(words, F.array().cast("array<string>"))
    return df.select(*key, bpe.merged_words(own, ranks, raw=True).alias("tokens"), bpe.merged_words(own, ranks, vocab=small_vocab(), unk_id=small_vocab()[UNK], raw=True).alias("ids"))


def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_ids(documents(spark, sf_dir).select("doc_id", T.byte_level_pretokens(F.col("text")).alias("words")), "doc_id")


def item_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read_table(spark, sf_dir, "benchmark").select("item_id", T.byte_level_pretokens(F.col("text")).alias("words"))
    return small_ids(items, "item_id").select("item_id", F.col("ids").alias("pair_ids"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the benchmark item of its id modulo 40."""
    return document_ids(spark, sf_dir).select("doc_id", "ids").join(item_ids(spark, sf_dir), F.col("doc_id") % 40 == F.col("item_id")).drop("item_id")


SPECIAL = {"bos_id": small_vocab()[BOS], "eos_id": small_vocab()[EOS]}
PAD_ID = small_vocab()[PAD]


# --- text ------------------------------------------------------------------------------------------------------

@query
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", T.clean_text(F.col("html")).alias("text"))


@query
def whitespace_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.whitespace_tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), shown("t", SEP).alias("tokens"))


@query
def lower_strip_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.strip_accents(F.lower("text")).alias("text"))


@query
def nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.normalize(F.col("text")).alias("text"))


@query
def split_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", shown(T.split_punctuation(F.col("text")), SEP).alias("parts"))


@query
def basic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", shown(T.basic_tokens(F.col("text"))).alias("tokens"))


@query
def word_end_pretokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", shown(T.word_end_pretokens(F.col("text")), SEP).alias("pretokens"))


@query
def byte_level_pretokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", shown(T.byte_level_pretokens(F.col("text")), SEP).alias("pretokens"))


@query
def byte_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.byte_encode(F.col("text")).alias("encoded"))


@query
def byte_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.byte_decode(T.byte_encode(F.col("text"))).alias("text"))


@query
def cleanup_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.cleanup_spaces(F.col("text")).alias("text"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("<|"), F.col("role"), F.lit("|> "), F.col("text"), F.lit(" <|end|>\n"))
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", marked.alias("text"))


@query
def added_token_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", shown(T.split_added(F.col("text"), ADDED), SEP).alias("parts"))


@query
def added_token_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _turns(spark, sf_dir).select("conv_id", "turn", T.split_added(F.col("text"), ADDED).alias("p"))
    return parts.select("conv_id", "turn", shown(T.strip_neighbours(F.col("p"), rstrip=ADDED, lstrip=("<|end|>",)), SEP).alias("parts"))


@query
def single_word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = documents(spark, sf_dir).select("doc_id", T.split_added(F.col("text"), ("the",)).alias("p"))
    return parts.select("doc_id", shown(T.rejoin_single_words(F.col("p"), ("the",)), SEP).alias("parts"))


@query
def protected_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    upper = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("<|END|> "), F.col("text"), F.lit(" <|END|>")).alias("text"))
    return upper.select("conv_id", "turn", T.protected_lower(F.col("text"), ("<|END|>",)).alias("text"))


@query
def piece_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.piece_text(F.col("text")).alias("text"))


@query
def symbol_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = documents(spark, sf_dir).select(F.explode(T.byte_level_pretokens(F.col("text"))).alias("word")).distinct()
    p = bpe.pairs(F.split("word", "(?!^)(?s)(?=.)"))
    return words.select("word", F.size(p).cast("long").alias("n_pairs"))


# --- sub-words and ids -----------------------------------------------------------------------------------------

@query
def bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_ids(spark, sf_dir).select("doc_id", shown("tokens").alias("tokens"))


@query
def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_ids(spark, sf_dir).select("doc_id", F.size("ids").cast("long").alias("n"), shown("ids").alias("ids"))


@query
def unknown_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words looked up whole in the small vocabulary: most are unknown."""
    words = documents(spark, sf_dir).select("doc_id", T.whitespace_tokens(F.lower("text")).alias("words"))
    ids = vocab.token_ids(words, ["doc_id"], "words", small_vocab(), small_vocab()[UNK])
    return ids.select("doc_id", F.size("ids").cast("long").alias("n"), F.size(F.filter("ids", lambda x: x == small_vocab()[UNK])).cast("long").alias("n_unknown"))


@query
def public_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole public vocabulary of 50,257 tokens."""
    v, ranks = public_vocabulary()
    ids = documents(spark, sf_dir).select("doc_id", bpe.merged_words(T.byte_level_pretokens(F.col("text")), ranks, vocab=v, raw=True).alias("ids"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n"), shown("ids").alias("ids"))


@query
def word_end_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word-end family over the public vocabulary of 49,408 tokens."""
    v, ranks = public_vocabulary(public_file("word_bpe_49k.json"))
    pre = T.word_end_pretokens(F.array_join(T.basic_tokens(F.col("text"), strip=False), " "))
    ids = documents(spark, sf_dir).select("doc_id", bpe.merged_words(pre, ranks, bpe.WORD_END, v, v.get("<|endoftext|>", len(v) + 1), True).alias("ids"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n"), shown("ids").alias("ids"))


@query
def piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The piece family over the public model of 32,000 pieces."""
    scores = read_pieces(public_file("piece_bpe_32k.model"))
    return documents(spark, sf_dir).select("doc_id", shown(bpe.piece_column(T.piece_text(F.col("text")), scores)).alias("pieces"))


@query
def piece_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to ids of the public piece model and back; characters that no piece has go through bytes."""
    scores = read_pieces(public_file("piece_bpe_32k.model"))
    v = {p: i for i, p in enumerate(scores)}
    ids = documents(spark, sf_dir).select("doc_id", bpe.piece_column(T.piece_text(F.coalesce("text", F.lit(""))), scores, v, v["<unk>"]).alias("ids"))
    return decode.decode(ids, ["doc_id"], "ids", v, Family.PIECES)


@query
def many_added_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents split at the 5,000 most frequent words of six letters and more as added tokens, found by one automaton."""
    words = documents(spark, sf_dir).select(F.explode(T.whitespace_tokens(F.lower("text"))).alias("w")).where(F.col("w").rlike("^[a-z]{6,}$"))
    known = [r.w for r in words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(5000).collect()]
    parts = saved(documents(spark, sf_dir).select("doc_id", T.split_parts(F.coalesce(F.lower("text"), F.lit("")), known).alias("p")))
    found = F.filter("p", lambda x: x.added)
    return parts.select("doc_id", F.size(found).cast("long").alias("n_added"), F.get(found, F.lit(0)).text.alias("first"), F.array_join(F.transform("p", lambda x: x.text), "").alias("text"))


@query
def vocabulary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 most frequent words of all documents as a vocabulary, written as a file of the published format, read back, and used for ids."""
    words = documents(spark, sf_dir).select("doc_id", T.whitespace_tokens(F.lower("text")).alias("words"))
    counts = words.select(F.explode("words").alias("token")).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(2000)
    path = f"{shared_dir(spark)}/vocabulary-{uuid.uuid4().hex}"
    write_vocab(counts.select("token", (F.row_number().over(Window.orderBy(F.desc("n"), "token")) - 1).alias("id")), path)
    known = read_vocab(spark, path)
    found = words.select("doc_id", F.explode("words").alias("token")).join(F.broadcast(known), "token").groupBy("doc_id").agg(F.count("*").alias("n_known"), F.sum("id").alias("id_sum"))
    return words.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("n_known", F.lit(0)).alias("n_known"), F.coalesce("id_sum", F.lit(0)).alias("id_sum"))


@query
def merges_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge table written as a file of the published format and read back, with how many of the documents' tokens each merge has made."""
    path = f"{shared_dir(spark)}/merges-{uuid.uuid4().hex}"
    lines = "\n".join(["#version: 0.2", *(f"{a} {b}" for a, b in small_merges()), ""])
    spark.createDataFrame([(lines,)], "value string").coalesce(1).write.text(path)
    made = document_ids(spark, sf_dir).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    merges = F.broadcast(read_merges(spark, path)).withColumn("token", F.concat("left", "right"))
    return merges.join(made, "token", "left").select(F.col("rank").cast("long").alias("rank"), "left", "right", F.coalesce("n", F.lit(0)).alias("n"))


@query
def tokenizer_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration files of three tokenizer classes, and what each does with the documents dealt to it: case, side and length."""
    rows = []
    for k, given in enumerate(CONFIGS.values()):
        c = TokenizerConfig.from_json(json.dumps(given))
        rows.append((k, c.tokenizer_class, c.do_lower_case, c.model_max_length, c.truncation_side.value, " ".join(c.special_tokens())))
    known = spark.createDataFrame(rows, "k int, tokenizer_class string, lower boolean, most int, side string, special string")
    own = documents(spark, sf_dir).withColumn("k", (F.col("doc_id") % 3).cast("int")).join(F.broadcast(known), "k")
    words = T.whitespace_tokens(F.when(F.col("lower"), F.lower("text")).otherwise(F.col("text")))
    own = own.select("doc_id", "tokenizer_class", "special", "most", "side", words.alias("w"))
    cut = F.when(F.col("side") == "left", F.slice("w", F.greatest(F.size("w") - F.col("most") + 1, F.lit(1)), F.greatest(F.size("w"), F.lit(0)))).otherwise(F.slice("w", F.lit(1), F.col("most")))
    return own.select("doc_id", "tokenizer_class", "special", F.size(cut).cast("long").alias("n"), F.try_element_at(cut, F.lit(1)).alias("first"), F.try_element_at(cut, F.lit(-1)).alias("last"))


CONFIGS = {
    "word_end": {"tokenizer_class": "CLIPTokenizer", "do_lower_case": True, "model_max_length": 77, "bos_token": {"content": BOS, "lstrip": False, "rstrip": False, "normalized": True, "single_word": False}, "eos_token": EOS, "unk_token": EOS, "pad_token": PAD},
    "byte_level": {"tokenizer_class": "GPT2Tokenizer", "add_prefix_space": True, "model_max_length": 1024, "bos_token": EOS, "eos_token": EOS, "unk_token": UNK, "truncation_side": "left"},
    "pieces": {"tokenizer_class": "LlamaTokenizer", "model_max_length": 4096, "padding_side": "left", "bos_token": "<s>", "eos_token": "</s>", "unk_token": UNK},
}


# --- sequence preparation --------------------------------------------------------------------------------------

def _special(family: Family, spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    a, b = F.col("ids"), F.col("pair_ids")
    return p.select("doc_id", shown(encode.with_special(family, a, b, **SPECIAL)).alias("input_ids"), shown(encode.special_mask(family, a, b)).alias("special_mask"), shown(encode.type_ids(family, a, b)).alias("type_ids"))


@query
def special_word_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _special(Family.WORD_END, spark, sf_dir)


@query
def special_byte_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _special(Family.BYTE_LEVEL, spark, sf_dir)


@query
def special_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _special(Family.PIECES, spark, sf_dir)


def _truncated(how: Truncation, side: Side, spark: SparkSession, sf_dir: str) -> DataFrame:
    options = EncodeOptions(truncation=how, max_length=96, stride=8, truncation_side=side, return_overflowing_tokens=how != Truncation.LONGEST_FIRST)
    out = encode.prepare(pairs(spark, sf_dir), "ids", options, Family.WORD_END, "pair_ids", **SPECIAL)
    more = [shown("overflowing_tokens").alias("overflow"), F.col("num_truncated_tokens").cast("long").alias("num_truncated_tokens")] if options.return_overflowing_tokens else []
    return out.select("doc_id", shown("input_ids").alias("input_ids"), *more)


@query
def truncate_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truncated(Truncation.ONLY_FIRST, Side.RIGHT, spark, sf_dir)


@query
def truncate_first_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truncated(Truncation.ONLY_FIRST, Side.LEFT, spark, sf_dir)


@query
def truncate_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truncated(Truncation.ONLY_SECOND, Side.RIGHT, spark, sf_dir)


@query
def truncate_longest_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truncated(Truncation.LONGEST_FIRST, Side.RIGHT, spark, sf_dir)


def _padded(options: EncodeOptions, spark: SparkSession, sf_dir: str, batch: bool = False) -> DataFrame:
    rows = document_ids(spark, sf_dir).select("doc_id", "ids", F.floor(F.col("doc_id") / BATCH).alias("batch_id"))
    out = encode.prepare(rows, "ids", options, Family.WORD_END, pad_id=PAD_ID, batch="batch_id" if batch else None, **SPECIAL)
    return out.select("doc_id", shown("input_ids").alias("input_ids"), shown("attention_mask").alias("attention_mask"), F.size("input_ids").cast("long").alias("length"))


@query
def pad_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _padded(EncodeOptions(padding=Padding.LONGEST, truncation=Truncation.LONGEST_FIRST, max_length=256), spark, sf_dir, True)


@query
def pad_max_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _padded(EncodeOptions(padding=Padding.MAX_LENGTH, truncation=Truncation.ONLY_FIRST, max_length=128, padding_side=Side.LEFT), spark, sf_dir)


@query
def pad_multiple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _padded(EncodeOptions(padding=Padding.LONGEST, pad_to_multiple_of=64), spark, sf_dir)


@query
def encode_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _padded(EncodeOptions(), spark, sf_dir)


@query
def encode_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text to model-ready rows: pre-tokens, bytes, merges, ids, special tokens, truncation, padding to 128, masks."""
    return _padded(EncodeOptions(padding=Padding.MAX_LENGTH, truncation=Truncation.LONGEST_FIRST, max_length=128), spark, sf_dir)


@query
def encode_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = EncodeOptions(padding=Padding.MAX_LENGTH, truncation=Truncation.LONGEST_FIRST, max_length=128, return_special_tokens_mask=True)
    out = encode.prepare(pairs(spark, sf_dir), "ids", options, Family.WORD_END, "pair_ids", pad_id=PAD_ID, **SPECIAL)
    return out.select("doc_id", *[shown(c).alias(c) for c in ("input_ids", "token_type_ids", "attention_mask", "special_tokens_mask")])


@query
def public_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole path with the public vocabulary of 50,257 tokens and an end token that doubles as padding."""
    from ..operators.tokenizer import Tokenizer
    from .options import AddedToken

    end = AddedToken(EOS, special=True)
    t = Tokenizer.from_json(public_file(), Family.BYTE_LEVEL, TokenizerConfig(eos_token=end, pad_token=end))
    options = EncodeOptions(padding=Padding.MAX_LENGTH, truncation=Truncation.LONGEST_FIRST, max_length=256)
    out = t.encode(documents(spark, sf_dir), ["doc_id"], options=options)
    return out.select("doc_id", shown("input_ids").alias("input_ids"), shown("attention_mask").alias("attention_mask"))


@query
def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows of 128 ids of every document, special tokens included, that share 32 ids with the one before."""
    out = encode.windows(document_ids(spark, sf_dir), ["doc_id"], "ids", 128, 32, [SPECIAL["bos_id"]], [SPECIAL["eos_id"]])
    return out.select("doc_id", F.col("window").cast("long").alias("window"), F.col("start").cast("long").alias("start"), shown("ids").alias("ids"))


@query
def mask_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Special-token mask of sequences that have their special tokens already."""
    ids = encode.with_special(Family.WORD_END, F.col("ids"), None, **SPECIAL)
    return document_ids(spark, sf_dir).select("doc_id", shown(encode.mask_of_ids(ids, [SPECIAL["bos_id"], SPECIAL["eos_id"]])).alias("mask"))


# --- decoding --------------------------------------------------------------------------------------------------

@query
def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.decode(document_ids(spark, sf_dir), ["doc_id"], "ids", small_vocab())


@query
def decoded_skip_special(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_ids(spark, sf_dir).select("doc_id", encode.with_special(Family.WORD_END, F.col("ids"), None, **SPECIAL).alias("ids"))
    return decode.decode(rows, ["doc_id"], "ids", small_vocab(), skip_ids=list(SPECIAL.values()), clean_up=True)


@query
def decoded_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added tokens stand alone between runs of model tokens."""
    rows = document_ids(spark, sf_dir).select("doc_id", F.concat(F.array(F.lit(SPECIAL["bos_id"])), "ids", F.array(F.lit(SPECIAL["eos_id"])), "ids").alias("ids"))
    return decode.decode(rows, ["doc_id"], "ids", small_vocab(), family=Family.PLAIN, added=(BOS, EOS))


@query
def input_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    j = turns.select("conv_id", input_json(F.col("t.text"), "BatchInput").alias("json"))
    p = j.select("conv_id", parse_input_json(F.col("json")).alias("p"))
    return p.select("conv_id", F.col("p.type").alias("type"), F.size("p.BatchInput").cast("long").alias("n"), shown("p.BatchInput", SEP).alias("texts"))


# --- generation ------------------------------------------------------------------------------------------------

@query
def generation_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mode of the options that each document's id spells: all combinations of a grid."""
    grid = read_table(spark, sf_dir, "documents").select("doc_id", F.pmod("doc_id", F.lit(192)).alias("id")).select(
        "doc_id", (F.col("id") % 2 == 1).alias("constrained"), (F.floor(F.col("id") / 2) % 3 + 1).alias("beams"), (F.floor(F.col("id") / 6) % 2 + 1).alias("groups"), (F.floor(F.col("id") / 12) % 2 == 1).alias("sample"),
        (F.floor(F.col("id") / 24) % 2 * 49 + 1).alias("top_k"), (F.floor(F.col("id") / 48) % 2 * 0.5).alias("alpha"), (F.floor(F.col("id") / 96) % 2 == 1).alias("assisted"),
    )
    cols = [F.col(c) for c in ("constrained", "beams", "groups", "sample", "top_k", "alpha", "assisted")]
    return grid.select("doc_id", generation.generation_mode_column(*cols, F.lit(False)).alias("mode"))


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a prompt of its own, named conv_id:turn, with all its ids."""
    turns = read_table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("prompt"), T.byte_level_pretokens(F.col("text")).alias("words"))
    return small_ids(turns, "prompt").select("prompt", "ids")


@query
def stop_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.col("ids")
    return document_ids(spark, sf_dir).select(
        "doc_id", generation.eos_stop(ids, [13, 14]).alias("eos"), generation.max_length_stop(ids, 200).alias("max_length"), generation.max_new_tokens_stop(ids, 100, 300).alias("max_new_tokens"),
        generation.any_of([generation.eos_stop(ids, [13, 14]), generation.max_length_stop(ids, 200)]).alias("stopped"),
    )


@query
def stop_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops at a string of the decoded text, whichever tokens it is made of."""
    text = decode.decode(document_ids(spark, sf_dir), ["doc_id"], "ids", small_vocab())
    return text.select("doc_id", generation.stop_string(F.col("text"), ["the end", "erly."]).alias("stopped"))


def _left_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, padded on the left to a multiple of 64 ids."""
    return document_ids(spark, sf_dir).select("doc_id", encode.padded(F.col("ids"), encode.round_up(F.size("ids"), 64), PAD_ID, Side.LEFT).alias("ids"))


@query
def generation_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _left_padded(spark, sf_dir).select("doc_id", shown(generation.attention_mask(F.col("ids"), PAD_ID, [SPECIAL["eos_id"]])).alias("mask"))


@query
def position_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = _left_padded(spark, sf_dir).select("doc_id", generation.attention_mask(F.col("ids"), PAD_ID).alias("mask"))
    return masks.select("doc_id", shown(generation.position_ids(F.col("mask"))).alias("position_ids"), shown(generation.cache_position(F.col("mask"), 40)).alias("cache_position"))


@query
def repeat_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generation.expand(read_table(spark, sf_dir, "benchmark").select("item_id"), 3).select("item_id", F.col("copy").cast("long").alias("copy"))


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns cut to their first 1, 8, 16 .. 56 ids, of which the last two count as generated, and the scores of what may follow."""
    state = generation.initial_state(_prompts(spark, sf_dir), "ids", "prompt", SPECIAL["bos_id"])
    conv, turn = (F.split("seq_id", ":")[i].cast("long") for i in (0, 1))
    m = ((conv * 3 + turn) % 8).cast("int")
    state = state.withColumn("ids", F.slice("ids", F.lit(1), F.when(m == 0, 1).otherwise(8 * m))).withColumn("prompt_len", F.greatest(F.size("ids") - 2, F.lit(1)))
    state = saved(state)
    return generation.bigram_scorer(_log_bigrams(spark, sf_dir))(state), state


def _processed(rule: generation.Processor) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        scores, state = _scored(spark, sf_dir)
        return rule(scores, state).where(F.col("score") > generation.NEVER).select("seq_id", F.col("token_id").cast("long").alias("token_id"), F.round("score", 6).alias("score"))

    return run


def _odd_scores(s: DataFrame) -> DataFrame:
    """Some scores that are no finite numbers, for the rule that mends them."""
    return s.withColumn("score", F.when(F.col("token_id") % 7 == 0, float("nan")).when(F.col("token_id") % 7 == 1, float("inf")).otherwise(F.col("score")))


def _ids_of(st: DataFrame) -> DataFrame:
    return st.select("seq_id", F.explode("ids").alias("token_id"))


_E, _N, _S = (small_vocab()[x] for x in "ens")

for _name, _rule in {
    "logits_temperature": generation.temperature(0.7), "logits_repetition_penalty": generation.repetition_penalty(1.3), "logits_encoder_repetition_penalty": generation.encoder_repetition_penalty(1.3),
    "logits_top_k": generation.top_k(10), "logits_top_p": generation.top_p(0.8), "logits_min_p": generation.min_p(0.05), "logits_typical": generation.typical_p(0.7), "logits_epsilon": generation.epsilon_cutoff(0.01),
    "logits_eta": generation.eta_cutoff(0.05), "logits_normalize": generation.log_normalize(), "logits_suppress": generation.suppress(range(256)), "logits_no_repeat": generation.no_repeat_ngram(2),
    "logits_min_length": generation.min_length(40, (_E, _N)), "logits_bias": generation.sequence_bias({(_E,): 2.0, (_E, _S): -1.0, (_N, _E): 3.0}),
    "logits_min_new_tokens": generation.min_new_tokens(2, (_E, _N)), "logits_encoder_no_repeat": generation.encoder_no_repeat_ngram(2), "logits_no_bad_words": generation.no_bad_words([[_S], [_E, _N], [_N, _E], [11]], (11,)),
    "logits_prefix_constrained": lambda s, st: generation.prefix_constrained(s.where("token_id % 3 = 0"))(s, st), "logits_hamming_diversity": lambda s, st: generation.hamming_diversity(_ids_of(st), 0.5)(s, st),
    "logits_forced_bos": generation.forced_bos(_E), "logits_forced_eos": generation.forced_eos(_E, 25), "logits_force_tokens": generation.force_tokens({8: _E, 16: _N, 40: _S}), "logits_remove_invalid": lambda s, st: generation.remove_invalid()(_odd_scores(s), st),
    "logits_exponential_decay": generation.exponential_decay(-1, 1.2, (_E, _N)), "logits_suppress_at_begin": generation.suppress_at_begin(range(100), 32),
    "logits_guidance": lambda s, st: generation.guidance(generation.temperature(2.0)(s, st), 1.5)(s, st), "logits_watermark": generation.watermark(2.0),
}.items():
    QUERIES[_name] = _processed(_rule)


@query
def greedy_bigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy decoding of 12 new ids after each turn, scored by id bigrams of all documents."""
    state = generation.initial_state(_prompts(spark, sf_dir), "ids", "prompt", SPECIAL["bos_id"])
    table = saved(generation.bigram_table(document_ids(spark, sf_dir), "ids"))
    out = generation.generate(state, generation.bigram_scorer(table), GenerationConfig(max_new_tokens=12), save=saved, every=1)
    return out.select(F.col("seq_id").alias("prompt"), shown("ids").alias("ids"))


@query
def greedy_until_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy decoding with end ids: rows that have ended take the pad id while others go on."""
    state = generation.initial_state(_prompts(spark, sf_dir), "ids", "prompt", SPECIAL["bos_id"])
    table = saved(generation.bigram_table(document_ids(spark, sf_dir), "ids"))
    config = GenerationConfig(max_new_tokens=6, eos_token_id=[small_vocab()["e"], small_vocab()["n"]], pad_token_id=PAD_ID)
    out = generation.generate(state, generation.bigram_scorer(table), config, save=saved, every=1)
    return out.select(F.col("seq_id").alias("prompt"), shown("ids").alias("ids"))


@query
def sampled_bigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = generation.initial_state(_prompts(spark, sf_dir), "ids", "prompt", SPECIAL["bos_id"])
    table = saved(generation.bigram_table(document_ids(spark, sf_dir), "ids").withColumn("score", F.log("score")))
    out = generation.generate(state, generation.bigram_scorer(table), GenerationConfig(max_new_tokens=4, do_sample=True, top_k=20, top_p=0.9), seed=7, save=saved)
    return out.select(F.col("seq_id").alias("prompt"), shown("ids").alias("ids"))


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's first half as a prompt: these end in many different ids."""
    state = generation.initial_state(_prompts(spark, sf_dir), "ids", "prompt", SPECIAL["bos_id"])
    return state.withColumn("ids", F.slice("ids", F.lit(1), F.greatest(F.floor(F.size("ids") / 2).cast("int"), F.lit(1)))).withColumn("prompt_len", F.size("ids"))


def _log_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saved(generation.bigram_table(document_ids(spark, sf_dir), "ids").withColumn("score", F.log("score")))


@query
def beam_bigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three beams with a penalty for repeated ids."""
    config = GenerationConfig(max_new_tokens=4, num_beams=3, repetition_penalty=1.3)
    out = beams.beam_search(_halves(spark, sf_dir), generation.bigram_scorer(_log_bigrams(spark, sf_dir), small=True), config, save=saved)
    return out.select(F.col("seq_id").alias("prompt"), shown("ids").alias("ids"), F.round("score", 6).alias("score"))


@query
def group_beams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six beams in three groups; what earlier groups choose costs later ones."""
    config = GenerationConfig(max_new_tokens=3, num_beams=6, num_beam_groups=3, diversity_penalty=0.5)
    out = beams.beam_search(_halves(spark, sf_dir), generation.bigram_scorer(_log_bigrams(spark, sf_dir), small=True), config, save=saved)
    return out.select(F.col("seq_id").alias("prompt"), shown("ids").alias("ids"), F.round("score", 6).alias("score"))


@query
def constrained_beams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuations that hold the first word of a benchmark item, and its second or third one (words of two to four ids)."""
    items = read_table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.byte_level_pretokens(F.col("text"))).alias("pos", "word"))
    words = small_ids(items.withColumn("words", F.array("word")), "item_id", "pos").where(F.size("ids").between(2, 4))
    first = words.groupBy("item_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ids"))), lambda x: x.ids), 1, 3).alias("w")).where(F.size("w") == 3)
    wanted = first.select("item_id", F.array(F.slice("w", 1, 1), F.slice("w", 2, 2)).alias("wanted"))
    own = _halves(spark, sf_dir).withColumn("item_id", F.split("seq_id", ":")[0].cast("long") % 40).join(F.broadcast(wanted), "item_id", "left").drop("item_id")
    out = beams.beam_search(own, generation.bigram_scorer(_log_bigrams(spark, sf_dir), small=True), GenerationConfig(max_new_tokens=9, num_beams=3), save=saved, constraints="wanted")
    return out.select(F.col("seq_id").alias("prompt"), shown("ids").alias("ids"), F.round("score", 6).alias("score"), "met")


@query
def contrastive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probable ids that are unlike what stands there already, by the vectors of the table of embeddings."""
    vectors = read_table(spark, sf_dir, "embeddings").where(F.col("vec_id") < len(small_vocab())).select(F.col("vec_id").cast("int").alias("token_id"), F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double")).alias("vector"))
    config = GenerationConfig(max_new_tokens=5, top_k=4, penalty_alpha=0.6)
    out = lookahead.contrastive_search(_halves(spark, sf_dir), generation.bigram_scorer(_log_bigrams(spark, sf_dir)), vectors, config, save=saved)
    return out.select(F.col("seq_id").alias("prompt"), shown("ids").alias("ids"))


@query
def prompt_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As greedy_bigram, with up to six ids at a time proposed from the sequence itself."""
    state = generation.initial_state(_prompts(spark, sf_dir), "ids", "prompt", SPECIAL["bos_id"])
    table = saved(generation.bigram_table(document_ids(spark, sf_dir), "ids"))
    out = lookahead.prompt_lookup(state, generation.bigram_scorer(table, small=True), GenerationConfig(max_new_tokens=12, prompt_lookup_num_tokens=6), save=saved)
    return out.select(F.col("seq_id").alias("prompt"), shown("ids").alias("ids"))


@query
def greedy_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As greedy_bigram, as one recursive plan."""
    state = generation.initial_state(_prompts(spark, sf_dir), "ids", "prompt", SPECIAL["bos_id"])
    table = saved(generation.bigram_table(document_ids(spark, sf_dir), "ids"))
    out = lookahead.greedy_plan(saved(state), table, GenerationConfig(max_new_tokens=12))
    return out.select(F.col("seq_id").alias("prompt"), shown("ids").alias("ids"))


@query
def token_healing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last id of every half turn chosen anew among those that begin as it does."""
    table = _log_bigrams(spark, sf_dir)
    normal = generation.log_normalize()(table.withColumnRenamed("prev", "seq_id"), None).withColumnRenamed("seq_id", "prev")
    out = lookahead.heal(_halves(spark, sf_dir), generation.bigram_scorer(saved(normal)), lookahead.prefix_index(spark, small_vocab()), SPECIAL["bos_id"])
    return out.select(F.col("seq_id").alias("prompt"), shown("ids").alias("ids"))


@query
def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's tokens of the whole public vocabulary begin and end in its text: how many, the sum of both, and the text put together from them."""
    v, ranks = public_vocabulary()
    rows = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = saved(rows.select("doc_id", "text", bpe.merged_words(T.byte_level_pretokens(F.col("text")), ranks, raw=True).alias("tokens")))
    at = rows.select("doc_id", "text", offsets.byte_level_offsets(F.col("text"), F.col("tokens")).alias("at"))
    pieces = offsets.added_text(F.col("text"), F.col("at"))
    return at.select("doc_id", F.array_join(pieces, "").alias("text"), F.coalesce(F.get("at", F.size("at") - 1)["end"], F.lit(0)).cast("long").alias("last_end"))


STOPS = ("er", " th", "est")


@query
def stop_in_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy decoding that ends where a string ends in the text, cut across ids or not."""
    config = GenerationConfig(max_new_tokens=10, stop_strings=STOPS, pad_token_id=PAD_ID)
    texts = spark.createDataFrame([(i, t) for t, i in small_vocab().items()], "token_id int, text string")
    stopping = generation.stops(config, texts, T.byte_encoded)
    table = saved(generation.bigram_table(document_ids(spark, sf_dir), "ids"))
    out = generation.generate(_halves(spark, sf_dir), generation.bigram_scorer(table), config, save=saved, stopping=stopping, every=1)
    return out.select(F.col("seq_id").alias("prompt"), shown("ids").alias("ids"))


@query
def stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns as a stream: eight lanes fill batches of sixteen rows in the state store; what is left goes out by the watermark."""
    source = f"{sf_dir}/conversations.parquet"
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source[:-1] + "[t]")  # a pattern, so that the table may be one file or a folder
    rows = stream.select("conv_id", F.concat_ws(":", F.lpad(F.col("conv_id").cast("string"), 12, "0"), F.lpad(F.col("turn").cast("string"), 6, "0")).alias("row"), F.timestamp_seconds(F.col("conv_id") * 1000 + F.col("turn") + 1).alias("time"), T.byte_level_pretokens(F.col("text")).alias("words"))
    ready = small_ids(rows, "conv_id", "row", "time")
    out, name = shared_dir(spark), uuid.uuid4().hex
    filled = batch_stream(ready, F.col("conv_id") % 8, "row", "ids", "time", 16, pad_id=PAD_ID)
    filled.writeStream.format("parquet").option("path", f"{out}/batches-{name}").option("checkpointLocation", f"{out}/batches-state-{name}").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(filled.schema).parquet(f"{out}/batches-{name}").select("lane", "batch", "row", shown("input_ids").alias("input_ids"), shown("attention_mask").alias("attention_mask"))


@query
def batch_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and longest row of each batch, as padding sees them."""
    rows = document_ids(spark, sf_dir).select(F.floor(F.col("doc_id") / BATCH).alias("batch_id"), F.size("ids").alias("n"))
    return rows.groupBy("batch_id").agg(F.count("*").alias("rows"), F.max("n").cast("long").alias("longest"))


__all__ = ["QUERIES", "Window"]
