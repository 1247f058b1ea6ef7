"""The same queries as SQL. Arrays, folds and windows are written independently of the Spark expressions."""

from __future__ import annotations

from ..functions.text import CLEANUP, LOWER_BAR, byte_alphabet, byte_encoded
from .vocabulary import BOS, EOS, PAD, UNK, small_merges, small_vocab


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


US, S = "chr(31)", "chr(57344)"
_UNICODE_PUNCT = r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E\p{P}]"
_NOT_PUNCT = r"[^\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E\p{P}]+"


def _char_table() -> tuple[str, str]:
    """Characters of up to two bytes, and their symbols wrapped."""
    alpha = byte_alphabet()
    chars = range(1, 256)
    return ", ".join(f"chr({c})" for c in chars), ", ".join(q("".join(f"⟨{alpha[b]}⟩" for b in chr(c).encode())) for c in chars)


def _ids(name: str, table: str, key: str, where: str = "") -> str:
    """CTEs that end in {name}(key, tokens, ids)."""
    keys, values = _char_table()
    merges = ", ".join(q(f"⟨{a}⟩⟨{b}⟩{chr(1)}⟨{a}{b}⟩") for a, b in small_merges())
    vocab = ", ".join(f"({q(t)}, {i})" for t, i in small_vocab().items())
    pattern = q(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}" + chr(57344) + r"]+|\s+")
    return f"""
{name}_p AS (SELECT {key}, regexp_extract_all(regexp_replace(text, '(\\s)(\\S)', {S} || '\\1\\2', 'g'), {pattern}) AS p FROM {table} {where}),
{name}_pre AS (SELECT {key}, unnest(range(len(p))) AS pos, unnest(p) AS word FROM {name}_p),
{name}_w AS (SELECT word, array_to_string(list_transform(string_split(word, ''), lambda c: map([{keys}], [{values}])[c]), '') AS wrapped FROM (SELECT DISTINCT word FROM {name}_pre)),
{name}_f AS (SELECT word, list_filter(string_split(regexp_replace(list_reduce(list_prepend(wrapped, [{merges}]), lambda a, m: replace(a, split_part(m, chr(1), 1), split_part(m, chr(1), 2))), '^⟨|⟩$', '', 'g'), '⟩⟨'), lambda x: x <> '') AS toks FROM {name}_w),
{name}_v(token, id) AS (VALUES {vocab}),
{name}_t AS (SELECT {key}, pos, k, token, id FROM (SELECT {key}, pos, unnest(range(len(toks))) AS k, unnest(toks) AS token FROM {name}_pre JOIN {name}_f USING (word)) LEFT JOIN {name}_v USING (token)),
{name}_g AS (SELECT {key}, list(token ORDER BY pos, k) AS tokens, list(coalesce(id, {small_vocab()[UNK]}) ORDER BY pos, k) AS ids FROM {name}_t GROUP BY {key}),
{name} AS (SELECT {key}, coalesce(tokens, []) AS tokens, coalesce(ids, []) AS ids FROM {name}_p LEFT JOIN {name}_g USING ({key}))"""


def _join(c: str, sep: str = "' '") -> str:
    return f"coalesce(array_to_string({c}, {sep}), '')"


def _rep(value: int, n: str) -> str:
    return f"list_transform(range(CAST(greatest({n}, 0) AS BIGINT)), lambda x: {value})"


def oracle_sql() -> dict[str, str]:
    v = small_vocab()
    bos, eos, pad = v[BOS], v[EOS], v[PAD]
    D, B = _ids("d", "documents", "doc_id"), _ids("b", "benchmark", "item_id")
    P = f"{D},{B}, p AS (SELECT doc_id, d.ids AS a, b.ids AS b FROM d JOIN b ON doc_id % 40 = item_id)"
    out: dict[str, str] = {}
    out["clean_text"] = r"SELECT page_id, regexp_replace(regexp_replace(html, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\p{Cf}\p{Co}\x{FFFD}]', '', 'g'), '[\t\n\r\p{Zs}]', ' ', 'g') AS text FROM pages"
    trimmed = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
    ws = rf"CASE WHEN {trimmed} = '' THEN [] ELSE string_split_regex({trimmed}, '\s') END"
    out["whitespace_tokens"] = f"SELECT doc_id, CAST(len({ws}) AS BIGINT) AS n, {_join(ws, US)} AS tokens FROM documents"
    out["lower_strip_accents"] = "SELECT doc_id, strip_accents(lower(text)) AS text FROM documents"
    out["nfc"] = "SELECT doc_id, nfc_normalize(text) AS text FROM documents"
    punct = lambda c: f"regexp_extract_all({c}, '{_UNICODE_PUNCT}|{_NOT_PUNCT}')"
    out["split_punctuation"] = f"SELECT doc_id, {_join(punct('text'), US)} AS parts FROM documents"
    folded = rf"strip_accents(lower(regexp_replace({trimmed}, '[\t\n\r]', ' ', 'g')))"
    words = f"flatten(list_transform(string_split({folded}, ' '), lambda w: {punct('w')}))"
    out["basic_tokens"] = f"SELECT doc_id, {_join(words)} AS tokens FROM documents"
    out["word_end_pretokens"] = r"SELECT doc_id, array_to_string(regexp_extract_all(text, '(?i)<\|startoftext\|>|<\|endoftext\|>|''s|''t|''re|''ve|''m|''ll|''d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+'), chr(31)) AS pretokens FROM documents"
    out["byte_level_pretokens"] = f"WITH {D} SELECT doc_id, {_join('p', US)} AS pretokens FROM d_p"
    keys, values = _char_table()
    out["byte_encode"] = f"SELECT doc_id, replace(replace(array_to_string(list_transform(string_split(text, ''), lambda c: map([{keys}], [{values}])[c]), ''), '⟨', ''), '⟩', '') AS encoded FROM documents"
    out["byte_roundtrip"] = "SELECT doc_id, text FROM documents"
    clean = "text"
    for a, b in CLEANUP:
        clean = f"replace({clean}, {q(a)}, {q(b)})"
    out["cleanup_spaces"] = f"SELECT doc_id, {clean} AS text FROM documents"
    turns = "SELECT conv_id, turn, '<|' || role || '|> ' || text || ' <|end|>' || chr(10) AS text FROM conversations"
    added = rf"list_filter(string_split(regexp_replace(text, '(<\|assistant\|>|<\|system\|>|<\|user\|>|<\|end\|>)', {S} || '\1' || {S}, 'g'), {S}), lambda x: x <> '')"
    out["added_token_split"] = f"SELECT conv_id, turn, {_join(added, US)} AS parts FROM ({turns})"
    out["added_token_strip"] = rf"""WITH s AS (SELECT conv_id, turn, {added} AS p FROM ({turns})), e AS (SELECT conv_id, turn, i, p[i] AS x, p[i - 1] AS before, p[i + 1] AS after FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM s)),
        r AS (SELECT conv_id, turn, i, CASE WHEN before IN ('<|assistant|>', '<|system|>', '<|user|>', '<|end|>') THEN ltrim(x, ' ' || chr(10)) ELSE x END AS x, after FROM e), t AS (SELECT conv_id, turn, i, CASE WHEN after = '<|end|>' THEN rtrim(x, ' ' || chr(10)) ELSE x END AS x FROM r)
        SELECT conv_id, turn, string_agg(x, {US} ORDER BY i) FILTER (WHERE x <> '') AS parts FROM t GROUP BY conv_id, turn"""
    # a single-word token goes back onto a left part that ends in a blank, else it takes a right part that starts with one
    out["single_word_tokens"] = f"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '(the)', {S} || '\\1' || {S}, 'g'), {S}), lambda x: x <> '') AS p FROM documents),
        e AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS x FROM s),
        a AS (SELECT *, x = 'the' AS single, lag(x) OVER w AS before, lag(x, 2) OVER w AS before2 FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        b AS (SELECT *, single AND coalesce(ends_with(before, ' '), false) AS onto_left FROM a),
        g AS (SELECT *, lag(single AND NOT onto_left, 1, false) OVER (PARTITION BY doc_id ORDER BY i) AND starts_with(x, ' ') AS onto_right FROM b),
        n AS (SELECT *, sum(CASE WHEN onto_left OR onto_right THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM g),
        t AS (SELECT doc_id, part, string_agg(x, '' ORDER BY i) AS x FROM n GROUP BY doc_id, part) SELECT doc_id, string_agg(x, {US} ORDER BY part) AS parts FROM t GROUP BY doc_id"""
    out["protected_lower"] = "SELECT conv_id, turn, '<|END|> ' || lower(text) || ' <|END|>' AS text FROM conversations"
    out["piece_text"] = f"SELECT doc_id, '{LOWER_BAR}' || replace(text, ' ', '{LOWER_BAR}') AS text FROM documents"
    out["symbol_pairs"] = f"WITH {D} SELECT word, CAST(len(list_distinct(list_transform(range(1, length(word)), lambda i: substr(word, i, 2)))) AS BIGINT) AS n_pairs FROM (SELECT DISTINCT word FROM d_pre)"
    out["bpe_tokens"] = f"WITH {D} SELECT doc_id, {_join('tokens')} AS tokens FROM d"
    out["token_ids"] = f"WITH {D} SELECT doc_id, CAST(len(ids) AS BIGINT) AS n, {_join('ids')} AS ids FROM d"
    out["unknown_rate"] = f"WITH {D}, u AS (SELECT doc_id, unnest({ws.replace('text', 'lower(text)')}) AS token FROM documents) SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE id IS NULL OR id = {v[UNK]}) AS n_unknown FROM u LEFT JOIN d_v USING (token) GROUP BY doc_id"
    shapes = {
        "special_word_end": (f"[{bos}] || a || [{eos}, {eos}] || b || [{eos}]", f"[1] || {_rep(0, 'len(a)')} || [1, 1] || {_rep(0, 'len(b)')} || [1]", _rep(0, "len(a) + len(b) + 4")),
        "special_byte_level": (f"[{bos}] || a || [{bos}] || b", f"[1] || {_rep(0, 'len(a)')} || [1] || {_rep(0, 'len(b)')}", f"{_rep(0, 'len(a)')} || {_rep(1, 'len(b)')}"),
        "special_pieces": (f"[{bos}] || a || [{eos}, {bos}] || b || [{eos}]", f"[1] || {_rep(0, 'len(a)')} || [1, 1] || {_rep(0, 'len(b)')} || [1]", f"{_rep(0, 'len(a) + 2')} || {_rep(1, 'len(b) + 2')}"),
    }
    for name, (ids, mask, types) in shapes.items():
        out[name] = f"WITH {P} SELECT doc_id, {_join(ids)} AS input_ids, {_join(mask)} AS special_mask, {_join(types)} AS type_ids FROM p"
    X = f"{P}, x AS (SELECT doc_id, a, b, len(a) AS la, len(b) AS lb, len(a) + len(b) + 4 - 96 AS n FROM p)"
    full = f"[{bos}] || {{}} || [{eos}, {eos}] || {{}} || [{eos}]"
    for name, side in (("truncate_first", "R"), ("truncate_first_left", "L")):
        cut = "a[1:la - n]" if side == "R" else "a[n + 1:la]"
        over = "a[la - least(la, n + 8) + 1:la]" if side == "R" else "a[1:least(la, n + 8)]"
        out[name] = f"WITH {X} SELECT doc_id, {_join(full.format(f'CASE WHEN n > 0 AND la > n THEN {cut} ELSE a END', 'b'))} AS input_ids, {_join(f'CASE WHEN n > 0 AND la > n THEN {over} ELSE [] END')} AS overflow, CAST(n AS BIGINT) AS num_truncated_tokens FROM x"
    out["truncate_second"] = f"WITH {X} SELECT doc_id, {_join(full.format('a', 'CASE WHEN n > 0 AND lb > n THEN b[1:lb - n] ELSE b END'))} AS input_ids, {_join('CASE WHEN n > 0 AND lb > n THEN b[lb - least(lb, n + 8) + 1:lb] ELSE [] END')} AS overflow, CAST(n AS BIGINT) AS num_truncated_tokens FROM x"
    halves = "CASE WHEN m = 0 THEN la WHEN la > lb THEN greatest(la - m, lb + greatest(la - lb - m, 0) - (greatest(m - (la - lb), 0) // 2)) ELSE la - greatest(m - (lb - la), 0) // 2 END"
    Y = f"{X}, y AS (SELECT *, greatest(n, 0) AS m FROM x), z AS (SELECT *, {halves} AS ka FROM y), k AS (SELECT doc_id, a[1:ka] AS a, b[1:lb - (m - (la - ka))] AS b FROM z)"
    out["truncate_longest_pair"] = f"WITH {Y} SELECT doc_id, {_join(full.format('a', 'b'))} AS input_ids FROM k"
    one = f"[{bos}] || ids || [{eos}]"

    def padded(ids: str, length: str, left: bool = False) -> str:
        fill, zero = _rep(pad, f"{length} - len({ids})"), _rep(0, f"{length} - len({ids})")
        ones = _rep(1, f"len({ids})")
        both = (f"{fill} || {ids}", f"{zero} || {ones}") if left else (f"{ids} || {fill}", f"{ones} || {zero}")
        return f"{_join(both[0])} AS input_ids, {_join(both[1])} AS attention_mask, CAST(greatest({length}, len({ids})) AS BIGINT) AS length"

    cut = lambda n: f"{D}, o AS (SELECT doc_id, [{bos}] || ids[1:{n} - 2] || [{eos}] AS s FROM d)"
    out["pad_longest"] = f"WITH {cut(256)}, l AS (SELECT *, max(len(s)) OVER (PARTITION BY doc_id // 32) AS most FROM o) SELECT doc_id, {padded('s', 'most')} FROM l"
    out["pad_max_left"] = f"WITH {cut(128)} SELECT doc_id, {padded('s', '128', True)} FROM o"
    out["pad_multiple"] = f"WITH {D}, o AS (SELECT doc_id, {one} AS s FROM d) SELECT doc_id, {padded('s', '((len(s) + 63) // 64 * 64)')} FROM o"
    out["encode_single"] = f"WITH {D}, o AS (SELECT doc_id, {one} AS s FROM d) SELECT doc_id, {padded('s', 'len(s)')} FROM o"
    out["encode_batch"] = f"WITH {cut(128)} SELECT doc_id, {padded('s', '128')} FROM o"
    Y2 = Y.replace("+ 4 - 96", "+ 4 - 128")
    ids, n = full.format("a", "b"), "len(a) + len(b) + 4"
    out["encode_pair"] = f"""WITH {Y2} SELECT doc_id, {_join(f"{ids} || {_rep(pad, f'128 - ({n})')}")} AS input_ids, {_join(_rep(0, f'greatest(128, {n})'))} AS token_type_ids, {_join(f"{_rep(1, n)} || {_rep(0, f'128 - ({n})')}")} AS attention_mask,
        {_join(f"[1] || {_rep(0, 'len(a)')} || [1, 1] || {_rep(0, 'len(b)')} || [1] || {_rep(1, f'128 - ({n})')}")} AS special_tokens_mask FROM k"""
    out["mask_finished"] = f"WITH {D} SELECT doc_id, {_join(f'[1] || {_rep(0, "len(ids)")} || [1]')} AS mask FROM d"
    out["windows"] = f"""WITH {D}, w AS (SELECT doc_id, ids, unnest(range(greatest(1, (len(ids) - 32 + 93) // 94))) AS w FROM d)
        SELECT doc_id, w AS window, w * 94 AS start, {_join(f'[{bos}] || ids[w * 94 + 1:w * 94 + 126] || [{eos}]')} AS ids FROM w"""
    out["piece_roundtrip"] = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
    out["decoded"] = "SELECT doc_id, text FROM documents"
    out["decoded_skip_special"] = out["cleanup_spaces"]
    out["decoded_added"] = f"WITH {D} SELECT doc_id, concat_ws(' ', {q(BOS)}, nullif(array_to_string(tokens, ' '), ''), {q(EOS)}, nullif(array_to_string(tokens, ' '), '')) AS text FROM d"
    out["input_json_roundtrip"] = f"SELECT conv_id, 'BatchInput' AS type, count(*) AS n, string_agg(text, {US} ORDER BY turn) AS texts FROM conversations GROUP BY conv_id"
    out["generation_mode"] = """WITH r AS (SELECT doc_id, doc_id % 192 AS id FROM documents), g AS (SELECT doc_id, id % 2 = 1 AS constrained, id // 2 % 3 + 1 AS beams, id // 6 % 2 + 1 AS groups, id // 12 % 2 = 1 AS sample, id // 24 % 2 * 49 + 1 AS top_k, id // 48 % 2 * 0.5 AS alpha, id // 96 % 2 = 1 AS assisted FROM r),
        m AS (SELECT doc_id, assisted, CASE WHEN constrained THEN 'constrained_beam_search' WHEN beams = 1 AND sample THEN 'sample' WHEN beams = 1 AND top_k > 1 AND alpha > 0 THEN 'contrastive_search' WHEN beams = 1 THEN 'greedy_search' WHEN groups > 1 THEN 'group_beam_search' WHEN sample THEN 'beam_sample' ELSE 'beam_search' END AS mode FROM g)
        SELECT doc_id, CASE WHEN NOT assisted THEN mode WHEN mode IN ('greedy_search', 'sample') THEN 'assisted_generation' END AS mode FROM m"""
    out["stop_flags"] = f"WITH {D} SELECT doc_id, coalesce(ids[len(ids)] IN (13, 14), false) AS eos, len(ids) >= 200 AS max_length, len(ids) >= 400 AS max_new_tokens, coalesce(ids[len(ids)] IN (13, 14), false) OR len(ids) >= 200 AS stopped FROM d"
    short = f"{D}, o AS (SELECT doc_id, len(ids) AS n, (len(ids) + 63) // 64 * 64 AS most FROM d)"
    out["generation_mask"] = f"WITH {short} SELECT doc_id, {_join(f'{_rep(0, "most - n")} || {_rep(1, "n")}')} AS mask FROM o"
    out["position_ids"] = f"WITH {short} SELECT doc_id, {_join(f'{_rep(1, "most - n")} || range(n)')} AS position_ids, {_join('range(40, CAST(most AS BIGINT))')} AS cache_position FROM o"
    out["repeat_interleave"] = "SELECT item_id, copy FROM benchmark, range(3) t(copy)"
    out["batch_lengths"] = f"WITH {D} SELECT doc_id // 32 AS batch_id, count(*) AS rows, CAST(max(len(ids)) AS BIGINT) AS longest FROM d GROUP BY doc_id // 32"
    C = _ids("c", "(SELECT conv_id || ':' || turn AS prompt, text FROM conversations)", "prompt")
    G = f"""{D},{C}, s AS (SELECT prompt AS seq_id, CASE WHEN len(ids) = 0 THEN [{bos}] ELSE ids END AS ids FROM c), bg AS (SELECT prev, nxt AS token_id, count(*) AS n FROM (SELECT ids[i] AS prev, ids[i + 1] AS nxt FROM (SELECT ids, unnest(range(1, len(ids))) AS i FROM d)) GROUP BY prev, nxt)"""
    GL = f"""{G}, s2 AS (SELECT seq_id, ids[1:CASE WHEN m = 0 THEN 1 ELSE 8 * m END] AS ids FROM (SELECT *, (CAST(split_part(seq_id, ':', 1) AS BIGINT) * 3 + CAST(split_part(seq_id, ':', 2) AS BIGINT)) % 8 AS m FROM s)),
        r AS (SELECT seq_id, ids, ids[len(ids)] AS last, len(ids) AS n_ids, greatest(len(ids) - 2, 1) AS plen, CAST(token_id AS BIGINT) AS token_id, ln(n) AS score FROM s2 JOIN bg ON bg.prev = ids[len(ids)])"""
    e_, n_, s_ = v["e"], v["n"], v["s"]
    E = f"{GL}, e AS (SELECT *, exp(score) / sum(exp(score)) OVER (PARTITION BY seq_id) AS p, max(score) OVER (PARTITION BY seq_id) AS top FROM r)"
    sel = "seq_id, token_id, round({}, 6) AS score"
    out["logits_temperature"] = f"WITH {GL} SELECT {sel.format('score / 0.7')} FROM r"
    out["logits_repetition_penalty"] = f"WITH {GL} SELECT {sel.format('CASE WHEN list_contains(ids, token_id) THEN CASE WHEN score < 0 THEN score * 1.3 ELSE score / 1.3 END ELSE score END')} FROM r"
    out["logits_encoder_repetition_penalty"] = f"WITH {GL} SELECT {sel.format('CASE WHEN list_contains(ids[1:plen], token_id) THEN CASE WHEN score < 0 THEN score * (1 / 1.3) ELSE score / (1 / 1.3) END ELSE score END')} FROM r"
    out["logits_top_k"] = f"WITH {GL} SELECT {sel.format('score')} FROM r QUALIFY rank() OVER (PARTITION BY seq_id ORDER BY score DESC) <= 10"
    out["logits_min_p"] = f"WITH {E} SELECT {sel.format('score')} FROM e WHERE score >= top + ln(0.05)"
    out["logits_epsilon"] = f"WITH {E} SELECT {sel.format('score')} FROM e WHERE p >= 0.01 OR score = top"
    out["logits_normalize"] = f"WITH {GL} SELECT {sel.format('score - ln(sum(exp(score)) OVER (PARTITION BY seq_id))')} FROM r"
    out["logits_suppress"] = f"WITH {GL} SELECT {sel.format('score')} FROM r WHERE token_id >= 256"
    out["logits_no_repeat"] = f"WITH {GL} SELECT {sel.format('score')} FROM r WHERE NOT list_contains(list_transform(list_filter(range(1, len(ids)), lambda i: ids[i] = ids[len(ids)]), lambda i: ids[i + 1]), token_id)"
    out["logits_min_length"] = f"WITH {GL} SELECT {sel.format('score')} FROM r WHERE n_ids >= 40 OR token_id NOT IN ({e_}, {n_})"
    out["logits_bias"] = f"WITH {GL} SELECT {sel.format('score + CASE WHEN token_id = ' + str(e_) + ' THEN 2.0 ELSE 0.0 END + CASE WHEN token_id = ' + str(s_) + ' AND last = ' + str(e_) + ' THEN -1.0 ELSE 0.0 END + CASE WHEN token_id = ' + str(e_) + ' AND last = ' + str(n_) + ' THEN 3.0 ELSE 0.0 END')} FROM r"
    upto = lambda mass, order: f"sum(p) OVER (PARTITION BY seq_id ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < {mass} OR row_number() OVER (PARTITION BY seq_id ORDER BY {order}) = 1"
    H = f"{E}, h AS (SELECT *, sum(-p * ln(p)) OVER (PARTITION BY seq_id) AS h FROM e)"
    out["logits_top_p"] = f"WITH {E} SELECT {sel.format('score')} FROM e QUALIFY {upto(0.8, 'score DESC, token_id')}"
    out["logits_typical"] = f"WITH {H} SELECT {sel.format('score')} FROM h QUALIFY {upto(0.7, 'abs(-ln(p) - h), token_id')}"
    out["logits_eta"] = f"WITH {H} SELECT {sel.format('score')} FROM h WHERE p >= least(0.05, sqrt(0.05) * exp(-h)) OR score = top"
    out["logits_min_new_tokens"] = f"WITH {GL} SELECT {sel.format('score')} FROM r WHERE n_ids - plen >= 2 OR token_id NOT IN ({e_}, {n_})"
    out["logits_encoder_no_repeat"] = f"WITH {GL} SELECT {sel.format('score')} FROM r WHERE NOT list_contains(list_transform(list_filter(range(1, plen), lambda i: ids[i] = last), lambda i: ids[i + 1]), token_id)"
    out["logits_no_bad_words"] = f"WITH {GL} SELECT {sel.format('score')} FROM r WHERE token_id <> {s_} AND NOT (token_id = {n_} AND last = {e_}) AND NOT (token_id = {e_} AND last = {n_})"
    out["logits_prefix_constrained"] = f"WITH {GL} SELECT {sel.format('score')} FROM r WHERE token_id % 3 = 0"
    out["logits_hamming_diversity"] = f"WITH {GL} SELECT {sel.format('score - 0.5 * len(list_filter(ids, lambda x: x = token_id))')} FROM r"
    forced = lambda n, t: f"CASE WHEN len(ids) = {n} THEN 0.0 ELSE score END FROM_ WHERE len(ids) <> {n} OR token_id = {t}"
    for name, (n, t) in {"logits_forced_bos": (1, e_), "logits_forced_eos": (24, e_)}.items():
        value, where = forced(n, t).split(" FROM_ ")
        out[name] = f"WITH {GL} SELECT {sel.format(value)} FROM r {where}"
    out["logits_force_tokens"] = f"WITH {GL} SELECT {sel.format('CASE WHEN n_ids IN (8, 16, 40) THEN 0.0 ELSE score END')} FROM r WHERE n_ids NOT IN (8, 16, 40) OR token_id = CASE n_ids WHEN 8 THEN {e_} WHEN 16 THEN {n_} ELSE {s_} END"
    out["logits_remove_invalid"] = f"WITH {GL} SELECT {sel.format('CASE token_id % 7 WHEN 0 THEN 0.0 WHEN 1 THEN 3.4028234663852886e38 ELSE score END')} FROM r"
    out["logits_exponential_decay"] = f"WITH {GL} SELECT {sel.format('CASE WHEN token_id IN (' + f'{e_}, {n_}' + ') THEN score + abs(score) * (pow(1.2, n_ids - plen + 1) - 1) ELSE score END')} FROM r"
    out["logits_suppress_at_begin"] = f"WITH {GL} SELECT {sel.format('score')} FROM r WHERE n_ids <> 32 OR token_id >= 100"
    soft = lambda x: f"({x} - ln(sum(exp({x})) OVER (PARTITION BY seq_id)))"
    out["logits_guidance"] = f"WITH {GL}, n AS (SELECT seq_id, token_id, {soft('score')} AS a, {soft('score / 2')} AS b FROM r) SELECT {sel.format('(a - b) * 1.5 + b')} FROM n"
    out["stop_strings"] = "SELECT doc_id, contains(text, 'the end') OR contains(text, 'erly.') AS stopped FROM documents"
    low = ws.replace("text", "lower(text)")
    out["vocabulary_file"] = f"""WITH w AS (SELECT doc_id, unnest({low}) AS token FROM documents), k AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS id FROM w GROUP BY token QUALIFY id < 2000)
        SELECT d.doc_id, count(k.token) AS n_known, CAST(coalesce(sum(k.id), 0) AS BIGINT) AS id_sum FROM documents AS d LEFT JOIN w USING (doc_id) LEFT JOIN k USING (token) GROUP BY d.doc_id"""
    out["merges_file"] = f"""WITH {D}, m(rank, l, r) AS (VALUES {', '.join(f'({i}, {q(a)}, {q(b)})' for i, (a, b) in enumerate(small_merges()))}), n AS (SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM d) GROUP BY token)
        SELECT CAST(rank AS BIGINT) AS rank, m.l AS "left", m.r AS "right", coalesce(n, 0) AS n FROM m LEFT JOIN n ON n.token = m.l || m.r"""
    out["tokenizer_configs"] = f"""WITH c(k, tokenizer_class, lowered, most, side, special) AS (VALUES (0, 'CLIPTokenizer', true, 77, 'right', {q(f'{BOS} {EOS} {PAD}')}), (1, 'GPT2Tokenizer', false, 1024, 'left', {q(f'{EOS} {UNK}')}), (2, 'LlamaTokenizer', false, 4096, 'right', {q(f'<s> </s> {UNK}')})),
        w AS (SELECT doc_id, tokenizer_class, special, most, side, CASE WHEN lowered THEN {low} ELSE {ws} END AS w FROM documents JOIN c ON c.k = doc_id % 3), x AS (SELECT *, CASE WHEN side = 'left' THEN w[greatest(len(w) - most + 1, 1):] ELSE w[1:most] END AS x FROM w)
        SELECT doc_id, tokenizer_class, special, CAST(len(x) AS BIGINT) AS n, x[1] AS first, x[-1] AS last FROM x"""
    ends = f"({v['e']}, {v['n']})"
    out["greedy_until_end"] = f"""WITH RECURSIVE {G}, nx AS (SELECT prev, token_id FROM bg QUALIFY row_number() OVER (PARTITION BY prev ORDER BY n DESC, token_id) = 1),
        w(seq_id, ids, step, done) AS (SELECT seq_id, ids, 0, false FROM s UNION ALL SELECT seq_id, list_append(ids, CASE WHEN done THEN {pad} ELSE nx.token_id END), step + 1, done OR nx.token_id IN {ends} FROM w LEFT JOIN nx ON nx.prev = ids[len(ids)] WHERE step < 6 AND (done OR nx.token_id IS NOT NULL)),
        l AS (SELECT seq_id, arg_max(ids, step) AS ids FROM w GROUP BY seq_id) SELECT seq_id AS prompt, {_join('ids')} AS ids FROM l"""
    out["greedy_bigram"] = f"""WITH RECURSIVE {G}, nx AS (SELECT prev, token_id FROM bg QUALIFY row_number() OVER (PARTITION BY prev ORDER BY n DESC, token_id) = 1),
        w(seq_id, ids, step) AS (SELECT seq_id, ids, 0 FROM s UNION ALL SELECT seq_id, list_append(ids, nx.token_id), step + 1 FROM w JOIN nx ON nx.prev = ids[len(ids)] WHERE step < 12)
        SELECT seq_id AS prompt, {_join('arg_max(ids, step)')} AS ids FROM w GROUP BY seq_id"""
    out["prompt_lookup"] = out["greedy_plan"] = out["greedy_bigram"]
    H2 = f"{G}, h AS (SELECT seq_id, ids[1:greatest(1, len(ids) // 2)] AS ids FROM s), lg AS (SELECT prev, token_id, sc - top - ln(sum(exp(sc - top)) OVER (PARTITION BY prev)) AS lp, exp(sc - top) / sum(exp(sc - top)) OVER (PARTITION BY prev) AS p FROM (SELECT *, ln(n) AS sc, max(ln(n)) OVER (PARTITION BY prev) AS top FROM bg))"
    steps = ", ".join(f"""b{k + 1} AS (SELECT seq_id, list_append(ids, token_id) AS ids, total + CASE WHEN list_contains(ids, token_id) THEN lp * 1.3 ELSE lp END AS total FROM b{k} JOIN lg ON prev = ids[len(ids)]
        QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY total + CASE WHEN list_contains(ids, token_id) THEN lp * 1.3 ELSE lp END DESC, list_append(ids, token_id)) <= 3)""" for k in range(4))
    out["beam_bigram"] = f"WITH {H2}, b0 AS (SELECT seq_id, ids, CAST(0 AS DOUBLE) AS total FROM h), {steps} SELECT seq_id AS prompt, {_join('ids')} AS ids, round(total / 4, 6) AS score FROM b4 QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY total / 4 DESC, total DESC, ids) = 1"
    steps = ", ".join(f"""c{k} AS (SELECT seq_id, ids, token_id, p FROM c{k}s JOIN lg ON prev = ids[len(ids)] QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY p DESC, token_id) <= 4),
        d{k} AS (SELECT c.seq_id, c.ids, c.token_id, c.p, coalesce(max(list_inner_product(x.v, y.v) / (x.norm * y.norm)), 0) AS near FROM c{k} AS c LEFT JOIN vec AS x ON x.token_id = c.token_id LEFT JOIN (SELECT DISTINCT seq_id, unnest(ids) AS token_id FROM c{k}s) AS u ON u.seq_id = c.seq_id LEFT JOIN vec AS y ON y.token_id = u.token_id GROUP BY ALL),
        c{k + 1}s AS (SELECT seq_id, list_append(ids, token_id) AS ids FROM d{k} QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY 0.4 * p - 0.6 * near DESC, token_id) = 1)""" for k in range(5))
    out["contrastive_search"] = f"WITH {H2}, vec AS (SELECT token_id, v, sqrt(list_inner_product(v, v)) AS norm FROM (SELECT vec_id AS token_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id < {len(v)})), c0s AS (SELECT seq_id, ids FROM h), {steps} SELECT seq_id AS prompt, {_join('ids')} AS ids FROM c5s"
    out["stream_batches"] = f"""WITH {C}, k AS (SELECT conv_id % 8 AS lane, conv_id * 1000 + turn AS t, lpad(CAST(conv_id AS VARCHAR), 12, '0') || ':' || lpad(CAST(turn AS VARCHAR), 6, '0') AS row, ids FROM conversations JOIN c ON c.prompt = conv_id || ':' || turn),
        b AS (SELECT *, (row_number() OVER (PARTITION BY lane ORDER BY t, row) - 1) // 16 AS batch, max(t) OVER () AS latest FROM k), l AS (SELECT *, max(len(ids)) OVER w AS most, count(*) OVER w AS n, min(t) OVER w AS first FROM b WINDOW w AS (PARTITION BY lane, batch))
        SELECT lane, batch, row, {_join(f"ids || {_rep(pad, 'most - len(ids)')}")} AS input_ids, {_join(f"{_rep(1, 'len(ids)')} || {_rep(0, 'most - len(ids)')}")} AS attention_mask FROM l WHERE n = 16 OR first < latest"""
    toks = ", ".join(f"({i}, {q(t)})" for t, i in v.items())
    out["token_healing"] = f"""WITH {H2}, tk(id, txt) AS (VALUES {toks}), k AS (SELECT seq_id, ids, CASE WHEN len(ids) = 1 THEN [{bos}] ELSE ids[1:len(ids) - 1] END AS cut, ids[len(ids)] AS tail, t.txt AS tail_txt FROM h JOIN tk AS t ON t.id = ids[len(ids)]),
        b AS (SELECT k.seq_id, k.cut, lg.token_id FROM k JOIN lg ON lg.prev = k.cut[len(k.cut)] JOIN tk ON tk.id = lg.token_id WHERE (SELECT count(*) FROM tk AS o WHERE starts_with(o.txt, k.tail_txt)) > 1
          QUALIFY row_number() OVER (PARTITION BY k.seq_id ORDER BY lg.lp + CASE WHEN starts_with(tk.txt, k.tail_txt) THEN 10.0 ELSE 0.0 END + CASE WHEN lg.token_id = k.tail THEN 1.0 ELSE 0.0 END DESC, lg.token_id) = 1)
        SELECT h.seq_id AS prompt, {_join('CASE WHEN b.token_id IS NULL THEN h.ids ELSE list_append(b.cut, b.token_id) END')} AS ids FROM h LEFT JOIN b USING (seq_id)"""
    out["token_offsets"] = "SELECT doc_id, coalesce(text, '') AS text, coalesce(length(text), 0) AS last_end FROM documents"
    hit = " OR ".join(f"contains(substr(w.txt, greatest(1, len(w.txt) - {len(byte_encoded(x)) - 2})) || tk.txt, {q(byte_encoded(x))})" for x in ("er", " th", "est"))
    texts = ", ".join(f"({i}, {q(t)})" for t, i in v.items())
    out["stop_in_loop"] = f"""WITH RECURSIVE {H2}, tk(id, txt) AS (VALUES {texts}), nx AS (SELECT prev, token_id FROM bg QUALIFY row_number() OVER (PARTITION BY prev ORDER BY n DESC, token_id) = 1),
        st AS (SELECT seq_id, string_agg(txt, '' ORDER BY i) AS txt FROM (SELECT seq_id, unnest(ids) AS id, unnest(range(len(ids))) AS i FROM h) JOIN tk USING (id) GROUP BY seq_id),
        w(seq_id, ids, last, txt, step, done) AS (SELECT seq_id, ids, ids[len(ids)], txt, 0, false FROM h JOIN st USING (seq_id) UNION ALL
          SELECT seq_id, list_append(ids, CASE WHEN done THEN {pad} ELSE nx.token_id END), nx.token_id, w.txt || tk.txt, step + 1, done OR {hit} FROM w JOIN nx ON nx.prev = w.last JOIN tk ON tk.id = nx.token_id WHERE step < 10)
        SELECT seq_id AS prompt, {_join('arg_max(ids, step)')} AS ids FROM w GROUP BY seq_id"""
    return out
