"""Removal of long byte strings that occur more than once, with suffix arrays built by linear grouping.

Equal strings of LENGTH bytes have the same smallest hashed K-gram at the same offset (their anchor), so
occurrences are grouped by anchor and only there compared: the SEGMENT of an anchor is all windows whose
smallest K-gram it is. Equal segments are counted by hash. Groups with different segments are dealt into
blocks of bounded size; a block's segments, cut into 16-byte symbols counted from the anchor, form one
string whose suffix array is built by Lyndon grouping: groups of suffixes with equal Lyndon prefix are
processed in descending order with previous-smaller pointers, then each group's order is emitted in one
ascending pass, without renaming. Common prefixes of neighbours give the windows that occur again, to the
byte. A group of too many segments is split by its windows' offset: each half shares a longer core, which
joins the key; at the last split the key is the whole window, and counting decides.

Edge cases: null text counts as empty; texts shorter than LENGTH keep every byte; repeated rows are copies
of each other; rows that share doc_id and text get equal results; an empty table gives an empty result; other
columns are ignored. Segments are told apart by 128 bits of hashes, rows by 64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, saved, sized

LENGTH = 400
K = 32
BLOCK_BYTES = 3_000_000
HOT = 1500
PASSAGE = 50
#: Bytes of text behind a frame of results, and behind arrays that a core's cache holds.
_PART, _CACHED = 1_000_000, 60_000
_RNG = np.random.default_rng(20240601)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = 0x9E3779B97F4A7C15
_SPACES = np.isin(np.arange(256), list(b" \t\n\r\v\f"))


def suffix_array(s: list[int]) -> list[int]:
    """Suffix array of s by Lyndon grouping; s ends with a symbol that is smaller than all others."""
    n = len(s)
    members: dict[int, list[int]] = {}
    for i, c in enumerate(s):
        members.setdefault(c, []).append(i)
    symbols = sorted(members)
    rank = {c: k for k, c in enumerate(symbols)}
    group = [rank[c] for c in s]
    members = {rank[c]: m for c, m in members.items()}
    size = {g: len(m) for g, m in members.items()}
    below = {k: k - 1 for k in range(len(symbols))}
    above = {k: k + 1 for k in range(len(symbols))}
    fresh, top = len(symbols), len(symbols) - 1
    done, previous = bytearray(n), [-1] * n
    order, g = [], top
    # First phase: from the greatest group down, each group's suffixes refine the groups of what comes before them.
    while g >= 0:
        own = members.pop(g)
        if len(own) != size[g]:
            own = [i for i in own if group[i] == g]
        own.sort()
        for i in own:
            done[i] = 1
        hits: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and done[p]:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                hits[p] = hits.get(p, 0) + 1
        parts: dict[tuple[int, int], list[int]] = {}
        for p, c in hits.items():
            parts.setdefault((c, group[p]), []).append(p)
        for c, h in sorted(parts, reverse=True) if len(parts) > 1 else parts:  # more followers: greater
            moved = parts[c, h]
            if len(moved) == size[h]:
                continue
            size[h] -= len(moved)
            size[fresh], members[fresh] = len(moved), moved
            for p in moved:
                group[p] = fresh
            below[fresh], above[fresh] = h, above[h]
            below[above[h]] = fresh
            above[h] = fresh
            fresh += 1
        order.append(g)
        g = below[g]
    # Second phase: an ascending pass; each placed suffix puts the ones it bounds at their groups' next places.
    nxt, at = {}, 0
    for g in reversed(order):
        nxt[g] = at
        at += size[g]
    out, placed = [0] * n, bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    nxt[group[n - 1]] += 1
    for r in range(n):
        j = out[r] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[nxt[g]] = j
            nxt[g] += 1
            placed[j] = 1
            j = previous[j]
    return out


def anchors(text: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For concatenated text: for each window start its anchor's position, and the hash of each K-gram."""
    h, step = _BYTE[text], 1
    power = np.uint64(_MULT)
    while step < k:  # k is a power of two
        h = h[:-step] * power + h[step:]
        power = np.uint64(int(power) ** 2 % 2**64)
        step *= 2
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return _lowest(h, length - k + 1), h


def _lowest(h: np.ndarray, span: int) -> np.ndarray:
    """The place of the smallest of each ``span`` consecutive hashes, by their upper 32 bits, the first one of equals; fewer than 2**32 hashes."""
    low, step = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), 1
    while step * 2 <= span:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if rest := span - step:
        low = np.minimum(low[:-rest], low[rest:])
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _anchor_rows(texts: list[bytes], keys: np.ndarray, length: int, k: int) -> dict | None:
    """Anchors of all texts: row key, anchor hash, segment hash, anchor position, first and last window start."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    joined = b"".join(texts)
    if len(joined) < length:
        return None
    pos, h = anchors(np.frombuffer(joined, dtype=np.uint8), length, k)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    valid = np.zeros(len(pos) + 1, dtype=np.int64)
    long = sizes >= length
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(valid)[: len(pos)])
    if not len(at):
        return None
    p = pos[at]
    first = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (at[1:] != at[:-1] + 1))))
    last = np.concatenate((first[1:] - 1, [len(at) - 1]))
    lo, hi, a = at[first], at[last], p[first]
    doc = np.searchsorted(ends, lo, side="right")
    digest = xxhash.xxh3_64_intdigest
    sh = np.array([digest(joined[x : y + length]) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], dtype=np.uint64)
    base = starts[doc]
    return {"dk": keys[doc], "ah": h[a].view(np.int64), "sh": sh.view(np.int64), "a": a - base, "lo": (lo - base), "hi": (hi - base)}


_A = "dk long, ah long, sh long, a long, lo long, hi long"


def _all_anchors(keyed: DataFrame, length: int, k: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found, part, keys, size, done = [], [], [], 0, 0
            for dk, text in [*zip(b.dk, b.text, strict=True), (None, None)]:
                raw = (text or "").encode() if dk is not None else b""
                if part and (dk is None or size + len(raw) > _CACHED):
                    if (rows := _anchor_rows(part, np.array(keys, dtype=np.int64), length, k)) is not None:
                        found.append(rows)
                    part, keys, size, done = [], [], 0, done + size
                if found and (dk is None or done > _PART):
                    yield pd.DataFrame({c: np.concatenate([x[c] for x in found]) for c in found[0]})
                    found, done = [], 0
                if dk is not None and len(raw) >= length:
                    part.append(raw)
                    keys.append(dk)
                    size += len(raw)

    return keyed.select("dk", "text").mapInPandas(run, _A)


_SEG = "key long, ah long, sh long, n long, body binary, a int, dlo int, dhi int"


def _answers(keyed: DataFrame, cuts: DataFrame, anchored: DataFrame, length: int, min_words: int) -> DataFrame:
    """What rows asked_dk are asked for, in one pass over the texts: the bytes of their cuts (_SEG, keyed by anchor; dk is null) and the runs of words, w, at their anchors."""
    asked = gathered(cuts.join(anchored, "asked_dk", "full"), cuts.count() + anchored.count(), 5_000)
    texts = keyed.join(asked, F.col("dk") == F.col("asked_dk")).select("dk", "text", "cuts", "anchors").dropDuplicates(["dk"])
    names = [x.split()[0] for x in _SEG.split(", ")] + ["dk", "w"]

    def bodies(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for text, own in [*zip(b.text, b.cuts, strict=True), ("", None)]:
            raw = text.encode()
            for c in own if own is not None else ():
                out.append((c["ah"], c["ah"], c["sh"], c["n"], raw[c["lo"] : c["hi"] + length], c["a"] - c["lo"], c["a"] - c["hi"], c["a"] - c["lo"]))
                size += len(out[-1][4])
            if size > _PART:
                yield pd.DataFrame(out, columns=names[:-2])
                out, size = [], 0
        yield pd.DataFrame(out, columns=names[:-2])

    def windows(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for part in _parts(b[b.anchors.notna()]):
            of, window, anchor, _ = passage_windows([t.encode() for t in part.text], min_words + 1)
            lists = [np.asarray(x, dtype=np.int64) for x in part.anchors]
            asked = pd.DataFrame({"of": np.repeat(np.arange(len(lists)), [len(x) for x in lists]), "ah": np.concatenate(lists)})
            found = pd.DataFrame({"of": of, "ah": anchor.view(np.int64), "w": window.view(np.int64)}).drop_duplicates().merge(asked, on=["of", "ah"])
            yield pd.DataFrame({"dk": part.dk.to_numpy()[found.of], "w": found.w})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for frames in (bodies(b), windows(b)):
                for x in frames:
                    if len(x):
                        yield x.assign(**{c: None for c in names if c not in x})[names]

    return saved(texts.mapInPandas(run, _SEG + ", dk long, w long"))


def _halves(rows: DataFrame, level_lo: int, level_hi: int, length: int) -> DataFrame:
    """Split the windows at offsets level_lo to level_hi from their anchor in two: the key takes in the core that a half's windows share."""
    mid = (level_lo + level_hi) // 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                for lo, hi in ((level_lo, mid), (mid + 1, level_hi)):
                    dlo, dhi = max(r.dlo, lo), min(r.dhi, hi)
                    if dlo > dhi:
                        continue
                    body = r.body[r.a - dhi : r.a - dlo + length]
                    # the common core reaches from lo before the anchor to where the window at hi ends
                    core = r.body[r.a - lo : r.a - hi + length]
                    key = xxhash.xxh3_64_intdigest(core, seed=lo * 1000 + hi) - 2**63
                    out.append((key, r.ah, r.sh, r.n, body, dhi, dlo, dhi, lo, hi))
            yield pd.DataFrame(out, columns=["key", "ah", "sh", "n", "body", "a", "dlo", "dhi", "llo", "lhi"])

    return rows.mapInPandas(run, _SEG + ", llo int, lhi int")


def repeated_windows(bodies: list[bytes], anchor: np.ndarray, first: np.ndarray, last: np.ndarray, key: np.ndarray, weight: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each segment the window starts that occur in another one of its key, or in a segment that itself occurs twice."""
    n = len(bodies)
    sizes = np.array([len(b) for b in bodies], dtype=np.int64)
    lead = (anchor - 0) % 16  # bytes before the first symbol, so that symbols are counted from the anchor
    count = -(-(sizes - lead) // 16)
    # each segment's bytes, shifted so that symbols start at multiples of 16, with zeros around
    cells = count + 2
    base = np.cumsum(cells) - cells
    raw = np.zeros(int(cells.sum()) * 16, dtype=np.uint8)
    joined = np.frombuffer(b"".join(bodies), dtype=np.uint8)
    offset = np.cumsum(sizes) - sizes
    raw[np.arange(len(joined)) + np.repeat(base * 16 + 16 - lead - offset, sizes)] = joined
    pair = raw.view(">u8").astype(np.uint64).reshape(-1, 2)
    hi, lo = pair[:, 0], pair[:, 1]
    owner = np.repeat(np.arange(n), count)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    cell = base[owner] + 1 + index
    # ranks of 16-byte symbols; 1 parts the segments and 0 ends the string
    order = np.lexsort((lo[cell], hi[cell]))
    h, l = hi[cell][order], lo[cell][order]
    rank = np.empty(len(cell), dtype=np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], ((h[1:] != h[:-1]) | (l[1:] != l[:-1])).astype(np.int64)))) + 2
    place = np.arange(len(cell)) + owner  # with one parting symbol after each segment
    s = np.ones(len(cell) + n + 1, dtype=np.int64)
    s[place] = rank
    s[-1] = 0
    sa = np.array(suffix_array(s.tolist()), dtype=np.int64)
    symbol = np.full(len(s), -1, dtype=np.int64)
    symbol[place] = np.arange(len(cell))
    sa = sa[symbol[sa] >= 0]
    s = np.concatenate((s, np.zeros(32, dtype=np.int64)))
    # common prefix of neighbours in bytes, as far as LENGTH asks
    most = -(-length // 16)
    same, live = np.zeros(len(sa), dtype=np.int64), np.arange(1, len(sa))
    for step in range(most):
        live = live[s[sa[live] + step] == s[sa[live - 1] + step]]
        same[live] += 1
        if not len(live):
            break
    mine = symbol[sa]
    x, y = np.arange(1, len(sa)), np.arange(0, len(sa) - 1)
    c = np.zeros(len(sa) + 1, dtype=np.int64)
    cx, cy = np.minimum(cell[mine[x]] + same[1:], len(hi) - 1), np.minimum(cell[mine[y]] + same[1:], len(hi) - 1)
    dh, dl = hi[cx] ^ hi[cy], lo[cx] ^ lo[cy]
    c[1:-1] = same[1:] * 16 + np.where(dh != 0, _equal_bytes(dh), 8 + _equal_bytes(dl))
    # windows that start delta bytes before a symbol: equal when the symbol's suffixes share LENGTH - delta bytes and so do the delta bytes before
    who = owner[mine]
    at = lead[who] + index[mine] * 16  # the symbol's place in its segment
    before_hi, before_lo = hi[cell[mine] - 1], lo[cell[mine] - 1]
    found: list[list[np.ndarray]] = [[] for _ in range(n)]
    got_who, got_at = [], []
    for delta in range(16):
        need = length - delta
        run = np.cumsum(c[:-1] < need)
        d = anchor[who] - (at - delta)
        ok = (at - delta >= 0) & (sizes[who] - at >= need) & (d >= first[who]) & (d <= last[who])
        in_run = np.bincount(run[ok], minlength=int(run[-1]) + 1 if len(run) else 1)
        ok &= (in_run[run] > 1) | (weight[who] > 1)
        i = np.flatnonzero(ok)
        if not len(i):
            continue
        if delta == 0:
            mh, ml = np.zeros(len(i), dtype=np.uint64), np.zeros(len(i), dtype=np.uint64)
        elif delta <= 8:
            mh, ml = np.zeros(len(i), dtype=np.uint64), before_lo[i] << np.uint64(64 - 8 * delta)
        else:
            mh, ml = before_hi[i] << np.uint64(128 - 8 * delta) if delta < 16 else before_hi[i], before_lo[i]
        o = np.lexsort((ml, mh, d[i], key[who[i]], run[i]))
        i = i[o]
        mh, ml, dd, kk = mh[o], ml[o], d[i], key[who[i]]
        new = np.concatenate(([True], (mh[1:] != mh[:-1]) | (ml[1:] != ml[:-1]) | (dd[1:] != dd[:-1]) | (kk[1:] != kk[:-1]) | (run[i][1:] != run[i][:-1])))
        label = np.cumsum(new) - 1
        heavy = np.bincount(label, weights=weight[who[i]]) > 1
        i = i[heavy[label]]
        got_who.append(who[i])
        got_at.append(at[i] - delta)
    if got_who:
        w, p = np.concatenate(got_who), np.concatenate(got_at)
        o = np.lexsort((p, w))
        w, p = w[o], p[o]
        cut = np.flatnonzero(np.diff(w)) + 1
        for part_w, part_p in zip(np.split(w, cut), np.split(p, cut), strict=True):
            found[int(part_w[0])].append(part_p)
    return [np.concatenate(f) if f else np.zeros(0, dtype=np.int64) for f in found]


def _equal_bytes(x: np.ndarray) -> np.ndarray:
    """Leading zero bytes of 64-bit words."""
    out = np.zeros(len(x), dtype=np.int64)
    for k in range(1, 9):
        out += (x >> np.uint64(64 - 8 * k)) == 0
    return out


def _spans(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Unions of the windows at sorted starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    return [(int(p[0]), int(p[-1]) + length) for p in np.split(starts, cut)]


def repeated_segments(keyed: DataFrame, length: int = LENGTH, k: int = K) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of anchors found more than once; their segments with count and one of the rows; asked_dk and the cuts of the segments that are to be compared."""
    rows = saved(_all_anchors(keyed, length, k))
    most = rows.count()
    again = gathered(rows.groupBy("ah").agg(F.count("*").alias("c"), F.min("sh").alias("x"), F.max("sh").alias("y")).where("c > 1").select("ah", (F.col("x") != F.col("y")).alias("mixed")), most)
    rows = gathered(rows.join(again, "ah"), most)
    segments = gathered(rows.groupBy("ah", "sh", "mixed").agg(F.count("*").alias("n"), F.min(F.struct("dk", "a", "lo", "hi")).alias("rep")), most)
    return rows, segments, gathered(segments.where("mixed").groupBy(F.col("rep.dk").alias("asked_dk")).agg(F.collect_list(F.struct("ah", "sh", "n", "rep.a", "rep.lo", "rep.hi")).alias("cuts")), most)


def removed_spans(rows: DataFrame, segments: DataFrame, bodies: DataFrame, length: int = LENGTH, k: int = K, hot: int = HOT, block: int = BLOCK_BYTES) -> DataFrame:
    """dk and the byte spans (s, e) to remove; spans may overlap."""
    most = rows.count()
    bodies = bodies.withColumns({"llo": F.lit(0), "lhi": F.lit(length - k)})

    cold, counted = [], []
    while True:
        groups = gathered(bodies.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("key"), most)
        if groups.limit(1).count() == 0:
            cold.append(bodies)
            break
        cold.append(bodies.join(groups, "key", "left_anti"))
        split = []
        for r in sorted(bodies.select("llo", "lhi").distinct().collect()):  # at most two ranges more with each level of splitting
            part = bodies.where((F.col("llo") == r.llo) & (F.col("lhi") == r.lhi)).join(groups, "key", "left_semi").drop("llo", "lhi")
            split.append(_halves(part, r.llo, r.lhi, length))
        bodies = split[0]
        for x in split[1:]:
            bodies = bodies.unionByName(x)
        bodies = saved(bodies)
        whole = bodies.where("llo = lhi")
        twice = whole.groupBy("key").agg(F.sum("n").alias("c")).where("c > 1").select("key")
        counted.append(whole.join(twice, "key", "left_semi").select("ah", "sh", F.array(F.struct((-F.col("dlo")).cast("long").alias("s"), (F.lit(length) - F.col("dlo")).cast("long").alias("e"))).alias("spans")))
        bodies = bodies.where("llo < lhi")
    bodies = cold[0]
    for x in cold[1:]:
        bodies = bodies.unionByName(x)
    total = bodies.agg(F.sum(F.length("body"))).first()[0] or 0
    blocks = max(1, -(-total // block))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["key", "ah", "sh"])
        pieces = list(b.body)
        starts = repeated_windows(pieces, b.a.to_numpy(np.int64), b.dlo.to_numpy(np.int64), b.dhi.to_numpy(np.int64), b.key.to_numpy(), b.n.to_numpy(np.int64), length)
        out = [(ah, sh, [{"s": s - a, "e": e - a} for s, e in _spans(w, length)]) for ah, sh, a, w in zip(b.ah, b.sh, b.a, starts, strict=True) if len(w)]
        return pd.DataFrame(out, columns=["ah", "sh", "spans"])

    found = bodies.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).groupBy("block").applyInPandas(run, "ah long, sh long, spans array<struct<s:long,e:long>>")
    full = segments.where("n > 1").select("ah", "sh", F.array(F.struct((F.col("rep.lo") - F.col("rep.a")).alias("s"), (F.col("rep.hi") + length - F.col("rep.a")).alias("e"))).alias("spans"))
    spans = full.unionByName(found)
    for x in counted:
        spans = spans.unionByName(x)
    spans = saved(spans)
    return rows.select("dk", "ah", "sh", "a").join(spans, ["ah", "sh"]).select("dk", F.explode(F.transform("spans", lambda x: F.struct((x.s + F.col("a")).alias("s"), (x.e + F.col("a")).alias("e")))).alias("span"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _MULT and of its inverse, modulo 2**64."""
    return tuple(np.multiply.accumulate(np.concatenate((np.ones(1, dtype=np.uint64), np.full(n - 1, m, dtype=np.uint64)))) for m in (_MULT, pow(_MULT, -1, 2**64)))


_POWERS = _powers(2 * _CACHED)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The number of words (between ASCII white space) of each text, and all words' hashes: polynomials taken from sums over all bytes before."""
    joined = b" " + b" ".join(texts) + b" "
    raw = np.frombuffer(joined, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(_SPACES[raw].view(np.int8))) + 1
    start, end = edges[::2], edges[1::2]
    up, down = _POWERS if len(raw) <= len(_POWERS[0]) else _powers(len(raw))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    h = _mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start > 500).tolist():  # where a polynomial modulo 2**64 has known collisions
        h[i] = xxhash.xxh3_64_intdigest(joined[start[i] : end[i]])
    begin = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return np.diff(np.searchsorted(start, begin)), h


def passage_windows(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all runs of ``words`` words (between ASCII white space) within a text: the text's number, the run's hash, and hash and place of its anchor, its smallest gram of a fourth as many words."""
    sizes, h = word_hashes(texts)
    if len(h) < words:
        none = np.zeros(0, dtype=np.int64)
        return none, none.view(np.uint64), none.view(np.uint64), none
    power, step, k = np.uint64(_MULT), 1, max(1, words // 4)
    grams = {}

    def joined(left: np.ndarray, right: np.ndarray, of: int, more: int) -> np.ndarray:
        n = len(h) - of - more + 1
        return _mixed(left[:n] * power + right[of : of + n])

    grams[1] = h
    while step * 2 <= words:
        grams[step * 2] = joined(grams[step], grams[step], step, step)
        step *= 2

    def gram(n: int) -> np.ndarray:
        have = out = None
        for size in sorted(grams, reverse=True):
            if n & size:
                out, have = (grams[size], size) if have is None else (joined(out, grams[size], have, size), have + size)
        return out

    window, low = gram(words), gram(k)
    ends = np.cumsum(sizes)
    at = np.flatnonzero(np.repeat(ends, sizes)[: len(window)] - np.arange(len(window)) >= words)
    place = _lowest(low, words - k + 1)[at]
    return np.searchsorted(ends, at, side="right"), window[at], low[place], place


def _parts(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
    if len(b):
        for _, part in b.groupby(b.text.str.len().cumsum() // _CACHED):
            yield part


def shared_segments(keyed: DataFrame, min_words: int = PASSAGE) -> tuple[DataFrame, DataFrame]:
    """dk of the rows that share all neighbouring runs of an anchor (a segment) with another row, told by one hash; asked_dk and the anchors to compare run by run, those of rows that share no whole segment."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for part in _parts(b):
                of, window, anchor, place = passage_windows([t.encode() for t in part.text], min_words + 1)
                first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (of[1:] != of[:-1])))) if len(of) else np.zeros(0, dtype=np.int64)
                last = np.append(first[1:], len(of)) - 1 if len(of) else first
                segment = _mixed(window[first] * np.uint64(_MULT) + window[last]) + (last - first).astype(np.uint64)
                out.append(pd.DataFrame({"dk": part.dk.to_numpy()[of[first]], "ah": anchor[first].view(np.int64), "sh": segment.view(np.int64)}))
            if out:
                yield pd.concat(out).drop_duplicates()

    rows = saved(keyed.where(F.octet_length("text") > 2 * min_words).select("dk", "text").mapInPandas(ask, "dk long, ah long, sh long"))
    most = rows.count()
    rows = gathered(rows.join(_several(rows, "ah"), "ah", "left_semi"), most)
    told = gathered(rows.join(_several(rows, "ah", "sh"), ["ah", "sh"], "left_semi").select("dk").distinct(), most)
    unsure = gathered(rows.join(told, "dk", "left_anti").select("ah").distinct(), most)
    reps = rows.join(sized(unsure), "ah", "left_semi").groupBy("ah", "sh").agg(F.min("dk").alias("asked_dk"))
    return told, gathered(reps.groupBy("asked_dk").agg(F.collect_set("ah").alias("anchors")), most)


def _several(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.min("dk").alias("x"), F.max("dk").alias("y")).where("x <> y").select(*by)


def _passages(told: DataFrame, windows: DataFrame) -> DataFrame:
    return told.union(windows.join(_several(windows, "w"), "w", "left_semi").select("dk")).distinct().withColumnRenamed("dk", "passage_dk")


def repeated_passages(keyed: DataFrame, min_words: int = PASSAGE) -> DataFrame:
    """passage_dk: the rows that share a run of min_words + 1 words with a row of another id or text, whatever its length in bytes and the white space between.

    Equal runs have equal anchors. Runs are compared one by one only for anchors of rows that share no whole segment. Hashes have 64 bits.
    """
    told, anchored = shared_segments(keyed, min_words)
    none = keyed.sparkSession.createDataFrame([], "asked_dk long, cuts array<struct<ah:long,sh:long,n:long,a:long,lo:long,hi:long>>")
    return _passages(told, _answers(keyed, none, anchored, LENGTH, min_words).where("w is not null").select("dk", "w"))


def _cut(documents: DataFrame, length: int, k: int = K, **settings) -> DataFrame:
    keyed = documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("dk"))
    rows, segments, cuts = repeated_segments(keyed, length, k)
    told, anchored = shared_segments(keyed)
    answers = _answers(keyed, cuts, anchored, length, PASSAGE)
    bodies, windows = answers.where("w is null").drop("dk", "w"), answers.where("w is not null").select("dk", "w")
    lists = removed_spans(rows, segments, bodies, length, k, **settings).groupBy(F.col("dk").alias("span_dk")).agg(F.array_sort(F.collect_set("span")).alias("spans"))
    found = keyed.join(lists, F.col("dk") == F.col("span_dk"), "left").join(_passages(told, windows), F.col("dk") == F.col("passage_dk"), "left")
    return found.select("doc_id", "text", "spans", F.col("passage_dk").isNotNull().alias("passage"))


def merged(starts: np.ndarray | None, ends: np.ndarray | None) -> list[tuple[int, int]]:
    """Maximal runs of sorted spans; runs that touch are one."""
    out: list[list[int]] = []
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True) if starts is not None else ():
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def suffix_dedup(documents: DataFrame, length: int = LENGTH, **settings) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, the spans as arrays, whether it repeats a passage, and the kept bytes.

    repeats: bytes are removed, or a run of more than PASSAGE words stands in another document too (which may be shorter than ``length`` bytes and then stays).
    """

    def framed(out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends", "repeats", "kept"])
        frame["doc_id"] = frame.doc_id.astype("Int64")
        return frame

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, size = [], 0
            for doc_id, text, starts, ends, passage in zip(b.doc_id, b.text, b.starts, b.ends, b.passage, strict=True):
                if size > _PART:
                    yield framed(out)
                    out, size = [], 0
                raw, runs, at, kept = (text or "").encode(), merged(starts, ends), 0, []
                size += len(raw)
                for s, e in runs:
                    kept.append(raw[at:s])
                    at = e
                kept = b"".join([*kept, raw[at:]])
                out.append((doc_id, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), [s for s, _ in runs], [e for _, e in runs], bool(runs or passage), kept))
            yield framed(out)

    found = _cut(documents, length, **settings).select("doc_id", "text", F.col("spans.s").alias("starts"), F.col("spans.e").alias("ends"), "passage")
    return found.mapInPandas(run, "doc_id bigint, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>, repeats boolean, kept binary")
