"""N-gram Jaccard join with parity sketches.

Each document is the set of its distinct word shingles. Two sets of n <= m shingles have a Jaccard
similarity of T or more exactly when their symmetric difference is at most (1 - T) / (1 + T) * (n + m).
Sizes fall into bands, each 1 / T wide, so partners lie in the smaller one's band or the next. Per band the
shingles are XOR-hashed into a bit sketch of more blocks than that bound: a shingle flips one bit of one
block, so two sketches differ in at most as many blocks as the sets differ in shingles, and a linked pair
agrees in some block that is not empty. (A document with too few such blocks emits its empty ones as well;
a pair in which neither has enough then agrees in an empty one.) Equal blocks are joined, pairs verified on the sets.

Hot blocks, in which more than COLD different sets agree, yield no pairs but a star around one member. A
document with enough other blocks meets all its partners there; the rest ("unsafe") meet in the rarest of
their blocks, as many as a linked pair must share one of, and compare whole sketches there with members of
other components only. One or two pairs for each class are verified first: they join most groups, and of the
other pairs only those between groups that are still apart are verified, so a group costs rows in proportion.

Equal sets form one class from the start; a class is named by a 64-bit hash of its set.

Edge cases: null, empty or wordless text has no shingles and links with nothing (it is its own component); a
text shorter than a shingle is one shingle; components take the smallest id that is not null; repeated rows
are linked; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import gathered, saved, sized, wrapped

WORDS = 5
NUM, DEN = 3, 4  # the similarity, 0.75
COLD = 24
BUCKET_KEYS = 1_000_000
SUB = 1500
SKETCH_LONGS = 32
CHUNK = 1024
FIRST, NO_KEY = 16, 2**63 - 1
SET_ITEMS, CELL_ROWS = 200_000, 10_000  # of a file: shingles of sets, rows with whole sketches
_M = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer, vectorized."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingle sets as sorted 64-bit hashes; word hashes are kept between texts."""

    def __init__(self, width: int = WORDS):
        self.width, self.words = width, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words, known = (text or "").encode().lower().split(), self.words
        if len(known) > 200_000:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        h = np.array(out, dtype=np.uint64)
        size = min(self.width, len(h))
        if not size:
            return h
        acc = np.full(len(h) - size + 1, size, dtype=np.uint64)
        for k in range(size):
            acc = acc * _M + h[k : len(h) - size + 1 + k]
        return np.unique(mix(acc))


def class_of(s: np.ndarray) -> int | None:
    """The set's 64-bit name, as a signed long."""
    return int(mix(np.array([np.bitwise_xor.reduce(mix(s, 1)) + np.uint64(len(s))], dtype=np.uint64), 2).view(np.int64)[0]) if len(s) else None


def bands(top: int) -> np.ndarray:
    """Lower bounds of the bands up to the one above top: a partner of a member is in its band or the next."""
    out = [1]
    while out[-1] <= top:
        out.append(out[-1] * DEN // NUM + 1)
    return np.array([*out, out[-1] * DEN // NUM + 1], dtype=np.int64)


def bound(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The largest symmetric difference of linked sets of these sizes."""
    return (n + m) * (DEN - NUM) // (DEN + NUM)


def blocks_of(upper: np.ndarray) -> np.ndarray:
    """Blocks of a band's sketch, more than any linked pair whose smaller size is below upper can differ in."""
    most = bound(upper - 1, (upper - 1) * DEN // NUM)
    return most + most // 4 + 8


def block_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """owner, key and step (0: own band, 1: the band below) of each emitted block; then by step and owner how many filled blocks there are beyond the bound."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    edges = bands(int(sizes.max(initial=1)))
    flat, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    own = np.searchsorted(edges, sizes, side="right") - 1
    owners, keys, steps, spare = [], [], [], []
    for step in (0, 1):  # as the smaller of a pair, and as the larger one of a pair in the band below
        band = own - step
        live = band >= 0
        band = np.maximum(band, 0)
        upper = edges[band + 1]
        count = blocks_of(upper)
        partner = sizes * DEN // NUM if step == 0 else np.minimum(sizes, upper - 1)
        limit = bound(sizes, partner)
        take = live[doc]
        d, h = doc[take], flat[take]
        b = (mix(h, 3) % count[d].astype(np.uint64)).astype(np.int64)
        slot = (d << 32) | b
        order = np.argsort(slot, kind="stable")
        slot, bits = slot[order], mix(mix(h[order], 4) & np.uint64(0xFFFFFFFF), 5)
        starts = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1]))) if len(slot) else np.zeros(0, dtype=np.int64)
        parity = np.bitwise_xor.reduceat(bits, starts) if len(starts) else np.zeros(0, dtype=np.uint64)
        at, block = slot[starts] >> 32, slot[starts] & 0xFFFFFFFF
        filled = np.bincount(at, minlength=len(sets))
        poor = np.flatnonzero(live & (filled <= limit))
        for x in poor:
            gone = np.setdiff1d(np.arange(count[x]), block[at == x])
            at, block, parity = np.concatenate((at, np.full(len(gone), x))), np.concatenate((block, gone)), np.concatenate((parity, np.zeros(len(gone), dtype=np.uint64)))
        owners.append(at)
        steps.append(np.full(len(at), step, dtype=np.uint16))
        spare.append(np.clip(filled - limit, -32768, 32767).astype(np.int16))
        keys.append(mix(parity ^ mix((block.astype(np.uint64) << np.uint64(16)) | band[at].astype(np.uint64), 6), 7))
    return np.concatenate(owners), np.concatenate(keys), np.concatenate(steps), np.stack(spare, axis=1)


def sketch(s: np.ndarray) -> np.ndarray:
    """The dense parity sketch of a set, as longs."""
    bit = (mix(s, 8) % np.uint64(64 * SKETCH_LONGS)).astype(np.int64)
    flips = np.bincount(bit, minlength=64 * SKETCH_LONGS) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def _sets(documents: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Shingler()
        for b in batches:
            sets = [own(x) for x in b.text]
            yield pd.DataFrame({"doc_id": b.doc_id, "dk": b.dk, "sig": pd.array([class_of(s) for s in sets], dtype="Int64"), "n": [len(s) for s in sets]})

    return documents.mapInPandas(run, "doc_id bigint, dk bigint, sig bigint, n long")


def _candidates(documents: DataFrame, buckets: int) -> DataFrame:
    """Rows: a pair (a, b) of classes that agree in some blocks (times) of a bucket, or a class in its hot blocks (b null)."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Shingler()
        for whole in batches:
            for lo in range(0, len(whole), SUB):
                found = {class_of(s): s for s in (own(x) for x in whole.text.iloc[lo : lo + SUB]) if len(s)}
                if not found:
                    continue
                sigs, sets = np.array(list(found), dtype=np.int64), list(found.values())
                sizes = np.array([len(s) for s in sets], dtype=np.int32)
                owner, key, low, spare = block_keys(sets)
                bucket = (key % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                owner, key, low, bucket = owner[order].astype(np.uint16), (key[order] >> np.uint64(32)).astype(np.uint32), low[order], bucket[order]
                starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
                out = []
                for s, e in zip(starts, [*starts[1:], len(bucket)], strict=True):
                    used, at = np.unique(owner[s:e], return_inverse=True)
                    out.append((int(bucket[s]), sigs[used].tobytes(), sizes[used].tobytes(), spare[used].tobytes(), (at.astype(np.uint16) | (low[s:e] << 15)).tobytes(), key[s:e].tobytes()))
                yield pd.DataFrame(out, columns=["bucket", "sigs", "sizes", "spare", "at", "keys"])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        sig, size, low, key, spare = [], [], [], [], []
        for row in group.itertuples(index=False):
            at = np.frombuffer(row.at, dtype=np.uint16)
            low.append((at >> 15).astype(np.int64))
            at = at & np.uint16(0x7FFF)
            spare.append(np.frombuffer(row.spare, dtype=np.int16).reshape(-1, 2)[at, low[-1]])
            sig.append(np.frombuffer(row.sigs, dtype=np.int64)[at])
            size.append(np.frombuffer(row.sizes, dtype=np.int32)[at])
            key.append(np.frombuffer(row.keys, dtype=np.uint32))
        sig, size, low, key, spare = map(np.concatenate, (sig, size, low, key, spare))
        order = np.lexsort((sig, key))
        sig, size, low, key, spare = sig[order], size[order], low[order], key[order], spare[order]
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])))  # copies of a set count once
        sig, size, low, key, spare = sig[fresh], size[fresh].astype(np.int64), low[fresh], key[fresh], spare[fresh].astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        length = np.diff(np.concatenate((starts, [len(key)])))
        left, right = [], []
        many = length >= 2
        for g in range(1, COLD):  # the pairs at distance g within each cold group
            first = starts[many & (length > g) & (length <= COLD)]
            span = length[many & (length > g) & (length <= COLD)] - g
            at = np.repeat(first, span) + np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
            left.append(at)
            right.append(at + g)
        hot = length > COLD
        at = np.flatnonzero(np.repeat(hot, length))
        lead = np.repeat(starts[hot] + key[starts[hot]] % length[hot], length[hot])  # another member for each key
        cold = len(np.concatenate(left))
        left.append(lead[lead != at])
        right.append(at[lead != at])
        left, right = map(np.concatenate, (left, right))
        small, large = np.minimum(size[left], size[right]), np.maximum(size[left], size[right])
        ok = small * DEN >= large * NUM
        left, right, near = left[ok], right[ok], (np.arange(len(ok)) < cold)[ok]
        turn = sig[left] > sig[right]
        left, right = np.where(turn, right, left), np.where(turn, left, right)
        pairs = pd.DataFrame({"a": sig[left], "b": sig[right], "cold": near, "low": low[left], "low_b": low[right], "spare": spare[left], "spare_b": spare[right]})
        pairs = pairs.groupby(["a", "b", "cold", "low", "low_b", "spare", "spare_b"], as_index=False).size().rename(columns={"size": "times"})
        pairs["n"], pairs["hot"] = 0, 0
        warm = pd.DataFrame({"a": sig[at], "n": size[at], "low": low[at], "spare": spare[at]}).groupby(["a", "n", "low", "spare"], as_index=False).size().rename(columns={"size": "hot"})
        warm["b"], warm["cold"] = pd.array([None] * len(warm), dtype="Int64"), False
        warm["low_b"], warm["spare_b"], warm["times"] = 0, 0, 0
        columns = ["a", "b", "cold", "n", "low", "low_b", "spare", "spare_b", "times", "hot"]
        return pd.concat([pairs.astype({"b": "Int64"})[columns], warm[columns]])

    blobs = documents.select("text").mapInPandas(emit, "bucket int, sigs binary, sizes binary, spare binary, at binary, keys binary")
    return blobs.groupBy("bucket").applyInPandas(join, "a bigint, b bigint, cold boolean, n long, low long, low_b long, spare long, spare_b long, times long, hot long")


def components(edges: DataFrame) -> DataFrame:
    """node and the smallest node it reaches, by label propagation with pointer jumping; lineage is cut in every round."""
    most = 2 * edges.count()
    both = gathered(edges.select("a", "b").union(edges.select("b", "a")).distinct(), most)
    labels = gathered(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), most)
    while True:
        labels = sized(labels)  # small graphs need one exchange a round
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = labels.join(near, "node").join(jump, "label").select("node", F.col("label").alias("old"), F.least("label", "near", "further").alias("label"))
        step = gathered(step, most)
        if step.where("old <> label").limit(1).count() == 0:
            return step.select("node", "label")
        labels = step.select("node", "label")


_LINKED = f"{DEN} * size(array_intersect(sa, sb)) >= {NUM} * (size(sa) + size(sb) - size(array_intersect(sa, sb)))"


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    with_a = pairs.join(sets.select(F.col("sig").alias("a"), F.col("items").alias("sa")), "a")
    return with_a.join(sets.select(F.col("sig").alias("b"), F.col("items").alias("sb")), "b").where(F.expr(_LINKED)).select("a", "b")


def _across(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs whose ends are not known to be connected."""
    label = sized(label)
    for side in ("a", "b"):
        pairs = pairs.join(label.select(F.col("node").alias(side), F.col("label").alias(f"l{side}")), side, "left")
    return pairs.where("coalesce(la, a) <> coalesce(lb, b)").drop("la", "lb")


def _picked(pairs: DataFrame, spread: int = 1) -> DataFrame:
    """For each class of the pairs its partner with most agreements and its smallest one, in each of ``spread`` parts of its partners."""
    both = pairs.select("a", "b", "times").union(pairs.select("b", "a", "times"))
    best = both.groupBy("a", F.pmod(F.xxhash64("b"), F.lit(spread)).alias("part")).agg(F.array_distinct(F.array(F.max_by("b", F.struct("times", "b")), F.min("b"))).alias("partners")).select("a", F.explode("partners").alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _joined(pairs: DataFrame, edges: DataFrame, label: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges and labels with the links of pairs between different components: one or two pairs for each class join most groups, then what is left between groups is verified."""
    for chosen in (_picked, lambda left: left.select("a", "b")):
        most = pairs.count()
        if most == 0:
            break
        more = gathered(_verified(chosen(pairs), sets), most)
        if more.limit(1).count():
            edges = gathered(edges.union(more), edges.count() + most)
            label = components(edges)
            if chosen is _picked:
                pairs = gathered(_across(pairs, label), most)
    return edges, label


def _unsafe(warm: DataFrame) -> DataFrame:
    """Classes with too few cold blocks to be sure of meeting every partner there: sig, band, n."""
    short = warm.groupBy(F.col("a").alias("sig"), "n", "low", "spare").agg(F.sum("hot").alias("hot")).where("hot >= spare")
    edges = [int(x) for x in bands(2**40)]  # about a hundred bounds
    own = F.size(F.filter(F.array(*map(F.lit, edges)), lambda x: x <= F.col("n")))
    return short.select("sig", (own - 1 - F.col("low")).cast("int").alias("band"), "n")


def linked_components(documents: DataFrame) -> DataFrame:
    """doc_id, dk, n_shingles, component_id and label of every row; label names the component whatever its ids, and is null without shingles."""
    keyed = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("dk"), "text")
    rows = saved(_sets(keyed))
    classes = rows.where("sig is not null").groupBy("sig").agg(F.min(F.struct("doc_id", "dk")).alias("rep"), F.min("doc_id").alias("least"))
    every, total = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = saved(_candidates(keyed, max(64, -(-total // BUCKET_KEYS))))
    most = found.count()
    unsafe = gathered(_unsafe(found.where("b is null")), most)
    # Hot blocks offer their unsafe members one partner each; safe members meet their partners in cold blocks.
    weak = sized(gathered(unsafe.select("sig").distinct(), most))
    hot = found.where("b is not null and not cold").groupBy("a", "b").agg(F.sum("times").alias("times"))
    hot = hot.join(weak.withColumnRenamed("sig", "a"), "a", "left_semi").join(weak.withColumnRenamed("sig", "b"), "b", "left_semi")
    # A linked pair agrees in all filled blocks of either end but as many as the bound: fewer cold agreements rule it out.
    warm = gathered(found.where("b is null").groupBy(F.col("a").alias("sig"), "low").agg(F.sum("hot").alias("hot")), most)
    met = found.where("cold").groupBy("a", "b", "low", "low_b", "spare", "spare_b").agg(F.sum("times").alias("times"))
    hot_a, hot_b = warm.select(F.col("sig").alias("a"), "low", F.col("hot").alias("hot_a")), warm.select(F.col("sig").alias("b"), F.col("low").alias("low_b"), F.col("hot").alias("hot_b"))
    met = met.join(hot_a, ["a", "low"], "left").join(hot_b, ["b", "low_b"], "left")
    met = met.where("times >= greatest(spare - coalesce(hot_a, 0), spare_b - coalesce(hot_b, 0))")
    pairs = gathered(met.groupBy("a", "b").agg(F.max("times").alias("times")), most)
    first = gathered(_picked(pairs).union(_picked(hot, 4)).distinct(), most)

    # The sets of all classes in a pair, and of the unsafe ones, which also get whole sketches.
    names = pairs.select("a", "b").union(first).select(F.explode(F.array("a", "b")).alias("sig")).union(unsafe.select("sig")).distinct()
    reps = gathered(names.join(classes, "sig").select(F.col("rep.doc_id").alias("rep_id"), F.col("rep.dk").alias("rep_dk")), every)
    texts = keyed.join(sized(reps), F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("dk") == F.col("rep_dk")), "left_semi").dropDuplicates(["doc_id", "dk"])

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Shingler()
        for b in batches:
            sets = [own(x) for x in b.text]
            yield pd.DataFrame({"sig": [class_of(s) for s in sets], "items": [s.view(np.int64) for s in sets], "bits": [sketch(s) for s in sets]})

    sets = gathered(texts.select("text").mapInPandas(sets_of, "sig bigint, items array<long>, bits array<long>"), total, SET_ITEMS)
    edges = gathered(_verified(first, sets), first.count())
    label = components(edges)
    edges, label = _joined(gathered(_across(pairs, label), most), edges, label, sets)
    tagged = gathered(unsafe.join(label.select(F.col("node").alias("sig"), "label"), "sig", "left").withColumn("label", F.coalesce("label", "sig")), most)
    edges, label = _joined(_unsafe_pairs(tagged, sets), edges, label, sets)

    least = classes.select(F.col("sig").alias("node"), "least").join(label, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    named = least.groupBy("label").agg(F.min("least").alias("component_id"))
    member = least.where("node <> label").select("node", "label").join(named, "label").select(F.col("node").alias("sig"), "component_id", F.col("label").alias("main"))
    member = gathered(member, every)
    # Most classes are alone: only those in a component of several need the join to find another class's id.
    alone = classes.select("sig", "least").join(named.withColumnRenamed("label", "sig"), "sig", "left").join(member.withColumnRenamed("component_id", "other"), "sig", "left").select("sig", F.coalesce("main", "sig").alias("label"), F.coalesce("other", "component_id", "least").alias("component_id"))
    return rows.join(alone, "sig", "left").select("doc_id", "dk", F.col("n").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "label")


def _meetings(keys: DataFrame) -> DataFrame:
    """The rows of keys that classes of different components share, with how many share them (members) and the component that has most of those (main); one exchange, no join."""
    by_key = Window.partitionBy("key")
    own = keys.withColumn("own", F.count("*").over(Window.partitionBy("key", "label")))
    found = own.withColumns({"members": F.count("*").over(by_key), "main": F.max_by("label", F.struct("own", "label")).over(by_key), "least": F.min("label").over(by_key), "most": F.max("label").over(by_key)})
    return found.where("least <> most").drop("own", "least", "most")


def _rarest(shared: DataFrame) -> DataFrame:
    """Each class's shared keys among the ``take`` first of all it emits; first come those that it shares with no other component, then the rarest."""
    one = Window.partitionBy("sig", "step")
    found = shared.withColumns({"shared": F.count("*").over(one), "place": F.row_number().over(one.orderBy("members", "key"))})
    return found.where("emitted - shared + place <= take")


def _unsafe_pairs(tagged: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of unsafe classes of different components whose sketches differ in no more bits than the bound; times is less the more they differ.

    A linked pair agrees in all filled blocks of either end but as many as the bound, so in one of the bound + 1 rarest
    of either (a class with too few filled blocks takes all it emits). Any order of blocks that all classes share will do:
    blocks of one component come first, since no pair meets there, and a class with more of those than the bound meets
    nobody. Classes meet in the blocks that are left; in each, the members
    outside its largest component are compared with all of other components, in chunks where it is large. A pair that meets in
    many blocks is told by the one with the least key: each member carries the FIRST least keys of its blocks, and the least key
    that is in both lists is the least one they share; only a pair without one in both lists is told by every block.
    """

    def rarest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for lo in range(0, len(whole), SUB):
                b = whole.iloc[lo : lo + SUB]
                owner, key, step, spare = block_keys([np.asarray(x, dtype=np.int64).view(np.uint64) for x in b["items"]])
                emitted = np.bincount(owner * 2 + step, minlength=2 * len(b)).reshape(-1, 2)
                take = np.where(spare > 0, emitted - spare + 1, emitted)
                yield pd.DataFrame({"sig": b.sig.to_numpy()[owner], "label": b.label.to_numpy()[owner], "n": b.n.to_numpy()[owner], "key": key.view(np.int64), "step": step.astype(np.int32), "emitted": emitted[owner, step].astype(np.int64), "take": take[owner, step].astype(np.int64)})

    members = tagged.groupBy("sig").agg(F.first("label").alias("label"), F.first("n").alias("n")).join(sets.select("sig", "items"), "sig")
    keys = saved(members.select("sig", "label", "n", "items").mapInPandas(rarest, "sig bigint, label bigint, n long, key bigint, step int, emitted long, take long"))
    most = keys.count()
    kept = gathered(_meetings(gathered(_rarest(_meetings(keys)).select("key", "sig", "label", "n"), most)), most)
    most = kept.count()
    buckets = most // (2 * CHUNK) + 1
    order = F.row_number().over(Window.partitionBy("sig").orderBy("key"))
    firsts = kept.select("sig", "key").distinct().withColumn("at", order).where(F.col("at") <= FIRST).groupBy("sig").agg(F.collect_list("key").alias("firsts"))
    bits, chunks, cols = sets.select("sig", "bits").join(firsts, "sig"), F.ceil(F.col("members") / CHUNK), ["cell", "q", "r", "key", "sig", "n", "label", "bits", "firsts"]
    cell = F.when(F.col("members") <= CHUNK, F.pmod("key", F.lit(buckets))).otherwise(F.col("key"))  # small groups share a cell, a large one has a cell for each pair of chunks
    kept = kept.join(bits, "sig").select("*", cell.alias("cell"), F.pmod(F.xxhash64("sig"), chunks).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("other"))
    left = kept.where("label <> main").select(F.col("own").alias("q"), F.col("other").alias("r"), "*")
    right = kept.select(F.col("other").alias("q"), F.col("own").alias("r"), "*")

    none = pd.DataFrame({"a": [], "b": [], "times": []})

    def listed(firsts: pd.Series) -> np.ndarray:
        out = np.full((len(firsts), FIRST), NO_KEY)
        for i, x in enumerate(firsts):
            out[i, : len(x)] = x
        return out

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return none
        y = y.sort_values("key", kind="stable")
        p, q = np.stack(x.bits).astype(np.int64).view(np.uint64), np.stack(y.bits).astype(np.int64).view(np.uint64)
        own, others = listed(x.firsts), listed(y.firsts)
        m, ys, yl, yk = y.n.to_numpy(), y.sig.to_numpy(), y.label.to_numpy(), y.key.to_numpy()
        starts, ends = np.searchsorted(yk, x.key, side="left"), np.searchsorted(yk, x.key, side="right")
        a, b, times = [], [], []
        for i, (sig, n, label, key, s, e) in enumerate(zip(x.sig, x.n, x.label, x.key, starts, ends, strict=True)):
            ok = np.flatnonzero((yl[s:e] != label) & (np.minimum(n, m[s:e]) * DEN >= np.maximum(n, m[s:e]) * NUM)) + s
            apart = np.bitwise_count(p[i] ^ q[ok]).sum(axis=1).astype(np.int64)
            near = np.flatnonzero(apart <= bound(n, m[ok]))
            shared = np.where(np.isin(others[ok[near]], own[i]), others[ok[near]], NO_KEY).min(axis=1, initial=NO_KEY)
            near = near[(shared == NO_KEY) | (shared == key)]
            a += [sig] * len(near)
            b += ys[ok[near]].tolist()
            times += (-apart[near]).tolist()
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "times": times}).drop_duplicates() if a else none

    by = ["cell", "q", "r"]
    left, right = gathered(left.select(*cols), most, CELL_ROWS), gathered(right.select(*cols), most, CELL_ROWS)
    return gathered(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(compare, "a bigint, b bigint, times long").distinct(), most)


def ngram_join(documents: DataFrame) -> DataFrame:
    return linked_components(documents).drop("dk", "label")


def drop_near_duplicates(documents: DataFrame) -> DataFrame:
    """One row of each component, the one with the smallest id (null ids last, then the least key; any one of rows alike in id and text), and every row without shingles."""
    found = linked_components(documents.select("doc_id", "text")).where("label is not null")
    rows = found.groupBy("label", "doc_id", "dk").agg(F.count("*").alias("copies"))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "dk", "copies")
    keep = gathered(rows.groupBy("label").agg(F.min(first).alias("k")).select(F.col("k.doc_id").alias("keep_id"), F.col("k.dk").alias("keep_dk"), F.col("k.copies").alias("copies")), documents.count())
    every = wrapped(documents)
    has_word = F.coalesce(F.col("row_.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    same = F.col("id_").eqNullSafe(F.col("keep_id")) & (F.col("dk_") == F.col("keep_dk"))
    kept = every.where(has_word).join(keep.where("copies = 1"), same, "left_semi").select("row_").union(every.where(~has_word).select("row_"))
    copied = keep.where("copies > 1")
    if copied.limit(1).count():
        kept = kept.union(every.where(has_word).join(sized(copied), same, "left_semi").dropDuplicates(["id_", "dk_"]).select("row_"))
    return kept.select("row_.*")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT rid, doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, doc_id, count(*) AS n FROM s GROUP BY rid, doc_id),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY a.rid, b.rid),
e AS (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(a, b) AS (SELECT rid, rid FROM d UNION SELECT reach.a, u.b FROM reach JOIN u ON reach.b = u.a),
m AS (SELECT reach.a AS rid, min(t.doc_id) AS component_id FROM reach JOIN d t ON t.rid = reach.b GROUP BY reach.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM d LEFT JOIN n ON n.rid = d.rid LEFT JOIN m ON m.rid = d.rid
"""
