"""Hard negatives by one-dimensional distance keys.

Rows get one more component, the square root of what their squared norm lacks of the largest one; queries get zero there. Then
the largest inner products are the smallest distances. Each row belongs to its nearest pivot and is stored sorted by
(pivot, distance to it); a pivot's range of distances is divided into key intervals (cells). By the triangle inequality a cell
whose keys lie further than r from the query's own distance to the pivot has no row within r of the query, so its reach is
known before it is read. A search scans the cells of least reach first and widens its annulus: once k rows are found, every cell
whose reach is at most the k-th distance is scanned, and what is left is certified to be further away. Limits on
scores bound the annulus from inside and outside. Equal scores are ordered by id, so cells at the very bound are read too.

Rows of one label and vector form a class, of which only the first few ids can ever be returned; the rest are set aside
without loss, and anchors of one class share one search. Queries go to cells, not rows to queries: a scan is a join by
cell, cells of many rows are split by ids, and many queries are split too, so no task holds more than CELL_ROWS rows and some
SIDE queries. Scores are integer inner products; pivots come from at most SAMPLE rows and change the work, never the result.

Edge cases: rows with a null id, label or vector or with a null or non-finite component take no part; of rows that share an
id the one with the smallest label and vector counts; ties go by id; a shorter vector counts as if it went on with zeros; anchors
without another row of their label, or positives without a negative, give no row; other columns are ignored, whatever their
names; an empty table gives none. Components of 2**23 and more, or squared norms of 2**62, raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

POSITIVES, NEGATIVES = 5, 3
LEAST, MOST = 50, 95  # of the positive's score, in hundredths
SCALE = 256
SAMPLE = 4096
MAX_PIVOTS, MAX_CELLS = 256, 256  # pivots, and cells of each
CELL_ROWS, SIDE = 4096, 4096
PROBE, WIDEN = 2048, 8  # rows that the first scan reads at least, and by how much the next ones grow until k are found


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, and v, the vector's components as integers; one row for each id."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(whole)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x).cast("int")).alias("v"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")


def matrix(vectors, dim: int) -> np.ndarray:
    """Vectors as rows, zeros at the end of shorter ones."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def inner(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Integer inner products of the rows of a and b; by Cauchy's inequality no partial sum exceeds the largest squared norm."""
    if largest < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0))


def k_means(points: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    centres = points[:k].copy()
    for _ in range(rounds):
        near = distances(points, centres).argmin(1)
        for c in np.unique(near):
            centres[c] = points[near == c].mean(0)
    return centres


@dataclass
class Index:
    """The stored rows (cell, salt, vec_id, label, v), and what is known of every cell: at most MAX_PIVOTS * MAX_CELLS rows."""

    rows: DataFrame
    dim: int
    largest: float  # squared norm, or a little more
    pivots: np.ndarray
    cell: np.ndarray
    pivot: np.ndarray
    low: np.ndarray  # keys of the cell
    high: np.ndarray
    count: np.ndarray

    def slack(self) -> float:
        return 1e-6 * float(np.sqrt(self.largest)) + 1e-9

    def distance(self, score: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Of a row with this inner product to a query with this squared norm."""
        return np.sqrt(np.maximum(norm + self.largest - 2 * score, 0))


def build(rows: DataFrame) -> Index | None:
    """Index of (vec_id, label, v); None if there are none."""
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    stats = rows.agg(F.count("*").alias("n"), F.max(norm).alias("most"), F.max(F.size("v")).alias("dim")).first()
    if not stats.n:
        return None
    if stats.most >= 2**62:
        raise ValueError("inner products do not fit in 64 bits")
    dim, largest = stats.dim, stats.most * (1 + 1e-9) + 1

    def lifted(vectors) -> np.ndarray:
        m = matrix(vectors, dim)
        return np.column_stack((m, np.sqrt(np.maximum(largest - (m**2).sum(1), 0))))

    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
    pivots = k_means(lifted([r.v for r in sample]), int(np.clip(round(stats.n**0.5 / 8), 1, min(MAX_PIVOTS, len(sample)))))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                d = distances(lifted(b.v), pivots)
                near = d.argmin(1)
                yield b.assign(pivot=near.astype(np.int32), key=d[np.arange(len(b)), near])

    keyed = saved(rows.select("vec_id", "label", "v").mapInPandas(assign, "vec_id long, label long, v array<int>, pivot int, key double"))
    ranges = keyed.groupBy("pivot").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.least(F.lit(MAX_CELLS), F.ceil(F.count("*") * 4 / CELL_ROWS)).alias("cells"))
    part = F.least(F.col("cells") - 1, F.floor((F.col("key") - F.col("first")) / F.greatest(F.col("last") - F.col("first"), F.lit(1e-300)) * F.col("cells")))
    placed = keyed.join(F.broadcast(ranges), "pivot").select("vec_id", "label", "v", "pivot", "key", (F.col("pivot") * MAX_CELLS + part).cast("int").alias("cell"))
    cells = saved(placed.groupBy("cell", "pivot").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("count"), F.ceil(F.count("*") / CELL_ROWS).alias("salts")).coalesce(1))
    stored = placed.join(F.broadcast(cells.select("cell", "salts")), "cell").withColumn("salt", F.pmod(F.xxhash64("vec_id"), "salts").cast("int"))
    stored = saved(stored.repartitionByRange("pivot", "key", "vec_id").sortWithinPartitions("pivot", "key", "vec_id").select("cell", "salt", "vec_id", "label", "v"))
    known = cells.orderBy("cell").toPandas()
    return Index(stored, dim, largest, pivots, *(known[c].to_numpy() for c in ("cell", "pivot", "low", "high", "count")))


def plan(index: Index, queries: np.ndarray, wants: list, bars: list, done: np.ndarray, rows: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each query the cells to scan next, and the radius within which all is scanned then. bars: the k-th score of each want so far, or None."""
    norm = (queries**2).sum(1)
    to_pivot = distances(np.column_stack((queries, np.zeros(len(queries)))), index.pivots)[:, index.pivot]
    reach = np.maximum(np.maximum(index.low - to_pivot, to_pivot - index.high), 0)
    furthest = to_pivot + index.high
    found, radius = [], np.zeros(len(queries))
    for i in range(len(queries)):
        own = lambda s: float(index.distance(float(s), norm[i]))  # noqa: B023, E731
        need, full = 0.0, True
        for want, bar in zip(wants[i], bars[i], strict=True):
            edge = float("inf") if want["least"] is None else own(want["least"])
            full &= bar is not None or edge <= done[i]
            need = max(need, edge if bar is None else min(edge, own(bar)))
        tops = [w["most"] for w in wants[i]]
        inside = -1.0 if any(t is None for t in tops) else own(max(tops)) - index.slack()
        left = (reach[i] > done[i]) & (reach[i] <= need + index.slack()) & (furthest[i] >= inside)
        if left.any() and not full:  # widen until enough rows are read
            order = np.flatnonzero(left)[np.argsort(reach[i][left], kind="stable")]
            enough = int(np.searchsorted(np.cumsum(index.count[order]), rows))
            need = min(need, float(reach[i][order[min(enough, len(order) - 1)]]))
            left &= reach[i] <= need + index.slack()
        found.append(index.cell[left])
        radius[i] = max(done[i], need + index.slack())
    return found, radius


def search(index: Index, asks: DataFrame, k: int, same: bool) -> DataFrame:
    """qid, want (its place), vec_id, score and rank: the first k rows for each want (most and least score, either may be null) of each ask
    (qid, label, v, wants), among the rows of the same label or of other ones."""
    spark = asks.sparkSession
    n = asks.count()
    sides = max(1, -(-n // SIDE))
    state_schema = "qid long, label long, v array<int>, wants array<struct<most:long,least:long>>, done double"
    state = asks.select("qid", "label", "v", "wants", F.lit(-1.0).alias("done"))
    best = spark.createDataFrame([], "qid long, want int, vec_id long, score long, rank int")
    salts = F.broadcast(index.rows.groupBy("cell").agg((F.max("salt") + 1).alias("salts")))
    rows = PROBE

    while True:

        def step(batches: Iterator[pd.DataFrame], rows: int = rows) -> Iterator[pd.DataFrame]:
            for b in batches:
                for at in range(0, len(b), 64):
                    part = b.iloc[at : at + 64]
                    bars = [[dict(x or {}).get(j) for j in range(len(w))] for w, x in zip(part.wants, part.bars, strict=True)]
                    cells, done = plan(index_, matrix(part.v.tolist(), index_.dim), part.wants.tolist(), bars, part.done.to_numpy(), rows)
                    yield part.drop(columns="bars").assign(wants=[list(w) for w in part.wants], done=done, cells=cells, bars=[[-(2**63) if x is None else x for x in row] for row in bars])

        index_ = Index(None, index.dim, index.largest, index.pivots, index.cell, index.pivot, index.low, index.high, index.count)
        bars = best.groupBy("qid", "want").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") == k).groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("want", "score"))).alias("bars"))
        planned = saved(state.join(bars, "qid", "left").mapInPandas(step, state_schema + ", cells array<int>, bars array<long>"))
        going = planned.where(F.size("cells") > 0)
        if going.isEmpty():
            return best
        asked = going.select("qid", "label", "v", "wants", "bars", F.explode("cells").alias("cell")).join(salts, "cell").select("*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.pmod(F.xxhash64("qid"), F.lit(sides)).cast("int").alias("side")).drop("salts")
        read = index.rows.join(F.broadcast(going.select(F.explode("cells").alias("cell")).distinct()), "cell", "left_semi").select("*", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))).alias("side"))
        keys = ["cell", "salt", "side"]
        hits = asked.groupBy(*keys).cogroup(read.groupBy(*keys)).applyInPandas(_scan(index.dim, index.largest, k, same), "qid long, want int, vec_id long, score long")
        first = Window.partitionBy("qid", "want").orderBy(F.desc("score"), "vec_id")
        best = saved(best.drop("rank").unionByName(hits).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k))
        state, rows = planned.drop("cells", "bars"), rows * WIDEN


def _scan(dim: int, largest: float, k: int, same: bool):
    """One cell's rows against the queries that ask for it: the first k of each want that may still count."""

    def run(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"qid": [], "want": [], "vec_id": [], "score": []}
        if len(asked) and len(rows):
            rows = rows.sort_values("vec_id", kind="stable")
            ids, labels, right = rows.vec_id.to_numpy(), rows.label.to_numpy(), matrix(rows.v.tolist(), dim)
            for at in range(0, len(asked), 256):
                part = asked.iloc[at : at + 256]
                scores = inner(matrix(part.v.tolist(), dim), right, largest)
                for s, qid, label, wants, bars in zip(scores, part.qid, part.label, part.wants, part.bars, strict=True):
                    fits = np.flatnonzero((labels == label) == same)
                    own = s[fits]
                    for j, (want, bar) in enumerate(zip(wants, bars, strict=True)):
                        ok = own >= max(bar, -(2**63) if want["least"] is None else want["least"])
                        if want["most"] is not None:
                            ok &= own <= want["most"]
                        at_ = np.flatnonzero(ok)
                        at_ = at_[np.argsort(-own[at_], kind="stable")[:k]]
                        out["qid"] += [qid] * len(at_)
                        out["want"] += [j] * len(at_)
                        out["vec_id"] += ids[fits[at_]].tolist()
                        out["score"] += own[at_].tolist()
        return pd.DataFrame({c: np.array(x, dtype=np.int32 if c == "want" else np.int64) for c, x in out.items()})

    return run


def hard_negatives(rows: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of (vec_id, label, v); is_anchor is a condition on these."""
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = saved(rows)
    of_class = Window.partitionBy("label", "v").orderBy("vec_id")
    index = build(rows.withColumn("nth", F.row_number().over(of_class)).where(F.col("nth") <= max(positives + 1, negatives)).drop("nth"))
    if index is None:
        return rows.sparkSession.createDataFrame([], schema)
    anchors = rows.where(is_anchor)
    classes = saved(anchors.groupBy("label", "v").agg(F.min("vec_id").alias("qid")))
    members = anchors.join(classes, ["label", "v"]).select(F.col("vec_id").alias("anchor_id"), "qid")
    no_limit = F.array(F.struct(F.lit(None).cast("long").alias("most"), F.lit(None).cast("long").alias("least")))
    near = search(index, classes.withColumn("wants", no_limit), positives + 1, True)
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    pairs = members.join(near.select("qid", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "qid").where("anchor_id != positive_id")
    pairs = saved(pairs.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= positives).drop("nth"))
    # a negative score has no negatives: its upper limit is below its lower one
    limits = pairs.where("positive_score >= 0").select("qid", "positive_score").distinct().select("qid", "positive_score", F.expr(f"({most} * positive_score) div 100").alias("most"), F.expr(f"({least} * positive_score + 99) div 100").alias("least")).where("least <= most")
    wants = saved(limits.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("positive_score", "most", "least"))).alias("w")))
    asks = classes.join(wants, "qid").select("qid", "label", "v", F.transform("w", lambda x: F.struct(x.most.alias("most"), x.least.alias("least"))).alias("wants"))
    far = search(index, asks, negatives, False).select("qid", "want", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    found = wants.select("qid", F.posexplode("w").alias("want", "w")).select("qid", "want", "w.positive_score").join(far, ["qid", "want"])
    return pairs.join(found, ["qid", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(embeddings: DataFrame) -> DataFrame:
    """The dealt query: labels of ids divisible by 7 are shifted, ids divisible by 50 are anchors."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(usable(embeddings.select("vec_id", shifted.alias("label"), "embedding")), F.col("vec_id") % 50 == 0)


ORACLE = """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as a, b.vec_id as b, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
  from r as a join r as b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0
), p as (
  select a, b, score from s where same qualify row_number() over (partition by a order by score desc, b) <= 5
), n as (
  select p.a, p.b, s.b as c, p.score as ps, s.score as ns, row_number() over (partition by p.a, p.b order by s.score desc, s.b) as k
  from p join s on s.a = p.a and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score
)
select a as anchor_id, b as positive_id, k::int as rank, c as negative_id, ps as positive_score, ns as negative_score from n where k <= 3
"""
