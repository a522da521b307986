"""Most similar vectors for every vector (problem 1): cross-polytope hashing.

A unit vector is put through pseudo-rotations (random signs, then a fast
Hadamard transform, three times) and hashed to the nearest signed axis.  Each of
several tables joins a few such hashes into a bucket.  A vector lies in one
bucket of a table and is also looked up in the buckets of its next best axes
(multiprobe).  Candidates that share a bucket are compared there, in the end in
double, so that ids and similarities alone leave the bucket: the best of each
vector, which are reranked over all buckets.

Copies of one vector are one class: only its smallest ids, k + 1 of them, can be
among anybody's k most similar when ties go to the smaller id, so the others
enter as members of the class and not as further candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.common import Scratch

#: Vectors that are compared at once within a bucket.
BLOCK = 2048
#: Vectors that own one bucket, or ask in it, beyond which it is cut into tiles.
BUCKET_ROWS = 20_000
#: Vectors in a bucket, where they are spread evenly, beyond which one more hash is joined to it.
FILL = 1000
#: Buckets that are cut into tiles, up to which their list is broadcast (24 bytes each).
BROADCAST_ROWS = 1_000_000


def usable(rows: DataFrame, id_col: str, vector: str, dim: int) -> DataFrame:
    """id, v of each row with a vector of `dim` finite values that is not all zero.

    Null, empty, short, long and zero vectors and null ids are left out.
    Repeated rows count once; if the vectors of an id differ, the first in array
    order counts.
    """
    v = F.col(vector)
    fine = F.col(id_col).isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e30)) & F.exists(v, lambda x: x != 0)
    return rows.where(fine).groupBy(F.col(id_col).alias("id")).agg(F.min(v).alias("v"))


def hashes_per_bucket(n: int, dim: int, fill: int = FILL) -> int:
    """Hashes joined to a bucket, so that n spread vectors make buckets of at most about `fill`."""
    return max(1, math.ceil(math.log(max(n, 2) / fill) / math.log(2 * dim)))


def tables_needed(hashes: int, dim: int, least: float, probes: int, miss: float = 1e-3, pairs: int = 8000) -> int:
    """Tables with which a pair of similarity `least` shares no probed bucket in only `miss` of all cases.

    How often one table brings such pairs together is drawn from random ones, in
    their own buckets and in the probed ones of either.
    """
    rng = np.random.default_rng(29)
    a, b = _unit(rng.normal(size=(pairs, dim))), rng.normal(size=(pairs, dim))
    c = min(max(least, 0.0), 1.0)
    b = c * a + math.sqrt(1 - c * c) * _unit(b - (a * b).sum(1, keepdims=True) * a)
    hit = 0
    groups = np.array_split(np.arange(pairs), 4)
    for own, flips in zip(groups, signs(len(groups), hashes, dim, 31)):
        x, y = (buckets(z[own].astype(np.float32), flips, probes) for z in (a, b))
        hit += int(((x == y[:, :1]) | (y == x[:, :1])).any(axis=1).sum())
    return max(1, math.ceil(math.log(miss) / math.log1p(-min(max(hit, 1) / pairs, 1 - miss))))


def signs(tables: int, hashes: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (tables, hashes, 3, dim))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform along the last axis, a power of two, scaled to keep lengths."""
    d = x.shape[-1]
    h = 1
    while h < d:
        y = x.reshape(*x.shape[:-1], d // (2 * h), 2, h)
        x = np.stack((y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]), axis=-2).reshape(*x.shape[:-1], d)
        h *= 2
    return x / math.sqrt(d)


def axes(x: np.ndarray, flips: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """For one hash: the `probes` nearest signed axes of each row, and how much farther each is than the nearest."""
    for f in flips:
        x = hadamard(x * f)
    size = np.abs(x)
    order = np.argpartition(-size, probes - 1, axis=1)[:, :probes]
    value = np.take_along_axis(size, order, 1)
    by = np.argsort(-value, axis=1)
    order, value = np.take_along_axis(order, by, 1), np.take_along_axis(value, by, 1)
    sign = np.take_along_axis(x, order, 1) < 0
    return order * 2 + sign, value[:, :1] - value


def buckets(x: np.ndarray, flips: np.ndarray, probes: int) -> np.ndarray:
    """rows x probes bucket numbers in one table, the own bucket first.

    The probes are the combinations of axes whose summed distance from the best
    axes is smallest.
    """
    total, code = np.zeros((len(x), 1), np.float32), np.zeros((len(x), 1), np.int64)
    for f in flips:
        axis, cost = axes(x, f, min(probes, x.shape[1]))
        total = (total[:, :, None] + cost[:, None, :]).reshape(len(x), -1)
        code = (code[:, :, None] * (2 * x.shape[1]) + axis[:, None, :]).reshape(len(x), -1)
        keep = np.argsort(total, axis=1, kind="stable")[:, :probes]
        total, code = np.take_along_axis(total, keep, 1), np.take_along_axis(code, keep, 1)
    return code


def _padded(rows: list, dim: int) -> np.ndarray:
    x = np.stack(rows).astype(np.float32)
    x /= np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True).astype(np.float32)
    return np.pad(x, ((0, 0), (0, dim - x.shape[1])))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows in double, of length 1."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashed(flips: np.ndarray, probes: int, dtype: type):
    """Rows (bucket, id, role, v): a vector in its own bucket (role 0), and asking in its probed ones (role 1)."""
    dim = flips.shape[-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            x = _padded(list(pdf.v), dim)
            raw = np.array([np.asarray(r, dtype).tobytes() for r in pdf.v], object)
            ids = pdf.id.to_numpy()
            for t, table in enumerate(flips):
                code = buckets(x, table, probes) * len(flips) + t
                for p in range(code.shape[1]):
                    yield pd.DataFrame({"bucket": code[:, p], "id": ids, "role": min(p, 1), "v": raw})

    return run


def _counts(flips: np.ndarray, probes: int):
    """Rows (bucket, own, asking): how many vectors of a batch own a bucket and how many ask in it, owners included."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            x = _padded(list(pdf.v), flips.shape[-1])
            for t, table in enumerate(flips):
                code = buckets(x, table, probes) * len(flips) + t
                bucket, where = np.unique(code, return_inverse=True)
                where = where.reshape(code.shape)
                own, asking = np.bincount(where[:, 0], minlength=len(bucket)), np.bincount(where.ravel(), minlength=len(bucket))
                yield pd.DataFrame({"bucket": bucket, "own": own, "asking": asking})

    return run


def _best(row: np.ndarray, ids: np.ndarray, sim: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `most` entries of each row of greatest similarity, of equal ones those of smaller id."""
    order = np.lexsort((ids, -sim, row))
    row, ids, sim = row[order], ids[order], sim[order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, np.int64)
    place = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
    return row[place < most], ids[place < most], sim[place < most]


def _block(ids, x, owner_ids, owners, least: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other id, similarity) of the best `most` owners of each row at `least` or more; owners come by id.

    A product in single precision finds the rows with any owner near; what
    counts is worked out in double.  A row with up to `most` owners near keeps
    them all.  For others the product is repeated in double and the best are
    taken, of equal ones those of smaller id.
    """
    close = (x.astype(np.float32) @ owners.astype(np.float32).T) >= least - 1e-5
    many = close.sum(axis=1) > most
    row, col = np.nonzero(close & ~many[:, None])
    sim = np.round((x[row] * owners[col]).sum(axis=1), 12)
    fine = (sim >= least) & (ids[row] != owner_ids[col])
    found = [(row[fine], owner_ids[col[fine]], sim[fine])]
    for s in range(0, int(many.sum()), BLOCK):
        mine = np.flatnonzero(many)[s : s + BLOCK]
        sim = np.round(x[mine] @ owners.T, 12)
        sim[ids[mine][:, None] == owner_ids[None, :]] = -2
        kth = np.partition(sim, -most, axis=1)[:, [-most]]
        above, equal = sim > kth, sim == kth
        keep = (above | equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= most - above.sum(axis=1, keepdims=True))) & (sim >= least)
        row, col = np.nonzero(keep)
        found.append((mine[row], owner_ids[col], sim[row, col]))
    return tuple(np.concatenate(z) for z in zip(*found))


def _near(least: float, k: int, dim: int, dtype: type):
    """Rows (a, b, similarity) of a bucket's vectors near each other; rows come sorted by bucket.

    Each vector that asks is compared with the bucket's owners in blocks; its
    best k + 4 at `least` or more go on.  Similarities count to 12 places, so
    what differs by rounding alone is a tie and goes to the smaller id.
    """
    more = k + 4

    def bucket(ids, x, role):
        own, asks = np.flatnonzero(role != 1), np.flatnonzero(role != 2)
        own = own[np.argsort(ids[own])]
        owner_ids, owners = ids[own], x[own]
        for s in range(0, len(asks), BLOCK):
            mine = asks[s : s + BLOCK]
            held = [_block(ids[mine], x[mine], owner_ids[o : o + BLOCK], owners[o : o + BLOCK], least, more) for o in range(0, len(own), BLOCK)]
            row, who, sim = _best(*[np.concatenate(z) for z in zip(*held)], more)
            a = ids[mine][row]
            yield np.minimum(a, who), np.maximum(a, who), sim

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def flush(parts):
            g = pd.concat(parts) if len(parts) > 1 else parts[0]
            x = _unit(np.frombuffer(b"".join(g.v), dtype).reshape(-1, dim))
            code, ids, role = g.bucket.to_numpy(), g.id.to_numpy(), g.role.to_numpy()
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            found = []
            for s, e in zip(starts, np.r_[starts[1:], len(code)]):
                if e - s > 1 and (role[s:e] != 1).any():
                    found += bucket(ids[s:e], x[s:e], role[s:e])
            if found:
                a, b, sim = (np.concatenate(z) for z in zip(*found))
                return pd.DataFrame({"a": a, "b": b, "similarity": sim}).drop_duplicates(["a", "b"])
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64), "similarity": np.empty(0)})

        for pdf in batches:
            if pdf.empty:
                continue
            code = pdf.bucket.to_numpy()
            last = int(np.flatnonzero(code == code[-1])[0])
            if last == 0 and held and held[-1].bucket.iloc[-1] == code[0]:
                held.append(pdf)
                continue
            head, tail = pdf.iloc[:last], pdf.iloc[last:]
            done = [*held, head] if last else held
            if done:
                yield flush(done)
            held = [tail]
        if held:
            yield flush(held)

    return run


def candidates(vectors: DataFrame, n: int, dim: int, k: int, least: float, tables: int | None = None, probes: int = 2, seed: int = 17, bucket_rows: int = BUCKET_ROWS, scratch: Scratch | None = None) -> DataFrame:
    """Distinct (a, b, similarity), a < b, of vectors (id, v) that share a probed bucket and are near `least` or above.

    Owners and askers of a bucket of more than `bucket_rows` of either are cut
    into blocks of their own, and each pair of blocks is a tile: all of the
    bucket's pairs are still compared, in tasks of bounded size.  Unless given,
    `tables` grow with the hashes of a bucket, so that recall stays.
    """
    width = 1 << max(0, dim - 1).bit_length()
    hashes = hashes_per_bucket(n, width)
    flips = signs(tables or tables_needed(hashes, width, least, probes), hashes, width, seed)
    sizes = vectors.mapInPandas(_counts(flips, probes), "bucket long, own long, asking long").groupBy("bucket").agg(F.sum("own").alias("own"), F.sum("asking").alias("asking"))
    blocks = [F.ceil(F.col(c) / bucket_rows).cast("int").alias(name) for c, name in (("own", "owns"), ("asking", "askers"))]
    large = (scratch or Scratch(vectors.sparkSession, "buckets")).cut(sizes.where(F.col("asking") > bucket_rows).select("bucket", *blocks))
    dtype = np.float32 if vectors.schema["v"].dataType.elementType.simpleString() == "float" else np.float64
    placed = vectors.mapInPandas(_hashed(flips, probes, dtype), "bucket long, id long, role int, v binary")
    hot = large.count()
    if hot:
        placed = _tiled(placed, F.broadcast(large) if hot <= BROADCAST_ROWS else large)
    placed = placed.repartition("bucket").sortWithinPartitions("bucket")
    near = placed.mapInPandas(_near(least, k, dim, dtype), "a long, b long, similarity double")
    return near.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def _tiled(placed: DataFrame, large: DataFrame) -> DataFrame:
    """The rows of large buckets in their tiles: an asker (role 1) in all tiles of its row, an owner (role 2) in all of its column."""
    block = F.xxhash64("id", F.lit(7))

    def tiles(asker, owner, role):
        return F.struct(F.xxhash64("bucket", asker.cast("int"), owner.cast("int")).alias("bucket"), F.lit(role).alias("role"))

    def upto(n):
        return F.sequence(F.lit(0), F.col(n) - 1)

    asking = F.transform(upto("owns"), lambda o: tiles(F.pmod(block, F.col("askers")), o, 1))
    owning = F.transform(upto("askers"), lambda a: tiles(a, F.pmod(block, F.col("owns")), 2))
    asking = F.when(F.col("owns") > 0, asking).otherwise(F.array().cast("array<struct<bucket:bigint,role:int>>"))
    all_of = F.when(F.col("role") == 0, F.concat(asking, owning)).otherwise(asking)
    whole = F.array(F.struct("bucket", "role"))
    where = F.when(F.col("owns").isNull(), whole).otherwise(all_of)
    return placed.join(large, "bucket", "left").select(F.explode(where).alias("t"), "id", "v").select("t.bucket", "id", "t.role", "v")


def most_similar(rows: DataFrame, id_col: str, vector: str, dim: int = 64, k: int = 5, least: float = 0.9, **how) -> DataFrame:
    """id, other, similarity, rank: up to k most similar others of each id, at `least` or more.

    Similarities are given to 12 places; equal ones: the smaller id first.  Rows
    are treated as `usable` says.  Of copies of one vector only the k + 1
    smallest ids are given as `other`, which is what the tie rule gives anyway;
    the further copies have their rows too.  An empty table gives no rows.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "vectors")
    digest = F.struct(F.xxhash64("v"), F.xxhash64(F.lit(1), "v"))
    vectors = scratch.cut(usable(rows, id_col, vector, dim).withColumn("key", digest))
    classes = scratch.cut(_classes(vectors.select("id", "key"), k))
    n = classes.count()
    reps = vectors.select("id", "v").join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    exact = scratch.cut(candidates(scratch.cut(reps), n, dim, k, least, scratch=scratch, **how))
    both = exact.unionByName(exact.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    own = classes.where(F.size("ids") > 1).select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("similarity"))
    by_class = both.unionByName(own).join(classes.select(F.col("rep").alias("b"), "ids"), "b").select("a", "similarity", F.explode("ids").alias("other"))
    best = Window.partitionBy("a").orderBy(F.desc("similarity"), "other")
    # one more than k, because the id itself may be among the members of its class
    short = by_class.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    members = vectors.select("id", "key").join(classes.select("key", "rep"), "key").select("id", F.col("rep").alias("a"))
    mine = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    out = members.join(short, "a").where(F.col("id") != F.col("other")).withColumn("rank", F.row_number().over(mine))
    return out.where(F.col("rank") <= k).select("id", "other", "similarity", "rank")


def _classes(vectors: DataFrame, k: int) -> DataFrame:
    """key, rep (smallest id) and the k + 1 smallest ids of each group of equal vectors (id, key).

    A group's ids are first cut to its smallest k + 1 within hash blocks, so the
    copies of one vector, however many, never come together.
    """
    keyed = vectors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(256)))
    w = Window.partitionBy("key", "block").orderBy("id")
    few = keyed.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)
    ids = F.sort_array(F.collect_list("id"))
    return few.groupBy("key").agg(F.slice(ids, 1, k + 1).alias("ids"), F.min("id").alias("rep"))


def mutual(best: DataFrame) -> DataFrame:
    """a, b (smaller first) that are each among the other's most similar."""
    one = best.where(F.col("id") < F.col("other")).select(F.col("id").alias("a"), F.col("other").alias("b"))
    two = best.where(F.col("id") > F.col("other")).select(F.col("other").alias("a"), F.col("id").alias("b"))
    return one.join(two, ["a", "b"], "left_semi")
