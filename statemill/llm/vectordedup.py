"""Embedding near-dedup by p-stable hashing for Euclidean distance.

Vectors are brought to length one. Each of ``tables`` hash tables puts a vector into the bucket named by ``width``-wide
quantised projections on ``projections`` Gaussian directions. Pairs that share a bucket in some table, and a label, are
checked by their exact cosine in double precision. A pair that meets in several tables counts in the first of them only;
every vector's buckets follow from the vector, so this needs no list of pairs.

Buckets travel as keys, ids and sketches of 128 signs of further projections; vectors don't. In each bucket the nodes that
have some other node within ``most_signs`` differing signs are kept, and only their vectors are fetched for the exact check.
A pair at the cosine differs in 15.3 signs on average with a spread of 3.7, so the bound lies six spreads off; an unrelated
pair differs in 64. Whether a pair passes doesn't depend on the table, so a pair that passes meets wherever it shares a bucket.

Equal vectors of a label are one node with a multiplicity, named by 128 bits of both. Buckets beyond ``block`` nodes
are cut into blocks by the name, and each pair of blocks is a group of its own: no group grows with the data, and no pair
is left out. Groups stream through the tasks in sorted order.

With the defaults a pair at cosine 0.93 (distance 0.374) shares a bucket with probability 1 - (1 - 0.80**8)**24 = 0.988,
closer pairs with more; unrelated unit vectors (distance 1.41) meet in a given table with probability 0.387**8 = 0.0005.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, components, shuffle_partitions


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.93
    tables: int = 24
    projections: int = 8
    width: float = 1.5
    block: int = 4096
    most_signs: int = 38
    seed: int = 11


_PROJECTIONS: dict = {}


def bucket_numbers(unit, s: Settings):
    """The bucket of each unit vector in each table, as a 64-bit mix of its quantised projections."""
    import numpy as np

    d = unit.shape[1]
    if (d, s) not in _PROJECTIONS:
        r = np.random.default_rng([s.seed, d])
        _PROJECTIONS[d, s] = r.standard_normal((d, s.tables * s.projections)), r.uniform(0, s.width, s.tables * s.projections), r.integers(1, 2**63, s.projections, np.uint64) | np.uint64(1)
    a, b, mix = _PROJECTIONS[d, s]
    cell = np.floor((unit @ a + b) / s.width).astype(np.int64).view(np.uint64).reshape(len(unit), s.tables, s.projections)
    out = (cell * mix).sum(axis=2, dtype=np.uint64)
    return (out ^ (out >> np.uint64(29))).view(np.int64)


def signs(unit, s: Settings):
    """128 signs of projections of each unit vector, as two 64-bit numbers."""
    import numpy as np

    d = unit.shape[1]
    if ("signs", d, s) not in _PROJECTIONS:
        _PROJECTIONS["signs", d, s] = np.random.default_rng([s.seed, d, 1]).standard_normal((d, 128))
    return np.packbits(unit @ _PROJECTIONS["signs", d, s] > 0, axis=1).view(np.int64)


def _units(blobs, dtype: str):
    """Unit vectors (double) of byte strings of one length."""
    import numpy as np

    v = np.frombuffer(b"".join(blobs), dtype).reshape(len(blobs), -1).astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _read(dtype: str):
    """(vec_id, label, v) with the vector as bytes, and 128 bits that name label and vector; both null where one is null, empty, zero, or holds null or non-finite components."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        for batch in batches:
            out, names = [], []
            for label, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = None if not v or None in v else np.array(v, dtype)
                with np.errstate(over="ignore", invalid="ignore"):
                    length = 0.0 if x is None else float(np.linalg.norm(x.astype(np.float64)))
                out.append((x + np.zeros(1, dtype)).tobytes() if 0 < length < np.inf else None)
                names.append(None if out[-1] is None else hashlib.blake2b(out[-1], digest_size=16, salt=(label or 0).to_bytes(8, "little", signed=True)).digest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary()), pa.array(names, pa.binary())], [*batch.schema.names[:-1], "vec", "name"])

    return run


def _hash(dtype: str, s: Settings):
    """(node, label, vec) to (node, key, s1, s2) for each table; a key stands for the label, the length, the table and the bucket."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                part = whole.slice(a, 1000)
                blobs = part.column(2).to_pylist()
                by_size: dict[int, list[int]] = {}
                for k, b in enumerate(blobs):
                    by_size.setdefault(len(b), []).append(k)
                for size, own in by_size.items():
                    unit = _units([blobs[k] for k in own], dtype)
                    label = part.column(1).to_numpy()[own]
                    sketch = signs(unit, s)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(own, s.tables))), pa.array(_keys(bucket_numbers(unit, s), label, size).ravel()), *(pa.array(np.repeat(sketch[:, k], s.tables)) for k in range(2))], ["node", "key", "s1", "s2"])

    return run


def _keys(buckets, label, size: int):
    """One number for each vector and table, spread by the finishing steps of a common 64-bit hash."""
    import numpy as np

    x = buckets.view(np.uint64) + np.arange(1, buckets.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for more in (label.view(np.uint64)[:, None], np.uint64(size)):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = (x ^ (x >> np.uint64(31))) + more
    return x.view(np.int64)


def _groups(batches, width: int):
    """Slices of sorted batches with equal values in the first ``width`` columns and more than one row."""
    import numpy as np
    import pyarrow as pa

    held = None
    for batch in batches:
        table = pa.Table.from_batches([*([held] if held is not None and held.num_rows else []), batch]).combine_chunks().to_batches()
        if not table:
            continue
        now = table[0]
        key = np.stack([now.column(k).to_numpy() for k in range(width)])
        cut = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if b - a > 1:
                yield now.slice(a, b - a)
        held = now.slice(int(cut[-1]))
    if held is not None and held.num_rows > 1:
        yield held


def _with_partners(s: Settings):
    """Of each sorted group (key, bi, bj, side, node, s1, s2) the rows with a sketch near that of another row (of the other block)."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        for g in _groups(batches, 3):
            one_block = g.column(1)[0].as_py() == g.column(2)[0].as_py()
            side = g.column(3).to_numpy()
            sketch = np.stack([g.column(k).to_numpy() for k in (5, 6)], axis=1).view(np.uint64)
            left, right = (np.arange(len(side)),) * 2 if one_block else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            keep = np.zeros(len(side), bool)
            for a in range(0, len(left), 512):
                i = left[a : a + 512]
                near = np.bitwise_count(sketch[i, None] ^ sketch[None, right]).sum(axis=2, dtype=np.uint16) <= s.most_signs
                if one_block:
                    near[np.arange(len(i)), i] = False
                keep[i] |= near.any(axis=1)
                keep[right] |= near.any(axis=0)
            if keep.any():
                yield g.select([0, 1, 2, 3, 4]).filter(pa.array(keep))

    return run


def _links(left, right, same: bool, t: int, s: Settings):
    """Index pairs of two blocks over the cosine that no earlier table has brought together; ``same``: one block."""
    import numpy as np

    (u, h), (v, g) = left, right
    found = []
    for a in range(0, len(u), 512):
        close = u[a : a + 512] @ v.T >= s.cosine
        i, j = np.nonzero(close)
        i += a
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        if len(i) and t:
            first = np.ones(len(i), bool)
            for e in range(t):  # table by table: a row of flags for each pair and table would be large
                first &= h[i, e] != g[j, e]
            i, j = i[first], j[first]
        found.append((i, j))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(2)) if found else (np.zeros(0, np.int64),) * 2


def _spanning(i, j, n: int):
    """For n places joined by the pairs (i, j), the least place that each can reach."""
    import numpy as np

    low = np.arange(n)
    while True:
        least = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _check_groups(dtype: str, s: Settings):
    """Rows (key, bi, bj, side, node, mult, label, vec) sorted by group: its nodes' new links, as (node, links, root)."""
    import pyarrow as pa

    def solve(key, diagonal, node, side, mult, label, blobs):
        import numpy as np

        unit = _units(blobs, dtype)
        h = _keys(bucket_numbers(unit, s), label, len(blobs[0]))
        t = int((h == key).any(axis=0).argmax())
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if diagonal:
            i, j = _links((unit, h), (unit, h), True, t, s)
        else:
            i, j = _links((unit[one], h[one]), (unit[two], h[two]), False, t, s)
            i, j = one[i], two[j]
        if not len(i):
            return None
        n = len(blobs)
        links = np.bincount(i, mult[j], n) + np.bincount(j, mult[i], n)
        at = np.flatnonzero(links)
        root = _spanning(i, j, n)[at]
        return node.take(pa.array(at)), pa.array(links[at].astype(np.int64)), node.take(pa.array(root))

    def run(batches):
        import numpy as np

        for g in _groups(batches, 3):
            col = [g.column(k) for k in range(8)]
            blobs, label = col[7].to_pylist(), col[6].to_numpy()
            kinds = list(zip(label.tolist(), map(len, blobs), strict=True))
            for kind in set(kinds):  # keys may clash; vectors of another label or length can't be compared
                at = np.array([k for k, x in enumerate(kinds) if x == kind])
                out = solve(col[0][0].as_py(), col[1][0].as_py() == col[2][0].as_py(), col[4].take(pa.array(at)), *(col[k].to_numpy()[at] for k in (3, 5, 6)), [blobs[k] for k in at])
                if out:
                    yield pa.RecordBatch.from_arrays(list(out), ["node", "links", "root"])

    return run


def near_duplicates(spark: SparkSession, vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", settings: Settings = Settings()) -> DataFrame:
    """One row for each row of ``vectors``: vec_id, n_links, component_id (all long) and kept.

    Only vectors of equal, non-null labels and equal length link. A vector that is null, empty or zero, or holds null or
    non-finite components, links with nothing, like one with a null label or id; its component is its own id. Rows that
    repeat an id count as vectors of their own; n_links counts all other linked rows. kept: the row has its component's
    id. An empty table gives an empty table.
    """
    s = settings
    scratch = Scratch(spark, "vectors")
    dtype = "<f4" if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else "<f8"
    kind = "float" if dtype == "<f4" else "double"
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(F.col(label_col).isNotNull() & F.col(id_col).isNotNull(), F.xxhash64(label_col)).alias("label"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    rows = scratch.save(raw.mapInArrow(_read(dtype), "vec_id long, label long, vec binary, name binary"))
    usable = rows.where("label IS NOT NULL AND name IS NOT NULL")
    nodes = scratch.save(usable.groupBy(F.col("name").alias("node")).agg(F.min("vec_id").alias("low"), F.count("*").alias("mult"), F.first("label").alias("label"), F.first("vec").alias("vec")))
    hashed = scratch.save(nodes.select("node", "label", "vec").mapInArrow(_hash(dtype, s), "node binary, key long, s1 long, s2 long"))
    large = hashed.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > s.block).select("key", F.ceil(F.col("size") / s.block).cast("int").alias("blocks"))
    placed = hashed.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = placed.select("key", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "node", "s1", "s2")

    def grouped(df: DataFrame) -> DataFrame:
        return df.repartition(shuffle_partitions(spark), "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")

    near = scratch.save(grouped(dealt).mapInArrow(_with_partners(s), "key long, bi int, bj int, side int, node binary"))
    fetched = near.join(nodes, "node").select("key", "bi", "bj", "side", "node", "mult", "label", "vec")
    found = scratch.save(grouped(fetched).mapInArrow(_check_groups(dtype, s), "node binary, links long, root binary"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(spark, found.select(F.col("node").alias("src"), F.col("root").alias("dst")), scratch)
    lowest = labels.join(nodes.select("node", "low"), "node").groupBy("component").agg(F.min("low").alias("lowest"))
    own = links.join(labels, "node").join(lowest, "component").select("node", "links", "lowest")
    known = nodes.select("node", "low", "mult").join(own, "node", "left").select(F.col("node").alias("name"), (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("lowest", "low").alias("component_id"))
    out = rows.withColumn("name", F.when(F.col("label").isNotNull(), F.col("name"))).select("vec_id", "name").join(known, "name", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
