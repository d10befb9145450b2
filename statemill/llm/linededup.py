"""Line dedup over a sharded minimal perfect hash.

Lines are known by 128-bit hashes of their keys (ends stripped of white space, A-Z lower-cased). All distinct hashes are
dealt into shards; each shard gets a minimal perfect hash (levels of bit sets, as in BBHash) that numbers its entries,
and arrays in that numbering: fingerprint (the second 64 bits), document count and largest doc_id. The shards are one
table in the shared folder. Every document's line hashes then stream past the arrays of their shard, whose counts decide
which lines go: one shard's arrays and one batch of probes are in memory at a time, whatever the size of either side.

Skew: counts come from an aggregate that is combined before its shuffle. A shard's hits are known from its counts, so a
shard that holds a very common line is copied to as many salts as bring its probes back to the usual number. Nothing
but one row for each shard is ever read with another table by broadcast, and only if Spark finds that small enough.
"""

from __future__ import annotations

import io
import math

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, shuffle_partitions

#: The white space of the contract: [\x20\x09-\x0D].
BLANK = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()  # bytes.lower() touches A-Z only


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least)


def _digests(text: bytes, least: int) -> list[bytes]:
    """For each line the hash of its key, or b'' where the key is too short to matter."""
    from xxhash import xxh3_128_digest as digest

    return [digest(k) if _long_enough(k := line_key(x), least) else b"" for x in text.split(b"\n")]


def _hash_lines(least: int):
    import pyarrow as pa

    def run(batches):
        import numpy as np

        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                part = whole.slice(a, 500)
                ids, n, found = [], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    own = {d for d in _digests(text, least) if d} if text else ()
                    ids.append(doc_id)
                    n.append(len(own))
                    found += own
                h = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), n)), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], ["doc_id", "h1", "h2"])

    return run


# ---- minimal perfect hash -------------------------------------------------------------------------------------------

_LEVELS = 32


def _place(keys, level: int, size: int):
    """Where a level's bit set has each key: a 64-bit mix with the level as its seed."""
    import numpy as np

    x = keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) % np.uint64(size)


class PerfectHash:
    """Numbers distinct keys 0..n-1; other keys get -1 or some number, which the fingerprints reject."""

    def __init__(self, bits: list, rest):
        import numpy as np

        self.bits, self.rest = bits, rest
        self.rank, base = [], 0
        for b in bits:
            up = np.cumsum(b, dtype=np.int64) - b + base
            self.rank.append(up)
            base += int(b.sum())
        self.n = base + len(rest)
        self.base = base

    @classmethod
    def of(cls, keys, gamma: float = 2.0) -> PerfectHash:
        import numpy as np

        bits, left = [], keys
        while len(left) and len(bits) < _LEVELS:
            size = max(8, math.ceil(gamma * len(left) / 8) * 8)
            at = _place(left, len(bits), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            bits.append(alone)
            left = left[~alone[at]]
        return cls(bits, np.sort(left))  # what no level could part is listed

    def slots(self, keys):
        import numpy as np

        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (b, rank) in enumerate(zip(self.bits, self.rank, strict=True)):
            at = _place(keys[open_], level, len(b))
            hit = b[at]
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                return out
        if len(self.rest):
            k = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            same = self.rest[k] == keys[open_]
            out[open_[same]] = self.base + k[same]
        return out


def pack_shard(h1, h2, counts, last) -> bytes:
    """One shard: the perfect hash over h1 ^ (h2 turned), and the arrays in its numbering."""
    import numpy as np

    keys = _joined(h1, h2)
    order = np.unique(keys, return_index=True)[1]
    keys, h2, counts, last = keys[order], h2[order], counts[order], last[order]
    f = PerfectHash.of(keys)
    slot = f.slots(keys)
    fp, n, most = np.zeros(f.n, np.int64), np.zeros(f.n, np.uint32), np.zeros(f.n, np.int64)
    fp[slot], n[slot], most[slot] = h2, np.minimum(counts, 2**32 - 1), last
    out = io.BytesIO()
    np.savez(out, sizes=np.array([len(b) for b in f.bits]), bits=np.concatenate([np.packbits(b) for b in f.bits] or [np.zeros(0, np.uint8)]), rest=f.rest, fp=fp, n=n, last=most)
    return out.getvalue()


def _joined(h1, h2):
    import numpy as np

    a, b = h1.view(np.uint64), h2.view(np.uint64)
    return a ^ (b << np.uint64(23) | b >> np.uint64(41))


class Shard:
    def __init__(self, blob: bytes):
        import numpy as np

        z = np.load(io.BytesIO(blob))
        ends = np.cumsum(z["sizes"] // 8)
        bits = [np.unpackbits(x).astype(bool) for x in np.split(z["bits"], ends[:-1])] if len(ends) else []
        self.hash, self.fp, self.n, self.last = PerfectHash(bits, z["rest"]), z["fp"], z["n"], z["last"]

    def probe(self, h1, h2):
        """(found, count, largest doc_id) of each hash."""
        import numpy as np

        if not len(self.fp):
            zero = np.zeros(len(h1), np.int64)
            return zero.astype(bool), zero, zero
        slot = self.hash.slots(_joined(h1, h2))
        at = np.maximum(slot, 0)
        return (slot >= 0) & (self.fp[at] == h2), self.n[at], self.last[at]


# ---- the operator ---------------------------------------------------------------------------------------------------


def _pack(pdf):
    import pandas as pd

    blob = pack_shard(pdf.h1.to_numpy(), pdf.h2.to_numpy(), pdf.n.to_numpy(), pdf["last"].to_numpy())
    return pd.DataFrame({"shard": [pdf.shard.iloc[0]], "blob": [blob], "hits": [int(pdf.n.sum())]})


def _probe(min_docs: int):
    """Rows sorted by shard, salt, and arrays before probes; yields the lines that go."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        at, shard = None, None
        for batch in batches:
            key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            is_probe = batch.column(2).to_numpy(zero_copy_only=False)
            doc, h1, h2 = (batch.column(k).fill_null(0).to_numpy() for k in (3, 4, 5))
            cut = np.flatnonzero((np.diff(key[0], prepend=key[0][:1] - 1) != 0) | (np.diff(key[1], prepend=-1) != 0) | ~is_probe)
            for i, j in zip(cut, [*cut[1:], batch.num_rows], strict=True):
                now = int(key[0][i]), int(key[1][i])
                if not is_probe[i]:
                    at, shard = now, Shard(batch.column(6)[int(i)].as_py())
                    i += 1
                if i < j and at == now:
                    found, count, last = shard.probe(h1[i:j], h2[i:j])
                    go = found & (count >= min_docs) & (last != doc[i:j])
                    yield pa.RecordBatch.from_arrays([pa.array(x[i:j][go]) for x in (doc, h1, h2)], ["doc_id", "h1", "h2"])

    return run


def _strip_lines(schema, text_at: int, least: int):
    import pyarrow as pa

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                part = whole.slice(a, 500)
                texts, n_lines, n_dropped = [], [], []
                for text, gone in zip(part.column(text_at).cast(pa.binary()).to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True):
                    n_lines.append((text or b"").count(b"\n") + 1)
                    if not gone:
                        texts.append(text)
                        n_dropped.append(0)
                        continue
                    out = {x["h1"].to_bytes(8, "little", signed=True) + x["h2"].to_bytes(8, "little", signed=True) for x in gone}
                    lines = text.split(b"\n")
                    kept = [x for x, d in zip(lines, _digests(text, least), strict=True) if d not in out]
                    texts.append(b"\n".join(kept))
                    n_dropped.append(len(lines) - len(kept))
                cols = part.columns[:-1]
                cols[text_at] = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], schema)

    return run


def build_index(spark: SparkSession, lines: DataFrame, scratch: Scratch, *, lines_per_shard: int = 50_000) -> tuple[DataFrame, int]:
    """(table of shard, blob, hits, salts; number of shards) for rows (doc_id, h1, h2), one for each line of a document."""
    seen = Observation("lines")
    counted = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).observe(seen, F.coalesce(F.sum("n"), F.lit(0)).alias("lines"))
    held = scratch.save(counted)
    total = int(seen.get["lines"] or 0)
    shards = max(1, math.ceil(total / lines_per_shard), min(2 * shuffle_partitions(spark), math.ceil(total / 1000)))
    usual = max(1000, total / shards)
    built = held.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(_pack, "shard int, blob binary, hits long")
    index = scratch.save(built.withColumn("salts", F.ceil(F.col("hits") / usual).cast("int")))
    scratch.drop(held)
    return index, shards


def lines_to_drop(lines: DataFrame, index: DataFrame, shards: int, *, min_docs: int = 3) -> DataFrame:
    """The rows of ``lines`` that the index has ``min_docs`` times or more, and for a larger doc_id; probes stream past the arrays."""
    keyed = lines.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    salts = index.where("salts > 1").select("shard", "salts")
    probes = keyed.join(salts, "shard", "left").select("shard", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"), F.lit(True).alias("is_probe"), "doc_id", "h1", "h2", F.lit(None).cast("binary").alias("blob"))
    arrays = index.select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("is_probe"), *(F.lit(None).cast("long").alias(c) for c in ("doc_id", "h1", "h2")), "blob")
    n = shuffle_partitions(lines.sparkSession)
    return probes.unionByName(arrays).repartition(n, "shard", "salt").sortWithinPartitions("shard", "salt", "is_probe").mapInArrow(_probe(min_docs), "doc_id long, h1 long, h2 long")


def dedup_lines(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_chars: int = 20, lines_per_shard: int = 50_000) -> DataFrame:
    """``docs`` with ``text_col`` freed of repeated lines, and n_lines (before) and n_dropped (both long).

    A text is split at newlines. Keys of at least ``min_chars`` code points that at least ``min_docs`` documents hold
    lose all their lines except in the document with the largest id. Each row counts as a document: rows that repeat an
    id count each, and all rows with the largest id keep the line. Rows with a null id pass unchanged and aren't
    counted; a null text is one empty line and stays null; an empty table gives an empty table. Columns named n_lines or
    n_dropped are replaced, all others pass through.
    """
    scratch = Scratch(spark, "lines")
    rows = docs.drop("n_lines", "n_dropped")
    pairs = rows.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lines = scratch.save(pairs.mapInArrow(_hash_lines(min_chars), "doc_id long, h1 long, h2 long"))
    index, shards = build_index(spark, lines, scratch, lines_per_shard=lines_per_shard)
    gone = scratch.save(lines_to_drop(lines, index, shards, min_docs=min_docs))
    scratch.drop(lines)
    scratch.drop(index)
    per_doc = gone.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct("h1", "h2")).alias("__gone"))
    joined = rows.join(per_doc, F.col(id_col).cast("long") == F.col("__id"), "left").drop("__id")
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "n_lines long", "n_dropped long"])
    return joined.mapInArrow(_strip_lines([*rows.columns, "n_lines", "n_dropped"], rows.columns.index(text_col), min_chars), out)
