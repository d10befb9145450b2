"""N-gram Jaccard join by vertical partitioning.

Texts become sets of hashed word shingles; equal sets are one node, so copies cost nothing further. All shingles stand
in one global order, rare ones first. The order is cut into fragments, a set's part in a fragment is a segment, and the
partial overlap of two sets is counted for each fragment by itself, as a row (pair, fragment); the rows are summed.

* The order: the head (a range of hashes) by the exact number of nodes that have a shingle; the other shingles by hash;
  and last those that are common by a sketch of all counts. Texts of like size are a class with a head of its own: short
  texts are head altogether. A text near a class's end stands in the next class as well, so that any two texts that can
  reach the threshold meet in the larger one's class, and have the same order there.
* Fragments: the head, even parts of the rest, and the common shingles.
* Two sets over the threshold share a shingle among the first ``n - ceil(t n) + 1`` of each. These lie in the head but
  for chance, and for nearly every text they are its own alone, which settles that it has no partner. For the others
  overlaps within these prefixes are summed per pair, and pairs that cannot reach the threshold go no further.
* The pairs left are counted fragment by fragment: first in the head, where most of what is unlike shows; a pair goes on
  to the other fragments only as long as the sizes of what is left of the two sets can still bring it to the threshold.

Large groups of near copies must not become all their pairs. So first every node is held against a few pivots only (of
each shared shingle two nodes, one from each half, that have most of their first shingles in common with others: the
ones in the middle of a group), which joins nearly every group. After that only pairs between different components are generated: what is
left out lies inside a component already and cannot change the answer, so the components are those of all links.

Shuffles are keyed by a shingle, a node or a pair. Where prefixes reach common shingles, their rows are dealt by node, and
so are rows of nodes with very many pairs. A shingle's nodes are streamed, never gathered. The sketch decides about the
order and the dealing alone: whatever it says, the result is the same.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Hot, Scratch, components, joined_components, lookup, shuffle_partitions

_MASK = 0xFFFFFFFFFFFFFFFF
_BASE = 0x9E3779B97F4A7C15 | 1


@dataclass(frozen=True)
class Settings:
    words: int = 5
    numerator: int = 80
    denominator: int = 100
    #: Of each size class the least set size and the share of the hashes that are its head. The shares leave a prefix
    #: outside the head with a chance of about one in a million.
    classes: tuple[tuple[int, float], ...] = ((0, 1.0), (128, 0.41), (512, 0.3), (2048, 0.25))
    sketch_bits: int | None = None  # log2 of the counters: a byte each from each task, a bit each for all; None: see sketch_size
    common: tuple[float, int] = (4, 64)  # a counter above 4 times the mean plus 64 is common
    fragments: int = 4  # of each class: the head, parts of the rest, the common shingles; 3 at least
    chunk_chars: int = 1_000_000


# ---- shingles ------------------------------------------------------------------------------------------------------

_STATE: dict = {}


def _tables(size: int):
    """Powers of the base and of its inverse, up to ``size``, and a number for each byte."""
    import numpy as np

    if _STATE.get("size", -1) < size:
        size = max(size, 1 << 21)
        up, down = np.full(size + 1, _BASE, np.uint64), np.full(size + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        blank = np.zeros(256, bool)
        blank[[32, *range(9, 14)]] = True
        r = np.random.default_rng(20240229)
        _STATE.update(size=size, up=up, down=down, blank=blank, byte=r.integers(1, _MASK, 256, np.uint64, endpoint=True), coef=r.integers(1, _MASK, 64, np.uint64, endpoint=True) | np.uint64(1))
    return _STATE


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes | None], k: int) -> list:
    """For each text its distinct shingle hashes, sorted: of each k words in a row, or of all words if there are fewer."""
    import numpy as np

    raw = [(t or b"").lower() for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    t = _tables(len(buf))
    blank = t["blank"][buf]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[0::2], edge[1::2]
    if not len(begin):
        return [np.zeros(0, np.uint64) for _ in texts]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(t["byte"][buf] * t["up"][: len(buf)], dtype=np.uint64)])
    word = _mix((total[end] - total[begin]) * t["down"][begin] + (end - begin).astype(np.uint64))
    firsts = np.cumsum([0, *(len(r) + 1 for r in raw)])
    at = np.searchsorted(begin, firsts)  # the words of text i: at[i] up to at[i + 1]
    window = np.zeros(max(0, len(word) - k + 1), np.uint64)
    for j in range(k):
        window += word[j : j + len(window)] * t["coef"][j]
    window = _mix(window)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(window[a : b - k + 1]))
        elif b > a:
            out.append(_mix((word[a:b] * t["coef"][k : k + b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _name(own) -> tuple[int, int]:
    """Two signed 64-bit halves that name a set."""
    from xxhash import xxh3_128_digest

    d = xxh3_128_digest(own.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _chunks(batches, at: int, most: int):
    """(batch slice, its texts as bytes) of about so many bytes."""
    import pyarrow as pa

    for whole in batches:
        texts = whole.column(at).cast(pa.binary()).to_pylist()
        start = size = 0
        for i, t in enumerate([*texts, None]):
            if i == len(texts) or (i > start and size + len(t or b"") > most):
                if i > start:
                    yield whole.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t or b"")


def class_of(n: int, s: Settings) -> int:
    return sum(n >= least for least, _ in s.classes) - 1


def classes_of(n: int, s: Settings) -> list[int]:
    """A set's own class, and the next one if partners that are larger can be there."""
    own = class_of(n, s)
    return [own, own + 1] if class_of(n * s.denominator // s.numerator, s) > own else [own]


def fragment_bounds(c: int, s: Settings) -> list[int]:
    """The hashes that part the fragments of a class but for the last: the end of the head, then even steps."""
    head, parts = int(s.classes[c][1] * 2**64), s.fragments - 2
    return [min(2**64 - 1, head + (2**64 - head) * f // parts) for f in range(parts)]


_BLOCK = 1 << 14


def sketch_size(rows: DataFrame) -> int:
    """log2 of the counters for an input: one for each 128 bytes, from 2**14 up to 2**22 (4 MB from each task).

    Beyond half a gigabyte the mean grows with the input, and fewer shingles count as common. They matter only to sets
    whose prefix leaves the head, which the classes keep to one in a million; the head is ordered by exact counts.
    """
    stats = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return max(14, min(22, (int(str(stats)) >> 7).bit_length()))


def _first_pass(s: Settings):
    """Each row's set size and name, and at the end of a task its counts of shingles by hash."""
    import pyarrow as pa

    names = ["doc_id", "n", "h", "l", "block", "counts"]

    def run(batches):
        import numpy as np

        size = 1 << s.sketch_bits
        seen = np.zeros(size, np.uint32)
        for part, texts in _chunks(batches, 1, s.chunk_chars):
            sets = shingle_sets(texts, s.words)
            own, more = np.unique(_counter(np.concatenate(sets), s), return_counts=True)
            seen[own] += more.astype(np.uint32)
            none = pa.nulls(len(texts))
            halves = np.array([_name(x) for x in sets], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), none.cast(pa.int32()), none.cast(pa.binary())], names)
        if seen.any():
            low = np.minimum(seen, 255).astype(np.uint8).reshape(-1, min(_BLOCK, size))
            none = pa.nulls(len(low), pa.int64())
            yield pa.RecordBatch.from_arrays([none] * 4 + [pa.array(range(len(low)), pa.int32()), pa.array([x.tobytes() for x in low], pa.binary())], names)

    return run


def _counter(own, s: Settings):
    """A shingle's counter: bits of the hash that don't say whether it is in the head."""
    import numpy as np

    return (own & np.uint64((1 << s.sketch_bits) - 1)).astype(np.int64)


def _add_blocks(most: float):
    """Sums the counts of each block that this partition gets, as they stream past: a bit for each counter above ``most``."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        sums: dict = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                more = np.frombuffer(counts, np.uint8)
                sums[block] = sums[block] + more if block in sums else more.astype(np.int64)
        for block, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(total > most).tobytes()], pa.binary())], ["block", "bits"])

    return run


def common_counters(first: DataFrame, s: Settings) -> bytes:
    """A bit for each counter: whether it is far above the mean."""
    size = 1 << s.sketch_bits
    bits = [bytes(min(_BLOCK, size) // 8)] * max(1, size // _BLOCK)
    factor, more = s.common
    most = factor * (first.agg(F.sum("n")).first()[0] or 0) / size + more
    blocks = first.where(F.col("block").isNotNull()).select("block", "counts").repartition(min(len(bits), shuffle_partitions(first.sparkSession)), "block")
    for r in blocks.mapInArrow(_add_blocks(most), "block int, bits binary").collect():  # half a megabyte at most
        bits[r["block"]] = bytes(r["bits"])
    return b"".join(bits)


def needed_of_one(n: int, s: Settings) -> int:
    """The least overlap with any partner: ceil(t n)."""
    return -(-s.numerator * n // s.denominator)


def ordered(own, c: int, common, s: Settings):
    """A set in its class's order as far as the hashes decide it: (head, the rest, common shingles)."""
    import numpy as np

    last = common[_counter(own, s)].astype(bool)
    plain = own[~last]
    k = len(plain) if s.classes[c][1] >= 1 else int(np.searchsorted(plain, np.uint64(fragment_bounds(c, s)[0])))
    return plain[:k], plain[k:], own[last]


_POSTING = ["key", "h", "l", "meta"]
_POSTING_SCHEMA = "key long, h long, l long, meta long"


def _postings(common_var, s: Settings):
    """Of each set all shingles of the head, and those behind it that the prefix needs where the head holds too few.

    Classes have keys of their own. meta: the head's size, three bits for the class, and one for a common shingle.
    """
    import pyarrow as pa

    def run(batches):
        import numpy as np

        common = np.unpackbits(np.frombuffer(common_var.value, np.uint8))
        for _, texts in _chunks(batches, 0, s.chunk_chars):
            keys, metas, names, reps, seen = [], [], [], [], set()
            for own in shingle_sets(texts, s.words):
                n = len(own)
                if not n or (name := _name(own)) in seen:
                    continue
                seen.add(name)
                for c in classes_of(n, s):
                    head, rest, last = ordered(own, c, common, s)
                    most = max(n - needed_of_one(n, s) + 1, len(head))
                    tail = last[: max(0, most - len(head) - len(rest))]
                    row = np.concatenate([head, rest[: most - len(head)], tail])
                    keys.append(_mix(row + np.uint64(c)) if c else row)
                    meta = np.full(len(row), len(head) << 4 | c << 1)
                    meta[len(row) - len(tail) :] |= 1
                    metas.append(meta)
                    names.append(name)
                    reps.append(len(row))
            if keys:
                halves = np.repeat(np.array(names, np.int64), reps, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(keys).view(np.int64), halves[:, 0].copy(), halves[:, 1].copy(), np.concatenate(metas))], _POSTING)

    return run


def _only_shared(batches):
    """Rows sorted by key and h: drops repeats, and keys with a single node, but for common ones, which are dealt to many tasks.

    (Names that agree in h alone may hide a repeat; it only makes counts that are upper bounds larger.)
    """
    import numpy as np
    import pyarrow as pa

    held = None  # the last row so far: whether it stays depends on the next one
    shared = False
    for batch in batches:
        cols = [c.to_numpy() for c in batch.columns]
        if held is not None:
            cols = [np.concatenate([[h], c]) for h, c in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        same = cols[0][1:] == cols[0][:-1]
        new = np.concatenate([[True], ~same | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])])
        cols = [c[new] for c in cols]
        same = cols[0][1:] == cols[0][:-1]
        stay = np.concatenate([[shared], same]) | np.concatenate([same, [False]]) | (cols[3] & 1).astype(bool)
        if len(same):
            shared = bool(same[-1])
        held = [c[-1] for c in cols]
        if stay[:-1].any():
            yield pa.RecordBatch.from_arrays([pa.array(c[:-1][stay[:-1]]) for c in cols], _POSTING)
    if held is not None and (shared or held[3] & 1):
        yield pa.RecordBatch.from_arrays([pa.array(np.array([h], np.int64)) for h in held], _POSTING)


def _segments(common_var, s: Settings):
    """(node, class, fragment, shingles): each wanted node's set, cut at the fragments' bounds of each wanted class."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        common = np.unpackbits(np.frombuffer(common_var.value, np.uint8))
        for part, texts in _chunks(batches, 4, s.chunk_chars):
            at, pieces = [], []
            wanted = zip(*(part.column(k).to_pylist() for k in range(4)), shingle_sets(texts, s.words), strict=True)
            for node, classes, h, l, own in wanted:
                if not len(own) or _name(own) != (h, l):  # another text under the same id
                    continue
                for c in classes:
                    head, rest, last = ordered(own, c, common, s)
                    cut = np.searchsorted(rest, np.array(fragment_bounds(c, s)[1:], np.uint64))
                    for f, x in enumerate([head, *np.split(rest, cut), last]):
                        at.append((node, c, f))
                        pieces.append(x.view(np.int64))
            if at:
                ends = np.cumsum([0, *map(len, pieces)]).astype(np.int32)
                node, c, f = (np.array(x) for x in zip(*at, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(node.astype(np.int64)), pa.array(c.astype(np.int32)), pa.array(f.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(pieces)))], ["node", "c", "fragment", "keys"])

    return run


# ---- pairs ---------------------------------------------------------------------------------------------------------


def _fits(a: Column, b: Column, s: Settings) -> Column:
    """The sizes alone allow the threshold."""
    return F.least(a, b) * s.denominator >= F.greatest(a, b) * s.numerator


def _reaches(overlap: Column, n: Column, m: Column, s: Settings) -> Column:
    """Sets of n and m with such an overlap are over the threshold."""
    return overlap.cast("long") * (s.numerator + s.denominator) >= (n + m).cast("long") * s.numerator


def _prefix_size(n: Column, s: Settings) -> Column:
    return n - F.ceil(n * s.numerator / s.denominator) + 1


def _class(n: Column, s: Settings) -> Column:
    return sum(((n >= least).cast("int") for least, _ in s.classes[1:]), F.lit(0))


def prefixes(held: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """(key, node, n, room, common, home): of the shared shingles those in a node's prefix, their number at most, which
    share of the prefix that is, and whether this is the node's own class.

    Shingles that a node has alone come first in the order; how many of the head's there are follows from their number
    and that of the shared ones, so they need no rows. A node whose prefix is its own alone disappears.
    """
    counted = held.join(lookup(held.groupBy("key").agg(F.count("*").alias("df"))), "key").join(lookup(nodes.select("h", "l", "node", "n")), ["h", "l"])
    order = Window.partitionBy("h", "l", "c").orderBy("df", "key")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = counted.withColumns({"rank": F.row_number().over(order), "held": F.count("*").over(whole), "size": _prefix_size(F.col("n"), s)})
    room = F.when(F.col("k") >= F.col("size"), F.col("size") - (F.col("k") - F.col("held"))).otherwise(F.col("held"))
    placed = ranked.withColumn("room", room).where("rank <= room")
    return placed.select("key", "node", "n", F.col("room").cast("int").alias("room"), (F.col("room") / F.col("size")).alias("common"), (F.col("c") == _class(F.col("n"), s)).alias("home"))


_PAIR = ("a", "b", "n", "m")


def star_pairs(shared: DataFrame, s: Settings) -> DataFrame:
    """(a, b, n, m): each node with the pivots that it shares most of its first shingles with; two for each node.

    A shingle's pivots are the best node of each half of the nodes, as their hashes part them: one aggregate finds both.
    """
    order = F.struct((-F.col("common")).alias("o"), F.xxhash64("node").alias("x"), F.col("node"), F.col("n"), F.col("home"))
    best_of = lambda half: F.min(F.when(F.pmod(F.xxhash64("node"), F.lit(2)) == half, order))
    top = shared.groupBy("key").agg(F.array(best_of(0), best_of(1)).alias("best")).select("key", F.explode("best").alias("p")).where("p IS NOT NULL")
    pivots = top.select("key", F.col("p.node").alias("pivot"), F.col("p.n").alias("m"), F.col("p.home").alias("base"))
    pairs = shared.join(lookup(pivots), "key").where((F.col("node") != F.col("pivot")) & (F.col("home") | F.col("base")) & _fits(F.col("n"), F.col("m"), s))
    counted = pairs.select("node", "pivot", "n", "m").repartition("node").groupBy("node", "pivot").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("m").alias("m")).where(F.col("c") * 4 >= _prefix_size(F.col("n"), s))
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("c"), "pivot"))
    chosen = counted.withColumn("rank", best).where("rank <= 2")
    low = F.col("node") < F.col("pivot")
    either = lambda x, y: F.when(low, F.col(x)).otherwise(F.col(y))
    return chosen.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"), either("n", "m").alias("n"), either("m", "n").alias("m")).distinct()


def cross_pairs(shared: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """(a, b, n, m): all pairs of different components that the overlap of their prefixes leaves within reach of the threshold."""
    named = shared.join(lookup(labels), "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    rows = named.join(mixed, "key").drop("common")
    other = rows.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("room").alias("space"), F.col("component").alias("other"), F.col("home").alias("base"))
    # whichever prefix ends first in the global order, all that the two share in it is counted
    behind = F.greatest(F.col("n") - _prefix_size(F.col("n"), s), F.col("m") - _prefix_size(F.col("m"), s))
    enough = lambda c: _reaches(c + behind, F.col("n"), F.col("m"), s)
    pairs = rows.withColumnRenamed("node", "a").join(other, "key").where((F.col("a") < F.col("b")) & (F.col("component") != F.col("other")) & (F.col("home") | F.col("base")) & _fits(F.col("n"), F.col("m"), s) & enough(F.least("room", "space")))
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("m").alias("m"))
    return counted.where(enough(F.col("c"))).select(*_PAIR)


def partial_overlaps(pairs: DataFrame, segments: DataFrame, hubs: tuple[Hot, Hot]) -> DataFrame:
    """Rows (a, b, n, m, c, fragment) with o, the overlap in that fragment, and x and y, the sizes of the two segments there."""
    side = lambda name, keys: segments.select(F.col("node").alias(name), "c", "fragment", F.col("keys").alias(keys))
    left = hubs[0].join(lookup(pairs), side("a", "ka"), ["a", "c", "fragment"], "a", deal="b")
    both = hubs[1].join(left, side("b", "kb"), ["b", "c", "fragment"], "b", deal="a")
    return both.select(*_PAIR, "c", "fragment", F.size(F.array_intersect("ka", "kb")).alias("o"), F.size("ka").alias("x"), F.size("kb").alias("y"))


def verify(pairs: DataFrame, segments: DataFrame, scratch: Scratch, s: Settings) -> DataFrame:
    """(src, dst) of the pairs that reach the threshold: partial overlaps of the fragments, summed per pair.

    A pair goes on from the head to the other fragments only if it can still reach the threshold, and has anything there.
    """
    hubs = Hot(pairs, "a"), Hot(pairs, "b")
    n, m = F.col("n"), F.col("m")
    first = pairs.withColumns({"c": F.greatest(_class(n, s), _class(m, s)), "fragment": F.lit(0)})
    head = scratch.save(partial_overlaps(first, segments, hubs).where(_reaches(F.col("o") + F.least(n - F.col("x"), m - F.col("y")), n, m, s)))
    later = [f for f in range(1, s.fragments)]
    whole = F.lit(False)  # classes that are head altogether have nothing between the head and the common shingles
    for c, (_, share) in enumerate(s.classes):
        whole = whole | (F.col("c") == c) if share >= 1 else whole
    numbers = F.when(whole, F.array(F.lit(later[-1]))).otherwise(F.array(*map(F.lit, later)))
    going = head.where((n > F.col("x")) & (m > F.col("y"))).select(*_PAIR, "c", F.explode(numbers).alias("fragment"))
    rows = head.unionByName(partial_overlaps(going, segments, hubs))
    summed = rows.groupBy("a", "b").agg(F.sum("o").alias("o"), F.first("n").alias("n"), F.first("m").alias("m"))
    return summed.where(_reaches(F.col("o"), n, m, s)).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def jaccard_components(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings(), scratch: Scratch | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles (long) and component_id.

    Words are runs of anything but the six white-space characters of ASCII, with A-Z lower-cased. A text of fewer words
    than a shingle is one shingle; a null text or one without words has none and links with nothing. Two texts link if
    their sets' Jaccard similarity reaches the threshold (integer arithmetic). component_id is the smallest id reachable.
    Rows with a null id link with nothing and keep a null component. Rows that repeat an id with the same text are one
    document; with another text, the id stands in both texts' components. Other columns of ``docs`` don't matter.

    Sets are named by 128 bits, and shingles by 64 bits of a hash. Two different shingles that share a hash can only make
    two sets look more alike by one shingle, and only if both sets hold one of the two.
    """
    scratch = scratch or Scratch(spark, "ngramjoin")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    s = settings if settings.sketch_bits else replace(settings, sketch_bits=sketch_size(rows))
    first = scratch.save(rows.mapInArrow(_first_pass(s), "doc_id long, n long, h long, l long, block int, counts binary"))
    names = first.where(F.col("block").isNull()).select("doc_id", "n", "h", "l")
    common_var = spark.sparkContext.broadcast(common_counters(first, s))
    known = names.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    repeated = (known.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 0) > 1
    # numbers for the names, fixed once the table is written: the smallest id, unless two sets can have the same one
    number = F.monotonically_increasing_id() if repeated else F.col("rep")
    nodes = scratch.save(known.groupBy("h", "l").agg(F.min("doc_id").alias("rep"), F.first("n").cast("int").alias("n")).withColumn("node", number))
    postings = rows.where("doc_id IS NOT NULL").select("text").mapInArrow(_postings(common_var, s), _POSTING_SCHEMA)
    dealt = postings.repartition(shuffle_partitions(spark), F.col("key"), F.expr("if(meta & 1 = 1, h, 0)")).sortWithinPartitions("key", "h").mapInArrow(_only_shared, _POSTING_SCHEMA)
    held = scratch.save(dealt.select("key", "h", "l", F.expr("cast(meta >> 4 as int)").alias("k"), F.expr("cast(meta >> 1 & 7 as int)").alias("c")))
    shared = scratch.save(prefixes(held, nodes, s))
    scratch.drop(held)

    def links_of(pairs: DataFrame) -> DataFrame | None:
        pairs = scratch.save(pairs)
        if pairs.isEmpty():
            return None
        c = F.greatest(_class(F.col("n"), s), _class(F.col("m"), s)).alias("c")
        ends = pairs.select(F.col("a").alias("node"), c).union(pairs.select(F.col("b").alias("node"), c)).groupBy("node").agg(F.collect_set("c").alias("classes"))
        wanted = lookup(ends).join(nodes, "node").select(F.col("rep").alias("doc_id"), "node", "classes", "h", "l")
        texts = rows.join(wanted, "doc_id").select("node", "classes", "h", "l", "text")
        cut = texts.mapInArrow(_segments(common_var, s), "node long, c int, fragment int, keys array<long>")
        segments = scratch.save(cut.dropDuplicates(["node", "c", "fragment"]) if repeated else cut)
        found = scratch.save(verify(pairs, segments, scratch, s))
        scratch.drop(segments)
        return found

    near = links_of(star_pairs(shared, s))
    none = spark.createDataFrame([], "node long, component long")
    labels = components(spark, near, scratch) if near is not None else none
    more = links_of(cross_pairs(shared, labels, s))
    scratch.drop(shared)
    if more is not None and not more.isEmpty():
        labels = joined_components(spark, labels, more, scratch)
    low = lookup(labels).join(lookup(nodes), "node").select("h", "l", "rep", "component", F.col("component").alias("component_id"))
    if repeated:
        lows = scratch.save(low.drop("component_id"))
        low = Hot(lows, "component").join(lows, lookup(lows.groupBy("component").agg(F.min("rep").alias("component_id"))), ["component"], "component", deal="h")
    low = low.select("h", "l", "component_id")
    named = nodes.join(low, ["h", "l"], "left").select("h", "l", F.coalesce("component_id", "rep").alias("component_id"))
    usable = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    own = names.withColumns({"h": F.when(usable, F.col("h")), "l": F.when(usable, F.col("l"))})
    out = Hot(known, "h").join(own, named, ["h", "l"], "h", "left", deal="doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
