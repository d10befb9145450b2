"""Benchmark decontamination with suffix arrays of the training text.

The training text is cut into shards (runs of whole documents within a task, bounded by words). A shard's suffixes are
the places where a word sequence can start that the benchmark has; they are sorted by their next ``window`` words, and
benchmark windows and array are matched by binary search, the shorter of the two in the longer, which gives each window
its range of equal suffixes. Neighbouring hits on one diagonal join into the longest verbatim matches (document, item,
places, length). Where a window stands several times in one item, a place goes on with the match that it can prolong, and
otherwise opens one at the first of them, so that repeated words give no more matches than places and items.

Only suffixes whose first ``probe`` words occur one after another in the benchmark enter the array: no other can match a
window, so this loses nothing, and it makes the arrays small. Benchmark items of fewer words than ``window`` are windows
themselves. The benchmark is cut into blocks of bounded size, and the documents pass one block after another without any
shuffle; with several blocks each pass is written to the shared folder before the driver reads the next block, so that
neither side has to fit anywhere as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch

#: The contract's word characters: ASCII digits and letters, and all characters beyond ASCII.
_BREAKS = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
END = 0  # no word: between documents and for words that the benchmark doesn't have


def words_of(text: str | bytes | None) -> list[bytes]:
    if text is None:
        return []
    raw = text.encode() if isinstance(text, str) else text
    return raw.lower().translate(_BREAKS).split()


class Block:
    """Benchmark items with their windows, ready to be searched."""

    def __init__(self, items: list[tuple[int, str | None]], window: int):
        self.window = window
        self.items = [i for i, _ in items]
        self.words = [words_of(t) for _, t in items]

    def prepare(self):
        """Built on each worker: it is several times the size of the texts."""
        import numpy as np

        if hasattr(self, "vocab"):
            return self
        self.vocab: dict[bytes, int] = {}
        coded = [[self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws] for ws in self.words]
        self.by_length = {}
        for number, ids in enumerate(coded):
            if ids:
                n = min(self.window, len(ids))
                for at in range(len(ids) - n + 1):
                    self.by_length.setdefault(n, []).append((number, at, ids[at : at + n]))
        self.searches = {}
        for n, found in self.by_length.items():
            rows = np.array([w for _, _, w in found], ">u4").reshape(-1, n)
            order, uniq = _sorted_rows(rows)
            self.searches[n] = (uniq, [[(found[k][0], found[k][1]) for k in ks] for ks in order])
        self.shortest = min(self.searches, default=1)
        probe = min(self.shortest, 3)
        grams = {tuple(w[:probe]) for found in self.by_length.values() for _, _, w in found}
        self.probe, self.grams = probe, np.unique(_gram(np.array(sorted(grams), np.uint64).reshape(-1, probe).T))
        del self.by_length
        return self


def _sorted_rows(rows):
    """(for each distinct row the places that have it, the distinct rows sorted, as byte strings that compare like them)."""
    import numpy as np

    keys = np.ascontiguousarray(rows).view(f"S{rows.shape[1] * 4}").ravel()
    order = np.argsort(keys, kind="stable")
    uniq, first = np.unique(keys[order], return_index=True)
    return np.split(order, first[1:]), uniq


def _gram(cols):
    """One number for the words in ``cols`` (exact for word numbers below 2**21, else a mix that can only admit more)."""
    import numpy as np

    out = cols[0].astype(np.uint64)
    for c in cols[1:]:
        out = (out << np.uint64(21)) ^ (out >> np.uint64(43)) ^ c.astype(np.uint64)
    return out


def search_shard(ids, block: Block):
    """{window length: (places, window numbers)}: all occurrences of the block's windows in one shard, by place.

    ``ids``: the shard's word numbers, END where a word isn't in the block's vocabulary and after each document.
    """
    import numpy as np

    p = block.probe
    if len(ids) < p or not len(block.grams):
        return {}
    n = len(ids) - p + 1
    live = ids[:n] != END
    for k in range(1, p):
        live &= ids[k : n + k] != END
    starts = np.flatnonzero(live)
    g = _gram([ids[starts + k] for k in range(p)])
    at = np.minimum(np.searchsorted(block.grams, g), len(block.grams) - 1)
    starts = starts[block.grams[at] == g]  # the suffixes that the array holds
    if not len(starts):
        return {}
    depth = max(block.searches)
    padded = np.concatenate([ids, np.zeros(depth, ids.dtype)]).astype(">u4")
    out = {}
    # suffix array by the first `depth` words; shorter windows are prefixes of the same order
    rows = np.ascontiguousarray(padded[starts[:, None] + np.arange(depth)])
    order = np.argsort(rows.view(f"S{depth * 4}").ravel(), kind="stable")
    starts, rows = starts[order], rows[order]
    for n, (windows, _) in block.searches.items():
        head = np.ascontiguousarray(rows[:, :n]).view(f"S{n * 4}").ravel()
        if len(windows) <= len(head):
            low, high = np.searchsorted(head, windows, "left"), np.searchsorted(head, windows, "right")
            number = np.repeat(np.arange(len(windows)), high - low)
            places = np.concatenate([starts[low[w] : high[w]] for w in np.flatnonzero(high > low)] or [starts[:0]])
        else:
            at = np.minimum(np.searchsorted(windows, head), len(windows) - 1)
            hit = windows[at] == head
            places, number = starts[hit], at[hit]
        if len(places):
            order = np.argsort(places, kind="stable")
            out[n] = places[order], number[order]
    return out


def joined_matches(places, numbers, owners, n: int):
    """Occurrences next to each other on one diagonal, joined: [place, item number, place in the item, words].

    At each place every item that has the window goes on with its open match if the item has the window at the next
    place too, and else opens a match at the first place where it has the window.
    """
    out, going, last = [], {}, None
    for place, w in zip(places.tolist(), numbers.tolist(), strict=True):
        by_item: dict[int, list[int]] = {}
        for number, at in owners[w]:
            by_item.setdefault(number, []).append(at)
        now = {}
        for number, ats in by_item.items():
            match = going.get(number) if last == place - 1 else None
            if match is not None and match[2] + match[3] - n + 1 in ats:
                match[3] += 1
            else:
                match = [place, number, min(ats), n]
                out.append(match)
            now[number] = match
        going, last = now, place
    return out


def _shards(texts, vocab, most_words: int):
    """Runs of documents: (first, after the last, word numbers with END after each document, start of each, words of each)."""
    import numpy as np

    get, first, ids, begin, size = vocab.get, 0, [], [], []
    for k, text in enumerate(texts):
        ws = words_of(text)
        begin.append(len(ids))
        size.append(len(ws))
        ids += [get(w, END) for w in ws]
        ids.append(END)
        if len(ids) >= most_words:
            yield first, k + 1, np.array(ids, np.int64), np.array(begin), np.array(size)
            first, ids, begin, size = k + 1, [], [], []
    if first < len(texts):
        yield first, len(texts), np.array(ids, np.int64), np.array(begin), np.array(size)


MATCH = "array<struct<item_id:bigint,doc_at:int,item_at:int,n_words:int>>"


def _search(shared, text_at: int, names: list[str], most_words: int):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("doc_at", pa.int32()), ("item_at", pa.int32()), ("n_words", pa.int32())]))

    def run(batches):
        import numpy as np

        block = shared.value.prepare()
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                part = whole.slice(a, 500)
                counts, found = [], part.column(part.num_columns - 1).to_pylist()
                for i, _, ids, begin, size in _shards(part.column(text_at).cast(pa.binary()).to_pylist(), block.vocab, most_words):
                    counts += size.tolist()
                    for n, (places, numbers) in search_shard(ids, block).items():
                        matches = joined_matches(places, numbers, block.searches[n][1], n)
                        owner = np.searchsorted(begin, [m[0] for m in matches], "right") - 1
                        for k, (place, number, item_at, words) in zip(owner.tolist(), matches, strict=True):
                            found[i + k].append({"item_id": block.items[number], "doc_at": place - int(begin[k]), "item_at": item_at, "n_words": words})
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(counts, pa.int32()), pa.array(found, kind)], names)

    return run


def read_blocks(benchmark: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text", block_chars: int = 4_000_000):
    """Yields the benchmark in blocks of about ``block_chars`` characters, in the order of ids; null ids are left out.

    The driver holds the partition that it reads and one block.
    """
    now, size, any_ = [], 0, False
    for item_id, text in benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), text_col).orderBy(id_col).toLocalIterator():
        now.append((item_id, text))
        size += len(text or "")
        if size >= block_chars:
            yield Block(now, window)
            now, size, any_ = [], 0, True
    if now or not any_:
        yield Block(now, window)


def find_matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", window: int = 13, block_chars: int = 4_000_000, shard_words: int = 200_000, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with n_words (int) and ``matches``: the longest verbatim matches of at least a window, with their places.

    Words are lower-cased (A-Z) runs of ASCII letters, digits and characters beyond ASCII. A null text has no words and
    no match; items without words match nothing; an empty benchmark leaves ``matches`` empty. Items that share windows
    match on their own; so do rows that repeat an id. Input columns named n_words or matches are replaced.
    """
    rows = docs.drop("n_words", "matches")
    at, names = rows.columns.index(text_col), [*rows.columns, "n_words", "matches"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "n_words int", f"matches {MATCH}"])
    out = rows.withColumns({"n_words": F.lit(0), "matches": F.array().cast(MATCH)})
    source, before = out, None
    for block in read_blocks(benchmark, window, block_chars=block_chars):
        if before is not None:  # the pass of the block before is over, and its broadcast can go
            scratch = scratch or Scratch(spark, "matches")
            kept = scratch.save(out)
            before.destroy()
            scratch.drop(source)
            out = kept
        source, before = out, spark.sparkContext.broadcast(block)
        out = out.mapInArrow(_search(before, at, names, shard_words), schema)
    return out


def contamination(matched: DataFrame) -> DataFrame:
    """Adds n_hit (words in any match), item_ids (sorted as strings) and contaminated: at least one word in 20 is hit."""
    spans = F.array_sort(F.transform("matches", lambda m: F.struct(m["doc_at"].alias("a"), (m["doc_at"] + m["n_words"]).alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("reach"))
    union = F.aggregate(spans, start, lambda s, x: F.struct((s["hit"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["reach"]))).alias("hit"), F.greatest(s["reach"], x["b"]).alias("reach")), lambda s: s["hit"])
    ids = F.array_sort(F.transform(F.array_distinct(F.transform("matches", lambda m: m["item_id"])), lambda i: i.cast("string")))
    out = matched.withColumns({"n_hit": union, "item_ids": ids})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that aren't contaminated, with the columns they came with."""
    return contamination(find_matches(spark, docs, benchmark, **options)).where(~F.col("contaminated")).select(*docs.columns)
