"""SentencePiece encoding and decoding on the tokenizers library.

The model file is read field by field (its protobuf wire format needs no generated code). From it come the pieces with
their scores and kinds, the normaliser's options and the model type; they are rebuilt as a ``tokenizers`` pipeline:

* unigram models become ``models.Unigram`` with the pieces' own scores and byte fallback;
* BPE models become ``models.BPE``; SentencePiece merges the adjacent pair whose union has the best score, leftmost
  first, so every way to cut a piece into two pieces is a merge, ranked by the piece's score.

The meta symbol U+2581 replaces each space, and the dummy prefix puts one in front. A text is cut in front of each run
of meta symbols where no piece reaches across such a place (this is checked when the model is read): merges cannot cross
it either, so the result is the same and the library's word cache works.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

SPACE = "▁"
#: Fixed values of the SentencePiece model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[i]
        i += 1
        value |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            return value, i


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) in order; length-delimited and fixed-width values stay bytes."""
    i = 0
    while i < len(data):
        key, i = _varint(data, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(data, i)
        elif kind in (1, 2, 5):
            n = {1: 8, 5: 4}.get(kind) or 0
            if kind == 2:
                n, i = _varint(data, i)
            value = data[i : i + n]
            i += n
        else:
            raise ValueError(f"wire type {kind} is not used by this format")
        yield key >> 3, value


@dataclass(frozen=True)
class PieceModel:
    pieces: list[tuple[str, float, int]]
    kind: int
    unk_id: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    squeeze_spaces: bool
    escape_spaces: bool

    @property
    def cuts_at_spaces(self) -> bool:
        """No piece has a meta symbol after another character."""
        return not any(SPACE in text.lstrip(SPACE) for text, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))


def parse_model(data: bytes) -> PieceModel:
    pieces, trainer, norm = [], {}, {}
    for field, value in wire_fields(data):
        if field == 1:
            f = dict(wire_fields(value))
            pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
        elif field == 2:
            trainer = dict(wire_fields(value))
        elif field == 3:
            norm = dict(wire_fields(value))
    unk = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
    return PieceModel(pieces, trainer.get(3, UNIGRAM), unk, bool(trainer.get(35, 0)), norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1)))


def _merges(model: PieceModel) -> list[tuple[str, str]]:
    ids = {text: i for i, (text, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for text, i in ids.items():
        for k in range(1, len(text)):
            left, right = text[:k], text[k:]
            if left in ids and right in ids:
                found.append((-model.pieces[i][1], i, ids[left], ids[right], left, right))
    found.sort(key=lambda x: x[:4])
    return [(x[4], x[5]) for x in found]


def build(model: PieceModel):
    """The ``tokenizers.Tokenizer`` of a model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.kind == UNIGRAM:
        t = Tokenizer(models.Unigram([(text, score) for text, score, _ in model.pieces], unk_id=model.unk_id, byte_fallback=model.byte_fallback))
    elif model.kind == BPE:
        vocab = {text: i for i, (text, _, _) in enumerate(model.pieces)}
        t = Tokenizer(models.BPE(vocab, _merges(model), unk_token=model.pieces[model.unk_id][0], fuse_unk=True, byte_fallback=model.byte_fallback))
    else:
        raise ValueError(f"model type {model.kind}: only unigram and BPE models are read")
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.squeeze_spaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", SPACE))
    t.normalizer = normalizers.Sequence(steps)
    if model.cuts_at_spaces:
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}*[^{SPACE}]+|{SPACE}+"), "isolated")
    steps = [decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()]
    if model.dummy_prefix:
        steps.append(decoders.Strip(" ", 1, 0))
    t.decoder = decoders.Sequence(steps)
    return t


def read_model(spark: SparkSession, path: str) -> bytes:
    """The model file through Spark's reader, so any store that Spark reads will do."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").head()[0])


class Coder:
    """Encodes and decodes batches; one per Python worker.

    Where no piece reaches across a space, a text's tokens are those of its units (a word with the spaces in front), so
    each distinct unit goes through the library once and is remembered, until ``most_units`` are: then the half that was
    used most stays. With ``verify``, each unit that is new also goes through SentencePiece, and a difference is an error.
    With ``trip``, each new unit's tokens are decoded at once, and it is remembered whether they come back as the unit.
    """

    def __init__(self, data: bytes, verify: bool = False, trip: bool = False, most_units: int = 150_000):
        import re

        import numpy as np
        from tokenizers import Tokenizer

        self.model = model = parse_model(data)
        if any(kind == USER_DEFINED for _, _, kind in model.pieces):
            raise ValueError("models with user-defined pieces are not read")
        self.whole = build(model)
        self.by_unit = model.cuts_at_spaces and model.dummy_prefix and model.escape_spaces and not (model.charsmap or model.squeeze_spaces)
        self.plain = Tokenizer(self.whole.model)
        self.unit = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.most_units, self.trip, self.own = most_units, trip, None
        self.number: dict[str, int] = {}
        self.start, self.size, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.same = np.zeros(0, np.int32), np.zeros(0, bool)
        if verify:
            import sentencepiece

            self.own = sentencepiece.SentencePieceProcessor(model_proto=data)

    def units(self, text: str) -> list[str]:
        """The units without their first meta symbol."""
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            return [u[1:] for u in self.unit.findall(SPACE + text.replace(" ", SPACE))]
        return text.split(" ")

    def _check(self, texts: list[str], ids: list) -> None:
        if self.own:
            for text, mine, theirs in zip(texts, ids, self.own.encode(texts, num_threads=1), strict=True):
                if text and list(mine) != theirs:  # without a text SentencePiece adds no prefix
                    raise ValueError(f"tokens of {text[:80]!r} differ from SentencePiece's")

    def _learn(self, units: set[str]) -> None:
        """Makes the tokens of these units known."""
        import numpy as np

        new = [u for u in units if u not in self.number]
        if new and self.number and len(self.number) + len(new) > self.most_units:
            self._forget()
            new = [u for u in units if u not in self.number]
        if new:
            made = [e.ids for e in self.plain.encode_batch_fast([SPACE + u for u in new], add_special_tokens=False)]
            self._check(new, made)
            size = np.fromiter(map(len, made), np.int64, len(made))
            same = [text == u.replace(SPACE, " ") for u, text in zip(new, self.decode(made), strict=True)] if self.trip else [False] * len(new)
            self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
            self.same = np.concatenate([self.same, np.array(same, bool)])
            self.pool = np.concatenate([self.pool, np.fromiter((i for x in made for i in x), np.int32, int(size.sum()))])
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))

    def _forget(self) -> None:
        """Keeps half of ``most_units`` at most, those that were used most and more than once; their uses count half from now on."""
        import numpy as np

        keep = np.sort(np.argsort(-self.uses, kind="stable")[: self.most_units // 2])
        keep = keep[self.uses[keep] > 1]
        units = list(self.number)
        self.number = {units[k]: i for i, k in enumerate(keep.tolist())}
        size = self.size[keep]
        start = np.cumsum(size) - size
        self.pool = self.pool[np.repeat(self.start[keep] - start, size) + np.arange(int(size.sum()))]
        self.start, self.size, self.uses, self.same = start, size, self.uses[keep] // 2, self.same[keep]

    def encode(self, texts: list[str]):
        """(tokens of all texts one after another, ends of each text in them, whether each text is what its tokens decode to).

        The last is None without ``trip``. Decoding is concatenation, so a text made of units that come back is one that
        comes back.
        """
        import numpy as np

        if not self.by_unit:
            ids = [e.ids if t else [] for t, e in zip(texts, self.whole.encode_batch_fast(texts, add_special_tokens=False), strict=True)]
            self._check(texts, ids)
            same = [x == t for x, t in zip(self.decode(ids), texts, strict=True)] if self.trip else None
            return np.fromiter((i for x in ids for i in x), np.int32), np.cumsum([len(x) for x in ids], dtype=np.int64), same
        split = [self.units(t) if t else [] for t in texts]
        units = [u for x in split for u in x]
        seen = set(units)
        if not seen <= self.number.keys():
            self._learn(seen)
        at = np.fromiter(map(self.number.__getitem__, units), np.int64, len(units))
        self.uses += np.bincount(at, minlength=len(self.uses))
        each = self.size[at]
        ends = np.cumsum(each)
        flat = self.pool[np.repeat(self.start[at] - (ends - each), each) + np.arange(int(each.sum()))]
        last = np.cumsum([len(x) for x in split], dtype=np.int64)
        same = None
        if self.trip:
            lost = np.concatenate([[0], np.cumsum(~self.same[at])])
            same = [bool(x) and SPACE not in t for x, t in zip(np.diff(lost[np.concatenate([[0], last])]) == 0, texts, strict=True)]
        return flat, np.concatenate([[0], ends]).astype(np.int64)[last], same

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.whole.decode_batch(ids, skip_special_tokens=False)


_LOADED: dict[tuple, Coder] = {}


def coder(data: bytes, verify: bool = False, trip: bool = False, threads: int = 2) -> Coder:
    key = (data, verify, trip)
    if key not in _LOADED:
        os.environ |= {"TOKENIZERS_PARALLELISM": "true", "RAYON_NUM_THREADS": str(threads)}
        _LOADED.clear()
        _LOADED[key] = Coder(data, verify, trip)
    return _LOADED[key]


def _runs(texts, most_chars: int):
    """Slices of consecutive texts with about so many characters at most (a longer text stands alone)."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and size + n > most_chars:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def _schema(df: DataFrame, added: dict[str, str]) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *(f"`{c}` {kind}" for c, kind in added.items())])


def encode(docs: DataFrame, model: bytes, *, text_col: str = "text", ids_col: str = "token_ids", round_trip: str | None = None, verify: bool = True, threads: int = 2, batch_chars: int = 1_000_000) -> DataFrame:
    """Adds ``ids_col``, the tokens (array of int) of each whole text.

    A null text gives null ids, an empty text no ids. Rows are never dropped or merged; other columns pass through, and
    an input column named like ``ids_col`` is replaced. Batches hold about ``batch_chars`` characters (a longer text is
    a batch of its own) and are encoded on ``threads`` threads. ``verify`` compares with SentencePiece as it goes.
    ``round_trip`` names a column to add (a boolean): the tokens, decoded in the same worker, are the text; null for null.
    """
    import pyarrow as pa

    kept = docs.drop(ids_col, *([round_trip] if round_trip else []))

    def run(batches):
        import numpy as np

        tok = coder(model, verify, bool(round_trip), threads)
        for whole in batches:
            texts = whole.column(text_col).to_pylist()
            for a, b in _runs(texts, batch_chars):
                part = whole.slice(a, b - a)
                filled, nulls = [t or "" for t in texts[a:b]], np.array([t is None for t in texts[a:b]])
                flat, ends, same = tok.encode(filled)
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=np.append(nulls, False))
                more = [pa.array(same, pa.bool_(), mask=nulls)] if round_trip else []
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, pa.array(flat)), *more], [*part.schema.names, *added])

    added = {ids_col: "array<int>"} | ({round_trip: "boolean"} if round_trip else {})
    return kept.mapInArrow(run, _schema(kept, added))


def decode(rows: DataFrame, model: bytes, *, ids_col: str = "token_ids", text_col: str = "decoded", threads: int = 2) -> DataFrame:
    """Adds ``text_col``, the text of ``ids_col``; null ids give null, no ids the empty text. Ids outside the model are an error."""
    import pyarrow as pa

    kept = rows.drop(text_col)

    def run(batches):
        tok = coder(model, threads=threads)
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                part = whole.slice(a, 256)
                ids = part.column(ids_col).to_pylist()
                texts = tok.decode([i or [] for i in ids])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([None if i is None else t for i, t in zip(ids, texts, strict=True)], pa.string())], [*part.schema.names, text_col])

    return kept.mapInArrow(run, _schema(kept, {text_col: "string"}))


def token_digest(docs: DataFrame, model: bytes, *, id_col: str = "doc_id", text_col: str = "text", verify: bool = True, threads: int = 2, batch_chars: int = 1_000_000) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 (of the little-endian 32-bit ids) and round_trip (the decoded tokens are the text).

    The same encoding as ``encode``, without sending every token back to the JVM. A null text has null in all three.
    """
    import pyarrow as pa

    def run(batches):
        import hashlib

        tok = coder(model, verify, True, threads)
        for whole in batches:
            every, ids_of = whole.column(1).to_pylist(), whole.column(0)
            for a, b in _runs(every, batch_chars):
                texts = every[a:b]
                filled = [t or "" for t in texts]
                flat, ends, same = tok.encode(filled)
                flat = flat.astype("<i4")
                starts = [0, *ends[:-1].tolist()] if len(ends) else []
                rows = [(None, None, None) if t is None else (j - i, hashlib.sha256(flat[i:j].tobytes()).hexdigest(), s) for t, i, j, s in zip(texts, starts, ends.tolist(), same, strict=True)]
                n, sha, ok = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([ids_of.slice(a, b - a), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(ok, pa.bool_())], [id_col, "n_tokens", "ids_sha256", "round_trip"])

    kept = docs.select(id_col, text_col)
    return kept.mapInArrow(run, _schema(kept.select(id_col), {"n_tokens": "bigint", "ids_sha256": "string", "round_trip": "boolean"}))
