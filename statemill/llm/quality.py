"""Quality classifier: ordinal regression with cumulative logits over hashed text.

P(grade <= k) = logistic(threshold_k - w . x): one weight vector for all grades, ordered thresholds between them. The
result is the expected grade and the tail probability P(grade >= accepted), by which documents are selected.

The features are hashed text, each present or absent: words in lower case without the punctuation around them, their
beginnings (three to five characters), and the page's style: for each form of token (its trailing symbols, capitals
only, repeats of the token before it) the steps that its share of the tokens reaches. Presence keeps one telling word
in a very long text as strong as in a short one. So that thousands of ordinary words don't add up to noise, only
features enter that enough rated documents have and that are far more (or less) frequent in some grade.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STEPS = (0.02, 0.1, 0.3, 0.6)
PART = 262_144
BEGINNINGS = (3, 4, 5)
_AROUND = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»¿¡…“”„’‘"


@dataclass(frozen=True)
class Settings:
    most_rated: int = 12_000  # rated documents for the fit, by a hash of their ids
    least_docs: int = 8
    least_z: float = 5.0
    least_log_odds: float = 2.0
    most_features: int = 20_000
    rounds: int = 400
    rate: float = 0.05
    decay: float = 2e-5
    accept: float = 0.5


def _word_features(word: str) -> set[int]:
    raw = word.encode("utf-8", "replace")
    return {crc32(raw), *(crc32(b"^" + word[:n].encode("utf-8", "replace")) for n in BEGINNINGS if len(word) > n)}


def _form(token: str) -> str:
    """What is unusual about a token's outside: its trailing symbols but one full stop or comma, and capitals only."""
    core = token.rstrip(_AROUND)
    tail = token[len(core) :].rstrip(".,")[:3] if core else token[:3]
    return tail + ("^" if len(core) > 1 and core.isupper() else "")


class Reader:
    """Features of texts; remembers those of ``most`` tokens."""

    def __init__(self, wanted: set[int] | None = None, most: int = 100_000):
        self.wanted, self.most, self.known = wanted, most, {}

    def _token(self, token: str):
        word = token.strip(_AROUND).lower()
        own = _word_features(word) if word else set()
        if self.wanted is not None:
            own &= self.wanted
        if len(self.known) >= self.most:
            self.known.clear()
        self.known[token] = out = (tuple(own), _form(token))
        return out

    def features(self, text: str | None) -> set[int]:
        tokens = (text or "").split()
        out: set[int] = set()
        forms: Counter = Counter()
        for token, n in Counter(tokens).items():
            own, form = self.known.get(token) or self._token(token)
            if own:
                out.update(own)
            if form:
                forms[form] += n
        if tokens:
            forms["="] += sum(a == b for a, b in zip(tokens, tokens[1:], strict=False))
            for form, n in forms.items():
                share = n / len(tokens)
                out.update(crc32(f" {form} {s}".encode("utf-8", "replace")) for s in STEPS if share >= s)
        return out if self.wanted is None else out & self.wanted


@dataclass
class Model:
    weights: dict[int, float]
    thresholds: list[float]
    settings: Settings = field(default_factory=Settings)

    def tails(self, features) -> list[float]:
        """P(grade >= k) for k = 1, 2, ..."""
        x = sum(self.weights[f] for f in sorted(features))
        return [1 / (1 + math.exp(min(50.0, max(-50.0, t - x)))) for t in self.thresholds]


def grades(quality: str = "quality", toxic: str = "toxic") -> Column:
    """0 toxic, 1 of low quality, 2 good; null where a rating is missing."""
    return F.when(F.col(toxic) == 1, 0).when((F.col(toxic) == 0) & (F.col(quality) == 0), 1).when((F.col(toxic) == 0) & (F.col(quality) == 1), 2)


def _select(used, at, owner, y, n_grades: int, s: Settings):
    """Features that stand out: by z and by log odds, in the documents below some threshold against the rest. ``at`` holds
    places in ``used``; the second result has the place of each among those that stand out, or -1."""
    import numpy as np

    df = _count(at, len(used))
    score = np.zeros(len(used))
    for k in range(n_grades - 1):
        for low in (y <= k, y == k):
            a = _count(at, len(used), owner, low) + 0.5
            b, na, nb = df - a + 1.0, low.sum(), (~low).sum()
            c, d = na - a + 1.0, nb - b + 1.0
            odds = np.log(a * d / (b * c))
            z = np.abs(odds) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
            score = np.maximum(score, np.where(np.abs(odds) >= s.least_log_odds, z, 0))
    ok = (df >= s.least_docs) & (score >= s.least_z)
    if ok.sum() > s.most_features:
        ok &= score >= np.sort(score)[-s.most_features]
    place = np.full(len(used), -1, np.int32)
    place[ok] = np.arange(ok.sum())
    return used[ok], place[at]


def train(spark: SparkSession, docs: DataFrame, rated: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", settings: Settings = Settings()) -> Model:
    """Fits on at most ``most_rated`` rows of ``rated`` (id, grade 0, 1, ...), chosen by a hash of the id, and their texts.

    Ratings with a null id or grade and ids without a document teach nothing. Without any rating, every document gets
    the highest of no grades: expected grade 0 and tail probability 1. The executors make the features; the driver
    gets hashes, of a bounded number of documents.
    """
    import numpy as np
    import pyarrow as pa

    s = settings
    few = rated.where(F.col(id_col).isNotNull() & F.col(grade_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(grade_col).cast("int").alias("__grade")).orderBy(F.xxhash64("__id"), "__id", "__grade").limit(s.most_rated)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(few), "__id")  # most_rated rows of two numbers

    def read(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                part = whole.slice(a, 500)
                reader = Reader(most=50_000)
                found = [np.array(sorted(reader.features(t)), "<u4").tobytes() for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(found, pa.binary())], ["grade", "features"])

    rows = texts.select("__text", "__grade").mapInArrow(read, "grade int, features binary").collect()
    rows.sort(key=tuple)
    y, sizes = np.array([g for g, _ in rows], np.int64), np.array([len(b) // 4 for _, b in rows], np.int64)
    flat = np.frombuffer(b"".join(b for _, b in rows), "<u4")
    del rows
    return fit(flat, sizes, y, s)


def _frequent(flat, least: int):
    """The hashes that occur often enough to be selected, sorted. Beside a sorted copy it takes a byte for each hash."""
    import numpy as np

    ordered = np.sort(flat)
    most = max(least, 1) - 1
    if len(ordered) <= most:
        return ordered[:0]
    return np.unique(ordered[: len(ordered) - most][ordered[most:] == ordered[: len(ordered) - most]])


def _places(flat, sizes, known):
    """(owner, at) of the hashes that are known: the row each is of, and its place among the known; a megabyte of hashes at a time."""
    import numpy as np

    ends = np.cumsum(sizes)
    owner, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for a in range(0, len(flat) if len(known) else 0, PART):
        x = flat[a : a + PART]
        k = np.minimum(np.searchsorted(known, x), len(known) - 1).astype(np.int32)
        hit = np.flatnonzero(known[k] == x)
        owner.append(np.searchsorted(ends, a + hit, side="right").astype(np.int32))
        at.append(k[hit])
    return np.concatenate(owner), np.concatenate(at)


def _count(at, n: int, owner=None, rows=None):
    """How often each place occurs (in these rows); numpy widens what it counts, so a part at a time."""
    import numpy as np

    out = np.zeros(n, np.int64)
    for a in range(0, len(at), PART):
        x = at[a : a + PART]
        out += np.bincount(x if rows is None else x[rows[owner[a : a + PART]]], minlength=n)
    return out


def fit(flat, sizes, y, s: Settings) -> Model:
    """The model of rows with these feature hashes (all rows' in ``flat``, ``sizes`` of them each) and grades."""
    import numpy as np

    rows = y
    if not len(rows):
        return Model({}, [], s)
    levels = int(y.max()) + 1
    known = _frequent(flat, s.least_docs)  # most words are rare, and rare ones are never selected
    owner, at = _places(flat, sizes, known)
    used, at = _select(known, at, owner, y, levels, s)
    owner, at = owner[at >= 0], at[at >= 0]
    # thresholds start at the observed shares; distances between them stay positive as exponentials
    below = np.clip(np.array([(y <= k).mean() for k in range(levels - 1)]), 1e-3, 1 - 1e-3)
    start = np.log(below / (1 - below))
    first, gaps = start[:1].copy(), np.log(np.maximum(np.diff(start), 0.05))
    w = np.zeros(len(used))
    moments = [np.zeros(len(w) + levels - 1) for _ in range(2)]
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -50, 50)))
    for step in range(1, s.rounds + 1 if levels > 1 else 1):
        x = np.bincount(owner, w[at], len(rows))
        theta = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        up, down = sigmoid(edges[y + 1] - x), sigmoid(edges[y] - x)
        up[y == levels - 1], down[y == 0] = 1.0, 0.0
        p = np.maximum(up - down, 1e-9)
        du, dd = up * (1 - up) / p, down * (1 - down) / p
        gx = (du - dd) / len(rows)
        gtheta = np.array([-du[y == k].sum() + dd[y == k + 1].sum() for k in range(levels - 1)]) / len(rows)
        rest = np.cumsum(gtheta[::-1])[::-1]
        grad = np.concatenate([np.bincount(at, gx[owner], len(w)) + s.decay * w, rest[:1], rest[1:] * np.exp(gaps)])
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.99 * moments[1] + 0.01 * grad**2
        move = s.rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-9)
        w -= move[: len(w)]
        first -= move[len(w) : len(w) + 1]
        gaps -= move[len(w) + 1 :]
    theta = np.concatenate([first, first + np.cumsum(np.exp(gaps))])[: levels - 1]
    return Model(dict(zip(used.tolist(), w.tolist(), strict=True)), theta.tolist(), s)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", accepted: int = 2) -> DataFrame:
    """Adds expected_grade, tail_prob = P(grade >= accepted) and accept (tail_prob reaches the settings' ``accept``).

    Whole texts count; a null or empty text has no features and gets the prior of the thresholds. Repeated rows get
    equal answers. Columns of these names are replaced, all others pass through. An ``accepted`` above the highest
    rated grade counts as the highest.
    """
    import pyarrow as pa

    rows = docs.drop("expected_grade", "tail_prob", "accept")
    at = rows.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most most_features weights

    def run(batches):
        own = shared.value
        reader = Reader(set(own.weights))
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                part = whole.slice(a, 500)
                tails = [own.tails(reader.features(t)) for t in part.column(at).to_pylist()]
                k = min(accepted, len(own.thresholds)) - 1
                tail = [t[k] if k >= 0 else 1.0 for t in tails]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([float(sum(t)) for t in tails], pa.float64()), pa.array(tail, pa.float64()), pa.array([t >= own.settings.accept for t in tail], pa.bool_())], [*part.schema.names, "expected_grade", "tail_prob", "accept"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "expected_grade double, tail_prob double, accept boolean"])
    return rows.mapInArrow(run, schema)
