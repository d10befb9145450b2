"""Language identification by error-correcting output codes.

Each language has a codeword; each bit of the code is one binary classifier over hashed character n-grams; the language
whose codeword has the least weighted loss against the bits' margins wins (loss-weighted decoding), and a small lead over
the runner-up marks the answer as ambiguous.

Texts are lower-cased, everything but letters becomes one space, and each word stands between spaces. The features are
the frequencies of n-grams of two, three and four characters, hashed into one table for each n. The classifiers are fitted on a bounded
sample of labelled documents (``per_language`` of each language, or fewer where there are so many languages that this would
be more than ``most_rows``, but at least one; chosen by a hash of the text); everything else covers all rows. The model has a fixed size, set by its parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORDERS = (2, 3, 4)
UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    bits: int = 15  # log2 of the table size for each n
    per_language: int = 250
    most_rows: int = 50000
    rounds: int = 40
    rate: float = 2.0
    decay: float = 1e-6
    sharpness: float = 6.0
    lead: float = 0.2


def _letters():
    """For each character below 65536 a space, or for letters the lower case, of which the first character counts."""
    import numpy as np

    out = np.full(65536, 32, np.uint32)
    for c in range(65536):
        if chr(c).isalpha():
            out[c] = ord(chr(c).lower()[0])
    return out


_TABLE = None


def _codes(text: str):
    """The characters of a text as numbers: letters in lower case, single spaces between words and at both ends."""
    import numpy as np

    global _TABLE
    if _TABLE is None:
        _TABLE = _letters()
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    low = _TABLE[np.minimum(c, 65535)]
    if len(c) and c.max() > 65535:
        far = np.flatnonzero(c > 65535)
        low[far] = [c[k] if chr(c[k]).isalpha() else 32 for k in far]
    low = np.concatenate([np.array([32], np.uint32), low, np.array([32], np.uint32)])
    return low[(low != 32) | np.concatenate([[True], low[:-1] != 32])]


def _features(codes, bits: int):
    """For each n the table places of all n-grams, with the tables one after another."""
    import numpy as np

    x, out = codes.astype(np.uint64), []
    for k, n in enumerate(ORDERS):
        m = len(x) - n + 1
        if m <= 0:
            out.append(np.zeros(0, np.int64))
            continue
        h = x[:m].copy()
        for j in range(1, n):
            h = h * np.uint64(0x100000001B3) + x[j : j + m]
        h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
        out.append(h.astype(np.int64) + (k << bits))
    return out


def code_words(n: int):
    """A row of +1 and -1 for each of n classes.

    Up to seven classes: all 2**(n-1) - 1 different splits of the classes. More: rows of a fixed pseudo-random code with
    four bits for each doubling of n and eleven more; equal or opposite columns don't occur, and rows differ in many places.
    """
    import numpy as np

    if n < 2:
        return np.ones((n, 1), np.float32)
    if n <= 7:
        return np.array([[1 - 2 * (split >> k & 1) for split in range(1, 2 ** (n - 1))] for k in range(n)][::-1], np.float32)
    width, best, most = 11 + 4 * (n - 1).bit_length(), None, -1
    rng = np.random.default_rng(n)
    if n > 1000:  # a table of all pairs would be large, and so wide a code's rows lie far apart anyway
        return rng.choice(np.array([-1, 1], np.float32), (n, width))
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.float32), (n, width))
        apart = (width - code @ code.T) / 2
        least = apart[~np.eye(n, dtype=bool)].min()
        if least > most and (np.abs(code.sum(0)) < n).all():
            best, most = code, least
    return best


@dataclass
class Model:
    languages: list[str]
    code: object  # languages x code bits
    weights: object  # places x code bits
    bias: object
    settings: Settings

    def margins(self, text: str):
        """The classifiers' margins for one text; None without letters."""
        import numpy as np

        codes = _codes(text)
        if len(codes) < 3 or not len(self.languages):
            return None
        total, mean = np.array(self.bias, np.float64), np.zeros(self.weights.shape[1])
        for start in range(0, len(codes), 65536):  # blocks overlap, so that no n-gram is lost
            for n, places in zip(ORDERS, _features(codes[start : start + 65536 + max(ORDERS) - 1], self.settings.bits), strict=True):
                own = places[: max(0, min(65536, len(codes) - n + 1 - start))]
                if len(own):
                    mean += np.bincount(own, minlength=0) @ self.weights[: own.max() + 1] if len(own) > 20000 else self.weights[own].sum(0, dtype=np.float64)
        return total + mean / len(codes)

    def decode(self, margins):
        """(language, score, ambiguous): the least loss sum(log(1 + exp(-bit * margin))), each bit weighted by its |margin| share."""
        import numpy as np

        weight = np.abs(margins) / max(np.abs(margins).sum(), 1e-9)
        loss = np.logaddexp(0, -self.code * margins) @ weight
        p = np.exp(-self.settings.sharpness * (loss - loss.min()))
        p /= p.sum()
        order = np.argsort(loss, kind="stable")
        lead = p[order[0]] - (p[order[1]] if len(order) > 1 else 0)
        return self.languages[order[0]], float(p[order[0]]), bool(lead < self.settings.lead)


def sample(docs: DataFrame, text_col: str, lang_col: str, s: Settings) -> DataFrame:
    """At most ``per_language`` different texts of each language, by a hash of the text; evenly from all partitions.

    The driver sees one count for each language. Copies of a text count once, or else they would
    enter or miss the sample together and a language made of copies could be left out. A threshold on the hash thins each language to
    about twice its quota before the ranks are taken, so no window holds more than that.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    places = rows.select("lang", F.xxhash64("text").alias("place")).distinct()
    counts = places.groupBy("lang").agg(F.count("*").alias("texts")).collect()
    if not counts:
        return rows.limit(0)
    quota = max(1, min(s.per_language, s.most_rows // len(counts)))
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 2.0 * quota / r["texts"] + 20.0 / r["texts"])))])
    unit = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    from pyspark.sql import Window

    thin = rows.where(unit < share[F.col("lang")]).distinct().withColumn("place", F.xxhash64("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "text"))
    return thin.withColumn("rank", rank).where(F.col("rank") <= quota).select("text", "lang")


def train(spark: SparkSession, docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", settings: Settings = Settings()) -> Model:
    """Fits the bits' classifiers (logistic loss, full gradient with Adam) on the driver, over sparse features of the sample.

    The executors make the features, so that the driver holds counts and no texts: at most ``most_rows`` rows, or one for
    each language. Rows without a language or letters teach nothing; without any, every answer is "und".
    """
    import numpy as np
    import pyarrow as pa

    bits = settings.bits

    def count(batches):
        for batch in batches:
            places, counts = [], []
            for text in batch.column(0).to_pylist():
                codes = _codes(text)
                p, n = np.unique(np.concatenate(_features(codes, bits)), return_counts=True)
                places.append(p.astype("<i4").tobytes())
                counts.append((n / len(codes)).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(places, pa.binary()), pa.array(counts, pa.binary())], ["lang", "places", "counts"])

    rows = sample(docs, text_col, lang_col, settings).mapInArrow(count, "lang string, places binary, counts binary").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["places"])))
    languages = sorted({r["lang"] for r in rows})
    code = code_words(len(languages))
    size = len(ORDERS) << bits
    if not rows:
        return Model([], code, np.zeros((size, 1), np.float32), np.zeros(1), settings)
    cols = [np.frombuffer(r["places"], "<i4") for r in rows]
    at, val = np.concatenate(cols), np.concatenate([np.frombuffer(r["counts"], "<f4") for r in rows])
    used, at = np.unique(at, return_inverse=True)
    # frequent n-grams would drown the rest: features count by the inverse of their spread
    scale = 1.0 / np.sqrt(np.bincount(at, val**2, len(used)) / len(rows) + 1e-8)
    val = val * scale[at]
    begin = np.cumsum([0, *map(len, cols)])[:-1]
    owner = np.repeat(np.arange(len(rows)), [len(c) for c in cols])
    y = code[[languages.index(r["lang"]) for r in rows]]
    share = 1.0 / np.bincount([languages.index(r["lang"]) for r in rows])[[languages.index(r["lang"]) for r in rows]] / len(languages)
    w, b = np.zeros((len(used), y.shape[1])), np.zeros(y.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    val = val / np.sqrt(len(used) / 50)
    for step in range(1, settings.rounds + 1):
        for bit in range(y.shape[1]):
            margin = np.add.reduceat(w[at, bit] * val, begin) + b[bit]
            g = -y[:, bit] * share / (1 + np.exp(np.clip(y[:, bit] * margin, -50, 50)))
            grad = np.bincount(at, g[owner] * val, len(used)) + settings.decay * w[:, bit]
            m[:, bit] = 0.9 * m[:, bit] + 0.1 * grad
            v[:, bit] = 0.99 * v[:, bit] + 0.01 * grad**2
            w[:, bit] -= 0.1 * settings.rate * (m[:, bit] / (1 - 0.9**step)) / (np.sqrt(v[:, bit] / (1 - 0.99**step)) + 1e-6)
            b[bit] -= settings.rate * g.sum()
    # the bits' margins get the same spread, so that losses and scores mean the same whatever the sample
    spread = np.array([np.abs(np.add.reduceat(w[at, bit] * val, begin) + b[bit]).mean() for bit in range(y.shape[1])]) / 2 + 1e-9
    w, b = w / spread, b / spread
    weights = np.zeros((size, y.shape[1]), np.float32)
    weights[used] = w * (scale / np.sqrt(len(used) / 50))[:, None]
    return Model(languages, code, weights, b, settings)


def predict(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """Adds lang_pred, score (0 to 1) and ambiguous, from whole texts alone.

    A null text or one without letters has "und", 0.0 and true. With a single learned language that one is the answer.
    Columns of these names are replaced, all others pass through.
    """
    import pyarrow as pa

    rows = docs.drop("lang_pred", "score", "ambiguous")
    at = rows.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is set by the settings, not by any data

    def run(batches):
        own = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                part = whole.slice(a, 500)
                out = []
                for text in part.column(at).to_pylist():
                    margins = own.margins(text) if text else None
                    out.append((UNDETERMINED, 0.0, True) if margins is None else own.decode(margins))
                lang, score, unsure = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], [*part.schema.names, "lang_pred", "score", "ambiguous"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "lang_pred string, score double, ambiguous boolean"])
    return rows.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The rows that no classifier may learn from: crc32 of the id as text leaves no remainder by five."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
