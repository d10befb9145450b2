"""URL filter: suffix rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained from a small labelled URL table. Host and path have n-grams of their own (three to five characters,
with marks at both ends of every label or path step), hashed into one table; a URL's features are their
frequencies, each part of length one, so long paths don't outweigh the host.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower

ORDERS = (3, 4, 5)


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the contract, fixed values.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    most_rows: int = 20_000  # labelled rows that the driver reads, by a hash of the URL
    rounds: int = 600
    rate: float = 0.3
    decay: float = 1e-5
    block_share: float = 0.2  # of all URLs, as far as anything is known beforehand
    block_at: float = 0.5


def labelled_urls() -> list[tuple[str, int]]:
    """A small table to start from: (url, 1 to block). Every host of a kind with every path of its kind."""
    bad_hosts = "spam-mill spam-blast cheap-meds pills-shop casino-slots poker-win xxx-videos adult-chat adult-video hot-singles free-bets bet-bonus ad-tracker free-porn payday-loans click-farm malware-drop warez-crack phish-login fake-bank replica-watches".split()
    bad_paths = "buy-now bonus/spin xxx/gallery win-prize download/crack".split()
    good_hosts = "river library weather harbour garden school project museum recipes travel research city music sports history blue-lake night-sky".split()
    good_paths = "en/12 articles/2021/notes about docs/start.html fr/340?page=2 de/7/ es/588.html".split()
    tops = "com org net".split()
    fronts = ["", "www.", "m.", "blog.", "news."]
    kinds = ((bad_hosts, [*bad_paths, *good_paths[:3]], 1), (good_hosts, good_paths, 0))
    return [(f"http://{fronts[(k + 2 * n) % 5]}{h}.{tops[(k + n) % 3]}/{p}", y) for hosts, paths, y in kinds for k, h in enumerate(hosts) for n, p in enumerate(paths)]


def host_of(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule (host and path together; ties by text) that fits, as a struct (text, verdict), or null.

    A rule fits its host and all subdomains where the path starts with the rule's. Rules number a few hundred at most
    (they become one expression).
    """
    if len(rules) > 500:
        raise ValueError("more than 500 rules: join a rule table on host suffixes instead")
    out = F.lit(None).cast("struct<text:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(part: str, mark: str) -> Counter:
    text = part.lower()
    return Counter(mark + text[i : i + n] for n in ORDERS for i in range(len(text) - n + 1))


_STEP = re.compile(r"[./_]")


def features(host: str, path: str, bits: int) -> dict[int, float]:
    """Hashed n-grams of the host's labels and the path's steps; each part is a vector of length one."""
    out: dict[int, float] = {}
    for part, mark in ((host, "h"), (path, "p")):
        grams = sum((_grams(f"^{x}$", mark) for x in _STEP.split(part) if x), Counter())
        total = sum(n * n for n in grams.values()) ** 0.5
        for g, n in grams.items():
            k = crc32(g.encode("utf-8", "replace")) & ((1 << bits) - 1)
            out[k] = out.get(k, 0.0) + n / total
    return out


@dataclass
class Model:
    weights: object
    bias: float
    settings: Settings

    def probability(self, host: str, path: str) -> float:
        import math

        x = self.bias + sum(float(self.weights[k]) * v for k, v in features(host, path, self.settings.bits).items())
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def train(spark: SparkSession, labelled: DataFrame, *, url_col: str = "url", label_col: str = "label", settings: Settings = Settings()) -> Model:
    """Logistic regression by full-gradient Adam over at most ``most_rows`` labelled URLs.

    Null URLs or labels teach nothing. The classes weigh as ``block_share`` says, whatever the table holds of each. Without rows of both classes nothing is blocked.
    """
    import numpy as np

    s = settings
    url = F.col(url_col)
    few = labelled.where(url.isNotNull() & F.col(label_col).isNotNull()).select(host_of(url).alias("h"), path_of(url).alias("p"), F.col(label_col).cast("int").alias("y"), F.xxhash64(url_col).alias("o")).orderBy("o", "h", "p", "y").limit(s.most_rows).collect()
    y = np.array([1.0 if r["y"] else 0.0 for r in few])
    size = 1 << s.bits
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(size, np.float32), -50.0, s)
    each = [features(r["h"], r["p"], s.bits) for r in few]
    owner = np.repeat(np.arange(len(few)), [len(e) for e in each])
    used, at = np.unique(np.array([k for e in each for k in e]), return_inverse=True)
    val = np.array([v for e in each for v in e.values()])
    share = np.where(y == 1, s.block_share / y.sum(), (1 - s.block_share) / (len(y) - y.sum()))
    w, b, m, v = np.zeros(len(used)), 0.0, np.zeros(len(used)), np.zeros(len(used))
    for step in range(1, s.rounds + 1):
        x = np.bincount(owner, w[at] * val, len(few)) + b
        g = (1 / (1 + np.exp(-np.clip(x, -50, 50))) - y) * share
        grad = np.bincount(at, g[owner] * val, len(used)) + s.decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= s.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        b -= s.rate * g.sum()
    weights = np.zeros(size, np.float32)
    weights[used] = w
    return Model(weights, float(b), s)


def judge(urls: DataFrame, model: Model, *, url_col: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds host, path, rule (its text, or null), block_prob and verdict: the rule's, else the model's.

    A null URL or one without :// has an empty host and path, which no rule fits and the model knows nothing about but
    its bias. Columns of these names are replaced, all others pass through; repeated rows get equal answers.
    """
    shared = urls.sparkSession.sparkContext.broadcast(model)  # 2**bits weights

    @F.pandas_udf("double")
    def block_prob(host: pd.Series, path: pd.Series) -> pd.Series:
        own = shared.value
        return pd.Series([own.probability(h, p) for h, p in zip(host, path, strict=True)], dtype="float64")

    named = urls.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    ruled = named.withColumn("__rule", rule_column(F.col("host"), F.col("path"), rules))
    out = ruled.withColumns({"rule": F.col("__rule.text"), "block_prob": block_prob("host", "path")})
    method = F.when(F.col("block_prob") >= model.settings.block_at, "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce(F.col("__rule.verdict"), method)).drop("__rule")
