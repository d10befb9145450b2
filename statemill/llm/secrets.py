"""Secret scans in DataFrame expressions only.

Base rules find assignments, access keys and hex strings. The method adds spans: long tokens of letters, digits and the
base64 symbols are scored by two character Markov models, one of random strings and one of ordinary identifiers, and
those whose log-likelihood ratio per transition is high enough are secrets too. As a token may glue a secret to ordinary
names by = / _ or -, stretches of its pieces between these signs are judged as if they stood alone.

The models are trained from labelled samples, by counting pairs of neighbouring symbols in one aggregate. Symbols are the 80
ASCII characters from + to z, so capitals, small letters and digits stay apart, and a model is a table of 80 x 80.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER, UPPER

KINDS = ("assign", "access", "hex", "markov")
_VALUE = "[A-Za-z0-9+/_.=-]"
_NAMES = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name) for name in ("password", "passwd", "secret", "token", "api_?key"))
#: The contract's patterns, fixed values; the shortest lengths of a match follow.
ASSIGN = rf"(?:{_NAMES})[\"']?\x20*[:=]\x20*[\"']?({_VALUE}+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"  # AKIA[A-Z0-9]+ of 18 characters or more: a shorter run holds no longer one
HEX = r"[0-9a-f]{16,}"  # [0-9a-f]+ of 16 or more
LEAST_VALUE = 12
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: A piece of a candidate; its group is the shortest stretch of whole pieces from there that is long enough.
STRETCH = r"(?=([A-Za-z0-9+/_=-]{20,}?)(?![A-Za-z0-9+]))[A-Za-z0-9+]+"

_BLOCK = 128
#: An identifier by its form, whatever its digits: never a secret of the method.
UUID = r"(?<![0-9A-Za-z])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Za-z])"
_FIRST, _SYMBOLS = 43, 80  # from + to z
DIGITS = "0123456789"


@dataclass(frozen=True)
class Model:
    ratios: tuple[float, ...]  # log P(b | a, random) - log P(b | a, ordinary) at 80 * a + b
    threshold: float = 0.35


def _pairs(text: Column) -> Column:
    """The numbers of neighbouring symbols, 80 * a + b; characters outside + to z count as full stops."""

    def numbered(codes: Column) -> Column:
        n = F.size(codes)
        return F.zip_with(F.slice(codes, F.lit(1), n - 1), F.slice(codes, F.lit(2), n - 1), lambda a, b: a * _SYMBOLS + b)

    # split into characters first: substring would walk the text again for each of them
    return _bound(F.transform(F.split(F.regexp_replace(text, "[^+-z]", "."), ""), lambda c: F.ascii(c) - _FIRST), numbered)


def _drawn(alphabet: str, length: Column, salt: int) -> Column:
    """A string of evenly drawn characters, the same for the same id and salt."""
    at = lambda k: F.pmod(F.xxhash64("id", F.lit(salt), k), F.lit(len(alphabet))).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(1), length), lambda k: F.substring(F.lit(alphabet), at(k) + 1, F.lit(1))), "")


def _shaped(mask: str, salt: int) -> Column:
    """``mask`` with 9, A, a, H and h replaced by drawn digits, capitals, small letters and hexadecimal digits."""
    kinds = {"9": DIGITS, "A": UPPER, "a": LOWER, "H": DIGITS + "ABCDEF", "h": DIGITS + "abcdef"}
    runs = re.findall(r"9+|A+|a+|H+|h+|[^9AaHh]+", mask)
    return F.concat(*(_drawn(kinds[r[0]], F.lit(len(r)), 100 * salt + k) if r[0] in kinds else F.lit(r) for k, r in enumerate(runs)))


#: Words of ordinary names, and the shapes of ordinary codes: dates, times, counters, part and order numbers, UUIDs, rulers.
WORDS = "get set user name value count index config read write file path list item node parse error message handle request response session time date page line table column order total price customer report window update create delete check default option render server client stream buffer thread process event number string object result status account address length width height the and for with this that from have will your when there their about would which after other over under between content system member service public private static return import export module version release build test case data model view control balance payment invoice network storage security language document question answer history project manager company country american government education development information international organization application configuration transaction authentication description previous sequence quantity quality exchange frequency library directory software hardware keyboard graphics animation background foreground temperature measurement".split()
SHAPES = ("9999-99-99T99-99-99Z", "99999999T999999Z-999999", "9999-99-99-99-99-99-999", "hhhhhhhh-hhhh-4hhh-8hhh-hhhhhhhhhhhh", "hhhhhhhh-hhhh-1hhh-ahhh-hhhhhhhhhhhh", "PN-99999-AA-9999-A99", "SKU-AAA-999999-AA-99", "AA99-9999-9999-9999-99", "AAA-9999-99999-AA-999", "99999999999999999999", "+99-999-9999999-99-99", "A9999999-99-AAA-99999", "9999/99/99/9999999/99", "AAAA9999999999999999", "--------------------", "====================", "____________________", "++++++++++++++++++++", "999-9999999-9999999-9")
SECRETS = (UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS + "-_", LOWER + DIGITS, UPPER + "234567", DIGITS + "ABCDEF", UPPER + LOWER, UPPER + DIGITS, LOWER)


def default_samples(spark: SparkSession, n: int = 3600) -> DataFrame:
    """Labelled strings (text, secret): ``n`` drawn from the alphabets of keys, ``n`` names made of words or codes of ordinary shapes."""
    pick = lambda k: F.element_at(F.array(*map(F.lit, WORDS)), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(WORDS))).cast("int") + 1)
    tail = F.when(F.col("id") % 5 == 0, _drawn(DIGITS, (F.col("id") % 4 + 1).cast("int"), 9)).otherwise("")
    some = [pick(k) for k in range(1, 7)]
    camel, title = F.concat(some[0], *map(F.initcap, some[1:]), tail), F.concat(*map(F.initcap, some), tail)
    glued = [F.concat(F.concat_ws(sign, *some), F.when(tail != "", F.concat(F.lit(sign), tail)).otherwise("")) for sign in ("_", "-", "/", "=", "")]
    shouted = F.upper(F.concat_ws("_", *some[:4]))
    dated = F.concat(some[0], F.lit("_"), _shaped("20999999_999999", 7), F.lit("-"), some[1], F.lit("/"), some[2])
    names = [camel, title, *glued, shouted, dated]
    choose = lambda forms, by: F.element_at(F.array(*forms), F.pmod(by, F.lit(len(forms))).cast("int") + 1)
    code = choose([_shaped(m, 20 + k) for k, m in enumerate(SHAPES)], F.xxhash64("id", F.lit(11)))
    ordinary = F.when(F.col("id") % 3 == 0, code).otherwise(choose(names, F.xxhash64("id", F.lit(12))))
    secret = choose([_drawn(a, (F.col("id") % 41 + 20).cast("int"), 60 + k) for k, a in enumerate(SECRETS)], F.xxhash64("id", F.lit(13)))
    rows = spark.range(0, n, 1, 4)
    return rows.select(ordinary.alias("text"), F.lit(False).alias("secret")).unionAll(rows.select(secret.alias("text"), F.lit(True).alias("secret")))


def train(samples: DataFrame, *, text_col: str = "text", secret_col: str = "secret", threshold: float = 0.35) -> Model:
    """Counts the pairs of both kinds of samples (add-one smoothing); the driver gets at most 2 x 80 x 80 counts.

    Null texts or labels and texts of one character teach nothing; without samples all ratios are 0 and no span is added.
    """
    known = samples.where(F.col(text_col).isNotNull() & F.col(secret_col).isNotNull() & (F.length(text_col) > 1))
    rows = known.select(F.col(secret_col).cast("boolean").alias("s"), F.explode(_pairs(F.col(text_col))).alias("pair")).groupBy("s", "pair").count().collect()
    logs = {}
    for kind in (True, False):
        counts = [1.0] * (_SYMBOLS * _SYMBOLS)
        for r in rows:
            if r["s"] == kind:
                counts[r["pair"]] += r["count"]
        totals = [sum(counts[a * _SYMBOLS : (a + 1) * _SYMBOLS]) for a in range(_SYMBOLS)]
        logs[kind] = [math.log(c / totals[k // _SYMBOLS]) for k, c in enumerate(counts)]
    return Model(tuple(a - b for a, b in zip(logs[True], logs[False], strict=True)), threshold)


def likelihood_ratio(text: Column, model: Model) -> Column:
    """The mean log-likelihood ratio of a token's transitions."""
    ratios = F.array(*map(F.lit, model.ratios))
    return F.aggregate(_pairs(text), F.lit(0.0), lambda s, p: s + F.element_at(ratios, p + 1)) / (F.length(text) - 1)


def _spans(text: Column, pattern: str, keep) -> Column:
    """(start, end, text) of the leftmost matches that don't overlap, in code points: pieces between the matches, and the matches.

    ``keep(match, value)`` says which of them stay. Texts without any match cost one search.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(1 if "(" in pattern.replace("(?:", "") else 0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("m"), value.alias("v"))
    none = F.array().cast("array<struct<start:int,end:int,m:string,v:string>>")

    def step(s, x):
        start = s["at"] + x["gap"]
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.array_append(s["out"], F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"), x["v"].alias("v"))).alias("out"))

    def block(parts, s, k):  # appending copies an array, so long lists are folded in blocks
        own = F.aggregate(F.slice(parts, k * _BLOCK + 1, F.lit(_BLOCK)), F.struct(s["at"].alias("at"), none.alias("out")), step)
        return _bound(own, lambda o: F.struct(o["at"].alias("at"), F.array_append(s["out"], F.filter(o["out"], keep)).alias("out")))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int,m:string,v:string>>>").alias("out"))
    blocks = lambda parts: F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / _BLOCK).cast("int"))
    folded = _bound(zipped, lambda parts: F.aggregate(blocks(parts), begin, lambda s, k: block(parts, s, k), lambda s: F.flatten(s["out"])))
    return F.when(text.rlike(pattern), folded).otherwise(none)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value made once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _joined(spans: Column) -> Column:
    """(start, end) with overlapping spans made one."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    begin = F.struct(none.alias("out"), F.lit(0).alias("start"), F.lit(-1).alias("end"))
    closed = lambda s: F.when(s["end"] < 0, s["out"]).otherwise(F.array_append(s["out"], F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def step(s, x):
        apart = x["start"] >= s["end"]
        return F.struct(F.when(apart, closed(s)).otherwise(s["out"]).alias("out"), F.when(apart, x["start"]).otherwise(s["start"]).alias("start"), F.greatest(s["end"], x["end"]).alias("end"))

    return F.aggregate(F.array_sort(spans), begin, step, closed)


def _inside(run: Column, taken: Column, model: Model) -> Column:
    """The secrets (start, end) in one candidate: what base spans leave of it, whole or else stretches of its pieces.

    A stretch gives way to a later one inside it if what comes before that one is ordinary by itself.
    """
    looks = lambda t: likelihood_ratio(t, model) >= model.threshold
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))

    def blank(t, b):
        a, z = F.greatest(b["start"] - run["start"], F.lit(0)), F.least(b["end"], run["end"]) - run["start"]
        return F.overlay(t, F.repeat(F.lit(" "), z - a), a + 1, z - a)

    def tight(found):
        ordinary = lambda g, h: likelihood_ratio(F.substring(run["m"], g["start"] + 1, h["start"] - g["start"]), model) < model.threshold
        # the pieces before a stretch's last one are shorter than 20 characters together, so at most nine more begin there
        return F.filter(found, lambda g, i: ~F.exists(F.slice(found, i + 2, F.lit(10)), lambda h: F.when((h["start"] > g["start"]) & (h["end"] <= g["end"]), ordinary(g, h)).otherwise(False)))

    def judged(m):
        m = F.regexp_replace(m, UUID, " " * 36)
        whole = F.transform(_spans(m, CANDIDATE, lambda y: looks(y["m"])), lambda y: span(y["start"], y["end"]))
        stretches = F.transform(_spans(m, STRETCH, lambda y: looks(y["v"])), lambda y: span(y["start"], y["start"] + F.length(y["v"])))
        return _joined(F.concat(whole, _bound(stretches, tight)))

    near = F.filter(taken, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    return F.transform(_bound(F.aggregate(near, run["m"], blank), judged), lambda y: span(run["start"] + y["start"], run["start"] + y["end"]))


def scan(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """Adds ``found``: an array of (kind, start, end) by start and then by the order of KINDS; a null text has none.

    Base spans may overlap across kinds. Spans of the method keep clear of base spans, and are whole tokens or stretches of
    their pieces. Texts are scanned whole. A column named ``found`` is replaced, all others pass through.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.drop("found").withColumns({"__assign": _spans(text, ASSIGN, lambda x: F.length(x["v"]) >= LEAST_VALUE), "__access": _spans(text, ACCESS, lambda x: F.lit(True)), "__hex": _spans(text, HEX, lambda x: F.lit(True))})
    taken = F.concat("__assign", "__access", "__hex")
    runs = _spans(text, CANDIDATE, lambda x: F.lit(True))
    more = base.withColumn("__markov", F.flatten(F.transform(runs, lambda x: _inside(x, taken, model))))

    def tagged(kind: str) -> Column:
        return F.transform(f"__{kind}", lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end")))

    names = F.array(*map(F.lit, KINDS))
    ordered = F.transform(F.array_sort(F.concat(*map(tagged, KINDS))), lambda x: F.struct(F.element_at(names, x["rank"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return more.withColumn("found", ordered).drop(*(f"__{k}" for k in KINDS))


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda x: x["kind"].isin(*kinds))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(scanned: DataFrame, *, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``text_col`` with every found span (overlapping ones together) replaced by ``mask``; ``found`` is dropped."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s, x):
        fresh = x["start"] >= s["at"]
        piece = F.when(fresh, F.concat(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mask))).otherwise("")
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], piece).alias("out"))

    done = F.aggregate("found", begin, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return scanned.withColumn(text_col, F.when(F.col(text_col).isNotNull(), done)).drop("found")
