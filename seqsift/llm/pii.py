"""Personal data: spans by fixed patterns, and more by generators that boosted trees select from. DataFrame functions only."""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spans import no_spans, regex_spans

# The \G and look-behinds only keep searches from starting again inside a long run that led to nothing;
# possessive quantifiers where nothing could be given back keep long matches off the stack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

#: Generators that propose more than is right: name, kind of their spans, gate, pattern.
_GENERATORS = (
    ("masked_email", "email", r"(?i)[\[({] ?at ?[\])}]", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?[\[({] ?at ?[\])}] ?[a-z0-9-]++(?: ?(?:\.|[\[({] ?dot ?[\])}]) ?[a-z0-9-]++)++"),
    ("grouped_phone", "phone", r"[0-9][ .)-]{1,2}[0-9]", r"(?<![0-9.+-])\(?[0-9]{2,4}\)?[ .-]{1,2}[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9])"),
    ("card_like", "card", r"[0-9](?:[ -]?[0-9]){11}", r"(?<![0-9])[0-9](?:[ -]?[0-9]){11,14}(?![0-9])"),
    ("ip6", "ip", r"[0-9A-Fa-f]:[0-9A-Fa-f]", r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])"),
    ("national_id", "id", r"[0-9]{3}-[0-9]{2}-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("iban", "account", r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("secret", "secret", r"[0-9]", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+"),
)
ALL_KINDS = (*KINDS, "account", "id", "secret")
_CONTEXT = r"(?i)(?:tel|phone|call|mobile|fax|cell|ssn|social|security|card|visa|master|amex|token|key|secret|password|bearer|mail|contact|write|iban|account|bank|\bip\b|addr|host|server|\bid\b)"
_AGAINST = r"(?i)(?:isbn|order|version|invoice|ticket|sku|serial|page|pp|vol|date|since|commit|sha|md5|hash|build|score|ratio|\$|€|eur|usd|time|size)"
FEATURES = ("generator", "length", "digits", "separators", "distinct", "luhn", "context", "against", "letters", "same_separator")


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    each = F.split(F.reverse(digits), "")
    twice = F.transform(each, lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise((d.try_cast("int") * 2) % 10 + F.floor(d.try_cast("int") / 5).cast("int")))
    return F.aggregate(F.filter(twice, lambda v: v.isNotNull()), F.lit(0), lambda a, v: a + v) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the four fixed kinds: leftmost matches per kind; those that fail their test are dropped, with no retry."""
    gated = lambda gate, pattern: F.when(gate, regex_spans(text, F.lit(pattern))).otherwise(no_spans())
    card_digits = lambda s: F.regexp_replace(s["hit"], "[ -]", "")
    small = lambda part: F.length(F.regexp_replace(part, "^0+(?=[0-9])", "")) <= 3
    parts_ok = lambda s: F.forall(F.split(s["hit"], r"\."), lambda p: F.when(small(p), p.cast("double") <= 255).otherwise(False))
    return {
        "email": gated(F.contains(text, F.lit("@")), EMAIL),
        "ip": F.filter(gated(F.rlike(text, F.lit(r"[0-9]\.[0-9]")), IP), parts_ok),
        "card": F.filter(gated(F.rlike(text, F.lit(r"[0-9](?:[ -]?[0-9]){15}")), CARD), lambda s: F.length(card_digits(s)).between(16, 19) & luhn(card_digits(s))),
        "phone": F.filter(gated(F.contains(text, F.lit("+")), PHONE), lambda s: F.length(_digits(s["hit"])).between(8, 15)),
    }


_CANDIDATE = f"array<struct<kind:string,start:int,end:int,{','.join(f'{f}:int' for f in FEATURES)}>>"


def candidates(text: Column) -> Column:
    """Overlapping proposals of all generators with their features of format and of the 24 characters before."""
    def described(g: int, kind: str):
        def describe(s: Column) -> Column:
            hit, digits = s["hit"], _digits(s["hit"])
            before = F.substring(text, F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24)))
            seps = F.regexp_replace(hit, "[A-Za-z0-9]", "")
            values = {
                "generator": F.lit(g), "length": F.length(hit), "digits": F.length(digits), "separators": F.length(seps),
                "distinct": F.size(F.array_distinct(F.split(hit, ""))), "luhn": F.when(F.length(digits) >= 12, luhn(digits)).otherwise(False).cast("int"),
                "context": F.rlike(before, F.lit(_CONTEXT)).cast("int"), "against": F.rlike(before, F.lit(_AGAINST)).cast("int"),
                "letters": F.length(F.regexp_replace(hit, "[^A-Za-z]", "")), "same_separator": (F.size(F.array_distinct(F.split(seps, ""))) <= 2).cast("int"),
            }
            return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), *(v.alias(k) for k, v in values.items()))

        return describe

    none = F.array().cast(_CANDIDATE)
    return F.concat(*(F.when(F.rlike(text, F.lit(gate)), F.transform(regex_spans(text, F.lit(pattern)), described(g, kind))).otherwise(none) for g, (_, kind, gate, pattern) in enumerate(_GENERATORS)))


# --- boosted trees


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    feature: int
    most: float
    low: Split | Leaf
    high: Split | Leaf


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> Split | Leaf:
    """A tree of Newton steps: splits that gain most, leaves -sum(g) / (sum(h) + 1)."""
    best, gain = None, 1e-3
    whole = g.sum() ** 2 / (h.sum() + 1)
    for f in range(x.shape[1]) if depth else ():
        for cut in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= cut
            new = g[low].sum() ** 2 / (h[low].sum() + 1) + g[~low].sum() ** 2 / (h[~low].sum() + 1) - whole
            if new > gain:
                best, gain = (f, float(cut), low), new
    if best is None:
        return Leaf(float(-g.sum() / (h.sum() + 1)))
    f, cut, low = best
    return Split(f, cut, _grow(x[low], g[low], h[low], depth - 1), _grow(x[~low], g[~low], h[~low], depth - 1))


def _value(tree: Split | Leaf, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, Leaf):
        return np.full(len(x), tree.value)
    return np.where(x[:, tree.feature] <= tree.most, _value(tree.low, x), _value(tree.high, x))


def _column(tree: Split | Leaf, at: Column) -> Column:
    if isinstance(tree, Leaf):
        return F.lit(tree.value)
    return F.when(at[FEATURES[tree.feature]] <= tree.most, _column(tree.low, at)).otherwise(_column(tree.high, at))


@dataclass(frozen=True)
class Boosted:
    trees: tuple[Split | Leaf, ...]
    rate: float
    thresholds: tuple[float, ...]  # least log-odds, for each generator

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3, precision: float = 0.97) -> Boosted:
        """Trees from two thirds of the rows; on the rest, each generator's threshold is the least at which it is precise enough."""
        fold = np.arange(len(x)) % 3 == 0
        a, b = x[~fold], y[~fold]
        total, trees = np.zeros(len(a)), []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-total))
            trees.append(_grow(a, p - b, p * (1 - p), depth))
            total += rate * _value(trees[-1], a)
        out = sum(rate * _value(t, x[fold]) for t in trees)
        thresholds = []
        for g in range(len(_GENERATORS)):
            own = x[fold][:, 0] == g
            s, t = out[own], y[fold][own]
            fine = [c for c in np.unique(s) if t[s >= c].mean() >= precision]
            thresholds.append(float(min(fine)) - 1e-9 if fine else float("inf"))
        return Boosted(tuple(trees), rate, tuple(thresholds))

    def log_odds(self, at: Column) -> Column:
        return sum((_column(t, at) * self.rate for t in self.trees), F.lit(0.0))

    def chosen(self, at: Column) -> Column:
        least = F.lit(float("inf"))
        for g, t in enumerate(self.thresholds):
            least = F.when(at["generator"] == g, F.lit(t)).otherwise(least)
        return self.log_odds(at) >= least


def _examples(n: int, seed: int) -> list[tuple[str, int, int]]:
    """Invented lines with what a generator would propose, its number, and whether it is personal."""
    rng, made = random.Random(seed), []
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    w = lambda: "".join(rng.choice(["an", "er", "th", "in", "re", "ou", "st", "la", "de", "ch"]) for _ in range(rng.randint(1, 4)))
    token = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    hexa, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def carded(k: int, right: bool) -> str:
        body = d(k - 1)
        total = sum(v if i % 2 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(body))))
        return body + str((-total + (0 if right else rng.randint(1, 9))) % 10)

    for _ in range(n):
        sep = rng.choice("-. ")
        made += [
            (f"{w()} {rng.choice(['mail', 'contact', 'write to', w()])} {w()}{d(2)} [at] {w()}.{w()} {w()}", 0, 1), (f"{w()} {w()} (at) {w()} . {w()} {w()}", 0, rng.random() < 0.3),
            (f"{w()} {rng.choice(['mail', 'contact', 'write to', w()])} {w()} {rng.choice(['[at]', '(at)', '{at}'])} {w()} {rng.choice(['[dot]', '(dot)'])} {w()} {w()}", 0, 1),
            (f"{w()} {rng.choice(['call', 'phone:', 'tel.', 'fax'])} ({d(3)}) {d(3)}{sep}{d(4)} {w()}", 1, 1), (f"{w()} {rng.choice(['call me on', 'phone', 'tel', 'mobile', 'cell'])} {d(3)}{sep}{d(3)}{sep}{d(4)} {w()}", 1, 1),
            (f"{w()} {rng.choice(['call me on', 'phone', 'tel', 'mobile', 'cell'])} 0{d(3)} {d(4)} {d(4)} {w()}", 1, 1), (f"{w()} {rng.choice(['call me on', 'phone', 'tel', 'mobile', 'cell'])} 0{d(3)} {d(4)} {d(4)} {w()}", 2, 0), (f"{w()} {rng.choice(['order', 'isbn', 'version', 'date', 'score', w()])} {d(2)}{sep}{d(3)}{sep}{d(4)} {w()}", 1, 0), (f"{w()} {d(4)}-{d(2)}-{d(2)} {w()}", 1, 0),
            (f"{w()} {rng.choice(['card', 'visa', 'amex'])} {carded(15, True)} {w()}", 2, 1), (f"{w()} {rng.choice(['order', 'serial', 'invoice', w()])} {carded(rng.randint(12, 15), False)} {w()}", 2, 0),
            (f"{w()} {rng.choice(['server', 'ip', 'host', w()])} {':'.join(token(hexa, 4) for _ in range(8))} {w()}", 3, 1), (f"{w()} {rng.choice(['time', 'ratio', 'size'])} {':'.join(d(2) for _ in range(5))} {w()}", 3, 0),
            (f"{w()} {rng.choice(['server', 'ip', 'host', w()])} {token(hexa, 4)}:{token(hexa, rng.randint(1, 4))}::{token(hexa, 4)}{rng.choice(['', ':' + token(hexa, 3)])} {w()}", 3, 1),
            (f"{w()} {rng.choice(['ssn', 'social security', 'id'])} {d(3)}-{d(2)}-{d(4)} {w()}", 4, 1), (f"{w()} {rng.choice(['isbn', 'sku', 'order', 'ticket'])} {d(3)}-{d(2)}-{d(4)} {w()}", 4, 0),
            (f"{w()} {rng.choice(['iban', 'account', 'bank'])} {rng.choice(['DE', 'FR', 'ES'])}{d(20)} {w()}", 5, 1), (f"{w()} {rng.choice(['sku', 'serial', 'build'])} {token('ABCDEFGHIJ', 2)}{d(2)}{token('ABCDEFG0123456', 12)} {w()}", 5, 0),
            (f"{w()} {rng.choice(['iban', 'account', 'bank', w()])} {rng.choice(['DE', 'FR', 'ES', 'GB'])}{d(2)} {' '.join(d(4) for _ in range(rng.randint(4, 5)))} {d(2)} {w()}", 5, 1),
            (f"{w()} {rng.choice(['key', 'token', 'secret', w()])} AKIA{token('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 15)}{d(1)} {w()}", 6, 1), (f"{w()} {rng.choice(['token =', 'key:', 'bearer'])} {token(b64, rng.choice([120, 300, 700]))}{d(2)} {w()}", 6, 1),
            (f"{w()} {rng.choice(['token =', 'key:', 'secret =', 'password'])} {token(rng.choice([hexa, b64]), rng.choice([32, 40, 64]))} {w()}", 6, 1), (f"{w()} {rng.choice(['commit', 'sha', 'md5', 'hash', 'build'])} {token(hexa, rng.choice([32, 40]))} {w()}", 6, 0), (f"{w()} {'-'.join(w() for _ in range(9))}-{d(1)} {w()}", 6, 0),
        ]
    return [(t, g, int(y)) for t, g, y in made]


@lru_cache(maxsize=4)
def _trained(n: int, seed: int) -> Boosted:
    spark = SparkSession.active()
    rows = spark.createDataFrame(_examples(n, seed), "text string, g int, y int")
    found = rows.select("g", "y", F.explode(candidates(F.col("text"))).alias("c")).where("c.generator = g").select("y", *(f"c.{f}" for f in FEATURES)).collect()
    data = np.array(sorted(tuple(r) for r in found), float)
    data = data[np.random.default_rng(seed).permutation(len(data))]
    return Boosted.fit(data[:, 1:], data[:, 0])


def _of(kind: str):
    return lambda s: s["kind"] == kind


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", examples: int = 150, seed: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each row of ``docs``: the id, base and all: array<struct<kind, start, end>> in code points, end exclusive.

    base has the fixed patterns' spans, by kind (email, ip, card, phone) then start. all has them too, and what the
    trees choose of the generators' proposals; of those, ones that touch a base span, or a chosen one that starts
    before or is longer, are left out. The trees are learned from invented lines (``examples`` of each form), so no
    text is seen for that. Null and empty texts have no spans; rows are judged one by one in the JVM, so repeated
    rows, hot keys, empty tables and other columns don't matter; ``keep`` names columns to carry along.
    """
    model = _trained(examples, seed)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    step = docs.select(F.col(id_col), *keep, text.alias("__text"))
    spans = base_spans(F.col("__text"))
    slim = lambda kind, a: F.transform(a, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    step = step.withColumns({f"__{k}": v for k, v in spans.items()} | {"__candidates": candidates(F.col("__text"))})
    step = step.withColumn("base", F.concat(*(slim(k, F.col(f"__{k}")) for k in KINDS)))
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    picked = F.transform(F.filter("__candidates", lambda c: ~F.exists("base", lambda b: meets(b, c)) & model.chosen(c)), lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("minus_end"), c["kind"].alias("kind")))
    step = step.withColumn("__picked", F.when(F.size("__candidates") > 0, F.array_sort(F.array_distinct(picked))).otherwise(F.array().cast("array<struct<start:int,minus_end:int,kind:string>>")))
    more = F.aggregate("__picked", F.array().cast("array<struct<kind:string,start:int,end:int>>"), lambda done, c: F.when(c["start"] < F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(0)), done).otherwise(F.concat(done, F.array(F.struct(c["kind"].alias("kind"), c["start"].alias("start"), (-c["minus_end"]).alias("end"))))))
    step = step.withColumn("__more", more)
    order = F.concat(*(F.array_sort(F.concat(F.filter("base", _of(k)), F.filter("__more", _of(k)))) for k in ALL_KINDS))
    return step.select(id_col, *keep, "base", order.alias("all"))


def redact_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with each span replaced by its kind in capitals in brackets; where spans overlap, the first that starts counts. Null stays null."""
    # All columns travel as one, so none can clash with those made on the way.
    packed = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(*docs.columns).alias("row"))
    found = find_pii(packed, id_col="id", text_col="text", keep=("text", "row"), **options)
    text = F.col("text")
    by_start = F.array_sort(F.transform("all", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    put = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(F.concat(a["text"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("text"), s["end"].alias("at")))
    clean = F.aggregate(by_start, start, put, lambda a: F.concat(a["text"], F.substring(text, a["at"] + 1, F.length(text))))
    redacted = F.when(F.size("all") > 0, clean).otherwise(text)
    return found.select(*((redacted if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents; nulls, ties and repeats as in :func:`find_pii`."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter("base", _of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("all").alias("spans"))
