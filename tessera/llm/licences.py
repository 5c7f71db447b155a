"""Licence scan: a trained paragraph classifier, confirmed by template comparison.

For each family a sparse logistic regression over the word 1- and 2-grams of a paragraph tells it from all
others and from what is no licence, so that a notice may name several. All are trained together on the driver, from published
notices with seeded variations (cut, wrapped, with words changed or added, two families in one notice), from
ordinary sentences, scraps of notices and notices of licences that are no family. L1 shrinkage leaves some hundred
grams; all biases are learned. A temperature is fitted on held-out variations, with other unknown
licences, so that the probabilities are calibrated; a unit for which no family is probable is unknown. A
prediction is confirmed when a template of its family shares enough of its grams.

A *paragraph* is a run of lines without an empty one between them, so that a wrapped
notice is seen whole; each of its lines is judged alone as well, so that two notices on
successive lines are both found. Where lines of a paragraph are confirmed for a family they
are returned, else the whole paragraph, else unconfirmed lines.

The scan itself is DataFrame expressions only. What must be scored follows from the weights: :func:`telling_words` are so chosen
that a text without any of them can't reach the least probability for any family, whatever else it holds; so what is left out
loses nothing. Units with such a word are written once, their grams joined
with the broadcast weights and templates (their numbers are fixed with the model), and
summed by unit.

Defined results: null and empty texts have no paragraphs; lines of any length are read
whole; repeated rows are scanned one by one; an empty table gives an empty result;
other columns are ignored. Only units of a known family are returned, once for each family.
"""

from __future__ import annotations

import json
import random
import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, materialize, small_or_shuffled
from .licence_texts import FRAMES, IDENTIFIERS, NAMES, ORDINARY, OTHER_NOTICES, OTHERS, TEXTS

FAMILIES = tuple(TEXTS)
SEED = 5
VARIANTS = 4
#: Function words: no gram of these alone is a feature, as they tell nothing about licences and are everywhere.
COMMON = frozenset(
    "a an and any are as at be by can for from he i if in is it may more not of on or she that the their this to two was were will with without you your all also but do does either had has have here her him his how into its new no"
    " only other our out over shall should so some such than them then there these they those under up use used very we what when where which while who would 0 1 2 3 4 1.0 1.1 2.0 2.1 3.0 4.0 v. v".split()
)
MIN_PROBABILITY = 0.8
MIN_SIMILARITY = 0.6
_TOKEN = "[a-z0-9]+(?:[.+-][a-z0-9]+)*"


def notices(family: str) -> list[str]:
    """Templates of a family: its texts, and its names in every frame."""
    return [*TEXTS[family], *(f.format(n) for n in NAMES[family] for f in FRAMES), *(f"SPDX-License-Identifier: {i}" for i in IDENTIFIERS[family])]


def grams(text: str) -> set[str]:
    words = re.findall(_TOKEN, text.lower())
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


#: What names two licences at once.
PAIRS = ("Dual licensed under {} OR {}", "Licensed under either of {} or {} at your option.", "This work is dual-licensed under {} and {}.", "You may choose {} or {}.", "Available under the terms of {} or the {}")


def variations(seed: int, n: int, others: tuple[str, ...] = OTHERS) -> list[tuple[str, frozenset[int]]]:
    """Seeded paragraphs with their families: notices with surroundings, dropped and changed words, cut at a wrap; what is unknown."""
    rng = random.Random(seed)
    filler = sorted({w for s in ORDINARY for w in re.findall(r"[A-Za-z]+", s)})
    scraps = {"the", "under", "is", "this", "work", "license", "licensed", "version", "public", "general", "of", "terms", "source", "use", "and", "to", "released", "copy", "software", "free", "permission", "copyright", "notice", "distributed"}
    out = []

    def varied(words: list[str]) -> list[str]:
        words = [rng.choice(filler) if rng.random() < 0.04 and len(words) > 8 else w for w in words if len(words) < 9 or rng.random() > 0.05]
        return rng.sample(filler, rng.randrange(4)) + words + rng.sample(filler, rng.randrange(6))

    for k, family in enumerate(FAMILIES):
        for notice in notices(family):
            for i in range(n * (3 if notice in TEXTS[family] else 1)):
                words = notice.split()
                if i:
                    if len(words) > 24 and rng.random() < 0.4:  # a part of some lines, if it isn't much less than the whole
                        at = rng.randrange(len(words) // 3)
                        words = words[at : at + 2 * len(words) // 3]
                    words = varied(words)
                out.append((" ".join(words), frozenset([k])))
                if i % 2:
                    scrap = [w for w in words if rng.random() < 0.3 and w.lower().strip(".,()\"") in scraps]
                    out.append((" ".join(rng.sample(filler, rng.randrange(3, 15)) + scrap), frozenset()))
    for name in others:
        out += [(" ".join(varied(f.format(name).split())), frozenset()) for f in FRAMES for _ in range(n)]
    for s in (*ORDINARY, *OTHER_NOTICES):
        out += [(" ".join(w for w in s.split() if rng.random() > 0.1), frozenset()) for _ in range(4 * n)]
    for k, family in enumerate(FAMILIES):
        out += [(" ".join(varied(f.format(i).split())), frozenset([k])) for i in IDENTIFIERS[family] for f in FRAMES[1:4] for _ in range(n)]
    for _ in range(250 * n):
        a, b = rng.sample(range(len(FAMILIES)), 2)
        if rng.random() < 0.3:
            text = f"SPDX-License-Identifier: {rng.choice(IDENTIFIERS[FAMILIES[a]])} {rng.choice(['OR', 'AND'])} {rng.choice(IDENTIFIERS[FAMILIES[b]])}"
        else:
            text = rng.choice(PAIRS).format(*(rng.choice([*NAMES[FAMILIES[k]], *IDENTIFIERS[FAMILIES[k]]]) for k in (a, b)))
        out.append((" ".join(varied(text.split())), frozenset([a, b])))
    return out


@dataclass(frozen=True)
class Classifier:
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    temperature: float

    def probabilities(self, text: str) -> np.ndarray:
        """Of each family."""
        z = np.array(self.bias)
        for g in sorted(grams(text) & self.weights.keys()):
            z = z + self.weights[g]
        return 1 / (1 + np.exp(-z / self.temperature))


def _own_parts(gram: str) -> set[str]:
    """The words of a gram that aren't, nor are made of, function words."""
    return {word for word in gram.split() if word not in COMMON and not set(re.findall("[a-z0-9]+", word)) <= COMMON}


@lru_cache
def train(seed: int = SEED, variants: int = VARIANTS, steps: int = 300, shrink: float = 1e-4) -> Classifier:
    """Accelerated proximal gradient on the families' log-losses with an L1 penalty; temperature and a shift of all biases by held-out loss, every third unknown licence being held out."""
    data, held = variations(seed, variants, tuple(o for i, o in enumerate(OTHERS) if i % 3)), variations(seed + 1, 2)
    noticed = set().union(*(grams(n) for f in TEXTS for n in notices(f)), *(grams(n) for n in OTHER_NOTICES))
    names = sorted(g for g in noticed if _own_parts(g))
    at = {g: i for i, g in enumerate(names)}
    x = np.zeros((len(data), len(names)), np.float32)
    y = np.zeros((len(data), len(FAMILIES)), np.float32)
    for i, (text, own) in enumerate(data):
        x[i, [at[g] for g in grams(text) if g in at]] = 1
        y[i, list(own)] = 1
    heavy = 1 + y * (np.sqrt(len(data) / y.sum(0)) - 1)  # families differ in their numbers of notices
    v = np.ones(len(names), np.float32)
    for _ in range(20):
        v = x.T @ (x @ v)
        norm = float(np.linalg.norm(v))
        v /= norm
    w = v = np.zeros((len(names), len(FAMILIES)), np.float32)
    bias = np.zeros(len(FAMILIES), np.float32)
    step, t = 4.0 * len(data) / (norm * float(heavy.max())), 1.0
    for _ in range(steps):
        p = (1 / (1 + np.exp(-(x @ v + bias))) - y) * heavy
        bias = bias - p.mean(0)
        new = v - step * (x.T @ p) / len(data)
        new = np.sign(new) * np.maximum(np.abs(new) - step * shrink, 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        w, v, t = new, new + (t - 1) / t_new * (new - w), t_new
    kept = {g: tuple(round(float(c), 4) for c in w[i]) for g, i in at.items() if np.abs(w[i]).max() >= 0.05}
    model = Classifier(kept, tuple(round(float(b), 4) for b in bias), 1.0)
    p = np.clip(np.array([model.probabilities(text) for text, _ in held]), 1e-12, 1 - 1e-12)
    z, own = np.log(p / (1 - p)), np.array([[k in o for k in range(len(FAMILIES))] for _, o in held])

    def loss(fit: tuple[float, float]) -> float:
        return float(np.logaddexp(0, np.where(own, -1, 1) * (z - fit[1]) / fit[0]).mean())

    temperature, less = min(product((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), (-0.5, 0.0, 0.5, 1.0, 1.5)), key=loss)
    return Classifier(model.weights, tuple(round(b - less, 4) for b in model.bias), temperature)


def telling_words(model: Classifier, least: float = MIN_PROBABILITY) -> tuple[str, ...]:
    """Words of which every text has one that reaches the least probability for a family.

    Those whose grams have the largest positive weights are taken until, for each family, all positive weights of the other grams together with
    the bias stay under what that probability needs.
    """
    need = model.temperature * float(np.log(least / (1 - least)))
    parts = {g: _own_parts(g) for g in model.weights}
    taken: set[str] = set()
    while True:
        left = {g: w for g, w in model.weights.items() if not parts[g] & taken}
        short = [k for k, b in enumerate(model.bias) if b + sum(max(w[k], 0) for w in left.values()) >= need - 1e-3]
        if not short:
            return tuple(sorted(taken))
        gain: dict[str, float] = {}
        for g, w in left.items():
            for part in parts[g]:
                gain[part] = gain.get(part, 0) + sum(max(w[k], 0) for k in short)
        taken.add(max(sorted(gain), key=gain.get))


def _may_tell(lower, words: tuple[str, ...]):
    """Has the text the longest run of letters and digits of a telling word, or, if it has none of three, the word itself? A text with a telling word has."""
    runs, whole = set(), []
    for word in words:
        run = max(re.findall("[a-z0-9]+", word), key=lambda x: (x not in COMMON, not x.isdigit(), len(x)))
        if run == word or (len(run) > 2 and run not in COMMON):
            runs.add(run)
        else:
            whole.append(word)
    may = F.arrays_overlap(F.split(lower, "[^a-z0-9]+"), F.array(*map(F.lit, sorted(runs))))
    for word in whole:
        may = may | lower.contains(word)
    return may


def _units(docs: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """``doc_id, paragraph, n_lines, row, block, words`` of every paragraph and every line of a longer one that has a telling word.

    ``paragraph`` is the number of the first line; a line carries its number through the cuts in front of its text.
    """
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("lower")).filter(_may_tell(F.col("lower"), words))
    numbered = F.transform(F.split("lower", "\n"), lambda line, i: F.when(F.trim(F.translate(line, "\t\r\u000b\u000c", "    ")) == "", F.lit("\u0001")).otherwise(F.concat(i.cast("string"), F.lit("\u0002"), F.translate(line, "\u0001\u0002", "  "))))
    blocks = rows.select("doc_id", "row", F.posexplode(F.split(F.array_join(numbered, "\n"), "\u0001")).alias("block", "body")).filter(_may_tell(F.col("body"), words))
    lines = F.filter(F.split("body", "\n"), lambda x: x != "")
    both = F.when(F.size("lines") > 1, F.concat(F.array(F.array_join("lines", "\n")), F.filter("lines", lambda x: _may_tell(x, words)))).otherwise(F.col("lines"))
    units = blocks.withColumn("lines", lines).select("doc_id", "row", "block", F.explode(both).alias("unit"))
    text = F.regexp_replace("unit", "(^|\n)[0-9]+\u0002", " ")
    return units.select("doc_id", F.substring_index("unit", "\u0002", 1).cast("long").alias("paragraph"), (F.length("unit") - F.length(F.replace("unit", F.lit("\u0002"), F.lit("")))).cast("long").alias("n_lines"), "row", "block", F.regexp_extract_all(text, F.lit(f"({_TOKEN})"), F.lit(1)).alias("words")).filter(F.arrays_overlap("words", F.array(*map(F.lit, words))))


def licence_paragraphs(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """``doc_id, paragraph, n_lines, family, probability, similarity, confirmed`` of every unit of a known family."""
    model, spark = model or train(), docs.sparkSession
    units = materialize(_units(docs, telling_words(model)))
    key = ["row", "paragraph", "n_lines"]
    pairs = F.when(F.size("words") > 1, F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    templates = [(c, i, g) for c in FAMILIES for i, n in enumerate(notices(c)) for g in sorted(grams(n))]
    table: dict[str, list] = {}
    for c, i, g in templates:
        table.setdefault(g, []).append({"template": f"{c}/{i}", "share": 1.0 / len(grams(notices(c)[i]))})
    zero = (0.0,) * len(FAMILIES)
    known = [{"gram": g, "w": [float(x) for x in model.weights.get(g, zero)], "parts": table.get(g, [])} for g in sorted(model.weights.keys() | table.keys())]
    kind = "array<struct<gram:string,w:array<double>,parts:array<struct<template:string,share:double>>>>"
    known = materialize(spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(known)), kind))))
    found = units.select("doc_id", *key, "block", F.explode(F.array_distinct(F.concat("words", pairs))).alias("gram")).join(F.broadcast(known), "gram")
    sums = [F.sum(F.get("w", i)).alias(f"w{i}") for i in range(len(FAMILIES))]
    z = F.array(*(F.col(f"w{i}") + F.lit(float(b)) for i, b in enumerate(model.bias)))
    graded = found.drop("parts").groupBy(*key).agg(F.first("doc_id").alias("doc_id"), F.first("block").alias("block"), *sums).withColumn("z", z)
    graded = graded.select(*key, "doc_id", "block", F.posexplode("z").alias("k", "z")).withColumn("p", 1.0 / (1.0 + F.exp(-F.col("z") / F.lit(float(model.temperature)))))
    family = F.get(F.array(*map(F.lit, FAMILIES)), F.col("k"))
    known_units = graded.filter(F.col("p") >= MIN_PROBABILITY).select(*key, "doc_id", "block", family.alias("family"), "p")
    known_units = small_or_shuffled(materialize(known_units))
    own = F.filter("parts", lambda t: F.substring_index(t["template"], "/", 1) == F.col("family"))
    shares = found.drop("doc_id", "block").join(known_units, key).select(*key, "doc_id", "block", "family", "p", F.explode(own).alias("t"))
    each = [*key, "doc_id", "block", "family", "p"]
    similar = shares.groupBy(*each, "t.template").agg(F.sum("t.share").alias("s")).groupBy(*each).agg(F.max("s").alias("s"))
    marked = similar.withColumn("confirmed", F.round("s", 6) >= MIN_SIMILARITY)
    inside = Window.partitionBy("row", "block", "family")
    line = F.col("n_lines") == 1
    chosen = F.when(F.max(line & F.col("confirmed")).over(inside), line & F.col("confirmed")).when(F.max(~line).over(inside), ~line).otherwise(F.lit(True))
    return marked.withColumn("chosen", chosen).filter("chosen").select("doc_id", "paragraph", "n_lines", "family", F.round("p", 6).alias("probability"), F.round("s", 6).alias("similarity"), "confirmed")


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_paragraphs(documents(spark, sf_dir))
