"""URL filter: rules first, then the ratio of two character language models.

Only DataFrame functions run here.  URLs that a rule decides teach two smoothed variable-order
Markov models, one of accepted and one of rejected URLs, over an alphabet of ``SYMBOLS`` signs: the whole URL
counts, with scheme, query and fragment; upper case reads as lower case, and rare signs as one.
A URL's score is the log-likelihood difference divided by its length; a threshold calibrated on
the fifth of the taught URLs that the models have not seen decides.

The models meet as one table of SYMBOLS ** ORDER log ratios (110,592 numbers, whatever the input
size), which enters the plan as a literal array.  So scoring is a projection: no join, no
shuffle, and no row leaves the JVM.

Defined results: a null URL, and one without ``://``, has empty host and path and fits no rule; a null URL
is scored as the empty string; if no rule decides any URL, or only one way, the ratio is 0 and
the verdict of the rest is that way, or ``allow``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The start, 26 letters, 10 digits, the ten of ``SIGNS``, and all others.
SYMBOLS = 48
SIGNS = ".-/:?#&=_%"
ORDER = 3
#: A context counts once it was seen so often; rarer ones leave their say to shorter contexts.
LEAST = 4
BINS = 400

#: The rules as (rule, verdict); the host is what stands before the first slash.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(col: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(col, _UPPER, _LOWER)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))
    front = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.regexp_extract(front, r"(?s)^([^/]*)", 1)
    path = F.regexp_extract(front, r"(?s)^[^/]*(.*)$", 1)
    return lower(host), path


def rule_match(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, p = text.split("/", 1)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def codes(text: Column) -> Column:
    """The text as symbol numbers, after two signs 0 for its start: a-z 1-26, digits 27-36, ``SIGNS`` 37-46, others 47."""
    points = F.transform(F.filter(F.split(lower(text), ""), lambda c: c != ""), lambda c: F.ascii(c))

    def number(a: Column) -> Column:
        out = F.when((a >= 97) & (a <= 122), a - 96).when((a >= 48) & (a <= 57), a - 21)
        for i, sign in enumerate(SIGNS):
            out = out.when(a == ord(sign), F.lit(37 + i))
        return out.otherwise(F.lit(SYMBOLS - 1))

    return F.concat(F.array(F.lit(0), F.lit(0)), F.transform(points, number))


def grams(symbols: Column) -> Column:
    """Each place's gram as one number below SYMBOLS ** ORDER: two signs of context, then the sign."""
    places = F.when(F.size(symbols) > 2, F.sequence(F.lit(3), F.size(symbols))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.get(symbols, i - 3) * (SYMBOLS * SYMBOLS) + F.get(symbols, i - 2) * SYMBOLS + F.get(symbols, i - 1))


def _log_probabilities(counts: dict[int, int]) -> list[float]:
    """Variable order: a context seen ``LEAST`` times speaks, smoothed by the next shorter one."""
    s = SYMBOLS
    uni, bi, bi_all = [0.0] * s, {}, [0.0] * s
    tri_all: dict[int, float] = {}
    for g, n in counts.items():
        a, b, c = g // (s * s), g // s % s, g % s
        uni[c] += n
        bi[b * s + c] = bi.get(b * s + c, 0) + n
        bi_all[b] += n
        tri_all[a * s + b] = tri_all.get(a * s + b, 0) + n
    total = sum(uni)
    p1 = [(n + 1.0) / (total + s) for n in uni]
    p2 = [[(bi.get(b * s + c, 0) + 4 * p1[c]) / (bi_all[b] + 4) if bi_all[b] >= LEAST else p1[c] for c in range(s)] for b in range(s)]
    out = []
    for ab in range(s * s):
        n, b = tri_all.get(ab, 0), ab % s
        for c in range(s):
            p = (counts.get(ab * s + c, 0) + 4 * p2[b][c]) / (n + 4) if n >= LEAST else p2[b][c]
            out.append(math.log(p))
    return out


def train(judged: DataFrame) -> tuple[list[float], float]:
    """(log ratios, threshold) from rows of (_symbols, _says, _held)."""
    seen = judged.where(~F.col("_held")).select("_says", F.explode(grams(F.col("_symbols"))).alias("_g"))
    tables: dict[str, dict[int, int]] = {"allow": {}, "block": {}}
    for r in seen.groupBy("_says", "_g").agg(F.count(F.lit(1)).alias("n")).collect():  # at most 2 * SYMBOLS ** ORDER rows
        tables[r["_says"]][r["_g"]] = r["n"]
    if not tables["allow"] or not tables["block"]:
        return [], (1.0 if tables["block"] else -1.0)
    yes, no = _log_probabilities(tables["allow"]), _log_probabilities(tables["block"])
    ratios = [round(a - b, 4) for a, b in zip(yes, no, strict=True)]
    held = judged.where("_held").select("_says", score(F.col("_symbols"), ratios).alias("_s"))
    bins = held.groupBy("_says", F.least(F.greatest(F.floor(F.col("_s") * 50), F.lit(-BINS // 2)), F.lit(BINS // 2)).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    return ratios, _threshold([(r["_says"], r["b"], r["n"]) for r in bins])


def _threshold(bins: list[tuple[str, int, int]]) -> float:
    """The cut with the best balanced accuracy on the held rows; 0 where they show only one class."""
    yes = sum(n for s, _, n in bins if s == "allow")
    no = sum(n for s, _, n in bins if s == "block")
    if not yes or not no:
        return 0.0
    best, cuts = -1.0, []
    for cut in range(-BINS // 2, BINS // 2 + 1):
        good = sum(n for s, b, n in bins if s == "allow" and b >= cut) / yes + sum(n for s, b, n in bins if s == "block" and b < cut) / no
        if good > best + 1e-12:
            best, cuts = good, [cut]
        elif abs(good - best) <= 1e-12:
            cuts.append(cut)
    return cuts[len(cuts) // 2] / 50


def score(symbols: Column, ratios: list[float]) -> Column:
    """Mean log ratio over the text's places; 0 for the empty text or without models."""
    if not ratios:
        return F.lit(0.0)
    model = F.from_json(F.lit("[" + ",".join(map(str, ratios)) + "]"), "array<double>")  # foldable: one literal in the plan
    total = F.aggregate(grams(symbols), F.lit(0.0), lambda acc, g: acc + F.get(model, g))
    return F.coalesce(total / F.greatest(F.size(symbols) - 2, F.lit(1)), F.lit(0.0))


def judge(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the method's score for every row of (page_id, url)."""
    host, path = host_path(F.col("url"))
    split = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, says = rule_match(F.col("host"), F.col("path"), rules)
    split = split.withColumns({"rule": rule, "_says": says, "_symbols": codes(F.coalesce("url", F.lit("")))})
    judged = split.where(F.col("_says").isNotNull()).select("_symbols", "_says", (F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(5)) == 0).alias("_held"))
    ratios, threshold = train(judged)
    out = split.withColumn("score", score(F.col("_symbols"), ratios))
    method = F.when(F.col("score") >= threshold, F.lit("allow")).otherwise(F.lit("block"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("_says", method).alias("verdict"), F.round("score", 6).alias("score"))
