"""URL filter: explicit rules, and logistic regression on hashed character n-grams of host and path.

The classifier is trained on the driver from the small labelled table in this module, weights and bias, in about a
second, and is a fixed-size vector.  Host and path have n-grams of their own (orders 2 to 5,
each host label and path segment marked at both ends).  A rule (host, path prefix) fits its host and all
subdomains and paths that begin with its path; the longest fitting rule decides, and only urls that no rule
fits are judged by the classifier.

A url that is null or has no ``://`` has an empty host and path, fits no rule and is judged by the
classifier's bias.  Long urls are read whole.  Each row is judged by itself, so ties and repeated rows need no rule; of
equal hosts and paths one is scored.  An empty table gives an empty result.  Other columns pass through; those that
have the name of a result (``RESULT``) are replaced.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules as (verdict, rule).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# Words of blocked hosts, words that any host may have, paths that are blocked on any host, and words of allowed hosts.
BLOCKED = """
casino casinos poker slots slot jackpot lottery roulette bet bets betting bookmaker gambling win wins winner prize prizes free freebies cheap cheapest
discount pills pill viagra pharma pharmacy meds steroids loan loans payday cash credit crypto bitcoin forex xxx porn sex adult adults cams escort dating
nude spam spammer spammy farm farms backlinks links clicks click popunder popup ads ad adserver advert track tracker tracking pixel redirect warez crack
cracks keygen torrent torrents serials replica replicas fake phishing verify malware hack hacks clickbait
""".split()
ANYWHERE = "online best top new my the live daily world pro hub zone plus one first".split()
BLOCKED_PATHS = """
/bonus/casino /slots/spin /poker/table /betting/odds /order/pills /buy/viagra /loan/apply /cash/now /claim/prize /win/free /xxx/videos /adult/cams /sex/dating
/porn/tube /links/farm /ads/click /track/pixel /redirect/ads /popunder/ad /keygen/crack /torrent/dl /verify/account
""".split()
ALLOWED = """
academy airport almanac anatomy aquarium archive army art astronomy atlas ballet baking bakery band bank biology birds blog boat book bookshop botany
bread bridge bus calendar camera camping castle cat cello chapel chemistry chess children choir cinema city climate clinic clock club coast code college
comet community concert cooking council country court cricket culture cycling dance data daily design dictionary dog drama economy editor education
encyclopedia energy engineering environment europe exhibition factory family farming festival film finance fishing flowers folk food football forest
forum fruit gallery garden gazette geography geology glass golf government grammar guide guitar harbour health herald history hockey home horse hospital
hotel house island jazz journal justice kitchen knitting lake language law lecture lessons letters library literature local magazine maps market maths
medicine memory mobile mountain museum music nature navy news novel ocean opera orchard orchestra painting palace paper parish park parliament people
philosophy photo physics piano planet poetry police pottery press project quarterly radio railway recipes record region research review river road
rowing sailing school science sea shop sky society space sport stadium statistics story street student summer swimming tea teacher tennis theatre town
tracks travel tree tutorial union university valley village violin volunteer walking water weather wiki wildlife window winter wood workshop writer zoo
""".split()
#: Hosts and paths of either kind are made of these, by turns, so that they tell nothing.
_PREFIXES = ("www.", "", "blog.", "m.", "")
_ENDINGS = ("com", "org", "net")
_PATHS = ("/en/{}.html", "/fr/{}", "/en/{}/", "/de/{}", "/en/{}", "/es/{}/", "/{}.html")


def labelled() -> list[tuple[str, str, float]]:
    """(host, path, 1.0 if blocked) of every row of the table: each word alone and with words that any host may have."""
    host = lambda i, name: f"{_PREFIXES[i % len(_PREFIXES)]}{name}.example.{_ENDINGS[i % len(_ENDINGS)]}"
    path = lambda i: _PATHS[i % len(_PATHS)].format(101 * i % 9973)
    rows = []
    for words, blocked in ((ALLOWED, 0.0), (BLOCKED, 1.0)):
        for k, word in enumerate(words):
            other = ANYWHERE[k % len(ANYWHERE)]
            for j, name in enumerate((word, f"{other}-{word}" if k % 2 else f"{word}-{other}")):
                rows.append((host(2 * k + j, name), path(3 * k + j), blocked))
    return rows + [(host(i, ALLOWED[7 * i % len(ALLOWED)]), p, 1.0) for i, p in enumerate(BLOCKED_PATHS)]


DIMENSIONS = 1 << 14
ORDERS = (2, 3, 4, 5)
RESULT = ("host", "path", "rule", "verdict", "p_block")
#: Value of an n-gram that occurs; steps, rate and ridge of the descent.
SCALE = 0.2
STEPS = 400
RATE = 2.0
L2 = 3e-4


def split(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, by the first ``://``, ``/``, ``?`` and ``#``."""
    text = F.coalesce(url, F.lit(""))
    # Everything up to the first :// is skipped; a url without one leaves both groups empty.
    parts = "(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(text, parts, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(text, parts, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(the longest fitting rule, its verdict), null where none fits; a longer rule is tried first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def grams(host: str, path: str) -> np.ndarray:
    """Hashed n-grams of the labels of the host and the segments of the path."""
    out = []
    for kind, parts in (("h", host.replace("-", ".").split(".")), ("p", path.split("/"))):
        for part in parts:
            if part:
                word = f"^{part}$"
                for k in ORDERS:
                    out += [zlib.crc32(f"{kind}{word[i : i + k]}".encode()) % DIMENSIONS for i in range(len(word) - k + 1)]
    return np.array(out, np.int64)


def vector(host: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    at = np.unique(grams(host, path))
    return at, np.full(len(at), SCALE)


def train(rows: list[tuple[str, str, float]] | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias, both by gradient descent on the logistic loss."""
    rows = labelled() if rows is None else rows
    seen = [vector(host, path) for host, path, _ in rows]
    used = np.unique(np.concatenate([at for at, _ in seen]))
    x = np.zeros((len(rows), len(used)))
    for i, (at, value) in enumerate(seen):
        x[i, np.searchsorted(used, at)] = value
    y = np.array([r[2] for r in rows])
    w, b = np.zeros(len(used)), 0.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        w -= RATE * (x.T @ (p - y) / len(y) + L2 * w)
        b -= RATE * float((p - y).mean())
    weights = np.zeros(DIMENSIONS)
    weights[used] = w
    return weights, b


def probability(model: tuple[np.ndarray, float], host: str, path: str) -> float:
    at, value = vector(host, path)
    return float(1 / (1 + np.exp(-(model[0][at] @ value + model[1]))))


def judge(urls: DataFrame, url: str = "url", rules=RULES, limit: float = 0.5) -> DataFrame:
    """``urls`` with host, path, rule, verdict and, where no rule fits, the classifier's probability ``p_block``."""
    held = urls.sparkSession.sparkContext.broadcast(train())  # a fixed size

    @F.pandas_udf("double")
    def p_block(host: pd.Series, path: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for key in zip(host, path, strict=True):
            if key[0] is not None and key not in known:
                known[key] = probability(held.value, *key)
            out.append(known.get(key))
        return pd.Series(out, dtype="float64")

    others = [F.col(f"`{c}`") for c in urls.columns if c not in RESULT]
    row = urls.select(F.struct(*others).alias("row") if others else F.lit(None).alias("row"), *(c.alias(n) for c, n in zip(split(F.col(f"`{url}`")), ("host", "path"), strict=True)))
    row = row.select("row", F.struct("host", "path", *(c.alias(n) for c, n in zip(rule_of(F.col("host"), F.col("path"), rules), ("rule", "says"), strict=True))).alias("u"))
    open_ = F.col("u.rule").isNull()
    row = row.withColumn("p", p_block(F.when(open_, F.col("u.host")), F.when(open_, F.col("u.path"))))
    verdict = F.coalesce("u.says", F.when(F.col("p") >= limit, "block").otherwise("allow"))
    return row.select(*(["row.*"] if others else []), "u.host", "u.path", "u.rule", verdict.alias("verdict"), F.col("p").alias("p_block"))
