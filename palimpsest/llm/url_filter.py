"""URL filter: a few host and path rules, else a logistic regression.

The regression runs on hashed character 3-grams of host and path. It is
trained on a small labelled URL table by plain stochastic gradient descent, and
its weights, in millionths, are scored with DataFrame expressions only. Integer
weights make every sum exact and independent of order.

Defined results: a null url, or one without ://, has an empty host and path and
is judged by the few 3-grams of the empty parts; a URL of any length is read whole, in time
linear in its length; of rules of equal length the first listed wins; an empty
table gives an empty result; repeated rows, and rows of equal page_id, are judged
row by row; other columns are ignored.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

BUCKETS = 8192
SCALE = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


RULES = (
    UrlRule("block", "net/"),
    UrlRule("allow", "example.net/en/"),
    UrlRule("block", "example.com/de/"),
    UrlRule("allow", "org/fr/"),
)

#: Names, words and paths from which the labelled table is put together. All hosts
#: are invented. Spam and clean hosts get the same subdomains, endings and paths, so
#: none of these decides alone; clean words that look like spam words stand against them.
_SUBDOMAINS = ("", "www.", "m.", "blog.", "en.", "shop.")
_ENDINGS = ("example.com", "example.net", "example.org", "com", "net", "org", "example", "info")
_SPAM_WORDS = (
    "casino", "poker", "jackpot", "slots", "roulette", "betting", "bets", "bonus", "lottery", "win", "winner", "prize",
    "free", "cheap", "pills", "viagra", "pharma", "meds", "adult", "xxx", "porn", "sex", "cams", "dating", "x",
    "loans", "cash", "payday", "crypto", "profit", "replica", "crack", "keygen", "warez", "torrent",
    "spam", "malware", "phish", "verify", "ads", "adserver", "banner", "popup", "click", "track", "tracker", "farm",
)
_CLEAN_WORDS = (
    "city", "council", "garden", "history", "museum", "library", "school", "river", "weather", "journal", "science",
    "travel", "kitchen", "music", "theatre", "hospital", "winter", "window", "farming", "freedom", "adulthood", "addition",
    "railway", "tractor", "tracking-birds", "clicking", "spinach", "profile", "pilgrim", "casing", "better", "pottery",
    "xylophone", "sussex", "cashmere", "croquet", "chapel", "peach", "advent", "address", "shadow", "bonsai", "news", "daily",
    "nation", "station", "fashion", "friendship", "leadership", "question", "workshop", "bookshop", "relations", "education",
    "mountain", "northern", "brother", "weather-report", "another", "method", "thread", "health", "earth", "thirty", "together",
    "market", "forest", "harbour", "bridge", "letters", "painting", "building", "evening", "wonder", "lantern", "summer",
    "table", "vegetable", "noble", "family", "weekly", "reading", "hundred", "island", "planet", "orchard", "village", "society",
)
_CLEAN_PATHS = (
    "", "/", "/about", "/docs/install/", "/papers/1204.5678", "/guide/chapter-3.html", "/2019/07/summer-notes",
    "/a/how-to-bake-bread", "/wiki/River", "/history.html", "/team/contact.php", "/item?id=7",
)
_SPAM_PATHS = (
    "/casino/free-spins", "/viagra-cheap.php", "/xxx/teen", "/win/prize?id=1", "/buy-now/pills", "/bet/slots/jackpot",
    "/porn/hd", "/crack/keygen.exe", "/loan/fast-cash", "/verify/account/login.php", "/sex-chat/live", "/poker/bonus",
)
_LANGUAGES = ("en", "de", "fr", "es")


def _name(dice: random.Random) -> str:
    """An invented host name of letters that any language may put together."""
    parts = []
    for _ in range(dice.randint(2, 4)):
        ends = dice.choice(("", "", "n", "r", "s", "t", "l", "nd", "th", "ng"))
        parts.append(dice.choice("b c d f g h j k l m n p r s t v w z th sh ch tr st".split()) + dice.choice("aeiou") + ends)
    return "".join(parts)


def labelled_urls(seed: int = 5, rows: int = 3000) -> list[tuple[str, int]]:
    """The built-in table (url, 1 for block): `rows` rows made by rule from invented hosts.

    One half are clean hosts, a quarter spam hosts; a sixteenth are clean hosts with
    a spam path. Every kind draws subdomain, ending and the other path alike.
    """
    dice = random.Random(seed)

    def host(spam: bool) -> str:
        if spam:
            # The two words differ, so that no listed name is found by heart.
            words = dice.sample(_SPAM_WORDS, dice.choice((1, 2, 2, 2, 3)))
            if len("".join(words)) < 4:
                words.append(dice.choice(_SPAM_WORDS))
            core = dice.choice(("-", "-", "")).join(words)
        elif dice.random() < 0.5:
            core = _name(dice) + dice.choice(("", "", "-" + _name(dice)))
        else:
            core = dice.choice(("-", "-", "")).join(dice.sample(_CLEAN_WORDS, dice.choice((1, 2, 2))))
        return f"{dice.choice(_SUBDOMAINS)}{core}.{dice.choice(_ENDINGS)}"

    def path() -> str:
        if dice.random() < 0.5:
            return dice.choice(_CLEAN_PATHS)
        return f"/{dice.choice(_LANGUAGES)}/{dice.randint(1, 9999)}" + dice.choice(("", "/", ".html", "?page=2", "#top"))

    found = []
    for i in range(rows):
        kind = i % 16
        if kind < 5:
            found.append((f"{dice.choice(('http', 'https'))}://{host(True)}{path()}", 1))
        elif kind == 5:
            found.append((f"https://{host(False)}{dice.choice(_SPAM_PATHS)}", 1))
        else:
            found.append((f"{dice.choice(('http', 'https'))}://{host(False)}{path()}", 0))
    return found


def parse(url: str | None) -> tuple[str, str]:
    """Host and path of a URL, as `host_column` and `path_column` give them."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:end], rest[end:]
    cut = min((rest.find(c) for c in "?#" if c in rest), default=len(rest))
    return host.translate(str.maketrans(UPPER, LOWER)), rest[:cut]


def buckets(host: str, path: str) -> list[int]:
    """Buckets of the character 3-grams of `^host` and `path$`, with repeats."""
    found = []
    for side, text in enumerate((f"^{host}", f"{path}$")):
        for a, b, c in zip(text, text[1:], text[2:]):
            found.append((ord(a) * 961 + ord(b) * 31 + ord(c) + side * 1021) % BUCKETS)
    return found


@dataclass(frozen=True)
class UrlModel:
    """Weights and bias in millionths; a positive score means block."""

    weights: tuple[int, ...]
    bias: int

    def score(self, host: str, path: str) -> int:
        return self.bias + sum(self.weights[b] for b in buckets(host, path))


def train(rows: Sequence[tuple[str, int]], epochs: int = 40, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> UrlModel:
    """Logistic regression by seeded SGD on the driver.

    `rows` is the small labelled table, so its size is the caller's bound.
    """
    data = [(buckets(*parse(url)), label) for url, label in rows]
    weights, bias, order = [0.0] * BUCKETS, 0.0, list(range(len(data)))
    dice = random.Random(seed)
    for _ in range(epochs):
        dice.shuffle(order)
        for i in order:
            found, label = data[i]
            z = bias + sum(weights[b] for b in found)
            slope = rate * (label - 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            bias += slope
            for b in found:
                weights[b] += slope - rate * decay * weights[b]
    return UrlModel(tuple(round(w * SCALE) for w in weights), round(bias * SCALE))


@lru_cache(maxsize=1)
def default_model() -> UrlModel:
    return train(labelled_urls())


_URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def host_column(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path_column(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_column(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null; of equal length, the first as listed."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.pattern)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.lit(rule.pattern)).otherwise(found)
    return found


def score_column(host: Column, path: Column, model: UrlModel) -> Column:
    """The model's score in millionths."""
    weights = F.expr("array(" + ",".join(f"{w}L" for w in model.weights) + ")")

    def total(text: Column, side: int) -> Column:
        codes = F.transform(F.split(text, ""), lambda c: F.ascii(c))

        def summed(codes: Column) -> Column:
            grams = F.sequence(F.lit(0), F.size(codes) - 3)
            bucket = lambda i: F.pmod(
                F.get(codes, i) * 961 + F.get(codes, i + 1) * 31 + F.get(codes, i + 2) + side * 1021, F.lit(BUCKETS)
            )
            return F.when(F.size(codes) < 3, F.lit(0).cast("long")).otherwise(
                F.aggregate(grams, F.lit(0).cast("long"), lambda s, i: s + F.get(weights, bucket(i)))
            )

        return F.element_at(
            F.transform(F.array(F.filter(codes, lambda c: c != 0)), summed), 1
        )

    return F.lit(model.bias).cast("long") + total(F.concat(F.lit("^"), host), 0) + total(F.concat(path, F.lit("$")), 1)


def judge(pages: DataFrame, model: UrlModel | None = None, rules=RULES, url: str = "url") -> DataFrame:
    """Adds host, path, rule, score (model, in millionths) and verdict to (page_id, url)."""
    model = model or default_model()
    parsed = pages.select(
        "page_id", host_column(F.col(url)).alias("host"), path_column(F.col(url)).alias("path")
    )
    host, path = F.col("host"), F.col("path")
    scored = parsed.withColumn("rule", rule_column(host, path, rules)).withColumn(
        "score", score_column(host, path, model)
    )
    verdict = F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))
    for rule in rules:
        verdict = F.when(F.col("rule") == rule.pattern, F.lit(rule.verdict)).otherwise(verdict)
    return scored.withColumn("verdict", verdict)


def oracle_sql(model: UrlModel | None = None) -> str:
    model = model or default_model()
    weights = "[" + ",".join(map(str, model.weights)) + "]::BIGINT[]"
    fits = lambda r: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"
    by_length = sorted(RULES, key=lambda r: -len(r.pattern))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r.pattern}'" for r in by_length) + " END"
    verdict = "CASE " + " ".join(f"WHEN rule = '{r.pattern}' THEN '{r.verdict}'" for r in RULES) + " WHEN score > 0 THEN 'block' ELSE 'allow' END"
    total = lambda text, side: (
        f"coalesce((SELECT sum(wt.w[(unicode(substr({text}, i, 1)) * 961 + unicode(substr({text}, i + 1, 1)) * 31 "
        f"+ unicode(substr({text}, i + 2, 1)) + {side * 1021}) % {BUCKETS} + 1]) FROM unnest(range(1, length({text}) - 1)) AS u(i)), 0)"
    )
    return (
        f"WITH wt AS (SELECT {weights} AS w), "
        "h AS (SELECT page_id, translate(CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' "
        "ELSE regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*') END, "
        f"'{UPPER}', '{LOWER}') AS host, "
        "CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' "
        "ELSE regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END AS path FROM pages), "
        f"s AS (SELECT h.page_id, host, path, {rule} AS rule, "
        f"CAST({model.bias} + {total(chr(40) + chr(39) + '^' + chr(39) + ' || host)', 0)} + {total('(path || ' + chr(39) + '$' + chr(39) + ')', 1)} AS BIGINT) AS score "
        f"FROM h, wt) SELECT page_id, host, path, rule, score, {verdict} AS verdict FROM s"
    )
