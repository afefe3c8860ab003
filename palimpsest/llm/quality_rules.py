"""Quality rules as a short-circuit cascade.

Each rule is a DataFrame condition that a good text meets. On a sample the
cascade estimates what a rule costs and how many texts it rejects, and then
tests the rules in the order of rejections per cost; a text that one rule
rejects is not tested further. The order only decides the work: the verdict is
the conjunction of all rules in any order.

Defined results: a null or empty text has no words and is rejected by
`enough_words`; a text of any length is read whole; an empty table gives an empty
result; ties between rules keep the order as listed; repeated rows are judged
alike; other columns pass through.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.llm.common import BLANKS, WORD_REGEX, char_class, let, text_or_empty

SYMBOLS = "#*$%&|<>"
DIGITS = "0123456789"
#: Capitals of the Latin-1 range.
CAPITALS = "".join(c for c in map(chr, range(0x41, 0xDF)) if c.isupper())
_MARKS = char_class(CAPITALS + DIGITS + SYMBOLS)
#: The sample from which costs and selectivities are estimated: at most so many rows,
#: of together about so many bytes. It never changes a verdict, only the order of the tests.
SAMPLE_ROWS = 512
SAMPLE_BYTES = 2 << 20
#: Each cost is the least of so many runs, after one that isn't counted.
TIMED_RUNS = 3
#: Low bits that hold a window's place while windows are sorted as plain longs.
_PLACE_BITS = 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_REGEX), F.lit(0))


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def marks(text: Column) -> Column:
    """The text's capitals, digits and symbols, in order, from one scan."""
    return F.array_join(F.regexp_extract_all(text, F.lit(_MARKS), F.lit(0)), "")


def _among(marks: Column, chars: str) -> Column:
    return (F.length(marks) - F.length(F.translate(marks, chars, ""))).cast("long")


def n_symbols(marks: Column) -> Column:
    return _among(marks, SYMBOLS)


def n_digits(marks: Column) -> Column:
    return _among(marks, DIGITS)


def n_upper(marks: Column) -> Column:
    return F.length(F.translate(marks, SYMBOLS + DIGITS, "")).cast("long")


def _word_lines(lines: Column) -> Column:
    return F.filter(lines, lambda x: F.length(F.translate(x, BLANKS, "")) > 0)


def line_counts(text: Column) -> Column:
    """Struct of n_dup_lines and, where there are any, n_lines: lines with a word."""

    def exact(lines: Column) -> Column:
        return F.struct(
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(lines).cast("long").alias("n_lines"),
        )

    def counted(lines: Column) -> Column:
        none = F.struct(F.lit(0).cast("long").alias("n_dup_lines"), F.lit(0).cast("long").alias("n_lines"))
        repeats = F.size(F.array_distinct(lines)) < F.size(lines)
        return F.when(repeats, let(_word_lines(lines), exact)).otherwise(none)

    return let(F.split(text, "\n", -1), counted)


def n_repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more, each word once.

    Windows are compared by 64-bit hash. A hash set tells whether any repeats;
    if so, the windows are sorted as longs of the hash's upper bits and the
    place, and neighbours that agree are the repeats. Should two hashes differ
    only in their lower bits, or a text be too long for the place's bits, whole
    (hash, place) pairs are sorted instead. Either way n log n in the words.
    """
    mask = (1 << _PLACE_BITS) - 1

    def windows(words: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(words) - 3)
        return F.transform(
            places, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        )

    def covered(places: Column) -> Column:
        """Words under windows at the sorted places."""
        steps = F.transform(places, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def by_pairs(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def found(placed: Column) -> Column:
            same = lambda x, j: F.coalesce(x["h"] == F.get(placed, j)["h"], F.lit(False))
            return F.transform(F.filter(placed, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])

        return let(F.sort_array(let(placed, found)), covered)

    def by_longs(hashes: Column) -> Column:
        packed = F.sort_array(
            F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")))
        )
        place = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")

        def found(packed: Column) -> Column:
            upper = lambda x: F.shiftright(x, _PLACE_BITS)
            same = lambda x, j: F.coalesce(upper(x) == upper(F.get(packed, j)), F.lit(False))
            twice = F.filter(packed, lambda x, j: same(x, j - 1) | same(x, j + 1))

            def agreed(twice: Column) -> Column:
                whole = lambda x: F.get(hashes, place(x))
                odd = F.exists(
                    F.transform(
                        twice,
                        lambda x, j: (upper(x) == upper(F.get(twice, j + 1))) & (whole(x) != whole(F.get(twice, j + 1))),
                    ),
                    lambda x: F.coalesce(x, F.lit(False)),
                )
                places = F.sort_array(F.transform(twice, place))
                return F.when(odd, by_pairs(hashes)).otherwise(let(places, covered))

            return let(twice, agreed)

        return F.when(F.size(hashes) > mask, by_pairs(hashes)).otherwise(let(packed, found))

    def counted(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(by_longs(hashes))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(
        let(windows(words), counted).cast("long")
    )


@dataclass(frozen=True)
class Rule:
    """`accepts` takes the columns of a text, its words and its marks and gives a boolean column."""

    name: str
    accepts: Callable[[Column, Column, Column], Column]
    base: bool = False


def _usual_marks(text: Column, words: Column, marks: Column) -> Column:
    return let(
        F.struct(marks.alias("m"), word_chars(words).alias("c")),
        lambda x: (n_symbols(x["m"]) * 100 <= F.size(words) * 10)
        & (n_upper(x["m"]) * 100 <= x["c"] * 50)
        & (n_digits(x["m"]) * 100 <= x["c"] * 30),
    )


def _few_repeated_lines(text: Column, words: Column, marks: Column) -> Column:
    return let(line_counts(text), lambda x: x["n_dup_lines"] * 100 <= x["n_lines"] * 50)


def _usual_word_length(text: Column, words: Column, marks: Column) -> Column:
    return let(word_chars(words), lambda c: (c >= F.size(words) * 2) & (c <= F.size(words) * 12))


RULES = (
    Rule("enough_words", lambda t, w, m: F.size(w) >= 50, base=True),
    Rule("few_repeated_words", lambda t, w, m: n_repeat_words(w) * 100 <= F.size(w) * 50, base=True),
    Rule("usual_marks", _usual_marks),
    Rule("few_repeated_lines", _few_repeated_lines),
    Rule("usual_word_length", _usual_word_length),
)


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def sample_texts(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """The first few whole texts as a local frame with the column t.

    A limit at the top of a plan is taken from as few tasks as have enough rows,
    so neither it nor anything else here grows with the table. Sizes are asked for
    first, so that the texts stay within `sample_bytes`, but for a first one that is larger.
    """
    texts = docs.select(text_or_empty(text).alias("t"))
    held, rows = 0, 0
    for size, in texts.select(F.octet_length("t")).limit(sample_rows).collect():
        held += size
        if rows and held > sample_bytes:
            break
        rows += 1
    # Rows that stay in the JVM: a frame made from Python rows would need a Python worker to read them.
    spark, taken = docs.sparkSession, texts.limit(rows)._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(taken.collectAsList(), taken.schema()), spark).coalesce(1)


def estimate(docs: DataFrame, rules=RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """Each rule's cost and share of rejections on a bounded sample.

    The cost is the time that the rule adds to cutting the sample's words, from
    warm runs; so neither starting a job nor the shared cutting counts.
    """
    sample = sample_texts(docs, text, sample_rows)

    def run(rejected: Column) -> DataFrame:
        return sample.agg(F.count_if(rejected))

    rows = sample.count()
    # The first one tests nothing; all take turns, so that each runs equally warm.
    runs = [run(let(words(F.col("t")), lambda w: F.size(w) < 0)), *(run(~cascade(F.col("t"), [rule])) for rule in rules)]
    seconds, rejected = [float("inf")] * len(runs), [0] * len(runs)
    for turn in range(TIMED_RUNS + 1):
        for i, frame in enumerate(runs):
            began = time.perf_counter()
            rejected[i] = frame.first()[0]
            if turn:
                seconds[i] = min(seconds[i], time.perf_counter() - began)
    return [
        Estimate(rule, max(taken - seconds[0], 1e-4), (n + 1) / (rows + 2)) for rule, taken, n in zip(rules, seconds[1:], rejected[1:])
    ]


def ordered(estimates: list[Estimate]) -> list[Rule]:
    return [e.rule for e in sorted(estimates, key=lambda e: -e.worth)]


def _verdict(rules, text: Column, words: Column, marks: Column) -> Column:
    verdict = F.lit(True)
    for rule in reversed(list(rules)):
        verdict = F.when(~rule.accepts(text, words, marks), F.lit(False)).otherwise(verdict)
    return verdict


def cascade(text: Column, rules) -> Column:
    """Whether all rules accept; later rules aren't evaluated once one rejects."""
    return let(words(text), lambda w: _verdict(rules, text, w, marks(text)))


def keep_good(docs: DataFrame, rules=RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of `docs` that pass every rule, all columns as they were."""
    order = ordered(estimate(docs, rules, text, sample_rows))
    return docs.where(cascade(text_or_empty(text), order))


def report(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document the counts behind the base rules and the verdict.

    The base rules have their counts in the result anyway, so only the others
    run as a cascade, and only on texts that the base rules accept.
    """
    order = ordered(estimate(docs, [r for r in rules if not r.base], "text", sample_rows))

    def measured(t: Column, w: Column, m: Column) -> Column:
        counts = F.struct(
            F.size(w).cast("long").alias("n_words"),
            word_chars(w).alias("word_chars"),
            n_symbols(m).alias("n_symbols"),
            line_counts(t)["n_dup_lines"].alias("n_dup_lines"),
            n_repeat_words(w).alias("n_repeat_words"),
        )

        def judged(c: Column) -> Column:
            failed = (c["n_words"] < 50) | (c["n_repeat_words"] * 100 > c["n_words"] * 50)
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
            return F.struct(
                *(c[n].alias(n) for n in names),
                failed.alias("base_failed"),
                F.when(failed, F.lit(False)).otherwise(_verdict(order, t, w, m)).alias("kept"),
            )

        return let(counts, judged)

    text = text_or_empty("text")
    found = docs.select(
        "doc_id", let(words(text), lambda w: let(marks(text), lambda m: measured(text, w, m))).alias("_m")
    )
    return found.select("doc_id", "_m.*")


ORACLE_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (SELECT r, i, w[i] AS a, w[i+1] AS b, w[i+2] AS c
      FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
p AS (SELECT r, list(i) AS places FROM g GROUP BY r, a, b, c HAVING count(*) > 1),
n AS (SELECT r, count(DISTINCT place) AS n FROM (
        SELECT r, i + unnest([0, 1, 2]) AS place FROM (SELECT r, unnest(places) AS i FROM p)) GROUP BY r),
f AS (
  SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
         CAST(coalesce(n.n, 0) AS BIGINT) AS n_repeat_words,
         length(t) - length(regexp_replace(t, '[A-ZÀ-ÖØ-Þ]', '', 'g')) AS n_upper,
         length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS n_digits
  FROM d LEFT JOIN n USING (r)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_symbols * 100 <= n_words * 10 AND n_dup_lines * 100 <= n_lines * 50
       AND word_chars BETWEEN n_words * 2 AND n_words * 12
       AND n_upper * 100 <= word_chars * 50 AND n_digits * 100 <= word_chars * 30 AS kept
FROM b
"""
