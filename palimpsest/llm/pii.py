"""Personal data: patterns propose spans, checksums confirm, context scores.

Only DataFrame expressions run here. A span is (start, end, kind) in code
points, end exclusive. Secrets count as personal data: access keys of known formats,
and long runs of letters and digits near a word such as "token". Defined results: a
null or empty text has no spans; a text of any length is searched whole; an empty
table gives an empty result; overlapping kinds are all reported, by start and then
as listed; repeated rows are judged alike; other columns of the input, whatever
their names, pass through untouched.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.llm.common import fresh, let, text_or_empty


@dataclass(frozen=True)
class Kind:
    """One kind of personal data.

    pattern: proposes spans, leftmost and not overlapping. Possessive loops
    and the lookbehind on the pattern's own class keep it linear on long runs.
    confirm: the check that a proposed span must pass.
    score: its confidence in percent; context words nearby add `bonus`.
    base: such spans are reported whatever their score.
    """

    name: str
    pattern: str
    confirm: Callable[[Column], Column]
    score: int
    context: str
    base: bool = True
    bonus: int = 15


def _digits(column: Column) -> Column:
    return F.regexp_replace(column, "[^0-9]", "")


def _is_card(found: Column) -> Column:
    digits = _digits(found)
    return F.length(digits).between(12, 19) & _luhn(digits)


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _is_ip(found: Column) -> Column:
    part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return found.rlike(rf"\A{part}\.{part}\.{part}\.{part}\z")


def _is_phone(found: Column) -> Column:
    return F.length(_digits(found)).between(9, 15)


def _is_iban(found: Column) -> Column:
    plain = F.translate(found, " ", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    values = F.split(turned, "")

    def step(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        letter = code >= 65
        value = F.when(letter, code - 55).otherwise(code - 48)
        return ((rest * F.when(letter, 100).otherwise(10) + value) % 97).cast("int")

    return (F.length(plain) <= 34) & (
        F.aggregate(F.filter(values, lambda c: c != ""), F.lit(0), step) == 1
    )


def _is_ssn(found: Column) -> Column:
    return ~found.rlike(r"\A(?:000|666|9[0-9]{2})-|-00-|-0000\z")


def _is_mixed(found: Column) -> Column:
    """Letters and digits: neither a word nor a number."""
    return found.rlike("[0-9]") & found.rlike("[A-Za-z]")


#: The fixed formats of common services' access keys are among the patterns.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda c: F.lit(True), 85, "(?i)mail|contact|kontakt|correo|courriel"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         _is_ip, 60, "(?i)address|server|host|login|ip"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", _is_card, 80, "(?i)card|visa|payment|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", _is_phone, 60, "(?i)phone|tel|call|fax|mobile"),
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b",
         _is_iban, 85, "(?i)iban|account|bank|konto|compte|cuenta", base=False),
    Kind("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
         _is_ssn, 40, "(?i)ssn|social security", base=False),
    Kind("key", r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}"
         r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
         _is_mixed, 80, "(?i)token|secret|passw|api|key|auth|bearer", base=False),
    Kind("token", r"(?:\G|(?<![A-Za-z0-9]))[A-Za-z0-9]{32,}+",
         _is_mixed, 40, "(?i)token|secret|passw|api|key|auth|bearer", base=False),
)
#: An added span is reported from this score on.
MIN_SCORE = 50
#: Context words count within so many code points before or after a span.
CONTEXT_CHARS = 40

_SPAN = "struct<s:int,k:int,e:int,score:int>"
#: A text without these can't hold the kind; the test is far cheaper than the pattern.
_NEEDS = {"email": "@", "phone": "+", "ip": ".", "ssn": "-"}


def _kind_spans(text: Column, number: int, kind: Kind, min_score: int) -> Column:
    none = F.array().cast(f"array<{_SPAN}>")

    def located(found: Column) -> Column:
        gaps = F.split(text, kind.pattern, -1)

        def spans(gaps: Column) -> Column:
            def step(state: Column, i: Column) -> Column:
                text_i = F.get(found, i)
                start = state["at"] + F.length(F.get(gaps, i))
                end = start + F.length(text_i)
                before = F.substring(
                    text, F.greatest(start - CONTEXT_CHARS, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT_CHARS))
                )
                after = F.substring(text, end + 1, F.lit(CONTEXT_CHARS))
                near = before.rlike(kind.context) | after.rlike(kind.context)
                score = F.lit(kind.score) + F.when(near, kind.bonus).otherwise(0)
                wanted = kind.confirm(text_i)
                if not kind.base:
                    wanted = wanted & (score >= min_score)
                span = F.struct(
                    start.alias("s"), F.lit(number).alias("k"), end.alias("e"), score.cast("int").alias("score")
                )
                return F.struct(
                    end.cast("int").alias("at"),
                    F.when(wanted, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"),
                )

            start = F.struct(F.lit(0).alias("at"), none.alias("out"))
            steps = F.sequence(F.lit(0), F.size(found) - 1)
            return F.aggregate(steps, start, step, lambda s: s["out"])

        return F.when(F.size(found) == 0, none).otherwise(let(gaps, spans))

    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    out = let(found, located)
    if kind.name in _NEEDS:
        return F.when(F.contains(text, F.lit(_NEEDS[kind.name])), out).otherwise(none)
    return out


def spans_column(text: Column, kinds=KINDS, min_score: int = MIN_SCORE) -> Column:
    """All spans of a text: array of (s, k, e, score) by start, then kind as listed."""
    return F.sort_array(F.concat(*(_kind_spans(text, i, k, min_score) for i, k in enumerate(kinds))))


def _listed(spans: Column, kinds=KINDS) -> Column:
    names = F.array(*(F.lit(k.name) for k in kinds))
    return F.array_join(
        F.transform(
            spans,
            lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string")),
        ),
        ",",
    )


def find(docs: DataFrame, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """Adds the array column `out` with each text's spans; see `spans_column`."""
    return docs.withColumn(out, spans_column(text_or_empty(text)))


def report(docs: DataFrame) -> DataFrame:
    """Per document the counts, digest and list of its spans.

    Null texts count as empty: no spans, and the digest of an empty string.
    Rows with a null or repeated doc_id are reported row by row.
    """
    base = [i for i, k in enumerate(KINDS) if k.base]
    found = docs.select("doc_id", spans_column(text_or_empty("text")).alias("spans"))

    def count(number: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["k"] == number)).cast("long").alias(f"n_{KINDS[number].name}")

    counts = [count(i) for i in base]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_listed(F.filter("spans", lambda x: x["k"] <= max(base))), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda x: x["score"].cast("string")), ",").alias("scores"),
        *(count(i) for i in range(len(KINDS)) if i not in base),
        F.size("spans").cast("long").alias("n_spans"),
    )


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """Replaces each span by its kind in angle brackets; overlapping spans become one.

    Keeps all columns and rows; a null text stays null. `n_chars`, where the
    table has it, follows the new text.
    """
    spans_name = fresh(docs, "_pii_spans")
    names = F.array(*(F.lit(f"<{k.name.upper()}>") for k in KINDS))
    whole = F.col(text)

    def step(state: Column, x: Column) -> Column:
        apart = x["s"] >= state["at"]
        between = F.substring(whole, state["at"] + 1, x["s"] - state["at"])
        return F.struct(
            F.greatest(state["at"], x["e"]).alias("at"),
            F.when(apart, F.concat(state["out"], F.array(between, F.get(names, x["k"]))))
            .otherwise(state["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(
        F.col(spans_name), start, step,
        lambda s: F.concat(F.array_join(s["out"], ""), F.substring(whole, s["at"] + 1, F.length(whole))),
    )
    done = docs.withColumn(spans_name, spans_column(text_or_empty(text)))
    done = done.withColumn(text, F.when(F.size(spans_name) == 0, whole).otherwise(clean)).drop(spans_name)
    if n_chars and n_chars.lower() in (c.lower() for c in docs.columns):
        kind = docs.schema[n_chars].dataType
        done = done.withColumn(n_chars, F.coalesce(F.length(text).cast(kind), F.col(n_chars)))
    return done


def _sql_regex(kind: Kind) -> str:
    plain = re.sub(r"^\(\?:\\G\|\(\?<!\[[^\]]*\]\)\)", "", kind.pattern)
    return plain.replace("++", "+").replace("}+", "}")


def _sql() -> str:
    """The same report for DuckDB: gaps and matches of each pattern give the places."""
    part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = (
        f"(list_sum(list_transform(range(1, length({digits}) + 1), lambda i: "
        f"CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({digits}), i, 1) AS INT) "
        f"WHEN CAST(substr(reverse({digits}), i, 1) AS INT) > 4 THEN CAST(substr(reverse({digits}), i, 1) AS INT) * 2 - 9 "
        f"ELSE CAST(substr(reverse({digits}), i, 1) AS INT) * 2 END)) % 10 = 0)"
    )
    plain = "replace(m, ' ', '')"
    turned = f"(substr({plain}, 5) || substr({plain}, 1, 4))"
    mod97 = (
        f"(list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length({turned}) + 1), "
        f"lambda i: unicode(substr({turned}, i, 1))::BIGINT)), "
        f"lambda r, c: (r * (CASE WHEN c >= 65 THEN 100 ELSE 10 END) + c - (CASE WHEN c >= 65 THEN 55 ELSE 48 END)) % 97) = 1)"
    )
    confirm = {
        "email": "true",
        "ip": rf"regexp_full_match(m, '{part}\.{part}\.{part}\.{part}')",
        "card": f"length({digits}) BETWEEN 12 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"length({plain}) <= 34 AND {mod97}",
        "ssn": r"NOT regexp_matches(m, '^(?:000|666|9[0-9]{2})-|-00-|-0000$')",
        "key": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')",
        "token": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')",
    }
    parts = []
    for i, k in enumerate(KINDS):
        regex = _sql_regex(k)
        before = f"substr(t, greatest(s - {CONTEXT_CHARS}, 0) + 1, least(s, {CONTEXT_CHARS}))"
        after = f"substr(t, s + length(m) + 1, {CONTEXT_CHARS})"
        score = f"{k.score} + CASE WHEN regexp_matches({before}, '{k.context}') OR regexp_matches({after}, '{k.context}') THEN {k.bonus} ELSE 0 END"
        keep = confirm[k.name] + ("" if k.base else f" AND {score} >= {MIN_SCORE}")
        parts.append(
            f"SELECT r, {i} AS k, '{k.name}' AS kind, s, s + length(m) AS e, {score} AS score FROM ("
            f"SELECT r, t, ms[i] AS m, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) "
            f"+ coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s FROM ("
            f"SELECT r, t, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM ("
            f"SELECT r, t, regexp_extract_all(t, '{regex}') AS ms, string_split_regex(t, '{regex}') AS gs FROM d) WHERE len(ms) > 0)) WHERE {keep}"
        )
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE k = {i}) AS BIGINT) AS n_{k.name}" for i, k in enumerate(KINDS))
    item = "kind || ':' || s || ':' || e"
    last = max(i for i, k in enumerate(KINDS) if k.base)
    return (
        "WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), "
        f"x AS ({' UNION ALL '.join(parts)}) "
        f"SELECT doc_id, {counts}, sha256(coalesce(string_agg({item}, ',' ORDER BY s, k, e) FILTER (WHERE k <= {last}), '')) AS base_sha256, "
        f"coalesce(string_agg({item}, ',' ORDER BY s, k, e), '') AS spans, "
        "coalesce(string_agg(CAST(score AS VARCHAR), ',' ORDER BY s, k, e), '') AS scores, CAST(count(k) AS BIGINT) AS n_spans "
        "FROM d LEFT JOIN x USING (r) GROUP BY r, doc_id"
    )


ORACLE_SQL = _sql()
