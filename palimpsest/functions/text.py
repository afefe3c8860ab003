"""The tokenizer, once as a column and once in Python for query texts.

A text is cut at Unicode white space and each piece trimmed of what is neither
alphabetic nor numeric; inside a piece, runs of CJK ideographs give their
bigrams (a run of one gives itself) and everything else is one lower-case
token. Optionally stop words are left out.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, functions as F

from palimpsest.functions.scalar import let

# The stop words.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it",
    "its", "of", "on", "or", "that", "the", "to", "was", "were", "will", "with", "的", "了", "是",
    "在", "和", "与", "或",
)
# The ideograph blocks that are cut into bigrams.
CJK_RANGES = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F))

# The characters that Unicode calls white space.
WHITE_SPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u0020\u0085\u00a0\u1680\u2000\u2001\u2002\u2003"
    "\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

_JAVA_CJK = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in CJK_RANGES)
#: Properties are one look-up a character; a class that lists its members tries them one after the other.
_JAVA_WORD = r"[\p{IsAlphabetic}\p{N}]"
#: All but `WHITE_SPACE`.
_JAVA_SOLID = r"\P{IsWhite_Space}"
#: From a piece's first to its last character that is alphabetic or numeric.
_JAVA_PIECE = f"{_JAVA_WORD}(?:{_JAVA_SOLID}*{_JAVA_WORD})?"


def _cut(pieces: Column) -> Column:
    """Splits pieces at the borders of CJK runs, and these into bigrams."""
    runs = F.flatten(F.transform(pieces, lambda p: F.regexp_extract_all(p, F.lit(f"[{_JAVA_CJK}]+|[^{_JAVA_CJK}]+"), F.lit(0))))

    def pair(run: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2))
        )

    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(rf"\A[{_JAVA_CJK}]"), pair(r)).otherwise(F.array(r))))


def tokenize(text: Column, stopwords: bool = True) -> Column:
    """Tokens of each text, in order; a null text has none.

    One scan finds the pieces; they are lower-cased together, and only texts
    that have ideographs are cut further.
    """
    text = F.coalesce(text, F.lit(""))
    pieces = F.regexp_extract_all(text, F.lit(_JAVA_PIECE), F.lit(0))
    cut = let(pieces, lambda p: F.when(F.array_join(p, "").rlike(f"[{_JAVA_CJK}]"), _cut(p)).otherwise(p))
    lower = let(cut, lambda p: F.when(F.size(p) == 0, p).otherwise(F.split(F.lower(F.array_join(p, "\n")), "\n", -1)))
    return F.filter(lower, lambda t: ~t.isin(*STOPWORDS)) if stopwords else lower


@lru_cache(maxsize=1)
def _patterns():
    import regex

    cjk = "".join(f"{chr(a)}-{chr(b)}" for a, b in CJK_RANGES)
    edges = regex.compile(r"\A[^\p{Alphabetic}\p{N}]+|[^\p{Alphabetic}\p{N}]+\Z")
    return regex.compile(r"\p{White_Space}+"), edges, regex.compile(f"[{cjk}]+|[^{cjk}]+"), regex.compile(f"[{cjk}]")


def tokenize_text(text: str | None, stopwords: bool = True) -> list[str]:
    """The tokens of one text on the driver, equal to the column's."""
    space, edges, runs, cjk = _patterns()
    found: list[str] = []
    for piece in space.split(text or ""):
        for run in runs.findall(edges.sub("", piece)):
            if cjk.match(run):
                found += [run[i : i + 2] for i in range(max(1, len(run) - 1))]
            else:
                found.append(run.lower())
    return [t for t in found if t not in STOPWORDS] if stopwords else found
