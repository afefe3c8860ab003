"""BM25 keyword search, by scan or over an inverted index.

score = sum over query terms of idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len / avgdl)),
idf = ln((N - df + 0.5) / (df + 0.5) + 1). N, df and avgdl count all visible
documents with a token, whatever the filter; the filter decides only which
documents are scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.functions.scalar import let
from palimpsest.functions.text import tokenize, tokenize_text
from palimpsest.functions.vector import best_first
from palimpsest.operators.knn import ranked
from palimpsest.sources.scratch import saved

# BM25's usual constants.
K1, B = 1.2, 0.75


def idf(n: Column, df: Column) -> Column:
    return F.ln((n - df + 0.5) / (df + 0.5) + 1.0)


def term_weight(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * length / mean))


def _counted(docs: DataFrame, terms: list[str], stopwords: bool, text: str, rowid: str, where: Column | None) -> DataFrame:
    """Per document its length in tokens and its count of each term; one pass, no shuffle."""
    def count(tokens: Column) -> Column:
        found = F.filter(tokens, lambda x: x.isin(*terms)) if terms else F.slice(tokens, 1, 0)
        tf = let(found, lambda f: F.transform(F.lit(terms).cast("array<string>"), lambda term: F.size(F.filter(f, lambda x: x == term))))
        return F.struct(F.size(tokens).alias("length"), tf.alias("tf"))

    wanted = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    # Exploding one struct keeps later filters from evaluating the tokens again below the projection.
    once = F.explode(F.array(let(tokenize(F.col(text), stopwords), count)))
    counted = docs.select(F.col(rowid).alias("rowid"), wanted.alias("wanted"), once.alias("c"))
    return counted.select("rowid", "wanted", "c.length", "c.tf").where("length > 0")


def search(
    docs: DataFrame, query: str, k: int, stopwords: bool = True, where: Column | None = None, text: str = "text", rowid: str = "rowid",
) -> DataFrame:
    """(rowid, score) of the k best documents for one query text.

    The query's terms are few, so each document counts just these. The counts are
    narrow and written to the shared folder, so texts are read and tokenized once;
    statistics are one row, which enters the scoring scan as a scalar subquery.
    Nothing is shuffled but partial sums and k rows a task.
    """
    terms = sorted(set(tokenize_text(query, stopwords)))
    counted = _counted(docs, terms, stopwords, text, rowid, where)
    if not terms:
        return counted.select("rowid", F.lit(0.0).alias("score")).limit(0)
    counted = saved(counted, "counts")
    stats = counted.agg(
        F.struct(
            F.count(F.lit(1)).cast("double").alias("n"),
            F.avg("length").alias("mean"),
            F.array(*(F.count_if(F.get("tf", i) > 0).cast("double") for i in range(len(terms)))).alias("df"),
        ).alias("s")
    ).scalar()
    parts = [
        idf(stats["n"], F.get(stats["df"], i)) * term_weight(F.get("tf", i).cast("double"), F.col("length"), stats["mean"])
        for i in range(len(terms))
    ]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    matched = counted.where(F.col("wanted") & F.exists("tf", lambda n: n > 0)).select("rowid", total.alias("score"))
    return matched.orderBy(*best_first(True, F.col("score"), F.col("rowid"))).limit(k)


def postings(docs: DataFrame, stopwords: bool = True, text: str = "text", rowid: str = "rowid", by: tuple[str, ...] = ()) -> DataFrame:
    """The inverted index: (*by, term, rowid, tf, length), one row a document and term.

    A document's tokens are sorted and counted by runs where it is read, so the
    index is made without a shuffle; write it before using it more than once.
    """

    def counted(tokens: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(tokens) - 1)
        starts = F.filter(places, lambda i: (i == 0) | (F.get(tokens, i) != F.get(tokens, i - 1)))
        runs = let(
            starts,
            lambda s: F.transform(
                s,
                lambda i, j: F.struct(
                    F.get(tokens, i).alias("term"), (F.coalesce(F.get(s, j + 1), F.size(tokens)) - i).alias("tf"), F.size(tokens).alias("length")
                ),
            ),
        )
        return F.when(F.size(tokens) > 0, runs)

    terms = let(let(tokenize(F.col(text), stopwords), F.sort_array), counted)
    found = docs.select(*by, F.col(rowid).alias("rowid"), F.explode(terms).alias("t"))
    return found.select(*by, "t.term", "rowid", "t.tf", "t.length")


def statistics(index: DataFrame, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Of an index: one row (n, mean), and (term, df)."""
    lengths = index.groupBy(*by, "rowid").agg(F.first("length").alias("length"))
    return (
        lengths.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("length").alias("mean")),
        index.groupBy(*by, "term").agg(F.count(F.lit(1)).cast("double").alias("df")),
    )


def batch_search(index: DataFrame, queries: DataFrame, k: int, stopwords: bool = True) -> DataFrame:
    """(query_id, rowid, score, rank) for each of `queries` (query_id, qtext) over an index.

    Query terms meet the postings in an equi-join, whose sides Spark may
    broadcast or split by their measured size; sums combine before the shuffle.
    Scores have nine decimals, since the order in which parts are summed is open:
    so equal documents have equal scores, and the smaller id goes first.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(tokenize(F.col("qtext"), stopwords))).alias("term"))
    totals, frequencies = statistics(index)
    wanted = index.join(terms.select("term").distinct(), "term", "left_semi")
    weighed = wanted.join(frequencies, "term")
    stats = totals.agg(F.struct(F.first("n").alias("n"), F.first("mean").alias("mean")).alias("s")).scalar()
    scored = weighed.select(
        "term", "rowid", (idf(stats["n"], F.col("df")) * term_weight(F.col("tf").cast("double"), F.col("length"), stats["mean"])).alias("part")
    )
    sums = terms.join(scored, "term").groupBy("query_id", "rowid").agg(F.round(F.sum("part"), 9).alias("score"))
    return ranked(sums, k, True)
