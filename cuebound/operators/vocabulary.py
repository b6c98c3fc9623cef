"""Vocabulary of texts: word frequencies, richness, top words, TF-IDF similarity, domains."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuebound.functions import text as X
from cuebound.operators.summary import rounded
from cuebound.session import written


def word_counts(rows: DataFrame, word_list: Column, *keys: str) -> DataFrame:
    """(*keys, word, n): how often each word of an array column occurs. Only keys and words are exploded and shuffled, after
    partial aggregation."""
    return rows.select(*keys, F.explode(word_list).alias("word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))


def richness(counts: DataFrame, *keys: str) -> DataFrame:
    """Per key: words, different words, words that occur once, and the ratios of both to words and different words."""
    grouped = counts.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_words"), F.count("word").alias("n_unique"), F.count_if(F.col("n") == 1).alias("n_hapax"))
    return grouped.withColumn("richness", rounded(F.coalesce(F.try_divide("n_unique", "n_words"), F.lit(0.0)))).withColumn("hapax_share", rounded(F.coalesce(F.try_divide(F.col("n_hapax") * 100, F.col("n_unique")), F.lit(0.0))))


def top_words(counts: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k most frequent words (per key); ties go to the smaller word."""
    if not keys:
        return counts.orderBy(F.desc("n"), "word").limit(k)
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "word")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def tfidf_similarity(rows: DataFrame, key: str, order: str, text: str, max_terms: int = 1000) -> DataFrame:
    """(a, b, similarity) of each two keys, a < b: the cosine of their TF-IDF vectors, 0 where they share no term.

    A key's document is its cleaned texts joined in order; terms are tokens of two or more word characters and pairs of
    neighbours in the document, across texts too. order is a whole number. The max_terms most frequent terms count (ties: the smaller term); idf is
    ln((1 + N) / (1 + df)) + 1; vectors have length 1. A key without terms has similarity 0; NULL is not a key.

    The pairs grow with the square of the number of keys, which is the result asked for; the keys are topics, not rows. Keys are in
    blocks of about BLOCK by their hash; a task takes the vectors of two blocks (at most max_terms numbers each) and multiplies them.
    """
    tokens = F.regexp_extract_all(X.clean_spaced(F.col(text)), F.lit(f"[{X.WORD}]{{2,}}"), F.lit(0))
    docs = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(order).cast("bigint").alias("order"), tokens.alias("t")).where("size(t) > 0")
    inside = F.transform(F.arrays_zip(F.slice("t", 1, F.size("t") - 1), F.slice("t", 2, F.size("t") - 1)), lambda p: F.concat_ws(" ", p["0"], p["1"]))
    terms = docs.select("key", F.explode(F.concat("t", inside)).alias("term")).unionByName(_seams(docs))
    tf = written(terms.groupBy("key", "term").agg(F.count(F.lit(1)).alias("n")), "terms")  # read three times below
    kept = tf.groupBy("term").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("df")).orderBy(F.desc("total"), "term").limit(max_terms)
    kept = kept.withColumn("place", F.row_number().over(Window.orderBy("term")) - 1)  # at most max_terms rows
    names = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct()
    n_keys = names.count()
    weights = tf.join(F.broadcast(kept), "term").select("key", "place", (F.col("n") * (F.log((1 + n_keys) / (1 + F.col("df"))) + 1)).alias("w"))
    vectors = weights.groupBy("key").agg(F.collect_list(F.struct("place", "w")).alias("v"))
    blocks = max(1, -(-n_keys // BLOCK))
    placed = names.join(vectors, "key", "left").withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    sent = placed.withColumn("other", other).select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "v.place", "v.w")
    found = sent.groupBy("i", "j").applyInPandas(_multiplied(max_terms), "a string, b string, similarity double")
    return found.select("a", "b", rounded(F.col("similarity")).alias("similarity"))


#: Keys in a block of tfidf_similarity.
BLOCK = 1024


def _multiplied(terms: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The cosines of two blocks' vectors."""

    def unit(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        matrix = np.zeros((len(pdf), terms))
        for row, place, w in zip(matrix, pdf["place"], pdf["w"], strict=True):
            if place is not None:
                row[np.asarray(place, np.int64)] = w
        length = np.sqrt((matrix * matrix).sum(1, keepdims=True))
        return pdf["key"].to_numpy(object), matrix / np.where(length == 0, 1, length)

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        pdf = pdf.sort_values("key")
        (a, x), (b, y) = unit(pdf[pdf["block"] == i]), unit(pdf[pdf["block"] == j])
        cosines = x @ y.T
        at = np.triu_indices(len(a), 1) if i == j else tuple(np.indices(cosines.shape).reshape(2, -1))
        first, second = a[at[0]], b[at[1]]
        swap = first > second
        return pd.DataFrame({"a": np.where(swap, second, first), "b": np.where(swap, first, second), "similarity": cosines[at]})

    return multiply


def _seams(docs: DataFrame) -> DataFrame:
    """(key, term) of the pairs that span two texts: a text's last token and the next text's first. Texts are put in order
    within blocks of 2^16 numbers, and the blocks of a key by their first texts, so no task gets all texts of a key."""
    ends = docs.select("key", "order", F.shiftright("order", 16).alias("block"), F.element_at("t", 1).alias("first"), F.element_at("t", -1).alias("last"))
    ends = written(ends, "ends")  # a row per text; two branches below start from it
    blocks = ends.groupBy("key", "block").agg(F.min_by("first", F.struct("order", "first")).alias("block_first"))
    blocks = blocks.select("key", "block", F.lead("block_first").over(Window.partitionBy("key").orderBy("block")).alias("later"))
    near = F.lead("first").over(Window.partitionBy("key", "block").orderBy("order", "first"))
    joined = ends.withColumn("near", near).join(blocks, ["key", "block"]).withColumn("next", F.coalesce("near", "later"))
    return joined.where("next IS NOT NULL").select("key", F.concat_ws(" ", "last", "next").alias("term"))


def domain_scores(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Per key: the occurrences of each domain's keywords in its lower-cased texts, and the domain with the most (the first of
    those on a tie, 'general' without any)."""
    lowered = F.lower(X.or_empty(F.col(text)))
    sums = [F.sum(sum((X.occurrences(lowered, w) for w in words[1:]), X.occurrences(lowered, words[0]))).alias(d) for d, words in X.DOMAIN_KEYWORDS.items()]
    scored = rows.groupBy(key).agg(*sums)
    best = F.greatest(*X.DOMAIN_KEYWORDS)
    primary = F.when(best == 0, "general")
    for domain in X.DOMAIN_KEYWORDS:
        primary = primary.when(F.col(domain) == best, domain)
    return scored.withColumn("primary_domain", primary)
