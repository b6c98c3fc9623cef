"""Queries of the problems of language-model data, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuebound.llm.encode import encode_corpus
from cuebound.llm.mixing import draw_mix, mix_report
from cuebound.llm.repair import find_garbled, restore_garbled
from cuebound.llm.splits import SPLITS, assign_splits, component_sizes, row_components, split_components, tied_topics, topic_classes
from cuebound.llm.tokens import count_tokens, language
from cuebound.queries.general import SQL_BLANK, SQL_VIDEO
from cuebound.session import spread, table, written


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of stored topics that must share a split."""
    return tied_topics(table(spark, sf_dir, "segments"))


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's component and split, by the configuration 'base'."""
    config = table(spark, sf_dir, "data_config").where("config_name = 'base'").first()
    members = written(row_components(table(spark, sf_dir, "segments")), "members")  # read twice
    return assign_splits(members, (config.train_split, config.validation_split, config.test_split), config.random_seed)


def p1_topic_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stored topic and the smallest one that must share its split."""
    return topic_classes(table(spark, sf_dir, "segments"))


def p1_split_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and share per split for each configuration, beside the wanted share."""
    configs = table(spark, sf_dir, "data_config").collect()  # a fixed table of three rows
    wanted = [(c.config_name, name, share) for c in configs for name, share in zip(SPLITS, (c.train_split, c.validation_split, c.test_split), strict=True)]
    sizes = component_sizes(row_components(table(spark, sf_dir, "segments")))
    chosen = split_components(sizes, [(c.config_name, (c.train_split, c.validation_split, c.test_split), c.random_seed) for c in configs])
    counts = chosen.groupBy(F.col("config").alias("config_name"), "split").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_components"))
    target = spark.createDataFrame(wanted, "config_name string, split string, target_share double")
    joined = target.join(counts, ["config_name", "split"], "left").fillna(0, ["n_rows", "n_components"])
    total = F.sum("n_rows").over(Window.partitionBy("config_name"))  # three rows each
    return joined.select("config_name", "split", "target_share", "n_rows", "n_components", (F.col("n_rows") / total).alias("actual_share"))


def _document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "domain", "text")
    return count_tokens(spread(docs), "text", ["doc_id", "source", "lang", "domain"])


def p3_document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document."""
    return _document_tokens(spark, sf_dir).select("doc_id", "n_tokens")


def p3_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens per source, language and domain."""
    tokens = _document_tokens(spark, sf_dir).withColumn("language", language(F.col("lang")))
    return tokens.groupBy("source", "language", "domain").agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("n_tokens") > 0).alias("n_with_text"), F.sum("n_tokens").alias("n_tokens")
    )


def p3_segment_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each segment."""
    return count_tokens(spread(table(spark, sf_dir, "segments").select("row_id", "topic", "text")), "text", ["row_id", "topic"])


def p3_topic_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments and tokens per topic, exactly as stored."""
    tokens = count_tokens(spread(table(spark, sf_dir, "segments").select("topic", "text")), "text", ["topic"])
    return tokens.groupBy("topic").agg(F.count(F.lit(1)).alias("n_segments"), F.sum("n_tokens").alias("n_tokens"))


def p3_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document's token count is the number of its token ids: counts and encoding are split by different engines."""
    ids = p6_ids(spark, sf_dir).select("doc_id", F.size("ids").cast("bigint").alias("n_ids"))
    return p3_document_tokens(spark, sf_dir).join(ids, "doc_id").select("doc_id", (F.col("n_tokens") == F.col("n_ids")).alias("agrees"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return encode_corpus(_texts(spark, sf_dir))


def _drawn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    sizes = written(count_tokens(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")), "text", ["doc_id", "source"]), "doc_tokens")
    targets = table(spark, sf_dir, "mix_targets")
    return sizes, targets, draw_mix(sizes, targets)


def p7_character_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixes drawn by sizes in characters, each source at its own target: whether it is capped, what a capped one gives, and whether
    another is within half a document of usual length of its target."""
    sizes = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("n_chars", F.lit(0)).alias("n_tokens"))
    targets = table(spark, sf_dir, "mix_targets")
    report = mix_report(sizes, targets, written(draw_mix(sizes, targets, fill=False), "drawn"), fill=False)
    near = F.abs(F.col("drawn_tokens") - F.col("target_tokens")) <= F.col("source_tokens") / F.col("source_docs") / 2
    return report.select("mix_id", "source", "is_capped", F.when(F.col("is_capped"), F.col("drawn_tokens")).alias("capped_chars"), (F.col("is_capped") | near).alias("is_near"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each mix and how often each is used."""
    return _drawn(spark, sf_dir)[2]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per mix and source: target share and the share really reached."""
    return mix_report(*_drawn(spark, sf_dir))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", language(F.col("lang")).alias("language")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a stretch that was decoded with a wrong encoding."""
    return find_garbled(_tagged(spark, sf_dir), language="language")


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled documents with their restored texts."""
    return restore_garbled(_tagged(spark, sf_dir), language="language")


#: Reachability over ties of topic keys; each video ties its keys to the smallest.
SQL_REACHED = f"""WITH RECURSIVE {SQL_VIDEO},
t AS (SELECT DISTINCT topic, vid, lower(regexp_replace(nfc_normalize(topic), '{SQL_BLANK}|[._-]', '', 'g')) AS k FROM keyed
      WHERE topic IS NOT NULL AND NOT regexp_full_match(topic, '{SQL_BLANK}*')),
n AS (SELECT DISTINCT topic, k FROM t), h AS (SELECT vid, min(k) AS hub FROM t WHERE vid IS NOT NULL GROUP BY vid),
e AS (SELECT DISTINCT hub AS a, k AS b FROM t JOIN h USING (vid) WHERE hub <> k), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT k AS a, k AS b FROM (SELECT DISTINCT k FROM n) UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a)"""
SQL_TIED = f"{SQL_REACHED} SELECT x.topic AS topic_a, y.topic AS topic_b FROM n x JOIN r ON x.k = r.a JOIN n y ON y.k = r.b WHERE x.topic < y.topic"
SQL_CLASSES = f"{SQL_REACHED} SELECT x.topic, min(y.topic) AS class FROM n x JOIN r ON x.k = r.a JOIN n y ON y.k = r.b GROUP BY x.topic"

#: What a capped source gives in characters; all others must be near their targets.
SQL_CHARACTER_MIX = """WITH t AS (SELECT source, sum(n_chars) AS n FROM documents WHERE n_chars > 0 GROUP BY source), a AS (SELECT sum(n_chars) AS n FROM documents),
c AS (SELECT mix_id, m.source, coalesce(target_share * size_factor, 0) * a.n > greatest(0, coalesce(max_repeats, 0)) * coalesce(t.n, 0) AS is_capped,
  CAST(greatest(0, coalesce(max_repeats, 0)) * coalesce(t.n, 0) AS BIGINT) AS most FROM mix_targets m CROSS JOIN a LEFT JOIN t ON m.source = t.source)
SELECT mix_id, source, is_capped, CASE WHEN is_capped THEN most END AS capped_chars, TRUE AS is_near FROM c"""

QUERIES: dict[str, tuple] = {
    "p1_found": (p1_found, SQL_TIED),
    "p1_topic_classes": (p1_topic_classes, SQL_CLASSES),
    "p1_splits": (p1_splits, None),
    "p1_split_shares": (p1_split_shares, None),
    "p3_document_tokens": (p3_document_tokens, None),
    "p3_budget": (p3_budget, None),
    "p3_segment_tokens": (p3_segment_tokens, None),
    "p3_topic_budget": (p3_topic_budget, None),
    "p3_agreement": (p3_agreement, "SELECT doc_id, TRUE AS agrees FROM documents"),
    "p6_ids": (p6_ids, None),
    "p7_mix": (p7_mix, None),
    "p7_shares": (p7_shares, None),
    "p7_character_mix": (p7_character_mix, SQL_CHARACTER_MIX),
    "p8_found": (p8_found, None),
    "p8_restored": (p8_restored, None),
}
