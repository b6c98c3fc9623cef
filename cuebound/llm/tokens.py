"""Exact token counts: each distinct piece of text is tokenized once, and its length is joined to where it occurs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuebound.llm.bpe import PATTERN, TOKENIZER_DIR, TrieEncoder, load_ranks
from cuebound.session import written

#: Lengths are broadcast while all of them take at most so many bytes, which is checked. Beyond that, those of the most frequent
#: pieces are, at most so many of at most so many bytes each (about 30 MB whatever the corpus), and others are joined by a shuffle.
ALL_BYTES, HOT_PIECES, HOT_BYTES, ROW_BYTES = 48 << 20, 250_000, 64, 60
#: Languages by their three-letter codes: fixed values.
LANGUAGE_OF = {"vie": "vi", "eng": "en", "por": "pt", "fra": "fr", "fre": "fr", "rus": "ru", "jpn": "ja"}


def language(tag: Column) -> Column:
    """The language of a tag however written: its first part in lower case, two letters where known; NULL for NULL, blank,
    'und' and other texts that are no tag."""
    first = F.regexp_extract(F.lower(F.trim(tag)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    known = F.create_map(*[F.lit(x) for pair in LANGUAGE_OF.items() for x in pair])
    return F.when((first != "") & (first != "und"), F.coalesce(F.try_element_at(known, first), first))


@dataclass(frozen=True)
class Tokenizer:
    """How a tokenizer prepares text: its normalization, and the pattern that splits text before the merges."""

    normalize: Callable[[Column], Column]
    pattern: str


#: The tokenizers whose preparation is known here. Both byte-level ones normalize nothing and split alike.
TOKENIZERS = {name: Tokenizer(lambda text: text, PATTERN) for name in ("byte_bpe_50k", "byte_bpe_multi_50k")}


def known_tokenizer(name: str) -> Tokenizer:
    """The tokenizer of that name; ValueError for one whose normalization and splitting are not known, since its counts would be wrong."""
    if name not in TOKENIZERS:
        raise ValueError(f"tokenizer {name!r} is none of {', '.join(TOKENIZERS)}")
    return TOKENIZERS[name]


def pieces(text: Column, tokenizer: str = "byte_bpe_50k") -> Column:
    """The pieces that the tokenizer splits text into, in order."""
    how = known_tokenizer(tokenizer)
    return F.regexp_extract_all(how.normalize(text), F.lit("(?U)" + how.pattern), F.lit(0))


def piece_frequencies(text: Column, tokenizer: str = "byte_bpe_50k") -> Column:
    """The different pieces of a text and how often each occurs, as an array of (piece, n); empty for a NULL text. Pieces are sorted, and
    a piece's frequency is the distance between where it and the next begin: no shuffle, whatever the text's length."""
    none = lambda kind: F.array().cast(f"array<{kind}>")
    places = lambda s: F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(none("int"))
    firsts = lambda s: F.filter(places(s), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))
    lengths = lambda s, f: F.transform(f, lambda i, k: F.struct(F.get(s, i).alias("piece"), (F.coalesce(F.get(f, k + 1), F.size(s)) - i).alias("n")))
    ordered = F.sort_array(F.coalesce(pieces(text, tokenizer), none("string")))
    both = F.transform(F.array(ordered), lambda s: F.struct(s.alias("s"), firsts(s).alias("f")))  # sorted once, named s
    return F.element_at(F.transform(both, lambda x: lengths(x["s"], x["f"])), 1)


def piece_lengths(found: DataFrame, tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(piece, freq, n_tokens) of each row (piece, freq) of found, written once to the shared folder; each piece is tokenized once."""
    known_tokenizer(tokenizer)
    path = f"{tokenizer_dir}/{tokenizer}.tiktoken"

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or TrieEncoder(load_ranks(path))
            words = [w.encode() for w in batch.column(0).to_pylist()]
            counts = pa.array(map(len, encoder.encode_sorted(words)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], names=["piece", "freq", "n_tokens"])

    spread = 4 * found.sparkSession.sparkContext.defaultParallelism  # distinct pieces are few bytes but much work
    counted = found.repartitionByRange(spread, "piece").sortWithinPartitions("piece").mapInArrow(lengths, "piece string, freq bigint, n_tokens bigint")
    return written(counted, "lengths")


def count_tokens(rows: DataFrame, text: str, keep: list[str], tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """The columns keep of each row of rows and n_tokens, the exact number of tokens of its text, special tokens aside.

    Null and empty texts have 0 tokens; rows that repeat come out as often as they are there; empty input gives no rows; a
    tokenizer that is not known is a ValueError. Texts are split once, into the different pieces of each row and their
    frequencies, which are written with a number for the row. Each distinct piece of all rows is tokenized once, and its length
    is joined to the rows' pieces: all lengths are broadcast while their checked size allows, beyond that those of the most
    frequent pieces, and the others meet theirs in a shuffle. Sums per row are formed on the map side, so of rows whose lengths
    are broadcast only one number is shuffled.
    """
    split = rows.select(*[F.col(c).alias(c) for c in keep], piece_frequencies(F.col(text), tokenizer).alias("__pieces"))
    split = written(split.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    each = split.select(F.explode("__pieces").alias("x")).select("x.piece", "x.n")
    lengths = piece_lengths(each.groupBy("piece").agg(F.sum("n").alias("freq")), tokenizer, tokenizer_dir)
    size = lengths.agg(F.coalesce(F.sum(F.octet_length("piece") + ROW_BYTES), F.lit(0))).first()[0]
    hot = lengths
    if size > ALL_BYTES:
        hot = written(lengths.where(F.octet_length("piece") <= HOT_BYTES).orderBy(F.desc("freq"), "piece").limit(HOT_PIECES), "hot")
    occurrences = split.select(*keep, "__row", F.explode_outer("__pieces").alias("x")).select(*keep, "__row", "x.piece", "x.n")
    known = occurrences.join(F.broadcast(hot.select("piece", "n_tokens")), "piece", "left")
    sums = known.groupBy("__row", *keep).agg(F.coalesce(F.sum(F.col("n") * F.col("n_tokens")), F.lit(0)).alias("n_tokens"))
    if size > ALL_BYTES:
        rare = lengths.join(hot.select("piece"), "piece", "left_anti")
        far = known.where("n_tokens IS NULL AND piece IS NOT NULL").drop("n_tokens").join(rare.select("piece", "n_tokens"), "piece")
        far = far.select("__row", *keep, (F.col("n") * F.col("n_tokens")).alias("n_tokens"))
        sums = sums.union(far).groupBy("__row", *keep).agg(F.sum("n_tokens").alias("n_tokens"))
    return sums.drop("__row")
