"""The same text functions as SQL for the engine that checks the queries."""

from __future__ import annotations

from cuebound.functions.text import BL, SENTENCE_END, SPECIAL, TOKEN


def strip(t: str) -> str:
    """See text.strip."""
    return f"regexp_replace({t}, '^[{BL}]+|[{BL}]+$', '', 'g')"


def words(t: str) -> str:
    """See text.words."""
    return f"list_filter(regexp_split_to_array(coalesce({t}, ''), '[{BL}]+'), lambda w: w <> '')"


def tokens(t: str) -> str:
    """See text.tokens."""
    return f"regexp_extract_all(coalesce({t}, ''), '{TOKEN}')"


def count_of(t: str, pattern: str) -> str:
    """See text.count_of."""
    return f"len(regexp_extract_all(coalesce({t}, ''), '{pattern}'))"


def clean(t: str) -> str:
    """See text.clean."""
    collapsed = f"regexp_replace({strip(f"coalesce({t}, '')")}, '[{BL}]+', ' ', 'g')"
    return f"lower(regexp_replace({collapsed}, '{SPECIAL}', '', 'g'))"


def clean_keep_case(t: str) -> str:
    """See text.clean_keep_case."""
    return f"regexp_replace(coalesce({t}, ''), '{SPECIAL}', '', 'g')"


def clean_spaced(t: str) -> str:
    """See text.clean_spaced."""
    return f"regexp_replace(lower(coalesce({t}, '')), '{SPECIAL}', ' ', 'g')"


def sentence_count(t: str) -> str:
    """See text.sentence_count."""
    return f"CASE WHEN coalesce({t}, '') = '' THEN 0 ELSE CAST(len(regexp_split_to_array({t}, '{SENTENCE_END}')) AS INTEGER) END"


def sentences(t: str) -> str:
    """See text.sentences."""
    return f"list_filter(list_transform(regexp_split_to_array(coalesce({t}, ''), '{SENTENCE_END}'), lambda p: {strip('p')}), lambda p: p <> '')"


def rate(amount: str, seconds: str) -> str:
    """See text.rate."""
    return f"CASE WHEN {seconds} = 0 AND {amount} > 0 THEN 0.0::DOUBLE WHEN {seconds} = 0 THEN NULL ELSE {amount} / {seconds} END"


def rate_or_zero(amount: str, seconds: str) -> str:
    """See text.rate_or_zero."""
    return f"CASE WHEN {seconds} > 0 THEN {amount} / {seconds} ELSE 0.0::DOUBLE END"


def occurrences(t: str, phrase: str) -> str:
    """See text.occurrences."""
    return f"CAST((length(coalesce({t}, '')) - length(replace(coalesce({t}, ''), '{phrase}', ''))) / {len(phrase)} AS BIGINT)"


def number(c: str) -> str:
    """A double without NaN."""
    return f"(CASE WHEN isnan({c}) THEN NULL ELSE {c} END)"


def zero(v: str) -> str:
    """v with a negative zero as zero."""
    return f"(CASE WHEN {v} = 0 THEN 0.0::DOUBLE ELSE {v} END)"
