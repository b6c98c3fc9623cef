"""Text functions: Column -> Column, all inside code generation. Patterns here are the only ones in the package.

The patterns spell their Unicode classes out, so that they mean the same to Java's and to RE2's engine.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks (inside a class): Unicode white space and the four separators below it.
BL = r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Word characters, and the letters of the corpus' language with what lies between them (both inside a class).
WORD, LATIN = r"\p{L}\p{N}_", r"\x{C0}-\x{1EF9}"
#: What cleaning removes, a token of the regular-expression kind, a sentence end.
SPECIAL = f"[^{WORD}{BL}{LATIN}]"
TOKEN = f"[{WORD}](?:[{WORD}{LATIN}]*[{WORD}])?"
SENTENCE_END = "[.!?]+"
#: Vowels of the language: bases, and the mark of each tone.
BASES = "aăâeêioôơuưy"
TONE_MARKS = {"acute": "́", "grave": "̀", "hook": "̉", "tilde": "̃", "dot": "̣"}


def toned(tone: str, bases: str = BASES) -> str:
    """The bases with a tone."""
    return "".join(unicodedata.normalize("NFC", b + TONE_MARKS[tone]) for b in bases)


ALL_TONED = "".join(map(toned, TONE_MARKS))
VOWELS = BASES + ALL_TONED
#: Vowel families by their bases.
FAMILIES = {f: "".join(sorted(set(bases + "".join(toned(t, bases) for t in TONE_MARKS)))) for f, bases in (("a", "aăâ"), ("e", "eê"), ("i", "i"), ("o", "oôơ"), ("u", "uư"), ("y", "y"))} | {"d": "dđ"}
#: Classes of letters by tone; the class without a tone has the plain vowels and d.
TONE_CLASSES = {"no_tone": "aeiouydăâêôơư"} | {t: toned(t) for t in TONE_MARKS}
#: Word-initial consonant clusters, function words, keywords of each domain in the order that breaks ties.
CLUSTERS = ["ch", "gh", "gi", "kh", "ng", "nh", "ph", "qu", "th", "tr"]
FUNCTION_WORDS = (
    "là của có được và với trong cho để từ về theo như khi nếu mà hay hoặc nhưng tôi bạn chúng họ nó này đó những các"
).split()
DOMAIN_KEYWORDS = {
    "self_development": ["phát triển", "bản thân", "tự", "cải thiện", "kỹ năng", "học"],
    "psychology": ["tâm lý", "cảm xúc", "tinh thần", "tư duy", "suy nghĩ"],
    "health_wellness": ["sức khỏe", "cơ thể", "chữa", "lành", "khỏe"],
    "relationships": ["tình yêu", "quan hệ", "người", "bạn", "gia đình"],
    "philosophy": ["triết", "sống", "đời", "cuộc", "ý nghĩa", "giá trị"],
    "business_finance": ["tiền", "kinh doanh", "công việc", "thành công"],
}


def or_empty(text: Column) -> Column:
    """text, '' for NULL."""
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    """text without blanks around it."""
    return F.regexp_replace(text, f"^[{BL}]+|[{BL}]+$", "")


def words(text: Column) -> Column:
    """The words between blanks; none for NULL, '' and blanks."""
    return F.filter(F.split(or_empty(text), f"[{BL}]+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Runs of word characters; none for NULL."""
    return F.regexp_extract_all(or_empty(text), F.lit(TOKEN), F.lit(0))


def count_of(text: Column, pattern: str) -> Column:
    """Matches of pattern; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def clean(text: Column) -> Column:
    """Trim, collapse blanks to one space, delete specials, lower case, in this order ('' for NULL): 'a - b' keeps two spaces."""
    return F.lower(F.regexp_replace(F.regexp_replace(strip(or_empty(text)), f"[{BL}]+", " "), SPECIAL, ""))


def clean_keep_case(text: Column) -> Column:
    """Specials deleted, nothing else changed; '' for NULL."""
    return F.regexp_replace(or_empty(text), SPECIAL, "")


def clean_spaced(text: Column) -> Column:
    """Lower case with each special replaced by a space; '' for NULL."""
    return F.regexp_replace(F.lower(or_empty(text)), SPECIAL, " ")


def sentence_count(text: Column) -> Column:
    """Parts between sentence ends, an empty last one included; 0 for '' and NULL."""
    return F.when(or_empty(text) == "", 0).otherwise(F.size(F.split(text, SENTENCE_END, -1)))


def sentences(text: Column) -> Column:
    """Parts between sentence ends that are not blank."""
    return F.filter(F.transform(F.split(or_empty(text), SENTENCE_END, -1), strip), lambda s: s != "")


def rate(amount: Column, seconds: Column) -> Column:
    """amount per second: 0 over zero seconds, NULL for nothing over zero seconds and for NULL seconds."""
    return F.when((seconds == 0) & (amount > 0), F.lit(0.0)).when(seconds == 0, F.lit(None).cast("double")).otherwise(amount / seconds)


def rate_or_zero(amount: Column, seconds: Column) -> Column:
    """amount per second where seconds > 0, else 0."""
    return F.when(seconds > 0, amount / seconds).otherwise(F.lit(0.0))


def repeats_a_character(text: Column, times: int = 6) -> Column:
    """Whether some character but a line end comes times times in a row; NULL for NULL."""
    return text.rlike(r"(.)\1{" + str(times - 1) + ",}")


def repeats_a_word(text: Column, longer_than: int = 2) -> Column:
    """Whether two neighbours among the lower-case words are equal and longer than longer_than."""
    w = words(F.lower(text))
    pairs = F.arrays_zip(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))))
    return F.exists(pairs, lambda p: (p["0"] == p["1"]) & (F.length(p["0"]) > longer_than))


def occurrences(text: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of phrase; 0 for NULL."""
    return ((F.length(or_empty(text)) - F.length(F.replace(or_empty(text), F.lit(phrase), F.lit("")))) / len(phrase)).cast("bigint")


def preview(text: Column, size: int = 100) -> Column:
    """The first characters and '...'; texts that are not longer stay whole."""
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("..."))).otherwise(text)


def code_point(char: Column) -> Column:
    """The code point of the first character as U+XXXX."""
    return F.format_string("U+%04X", F.ascii(char))


def file_name_safe(name: Column) -> Column:
    """name with each character that file systems refuse replaced by an underscore."""
    return F.regexp_replace(name, r'[<>:"/\\|?*]', "_")


def stem(path: Column) -> Column:
    """The file name of path without its last extension; a name that is only an extension stays."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def suffix(path: Column) -> Column:
    """The last extension of path in lower case, '' without one."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]*)$", 1))


def srt_seconds(clock: Column) -> Column:
    """HH:MM:SS,mmm as seconds; 0 for anything else: a missing fraction, an hour over 23, a minute over 59, a second over 61."""
    pattern = r"^(\d{1,2}):(\d{1,2}):(\d{1,2})[.,](\d{1,6})$"
    h, m, s = (F.try_to_number(F.regexp_extract(clock, pattern, i), F.lit("99")).cast("double") for i in (1, 2, 3))
    fraction = F.concat(F.lit("0."), F.regexp_extract(clock, pattern, 4)).cast("double")
    fine = clock.rlike(pattern) & (h <= 23) & (m <= 59) & (s <= 61)
    return F.when(F.coalesce(fine, F.lit(False)), h * 3600 + m * 60 + s + fraction).otherwise(F.lit(0.0))


def video_id_of_address(url: Column) -> Column:
    """The id in a watch or short address: after watch?v= up to &, or after the short host up to ?; NULL for others."""
    watch, short = "watch?v=", "youtu.be/"
    return F.when(url.contains(watch), F.split_part(F.split_part(url, F.lit(watch), F.lit(2)), F.lit("&"), F.lit(1))).when(
        url.contains(short), F.split_part(F.split_part(url, F.lit(short), F.lit(2)), F.lit("?"), F.lit(1))
    )
