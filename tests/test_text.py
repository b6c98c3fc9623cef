"""Text functions against Python's re, subtitles, keys of files."""

import re

import pytest
from pyspark.sql import functions as F

from cuebound.functions import text as X
from cuebound.sources import subtitles as B

TEXTS = [
    None, "", "   ", "!!!", "a - b", "Xin chào các bạn.", "aaaaaa", "aaaaa", "rất rất lâu", "Rất rẤt đẹp", "khong co dau", "một\xa0hai　ba", "x" * 5000, "é é 日本 Привет", "1 2 3 . ! ?",
    "line\nbreak\r\n  tab\tend ", "no_underscore-hyphen", "a.b!c?d", "...", "😀 emoji 😀", "@#$%^&*()" * 8, "phát triển bản thân học học", "NFD tiếng",
]
SPECIAL = re.compile(r"[^\w\sÀ-ỹ]")


def collect(spark, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    return [r.x for r in df.orderBy("i").select(column.alias("x")).collect()]


def clean(t):
    return SPECIAL.sub("", re.sub(r"\s+", " ", (t or "").strip())).lower()


@pytest.mark.parametrize(
    ("column", "plain"),
    [
        (lambda: X.clean(F.col("t")), clean),
        (lambda: X.clean_keep_case(F.col("t")), lambda t: SPECIAL.sub("", t or "")),
        (lambda: X.clean_spaced(F.col("t")), lambda t: SPECIAL.sub(" ", (t or "").lower())),
        (lambda: X.words(F.col("t")), lambda t: (t or "").split()),
        (lambda: X.sentence_count(F.col("t")), lambda t: len(re.split(r"[.!?]+", t)) if t else 0),
        (lambda: X.sentences(F.col("t")), lambda t: [s.strip() for s in re.split(r"[.!?]+", t or "") if s.strip()]),
        (lambda: X.repeats_a_word(F.col("t")), lambda t: (lambda w: any(a == b and len(a) > 2 for a, b in zip(w, w[1:])))((t or "").lower().split())),
        (lambda: F.coalesce(X.repeats_a_character(F.col("t")), F.lit(False)), lambda t: bool(re.search(r"(.)\1{5,}", t or ""))),
        (lambda: X.occurrences(F.col("t"), "học"), lambda t: (t or "").count("học")),
        (lambda: X.count_of(F.col("t"), f"[{X.VOWELS}]+"), lambda t: len(re.findall(f"[{X.VOWELS}]+", t or ""))),
    ],
)
def test_against_python(spark, column, plain):
    assert collect(spark, column()) == [plain(t) for t in TEXTS]


def test_tone_classes_have_all_vowels():
    assert X.toned("acute", "aăâeêioôơuưy") == "áắấéếíóốớúứý"
    assert len(set(X.VOWELS)) == 12 * 6
    assert "ặ" in X.FAMILIES["a"] and "đ" in X.FAMILIES["d"]


def test_rates(spark):
    df = spark.createDataFrame([(4, 2.0), (4, 0.0), (0, 0.0), (4, None), (4, -2.0)], "n int, d double")
    rows = df.select(X.rate(F.col("n"), F.col("d")).alias("a"), X.rate_or_zero(F.col("n"), F.col("d")).alias("b")).collect()
    assert [r.a for r in rows] == [2.0, 0.0, None, None, -2.0]
    assert [r.b for r in rows] == [2.0, 0.0, 0.0, 0.0, 0.0]


def test_clock(spark):
    cases = {"00:00:05,250": 5.25, "1:2:3.5": 3723.5, "00:00:05": 0.0, "24:00:00,0": 0.0, "00:60:00,0": 0.0, "00:00:61,0": 61.0, "x": 0.0, "": 0.0, None: 0.0}
    df = spark.createDataFrame(list(cases.items()), "t string, w double").withColumn("s", X.srt_seconds(F.col("t")))
    assert {r.t: r.s for r in df.collect()} == cases


def test_srt_blocks(spark):
    content = "1\n00:00:01,000 --> 00:00:02,500\nfirst\nsecond line\n   \n2\n00:00:03,000 --> 00:00:04,000\n\n3\nno time\ntext\n\n4\r\n00:00:05 --> 00:00:06,000\r\nzero start\r\n\n5\n00:00:01,000 --> 00:00:02,000 --> 3\nx"
    df = spark.createDataFrame([("a", content), ("b", None), ("c", "")], "k string, c string")
    found = [(r.k, r.cue_index, r.start, r.end, r.text) for r in B.parse_srt(df, "k", "c").orderBy("pos").collect()]
    assert found == [("a", "1", 1.0, 2.5, "first second line"), ("a", "4", 0.0, 6.0, "zero start")]
    assert df.where("k = 'a'").select(B.srt_to_text(F.col("c")).alias("t")).first().t.split("\n")[:2] == ["first", "second line"]


def test_paths_and_names(spark):
    df = spark.createDataFrame([("a/b/c_001.v2.json",), ("x.WAV",), (".hidden",), ("a/noext",)], "p string")
    rows = df.select(X.stem(F.col("p")).alias("s"), X.suffix(F.col("p")).alias("e")).collect()
    assert [(r.s, r.e) for r in rows] == [("c_001.v2", ".json"), ("x", ".wav"), (".hidden", ""), ("noext", "")]
    one = spark.createDataFrame([('a<b>:"c/d\\e|f?*',)], "n string").select(X.file_name_safe(F.col("n")).alias("s")).first().s
    assert one == "a_b___c_d_e_f__"
    assert spark.range(1).select(X.code_point(F.lit("ữ")).alias("c")).first().c == "U+1EEF"
    urls = spark.createDataFrame([("https://h/watch?v=X&t=1", "X"), ("https://youtu.be/X?si=1", "X"), ("https://h/shorts/X", None)], "u string, w string")
    assert all(r.f == r.w for r in urls.withColumn("f", X.video_id_of_address(F.col("u"))).collect())


def test_subtitle_choice(spark):
    files = spark.createDataFrame([("s/v1.vi.srt",), ("s/v1.en.srt",), ("s/v10.vi.srt",), ("s/v2.txt",)], "path string")
    videos = spark.createDataFrame([("v1",), ("v2",), ("v1",)], "video_id string")
    assert {tuple(r) for r in B.subtitle_of_video(videos, files).collect()} == {("v1", "s/v1.en.srt"), ("v2", None)}
    tracks = spark.createDataFrame([("v", "fr"), ("v", "vi"), ("w", "fr"), ("w", "de"), ("x", None)], "video_id string, lang string")
    assert {tuple(r) for r in B.preferred_language(tracks, ["vi", "en"]).collect()} == {("v", "vi"), ("w", "de")}
