"""Garbled text: chains, examples, lost characters, held-out documents."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuebound.llm import mojibake as M
from cuebound.llm import repair as R

CLEAN = [
    "Người dẫn chuyện kể thêm về ba lô nặng để lần sau làm tốt hơn.", "Ở quê, chúng ta giải thích phản ứng hóa học và quỹ đạo hành tinh?", "Đứa em út bỏ quên khoản tiết kiệm mà không ai để ý!", "Mùa hè năm ngoái bà ngoại giữ gìn cửa hàng nhỏ.",
    "L’équipe a enregistré l’expérience du pendule à la gare.", "À l’époque, nos élèves préférait le café d’à côté.", "The old carpenter didn’t expect the café on the corner.", "Our guest talked about the market bridge — and that was it.",
    "O convidado não esperava a lição de gramática no sertão.", "Há três semanas, a gente provou o pão de ontem.", "Учительница искали опыт с маятником до полуночи.", "Старый столяр вспомнил про семейные сбережения ещё раз!",
    "昨日先生は教室で発音の練習を味わった。", "七時ごろ語り手は駅で古い手紙を忘れていた。",
]


def texts(n, seed=0):
    rng = random.Random(seed)
    groups = [CLEAN[:4], CLEAN[4:6], CLEAN[6:8], CLEAN[8:10], CLEAN[10:12], CLEAN[12:]]
    return [" ".join(rng.choice(g) for _ in range(rng.randint(2, 6))) for g in rng.choices(groups, [8, 2, 3, 2, 2, 2], k=n)]


def counts_of(by_language):
    """Counts of texts by language."""
    found, everything = {}, np.zeros(M.K * M.K, np.int64)
    for language, many in by_language.items():
        n = np.bincount(M.pair_codes(M.codes("\n" + "\n".join(many) + "\n")), minlength=M.K * M.K)
        everything += n
        found[language] = (np.flatnonzero(n), n[np.flatnonzero(n)])
    return M.Counts({None: (np.flatnonzero(everything), everything[np.flatnonzero(everything)])} | found)


LANGUAGES = {"vi": CLEAN[:4], "fr": CLEAN[4:6], "en": CLEAN[6:8], "pt": CLEAN[8:10], "ru": CLEAN[10:12], "ja": CLEAN[12:]}


@pytest.fixture(scope="module")
def model():
    rng = random.Random(0)
    made = M.Model(counts_of({k: [" ".join(rng.choice(v) for _ in range(4)) for _ in range(900 if k == "vi" else 250)] for k, v in LANGUAGES.items()}))
    sample = [t for v in LANGUAGES.values() for t in v] * 20
    found = R.validate(made, np.bincount([M.bin_of(0.0)] * 1000, minlength=M.BINS), sample)
    made.margin, made.example_margin = found.margin, found.example_margin
    return made


def judge(text, model):
    """(whether text is garbled, original)."""
    verdict = M.judge(text, model, M.Hopes(model))
    return (True, verdict.text) if verdict.accepted(model) else (False, None)


def wrong(text, really, read_as):
    data = text.encode(really) if really != "tcvn3" else bytes(M.TCVN3.get(c, ord(c)) if ord(c) > 127 else ord(c) for c in text)
    return M.from_bytes(data, read_as)


@pytest.mark.parametrize("read_as", ["cp1252", "latin-1", "cp1258", "cp1250", "cp1251", "cp437", "cp850", "mac_roman"])
def test_utf8_read_as_something_else_comes_back(model, read_as):
    for clean in CLEAN:
        bad = wrong(clean, "utf-8", read_as)
        assert judge(bad, model) == (True, clean), bad


def test_twice_garbled_and_entities(model):
    clean = CLEAN[0]
    twice = wrong(wrong(clean, "utf-8", "cp1252"), "utf-8", "latin-1")
    assert judge(twice, model) == (True, clean)
    entities = "".join(f"&#{ord(c)};" if ord(c) > 127 else c for c in wrong(clean, "utf-8", "latin-1"))
    assert judge(entities, model) == (True, clean)


def test_other_encodings(model):
    vietnamese = "Người dẫn chuyện kể thêm về ba lô nặng để lần sau làm tốt hơn."
    assert judge(wrong(vietnamese, "tcvn3", "cp1252"), model) == (True, vietnamese)
    for clean, really, read_as in ((CLEAN[10], "cp1251", "cp1252"), (CLEAN[12], "euc_jp", "cp1252"), (CLEAN[13], "cp932", "latin-1"), (CLEAN[8], "cp1252", "cp1251")):
        assert judge(wrong(clean, really, read_as), model) == (True, clean)


def test_every_chain_is_tried(model):
    tried = restored = 0
    for really, read_as in [("utf-8", w) for w in M.READ_AS] + [(t, w) for w, t in M.LEGACY]:
        for clean in CLEAN:
            bad = M.garble(clean, really, read_as)
            if bad is not None:
                tried += 1
                restored += judge(bad, model)[1] == clean
    assert tried > 300 and restored >= 0.97 * tried


def test_runs_of_words_and_examples_garbled_again(model):
    assert judge("ｶﾀｶﾅ半角も少し " + wrong(CLEAN[12], "euc_jp", "cp1252"), model) == (True, "ｶﾀｶﾅ半角も少し " + CLEAN[12])
    assert judge(wrong(CLEAN[13], "utf-8", "cp1250") + " " + CLEAN[12], model) == (True, CLEAN[13] + " " + CLEAN[12])
    once = "The old carpenter drew nhß╗»ng on the corner."
    assert judge(wrong(once, "utf-8", "cp1252"), model)[0]  # whichever of its two layers are taken off


def test_normalized_blanks(model):
    bad = wrong("Đứa em út bỏ quên nhà và làng.", "utf-8", "cp1252").replace("\xa0", " ")
    assert judge(bad, model) == (True, "Đứa em út bỏ quên nhà và làng.")


@pytest.mark.parametrize("text", [*CLEAN, "ĐÃ ĐẾN LÚC ÂM NHẠC LÊN TIẾNG", "CORAÇÕES À MÃO", "Ångström, Þór, Ðuro", "Prices: £40, €35, ¥900 – about ±3 %", "╔══════╗ mục lục ║", "Bảng chữ: Ă Â Đ Ê Ô Ơ Ư", "x² + y² = z²", "ｶﾀｶﾅ", "", "   ", "plain"])
def test_right_text_stays(model, text):
    assert judge(text, model) == (False, None)


@pytest.mark.parametrize("text", ["Hiệu sách treo biển «lÃ\xa0» suốt cả mùa hè năm ngoái.", "Ở quê, đứa em út kể tiáº¿ng cho bà ngoại.", 'Our guest wrote "cafÃ©" on the market bridge.', "Bà ngoại giữ gìn ‘���’ để lần sau.", "The old carpenter talked �� about the corner.", "昨日先生は lÃ\xa0 を味わった。", "The old carpenter drew nhß╗»ng on the corner."])
def test_examples_are_not_garbled(model, text):
    assert judge(text, model) == (False, None)


def test_lost_text_is_found(model):
    for clean in (CLEAN[0], CLEAN[4], CLEAN[10]):
        lost = clean.encode("utf-8").decode("ascii", "replace")
        assert judge(lost, model) == (True, None)


def test_bytes_that_an_encoding_lacks_come_back(model):
    half = CLEAN[0].encode().decode("cp1252", "replace")
    assert "�" in half
    assert judge(half, model) == (True, CLEAN[0])


def test_threshold_lies_between_right_and_garbled():
    right, garbled = np.zeros(M.BINS, np.int64), np.zeros(M.BINS, np.int64)
    right[M.bin_of(0.0)], right[M.bin_of(4.0)], garbled[M.bin_of(9.0)], garbled[M.bin_of(30.0)] = 990, 10, 5, 95
    at, fp, fn = M.threshold(right, garbled, 1.0)
    assert 4.0 < at <= 9.0 and fp == fn == 0
    assert M.threshold(right, garbled * 0, 1.5) == (1.5, 0, 0)
    garbled[M.bin_of(-50.0)] = 1  # one that no margin can find moves nothing
    assert 4.0 < M.threshold(right, garbled, 1.0)[0] <= 9.0


def test_held_out_documents(spark):
    rng, rows, garbled = random.Random(7), [], {}
    for i, text in enumerate(texts(1500, 5)):
        if i % 12 == 0:
            parts = text.split(" ")
            chain = rng.choice([("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "cp1251")])
            bad = wrong(text, *chain)
            if bad != text:
                garbled[i] = text
                text = bad
            del parts
        rows.append((i, text))
    rows += [(2000, None), (2001, ""), (2002, " "), (2003, "dài " * 50_000), (2004, "Bà ngoại kể thêm về ‘Ã©’ để lần sau làm tốt hơn.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("pair", F.lit("clash")).withColumn("n", F.lit(0)).repartition(3)
    found = [r.doc_id for r in R.find_garbled(df).collect()]
    assert len(found) == len(set(found))
    assert set(found) == set(garbled)
    back = {r.doc_id: r for r in R.restore_garbled(df).collect()}
    assert set(back) == set(garbled)
    assert sum(back[i].restored_text == garbled[i] for i in garbled) >= 0.99 * len(garbled)
    twice = df.union(df)
    assert len(R.find_garbled(twice).collect()) == 2 * len(found)


def test_margins_come_from_all_documents(spark, model):
    many = sorted(set(texts(500, 3)))
    long = " ".join(CLEAN[:4] * 100)  # longer than any bound on a sample's texts
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*many, long, long])], "doc_id bigint, text string").repartition(3)
    _, v = R.read_garbled(df, "doc_id", "text")
    rows = df.select(F.xxhash64("text").alias("h"), F.lit("vi").alias("language"), "text")
    by_hash = sorted({r.h: r.text for r in rows.collect()}.items())  # texts that repeat count once
    assert v.cases == sum(int(R._cases(model, [t for h, t in by_hash if h % R.FOLDS == fold], fold)[3, 1]) for fold in range(R.FOLDS))
    counts, folds, n = R._counts(rows, ["vi"])
    assert n == len(many) + 2 and len(folds) == R.FOLDS and sum(f.total for f in folds) == counts.total
    for fold in folds:
        counts = counts.less(fold)
    assert all((n == 0).all() for _, n in counts.by_language.values())


def test_garbled_text_that_was_trained_on_is_found(spark):
    clean = [" ".join([CLEAN[10]] * 2)] * 2
    bad = [wrong(t, "koi8_r", "cp1251") for t in clean]
    assert all(M.fit_for_training(M.points(t + "\n"), np.array([0])).all() for t in bad)
    right = texts(1200, 9)
    found = []
    for order in (1, -1):
        df = spark.createDataFrame(list(enumerate(right + bad))[::order], "doc_id bigint, text string").coalesce(1)
        readings, v = R.read_garbled(df, "doc_id", "text")
        found.append((v, {r.doc_id: r.restored_text for r in R.restore_garbled(df).collect()}))
    assert found[0] == found[1]  # margins and results depend on no row order
    assert found[0][1] == {1200 + i: t for i, t in enumerate(clean)}


@pytest.mark.parametrize(("noise", "times"), [(M.NOISE, 1), (0.0, 2)])
def test_cases_are_judged_again_only_for_other_models(spark, monkeypatch, noise, times):
    bad = wrong(" ".join([CLEAN[10]] * 2), "koi8_r", "cp1251")  # trained on at first, 0.04 % of all
    df = spark.createDataFrame(list(enumerate([*texts(1200, 9), bad])), "doc_id bigint, text string").coalesce(1)
    calls, validated = [], R._validated
    monkeypatch.setattr(R, "_validated", lambda *args: calls.append(args) or validated(*args))
    monkeypatch.setattr(M, "NOISE", noise)
    readings, v = R.read_garbled(df, "doc_id", "text")
    assert [r.id for r in readings.where(R._accepted(v) > 0).collect()] == [1200]
    assert len(calls) == times
    assert all(docs == 1201 and counts.total == sum(f.total for f in folds) for _, counts, folds, docs in calls)


def test_words_kept_from_block_to_block_change_nothing(model):
    hopes = M.Hopes(model)
    for seed in range(3):
        many = texts(40, seed)
        assert (R._cases(model, many, seed, hopes) == R._cases(model, many, seed)).all()
    assert len(hopes) > 0


def test_words_are_scored_once_and_add_up(model):
    made = M.Model(counts_of(LANGUAGES))
    garbled = [wrong(t, "utf-8", "cp1252") for t in CLEAN]
    for text in [*CLEAN, *garbled, "", " ", "a", " à  b ", "đã\tđến\nlúc", CLEAN[0] + " " + CLEAN[12]]:
        for ends in ("\n", " "):
            pairs = M.pair_codes(M.codes(f"{ends}{text}{ends}"))
            assert np.allclose(made.by_language(text, ends), made.tables[pairs].sum(0, dtype=np.float64), atol=1e-6)
    known = [made.score(t) for t in garbled]
    made.prepare([*CLEAN, *garbled])
    assert np.allclose([made.score(t) for t in garbled], known)
    made.prepare([])
    made.tables = None  # words that are known need no table
    assert np.allclose([made.score(t) for t in garbled], known)


def test_words_that_are_cleared_change_nothing(model, monkeypatch):
    many = texts(40, 8)
    expected = R._cases(model, many, 3)
    monkeypatch.setattr(M, "KEPT", 20)
    for cache in (M._MASKS, M._VALID, M._AGAIN, M._READS, M._WIDE_AGAIN, M._BLOCKS):
        cache.clear()
    model._at.clear(), model._alone.clear(), model._words.clear(), model._surprises.clear()
    assert (R._cases(model, many, 3) == expected).all()
    assert len(model._at) < 2_000


def test_first_words_rule_out_no_encoding_of_utf8(model):
    for clean in CLEAN:
        for name in M.READ_AS:
            bad = M.garble(clean, "utf-8", name)
            for text in {bad, bad and bad.replace("\xa0", " "), clean} - {None}:
                assert [n for n in M.may_read_as(text) if M.utf8_again(text, n) is not None] == [n for n in M._may_be_utf8(text) if M.utf8_again(text, n) is not None]


def test_languages_tell_words_that_do_not_fit(spark):
    rng, rows = random.Random(4), []
    for name, many in LANGUAGES.items():
        rows += [(len(rows) + i, " ".join(rng.choice(many) for _ in range(3)), name) for i in range(150)]
    rows += [(5000, "The old carpenter drew nhß╗»ng on the corner.", "en"), (5001, wrong(CLEAN[6], "utf-8", "cp1252"), "en"), (5002, None, None), (5003, "x", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, language string").withColumn("id", F.lit("clash")).withColumn("h", F.lit(0)).repartition(3)
    assert [r.doc_id for r in R.find_garbled(df, language="language").collect()] == [5001]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert R.find_garbled(df).count() == 0
    assert R.restore_garbled(df).count() == 0
    tagged = df.withColumn("language", F.lit("vi"))
    assert R.find_garbled(tagged, language="language").count() == 0
