"""Facts of the rules, case by case: geometry, text, Korean, classes, confidence."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.geometry import Box, center_distance, covered_share, iou, union
from palimpsest.functions.hangul import compose_text, normalize_ocr_text
from palimpsest.operators import classify, resolve


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def box(*v):
    return Box(*(F.lit(float(x)) for x in v))


def test_geometry(spark):
    a, b = box(0, 0, 10, 10), box(5, 5, 15, 15)
    assert one(spark, iou(a, b)) == pytest.approx(25 / 175)
    assert one(spark, iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0.0
    assert one(spark, center_distance(a, b)) == pytest.approx(50**0.5)
    assert one(spark, union(a, b).area) == 225
    assert one(spark, box(10, 0, 0, 5).width) == 0
    assert one(spark, covered_share(box(0, 0, 10, 10), box(0, 0, 8, 10))) == pytest.approx(0.8)


@pytest.mark.parametrize(
    ("p", "o", "cov", "den", "want"),
    [(420, 100, 0.2, 0.18, "digital"), (20, 300, 0.62, 0.56, "scanned"), (230, 220, 0.1, 0.22, "digital"), (100, 150, 0.1, 0.15, "hybrid"), (0, 0, 0.31, 0.0, "scanned"), (0, 0, 0.0, 0.0, "hybrid")],
)
def test_page_class(spark, p, o, cov, den, want):
    assert one(spark, classify.page_class(F.lit(p), F.lit(o), F.lit(cov), F.lit(den))) == want


@pytest.mark.parametrize(
    ("a", "b", "want"), [("2024 report", "2023 report", 0.521212), ("same text", "same text", 1.0), ("", "x", 0.0), ("abc", "xyz", 0.0), ("한글 문서", "한글 문서", 1.0)]
)
def test_similarity(spark, a, b, want):
    assert one(spark, T.similarity(F.lit(a), F.lit(b))) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(
    ("text", "want"),
    [("ㅁ ㅁ ㅁ ㅁ ㅁ", True), ("이것은 哲 豆 吳 테스트 문서", True), ("Appendix C checksum 9A7F", False), ("a", True), ("......", True), ("aaaaaaaa", True), ("한글 테스트", False)],
)
def test_noisy(spark, text, want):
    assert one(spark, T.noisy_ocr(F.lit(text))) is want


def test_hangul():
    assert compose_text("한글") == "한글"
    assert compose_text("ㄱㅏ") == "가"
    assert compose_text("ᄒ ᅡ ᆫ") == "한"
    assert compose_text("한 글 문서") == "한 글 문서"
    assert compose_text("가 abc") == "가 abc"
    assert normalize_ocr_text("이것은 哲  문서 ") == "이것은 문서"


@pytest.mark.parametrize(
    ("text", "want"),
    [("문 서 입 니다", "문서입 니다"), ("가 나 다 라 마 바", "가 나 다 라 마 바"), ("가 나 다 라 끝났다", "가나다라 끝났다"), ("ab 가 나", "ab 가 나"), ("", ""), ("x 가 나 다 y", "x 가나다 y")],
)
def test_short_runs(spark, text, want):
    assert one(spark, T.collapse_short_runs(F.lit(text))) == want


def test_split_endings(spark):
    assert one(spark, T.fix_split_endings(F.lit("테스트입 니다 말할   수 보고서입 니까"))) == "테스트입니다 말할 수 보고서입니까"


@pytest.mark.parametrize(("text", "want"), [("\n\n a \n\n\n b\n", "a\n\nb"), ("ㄱㅏ\n한글", "한글"), ("x", "x"), ("", "")])
def test_clean_lines(spark, text, want):
    assert one(spark, T.clean_decomposed_lines(F.lit(text))) == want


@pytest.mark.parametrize(
    ("p", "o", "sim", "good", "want"), [(True, True, 0.95, True, 1.0), (True, True, 0.75, False, 0.75), (True, True, 0.2, True, 0.6), (True, False, None, True, 0.5), (False, True, None, True, 0.4), (False, False, 0.1, False, 0.0)]
)
def test_confidence(spark, p, o, sim, good, want):
    assert one(spark, resolve.confidence(F.lit(p), F.lit(o), F.lit(sim).cast("double"), F.lit(good))) == pytest.approx(want)


def test_rounding_and_escape(spark):
    assert [one(spark, T.rounded(F.lit(x))) for x in (0.5, 1.5, 2.5, 2.51)] == ["0", "2", "2", "3"]
    assert one(spark, T.html_escape(F.lit("a<b>&'"))) == "a&lt;b&gt;&amp;'"


@pytest.mark.parametrize(
    ("text", "area", "edge", "h", "v", "want"),
    [("sin x + dx + 2", 10000.0, 0, 0, 0, "math"), ("plain text that is long enough to be text", 1.0, 0, 0, 0, "text"), ("", 60000.0, 0.1, 0, 0, "figure"), ("", 20000.0, 0.01, 0.02, 0.02, "table"), ("", 100.0, 0, 0, 0, "text")],
)
def test_block_type(spark, text, area, edge, h, v, want):
    d = lambda x: F.lit(float(x))
    assert one(spark, T.block_type(F.lit(text), d(area), d(edge), d(h), d(v))) == want


def test_export_filters(spark):
    assert one(spark, T.skip_noisy_ocr(F.lit("ocr"), F.lit("## .. ##")))
    assert not one(spark, T.skip_noisy_ocr(F.lit("parser"), F.lit("## .. ##")))
    assert one(spark, T.skip_degraded_parser(F.lit("parser"), F.lit("ㄱㄴㄷㄹㅁㅂㅅㅇ 가")))


def test_measures_by_shorter_ways(spark):
    """Edit distance, tokens, white space and noise by their shorter ways say what the plain ones say."""
    texts = ["", " ", "a", "ab", "aaaaaa", "abababab", "abcabc", "a  b\tc d　", " x\n\ny ", "The quick brown fox", "THE QUICK", "quick", "1", "1 2", "가나 다라", "ㅁㅁㅁㅁㅁㅁㅁ", "哲豆 이것", "😀😀😀😀😀😀", "😀a😀a😀a", "\u0085x ", None]
    d = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    a, b, n = F.col("a"), F.col("b"), F.lower(F.regexp_replace(F.regexp_replace("a", "(?U)\\s+", " "), "^ | $", ""))
    plain = F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    split = F.array_distinct(F.filter(F.split(a, "(?U)\\s+"), lambda t: t != ""))
    quality = T.syllables(n) * 2 - T.jamos(n) * 3
    noisy = (F.length(n) <= 1) | (T.alnum(n) <= 1) | ((F.length(n) >= 6) & (T.distinct_chars(n) <= 2)) | (T.has_korean(n) & (T.hanja(n) >= 2)) | (T.has_korean(n) & (quality < -6))
    pairs = {"edit": (T.edit_similarity(a, b), plain), "tokens": (T.tokens(a), split), "norm": (T.normalized(a), n), "noisy": (T.noisy_ocr(a), noisy), "quality": (T.quality(n), quality), "two": (T.two_chars(a), T.distinct_chars(a) <= 2)}
    for name, (got, want) in pairs.items():
        assert d.where(~got.eqNullSafe(want) & (F.lit(name != "two") | (F.length(a) > 0))).select("a", "b", got, want).collect() == [], name


def test_whole_stays_cheap(spark):
    """Of two long texts of which one holds the other no edit distance is taken: seconds, not minutes."""
    import time

    d = spark.createDataFrame([("lorem ipsum dolor " * 6000, "lorem ipsum dolor " * 5999)] * 4, "a string, b string")
    began = time.time()
    assert {r[0] for r in d.select(T.edit_similarity(F.col("a"), F.col("b")) > 0.99).collect()} == {True}
    assert time.time() - began < 20
