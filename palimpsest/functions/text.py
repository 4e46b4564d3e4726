"""Text measures as columns: built-in functions only, so they stay in the JVM.

Fixed values of the quality rules (code point ranges, weights and limits) stand together below.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SYLLABLE = "[\\uAC00-\\uD7A3]"
JAMO = "[\\u1100-\\u11FF\\u3130-\\u318F\\uA960-\\uA97F\\uD7B0-\\uD7FF]"
KOREAN = "[\\uAC00-\\uD7A3\\u1100-\\u11FF\\u3130-\\u318F\\uA960-\\uA97F\\uD7B0-\\uD7FF]"
HANJA = "[\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF]"
ALNUM = "[A-Za-z0-9\\uAC00-\\uD7A3]"
#: White space (Unicode), written out, as a class of the `U` flag is slow; and runs of it other than a single blank.
WHITE = "\\t-\\r\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
#: A class is a chain of tests, so the one that most characters fail stands first.
SPACE = f"[[^!-\\u0084]&&[ {WHITE}]]+"
UNTIDY = f"[[^!-\\u0084]&&[ {WHITE}]](?:{SPACE}|(?<! ))"
FUSION_WEIGHTS = (2, 3)
EXTRACT_WEIGHTS = (3, 2)


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def ascii_only(text: Column) -> Column:
    """As many bytes as characters: spares the search for characters that lie beyond."""
    return F.octet_length(text) == F.length(text)


def beyond_ascii(text: Column, pattern: str) -> Column:
    return F.when(ascii_only(text), F.lit(0)).otherwise(count(text, pattern))


def syllables(text: Column) -> Column:
    return beyond_ascii(text, SYLLABLE)


def jamos(text: Column) -> Column:
    return beyond_ascii(text, JAMO)


def hanja(text: Column) -> Column:
    return beyond_ascii(text, HANJA)


def has_korean(text: Column) -> Column:
    return ~ascii_only(text) & text.rlike(KOREAN)


def quality(text: Column, weights: tuple[int, int] = FUSION_WEIGHTS) -> Column:
    """Syllables speak for a text, single jamo against it. Resolving and extracting weigh them differently."""
    return F.when(~has_korean(text), 0).otherwise(syllables(text) * weights[0] - jamos(text) * weights[1])


def degraded(text: Column, least: int = 8) -> Column:
    s, j = syllables(text), jamos(text)
    return (s + j >= least) & (j > s * 2)


def parser_degraded(text: Column) -> Column:
    return has_korean(text) & (quality(text) < -2)


def normalized(text: Column) -> Column:
    """White space (Unicode) collapsed, ends trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, UNTIDY, " ")))


def compact(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "")


def alnum(text: Column) -> Column:
    """What is left without the rest, which makes no string a character."""
    return F.length(F.regexp_replace(text, f"[^{ALNUM[1:-1]}]+", ""))


def distinct_chars(text: Column) -> Column:
    return F.size(F.array_distinct(F.split(text, "")))


def tokens(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(text, SPACE)), "")


def bound(text: Column, f) -> Column:
    """f of a value that is made once, however often f uses it: a one-element array binds it."""
    return F.element_at(F.transform(F.array(text), f), 1)


def overlap(x: Column, y: Column) -> Column:
    """Shared tokens over all tokens of two sets; 0 if either is empty."""
    sizes = F.struct(F.size(F.array_intersect(x, y)).alias("both"), F.size(x).alias("x"), F.size(y).alias("y"))
    return bound(sizes, lambda n: F.coalesce(F.try_divide(n["both"], F.when((n["x"] > 0) & (n["y"] > 0), n["x"] + n["y"] - n["both"])), F.lit(0.0)))


def words(norm: Column) -> Column:
    """tokens() of a normalized text, whose only white space is single blanks."""
    return F.array_remove(F.array_distinct(F.split(norm, " ")), "")


def token_overlap(a: Column, b: Column) -> Column:
    return bound(F.struct(tokens(a).alias("x"), tokens(b).alias("y")), lambda t: overlap(t["x"], t["y"]))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length, in code points. Where one text holds the other, the distance is
    what it has more, without the product of both lengths in steps."""
    n, m = F.length(a), F.length(b)
    distance = F.when(F.contains(a, b) | F.contains(b, a), F.abs(n - m)).otherwise(F.levenshtein(a, b))
    return F.lit(1.0) - distance / F.greatest(n, m, F.lit(1))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def differ(x: Column, y: Column) -> Column:
    return (x != "") & (y != "") & (x != y)


def digits_differ(a: Column, b: Column) -> Column:
    return differ(digits(a), digits(b))


def similarity(a: Column, b: Column) -> Column:
    """Mean of edit similarity and token overlap, less 0.1 where digits differ, within 0 and 1; 0 if either is empty."""
    return joint_similarity(a, b, edit_similarity(a, b), token_overlap(a, b), digits_loss(a, b))


def digits_loss(a: Column, b: Column) -> Column:
    return F.when(digits_differ(a, b), F.lit(0.1)).otherwise(F.lit(0.0))


def joint_similarity(a: Column, b: Column, edit: Column, tokens_: Column, loss: Column) -> Column:
    """similarity() from its parts; grows with edit, so a bound of the one gives a bound of the other."""
    raw = (edit + tokens_) / F.lit(2.0) - loss
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.greatest(F.least(raw, F.lit(1.0)), F.lit(0.0)))


def length_ratio(a: Column, b: Column) -> Column:
    """The most that edit_similarity() can be."""
    n, m = F.length(a), F.length(b)
    return F.lit(1.0) - F.abs(n - m) / F.greatest(n, m, F.lit(1))


def few_alnum(text: Column) -> Column:
    """At most one letter or digit; looks no further than the second."""
    return ~text.rlike(f"(?s){ALNUM}.*?{ALNUM}")


def two_chars(text: Column) -> Column:
    """No more than two distinct characters: nothing is left without the first one and the first one of the rest."""
    less = lambda t: F.replace(t, F.substring(t, 1, 1), F.lit(""))
    return less(less(text)) == ""


def noisy_ocr(text: Column) -> Column:
    """Optical text that says nothing: too short, no letters, one or two characters repeated, or broken Korean."""
    return bound(normalized(text), lambda n: (F.length(n) <= 1) | few_alnum(n) | ((F.length(n) >= 6) & two_chars(n)) | (has_korean(n) & ((hanja(n) >= 2) | (quality(n) < -6))))


def noise_token(norm: Column) -> Column:
    """The recognizer's own noise rule, on text that normalize_ocr() has cleaned."""
    c = compact(norm)
    # Texts of fewer than six characters can't repeat; texts without Korean can't be broken Korean.
    korean = has_korean(norm) & (((syllables(norm) >= 3) & (hanja(norm) >= 2)) | degraded(norm, 6))
    return (F.length(norm) <= 1) | few_alnum(norm) | ((F.length(norm) >= 6) & (F.length(c) >= 6) & two_chars(c)) | korean


def candidate_score(norm: Column, conf_100: Column) -> Column:
    """Weighs a recognizer's candidate: confidence, length, share of letters, noise. -1 without text."""
    conf = F.greatest(F.lit(0.0), F.least(F.lit(100.0), conf_100)) / F.lit(100.0)
    length = F.least(F.length(norm), F.lit(180)) / F.lit(180.0)
    ratio = alnum(norm) / F.greatest(F.length(norm), F.lit(1))
    penalty = F.when(noise_token(norm), F.lit(0.35)).otherwise(F.lit(0.0))
    return F.when(norm == "", F.lit(-1.0)).otherwise(conf * F.lit(0.52) + length * F.lit(0.28) + ratio * F.lit(0.20) - penalty)


#: Korean polite endings that a recognizer splits. Fixed values, applied in this order.
SPLIT_ENDINGS = (
    ("([가-힣])입\\s+니다", "$1입니다"),
    ("([가-힣])합\\s+니다", "$1합니다"),
    ("([가-힣])습\\s+니다", "$1습니다"),
    ("([가-힣])됩\\s+니다", "$1됩니다"),
    ("([가-힣])입\\s+니까", "$1입니까"),
    ("([가-힣])할\\s+수", "$1할 수"),
)


def fix_split_endings(text: Column) -> Column:
    for pattern, to in SPLIT_ENDINGS:
        text = F.regexp_replace(text, pattern, to)
    return text


def collapse_short_runs(text: Column, least: int = 3, most: int = 4) -> Column:
    """Runs of 3 to 4 single syllables become one word; longer and shorter runs stay.

    A word is marked as single; runs are closed by the first word that isn't one, in one fold over the words.
    """
    words = F.filter(F.split(text, SPACE), lambda t: t != "")
    empty = F.array().cast("array<string>")
    close = lambda acc: F.when((F.size(acc["run"]) >= least) & (F.size(acc["run"]) <= most), F.array_append(acc["out"], F.array_join(acc["run"], ""))).otherwise(F.concat(acc["out"], acc["run"]))
    step = lambda acc, w: F.when(w.rlike("^[가-힣]$"), F.struct(acc["out"].alias("out"), F.array_append(acc["run"], w).alias("run"))).otherwise(F.struct(F.array_append(close(acc), w).alias("out"), empty.alias("run")))
    folded = F.aggregate(words, F.struct(empty.alias("out"), empty.alias("run")), step, lambda acc: F.array_join(close(acc), " "))
    return F.when(F.size(words) == 0, text).otherwise(folded)


def clean_decomposed_lines(text: Column) -> Column:
    """Lines trimmed; lines of single jamo dropped; runs of blank lines become one, leading ones vanish."""
    lines = F.transform(F.split(F.regexp_replace(F.regexp_replace(text, "\\r\\n", "\n"), "\\n$", ""), "\n"), lambda x: F.regexp_replace(x, "(?U)^\\s+|\\s+$", ""))
    s, j = syllables, jamos
    kept = F.filter(lines, lambda x: ~(((j(x) >= 2) & (s(x) == 0)) | ((s(x) + j(x) > 0) & (j(x) >= s(x) * 3) & (j(x) >= 4))))
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("blank"))
    add = lambda acc, x: F.when((x == "") & acc["blank"], acc).otherwise(
        F.struct(F.concat(acc["out"], F.when(acc["out"] != "", "\n").otherwise(""), x).alias("out"), (x == "").alias("blank"))
    )
    return F.aggregate(kept, start, add, lambda acc: acc["out"])


#: Signs of mathematics in a text; the first eight patterns are counted, the last gives the density. Fixed values.
MATH_SIGNS = (
    "[∫∑∏∂∇]",
    "[α-ωΑ-Ω]",
    "[λμσπΔΣΩ]",
    "lim\\s|sin\\s|cos\\s|tan\\s|exp\\s|log\\s",
    "\\^\\d+|\\^-|\\^t",
    "\\\\frac|\\\\int|\\\\sum|\\\\prod",
    "dx\\s|dt\\s|dy\\s",
    "[≤≥≠∞⊂⊃∪∩∈∉±×÷√]",
)
MATH_CHARS = "[∫∑∏∂∇±≤≥≠∞⊂⊃∪∩∧∨¬∀∃√πλμσΣΔΩαβγδεζηθικλμνξπρστυφχψω()=\\[\\]]"


def block_type(text: Column, area: Column, edge_density: Column, h_density: Column, v_density: Column) -> Column:
    """math, text, figure or table, by signs in the text first and then by measures of the picture, which come as columns."""
    n = F.length(F.regexp_replace(text, "(?U)^\\s+|\\s+$", ""))
    signs = sum((text.rlike(f"(?iu){p}").cast("int") for p in MATH_SIGNS), F.lit(0))
    chars = count(text, MATH_CHARS)
    math = (n > 5) & ((signs >= 2) | ((chars / F.greatest(n, F.lit(1)) > 0.2) & (n > 10)) | ((signs >= 1) & (area > 5000) & (area < 100000) & (chars >= 3)))
    return (
        F.when(math, "math")
        .when((n > 30) & (signs < 2), "text")
        .when((area > 50000) & (edge_density > 0.08), "figure")
        .when((h_density > 0.01) & (v_density > 0.01) & (area > 10000) & (edge_density < 0.05), "table")
        .otherwise("text")
    )


def html_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def rounded(x: Column) -> Column:
    """A number as text without decimals, halves to even."""
    return F.bround(x, 0).cast("long").cast("string")


def block_body(lines: Column) -> Column:
    """Spans joined as they are, lines by line ends."""
    return F.array_join(F.transform(lines, lambda x: F.array_join(F.transform(x["spans"], lambda s: s["text"]), "")), "\n")


def skip_degraded_parser(source: Column, text: Column) -> Column:
    s, j = syllables(text), jamos(text)
    return (source == "parser") & (s + j > 0) & (j >= s * 2) & (j >= 8)


def skip_noisy_ocr(source: Column, text: Column) -> Column:
    # More symbols than letters and digits need no count of their own: then less than half are letters and digits.
    def noisy(c: Column) -> Column:
        return (F.length(c) <= 2) | (alnum(c) * 2 < F.length(c))

    return (source == "ocr") & bound(compact(text), noisy)
