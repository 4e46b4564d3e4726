"""SQL for DuckDB, query by query. Written from the rules, apart from the Spark code."""

from __future__ import annotations

from palimpsest.plans.tracks import SQL
from palimpsest.sinks.export import FRAME

#: Literal rows for Korean rules: composed, single jamo, spaced, with hanja, noise.
KOREAN = [
    "한글 테스트 문서", "ㄱㅏㄴㅏㄷㅏ ㄹㅏㅁㅏ", "ㅎㅏㄴ ㄱㅡㄹ", "이것은 哲 豆 吳 테스트 문서", "ㅁ ㅁ ㅁ ㅁ ㅁ", "문 서 입 니다", "가 나 다 라 마 바", "테스트입 니다 그리고 합 니다",
    "말할   수 있습 니다", "plain ascii 123", "가 나", "가 나 다", "가 나 다 라 끝", "보고서입 니까", "됩 니다 안됩 니다", "", "ab", "......", "ㄱㄴㄷㄹㅁㅂㅅㅇ 가",
]
_LITERAL = ", ".join(f"({i}, '{t}')" for i, t in enumerate(KOREAN))


def _with(body: str, *more: str, recursive: bool = False) -> str:
    parts = ",\n".join([SQL.strip(), *[m.strip() for m in more]])
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}\n{body.strip()}"


def area(a: str) -> str:
    return f"(greatest({a}x1 - {a}x0, 0e0) * greatest({a}y1 - {a}y0, 0e0))"


def inter(a: str, b: str) -> str:
    return f"(greatest(least({a}x1, {b}x1) - greatest({a}x0, {b}x0), 0e0) * greatest(least({a}y1, {b}y1) - greatest({a}y0, {b}y0), 0e0))"


def iou(a: str, b: str) -> str:
    u = f"({area(a)} + {area(b)} - {inter(a, b)})"
    return f"(CASE WHEN {u} <= 0 THEN 0e0 ELSE {inter(a, b)} / {u} END)"


def dist(a: str, b: str) -> str:
    dx, dy = (f"(({a}{c}0 + {a}{c}1) * 5e-1 - ({b}{c}0 + {b}{c}1) * 5e-1)" for c in "xy")
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


def score(a: str, b: str) -> str:
    return f"({iou(a, b)} + (CASE WHEN {a}type = {b}type THEN 1e-1 ELSE 0e0 END) - {dist(a, b)} / 1e4)"


def toks(a: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array({a}, '\\s+'), lambda t: t <> ''))"


def digits(a: str) -> str:
    return f"regexp_replace({a}, '[^0-9]', '', 'g')"


def differ(a: str, b: str) -> str:
    return f"({digits(a)} <> '' AND {digits(b)} <> '' AND {digits(a)} <> {digits(b)})"


#: The engine's edit distance counts bytes, so letters beyond ASCII become control characters, which no line holds.
_LETTERS = "äöüßéèêëàâçñáíóúÄÖÜÉÈÊÇÑÍÓÁÚ"
_STAND_INS = "".join(chr(c) for c in range(1, 32) if c not in (9, 10, 13))[: len(_LETTERS)]


def octets(a: str) -> str:
    return f"translate({a}, '{_LETTERS}', '{_STAND_INS}')"


def sim(a: str, b: str) -> str:
    jac = f"(CASE WHEN len({toks(a)}) = 0 OR len({toks(b)}) = 0 THEN 0e0 ELSE len(list_intersect({toks(a)}, {toks(b)})) / len(list_distinct(list_concat({toks(a)}, {toks(b)}))) END)"
    edit = f"(1e0 - levenshtein({octets(a)}, {octets(b)}) / greatest(length({a}), length({b}), 1))"
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0e0 ELSE greatest(least(({edit} + {jac}) / 2e0 - (CASE WHEN {differ(a, b)} THEN 1e-1 ELSE 0e0 END), 1e0), 0e0) END)"


def norm(a: str) -> str:
    return f"lower(trim(regexp_replace({a}, '\\s+', ' ', 'g')))"


def count(a: str, p: str) -> str:
    return f"len(regexp_extract_all({a}, '{p}'))"


def noisy(n: str) -> str:
    """On text in normal form, without Korean."""
    return f"(length({n}) <= 1 OR {count(n, '[A-Za-z0-9]')} <= 1 OR (length({n}) >= 6 AND len(list_distinct(string_split({n}, ''))) <= 2))"


def clamp(x: str) -> str:
    return f"greatest(least({x}, 1e0), 0e0)"


def conf(p: str, o: str, s: str, g: str) -> str:
    agreed = f"(CASE WHEN {s} IS NULL THEN 0e0 WHEN {s} >= 9e-1 THEN 3e-1 WHEN {s} >= 7e-1 THEN 15e-2 ELSE -2e-1 END)"
    return clamp(f"((CASE WHEN {p} THEN 4e-1 ELSE 0e0 END) + (CASE WHEN {o} THEN 3e-1 ELSE 0e0 END) + {agreed} + (CASE WHEN {g} THEN 1e-1 ELSE -1e-1 END))")


def class_of(p: str, o: str, c: str, d: str) -> str:
    return f"""CASE WHEN {p} >= 120 AND {p} >= 2 * {o} THEN 'digital' WHEN {o} >= 2 * {p} AND ({d} > 0.35 OR {c} > 0.3) THEN 'scanned'
      WHEN {p} > 220 AND {d} < 0.25 AND {c} < 0.25 THEN 'digital' ELSE 'hybrid' END"""


SIG = """
sig AS (
  SELECT doc_id, page_idx,
    CAST(coalesce(sum(strlen(text)) FILTER (track = 'parser' AND type = 'text'), 0) AS BIGINT) AS parser_glyphs,
    CAST(coalesce(sum(strlen(text)) FILTER (track = 'ocr' AND type = 'text'), 0) AS BIGINT) AS ocr_glyphs,
    greatest(least(coalesce(max((x1 - x0) * (y1 - y0)) FILTER (track = 'ocr'), 0e0) / 14e5, 1e0), 0e0) AS image_coverage
  FROM blk GROUP BY doc_id, page_idx
),
cls AS (
  SELECT *, least(ocr_glyphs / 1e3, 1e0) AS ocr_text_density, """ + class_of("parser_glyphs", "ocr_glyphs", "image_coverage", "least(ocr_glyphs / 1e3, 1e0)") + """ AS class FROM sig
)
"""

page_signals = _with("SELECT doc_id, page_idx, parser_glyphs, ocr_glyphs, round(image_coverage, 6) AS image_coverage, round(ocr_text_density, 6) AS ocr_text_density FROM cls", SIG)
page_class = _with("SELECT class, count(*) AS pages, CAST(sum(parser_glyphs) AS BIGINT) AS parser_glyphs, CAST(sum(ocr_glyphs) AS BIGINT) AS ocr_glyphs FROM cls GROUP BY class", SIG)
page_class_rules = f"SELECT class, count(*) AS n FROM (SELECT {class_of('(l_orderkey % 450)', '(l_partkey % 450)', '(l_discount * 5)', '(l_tax * 6)')} AS class FROM lineitem) GROUP BY class"
confidence = f"""SELECT confidence, count(*) AS n FROM (SELECT round({conf('l_linenumber % 2 = 0', 'l_linenumber % 3 = 0', '(CASE WHEN l_linenumber % 4 <> 0 THEN l_discount * 10 END)', 'l_linenumber % 5 = 0')}, 6) AS confidence FROM lineitem) GROUP BY confidence"""

_PAIR = """
pr AS (
  SELECT p.doc_id, p.page_idx, p.seq AS p_seq, o.seq AS o_seq, {iou} AS iou, {dist} AS dist, {score} AS score, p.type AS p_type, o.type AS o_type, p.text AS p_text, o.text AS o_text,
         least(p.x0, o.x0) AS ux0, least(p.y0, o.y0) AS uy0, greatest(p.x1, o.x1) AS ux1, greatest(p.y1, o.y1) AS uy1
  FROM (SELECT * FROM blk WHERE track = 'parser') p JOIN (SELECT * FROM blk WHERE track = 'ocr') o USING (doc_id, page_idx)
)
""".replace("{iou}", iou("p.", "o.")).replace("{dist}", dist("p.", "o.")).replace("{score}", score("p.", "o."))
bbox_metrics = _with("SELECT doc_id, page_idx, p_seq, o_seq, round(iou, 6) AS iou, round(dist, 6) AS dist, round((ux1 - ux0) * (uy1 - uy0), 6) AS union_area, round(ux1 - ux0, 6) AS union_width FROM pr", _PAIR)
candidate_pairs = _with("SELECT doc_id, page_idx, count(*) AS pairs, round(max(score), 6) AS best, CAST(count(*) FILTER (iou > 0.1) AS BIGINT) AS overlapping FROM pr WHERE score > 0 GROUP BY doc_id, page_idx", _PAIR)
text_sim = _with(f"SELECT doc_id, page_idx, p_seq, o_seq, round({sim('p_text', 'o_text')}, 6) AS sim, {differ('p_text', 'o_text')} AS digits_differ FROM pr WHERE dist < 40 AND p_type = 'text' AND o_type = 'text'", _PAIR)

# The greedy choice, one parser block a step: `used` and `pairs` grow along the parser blocks of a page.
_GREEDY = _PAIR + """
, pnum AS (SELECT doc_id, page_idx, seq AS p_seq, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY seq) AS n, count(*) OVER (PARTITION BY doc_id, page_idx) AS total FROM blk WHERE track = 'parser'),
cand AS (SELECT doc_id, page_idx, n, p_seq, list(struct_pack(neg := -score, o := o_seq, iou := iou, dist := dist) ORDER BY -score, o_seq) AS cs FROM pr JOIN pnum USING (doc_id, page_idx, p_seq) WHERE score > 0 GROUP BY doc_id, page_idx, n, p_seq),
steps AS (SELECT pnum.doc_id, pnum.page_idx, pnum.n, pnum.p_seq, cs FROM pnum LEFT JOIN cand USING (doc_id, page_idx, n)),
walk AS (
  SELECT doc_id, page_idx, CAST(0 AS BIGINT) AS n, CAST([] AS INTEGER[]) AS used, CAST(NULL AS INTEGER) AS p_seq, CAST(NULL AS STRUCT(neg DOUBLE, o INTEGER, iou DOUBLE, dist DOUBLE)) AS hit
  FROM (SELECT DISTINCT doc_id, page_idx FROM pnum)
  UNION ALL
  SELECT doc_id, page_idx, n, CASE WHEN ok THEN list_append(used, best.o) ELSE used END, p_seq, CASE WHEN ok THEN best END
  FROM (SELECT *, best IS NOT NULL AND (best.iou > 0.1 OR best.dist < 150) AS ok
        FROM (SELECT s.doc_id, s.page_idx, s.n, s.p_seq, w.used, list_filter(s.cs, lambda c: NOT list_contains(w.used, c.o))[1] AS best
              FROM walk w JOIN steps s ON s.doc_id = w.doc_id AND s.page_idx = w.page_idx AND s.n = w.n + 1))
),
mt AS (SELECT doc_id, page_idx, n, p_seq, hit.o AS o_seq, hit.iou AS iou, hit.dist AS dist FROM walk WHERE hit IS NOT NULL),
lone AS (
  SELECT b.doc_id, b.page_idx, b.track, b.seq FROM blk b
  WHERE (b.track = 'parser' AND NOT EXISTS (SELECT 1 FROM mt WHERE mt.doc_id = b.doc_id AND mt.page_idx = b.page_idx AND mt.p_seq = b.seq))
     OR (b.track = 'ocr' AND NOT EXISTS (SELECT 1 FROM mt WHERE mt.doc_id = b.doc_id AND mt.page_idx = b.page_idx AND mt.o_seq = b.seq))
),
nleft AS (SELECT doc_id, page_idx, CAST(count(*) FILTER (track = 'ocr') AS INTEGER) AS ocr_left FROM lone GROUP BY doc_id, page_idx)
"""
align_greedy = _with("SELECT doc_id, page_idx, p_seq, o_seq, round(iou, 6) AS iou, round(dist, 6) AS dist FROM mt", _GREEDY, recursive=True)
unmatched = _with("SELECT doc_id, page_idx, CASE track WHEN 'parser' THEN 'parser_only' ELSE 'ocr_only' END AS match, seq, ocr_left FROM lone JOIN nleft USING (doc_id, page_idx)", _GREEDY, recursive=True)

_BIG = f"({area('p.')} / 14e5 > 0.58)"
_ALONE = {t: f"CASE WHEN b.type = 'text' AND c.class = 'scanned' THEN {clamp(base + extra)} ELSE {base} END" for t, base, extra in (("parser", conf("true", "false", "NULL", "true"), " - 1e-1"), ("ocr", conf("false", "true", "NULL", "true"), " + 8e-2"))}
# The tracks hold no Korean, so qualities are 0 and Korean conditions never hold.
_RESOLVE = _GREEDY + f"""
, pairs AS (
  SELECT m.doc_id, m.page_idx, m.n, m.p_seq, c.class, p.type AS pt, o.type AS ot, p.text AS px, o.text AS ox, m.iou, m.dist,
         CASE WHEN p.type = 'text' AND o.type = 'text' THEN {sim('p.text', 'o.text')} END AS sim, {_BIG} AS big,
         p.x0 AS px0, p.y0 AS py0, p.x1 AS px1, p.y1 AS py1, o.x0 AS ox0, o.y0 AS oy0, o.x1 AS ox1, o.y1 AS oy1, o.latex AS olatex,
         {noisy(norm('o.text'))} AS nz, length(p.text) AS lp, length(o.text) AS lo, {norm('o.text')} = '' AS blank
  FROM mt m JOIN blk p ON p.doc_id = m.doc_id AND p.page_idx = m.page_idx AND p.track = 'parser' AND p.seq = m.p_seq
  JOIN blk o ON o.doc_id = m.doc_id AND o.page_idx = m.page_idx AND o.track = 'ocr' AND o.seq = m.o_seq
  JOIN cls c ON c.doc_id = m.doc_id AND c.page_idx = m.page_idx
),
chosen AS (
  SELECT *, CASE
    WHEN big AND coalesce(sim, 0) < 0.15 THEN 'yield'
    WHEN sim IS NULL THEN 'figure'
    WHEN sim >= 0.72 AND class = 'scanned' THEN 'ocr+fused'
    WHEN sim >= 0.72 AND class = 'hybrid' AND big AND lo + 40 >= lp AND NOT blank THEN 'ocr'
    WHEN sim >= 0.72 THEN 'parser+fused'
    WHEN class = 'scanned' THEN CASE WHEN NOT blank AND NOT nz THEN 'ocr' ELSE 'parser' END
    WHEN big AND sim < 0.55 AND lo + 40 >= lp AND NOT nz THEN 'ocr'
    WHEN class = 'hybrid' AND sim < 0.35 AND lo > lp + 80 AND NOT nz THEN 'ocr'
    ELSE 'parser' END AS ch,
    {conf('true', 'true', 'sim', '(iou > 0.3 OR dist < 50)')} AS base
  FROM pairs
),
res AS (
  SELECT doc_id, page_idx, class, n, p_seq, sim,
    CASE ch WHEN 'yield' THEN ot WHEN 'figure' THEN 'figure' ELSE 'text' END AS type,
    CASE ch WHEN 'yield' THEN 'ocr' WHEN 'figure' THEN 'fused' WHEN 'ocr+fused' THEN 'fused' WHEN 'parser+fused' THEN 'fused' ELSE ch END AS source,
    CASE WHEN ch = 'yield' THEN {_ALONE['ocr'].replace('b.type', 'ot').replace('c.class', 'class')} WHEN ch = 'ocr' AND class = 'scanned' THEN {clamp('base + 8e-2')} ELSE base END AS confidence,
    CASE WHEN ch = 'figure' THEN NULL WHEN ch IN ('yield', 'ocr', 'ocr+fused') THEN ox ELSE px END AS text,
    CASE ch WHEN 'yield' THEN ox0 WHEN 'figure' THEN least(px0, ox0) ELSE px0 END AS x0, CASE ch WHEN 'yield' THEN oy0 WHEN 'figure' THEN least(py0, oy0) ELSE py0 END AS y0,
    CASE ch WHEN 'yield' THEN ox1 WHEN 'figure' THEN greatest(px1, ox1) ELSE px1 END AS x1, CASE ch WHEN 'yield' THEN oy1 WHEN 'figure' THEN greatest(py1, oy1) ELSE py1 END AS y1,
    CASE WHEN ch = 'yield' THEN olatex END AS latex,
    CASE WHEN ch NOT IN ('yield', 'figure') THEN px WHEN ch = 'yield' THEN NULL END AS d_parser, CASE WHEN ch = 'figure' THEN NULL WHEN ot = 'text' THEN ox END AS d_ocr, CASE WHEN ch NOT IN ('yield', 'figure') THEN sim END AS d_sim
  FROM chosen
)
"""
resolve_pairs = _with("SELECT doc_id, page_idx, p_seq, type, source, round(confidence, 6) AS confidence, text, round(sim, 6) AS sim FROM res", SIG, _RESOLVE, recursive=True)
_SINGLE = f"""
single AS (
  SELECT b.*, c.class, CASE WHEN b.track = 'parser' THEN {_ALONE['parser']} ELSE {_ALONE['ocr']} END AS confidence, nl.ocr_left,
    b.track = 'parser' AND nl.ocr_left >= 10 AND ((abs(b.x0) < 10 AND abs(b.y0) < 10 AND abs(b.x1 - 1000) < 10 AND abs(b.y1 - 1400) < 10) OR {area('b.')} / 14e5 > 0.7) AS skipped
  FROM blk b JOIN lone l USING (doc_id, page_idx, track, seq) JOIN cls c USING (doc_id, page_idx) JOIN nleft nl USING (doc_id, page_idx)
)
"""
promote_single = _with("SELECT type, track AS source, round(confidence, 6) AS confidence, count(*) AS n FROM single GROUP BY ALL", SIG, _GREEDY, _SINGLE, recursive=True)
oversized_skip = _with("SELECT doc_id, page_idx, seq, skipped FROM single WHERE track = 'parser'", SIG, _GREEDY, _SINGLE, recursive=True)

# Matched pairs first, in parser order, then lone parser blocks, then lone optical blocks.
_MERGED = _SINGLE + """
, seqs AS (
  SELECT doc_id, page_idx, class, type, source, confidence, text, x0, y0, x1, y1, latex, d_parser, d_ocr, text AS d_final, d_sim, 0 AS g, n AS o FROM res
  UNION ALL SELECT doc_id, page_idx, class, type, track, confidence, text, x0, y0, x1, y1, latex, CASE WHEN track = 'parser' THEN text END, CASE WHEN track = 'ocr' THEN text END, text, NULL, CASE track WHEN 'parser' THEN 1 ELSE 2 END, seq FROM single
),
allseq AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY g, o) - 1 AS INTEGER) AS seq FROM seqs),
mg AS (SELECT * FROM allseq a WHERE NOT (g = 1 AND EXISTS (SELECT 1 FROM single s WHERE s.skipped AND s.doc_id = a.doc_id AND s.page_idx = a.page_idx AND s.seq = a.o AND s.track = 'parser')))
"""
_DOM = """
dm AS (
  SELECT *, coalesce(sum(CASE WHEN type = 'text' AND source IN ('parser', 'fused') THEN length(text) END) OVER w >= 120
    AND max(CASE WHEN type = 'text' AND source IN ('parser', 'fused') THEN (x1 - x0) * (y1 - y0) END) OVER w >= 3e5, false) AS dominant
  FROM mg WINDOW w AS (PARTITION BY doc_id, page_idx)
)
"""
_CHAIN = (SIG, _RESOLVE, _MERGED, _DOM)
parser_dominant = _with("SELECT doc_id, page_idx, class, dominant, count(*) AS blocks FROM dm GROUP BY ALL", *_CHAIN, recursive=True)


def _redundant(name: str, when: str) -> str:
    on, qn = norm("o.text"), norm("q.text")
    return f"""
{name} AS (
  SELECT * FROM dm o WHERE NOT (o.dominant AND {when} AND o.type = 'text' AND o.source = 'ocr' AND (strlen({on}) < 4 OR EXISTS (
    SELECT 1 FROM mg q WHERE q.doc_id = o.doc_id AND q.page_idx = o.page_idx AND q.type = 'text' AND q.source IN ('parser', 'fused') AND {qn} <> ''
      AND ((strlen({on}) >= 8 AND contains({qn}, {on})) OR {sim(qn, on)} >= 0.82 OR ({iou('o.', 'q.')} >= 0.55 AND {sim(qn, on)} >= 0.55)))))
)
"""


dup_ocr_anti = _with("SELECT doc_id, page_idx, seq, source, type FROM f3", *_CHAIN, _redundant("f3", "true"), recursive=True)
_low = lambda c: f"({norm('text')} = '' OR {noisy(norm('text'))} OR ({c} <> 'scanned' AND length({norm('text')}) <= 3))"
noise_filter = _with(
    f"SELECT doc_id, page_idx, class, count(*) AS kept, CAST(sum(seq) AS BIGINT) AS seqs FROM (SELECT *, CASE WHEN seq % 2 = 0 THEN 'scanned' ELSE 'hybrid' END AS class FROM blk WHERE track = 'ocr' AND type = 'text') WHERE NOT {_low('class')} GROUP BY doc_id, page_idx, class"
)


def divider(src: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT doc_id, page_idx, CASE WHEN n >= 6 AND wd >= 300 AND l >= 2 AND r >= 2 AND l + r >= 5 AND s / n <= 0.45 THEN mid END AS divider
  FROM (
    SELECT doc_id, page_idx, any_value(n) AS n, any_value(wd) AS wd, any_value(mid) AS mid, count(*) FILTER (wide) AS s, count(*) FILTER (NOT wide AND (x0 + x1) * 5e-1 < mid) AS l, count(*) FILTER (NOT wide AND (x0 + x1) * 5e-1 >= mid) AS r
    FROM (SELECT *, x0 < mid AND x1 > mid AND (x1 - x0) / wd > 0.58 AS wide
          FROM (SELECT *, lo + wd * 5e-1 AS mid
                FROM (SELECT *, greatest(hi - lo, 1e0) AS wd
                      FROM (SELECT *, count(*) OVER w AS n, min(x0) OVER w AS lo, greatest(max(x1) OVER w, 0e0) AS hi FROM {src} WINDOW w AS (PARTITION BY doc_id, page_idx)))))
    GROUP BY doc_id, page_idx)
)
"""


def reliable(src: str, name: str) -> str:
    own, ocr = "type = 'text' AND source IN ('parser', 'fused')", "type = 'text' AND source = 'ocr'"
    return divider(src, f"{name}_div") + f""",
{name}_sum AS (
  SELECT doc_id, page_idx, count(*) FILTER ({own}) AS n, count(*) FILTER ({ocr}) AS m, coalesce(sum(length(text)) FILTER ({own}), 0) AS pc, coalesce(sum(length(text)) FILTER ({ocr}), 0) AS oc FROM {src} GROUP BY doc_id, page_idx
),
{name} AS (
  SELECT doc_id, page_idx, n >= 1 AND NOT (n = 1 AND m >= 6 AND divider IS NOT NULL) AND pc >= 220 AND (oc = 0 OR pc * 10 >= oc * 7) AS reliable FROM {name}_sum JOIN {name}_div USING (doc_id, page_idx)
)
"""


reliable_parser = _with("SELECT doc_id, page_idx, reliable, count(*) AS blocks FROM mg JOIN rl USING (doc_id, page_idx) GROUP BY ALL", *_CHAIN, reliable("mg", "rl"), recursive=True)
_OCR = "ob AS (SELECT * FROM blk WHERE track = 'ocr')"
two_column = _with("SELECT doc_id, page_idx, round(divider, 6) AS divider, count(*) AS blocks FROM ob JOIN dv USING (doc_id, page_idx) GROUP BY ALL", _OCR, divider("ob", "dv"))


def ordered(src: str, name: str) -> str:
    return divider(src, f"{name}_div") + f""",
{name} AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY coalesce(bucket, 0), CASE WHEN bucket IS NOT NULL THEN y0 END, CASE WHEN bucket IS NOT NULL THEN x0 END, seq) - 1 AS INTEGER) AS pos
  FROM (
    SELECT *, CASE WHEN cnt <= 2 THEN NULL WHEN divider IS NULL THEN 0 WHEN sp AND (top IS NULL OR y1 <= top + 50) THEN 0 WHEN sp AND y0 >= low - 30 THEN 4 WHEN sp THEN 3 WHEN (x0 + x1) * 5e-1 < divider THEN 1 ELSE 2 END AS bucket
    FROM (SELECT *, count(*) OVER w AS cnt, min(CASE WHEN divider IS NOT NULL AND NOT sp THEN y0 END) OVER w AS top, greatest(coalesce(max(CASE WHEN divider IS NOT NULL AND NOT sp THEN y1 END) OVER w, 0e0), 0e0) AS low
          FROM (SELECT *, coalesce(x0 < divider AND x1 > divider, false) AS sp FROM {src} JOIN {name}_div USING (doc_id, page_idx)) WINDOW w AS (PARTITION BY doc_id, page_idx)))
)
"""


reading_order = _with("SELECT doc_id, page_idx, seq, CAST(coalesce(bucket, -1) AS INTEGER) AS bucket, pos FROM od", _OCR, ordered("ob", "od"))
_FINAL = (
    *_CHAIN,
    _redundant("f3", "o.class <> 'scanned'"),
    f"f4 AS (SELECT * FROM f3 WHERE NOT (type = 'text' AND source = 'ocr' AND {_low('class')}))",
    reliable("f4", "rl"),
    "f6 AS (SELECT f4.* FROM f4 JOIN rl USING (doc_id, page_idx) WHERE NOT (class <> 'scanned' AND reliable AND type = 'text' AND source = 'ocr'))",
    ordered("f6", "fz"),
)
fuse_full = _with("SELECT doc_id, page_idx, class, pos, seq, type, source, round(confidence, 6) AS confidence, text, x0, y0, x1, y1 FROM fz", *_FINAL, recursive=True)
fuse_summary = _with("SELECT class, source, type, count(*) AS blocks FROM fz GROUP BY ALL", *_FINAL, recursive=True)

WORDS = """
wd AS (
  SELECT doc_id, page_idx, CAST(line_no * 1000 + n AS INTEGER) AS seq, CAST(line_no // 4 AS INTEGER) AS block_num, CAST(line_no // 2 AS INTEGER) AS par_num, CAST(line_no AS INTEGER) AS line_num, text,
    CASE WHEN (doc_id + n) % 11 = 0 THEN 'x' WHEN (doc_id + n) % 13 = 0 THEN '-1' ELSE CAST((doc_id * 7 + line_no * 3 + n * 5) % 101 AS VARCHAR) END AS conf,
    CAST(10 + n * 40 AS INTEGER) AS "left", CAST(10 + line_no * 30 AS INTEGER) AS top, CAST(length(text) * 5 AS INTEGER) AS width, 20 AS height
  FROM (SELECT doc_id, page_idx, line_no, i - 1 AS n, parts[i] AS text FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT *, string_split(line, ' ') AS parts FROM lin)))
)
"""
mean_word_conf = _with("SELECT doc_id, page_idx, block_num, string_agg(text, ' ' ORDER BY seq, text) AS text, round(avg(CAST(conf AS DOUBLE)), 6) AS conf FROM wd WHERE text <> '' AND TRY_CAST(conf AS DOUBLE) >= 0 GROUP BY doc_id, page_idx, block_num", WORDS)
_LINES = WORDS + """
, gl AS (
  SELECT doc_id, page_idx, block_num, par_num, line_num, string_agg(text, ' ' ORDER BY seq, text) AS text, min(seq) AS seq, CAST(min("left") AS DOUBLE) AS x0, CAST(min(top) AS DOUBLE) AS y0, CAST(max("left" + width) AS DOUBLE) AS x1, CAST(max(top + height) AS DOUBLE) AS y1, round(avg(CAST(conf AS DOUBLE)) / 100, 6) AS confidence
  FROM wd WHERE length(text) >= 3 AND TRY_CAST(conf AS DOUBLE) >= 55 GROUP BY doc_id, page_idx, block_num, par_num, line_num HAVING length(string_agg(text, ' ' ORDER BY seq)) >= 3
)
"""
line_group = _with("SELECT doc_id, page_idx, block_num, par_num, line_num, text, x0, y0, x1, y1, confidence FROM gl", _LINES)
covered_line_anti = _with(f"SELECT doc_id, page_idx, line_num, text FROM gl l WHERE NOT EXISTS (SELECT 1 FROM blk b WHERE b.track = 'ocr' AND b.doc_id = l.doc_id AND b.page_idx = l.page_idx AND {inter('l.', 'b.')} / greatest((l.x1 - l.x0) * (l.y1 - l.y0), 1) > 0.7)", _LINES)
fallback_gate = _with("SELECT doc_id, page_idx, count(*) AS n_tokens, CAST(sum(length(trim(text))) AS BIGINT) AS n_chars, count(*) <= 2 OR sum(length(trim(text))) < 50 AS fallback FROM blk WHERE track = 'ocr' AND type = 'text' GROUP BY doc_id, page_idx")
_SCORE = f"(CASE WHEN text = '' THEN -1e0 ELSE least(greatest(conf, 0e0), 1e2) / 1e2 * 52e-2 + least(length(text), 180) / 18e1 * 28e-2 + {count('text', '[A-Za-z0-9]')} / greatest(length(text), 1) * 2e-1 - (CASE WHEN {noisy('text')} THEN 35e-2 ELSE 0e0 END) END)"
cand_argmax = _with(
    f"""SELECT doc_id, page_idx, line_num, CASE WHEN b.score > -1 THEN b.text ELSE '' END AS text, round(greatest(b.score, -1), 6) AS score, round(greatest(0.05, least(1e0, CASE WHEN b.score > -1 THEN b.conf ELSE 0 END / 100)), 6) AS confidence
  FROM (SELECT doc_id, page_idx, line_num, max(struct_pack(score := score, neg := -cand_ord, text := text, conf := conf)) AS b
        FROM (SELECT *, {_SCORE} AS score FROM (SELECT doc_id, page_idx, line_num, cand_ord, b.text AS text, b.conf AS conf FROM (
          SELECT doc_id, page_idx, line_num, seq % 6 AS cand_ord, max(struct_pack(n := length(text), text := text, conf := CAST((doc_id + seq * 17) % 101 AS DOUBLE))) AS b FROM wd GROUP BY doc_id, page_idx, line_num, seq % 6)))
        GROUP BY doc_id, page_idx, line_num)""",
    WORDS,
)
dedupe_first = _with("SELECT doc_id, page_idx, min(seq) AS seq, text FROM wd GROUP BY doc_id, page_idx, text", WORDS)
_RECT = "rc AS (SELECT doc_id, page_idx, CAST(k AS INTEGER) AS seq, (k % 2) * (300 + (doc_id % 3) * 100) + (doc_id + line_no) % 17 AS x, (line_no * 37) % 200 AS y, 100 + (line_no * 13) % 90 + (doc_id % 4) * 60 AS w, 10 + (line_no * 7) % 30 AS h FROM lin)"
detector_order = _with(
    """SELECT doc_id, page_idx, seq, CAST(row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY CASE WHEN two_column AND x + w / 2e0 >= mid THEN 1 ELSE 0 END, y, x, seq) - 1 AS INTEGER) AS pos, two_column
  FROM (SELECT *, n >= 4 AND wide >= 100 AND count(*) FILTER (lf) OVER p >= 2 AND count(*) FILTER (rt) OVER p >= 2 AND coalesce(min(CASE WHEN rt THEN x END) OVER p - max(CASE WHEN lf THEN x + w END) OVER p > -20, false) AS two_column
        FROM (SELECT *, x + w / 2e0 < mid AND x + w < wide * 45e-2 + 50 AS lf, x + w / 2e0 >= mid AND x > wide * 55e-2 - 50 AS rt
              FROM (SELECT *, wide / 2e0 AS mid FROM (SELECT *, count(*) OVER p AS n, CAST(max(x + w) OVER p AS DOUBLE) AS wide FROM rc WHERE w * h >= 2000 WINDOW p AS (PARTITION BY doc_id, page_idx))))
        WINDOW p AS (PARTITION BY doc_id, page_idx))""",
    _RECT,
)
_SIGNS = " + ".join(f"CAST(regexp_matches(t, '{p}') AS INTEGER)" for p in ("(?i)lim\\s|sin\\s|cos\\s|tan\\s|exp\\s|log\\s", "\\^\\d+|\\^-|\\^t", "(?i)dx\\s|dt\\s|dy\\s"))
block_type = _with(
    f"""SELECT doc_id, kind, count(*) AS n FROM (
  SELECT doc_id, CASE WHEN n > 5 AND (sg >= 2 OR (ch / greatest(n, 1) > 0.2 AND n > 10) OR (sg >= 1 AND ar > 5000 AND ar < 100000 AND ch >= 3)) THEN 'math' WHEN n > 30 AND sg < 2 THEN 'text'
    WHEN ar > 50000 AND ed > 0.08 THEN 'figure' WHEN hd > 0.01 AND vd > 0.01 AND ar > 10000 AND ed < 0.05 THEN 'table' ELSE 'text' END AS kind
  FROM (SELECT *, length(trim(t)) AS n, {_SIGNS} AS sg, {count('t', '[()=\\[\\]]')} AS ch FROM (
    SELECT doc_id, CASE line_no % 6 WHEN 0 THEN left(line, 8) || ' = (a) [b] ^2 sin x' WHEN 1 THEN left(line, 9) WHEN 2 THEN '(=)=[]' ELSE line END AS t,
      (doc_id * 997 + line_no * 1009) % 120000 AS ar, ((doc_id + line_no) % 12) / 1e2 AS ed, (line_no % 3) / 1e2 AS hd, (line_no % 5) / 1e2 AS vd FROM lin)))
GROUP BY doc_id, kind"""
)
mode_argmax = _with(
    """SELECT doc_id, page_idx, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS mode_ord, CAST(6 AS BIGINT) AS score, CAST(length(t) + CASE WHEN doc_id % 2 = 0 THEN 5 ELSE 3 END AS INTEGER) AS chars
  FROM (SELECT doc_id, page_idx, string_agg(line, chr(10) ORDER BY line_no) AS t FROM lin GROUP BY doc_id, page_idx)"""
)
blank_collapse = """
WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\\. ', '.' || chr(10) || chr(10) || chr(10), 'g'), '\\n$', '') AS text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, i, trim(parts[i]) AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM t))),
k AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS prev, max(CASE WHEN line <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS seen FROM l),
o AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (seen = 1 AND NOT (line = '' AND prev = '')), '') AS c FROM k GROUP BY doc_id)
SELECT doc_id, CAST(length(c) AS INTEGER) AS chars, CAST(len(string_split(c, chr(10))) AS INTEGER) AS lines, sha256(c) AS sha256 FROM o
"""
_SYL, _JAMO, _HANJA = "[\\x{AC00}-\\x{D7A3}]", "[\\x{1100}-\\x{11FF}\\x{3130}-\\x{318F}\\x{A960}-\\x{A97F}\\x{D7B0}-\\x{D7FF}]", "[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}]"
korean_counts = f"""
WITH v(id, text) AS (VALUES {_LITERAL}),
c AS (SELECT id, text, {norm('text')} AS n, CAST({count('text', _SYL)} AS INTEGER) AS s, CAST({count('text', _JAMO)} AS INTEGER) AS j, CAST({count('text', _HANJA)} AS INTEGER) AS h, CAST({count('text', '[A-Za-z0-9\\x{AC00}-\\x{D7A3}]')} AS INTEGER) AS a FROM v)
SELECT id, s AS syllables, j AS jamos, h AS hanja, s + j > 0 AS korean, 2 * s - 3 * j AS quality, 3 * s - 2 * j AS extract_quality, s + j >= 8 AND j > 2 * s AS degraded, s + j > 0 AND 2 * s - 3 * j < -2 AS parser_degraded, a AS alnum,
  CAST(len(list_distinct(string_split(text, ''))) AS INTEGER) AS distinct_chars,
  length(n) <= 1 OR {count('n', '[A-Za-z0-9\\x{AC00}-\\x{D7A3}]')} <= 1 OR (length(n) >= 6 AND len(list_distinct(string_split(n, ''))) <= 2) OR (s + j > 0 AND h >= 2) OR (s + j > 0 AND 2 * s - 3 * j < -6) AS noisy
FROM c
"""
_fixed = "text"
for _a, _b in (("입\\s+니다", "입니다"), ("합\\s+니다", "합니다"), ("습\\s+니다", "습니다"), ("됩\\s+니다", "됩니다"), ("입\\s+니까", "입니까"), ("할\\s+수", "할 수")):
    _fixed = f"regexp_replace({_fixed}, '([가-힣]){_a}', '\\1{_b}', 'g')"
split_endings = f"WITH v(id, text) AS (VALUES {_LITERAL}) SELECT id, {_fixed} AS text FROM v"
normalize_text = f"""SELECT doc_id, sha256(n) AS sha256, CAST(length(n) AS INTEGER) AS chars, CAST(len(list_distinct(string_split(n, ''))) AS INTEGER) AS distinct_chars
FROM (SELECT doc_id, {norm("text")} AS n FROM documents WHERE text IS NOT NULL)"""
token_json = _with("""SELECT doc_id, page_idx, CAST(row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY line_no) - 1 AS INTEGER) AS seq, CASE WHEN line_no = 1 THEN 'math' ELSE 'text' END AS type, CAST(line_no AS DOUBLE) AS x1, CAST(9.5 AS DOUBLE) AS y1, CASE WHEN line_no % 2 = 0 THEN 1e0 ELSE 5e-1 END AS confidence,
  CASE WHEN line_no <> 1 THEN line END AS text, CASE WHEN line_no = 1 THEN 'x_' || CAST(k AS VARCHAR) END AS latex FROM lin""")


def num(x: str) -> str:
    return f"CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"


_SYM = count("text", "[^\\pL\\pN\\s]")
_COMPACT = "replace(text, ' ', '')"
_BODY = f"(CASE WHEN source = 'ocr' AND (length({_COMPACT}) <= 2 OR {count('text', '[A-Za-z0-9]')} * 2 < length({_COMPACT}) OR ({_SYM} >= 8 AND {_SYM} > {count('text', '[A-Za-z0-9]')})) THEN '' ELSE text END)"
_PLACE = f"'[' || upper(type) || ' at x:' || {num('x0')} || ' y:' || {num('y0')} || ' w:' || {num('x1 - x0')} || ' h:' || {num('y1 - y0')} || ']'"


#: Every page there is, whether or not a block is left on it.
_LIST = "pl AS (SELECT doc_id, page_idx, coalesce(class, 'hybrid') AS class, width, height FROM pgs LEFT JOIN cls USING (doc_id, page_idx))"
page_list = _with("SELECT doc_id, page_idx, class, width, height FROM pl", SIG, _LIST)


def pages(block: str) -> str:
    rows = f"SELECT doc_id, page_idx, pos, {block} AS b FROM fz UNION ALL SELECT doc_id, page_idx, -1, '' FROM pl"
    return f"{_LIST}, pg AS (SELECT doc_id, page_idx, coalesce(string_agg(b || chr(10) || chr(10), '' ORDER BY pos) FILTER (b <> ''), '') AS page FROM ({rows}) GROUP BY doc_id, page_idx)"


_TEXT = pages(f"CASE WHEN type = 'text' THEN {_BODY} ELSE {_PLACE} END")
_TEXT_DOC = "SELECT doc_id, string_agg('=== Page ' || CAST(page_idx + 1 AS VARCHAR) || ' ===' || chr(10) || chr(10) || page || chr(10), '' ORDER BY page_idx) AS c FROM pg GROUP BY doc_id"
text_export = _with(f"SELECT doc_id, 'document.txt' AS path, sha256(c) AS sha256, CAST(length(c) AS INTEGER) AS chars FROM ({_TEXT_DOC})", *_FINAL, _TEXT, recursive=True)
text_pages = _with("SELECT doc_id, printf('page_%03d.txt', page_idx + 1) AS path, sha256(page) AS sha256 FROM pg", *_FINAL, _TEXT, recursive=True)
_APP = pages(f"CASE WHEN type = 'text' THEN {_BODY} WHEN type = 'math' AND trim(coalesce(latex, '')) <> '' THEN '[MATH] ' || latex ELSE {_PLACE} END")
app_text = _with(f"SELECT doc_id, sha256(c) AS sha256 FROM ({_TEXT_DOC})", *_FINAL, _APP, recursive=True)
app_text_files = _with(f"SELECT doc_id, 'in/' || CAST(doc_id AS VARCHAR) || '.pdf' AS path, sha256('===== in/' || CAST(doc_id AS VARCHAR) || '.pdf =====' || chr(10) || chr(10) || c || chr(10)) AS sha256 FROM ({_TEXT_DOC})", *_FINAL, _APP, recursive=True)


def _md(place: str) -> str:
    nl = "chr(10)"
    box = f"{nl} || '[' || upper(type) || ': ' || {num('x1 - x0')} || 'x' || {num('y1 - y0')} || {place} || ']' || {nl}"
    return f"CASE WHEN type = 'text' THEN {_BODY} WHEN type = 'math' AND coalesce(latex, '') <> '' THEN {nl} || '$$' || {nl} || latex || {nl} || '$$' || {nl} ELSE {box} END"


_AT = f"' at (' || {num('x0')} || ', ' || {num('y0')} || ')'"
md_export = _with(
    "SELECT doc_id, 'document.md' AS path, sha256(c) AS sha256, CAST(length(c) AS INTEGER) AS chars FROM (SELECT doc_id, '# Document' || chr(10) || chr(10) || string_agg('---' || chr(10) || chr(10) || '## Page ' || CAST(page_idx + 1 AS VARCHAR) || chr(10) || chr(10) || page, '' ORDER BY page_idx) AS c FROM pg GROUP BY doc_id)",
    *_FINAL, pages(_md(_AT)), recursive=True,
)


def crop(w: int, h: int) -> tuple[str, str, str, str]:
    x, y = "greatest(CAST(floor(x0) AS BIGINT), 0)", "greatest(CAST(floor(y0) AS BIGINT), 0)"
    cw, ch = f"least(CAST(floor(x1 - x0) AS BIGINT), {w} - {x})", f"least(CAST(floor(y1 - y0) AS BIGINT), {h} - {y})"
    ok = f"({cw} > 0 AND {ch} > 0)"
    return x, y, f"(CASE WHEN {ok} THEN {cw} ELSE 0 END)", f"(CASE WHEN {ok} THEN {ch} ELSE 0 END)"


_CW = crop(1000, 1400)[2]
_FIG = "printf('figures/page_%03d_%s__%02d.png', page_idx + 1, type, {n})"
_HEAD = "chr(10) || '**' || (CASE type WHEN 'math' THEN 'Math Equation' WHEN 'table' THEN 'Table' ELSE 'Figure' END) || ' ' || CAST(pos + 1 AS VARCHAR) || ':**' || chr(10) || chr(10)"
_RICH = f"CASE WHEN type = 'text' THEN {_BODY} WHEN type = 'math' AND coalesce(latex, '') <> '' THEN {_HEAD} || '$$' || chr(10) || latex || chr(10) || '$$' || chr(10) WHEN {_CW} > 0 THEN {_HEAD} || '![' || upper(left(type, 1)) || substr(type, 2) || '](' || {_FIG.format(n='pos')} || ')' || chr(10) ELSE '' END"
md_images = _with(
    "SELECT doc_id, printf('page_%03d.md', page_idx + 1) AS path, sha256('# Page ' || CAST(page_idx + 1 AS VARCHAR) || chr(10) || chr(10) || page) AS sha256 FROM pg",
    *_FINAL, pages(f"CASE WHEN page_idx % 2 = 0 THEN {_RICH} ELSE {_md(chr(39) * 2)} END"), recursive=True,
)
_x, _y, _w, _h = crop(600, 500)
crop_boxes = _with(f"SELECT doc_id, page_idx, track, seq, {_FIG.format(n='seq')} AS path, {_x} AS x, {_y} AS y, {_w} AS w, {_h} AS h FROM blk WHERE type <> 'text'")


def esc(x: str) -> str:
    return f"replace(replace(replace(coalesce({x}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def plain(x: str) -> str:
    return f"regexp_replace(CAST(round({x}, 4) AS VARCHAR), '\\.0$', '')"


_DIV = f"""'<div class=''bbox ' || layer || ' ' || type || ''' style=''left:' || {plain('x0')} || 'px; top:' || {plain('y0')} || 'px; width:' || {plain('x1 - x0')} || 'px; height:' || {plain('y1 - y0')} || 'px;'' data-text=''' || {esc('text')} ||
 ''' data-type=''' || type || ''' data-provenance=''' || source || ''' data-confidence=''' || {plain('confidence')} || ''' data-parser-text=''' || {esc('dp')} || ''' data-ocr-text=''' || {esc('dc')} || ''' data-final-text=''' || {esc('df')} ||
 ''' data-similarity=''' || (CASE WHEN ds IS NULL THEN '' ELSE printf('%d.%03d', CAST(round_even(ds * 1e3, 0) AS BIGINT) // 1000, CAST(round_even(ds * 1e3, 0) AS BIGINT) % 1000) END) || '''></div>'"""
_LAYERS = """SELECT doc_id, page_idx, track AS layer, seq AS place, type, x0, y0, x1, y1, text, CASE track WHEN 'parser' THEN 6e-1 ELSE 5e-1 END AS confidence, track AS source, NULL AS dp, NULL AS dc, NULL AS df, CAST(NULL AS DOUBLE) AS ds FROM blk
  UNION ALL SELECT doc_id, page_idx, 'fused', pos, type, x0, y0, x1, y1, text, confidence, source, d_parser, d_ocr, d_final, d_sim FROM fz"""
html_layers = _with(f"SELECT doc_id, page_idx, layer, place, sha256({_DIV}) AS sha256 FROM ({_LAYERS})", *_FINAL, recursive=True)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_F = [quoted(x) for x in FRAME]
html_export = _with(
    f"""SELECT doc_id, printf('debug/page_%03d.html', page_idx + 1) AS path, CAST(length(c) AS INTEGER) AS chars, sha256(c) AS sha256 FROM (
  SELECT doc_id, page_idx, {_F[0]} || CAST(page_idx + 1 AS VARCHAR) || {_F[1]} || printf('page_%03d.png', page_idx + 1) || {_F[2]} || coalesce(string_agg(div, '' ORDER BY CASE layer WHEN 'parser' THEN 0 WHEN 'ocr' THEN 1 ELSE 2 END, place) FILTER (div <> ''), '') || {_F[3]} AS c
  FROM (SELECT doc_id, page_idx, layer, place, {_DIV} AS div FROM ({_LAYERS}) UNION ALL SELECT doc_id, page_idx, '', -1, '' FROM pl) GROUP BY doc_id, page_idx)""",
    *_FINAL, _LIST, recursive=True,
)
_CENT = lambda x: f"CAST(CAST(round_even({x} * 100, 0) AS BIGINT) AS VARCHAR)"
_FACTS = f"upper(left(type, 1)) || substr(type, 2) || 'Block/' || source || '/' || {_CENT('x0')} || '/' || {_CENT('y1')} || '/' || {_CENT('confidence')} || '/' || coalesce(CASE WHEN type = 'math' THEN latex END, '') || '/' || CASE WHEN type = 'text' THEN coalesce(text, '') ELSE '' END"
_DIGEST = lambda at, cond: f"sha256(coalesce(string_agg(f, chr(10) ORDER BY {at}) FILTER ({cond}), ''))"
json_export = _with(
    f"""SELECT doc_id, page_idx, any_value(class) AS class, any_value(width) AS width, any_value(height) AS height, CAST(count(*) FILTER (layer = 'fused') AS INTEGER) AS blocks, {_DIGEST('place', "layer = 'fused'")} AS facts, {_DIGEST('place', "layer = 'parser'")} AS parser_facts, {_DIGEST('place', "layer = 'ocr'")} AS ocr_facts
  FROM pl LEFT JOIN (SELECT doc_id, page_idx, layer, place, {_FACTS} AS f FROM (
    SELECT doc_id, page_idx, track AS layer, seq AS place, type, x0, y1, text, CASE track WHEN 'parser' THEN 6e-1 ELSE 5e-1 END AS confidence, track AS source, latex FROM blk
    UNION ALL SELECT doc_id, page_idx, 'fused', pos, type, x0, y1, text, confidence, source, latex FROM fz)) USING (doc_id, page_idx) GROUP BY doc_id, page_idx""",
    *_FINAL, _LIST, recursive=True,
)
batch_summary = """SELECT CASE page_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'pptx' WHEN 3 THEN 'ppt' ELSE 'none' END AS kind, count(*) FILTER (page_id % 5 <> 4) AS succeeded, count(*) FILTER (page_id % 5 = 4) AS failed, CAST(sum(page_id % 97) AS BIGINT) AS elapsed_ms FROM pages GROUP BY 1"""
output_paths = "SELECT page_id, 'c ' || CAST(page_id AS VARCHAR) || '.v2_output' AS single, 'out/c ' || CAST(page_id AS VARCHAR) || '.v2' AS batch, 'pdf' AS ext FROM pages"
doc_info = _with("SELECT doc_id, pages, blocks FROM (SELECT doc_id, count(*) AS pages FROM pgs GROUP BY doc_id) JOIN (SELECT doc_id, count(*) AS blocks FROM blk GROUP BY doc_id) USING (doc_id)")
eval_metrics = _with(
    """SELECT t.doc_id, CAST(length(t) AS INTEGER) AS chars, CAST(len(regexp_extract_all(t, '[^ \\n]+')) AS INTEGER) AS words, CAST(len(string_split(regexp_replace(t, '\\n$', ''), chr(10))) AS INTEGER) AS lines, blocks
  FROM (SELECT doc_id, text AS t FROM documents WHERE text IS NOT NULL) t LEFT JOIN (SELECT doc_id, count(*) AS blocks FROM blk GROUP BY doc_id) b ON b.doc_id = t.doc_id"""
)
_SAID = "CAST(seq AS VARCHAR) || '/' || type || '/' || coalesce(text, '')"
debug_attach = _with(
    f"""SELECT doc_id, page_idx, CAST(count(*) FILTER (track = 'parser') AS INTEGER) AS parser_blocks, CAST(count(*) FILTER (track = 'ocr') AS INTEGER) AS ocr_blocks,
  sha256(coalesce(string_agg({_SAID}, chr(10) ORDER BY seq) FILTER (track = 'parser'), '')) AS parser_facts, sha256(coalesce(string_agg({_SAID}, chr(10) ORDER BY seq) FILTER (track = 'ocr'), '')) AS ocr_facts FROM blk GROUP BY doc_id, page_idx"""
)

# What the recognizer's steps make of its words. Words of a line stand side by side with rising left edges, and joining
# asks for a gap of 0 or more, so a block's right edge is its last word's and the word before decides.
_TOKENS = WORDS + f"""
, tk AS (SELECT doc_id, page_idx, seq, CASE WHEN seq % 7 = 0 THEN 'figure' ELSE 'text' END AS block_type, text, CAST("left" AS DOUBLE) AS x0, CAST(top AS DOUBLE) AS y0, CAST("left" + width AS DOUBLE) AS x1, CAST(top + height AS DOUBLE) AS y1 FROM wd WHERE text <> ''),
ck AS (SELECT * FROM tk WHERE NOT (block_type = 'text' AND {noisy('text')})),
tn AS (SELECT *, sum(CASE WHEN abs(y0 + y1 - py) <= 18 AND x0 - px BETWEEN 0 AND 24 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_idx ORDER BY seq) - 1 AS g
       FROM (SELECT *, lag(x1) OVER w AS px, lag(y0 + y1) OVER w AS py FROM ck WHERE block_type = 'text' WINDOW w AS (PARTITION BY doc_id, page_idx ORDER BY seq))),
fig AS (SELECT c.*, row_number() OVER (PARTITION BY c.doc_id, c.page_idx ORDER BY c.seq) + coalesce(m.n, 0) - 1 AS g FROM ck c LEFT JOIN (SELECT doc_id, page_idx, max(g) + 1 AS n FROM tn GROUP BY doc_id, page_idx) m ON m.doc_id = c.doc_id AND m.page_idx = c.page_idx WHERE c.block_type <> 'text')
"""
adjacent_merge = _with(
    """SELECT doc_id, page_idx, CAST(g AS INTEGER) AS pos, block_type, string_agg(text, ' ' ORDER BY seq) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
  FROM (SELECT doc_id, page_idx, g, block_type, seq, text, x0, y0, x1, y1 FROM tn UNION ALL SELECT doc_id, page_idx, g, block_type, seq, text, x0, y0, x1, y1 FROM fig) GROUP BY doc_id, page_idx, g, block_type""",
    _TOKENS,
)
_GATE = """
ot AS (SELECT doc_id, page_idx, seq, type, coalesce(text, '') AS text, x0, y0, x1, y1, latex FROM blk WHERE track = 'ocr'),
gate AS (SELECT p.doc_id, p.page_idx, count(ot.seq) AS n_tokens, CAST(coalesce(sum(length(trim(ot.text))), 0) AS BIGINT) AS n_chars FROM pgs p LEFT JOIN ot ON ot.doc_id = p.doc_id AND ot.page_idx = p.page_idx GROUP BY p.doc_id, p.page_idx)
"""
fallback_pages = _with("SELECT doc_id, page_idx, n_tokens, n_chars, n_tokens <= 2 OR n_chars < 50 AS fallback FROM gate", _GATE)
fallback_union = _with(
    f"""SELECT doc_id, page_idx, seq, type AS block_type, text, x0, y0, x1, y1, 5e-1 AS confidence FROM ot
  UNION ALL SELECT doc_id, page_idx, CAST(seq + 1000000 AS INTEGER), 'text', text, x0, y0, x1, y1, confidence FROM gl l
  WHERE EXISTS (SELECT 1 FROM gate g WHERE g.doc_id = l.doc_id AND g.page_idx = l.page_idx AND (g.n_tokens <= 2 OR g.n_chars < 50))
    AND NOT EXISTS (SELECT 1 FROM ot b WHERE b.doc_id = l.doc_id AND b.page_idx = l.page_idx AND {inter('l.', 'b.')} / greatest((l.x1 - l.x0) * (l.y1 - l.y0), 1) > 0.7)""",
    _LINES, _GATE,
)
extract_pages = _with(
    """SELECT doc_id, page_idx, 0 AS seq, CAST(1000 AS DOUBLE) AS x1, CAST(1400 AS DOUBLE) AS y1, string_agg(line, chr(10) ORDER BY i) FILTER (seen = 1 AND NOT (line = '' AND prev = '')) AS text, 6e-1 AS confidence
  FROM (SELECT *, lag(line) OVER w AS prev, max(CASE WHEN line <> '' THEN 1 ELSE 0 END) OVER w AS seen
        FROM (SELECT doc_id, page_idx, i, trim(parts[i]) AS line FROM (SELECT doc_id, page_idx, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
          SELECT doc_id, page_idx, string_split(CASE WHEN doc_id % 2 = 0 THEN '다라' || chr(10) || chr(10) || chr(10) || t ELSE t || chr(10) || '가나' END, chr(10)) AS parts
          FROM (SELECT doc_id, page_idx, string_agg(line, chr(10) ORDER BY line_no) AS t FROM lin GROUP BY doc_id, page_idx))))
        WINDOW w AS (PARTITION BY doc_id, page_idx ORDER BY i)) GROUP BY doc_id, page_idx"""
)
short_runs = f"""
WITH v(id, text) AS (VALUES {_LITERAL}),
w AS (SELECT id, i, ws[i] AS x, regexp_full_match(ws[i], '[가-힣]') AS single FROM (SELECT id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM v))),
g AS (SELECT *, i - row_number() OVER (PARTITION BY id, single ORDER BY i) AS grp FROM w),
r AS (SELECT id, min(i) AS i, CASE WHEN single AND count(*) BETWEEN 3 AND 4 THEN string_agg(x, '' ORDER BY i) ELSE string_agg(x, ' ' ORDER BY i) END AS x FROM g GROUP BY id, single, grp)
SELECT v.id, coalesce(string_agg(r.x, ' ' ORDER BY r.i), any_value(v.text)) AS text FROM v LEFT JOIN r ON r.id = v.id GROUP BY v.id
"""

#: id, class, parser text, optical text. They use few characters, so that each can become one byte for the edit distance.
KOREAN_PAIRS = [
    (0, "digital", "ㄱㄴㄷ", "한글 문서 " * 12), (1, "hybrid", "ㄱㄴㄷ", "한글 문서 " * 12), (2, "scanned", "ㄱㄴㄷ", "한글 문서 " * 12), (3, "digital", "한글 문서", "한글 문서"),
    (4, "scanned", "한글 문서", "한글 문서"), (5, "hybrid", "한글 문서 글문", "한글 문서 문글"), (6, "digital", "한글문서한글문서", "ㄱㄴㄷㄱㄴㄷㄱㄴㄷ"), (7, "scanned", "한글문서", "ㄱㄴㄷㄱㄴㄷㄱㄴㄷ"),
    (8, "digital", "abc def", "한글 문서 " * 9), (9, "hybrid", "abc def", "한글 문서 한글"), (10, "scanned", "글 漢字 문서 한글", "漢字 한"), (11, "digital", "ㄱㄴㄷㄱㄴㄷ", "ㄱㄴㄷㄱㄴㄷ"),
    (12, "digital", "ㄱㄴㄷㄱㄴㄷ", "한글"), (13, "scanned", "ㄱㄴㄷ", "漢字 한 글"), (14, "hybrid", "한글", "문서 글 한 " * 9), (15, "scanned", "2024 한글", "2023 한글"),
]
_pairs = ", ".join(f"({i}, '{c}', '{p}', '{o}')" for i, c, p, o in KOREAN_PAIRS)


def measures(a: str, x: str) -> str:
    """Counts of syllables, jamo and hanja of a text column, and its quality, as <x>s, <x>j, <x>h, <x>q."""
    s_, j_, h_ = (count(a, p) for p in (_SYL, _JAMO, _HANJA))
    return f"{s_} AS {x}s, {j_} AS {x}j, {h_} AS {x}h, 2 * {s_} - 3 * {j_} AS {x}q"


_few = lambda x: f"translate({x}, '한글문서ㄱㄴㄷ漢字', '{_STAND_INS[:9]}')"
korean_pairs = f"""
WITH v(id, class, pt, ot) AS (VALUES {_pairs}),
m AS (SELECT *, {norm('ot')} AS n, {sim('pt', 'ot').replace(octets('pt'), _few('pt')).replace(octets('ot'), _few('ot'))} AS sim, {measures('pt', 'p')}, {measures('ot', 'o')} FROM v),
k AS (SELECT *, ps + pj + os + oj > 0 AS kor, length(n) <= 1 OR {count('n', '[A-Za-z0-9\\x{AC00}-\\x{D7A3}]')} <= 1 OR (length(n) >= 6 AND len(list_distinct(string_split(n, ''))) <= 2) OR (os + oj > 0 AND (oh >= 2 OR oq < -6)) AS noisy FROM m),
c AS (SELECT *, CASE
    WHEN sim >= 0.72 AND class = 'scanned' THEN 'ocr+fused' WHEN sim >= 0.72 THEN 'parser+fused'
    WHEN class = 'digital' AND kor AND sim < 0.30 AND oq > pq + 5 AND length(ot) > length(pt) + 40 THEN 'ocr'
    WHEN class = 'hybrid' AND ((kor AND sim < 0.30 AND oq > pq + 4 AND length(ot) > length(pt) + 50) OR (sim < 0.35 AND length(ot) > length(pt) + 80 AND NOT noisy)) THEN 'ocr'
    WHEN class = 'scanned' AND n <> '' AND NOT noisy THEN 'ocr' ELSE 'parser' END AS ch, {conf('true', 'true', 'sim', 'true')} AS base FROM k),
d AS (SELECT *, CASE WHEN ch LIKE '%fused' THEN 'fused' ELSE ch END AS source, CASE WHEN kor AND ch = 'parser' AND pq < -2 THEN {clamp('base - 2e-1')} WHEN kor AND ch = 'ocr' AND oq > 0 THEN {clamp('base + 5e-2')} ELSE base END AS c1 FROM c)
SELECT id, source, round(CASE WHEN class = 'scanned' AND source = 'ocr' THEN {clamp('c1 + 8e-2')} ELSE c1 END, 6) AS confidence, CASE WHEN ch LIKE 'ocr%' THEN ot ELSE pt END AS text, round(sim, 6) AS sim FROM d
"""
#: Blocks of pages: doc_id, seq, source, text.
KOREAN_BLOCKS = [
    (1, 0, "parser", "ㄱㄴㄷㄹㅁㅂㅅ"), (1, 1, "ocr", "한글 문서"), (2, 0, "parser", "한국어 문서의 본문은 충분히 길고 또한 믿을 만합니다 그렇습니다"), (2, 1, "ocr", "한글 조각"), (2, 2, "ocr", "English words stay"),
    (3, 0, "parser", "ㄱㄴㄷㄹㅁㅂㅅ"), (3, 1, "ocr", "ㄱㄴㄷㄹㅁㅂㅅㅇㅈㅊ"), (4, 0, "parser", "짧은 글"), (4, 1, "ocr", "짧은 조각"), (5, 0, "fused", "이 문서는 두 쪽에서 온 글로 되어 있으며 모두 읽을 수 있다"), (5, 1, "ocr", "읽을 수 있다"),
    (6, 0, "parser", "Plain English text of a page"), (6, 1, "ocr", "한글"), (7, 0, "ocr", "ㄱㄴ"), (8, 0, "parser", "ㄱㄴㄷㄹㅁㅂㅅㅇ"), (8, 1, "parser", "온전한 글"),
]
_kb = "v(doc_id, seq, source, text) AS (VALUES " + ", ".join(f"(CAST({d} AS BIGINT), {n}, '{c}', '{t}')" for d, n, c, t in KOREAN_BLOCKS) + f"), k AS (SELECT *, {measures('text', 'k')} FROM v)"
degraded_parser = f"WITH {_kb} SELECT doc_id, seq FROM (SELECT *, max(CASE WHEN source = 'ocr' THEN kq END) OVER (PARTITION BY doc_id) AS best FROM k) WHERE NOT coalesce(source = 'parser' AND ks + kj > 0 AND kq < -10 AND best > kq, false)"
korean_ocr = f"WITH {_kb} SELECT doc_id, seq FROM (SELECT *, coalesce(sum(CASE WHEN source <> 'ocr' THEN ks END) OVER w >= 18 AND max(CASE WHEN source <> 'ocr' THEN kq END) OVER w >= -1, false) AS ok FROM k WINDOW w AS (PARTITION BY doc_id)) WHERE NOT (ok AND source = 'ocr' AND ks + kj > 0)"
korean_singles = f"""WITH {_kb} SELECT doc_id, seq, class, round(CASE WHEN source = 'ocr' THEN 4e-1 + (CASE class WHEN 'scanned' THEN 8e-2 ELSE 0e0 END) ELSE 5e-1 - (CASE WHEN ks + kj > 0 AND kq < -2 THEN 2e-1 ELSE 0e0 END) - (CASE class WHEN 'scanned' THEN 1e-1 ELSE 0e0 END) END, 6) AS confidence,
  source = 'parser' AND ks + kj > 0 AND kj >= 2 * ks AND kj >= 8 AS skipped FROM k CROSS JOIN (VALUES ('digital'), ('scanned'), ('hybrid')) c(class)"""
