"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

OP1 = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g') AS bare FROM documents
), r AS (
  SELECT doc_id, sha256(bare) AS text_sha256, count(*) OVER (PARTITION BY bare) AS group_size,
    first_value(doc_id) OVER (PARTITION BY bare ORDER BY length(t) DESC, doc_id) AS keep_id
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r"""

OP2 = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
    md5('mix:' || doc_id) AS key FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, 3 * source_size AS cap,
    (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST)
), t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), weight *
    (SELECT min_by(level, cap / weight) FROM l WHERE level * weight <= cap)) AS target FROM l
), r AS (
  SELECT d.*, source_size, target, CAST(round(target) AS BIGINT) AS budget,
    sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
  CAST(size * coalesce(budget // source_size, 0) + greatest(0, least(size, budget % source_size - (upto - size))) AS BIGINT) AS taken
FROM r"""

OP10 = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw,
    unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS place FROM documents
), lines AS (
  SELECT *, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM split
), words AS (
  SELECT doc_id, place, row_number() OVER w AS nth, line,
    line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS win
  FROM lines WHERE line <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY place)
), later AS (
  SELECT doc_id, nth FROM (
    SELECT doc_id, nth, row_number() OVER (PARTITION BY win ORDER BY doc_id, nth) AS k FROM words WHERE win IS NOT NULL
  ) WHERE k > 1
), gone AS (
  SELECT DISTINCT words.doc_id, words.place FROM words JOIN later
    ON later.doc_id = words.doc_id AND words.nth BETWEEN later.nth AND later.nth + 2
)
SELECT s.doc_id, count(*) FILTER (s.line <> '') AS n_lines, count(g.place) AS n_removed,
  sha256(coalesce(string_agg(s.raw, chr(10) ORDER BY s.place) FILTER (g.place IS NULL), '')) AS kept_sha256
FROM lines s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.place = s.place GROUP BY s.doc_id"""

# Measures with their denominator and least step, as in the quality rules.
_STEPS = {"word_length": ("n_words", 1), "symbols": ("n_words", 1), "repeats": ("n_words", 6), "dup_lines": ("n_lines", 1), "capitals": ("word_chars", 1)}
_DENOMINATORS = ("n_words", "n_lines", "word_chars")


def _fences(keys: str, name: str) -> str:
    by = f"{keys}, " if keys else ""
    same = f"PARTITION BY {by}measure"
    steps = " ".join(f"WHEN '{m}' THEN {step} / of_{d}" for m, (d, step) in _STEPS.items())
    medians = ", ".join(f"max(q5) FILTER (measure = '{d}') OVER ({f'PARTITION BY {keys}' if keys else ''}) AS of_{d}" for d in _DENOMINATORS)
    q = ", ".join(f"min(value) FILTER (upto >= ceil({x} * size)) AS q{x[2:]}" for x in ("0.5", "0.8"))
    return f"""{name}_upto AS (
  SELECT {by}measure, CASE WHEN bucket = -1000000 THEN CAST(0 AS DOUBLE) ELSE 2 * pow(CAST(1.02 AS DOUBLE), bucket) / CAST(2.02 AS DOUBLE) END AS value,
    sum(n) OVER ({same} ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER ({same}) AS size
  FROM (SELECT {by}measure, bucket, sum(n) AS n FROM sketch GROUP BY ALL)
), {name}_q AS (
  SELECT {by}measure, max(size) AS size, {q} FROM {name}_upto GROUP BY ALL
), {name} AS (
  SELECT {by}measure, size, q8 + 8 * greatest(q8 - q5, CASE measure {steps} END) AS fence FROM (SELECT *, {medians} FROM {name}_q))"""


OP9 = rf"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents
), w AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS nth FROM d
), win AS (
  SELECT doc_id, nth, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS three FROM w
  WINDOW o AS (PARTITION BY doc_id ORDER BY nth)
), again AS (
  SELECT doc_id, nth FROM win WHERE three IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, three) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT nth + k) AS n_repeat_words FROM again, range(3) AS r(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id
), f AS (
  SELECT doc_id, lang, source, len(words) AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_capitals
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)
), m AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    coalesce(word_chars / nullif(n_words, 0), 0) AS word_length, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbols,
    coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeats, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_lines,
    coalesce(n_capitals / nullif(word_chars, 0), 0) AS capitals
  FROM f
), long AS (
  {" UNION ALL ".join(f"SELECT doc_id, lang, source, base_failed, '{m}' AS measure, {m} AS v FROM m" for m in (*_STEPS, *_DENOMINATORS))}
), sketch AS (
  SELECT lang, source, measure, CASE WHEN v <= 0 THEN -1000000 ELSE CAST(ceil(ln(v) / ln(CAST(1.02 AS DOUBLE))) AS INT) END AS bucket,
    count(*) AS n FROM long WHERE NOT base_failed GROUP BY ALL
), {_fences("lang, source", "own")}, {_fences("lang", "by_lang")}, {_fences("", "every")}, limits AS (
  SELECT own.lang, own.source, own.measure, (own.size * own.fence + 100 * (by_lang.size * by_lang.fence + 100 * every.fence)
    / (by_lang.size + 100)) / (own.size + 100) AS fence
  FROM own JOIN by_lang ON own.lang IS NOT DISTINCT FROM by_lang.lang AND own.measure = by_lang.measure
  JOIN every ON every.measure = own.measure WHERE own.measure NOT IN ({", ".join(f"'{d}'" for d in _DENOMINATORS)})
), over AS (
  SELECT DISTINCT long.doc_id FROM long JOIN limits ON long.measure = limits.measure AND long.lang IS NOT DISTINCT FROM limits.lang
    AND long.source IS NOT DISTINCT FROM limits.source WHERE v > limits.fence)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM over) AS kept FROM m"""

OP11 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces
), grams AS (
  SELECT lang, array_to_string(words[i:i + k - 1], ' ') AS phrase, k, count(*) AS f
  FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, range(1, 5) AS r(k))
  GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, phrase, k AS size, f AS a, string_split(phrase, ' ') AS words FROM grams WHERE k > 1 AND f >= 30
), cuts AS (
  SELECT c.*, cut, x.f AS l, y.f AS r,
    CAST(CAST(2000000 AS HUGEINT) * a // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, size)) AS cut FROM c) AS c
  JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(words[1:cut], ' ')
  JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(words[cut + 1:], ' ')
), worst AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), parts AS (
  SELECT lang, a, size, words, unnest(range(2, size)) AS k FROM c
), gone AS (
  SELECT DISTINCT c.lang, c.phrase FROM (SELECT *, unnest(range(1, size - k + 2)) AS i FROM parts) AS p
  JOIN c ON c.lang = p.lang AND c.phrase = array_to_string(p.words[i:i + k - 1], ' ')
  WHERE CAST(100 AS HUGEINT) * p.a >= CAST(80 AS HUGEINT) * c.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM worst ANTI JOIN gone USING (lang, phrase) JOIN totals USING (lang)
QUALIFY rank <= 2000"""

OP12 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS size FROM pages
), s AS (
  SELECT *, max(page_id) OVER (PARTITION BY body) AS largest FROM p)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest,
  CASE WHEN size >= 1000 AND page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN size >= 1000 AND page_id < largest THEN largest END AS refers_to FROM s"""

OP13 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || doc_id) AS h
  FROM documents
), x AS (
  SELECT doc_id, t, units, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS c2,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT doc_id, t, n, form, array_to_string(units[1:least(c1, c2)], '') AS prefix,
    array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle, array_to_string(units[greatest(c1, c2) + 1:], '') AS suffix FROM x)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""

SQL: dict[str, str] = {
    "op1_exact_dedup": OP1, "op2_mixing": OP2, "op9_quality_rules": OP9, "op10_line_dedup": OP10, "op11_collocations": OP11,
    "op12_warc": OP12, "op13_fill_in_middle": OP13,
}
