"""DuckDB statements that state the same results as the queries."""

from __future__ import annotations

from trackloom.llm import urlgraph
from trackloom.llm.quality import MAX_REPEAT_PERCENT, MIN_WORDS, RULES, STOP_WORDS, WINDOW

SPACE_CHARS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
AZ = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_DEDUP = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d
), k AS (
  SELECT *, {AZ.format(f"trim(line, {SPACE_CHARS})")} AS key FROM l
), common AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key
  HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '?')) >= 10
), m AS (
  SELECT k.*, common.key IS NOT NULL AS gone FROM k LEFT JOIN common USING (key)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines,
  CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""


def quality_rules() -> str:
    stop = "(" + "|".join(STOP_WORDS) + ")"
    bounds = []
    for r in RULES:
        asked = f" AND n_words >= {r.words_from}" + (f" AND n_bytes <= {r.bytes_a_char}::DOUBLE * n_chars" if r.bytes_a_char is not None else "")
        bounds += [f"{r.metric} < {r.least}{asked}"] * (r.least is not None)
        bounds += [f"{r.metric} > {r.most}{asked}"] * (r.most is not None)
    broken = " OR ".join(f"coalesce({b}, false)" for b in bounds)
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM d
), g AS (
  SELECT r, unnest(range(1, greatest(len(words) - {WINDOW - 1}, 0) + 1)) AS i, words FROM w
), h AS (
  SELECT r, i, list_slice(words, i, i + {WINDOW - 1}) AS gram FROM g
), again AS (
  SELECT r, i FROM h QUALIFY count(*) OVER (PARTITION BY r, gram) >= 2
), cover AS (
  SELECT r, count(DISTINCT i + k) AS n FROM again, range(0, {WINDOW}) AS t(k) GROUP BY r
), c AS (
  SELECT w.r, doc_id, CAST(len(words) AS BIGINT) AS n_words, strlen(text) AS n_bytes, length(text) AS n_chars,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    len(regexp_extract_all(text, '!!')) AS n_shouts,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(words, lambda x: regexp_full_match(x, '(?i){stop}'))) AS n_stop,
    len(lines) AS n_lines,
    len(list_filter(lines, lambda s: regexp_matches(s, '^[ \\t]*[-*•][ \\t]'))) AS n_bullets,
    len(list_filter(lines, lambda s: regexp_matches(s, '(\\.\\.\\.|…)[ \\t\\r]*$'))) AS n_ellipsis
  FROM w LEFT JOIN cover USING (r)
), m AS (
  SELECT *, word_chars / nullif(n_words, 0) AS mean_word_length, n_symbols / nullif(n_words, 0) AS symbol_ratio,
    n_shouts / nullif(n_words, 0) AS shout_ratio, 
    n_stop / nullif(n_words, 0) AS stop_word_ratio, n_dup_lines / nullif(n_lines, 0) AS dup_line_ratio,
    n_bullets / nullif(n_lines, 0) AS bullet_line_ratio, n_ellipsis / nullif(n_lines, 0) AS ellipsis_line_ratio,
    n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({broken}) AS kept
FROM m
"""


MIXING = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15) AS BIGINT) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank
  FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][1 + (rank - 1) % 3] AS weight, 2.0::DOUBLE * source_size AS cap FROM s
), v AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER b, 0.0::DOUBLE))
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
  FROM w WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM v
), q AS (
  SELECT r, doc_id, d.source, key, size, source_size, target,
    CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, size, r ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT r, source, round, key, size, CAST(round * source_size + start + size AS DOUBLE) / target AS finish
  FROM q, (VALUES (0), (1)) AS v(round) WHERE size > 0
), m AS (
  SELECT r, size, sum(size) OVER (ORDER BY finish, source NULLS LAST, round, key, size, r ROWS UNBOUNDED PRECEDING) AS upto FROM e
), k AS (
  SELECT r, sum(size) AS taken FROM m WHERE upto <= (SELECT floor(1.5::DOUBLE * CAST(sum(size) AS DOUBLE)) FROM d) GROUP BY r
)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN k USING (r)
"""


def url_graph() -> str:
    """The rules and all rounds of both walks, one common table expression a round."""
    fits = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'rule': '{h}{p}', 'verdict': '{v}'}}"
        for v, h, p in sorted(urlgraph.RULES, key=lambda r: -len(r[1] + r[2]))
    )
    d = urlgraph.DAMPING
    rounds = ", ".join(
        f"""s{k + 1} AS (SELECT walk, host, sum(score) AS score FROM (
          SELECT walk, host, {1 - d} * score AS score FROM s0 UNION ALL
          SELECT s.walk, e.b, {d} * s.score * e.share FROM s{k} s JOIN e ON s.walk = e.walk AND s.host = e.a) GROUP BY ALL)"""
        for k in range(urlgraph.ROUNDS)
    )
    link = urlgraph.LINK.replace("'", "''")
    return f"""
WITH u AS (
  SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, html, {AZ.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), f AS (
  SELECT *, CASE {fits} END AS fit FROM h
), links AS (
  SELECT host AS src, {AZ.format("dst")} AS dst FROM (
    SELECT host, unnest(list_concat(regexp_extract_all(html, '{link}', 1), regexp_extract_all(html, '{urlgraph.MAIL}', 1))) AS dst FROM f)
), w AS (
  SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM links WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL
), t AS (
  SELECT 'trust' AS walk, src AS a, dst AS b, weight FROM w UNION ALL SELECT 'distrust', dst, src, weight FROM w
), e AS MATERIALIZED (
  SELECT walk, a, b, weight / sum(weight) OVER (PARTITION BY walk, a) AS share FROM t
), hs AS (
  SELECT host, count(*) AS n, count(*) FILTER (WHERE fit.verdict = 'allow') AS allowed, count(*) FILTER (WHERE fit.verdict = 'block') AS blocked
  FROM f WHERE host <> '' GROUP BY host
), v AS (
  SELECT 'trust' AS walk, host, allowed AS n FROM hs WHERE allowed > 0 UNION ALL SELECT 'distrust', host, blocked FROM hs WHERE 2 * blocked > n
), s0 AS (
  SELECT walk, host, n / sum(n) OVER (PARTITION BY walk) AS score FROM v
), {rounds}, z AS (
  SELECT host, coalesce(max(score) FILTER (WHERE walk = 'trust'), 0) AS trust,
    coalesce(max(score) FILTER (WHERE walk = 'distrust'), 0) AS distrust
  FROM s{urlgraph.ROUNDS} GROUP BY host
)
SELECT page_id, f.host, path, fit.rule AS rule,
  coalesce(fit.verdict, CASE WHEN coalesce(distrust, 0) - coalesce(trust, 0) > {urlgraph.THRESHOLD} * (coalesce(distrust, 0) + coalesce(trust, 0)) THEN 'block' ELSE 'allow' END) AS verdict
FROM f LEFT JOIN z ON f.host = z.host
"""


#: Every pair of documents that share a five-word window, by exact Jaccard; classes by the closure of the links.
NGRAM_JACCARD = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({AZ.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT r, array_to_string(list_slice(w, i, i + 4), ' ') AS gram FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT r, count(*) AS n FROM g GROUP BY r), b AS (
  SELECT x.r AS a, y.r AS b, count(*) AS shared FROM g x JOIN g y ON x.gram = y.gram AND x.r < y.r GROUP BY ALL
), e AS (
  SELECT a, b FROM b JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE shared >= 0.8::DOUBLE * (p.n + q.n - shared) - 1e-9
), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), reach AS (
  SELECT a, b FROM u UNION SELECT reach.a, u.b FROM reach JOIN u ON reach.b = u.a
), c AS (
  SELECT reach.a AS r, min(d.doc_id) AS least FROM reach JOIN d ON d.r = reach.b GROUP BY 1
), k AS (SELECT a AS r, count(*) AS links FROM u GROUP BY 1)
SELECT doc_id, coalesce(least(least, doc_id), least, doc_id) AS class_id, coalesce(links, 0) AS n_links FROM d LEFT JOIN c USING (r) LEFT JOIN k USING (r)
"""


TURN_REPAIR = r"""
WITH RECURSIVE r AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), c AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length(k) + 1), lambda i: [CAST(ascii(substr(k, i, 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)), 4294967295) % 20 AS damage FROM r
), d AS (
  SELECT conv_id, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role, CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE damage WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE damage <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST, md5(role || chr(0) || text), copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM d
), f AS (
  SELECT *, left(role, 1) AS init, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'none' ELSE 'truncated' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o
), e AS (
  SELECT conv_id, i, n, init, role, text, fault IN ('none', 'truncated') AS stays, CASE fault WHEN 'truncated' THEN 1 ELSE 0 END AS more FROM f
), b AS (
  SELECT DISTINCT conv_id, n AS i, [0, 4, 2, 0] AS c FROM f
  UNION ALL
  SELECT conv_id, i, [least(q[1], 2 + least(q[3], 2 + q[4])), least(q[2], 2 + least(q[3], 2 + q[4])), least(q[3], 2 + q[4]), least(q[4], 2 + q[3])] FROM (
    SELECT b.conv_id, b.i - 1 AS i, [
      least(3 + c[1], CASE WHEN stays THEN more + least(2 + c[3], CASE init WHEN 's' THEN c[2] WHEN 'u' THEN c[3] ELSE 999999 END) ELSE 999999 END),
      least(3 + c[2], CASE WHEN stays THEN more + least(2 + c[3], CASE init WHEN 'u' THEN c[3] ELSE 999999 END) ELSE 999999 END),
      least(3 + c[3], CASE WHEN stays THEN more + least(2 + c[4], CASE init WHEN 'a' THEN c[4] ELSE 999999 END) ELSE 999999 END),
      least(3 + c[4], CASE WHEN stays THEN more + least(2 + c[3], CASE init WHEN 'u' THEN c[3] ELSE 999999 END) ELSE 999999 END)] AS q
    FROM b JOIN e ON e.conv_id IS NOT DISTINCT FROM b.conv_id AND e.i = b.i)
), p AS (
  SELECT now.conv_id, now.i, now.c AS c, nxt.c AS after, init, role, text, stays, more FROM b now LEFT JOIN b nxt ON nxt.conv_id IS NOT DISTINCT FROM now.conv_id AND nxt.i = now.i + 1
  LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM now.conv_id AND e.i = now.i + 1
), w AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 1 AS q, '' AS audit, CAST(NULL AS VARCHAR) AS repaired, false AS done FROM f
  UNION ALL
  SELECT conv_id, CASE WHEN edit IN ('I', '.') THEN i ELSE i + 1 END, CASE edit WHEN 'D' THEN q WHEN '.' THEN q WHEN 'K' THEN kept ELSE due END, CASE edit WHEN '.' THEN audit ELSE audit || edit END,
    CASE WHEN edit IN ('D', '.') THEN repaired ELSE coalesce(repaired || chr(10), '') || CASE edit WHEN 'K' THEN role ELSE CASE q WHEN 3 THEN 'assistant' ELSE 'user' END END || ':' || CASE edit WHEN 'I' THEN '' ELSE text END END, edit = '.'
  FROM (SELECT *, CASE WHEN after IS NULL AND c[q] = 0 THEN '.' WHEN after IS NOT NULL AND c[q] = 3 + after[q] THEN 'D' WHEN c[q] = 2 + c[due] THEN 'I' WHEN stays AND kept IS NOT NULL AND c[q] = more + after[kept] THEN 'K' ELSE 'R' END AS edit
    FROM (SELECT w.*, p.* EXCLUDE (conv_id, i), [3, 3, 4, 3][q] AS due, CASE WHEN q = 1 AND init = 's' THEN 2 WHEN q <> 3 AND init = 'u' THEN 3 WHEN q = 3 AND init = 'a' THEN 4 END AS kept
      FROM w JOIN p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.i = w.i WHERE NOT w.done))
), s AS (
  SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || init NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
), a AS (SELECT DISTINCT conv_id FROM conversations)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(b.c[1], 0) AS BIGINT) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM a LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.i = 0 LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM a.conv_id AND w.done
"""
