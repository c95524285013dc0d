"""The operators' queries, and their SQL where SQL can express them."""

from __future__ import annotations

from gridweave.llm import bpe, chat, decontam, neardup, ogg, phrases, pii, quality, repeats, stamps, tokenfile, urls, warc
from gridweave.llm.common import read


def op1_decontamination(spark, sf_dir):
    return decontam.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op3_bpe(spark, sf_dir):
    return bpe.digests(read(spark, sf_dir, "documents"))


def op4_chat(spark, sf_dir):
    return chat.digests(chat.with_trial(read(spark, sf_dir, "conversations")))


def op5_quality(spark, sf_dir):
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_urls(spark, sf_dir):
    return urls.judge(read(spark, sf_dir, "pages"))


def url_rules(spark, sf_dir):
    """The part of op6 that SQL can express."""
    return urls.with_rule(urls.split_url(read(spark, sf_dir, "pages").select("page_id", "url"))).select("page_id", "host", "path", "rule")


def op7_ogg(spark, sf_dir):
    return ogg.describe(ogg.encode(read(spark, sf_dir, "documents")))


def op8_pii(spark, sf_dir):
    return pii.apply(read(spark, sf_dir, "documents").select("doc_id", "text"), key=pii.session_key(spark))


def op9_token_files(spark, sf_dir):
    return tokenfile.write_and_read(read(spark, sf_dir, "documents"))


def op10_warc(spark, sf_dir):
    return warc.write_and_read(read(spark, sf_dir, "pages"))


def op11_repeats(spark, sf_dir):
    return repeats.digests(read(spark, sf_dir, "documents"))


def op12_stamps(spark, sf_dir):
    return stamps.normalise(read(spark, sf_dir, "stamps"))


def op13_phrases(spark, sf_dir):
    return phrases.collocations(read(spark, sf_dir, "documents"))


def queries() -> dict:
    every = (op1_decontamination, op2_near_duplicates, op3_bpe, op4_chat, op5_quality, op6_urls, op7_ogg, op8_pii, op9_token_files, op10_warc, op11_repeats, op12_stamps, op13_phrases, url_rules)
    return {f.__name__: f for f in every}


OP1_SQL = r"""
WITH doc AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
item AS (
  SELECT * FROM (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) >= 5),
in_item AS (SELECT item_id, w, x, count(*) AS n FROM (SELECT item_id, w, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS x FROM item) GROUP BY 1, 2, 3),
in_doc AS (SELECT doc_id, w, x, count(*) AS n FROM (SELECT doc_id, w, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS x FROM doc) GROUP BY 1, 2, 3),
pair AS (
  SELECT doc_id, item_id, d.w AS dw, i.w AS iw FROM in_doc d JOIN in_item i ON i.x = d.x GROUP BY 1, 2, 3, 4 HAVING 100 * sum(least(d.n, i.n)) >= 75 * (len(i.w) - 4)),
win AS (
  SELECT doc_id, item_id, iw, greatest(s, 1) - 1 AS b, dw[greatest(s, 1):least(s + len(iw) - 1, len(dw))] AS w, s FROM (SELECT *, unnest(range(6 - len(iw), len(dw) - 3)) AS s FROM pair)),
begun AS (
  SELECT win.* FROM win LEFT JOIN in_item i ON i.item_id IS NOT DISTINCT FROM win.item_id AND i.w = win.iw AND i.x = array_to_string(win.w[1:5], ' ') WHERE len(win.w) >= 5 AND (s < 1 OR i.x IS NOT NULL)),
in_win AS (SELECT item_id, iw, w, x, count(*) AS n FROM (SELECT item_id, iw, w, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS x FROM (SELECT DISTINCT item_id, iw, w FROM begun)) GROUP BY 1, 2, 3, 4),
shared AS (SELECT a.item_id, iw, a.w, len(a.w) + len(iw) - 8 AS total, sum(least(a.n, b.n)) AS n FROM in_win a JOIN in_item b ON a.x = b.x AND a.item_id IS NOT DISTINCT FROM b.item_id AND a.iw = b.w GROUP BY 1, 2, 3),
good AS (SELECT item_id, iw, w, round(CAST(n AS DOUBLE) / (total - n), 6) AS similarity FROM shared WHERE 100 * n >= 75 * (total - n))
SELECT doc_id, item_id, similarity, CAST(b AS INTEGER) AS start_word, CAST(len(w) AS INTEGER) AS n_words FROM (
  SELECT doc_id, g.item_id, similarity, b, g.w, row_number() OVER (PARTITION BY doc_id, g.item_id ORDER BY similarity DESC, b, len(g.w) DESC) AS k
  FROM begun JOIN good g ON g.item_id IS NOT DISTINCT FROM begun.item_id AND g.iw = begun.iw AND g.w = begun.w) WHERE k = 1
"""
OP2_SQL = r"""
WITH RECURSIVE word AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
bag AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM word),
each_ AS (SELECT doc_id, unnest(s) AS x FROM bag),
size AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM bag),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM each_ a JOIN each_ b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ x JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * x.n >= 75 * (p.n + q.n - x.n)),
reach AS (SELECT doc_id AS s, doc_id AS t FROM size UNION SELECT r.s, l.b FROM reach r JOIN link l ON l.a = r.t)
SELECT doc_id, n AS n_shingles, c AS component_id, doc_id = c AS kept FROM size JOIN (SELECT s, min(t) AS c FROM reach GROUP BY s) ON s = doc_id
"""
OP4_SQL = r"""
WITH said AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
size AS (
  SELECT *, 15 + 2 * length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', ''))
    + 2 * length(role) - length(replace(replace(replace(replace(role, '\', ''), '#', ''), '<', ''), ':', '')) AS n FROM said)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM size GROUP BY conv_id
"""
URL_RULES_SQL = r"""
WITH part AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', ['host', 'path']) AS x FROM pages),
page AS (SELECT page_id, translate(x.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, x.path AS path FROM part),
fit(h, p) AS (VALUES ('com', '/en/'), ('example.com', '/en/7'), ('net', '/de/'), ('example.net', '/de/8'), ('org', '/es/'))
SELECT page_id, host, path, (SELECT arg_max(h || p, length(h || p)) FROM fit WHERE (page.host = h OR ends_with(page.host, '.' || h)) AND starts_with(page.path, p)) AS rule FROM page
"""
OP11_SQL = r"""
WITH word AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM word)),
first_ AS (SELECT x, min(doc_id) AS source FROM win GROUP BY x),
gone AS (SELECT win.doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS g FROM win JOIN first_ ON first_.x = win.x AND source < win.doc_id GROUP BY 1),
kept AS (SELECT word.doc_id, w, coalesce(g, []) AS g, CASE WHEN g IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda p: NOT list_contains(g, p[2])), lambda p: p[1]) END AS k FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(g) AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""
OP12_SQL = r"""
WITH text AS (SELECT stamp_id, source, zone, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS t FROM stamps),
part AS (
  SELECT *, regexp_extract(t, '^(?:(20\d\d)-(\d\d)-(\d\d)|(20\d\d)(\d\d)(\d\d)|(\d\d)[.](\d\d)[.](20\d\d)|(\d\d) (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) (20\d\d)|(\d\d)/(\d\d)/(20\d\d))(?:[T ](\d\d):(\d\d)(?::(\d\d))?(?: ?([AP]M))?(?: ?(Z|[+-]\d\d:?\d\d))?)?$',
    ['y1', 'm1', 'd1', 'y2', 'm2', 'd2', 'd3', 'm3', 'y3', 'd4', 'b4', 'y4', 's1', 's2', 'y5', 'h', 'mi', 'se', 'half', 'off']) AS p FROM text),
field AS (
  SELECT stamp_id, source, zone, t, p.off AS off, nullif(p.y1 || p.y2 || p.y3 || p.y4 || p.y5, '') AS y, p.s1 AS s1, p.s2 AS s2,
    CASE WHEN p.b4 <> '' THEN lpad(CAST((position(p.b4 IN 'JanFebMarAprMayJunJulAugSepOctNovDec') + 2) // 3 AS VARCHAR), 2, '0') ELSE p.m1 || p.m2 || p.m3 END AS m, p.d1 || p.d2 || p.d3 || p.d4 AS d,
    CASE WHEN p.h = '' THEN 0 WHEN try_cast(p.mi AS INT) > 59 OR try_cast(coalesce(nullif(p.se, ''), '0') AS INT) > 59 THEN NULL
      WHEN p.half = '' AND try_cast(p.h AS INT) <= 23 THEN try_cast(p.h AS INT) WHEN p.half <> '' AND try_cast(p.h AS INT) BETWEEN 1 AND 12 THEN try_cast(p.h AS INT) % 12 + CASE p.half WHEN 'PM' THEN 12 ELSE 0 END END * 3600
      + try_cast(coalesce(nullif(p.mi, ''), '0') AS INT) * 60 + try_cast(coalesce(nullif(p.se, ''), '0') AS INT) AS clock,
    CASE WHEN p.off IN ('', 'Z') THEN 0 WHEN try_cast(p.off[2:3] AS INT) <= 14 AND try_cast(p.off[-2:] AS INT) <= 59 THEN (try_cast(p.off[2:3] AS INT) * 60 + try_cast(p.off[-2:] AS INT)) * CASE p.off[1] WHEN '-' THEN -60 ELSE 60 END END AS shift FROM part),
wall AS (
  SELECT *, CASE WHEN clock IS NOT NULL AND shift IS NOT NULL THEN epoch(try_cast(y || '-' || m || '-' || d AS DATE)) END + clock AS sure,
    CASE WHEN s1 <> '' AND clock IS NOT NULL AND shift IS NOT NULL THEN epoch(try_cast(y || '-' || s2 || '-' || s1 AS DATE)) END + clock AS day1,
    CASE WHEN s1 <> '' AND clock IS NOT NULL AND shift IS NOT NULL THEN epoch(try_cast(y || '-' || s1 || '-' || s2 AS DATE)) END + clock AS month1 FROM field),
vote AS (SELECT source, count(day1) AS dv, count(month1) AS mv FROM wall WHERE (day1 IS NULL) <> (month1 IS NULL) GROUP BY source),
chosen AS (
  SELECT stamp_id, zone, off, shift, CASE WHEN regexp_full_match(t, '[0-9]{10}') THEN try_cast(t AS BIGINT) * 1000000 WHEN regexp_full_match(t, '[0-9]{13}') THEN try_cast(t AS BIGINT) * 1000 END AS ep,
    CAST(coalesce(sure, CASE WHEN day1 <> month1 AND coalesce(dv, 0) > coalesce(mv, 0) THEN day1 WHEN day1 <> month1 THEN month1 ELSE coalesce(day1, month1) END) AS BIGINT) AS w,
    CASE WHEN day1 <> month1 AND coalesce(dv, 0) <> coalesce(mv, 0) THEN 'votes' WHEN day1 <> month1 THEN 'default' ELSE 'plain' END AS rule
  FROM wall LEFT JOIN vote ON vote.source IS NOT DISTINCT FROM wall.source),
a AS (SELECT *, date_diff('second', make_timestamp((w - 86400) * 1000000), timezone(zone, to_timestamp(w - 86400))) AS b, date_diff('second', make_timestamp((w + 86400) * 1000000), timezone(zone, to_timestamp(w + 86400))) AS c FROM chosen),
fit AS (
  SELECT *, date_diff('second', make_timestamp((w - b) * 1000000), timezone(zone, to_timestamp(w - b))) = b AS fits_b, date_diff('second', make_timestamp((w - c) * 1000000), timezone(zone, to_timestamp(w - c))) = c AS fits_c FROM a)
SELECT stamp_id, coalesce(ep, CASE WHEN off <> '' THEN w - shift WHEN fits_c AND NOT fits_b THEN w - c ELSE w - b END * 1000000) AS utc_us,
  CASE WHEN ep IS NOT NULL THEN 'epoch' WHEN w IS NULL THEN 'bad' ELSE rule END AS rule,
  ep IS NULL AND w IS NOT NULL AND (rule <> 'plain' OR (off = '' AND b <> c AND fits_b = fits_c)) AS ambiguous FROM fit
"""
OP13_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
word AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM word GROUP BY lang),
gram AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM word CROSS JOIN (VALUES (1), (2), (3), (4), (5)) s(m) WHERE len(w) >= m)),
freq AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, count(*) AS a FROM gram GROUP BY 1, 2, 3 HAVING count(*) >= 100),
cut AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, m)) AS k FROM freq WHERE m > 1)),
score AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, t.n, CAST((CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM cut c JOIN total t ON t.lang = c.lang JOIN freq x ON x.lang = c.lang AND x.phrase = c.head JOIN freq y ON y.lang = c.lang AND y.phrase = c.tail),
low AS (SELECT * FROM score QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, a, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, m - n + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS n FROM freq WHERE m > 2))),
kept AS (SELECT * FROM low WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = low.lang AND i.phrase = low.phrase AND 100 * i.a >= 100 * low.a))
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
"""


def oracle_sql() -> dict:
    """SQL slides windows over every place where op1 lays a few. The rest needs a library, a trained model or a file format: tests hold it against plain versions."""
    return {"op1_decontamination": OP1_SQL, "op2_near_duplicates": OP2_SQL, "op4_chat": OP4_SQL, "url_rules": URL_RULES_SQL, "op11_repeats": OP11_SQL, "op12_stamps": OP12_SQL, "op13_phrases": OP13_SQL}
