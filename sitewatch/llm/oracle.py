"""SQL for DuckDB that says what some of the operators return, over the same tables."""

from __future__ import annotations

from .mixing import REPEATS, SEED, WEIGHTS
from .url_filter import DAMPING, LINK, RULES, SETTLED, THRESHOLD

WORD = r"[^\x20\x09-\x0D]+"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
 g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
 SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
   list_aggregate(list_transform(range(32), lambda j: substr('{BASE32}', ((('0x' || substr(h, (j // 4) * 5 + 1, 5))::INT >> (15 - 5 * (j % 4))) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
   CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM g"""

CONTROL = ("<s>", "[INST]", "[/INST]", "</s>", "\\")


def escaped_length(text: str) -> str:
    """Characters of a text once its control strings and backslashes are escaped, one more for each; of << and >>
    there is one for each character in a run but the first."""
    twice = [f"(length({text}) - length(replace({text}, '{c}', '')) - len(regexp_extract_all({text}, '{c}+')))" for c in "<>"]
    return " + ".join([f"length({text})", *twice, *[f"(length({text}) - length(replace({text}, '{c}', ''))) // {len(c)}" for c in CONTROL]])


CHAT = f"""WITH c AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
   UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
   coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
   sum({escaped_length('text')} + CASE role WHEN 'assistant' THEN 5 WHEN 'user' THEN 18 ELSE 23 + {escaped_length('role')} END)::BIGINT AS formatted_chars FROM c GROUP BY 1"""

MIXTURE = f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, md5('{SEED}|' || CASE WHEN doc_id IS NULL THEN '' ELSE doc_id || '|' END || md5(coalesce(text, ''))) AS key FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY 1),
 w AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][(rank % {len(WEIGHTS)} + 1)::INT]::BIGINT AS weight, source_size * {REPEATS} AS most FROM s),
 o AS (SELECT *, sum(source_size) OVER ()::BIGINT AS budget, sum(weight) OVER ()::BIGINT AS all_, coalesce(sum(most) OVER f, 0)::BIGINT AS used, coalesce(sum(weight) OVER f, 0)::BIGINT AS gone FROM w WINDOW f AS (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 c AS (SELECT *, CASE WHEN most::DOUBLE > (weight * (budget - used))::DOUBLE / (all_ - gone)::DOUBLE THEN [budget - used, all_ - gone] END AS level FROM o),
 l AS (SELECT *, first_value(level IGNORE NULLS) OVER (ORDER BY most / weight, rank ROWS UNBOUNDED PRECEDING) AS lev FROM c),
 t AS (SELECT *, CASE WHEN lev IS NULL THEN most::DOUBLE ELSE (weight * lev[1])::DOUBLE / lev[2]::DOUBLE END AS target FROM l),
 r AS (SELECT d.doc_id, d.size, d.key, t.rank, t.source_size, t.target, t.budget, sum(d.size) OVER (PARTITION BY t.rank ORDER BY d.key, d.size ROWS UNBOUNDED PRECEDING)::BIGINT AS total, row_number() OVER () AS row FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
 e AS (SELECT r.*, e, CASE WHEN target > 0 THEN (total + e * source_size)::DOUBLE / target ELSE 'inf'::DOUBLE END AS finish FROM r CROSS JOIN range({REPEATS}) x(e)),
 m AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, e, key, size ROWS UNBOUNDED PRECEDING) <= budget AS taken FROM e)
 SELECT any_value(doc_id) AS doc_id, any_value(size)::BIGINT AS size, any_value(source_size) AS source_size, any_value(target) AS target, (any_value(size) * count(*) FILTER (taken))::BIGINT AS taken FROM m GROUP BY row"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
JACCARD = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
 g AS (SELECT row, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
 n AS (SELECT row, doc_id, len(s) AS n, hash(list_sort(s)) AS same FROM g),
 one AS (SELECT same, min(row) AS row, any_value(n) AS n FROM n WHERE n > 0 GROUP BY 1),
 f AS (SELECT one.row, one.n, unnest(s) AS x FROM g JOIN one USING (row)),
 met AS (SELECT a.row AS a, b.row AS b, count(*) AS c, any_value(a.n) AS n, any_value(b.n) AS o FROM f a JOIN f b ON a.x = b.x AND a.row < b.row AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80 GROUP BY 1, 2),
 link AS (SELECT a, b FROM met WHERE 100 * c >= 80 * (n + o - c)), ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
 reach AS (SELECT row AS a, row AS b FROM one WHERE row IN (SELECT a FROM ways) UNION SELECT r.a, t.b FROM reach r JOIN ways t ON t.a = r.b),
 root AS (SELECT one.row, one.same, coalesce(min(r.b), one.row) AS root FROM one LEFT JOIN reach r ON r.a = one.row GROUP BY 1, 2),
 named AS (SELECT n.row, n.doc_id, n.n, min(n.doc_id) OVER (PARTITION BY root) AS component FROM n JOIN root ON root.same = n.same WHERE n > 0)
 SELECT doc_id, n AS n_shingles, component AS component_id FROM named UNION ALL SELECT doc_id, n, doc_id FROM n WHERE n = 0"""

#: The unsigned CRC-32 of a text: its table's column t from crc_table, in the same query.
CRC_TABLE = "crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i)))"


def crc32(text: str) -> str:
    code = f"list_transform(range(octet_length(encode({text}))), lambda j: ('0x' || substr(hex(encode({text})), (j * 2 + 1)::INT, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {code}), lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295)"


#: Letters beyond ASCII by others of one byte, as levenshtein() counts bytes.
HIGH, FLAT = "".join(map(chr, range(0xC0, 0x100))), "".join(map(chr, range(33, 97))).replace("'", "''")
SPELLING = f"""WITH RECURSIVE {CRC_TABLE},
 occ AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{{5,}}')), '{UPPER}', '{LOWER}') AS run FROM documents) GROUP BY 1, 2),
 hashed AS (SELECT run, c, {crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM occ, crc_table),
 v AS (SELECT word, sum(c)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed) WHERE length(word) >= 5 GROUP BY 1 HAVING sum(c) >= 3),
 cut AS (SELECT word, n, translate(word, '{HIGH}', '{FLAT}') AS f, unnest(list_distinct(list_prepend(word, list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1))))) AS x FROM v),
 near AS (SELECT DISTINCT a.word AS w, b.word AS o, b.n AS n FROM cut a JOIN cut b USING (x) WHERE a.word <> b.word AND levenshtein(a.f, b.f) = 1),
 best AS (SELECT w, count(*) AS n_near, arg_max(o, n) AS any_, max(n) AS most FROM near GROUP BY 1),
 first AS (SELECT b.w, n_near, most, min(o) AS o FROM best b JOIN near ON near.w = b.w AND near.n = most GROUP BY 1, 2, 3),
 form AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * v.n THEN o END AS form, CASE WHEN most >= 2 * v.n THEN most END AS form_n FROM v LEFT JOIN first ON first.w = v.word),
 walk AS (SELECT word, form AS at FROM form WHERE form IS NOT NULL UNION ALL SELECT walk.word, f.form FROM walk JOIN form f ON f.word = walk.at WHERE f.form IS NOT NULL),
 last AS (SELECT walk.word, walk.at FROM walk JOIN form f ON f.word = walk.at WHERE f.form IS NULL)
 SELECT form.word, form, coalesce(last.at, form.word) AS root, n, n_near, form_n FROM form LEFT JOIN last USING (word)"""

AFTER = "CASE WHEN contains({0}, '://') THEN substr({0}, strpos({0}, '://') + 3) END"
HOST = f"translate(regexp_extract({{0}}, '^[^/?#]*'), '{UPPER}', '{LOWER}')"
FITS = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{{i}}}" for i, (v, h, p) in sorted(enumerate(RULES), key=lambda r: -len(r[1][1] + r[1][2])))
URLS = f"""WITH RECURSIVE a AS (SELECT page_id, html, {AFTER.format('url')} AS rest FROM pages),
 p AS (SELECT page_id, html, coalesce({HOST.format('rest')}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM a),
 j AS (SELECT *, CASE {FITS.format(*[f"'{h}{p}'" for _, h, p in RULES])} END AS rule, CASE {FITS.format(*[f"'{v}'" for v, _, _ in RULES])} END AS said FROM p),
 hosts AS (SELECT host, (count(*) FILTER (said = 'allow') - count(*) FILTER (said = 'block')) / count(*) AS balance FROM j WHERE host <> '' GROUP BY 1),
 u AS (SELECT row, host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{LINK.replace("'", "''")}', 1), lambda l: {HOST.format("CASE WHEN starts_with(l, '//') THEN substr(l, 3) ELSE " + AFTER.format("l") + " END")}))) AS dst FROM (SELECT row_number() OVER () AS row, * FROM p)),
 up AS (SELECT h.host AS src, x.host AS dst FROM hosts h JOIN hosts x ON x.host = substr(h.host, strpos(h.host, '.') + 1) AND x.host <> h.host),
 l AS (SELECT src, dst, count(*) AS n FROM (SELECT src, dst FROM u WHERE src <> '' AND dst <> '' AND src <> dst UNION ALL SELECT src, dst FROM up UNION ALL SELECT dst, src FROM up) GROUP BY 1, 2),
 s AS (SELECT 'trust' AS kind, src AS at, dst AS too, n / sum(n) OVER (PARTITION BY src) AS share FROM l UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM l),
 m AS (SELECT 0 AS k, CASE WHEN balance > 0 THEN 'trust' ELSE 'distrust' END AS kind, host, abs(balance)::DOUBLE AS mass FROM hosts WHERE balance <> 0
   UNION ALL SELECT any_value(k) + 1, s.kind, s.too, {DAMPING} * sum(mass * share) FROM (SELECT *, max(mass) OVER () AS top FROM m) x JOIN s ON s.kind = x.kind AND s.at = x.host WHERE k = 0 OR top > {SETTLED} GROUP BY s.kind, s.too),
 got AS (SELECT host, round(coalesce(sum(mass) FILTER (kind = 'trust'), 0), 9) AS trust, round(coalesce(sum(mass) FILTER (kind = 'distrust'), 0), 9) AS distrust FROM m GROUP BY 1)
 SELECT page_id, j.host, path, rule, coalesce(said, CASE WHEN distrust >= {THRESHOLD} AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN got ON got.host = j.host"""

TRIE = f"""WITH {CRC_TABLE}, t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
 h AS (SELECT c, {crc32('c::VARCHAR')} % 4 AS h FROM (SELECT DISTINCT c FROM t), crc_table),
 both_ AS (SELECT h.c, 0 AS own, t.i, role, text FROM h JOIN t ON t.c = h.c - h.c % 20 AND t.i <= h UNION ALL SELECT t.c, 1, t.i, role, text FROM t JOIN h USING (c) WHERE t.i > h),
 r AS (SELECT c, row_number() OVER w AS d, len(regexp_extract_all(text, '{WORD}')) AS words, md5(string_agg(md5(role) || md5(text), '') OVER w) AS p FROM both_ WINDOW w AS (PARTITION BY c ORDER BY own, i)),
 m AS (SELECT c, 0 AS d, 0 AS words, '' AS p FROM h UNION ALL SELECT c, d, words, p FROM r),
 ends AS (SELECT c, max(d) AS d FROM m GROUP BY 1),
 nodes AS (SELECT p, m.d, min(m.c) AS conv_id, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(m.c::VARCHAR, ',' ORDER BY m.c) FILTER (ends.d = m.d), '')) AS ends_sha256 FROM m JOIN ends ON ends.c = m.c GROUP BY 1, 2),
 up AS (SELECT x.p, x.d, y.p AS q, nodes.conv_id AS parent FROM nodes x LEFT JOIN m y ON y.c = x.conv_id AND y.d = x.d - 1 LEFT JOIN nodes ON nodes.p = y.p AND nodes.d = y.d),
 kids AS (SELECT q, d - 1 AS d, count(*) AS k FROM up WHERE q IS NOT NULL GROUP BY 1, 2),
 sub AS (SELECT y.p, y.d, count(*) FILTER (kids.k IS NULL) AS leaves, sum((x.n_convs - 1) * x.words) AS saved FROM nodes x JOIN m y ON y.c = x.conv_id AND y.d <= x.d LEFT JOIN kids ON kids.q = x.p AND kids.d = x.d GROUP BY 1, 2)
 SELECT nodes.conv_id, nodes.d AS depth, up.parent AS parent_conv_id, n_convs, coalesce(kids.k, 0) AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, ends_sha256
 FROM nodes JOIN up ON up.p = nodes.p AND up.d = nodes.d JOIN sub ON sub.p = nodes.p AND sub.d = nodes.d LEFT JOIN kids ON kids.q = nodes.p AND kids.d = nodes.d"""

ORACLE_SQL = {"op5_warc": WARC, "op6_mixture": MIXTURE, "op7_jaccard_join": JACCARD, "op9_chat": CHAT, "op11_spelling_variants": SPELLING, "op12_url_filter": URLS, "op13_prefix_trie": TRIE}
