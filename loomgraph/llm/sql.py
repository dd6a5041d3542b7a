"""DuckDB SQL that gives the same rows as the queries, where SQL can express them on whole tables."""

from __future__ import annotations

from loomgraph.llm.substring_dedup import MIN_WORDS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def substring_dedup(source: str = "documents") -> str:
    """Clauses that an earlier clause equals (A-Z in lower case, white space collapsed), removed in runs of MIN_WORDS words."""
    return rf"""
WITH parts AS (SELECT doc_id, length(text) AS n, list_filter(regexp_extract_all(text, '[^\n]*?(?:[.!?,;:|][ \t\r\x0b\x0c]+|\n|\z)'), lambda x: x <> '') AS p FROM {source} WHERE text IS NOT NULL),
lines AS (SELECT doc_id, n, unnest(p) AS raw, generate_subscripts(p, 1) AS pos FROM parts),
norm AS (SELECT *, trim(regexp_replace(translate(raw, '{UPPER}', '{LOWER}'), '[ \t\n\x0b\x0c\r]+', ' ', 'g')) AS unit FROM lines),
seen AS (SELECT *, CASE WHEN unit <> '' THEN row_number() OVER (PARTITION BY unit ORDER BY doc_id, pos) > 1 END AS rep,
  CASE WHEN unit = '' THEN 0 ELSE length(unit) - length(replace(unit, ' ', '')) + 1 END AS words,
  coalesce(sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos0 FROM norm),
near AS (SELECT *, coalesce(rep, coalesce(last_value(rep IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
  AND coalesce(first_value(rep IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false)) AS e FROM seen),
isle AS (SELECT *, sum(CASE WHEN e THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM near),
runs AS (SELECT *, e AND sum(CASE WHEN e THEN words ELSE 0 END) OVER (PARTITION BY doc_id, k) >= {MIN_WORDS} AS gone FROM isle),
spans AS (SELECT doc_id, k, min(pos0) AS s, max(pos0 + length(raw)) AS t FROM runs WHERE gone GROUP BY doc_id, k),
cuts AS (SELECT doc_id, string_agg(CAST(s AS BIGINT) || '-' || CAST(t AS BIGINT), ';' ORDER BY s) AS removed FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, coalesce(string_agg(CASE WHEN NOT gone THEN raw END, '' ORDER BY pos), '') AS text,
  CAST(count(*) FILTER (WHERE unit <> '') AS INTEGER) AS n_units, CAST(count(*) FILTER (WHERE gone AND rep) AS INTEGER) AS n_removed FROM runs GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text, coalesce(k.n_removed, 0) > 0 AS cut, coalesce(k.n_units, 0) AS n_units, coalesce(k.n_removed, 0) AS n_removed, coalesce(g.removed, '') AS removed
FROM {source} d LEFT JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN cuts g ON g.doc_id = d.doc_id"""


def top_inner_products(source: str = "embeddings", k: int = 5) -> str:
    """Exact inner products of whole-number components, every query against every row."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM {source}
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS s FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INTEGER) AS rank, vec_id, CAST(s AS BIGINT) AS score FROM p)
SELECT * FROM r WHERE rank <= {k}"""


def quality_rules(source: str = "documents") -> str:
    """Counts, base and all rules of the cascade, evaluated without an order."""
    space = r"[\x20\x09-\x0D]"
    word = r"[^\x20\x09-\x0D]"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM {source}),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{word}+') AS ws FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
r AS (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT k) AS n FROM r GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT x) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{word}') GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{space}', '', 'g')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  coalesce(l.dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_lines, len(regexp_extract_all(t, '[A-Z]')) AS up, len(regexp_extract_all(t, '[a-z]')) AS low, len(regexp_extract_all(t, '!!')) AS bang
  FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN l ON l.doc_id = w.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 10 * n_symbols <= n_words AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 2 * n_dup_lines <= n_lines AND up / greatest(1, up + low) <= 0.6 AND 10 * bang <= 3 * n_words AS kept FROM b"""


def filter_audit(source: str = "documents", labels: str = "labels") -> str:
    """Five failures a document, then every step of the 120 orders over the counts of equal documents."""
    letters = "(SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x)"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM {source}),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM {labels} GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CASE WHEN len(ws) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' ELSE '' END
  || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
n AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY part, fails),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM {letters} a, {letters} b, {letters} c, {letters} d, {letters} e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS x, filter_order[1 : step - 1] AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
m AS (SELECT part, filter_order, step, x, n, good, toxic, contains(fails, x) AS hit, translate(fails, earlier, '') <> fails AS gone, fails = x AS alone FROM n, s),
r AS (SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (WHERE NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (WHERE hit AND NOT gone), 0) AS removed,
  coalesce(sum(n) FILTER (WHERE hit AND gone), 0) AS redundant, coalesce(sum(n) FILTER (WHERE alone), 0) AS unique_fails,
  coalesce(sum(good) FILTER (WHERE hit AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE hit AND NOT gone), 0) AS toxic_lost FROM m GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r"""


def _crc32(codes: str) -> str:
    """Unsigned CRC-32 of a list of byte values."""
    return f"xor(4294967295, list_reduce(list_concat([4294967295], {codes}), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"


def merkle_manifest(source: str = "documents") -> str:
    """The tree level by level, what stands beside each path, and each leaf folded along it."""
    field = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
    digest = lambda text: f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    level = lambda t: f"SELECT l + 1, g, p // 3, sha256(string_agg(h, '' ORDER BY p)), (n + 2) // 3 FROM {t} WHERE n > 1 GROUP BY l, g, p // 3, n"
    beside = lambda t: f"SELECT a.l, a.g, a.p, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (WHERE b.p < a.p), '') AS lft, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (WHERE b.p > a.p), '') AS rgt FROM {t} a JOIN {t} b ON b.g = a.g AND b.l = a.l AND b.p // 3 = a.p // 3 WHERE a.n > 1 GROUP BY a.l, a.g, a.p"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, {digest("text")} AS h,
  CASE WHEN {_crc32(codes)} % 2 = 0 THEN {digest("replace(text, chr(10), '')")} END AS fake FROM {source}),
leaf AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM d),
low AS (SELECT 0 AS l, g, p, h, n FROM leaf UNION ALL {level("low")}),
sub AS (SELECT 0 AS g, g AS p, h, count(*) OVER () AS n FROM low WHERE n = 1),
top AS (SELECT 0 AS l, g, p, h, n FROM sub UNION ALL {level("top")}),
lows AS ({beside("low")}), tops AS ({beside("top")}),
path AS (SELECT f.g, f.p, s.l AS k, lft, rgt FROM leaf f JOIN lows s ON s.g = f.g AND s.p = f.p // CAST(pow(3, s.l) AS BIGINT)
  UNION ALL SELECT f.g, f.p, 1000 + s.l, lft, rgt FROM leaf f JOIN tops s ON s.p = f.g // CAST(pow(3, s.l) AS BIGINT)),
steps AS (SELECT *, row_number() OVER (PARTITION BY g, p ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY g, p) AS m FROM path),
fold AS (SELECT g, p, 0 AS i, coalesce(fake, h) AS h, coalesce(fake, h) AS h0 FROM leaf
  UNION ALL SELECT f.g, f.p, f.i + 1, sha256(s.lft || f.h || s.rgt), f.h0 FROM fold f JOIN steps s ON s.g = f.g AND s.p = f.p AND s.i = f.i),
folded AS (SELECT g, p, arg_max(h, i) AS h FROM fold GROUP BY g, p),
proof AS (SELECT g, p, string_agg(lft || rgt, '' ORDER BY i) AS x FROM steps GROUP BY g, p),
root AS (SELECT h FROM top WHERE n = 1)
SELECT f.doc_id, f.h AS leaf, s.h AS subroot, r.h AS root, sha256(coalesce(x.x, '')) AS proof_sha256, o.h AS folded_root, o.h = r.h AS verified
FROM leaf f JOIN sub s ON s.p = f.g JOIN folded o ON o.g = f.g AND o.p = f.p LEFT JOIN proof x ON x.g = f.g AND x.p = f.p, root r"""


def sharding(source: str = "documents", n: int = 16, tolerance: int = 100) -> str:
    """Bytes before each row in key order, the cuts nearest to equal shares of them, and the cuts at or before each row."""
    head = lambda c: f"CAST('0x' || substr(md5(coalesce(CAST({c} AS VARCHAR), '')), 1, 15) AS BIGINT)"
    codes = "list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"""
WITH k AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, {_crc32(codes)} AS text_crc32, {head("text")} AS th, {head("doc_id")} AS rh FROM {source}),
r AS (SELECT *, CAST(sum(size) OVER (ORDER BY th, rh, doc_id ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS b, CAST(sum(size) OVER () AS BIGINT) AS total FROM k),
g AS (SELECT th, min(b) AS s, max(b + size) AS e, any_value(total) AS total FROM r GROUP BY th),
t AS (SELECT total * i // {n} AS t, total // {n * tolerance} AS slack FROM (SELECT max(total) AS total FROM r), (SELECT unnest(range(1, {n})) AS i)),
c AS (SELECT CASE WHEN least(t - g.s, g.e - t) <= slack THEN CASE WHEN t - g.s <= g.e - t THEN g.s ELSE g.e END WHEN t - r.b <= r.b + r.size - t THEN r.b ELSE r.b + r.size END AS at
  FROM t JOIN g ON g.s <= t AND t < g.e JOIN r ON r.b <= t AND t < r.b + r.size),
z AS (SELECT r.*, CAST((SELECT count(*) FROM c WHERE c.at <= r.b) AS INTEGER) AS shard FROM r)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY th, rh, doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM z"""
