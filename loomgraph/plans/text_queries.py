"""Similarity and text queries over documents, pages and benchmark items."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import paths, text
from loomgraph.operators import search, similarity
from loomgraph.sources.adapters import COMMERCE_SQL, commerce, market, market_sql
from loomgraph.session import table


def m1_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).alias("n"), F.md5(F.array_join(text.tokens(F.col("text")), " ")).alias("digest"))


def _shingles(spark, d, name="documents", key="doc_id", stored=True):
    return similarity.shingle_table(table(spark, d, name), key, "text", stored)


def m2_shingles(spark, d):
    t = _shingles(spark, d)
    return t.select(F.col("id").alias("doc_id"), "n", F.md5(F.array_join(F.sort_array("shingles"), "|")).alias("digest"))


def m3_skeleton(spark, d):
    s = text.skeleton(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.size(s).alias("n"), F.md5(F.array_join(s, " ")).alias("digest"))


def m4_similar_pairs(spark, d):
    """All pairs of documents, copies too."""
    return similarity.similar_pairs(_shingles(spark, d, stored=False), 0.6).withColumn("sim", F.round("sim", 9))


def m4_classes(spark, d):
    """Every document's class of equal sets."""
    return similarity.equal_sets(_shingles(spark, d)).select("id", "n", "rep", "size")


def m5_find_similar(spark, d):
    out = similarity.best_matches(_shingles(spark, d, "benchmark", "item_id"), _shingles(spark, d), 3, 0.01)
    return out.withColumn("sim", F.round("sim", 9))


def m6_group_bands(spark, d):
    """Documents of one source and language as groups."""
    members = table(spark, d, "documents").select(F.concat_ws("/", "source", "lang").alias("group"), F.col("doc_id").alias("id"))
    out = similarity.group_bands(members, _shingles(spark, d))
    return out.withColumn("mean_sim", F.round("mean_sim", 9)).withColumn("min_sim", F.round("min_sim", 9))


def m7_twins(spark, d):
    n, e = commerce(spark, d)
    return similarity.twins(e, n, 0.7).withColumn("sim", F.round("sim", 9))


def m8_multiset(spark, d):
    """Orders by the multiset of their lines' suppliers and return flags."""
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat_ws("/", "l_suppkey", "l_returnflag").alias("item"))
    return similarity.multiset_pairs(items, 0.7).withColumn("sim", F.round("sim", 9))


def m11_lsh(spark, d):
    return similarity.lsh_pairs(_shingles(spark, d), 0.8).withColumn("sim", F.round("sim", 9))


def m12_incremental(spark, d):
    """Every document whose id is divisible by 50 as changed: its best match of at least 0.6 among all others."""
    hits = similarity.most_similar(_shingles(spark, d, stored=False), F.col("id") % 50 == 0, 2, 0.6).where("query <> id")
    best = hits.groupBy("query").agg(F.min_by(F.struct("id", "sim"), F.col("rank")).alias("m"))
    return best.select("query", "m.id", F.round("m.sim", 6).alias("sim"))


#: Ideas looked for in the market.
IDEAS = ("customers of machinery", "the Supplier 7", "tests of household", "customer 12 c", "auto building customer-3")


def m13_find(spark, d):
    n, e = market(spark, d)
    return search.find(search.build_index(n, e), spark.createDataFrame(list(enumerate(IDEAS)), "query int, text string"))


def p4_suggest(spark, d):
    n = commerce(spark, d)[0]
    return similarity.suggest(n, "BUILDNG").union(similarity.suggest(n, "machine")).union(similarity.suggest(n, "AMERIC"))


def x5_complexity(spark, d):
    return table(spark, d, "pages").select("page_id", text.complexity(F.col("html")).alias("complexity"))


def x6_nesting(spark, d):
    return table(spark, d, "pages").select("page_id", text.nesting(F.col("html")).alias("depth"))


def x7_roles(spark, d):
    path = F.regexp_extract("url", "^https?://([^?#]*)", 1)
    return table(spark, d, "pages").select(paths.role_of(F.concat(path, F.when(F.col("page_id") % 3 == 0, "/tests/a.js").when(F.col("page_id") % 3 == 1, "/examples/b.min.js").otherwise("/c.py"))).alias("role")).groupBy("role").agg(F.count("*").alias("n"))


def x13_imports(spark, d):
    """Links of pages, resolved against the pages there are: an ordered list of candidates, the first that exists."""
    pages = table(spark, d, "pages")
    known = pages.select(F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1).alias("path")).where("path <> ''").distinct()
    href = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"#?]+)'), F.lit(1))).alias("href")).distinct()
    cand = href.select("page_id", "href", F.posexplode(F.array("href", F.concat("href", F.lit("/")), F.concat("href", F.lit("/index.html")))).alias("pos", "path"))
    hit = cand.join(known, "path").groupBy("page_id", "href").agg(F.min_by("path", "pos").alias("target"))
    return href.join(hit, ["page_id", "href"], "left").groupBy("page_id").agg(F.count("*").alias("links"), F.count("target").alias("resolved"))


def f_split_stem(spark, d):
    w = F.explode(text.split_name(F.col("p_name"))).alias("w")
    return table(spark, d, "part").select(w).distinct().select("w", text.stem(F.col("w")).alias("stem"))


QUERIES = {f.__name__: f for f in (m1_tokens, m2_shingles, m3_skeleton, m4_similar_pairs, m4_classes, m5_find_similar, m6_group_bands, m7_twins, m8_multiset, m11_lsh, m12_incremental, m13_find, p4_suggest, x5_complexity, x6_nesting, x7_roles, x13_imports, f_split_stem)}

_Q = lambda s: s.replace("'", "''")
_DROP = ", ".join(f"'{w}'" for w in text.DROPPED)
_BARE = lambda c: rf"regexp_replace(regexp_replace({c}, '//[^\n]*', ' ', 'g'), '/\*[\s\S]*?\*/', ' ', 'g')"
_TOK = f"list_filter(regexp_extract_all(lower(regexp_replace({_BARE('text')}, '(?s){_Q(text.STRINGS)}', ' STR ', 'g')), '{text.TOKENS}'), lambda t: t NOT IN ({_DROP}))"


def _sets(name: str, key: str) -> str:
    return f"(SELECT {key} AS id, CASE WHEN len(t) < 3 THEN [] ELSE list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) END AS sh FROM (SELECT {key}, {_TOK} AS t FROM {name}))"


_SIM = "len(list_intersect(a.sh, b.sh)) / (len(a.sh) + len(b.sh) - len(list_intersect(a.sh, b.sh)))"
_ITEMS = "I AS (SELECT id, len(sh) AS n, unnest(sh) AS s FROM S)"
_KEEP = ", ".join(f"'{w}'" for w in text.KEPT["js"])
_STRIP = f"regexp_replace({_BARE('html')}, '{_Q(text.STRINGS)}', ' ', 'g')"
_STEM = "CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN left(w, length(w) - 3) || 'y' ELSE CASE WHEN length(f) > 4 AND f LIKE '%e' THEN left(f, length(f) - 1) ELSE f END END"
_FIRST = "CASE WHEN length(w) > 5 AND w LIKE '%ing' THEN left(w, length(w) - 3) WHEN length(w) > 4 AND (w LIKE '%ed' OR w LIKE '%es' OR w LIKE '%er') THEN left(w, length(w) - 2) WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END"
_SPLIT = lambda c: f"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: x <> '')"



def _suggest(wanted: str) -> str:
    w = wanted.lower()
    return f"""(SELECT id, label, tier FROM (SELECT id, label, CASE WHEN lower(label) = '{w}' THEN 5 WHEN length(label) >= 3 AND (starts_with(lower(label), '{w}') OR starts_with('{w}', lower(label))) THEN 4
WHEN length(label) >= 3 AND (contains(lower(label), '{w}') OR contains('{w}', lower(label))) THEN 3 WHEN list_has_any({_SPLIT('label')}, {_SPLIT(repr(wanted))}) THEN 2
WHEN length(label) >= 3 AND levenshtein(lower(label), '{w}') <= 2 THEN 1 ELSE 0 END AS tier FROM N) WHERE tier > 0 ORDER BY tier DESC, label, id LIMIT 3)"""


_STEMS = lambda c: f"list_transform({_SPLIT(c)}, lambda w: {_STEM_OF})"
_STEM_OF = f"CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN left(w, length(w) - 3) || 'y' ELSE CASE WHEN length({_FIRST}) > 4 AND ({_FIRST}) LIKE '%e' THEN left({_FIRST}, length({_FIRST}) - 1) ELSE {_FIRST} END END"
_STOPPED = ", ".join(f"'{w}'" for w in search.STOP)
_FIND = f"""WITH {market_sql()}, D AS (SELECT dst AS id, count(DISTINCT src || kind) AS degree FROM E WHERE kind IN ('call', 'import') GROUP BY dst),
W AS (SELECT N.*, coalesce(degree, 0) AS degree, {_STEMS("label")} AS l, {_STEMS("string_split(N.id, ':')[-1]")} AS o, {_STEMS("string_split(file, '/')[-1]")} AS f, {_STEMS("regexp_replace(file, '[^/]*$', '')")} AS p, {_STEMS("domain")} AS m FROM N LEFT JOIN D ON D.id = N.id),
Q AS (SELECT query, list_transform(list_filter({_SPLIT("t")}, lambda x: x NOT IN ({_STOPPED})), lambda w: {_STEM_OF}) AS u FROM (VALUES {", ".join(f"({i}, '{x}')" for i, x in enumerate(IDEAS))}) v(query, t)),
A AS (SELECT query, list_filter(u, lambda x, i: list_position(u, x) = i) AS u FROM Q), B AS (SELECT query, u, unnest(u) AS x FROM A),
H AS (SELECT query, u, W.id, CASE WHEN list_contains(l, x) THEN 3.0 WHEN length(x) >= 3 AND len(list_filter(l, lambda y: starts_with(y, x))) > 0 THEN 1.5 WHEN list_contains(CASE WHEN string_split(W.id, ':')[-1] = label THEN l ELSE o END, x) THEN 1.5
WHEN list_contains(f, x) THEN 2.0 WHEN list_contains(p, x) THEN 1.0 WHEN list_contains(m, x) THEN 0.75 ELSE 0.0 END AS hit FROM B, W),
S AS (SELECT query, id, any_value(u) AS u, CAST(sum(hit) AS DOUBLE) AS base, count(*) FILTER (WHERE hit > 0) AS k FROM H GROUP BY query, id HAVING sum(hit) > 0)
SELECT CAST(query AS INTEGER) AS query, S.id, round((base + CASE WHEN array_to_string(l, '') = array_to_string(u, '') THEN 4.0 ELSE 0.0 END) * k / len(u) * (CASE WHEN exports THEN 1.25 ELSE 1.0 END * 1.0 * (1 + least(degree, 20) / 40))
* CASE WHEN list_has_any(u, ['test', 'spec']) THEN 1.0 WHEN role = 'test' THEN 0.6 ELSE 1.2 END, 6) AS score FROM S JOIN W ON W.id = S.id"""

ORACLE_SQL = {
    "m13_find": _FIND,
    "p4_suggest": f"WITH {COMMERCE_SQL} " + " UNION ALL ".join(_suggest(w) for w in ("BUILDNG", "machine", "AMERIC")),
    "m1_tokens": f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_TOK} AS t FROM documents)",
    "m2_shingles": f"SELECT id AS doc_id, len(sh) AS n, md5(array_to_string(list_sort(sh), '|')) AS digest FROM {_sets('documents', 'doc_id')}",
    "m3_skeleton": f"SELECT page_id, len(t) AS n, md5(array_to_string(list_transform(t, lambda x: CASE WHEN x[1] IN ('`', '\"', '''') THEN 'STR' WHEN regexp_matches(x[1], '[0-9]') THEN 'NUM' WHEN regexp_matches(x[1], '[A-Za-z_$]') AND x NOT IN ({_KEEP}) THEN 'ID' ELSE x END), ' ')) AS digest FROM (SELECT page_id, regexp_extract_all({_BARE('html')}, '{_Q(text.SKELETON)}') AS t FROM pages)",
    "m4_similar_pairs": f"WITH S AS {_sets('documents', 'doc_id')}, {_ITEMS}, P AS (SELECT a.id AS a, b.id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM I a JOIN I b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2) SELECT a, b, round(c / (na + nb - c), 9) AS sim FROM P WHERE c / (na + nb - c) >= 0.6 - 1e-12",
    "m4_classes": f"SELECT id, len(sh) AS n, min(id) OVER (PARTITION BY list_sort(sh)) AS rep, count(*) OVER (PARTITION BY list_sort(sh)) AS size FROM {_sets('documents', 'doc_id')} WHERE len(sh) > 0",
    "m5_find_similar": f"WITH S AS {_sets('documents', 'doc_id')}, {_ITEMS}, Q AS (SELECT id AS query, len(sh) AS nq, unnest(sh) AS s FROM {_sets('benchmark', 'item_id')}), X AS (SELECT query, id, count(*) / (any_value(nq) + any_value(n) - count(*)) AS sim FROM Q JOIN I ON Q.s = I.s GROUP BY 1, 2), R AS (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS INTEGER) AS rank, id, round(sim, 9) AS sim, count(*) OVER (PARTITION BY query) AS true_count FROM X WHERE sim >= 0.01) SELECT * FROM R WHERE rank <= 3",
    "m6_group_bands": f"WITH S AS {_sets('documents', 'doc_id')}, G AS (SELECT source || '/' || lang AS grp, id, sh, row_number() OVER (PARTITION BY source, lang ORDER BY id) AS r FROM S JOIN documents ON doc_id = id), P AS (SELECT a.grp, CASE WHEN len(a.sh) = 0 OR len(b.sh) = 0 THEN 0.0 ELSE {_SIM} END AS sim FROM G a JOIN G b ON a.grp = b.grp AND a.id < b.id WHERE a.r <= 12 AND b.r <= 12) SELECT grp AS \"group\", round(avg(sim), 9) AS mean_sim, round(min(sim), 9) AS min_sim, CASE WHEN avg(sim) >= 0.6 THEN 'high' WHEN avg(sim) >= 0.35 THEN 'medium' WHEN avg(sim) >= 0.15 THEN 'low' ELSE 'refuted' END AS band FROM P GROUP BY grp",
    "m7_twins": f"WITH {COMMERCE_SQL}, C AS (SELECT DISTINCT src AS id, label AS s FROM E JOIN N ON N.id = dst WHERE E.kind = 'call'), Z AS (SELECT id, count(*) AS n FROM C GROUP BY id HAVING count(*) >= 4), P AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM C a JOIN C b ON a.s = b.s AND a.id < b.id SEMI JOIN Z x ON x.id = a.id SEMI JOIN Z y ON y.id = b.id GROUP BY 1, 2) SELECT a, b, round(c / (x.n + y.n - c), 9) AS sim FROM P JOIN Z x ON x.id = a JOIN Z y ON y.id = b JOIN N na ON na.id = a JOIN N nb ON nb.id = b WHERE c / (x.n + y.n - c) >= 0.7 - 1e-12 AND na.file <> nb.file",
    "m8_multiset": "WITH C AS (SELECT l_orderkey AS id, l_suppkey || '/' || l_returnflag AS item, count(*) AS c FROM lineitem GROUP BY 1, 2), T AS (SELECT id, sum(c) AS n FROM C GROUP BY id), P AS (SELECT a.id AS a, b.id AS b, sum(least(a.c, b.c)) AS s FROM C a JOIN C b ON a.item = b.item AND a.id < b.id GROUP BY 1, 2) SELECT a, b, round(s / (x.n + y.n - s), 9) AS sim FROM P JOIN T x ON x.id = a JOIN T y ON y.id = b WHERE s / (x.n + y.n - s) >= 0.7 - 1e-12",
    "m12_incremental": f"WITH S AS {_sets('documents', 'doc_id')}, {_ITEMS}, X AS (SELECT q.id AS query, i.id, count(*) / (any_value(q.n) + any_value(i.n) - count(*)) AS sim FROM I q JOIN I i ON q.s = i.s WHERE q.id % 50 = 0 GROUP BY 1, 2), R AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS r FROM X WHERE sim >= 0.6) SELECT query, first(id ORDER BY r) AS id, round(first(sim ORDER BY r), 6) AS sim FROM R WHERE r <= 2 AND id <> query GROUP BY query",
    "x5_complexity": f"SELECT page_id, CAST(1 + len(regexp_extract_all({_STRIP}, '\\b(?:if|for|while|case|catch)\\b|&&|\\|\\||\\?\\?')) + len(regexp_extract_all(regexp_replace({_STRIP}, '\\?\\?|\\?\\.', ' ', 'g'), '\\?')) AS INTEGER) AS complexity FROM pages",
    "x6_nesting": f"WITH B AS (SELECT page_id, regexp_extract_all({_STRIP}, '[{{}}]') AS l FROM pages), U AS (SELECT page_id, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM B), S AS (SELECT *, sum(CASE c WHEN '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY i) AS s FROM U), D AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY page_id ORDER BY i)) AS d FROM S) SELECT B.page_id, CAST(coalesce((SELECT max(d) FROM D WHERE D.page_id = B.page_id), 0) AS INTEGER) AS depth FROM B",
    "x7_roles": f"SELECT {paths.role_sql('p')} AS role, count(*) AS n FROM (SELECT regexp_extract(url, '^https?://([^?#]*)', 1) || CASE page_id % 3 WHEN 0 THEN '/tests/a.js' WHEN 1 THEN '/examples/b.min.js' ELSE '/c.py' END AS p FROM pages) GROUP BY 1",
    "x13_imports": "WITH K AS (SELECT DISTINCT regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages), H AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"#?]+)', 1)) AS href FROM pages) SELECT page_id, count(*) AS links, count(*) FILTER (WHERE href IN (SELECT path FROM K WHERE path <> '') OR href || '/' IN (SELECT path FROM K) OR href || '/index.html' IN (SELECT path FROM K)) AS resolved FROM H GROUP BY page_id",
    "f_split_stem": f"SELECT w, {_STEM} AS stem FROM (SELECT w, {_FIRST} AS f FROM (SELECT DISTINCT unnest({_SPLIT('p_name')}) AS w FROM part))",
}
