"""The numbered operators as queries over whole tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fairlead.llm import audit, chat, codes, decontaminate, html, jaccard, langid, lines, mixing, packing, quality, warc
from fairlead.llm.common import table
from fairlead.operators.shared import released


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op3_packed_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_best_fit(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents"), text=False)


def op6_min_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_min_slack(table(spark, sf_dir, "documents"))


def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, made of control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], turns.schema)
    return chat.read_back(chat.format_windows(turns.unionByName(more)), in_order=True)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_pages(spark, warc.write_pages(table(spark, sf_dir, "pages")))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), words=4, pct=85)


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interaction_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_main_text, op2_quality_rules, op3_packed_matrix, op4_language, op5_line_dedup, op6_min_slack, op7_chat_windows, op8_decontaminate, op9_warc, op10_near_duplicates, op11_source_mix, op12_vector_codes, op13_filter_audit, pipeline)
    # a data source of its own reads op9's archives, so they stay; the pipeline releases by stage
    return {f.__name__: f if f in (op9_warc, pipeline) else released(f) for f in found}


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
h AS (SELECT r, i, w[i:i+4] AS five FROM g),
t AS (SELECT r, five FROM h GROUP BY r, five HAVING count(*) > 1),
p AS (SELECT DISTINCT h.r, unnest(range(h.i, h.i + 5)) AS at FROM h JOIN t ON h.r = t.r AND h.five = t.five),
n AS (SELECT r, count(*) AS n FROM p GROUP BY r),
m AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN n ON w.r = n.r),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base, 100 * n_symbols > 10 * n_words AS symbols, 100 * n_dup_lines > 30 * n_lines AS dup,
             100 * n_symbols > 100 * n_words OR 100 * n_dup_lines > 50 * n_lines AS lenient FROM m),
hosts AS (SELECT source, count(*) AS n, unnest([sum(base::INT), sum(symbols::INT), sum(dup::INT)]) AS k, unnest(['base', 'symbols', 'dup']) AS rule FROM f GROUP BY source),
mean AS (SELECT rule, sum(k) / sum(n) AS m FROM hosts GROUP BY rule),
prior AS (SELECT h.rule, any_value(m) AS m, avg((k / n - m) ** 2) AS v FROM hosts h JOIN mean USING (rule) GROUP BY h.rule),
strength AS (SELECT rule, m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 10.0), 1000.0) ELSE 1000.0 END AS s FROM prior),
verdict AS (SELECT source, max((k + m * s) / (n + s)) > 0.5 AS condemned FROM hosts JOIN strength USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base AS base_failed,
       NOT base AND NOT lenient AND NOT (condemned AND (symbols OR dup)) AS kept, condemned AS host_condemned
FROM f JOIN verdict ON f.source IS NOT DISTINCT FROM verdict.source
"""

OP5_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
s AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM s),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, i, line, keeper IS NOT NULL AND keeper <> k.doc_id AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
z AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
items AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS win FROM z),
sizes AS (SELECT DISTINCT n FROM items),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
o AS (SELECT doc_id, i, n, array_to_string(w[i:i+n-1], ' ') AS win FROM p),
hit AS (SELECT doc_id, item_id, i, n FROM o JOIN items USING (n, win)),
words AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM hit),
n_hit AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit.n, 0) AS n_hit, coalesce(names.n, 0) AS n_items, sha256(coalesce(names.l, '')) AS items_sha256, n_hit.n IS NOT NULL AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN names USING (doc_id)
"""

OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to FROM s
"""

OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
z AS (SELECT doc_id, w, least(len(w), 4) AS n, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+n-1], ' ') AS g FROM z),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT pair.a, pair.b FROM pair JOIN size x ON x.doc_id = pair.a JOIN size y ON y.doc_id = pair.b WHERE 100 * pair.n >= 85 * (x.n + y.n - pair.n)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) AS component_id FROM d LEFT JOIN size ON size.doc_id = d.doc_id
"""


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
                  md5(concat_ws('|', '11', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))) AS hash FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS lim FROM s),
t AS (SELECT sum(weight) AS w, CAST(sum(source_size) AS DOUBLE) AS size FROM w),
k AS (SELECT w.*, coalesce(sum(weight) OVER o, 0) AS w_before, coalesce(sum(lim) OVER o, 0) AS lim_before FROM w WINDOW o AS (ORDER BY lim / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT k.*, lim * (t.w - w_before) <= (t.size - lim_before) * weight AS held FROM k, t),
rest AS (SELECT coalesce(sum(weight) FILTER (held), 0.0) AS w, coalesce(sum(lim) FILTER (held), 0.0) AS size FROM h),
target AS (SELECT source, source_size, CASE WHEN held THEN lim ELSE (t.size - rest.size) / (t.w - rest.w) * weight END AS target FROM h, t, rest),
e AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0.0 END AS e, (CAST('0x' || substring(hash, 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN target g ON d.source IS NOT DISTINCT FROM g.source),
q AS (SELECT *, CAST(floor(e) AS BIGINT) AS certain, CASE WHEN e > floor(e) THEN (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) END AS q FROM e),
b AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) - sum(certain * size) OVER (PARTITION BY source) AS budget,
             sum(size) OVER (PARTITION BY source ORDER BY q, hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(size) OVER (PARTITION BY source, q, hash) AS alike, count(*) OVER (PARTITION BY source, q, hash) AS n FROM q)
SELECT doc_id, size, source_size, target, CAST(certain * size + CASE WHEN q IS NULL THEN 0 WHEN upto <= budget THEN size WHEN upto - alike > budget THEN 0
         WHEN upto - budget <= 0.005::DOUBLE * target THEN size WHEN budget - upto + alike <= 0.005::DOUBLE * target THEN 0 ELSE (budget - upto + alike) // n END AS BIGINT) AS taken FROM b
"""


def _op12_sql() -> str:
    """Four rounds of assigning and averaging, spelled out; every table once."""
    sql = """WITH v AS MATERIALIZED (SELECT vec_id, label, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, x[part * (len(x) // 4) + 1 : (part + 1) * (len(x) // 4)] AS y FROM v, range(4) t(part)),
c0 AS MATERIALIZED (SELECT part, entry, y FROM p JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < 256) USING (r)),
"""
    for i in range(5):
        sql += f"""a{i} AS MATERIALIZED (SELECT r, part, min(struct_pack(d := d, e := entry)) AS best FROM (SELECT r, p.part, entry, list_sum(list_transform(list_zip(p.y, c.y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN c{i} c ON p.part = c.part) GROUP BY r, part),
"""
        if i < 4:
            sql += f"""m{i} AS (SELECT part, best.e AS entry, pos, CAST(floor(sum(z) / count(*)) AS BIGINT) AS z FROM (SELECT a.part, best, unnest(y) AS z, unnest(range(len(y))) AS pos FROM a{i} a JOIN p USING (r, part)) GROUP BY ALL),
n{i} AS (SELECT part, entry, list(z ORDER BY pos) AS y FROM m{i} GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(n.y, c.y) AS y FROM c{i} c LEFT JOIN n{i} n ON c.part = n.part AND c.entry = n.entry),
"""
    return sql + """f AS (SELECT r, string_agg(printf('%02x', CAST(best.e AS INT)), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a4 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) FROM c4) AS codebooks_sha256 FROM f JOIN v USING (r)
"""


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
e AS (SELECT *, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS late FROM d),
f AS (SELECT doc_id, part, {'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w), 'C': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text), 'D': regexp_matches(text, '[#$%&*|]'), 'E': late} AS f FROM e),
l AS (SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, f, list_filter([CASE WHEN f.A THEN 'A' END, CASE WHEN f.B THEN 'B' END, CASE WHEN f.C THEN 'C' END, CASE WHEN f.D THEN 'D' END, CASE WHEN f.E THEN 'E' END], lambda x: x IS NOT NULL) AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)),
n AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM g GROUP BY ALL),
x(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, CAST(step AS INT) AS step, filter_order[step] AS f, string_split(filter_order[1:step - 1], '') AS prior FROM o, range(1, 6) t(step)),
r AS (SELECT part, filter_order, step, f, CAST(coalesce(sum(n) FILTER (NOT list_contains(fails, f) AND NOT list_has_any(fails, prior)), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (list_contains(fails, f) AND NOT list_has_any(fails, prior)), 0) AS BIGINT) AS removed,
             CAST(coalesce(sum(n) FILTER (list_contains(fails, f) AND list_has_any(fails, prior)), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails = [f]), 0) AS BIGINT) AS unique_fails,
             CAST(coalesce(sum(good) FILTER (list_contains(fails, f) AND NOT list_has_any(fails, prior)), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (list_contains(fails, f) AND NOT list_has_any(fails, prior)), 0) AS BIGINT) AS toxic_lost
      FROM n, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_source_mix": OP11_SQL, "op12_vector_codes": _op12_sql(), "op13_filter_audit": OP13_SQL, "op2_quality_rules": OP2_SQL, "op5_line_dedup": OP5_SQL, "op8_decontaminate": OP8_SQL, "op9_warc": OP9_SQL, "op10_near_duplicates": OP10_SQL}


