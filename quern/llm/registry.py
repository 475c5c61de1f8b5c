"""The queries of this subpackage and, where SQL can say the same over whole tables, their SQL."""

from __future__ import annotations

from quern.llm import defects, encode, leaks, near_dup, shared_spans, split_overlap, split_oversized, vectors

QUERIES = {
    "p1_found": near_dup.p1_found,
    "p1_links": near_dup.p1_links,
    "p2_found": split_overlap.p2_found,
    "p2_report": split_overlap.p2_report,
    "p3_found": defects.p3_found,
    "p6_found": split_oversized.p6_found,
    "p6_pieces": split_oversized.p6_pieces,
    "p7_found": vectors.p7_found,
    "p7_neighbours": vectors.p7_neighbours,
    "p8_ids": encode.p8_ids,
    "p9_found": leaks.p9_found,
    "p9_leaks": leaks.p9_leaks,
    "p10_found": shared_spans.p10_found,
    "p10_shared": shared_spans.p10_shared,
}

_SET = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+'))"

_ALIKE = r"""
, t AS (SELECT space, id, unnest(words) AS word, len(words) AS n FROM s WHERE len(words) > 0),
o AS (SELECT a.space, a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS common FROM t a JOIN t b ON a.space = b.space AND a.word = b.word AND a.id < b.id GROUP BY ALL),
alike AS (SELECT space, a, b FROM o WHERE common * 10 >= (na + nb - common) * 7)
"""

SQL = {
    "p1_found": f"""WITH s AS (SELECT 'training_samples' AS space, row_id AS id, {_SET.format("prompt")} AS words FROM training_samples
        UNION ALL SELECT 'text_task_templates', row_id, {_SET.format("prompt_template")} FROM text_task_templates) {_ALIKE}
        SELECT space AS table_name, a AS row_a, b AS row_b FROM alike""",
    "p2_found": f"""WITH r AS (SELECT row_id, prompt, context, regexp_replace(sample_id, '_(para|emph|reorder)$', '') AS base,
            CASE lower(trim(split)) WHEN 'train' THEN 1 WHEN 'val' THEN 2 WHEN 'validation' THEN 2 WHEN 'test' THEN 2 END AS side FROM training_samples),
        s AS (SELECT 'prompt' AS space, row_id AS id, {_SET.format("prompt")} AS words FROM r UNION ALL SELECT 'context', row_id, {_SET.format("context")} FROM r WHERE context IS NOT NULL) {_ALIKE},
        p AS (SELECT a, b FROM alike UNION SELECT x.row_id, y.row_id FROM r x JOIN r y ON x.base = y.base AND x.row_id < y.row_id)
        SELECT a AS row_a, b AS row_b FROM p JOIN r x ON x.row_id = a JOIN r y ON y.row_id = b WHERE x.side <> y.side""",
    "p1_links": f"""WITH s AS (SELECT 'training_samples' AS space, row_id AS id, {_SET.format("prompt")} AS words FROM training_samples
        UNION ALL SELECT 'text_task_templates', row_id, {_SET.format("prompt_template")} FROM text_task_templates) {_ALIKE},
        c AS (SELECT space, id, min(id) OVER (PARTITION BY space, list_sort(words)) AS class, count(*) OVER (PARTITION BY space, list_sort(words)) AS size FROM s WHERE len(words) > 0),
        lk AS (SELECT DISTINCT x.space, x.class AS ca, y.class AS cb FROM alike JOIN c x ON x.space = alike.space AND x.id = a JOIN c y ON y.space = alike.space AND y.id = b WHERE x.class <> y.class),
        en AS (SELECT space, class, count(*) AS links FROM (SELECT space, ca AS class, cb AS other FROM lk UNION SELECT space, cb, ca FROM lk) GROUP BY ALL)
        SELECT c.space AS table_name, id AS row_id, c.class AS class_id, coalesce(links, 0) AS links FROM c LEFT JOIN en ON en.space = c.space AND en.class = c.class WHERE size > 1 OR links IS NOT NULL""",
    "p2_report": f"""WITH r AS (SELECT row_id, source, prompt, context, regexp_replace(sample_id, '_(para|emph|reorder)$', '') AS base,
            CASE lower(trim(split)) WHEN 'train' THEN 'train' WHEN 'val' THEN 'validation' WHEN 'validation' THEN 'validation' WHEN 'test' THEN 'test' END AS split FROM training_samples),
        s AS (SELECT 'prompt' AS space, row_id AS id, {_SET.format("prompt")} AS words FROM r UNION ALL SELECT 'context', row_id, {_SET.format("context")} FROM r WHERE context IS NOT NULL) {_ALIKE},
        p AS (SELECT space AS how, a, b FROM alike UNION ALL SELECT space, b, a FROM alike UNION ALL SELECT 'sample_id', x.row_id, y.row_id FROM r x JOIN r y ON x.base = y.base AND x.row_id <> y.row_id)
        SELECT y.split, y.source, how, count(DISTINCT b) AS eval_rows, count(*) AS pairs FROM p JOIN r x ON x.row_id = a JOIN r y ON y.row_id = b WHERE x.split = 'train' AND y.split IN ('validation', 'test') GROUP BY ALL""",
    "p10_shared": """WITH d AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS class, count(*) OVER (PARTITION BY text) AS size FROM documents WHERE length(text) >= 300),
        w AS (SELECT doc_id, i, hash(substring(text, i::INT, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM d WHERE doc_id = class)),
        s AS (SELECT doc_id, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1)),
        k AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM (SELECT doc_id, i, (coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 301) > 300)::INT AS fresh FROM s)),
        p AS (SELECT doc_id, sum(n) AS part, count(*) AS spans FROM (SELECT doc_id, max(i) - min(i) + 300 AS n FROM k GROUP BY doc_id, island) GROUP BY doc_id)
        SELECT d.doc_id, CASE WHEN size > 1 THEN length(text) ELSE part END::BIGINT AS shared_chars, CASE WHEN size > 1 THEN 1 ELSE spans END::BIGINT AS spans, length(text)::BIGINT AS chars FROM d LEFT JOIN p ON p.doc_id = d.class WHERE size > 1 OR part IS NOT NULL""",
    "p7_found": """WITH n AS (SELECT node_id, embedding::DOUBLE[] AS v FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ingested_at DESC) AS rn FROM nodes) WHERE rn = 1),
        u AS (SELECT node_id, v FROM n WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0)
        SELECT a.node_id AS node_a, b.node_id AS node_b FROM u a JOIN u b ON a.node_id < b.node_id WHERE list_cosine_similarity(a.v, b.v) >= 0.9""",
    "p9_found": r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS w FROM heldout_items),
        g AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
        h AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i))
        SELECT DISTINCT doc_id, item_id FROM g JOIN h USING (g)""",
    "p10_found": """WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 300),
        w AS (SELECT DISTINCT doc_id, hash(substring(text, i::INT, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM d))
        SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM w a JOIN w b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p6_found": "SELECT node_id FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ingested_at DESC) AS rn FROM chunk_nodes) WHERE rn = 1 AND length(content) > 2000",
}
