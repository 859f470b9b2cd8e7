"""The registered queries of the corpus operators, over the tables of a data folder."""

from __future__ import annotations

from chronoloom.llm.audit import op13_audit
from chronoloom.llm.decontamination import op3_decontaminate
from chronoloom.llm.fingerprints import op10_fingerprint
from chronoloom.llm.jaccard_join import op11_jaccard
from chronoloom.llm.langid import op4_langid
from chronoloom.llm.mixing import op1_mix
from chronoloom.llm.neardup import op7_neardup
from chronoloom.llm.periods import op12_runs
from chronoloom.llm.pii import op2_pii
from chronoloom.llm.secrets import op8_secrets
from chronoloom.llm.substrings import op6_substrings
from chronoloom.llm.warc import op5_warc
from chronoloom.llm.webpages import op9_extract

QUERIES = {
    "op1_mix": op1_mix,
    "op2_pii": op2_pii,
    "op3_decontaminate": op3_decontaminate,
    "op4_langid": op4_langid,
    "op5_warc": op5_warc,
    "op6_substrings": op6_substrings,
    "op7_neardup": op7_neardup,
    "op8_secrets": op8_secrets,
    "op9_extract": op9_extract,
    "op10_fingerprint": op10_fingerprint,
    "op11_jaccard": op11_jaccard,
    "op12_runs": op12_runs,
    "op13_audit": op13_audit,
}

#: The others are beyond SQL (fitted models, hashed draws, automata, parsers) or too slow in it; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op5_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS n, sha256(h) AS s FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS first_id FROM d)
SELECT page_id, n AS payload_bytes, s AS payload_digest, CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM m""",
    "op7_neardup": """WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.y) AS component_id, d.doc_id = min(r.y) AS kept FROM documents d JOIN r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY 1""",
    "op11_jaccard": """WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.y) AS component_id FROM documents d JOIN r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY 1""",
    "op13_audit": """WITH w AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT doc_id, part, (len(w) < 100)::INT AS a, (100 * len(list_distinct(w)) < 80 * len(w))::INT AS b, (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT AS c, regexp_matches(t, '[#$%&*|]')::INT AS d,
coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS e FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, a + b + c + d + e AS k, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM f LEFT JOIN l USING (doc_id)),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
s AS (SELECT filter_order, i AS step, (2 ** (ascii(filter_order[i]) - 65))::INT AS bit, coalesce(list_sum(list_transform(range(1, i), lambda j: 2 ** (ascii(filter_order[j]) - 65))), 0)::INT AS pre FROM o, (SELECT unnest(range(1, 6)) AS i)),
c AS (SELECT part, mask, k, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2, 3)
SELECT part, filter_order, step::INT AS step, coalesce(sum(n) FILTER ((mask & (bit | pre)) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER ((mask & bit) <> 0 AND (mask & pre) = 0), 0)::BIGINT AS removed,
coalesce(sum(n) FILTER ((mask & bit) <> 0 AND (mask & pre) <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER ((mask & bit) <> 0 AND (mask & pre) = 0), 0)::BIGINT AS good_lost,
coalesce(sum(toxic) FILTER ((mask & bit) <> 0 AND (mask & pre) = 0), 0)::BIGINT AS toxic_lost, coalesce(sum(n * 120 // greatest(k, 1)) FILTER ((mask & bit) <> 0), 0)::BIGINT AS shapley
FROM c, s GROUP BY part, filter_order, step""",
}
