"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .bestfit import op13_best_fit_packing
from .html_text import op7_html_text
from .jaccard import op4_jaccard_join
from .language import op6_language_id
from .media import op5_media_columns
from .merkle import OP12_SQL, op12_merkle_manifest
from .negatives import OP11_SQL, op11_hard_negatives
from .packing import op10_packing
from .pii import OP8_SQL, op8_pii
from .quality import op1_quality_classifier
from .rules import op9_quality_rules
from .sentencepiece_codec import op3_sentencepiece
from .token_counts import op2_token_counts

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_token_counts, op3_sentencepiece, op4_jaccard_join, op5_media_columns, op6_language_id,
        op7_html_text, op8_pii, op9_quality_rules, op10_packing, op11_hard_negatives, op12_merkle_manifest, op13_best_fit_packing,
    )
}

#: Links by counting shared shingles, then the least reachable doc_id by recursion.
OP4_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM w),
c AS (SELECT sh, min(doc_id) AS rep, len(sh) AS n FROM (SELECT doc_id, list_sort(sh) AS sh FROM s WHERE len(sh) > 0) GROUP BY sh),
t AS MATERIALIZED (SELECT rep, n, unnest(sh) AS x FROM c),
p AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b FROM t a JOIN t b ON a.x = b.x AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT rep AS a, rep AS b FROM c UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
k AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN c ON list_sort(s.sh) = c.sh LEFT JOIN k ON k.a = c.rep"""

SQL = {"op4_jaccard_join": OP4_SQL, "op8_pii": OP8_SQL, "op11_hard_negatives": OP11_SQL, "op12_merkle_manifest": OP12_SQL}
