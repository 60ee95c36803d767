"""The queries of this package and what DuckDB can check of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parcelflow.llm.embeddings import op8_embedding_near_dedup
from parcelflow.llm.encode import op5_bpe_encode_decode
from parcelflow.llm.jaccard import op1_ngram_jaccard_join
from parcelflow.llm.negatives import op11_hard_negatives
from parcelflow.llm.packing import op6_best_fit_packing
from parcelflow.llm.passages import op13_passage_dedup
from parcelflow.llm.pii import op7_personal_data
from parcelflow.llm.quality import op10_quality_discriminant
from parcelflow.llm.rules import PHRASES, op9_quality_rules
from parcelflow.llm.secrets import op4_secret_scan
from parcelflow.llm.spelling import op12_spelling_variants
from parcelflow.llm.suffix import op3_suffix_dedup
from parcelflow.llm.toxicity import op2_toxicity_kernel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_toxicity_kernel,
        op3_suffix_dedup,
        op4_secret_scan,
        op5_bpe_encode_decode,
        op6_best_fit_packing,
        op7_personal_data,
        op8_embedding_near_dedup,
        op9_quality_rules,
        op10_quality_discriminant,
        op11_hard_negatives,
        op12_spelling_variants,
        op13_passage_dedup,
    )
}
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+3], ' ') g FROM w, unnest(generate_series(1, greatest(len(ws) - 3, 1))) u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
bth AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM bth JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a, min(b) m FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.m AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN m ON m.a = w.doc_id""",
    "op8_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) s FROM v),
l AS (SELECT a.vec_id a, b.vec_id b FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE list_inner_product(a.e, b.e) / (a.s * b.s) >= 0.9),
r(a, b) AS (SELECT vec_id, vec_id FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) m FROM r GROUP BY a)
SELECT n.vec_id, (SELECT count(*) FROM l WHERE l.a = n.vec_id) AS n_links, c.m AS component_id, c.m = n.vec_id AS kept FROM n JOIN c ON c.a = n.vec_id""",
    "op9_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls FROM d),
p AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') g FROM w, unnest(generate_series(1, greatest(len(ws) - 7, 0))) u(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) c FROM p) WHERE c > 1),
cover AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) nxt FROM twice) GROUP BY 1),
line AS (SELECT doc_id, x, length(x) c, length(x) - length(replace(x, ' ', '')) + 1 k FROM w, unnest(ls) u(x)),
judged AS (SELECT doc_id, c, (length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) > 0.34 * k OR length(regexp_replace(x, '[^|»›•]', '', 'g')) >= 3
  OR (NOT regexp_matches(x, '\p{Ll}') AND regexp_matches(x, '\p{Lu}.*\p{Lu}') AND k >= 3) OR (k <= 3 AND NOT contains('.!?:;,"'')]…”»', right(rtrim(x), 1)))
  OR (c <= 200 AND regexp_matches(lower(x), 'PHRASES'))) bad FROM line),
lost AS (SELECT doc_id, sum(CASE WHEN bad THEN c ELSE 0 END) / sum(c) f FROM judged GROUP BY 1),
o AS (SELECT w.doc_id, len(ws)::BIGINT n_words, length(array_to_string(ws, ''))::BIGINT word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT n_dup_lines, coalesce(cover.n, 0)::BIGINT n_repeat_words, coalesce(lost.f, 0) f FROM w LEFT JOIN cover USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND f <= 0.5 AS kept FROM o""".replace("PHRASES", "|".join(PHRASES)),
    "op11_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END l, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id a, a.l al, b.vec_id b, b.l bl, list_inner_product(a.q, b.q)::BIGINT s FROM v a JOIN v b ON a.vec_id % 50 = 0 AND (a.vec_id <> b.vec_id OR a.l <> b.l)),
p AS (SELECT a, b, s FROM s WHERE al = bl QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b))::INT AS rank, s.b AS negative_id, p.s AS positive_score, s.s AS negative_score
FROM p JOIN s ON s.a = p.a AND s.al <> s.bl AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) <= 3""",
    # crc32 by its table; near words by words with one letter left out, at one place for both or for the longer one only
    "op12_spelling_variants": r"""
WITH t AS (SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
r AS (SELECT doc_id, run, count(*) c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]{7,}')) run FROM documents) GROUP BY 1, 2),
b AS (SELECT run, c, hex(encode(doc_id || ':' || run)) x FROM r),
h AS (SELECT run, c, xor(list_reduce([4294967295] || list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT), lambda a, y: xor(a >> 8, tab[xor(a, y) % 256 + 1])), 4294967295) h FROM b, t),
w AS (SELECT word, sum(c)::BIGINT n FROM (SELECT c, CASE WHEN h % 31 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END word FROM h) WHERE length(word) >= 7 GROUP BY 1 HAVING sum(c) >= 2),
d AS (SELECT word, n, i, word[1 : i - 1] || word[i + 1 :] g FROM w, unnest(range(1, length(word) + 1)) u(i)),
e AS (SELECT a.word x, b.word y FROM d a JOIN d b ON a.g = b.g AND a.i = b.i AND a.word <> b.word UNION SELECT d.word, w.word FROM d JOIN w ON d.g = w.word UNION SELECT w.word, d.word FROM d JOIN w ON d.g = w.word),
f AS (SELECT x, count(*) n_near, first(y ORDER BY b.n DESC, y) y, max(b.n) m FROM e JOIN w b ON b.word = e.y GROUP BY 1),
s AS (SELECT word, n, coalesce(n_near, 0) n_near, CASE WHEN m >= 10 * n THEN y END form, CASE WHEN m >= 10 * n THEN m END form_n FROM w LEFT JOIN f ON f.x = w.word),
p(word, root) AS (SELECT word, word FROM s UNION ALL SELECT p.word, s.form FROM p JOIN s ON s.word = p.root WHERE s.form IS NOT NULL)
SELECT s.word, s.form, p.root, s.n, s.n_near, s.form_n FROM s JOIN p ON p.word = s.word JOIN s z ON z.word = p.root AND z.form IS NULL""".replace("WITH t AS", "WITH RECURSIVE t AS"),
    "op13_passage_dedup": r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) g FROM w, unnest(range(1, len(ws) - 48)) u(i)),
m AS (SELECT g, min(doc_id) d FROM p GROUP BY 1),
s AS (SELECT doc_id, list(i) starts FROM p JOIN m USING (g) WHERE d < doc_id GROUP BY 1),
k AS (SELECT doc_id, ws, list_filter(range(1, len(ws) + 1), lambda i: starts IS NULL OR NOT list_bool_or(list_transform(range(0, 50), lambda j: list_contains(starts, i - j)))) kept FROM w LEFT JOIN s USING (doc_id))
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - len(kept))::BIGINT AS n_removed, sha256(array_to_string(list_transform(kept, lambda i: ws[i]), ' ')) AS kept_sha256 FROM k""",
}
