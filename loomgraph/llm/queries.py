"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from loomgraph.llm import op03_quality_rules as rules
from loomgraph.llm.op01_warc import op1_warc
from loomgraph.llm.op02_ann import op2_ann
from loomgraph.llm.op04_sharding import op4_sharding
from loomgraph.llm.op05_token_file import op5_token_file
from loomgraph.llm.op06_packing import op6_packing
from loomgraph.llm.op07_sampled_pieces import op7_sampled_pieces
from loomgraph.llm.op08_gam_classifier import op8_gam_classifier
from loomgraph.llm.op09_language_id import op9_language_id
from loomgraph.llm.op10_simhash import op10_simhash


def queries() -> dict:
    import corpus_pipeline

    found = [op1_warc, op2_ann, rules.op3_quality_rules, op4_sharding, op5_token_file, op6_packing, op7_sampled_pieces, op8_gam_classifier, op9_language_id, op10_simhash]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


WARC_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS m FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(s, 1 + 10 * (i // 8), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id < m THEN m END AS refers_to, true AS ok
FROM d
"""


def rules_sql() -> str:
    cells = ", ".join(f"('{name}', {c})" for name, (_, _, grid) in rules.SIGNALS.items() for c in grid)
    ratios = ", ".join(f"CASE WHEN {b} > 0 THEN {t}::DOUBLE / {b} ELSE 0 END AS s_{name}" for name, (t, b, _) in rules.SIGNALS.items())
    value = "CASE signal " + " ".join(f"WHEN '{x}' THEN s_{x}" for x in rules.SIGNALS) + " END"
    risk, level = rules.RISK / len(rules.SIGNALS), rules.DELTA / (len(rules.SIGNALS) * len(rules.BANDS))
    bands = " + ".join(f"(n_words >= {b})::INT" for b in rules.BANDS[1:])
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[ \x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')) AS l FROM t),
v AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM
  (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w))),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS p FROM v WHERE c > 1) GROUP BY doc_id),
s AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t, '\P{{Lu}}+', '', 'g'))::BIGINT AS n_upper,
  len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
f AS (SELECT *, {bands} AS stratum, {ratios}, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s),
g AS (SELECT f.* FROM f JOIN (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) y ON f.doc_id = y.doc_id AND y.q = 1),
k AS (SELECT stratum, signal, cutoff, count(*) AS n, count(*) FILTER (WHERE {value} > cutoff) AS k
  FROM g, (VALUES {cells}) c(signal, cutoff) GROUP BY stratum, signal, cutoff),
p AS (SELECT *, CASE WHEN k >= n * {risk} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1),
  lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk})))) END <= {level} AS passed FROM k),
c AS (SELECT stratum, signal, min(cutoff) AS cutoff FROM (SELECT *, bool_and(passed) OVER (PARTITION BY stratum, signal ORDER BY cutoff DESC) AS so_far FROM p) WHERE so_far GROUP BY stratum, signal)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM c WHERE c.stratum = f.stratum AND {value} > c.cutoff) AS kept FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": WARC_SQL, "op3_quality_rules": rules_sql()}
