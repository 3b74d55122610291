"""The queries of this subpackage: thin wrappers that apply an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversationtrie, decontamination, divergence, fingerprints, htmltext, langid, neardup, packing, quality, sharding, tokencount, toxicity, urlfilter
from .common import table


def op4_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op5_transducer_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


def op6_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_language(table(spark, sf_dir, "documents"))


def op8_grammar_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.duplicate_classes(table(spark, sf_dir, "documents"))


def op2_mincut_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(table(spark, sf_dir, "pages"))


def op3_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op9_boosted_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


def op10_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_systolic_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_prefix_doubling_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversationtrie.trie(table(spark, sf_dir, "conversations"))


def op13_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def proximity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.proximity_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_order_minhash": op1_order_minhash,
    "op2_mincut_html": op2_mincut_html,
    "op3_imatch_fingerprints": op3_imatch_fingerprints,
    "op4_lpt_shards": op4_lpt_shards,
    "op5_transducer_token_counts": op5_transducer_token_counts,
    "op6_bounded_packing": op6_bounded_packing,
    "op7_hyperdimensional_language": op7_hyperdimensional_language,
    "op8_grammar_toxicity": op8_grammar_toxicity,
    "op9_boosted_url_filter": op9_boosted_url_filter,
    "op10_positional_decontamination": op10_positional_decontamination,
    "op11_systolic_divergence": op11_systolic_divergence,
    "op12_prefix_doubling_trie": op12_prefix_doubling_trie,
    "op13_rule_quality": op13_rule_quality,
    "proximity_matches": proximity_matches,
}

#: What DuckDB can say, by plain joins of windows, terms and prefixes.
ORACLE_SQL: dict[str, str] = {
    "op10_positional_decontamination": r"""
        WITH d AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
        ), b AS (
          SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
        ), bw AS (
          SELECT item_id, ws, least(len(ws), 10) AS k, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS p FROM b WHERE len(ws) > 0
        ), win AS (
          SELECT DISTINCT item_id, k, array_to_string(ws[p:p + k - 1], ' ') AS w FROM bw
        ), ks AS (SELECT DISTINCT k FROM win),
        dw AS (
          SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, ks WHERE len(ws) >= k
        ), hits AS (
          SELECT dw.doc_id, dw.p, dw.k, win.item_id FROM dw JOIN win ON win.k = dw.k AND win.w = array_to_string(dw.ws[dw.p:dw.p + dw.k - 1], ' ')
        ), words AS (
          SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY doc_id
        ), items AS (
          SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS item_id FROM hits) GROUP BY doc_id
        )
        SELECT d.doc_id, cast(len(d.ws) AS bigint) AS n_words, coalesce(words.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items,
               sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "proximity_matches": r"""
        WITH d AS (
          SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
        ), b AS (
          SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
        ), postings AS (
          SELECT r, doc_id, unnest(range(0, len(ws))) AS pos, unnest(ws) AS term FROM d
        ), terms AS (SELECT item_id, ws, unnest(list_distinct(ws)) AS term FROM b),
        counts AS (SELECT t.term, count(p.pos) AS n FROM (SELECT DISTINCT term FROM terms) t LEFT JOIN postings p ON p.term = t.term GROUP BY t.term),
        rare AS (
          SELECT item_id, ws, term FROM terms JOIN counts USING (term) QUALIFY row_number() OVER (PARTITION BY item_id, ws ORDER BY n, term) <= 4
        ), need AS (SELECT item_id, ws, count(*) AS needed FROM rare GROUP BY item_id, ws),
        near AS (
          SELECT doc_id, item_id, ws, pos,
                 len(list_distinct(list(term) OVER (PARTITION BY r, item_id, ws ORDER BY pos RANGE BETWEEN 19 PRECEDING AND CURRENT ROW))) AS seen
          FROM postings JOIN rare USING (term)
        )
        SELECT doc_id, item_id, cast(pos AS integer) AS "at" FROM near JOIN need USING (item_id, ws) WHERE seen = needed
    """,
    "op11_systolic_divergence": r"""
        WITH d AS (SELECT coalesce(lang,'') lang, coalesce(source,'') source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws, row_number() OVER () AS r FROM documents),
        w AS (SELECT lang, source, r, unnest(ws) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
        langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
        groups AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        sums AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
        p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (coalesce(s.n, 0) + 5 * l.v) AS p,
                1 + (1000000000::hugeint * (k.n + 5)) // (l.n + 5 * l.v) AS q
              FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN sums s USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        rows AS (
          SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v.value, 0) AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
          UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, cast(value AS bigint) AS value, cast(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS integer) AS rank
        FROM rows QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 50
    """,
    "op12_prefix_doubling_trie": r"""
        WITH t AS (
          SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS said,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
          FROM conversations WHERE conv_id IS NOT NULL),
        crc(n, x) AS (SELECT n, x FROM (SELECT n, n AS x0 FROM range(256) r(n)), LATERAL (SELECT list_reduce(list_prepend(x0, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS x)),
        tab AS (SELECT list(x ORDER BY n) AS xs FROM crc),
        ids AS (SELECT DISTINCT c FROM t),
        hs AS (SELECT c, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda s: ascii(s)::bigint)),
                      lambda a, b: xor(a >> 8, xs[1 + (xor(a, b) & 255)])), 4294967295) % 9 AS h FROM ids, tab),
        seqs AS (SELECT c, list({r: role, s: said} ORDER BY i) AS ts FROM t GROUP BY c),
        built AS (SELECT hs.c, list_concat(coalesce(b.ts[1:h], []), o.ts[h + 1:]) AS ts
          FROM hs JOIN seqs o ON o.c = hs.c LEFT JOIN seqs b ON b.c = hs.c - hs.c % 5),
        pre AS (SELECT c, len(ts) AS length, d, ts[1:d] AS p FROM built, LATERAL (SELECT unnest(range(0, len(ts) + 1)) AS d)),
        nodes AS (SELECT d, p, min(c) AS c, count(*) AS n, coalesce(sha256(string_agg(CASE WHEN length = d THEN c::varchar END, ',' ORDER BY c)), sha256('')) AS ends FROM pre GROUP BY d, p),
        kids AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
        vals AS (SELECT n.d, n.p, n.c, n.n, n.ends, coalesce(k.k, 0) AS k, CASE WHEN n.d = 0 THEN 0 ELSE (n.n - 1) * strlen(n.p[n.d].s) END AS saved
          FROM nodes n LEFT JOIN kids k ON k.d = n.d AND k.p = n.p),
        up AS (SELECT a, p[1:a] AS p, sum(saved) AS saved, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS leaves FROM vals, LATERAL (SELECT unnest(range(0, d + 1)) AS a) GROUP BY ALL)
        SELECT v.c AS conv_id, v.d AS depth, q.c AS parent_conv_id, v.n AS n_convs, v.k AS n_children, cast(up.leaves AS bigint) AS n_leaves, cast(up.saved AS bigint) AS saved_tokens, v.ends AS ends_sha256
        FROM vals v JOIN up ON up.a = v.d AND up.p = v.p LEFT JOIN nodes q ON q.d = v.d - 1 AND q.p = v.p[1:v.d - 1]
    """,
}
