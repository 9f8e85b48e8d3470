"""Queries of this subpackage for __spark_entry__, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fill_in_middle, hard_negatives, license_scan, line_dedup, near_dup, packing, permutation_index, pii, quality_classifier, quality_rules, url_filter, warc
from .common import table


def public_key(spark: SparkSession) -> bytes | None:
    """For the synthetic tables only, where the session names no secret key: surrogates of a known key can be undone."""
    return None if spark.conf.get(pii.KEY_SETTING, None) else b"synthetic tables"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(spark, table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *names)


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_table(spark, docs, public_key(spark), "n_entities").select("doc_id", "n_entities", "text")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_table(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_runs(spark, docs, "removed_units").select("doc_id", "removed_units", "text")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op7_min_max_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.label(spark, table(spark, sf_dir, "documents"), 3, 85, 100)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.concat_ws(",", "sentence_ids").alias("sentence_ids"), F.concat_ws(",", "licenses").alias("licenses"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights, bias = quality_classifier.fit(spark, docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(spark, docs, weights, bias)


def op10_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(spark, table(spark, sf_dir, "embeddings"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.transform(spark, table(spark, sf_dir, "documents"), digests=True)


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = url_filter.mine(spark, url_filter.labelled(pages, table(spark, sf_dir, "labels")))
    return url_filter.judge(spark, pages.select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict", "mined")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(spark, table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_quality_rules,
        op3_surrogates,
        op4_bpe,
        op5_line_dedup,
        op6_warc,
        op7_min_max_hashing,
        op8_license_scan,
        op9_quality_classifier,
        op10_permutation_index,
        op11_fill_in_middle,
        op12_url_filter,
        op13_hard_negatives,
    )
}

_AROUND = quality_rules.AROUND.replace("'", "''")
_STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted({w for ws in quality_rules.STOP_WORDS.values() for w in ws}))



def _replaced(column: str) -> str:
    for sentence, name in license_scan.long_sentences():
        column = f"replace({column}, '{sentence}', '{name}')"
    return column


_names = "MAP {" + ", ".join(f"'{n}': '{x}'" for n, x in license_scan.NOTICES.items()) + "}"
_held = lambda rule: f"line LIKE '%,{',%,'.join(rule)},%'"
_rules = ", ".join(f"CASE WHEN {' AND NOT '.join(map(_held, [rule, *longer]))} THEN '{name}' END" for (name, rule), longer in zip(license_scan.RULES, license_scan.LONGER, strict=True))
_spdx = "MAP {" + ", ".join(f"'{n}': '{x}'" for n, x in license_scan.SPDX_NAMES.items()) + "}"
_named = " || ".join(f"regexp_extract(n, '{license_scan.NOTICE}', {g})" for g in license_scan.GROUPS)

ORACLE_SQL = {
    "op2_quality_rules": rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT rid, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM docs),
grams AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM parts)),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE n > 1) GROUP BY rid),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         (len(list_filter(w, lambda x: trim(lower(x), '{_AROUND}') IN ({_STOPS}))) + len(regexp_extract_all(t, '{quality_rules.OTHER_LETTERS.replace("Is", "")}')))::BIGINT AS stops,
         len(regexp_extract_all(t, '\p{{L}}'))::BIGINT AS letters,
         len(list_filter(lines, lambda x: regexp_matches(x, '{quality_rules.BULLET}')))::BIGINT AS bullets, len(list_filter(lines, lambda x: regexp_matches(x, '{quality_rules.ELLIPSIS}')))::BIGINT AS cut,
         len(list_filter(w, lambda x: x = upper(x) AND x <> lower(x) AND length(x) > 3))::BIGINT AS shouted, len(lines)::BIGINT AS n_lines
  FROM parts LEFT JOIN covered USING (rid)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words > 0 AND n_lines > 0
       AND word_chars >= 2.0::DOUBLE * n_words AND word_chars <= 12.0::DOUBLE * n_words AND n_symbols <= 0.1::DOUBLE * n_words
       AND shouted <= 0.3::DOUBLE * n_words AND stops >= 0.02::DOUBLE * n_words AND n_dup_lines <= 0.5::DOUBLE * n_lines
       AND word_chars > 0 AND letters >= 0.5::DOUBLE * word_chars AND n_words >= 2.0::DOUBLE * n_lines AND bullets <= 0.9::DOUBLE * n_lines AND cut <= 0.3::DOUBLE * n_lines AS kept
FROM failed
""",
    "op6_warc": """
WITH p AS (SELECT row_number() OVER () AS rid, page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT rid, page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS payload_digest, sha256(h) AS same FROM p),
r AS (SELECT *, count(*) OVER w AS n, first_value(rid) OVER w AS head, first_value(page_id) OVER w AS head_page
      FROM d WINDOW w AS (PARTITION BY same ORDER BY page_id DESC NULLS LAST, rid DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND rid <> head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND rid <> head THEN head_page END AS refers_to
FROM r
""",
    "op8_license_scan": rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, lower(coalesce(text, '')) AS t FROM documents),
marked AS (SELECT rid, doc_id, regexp_replace(' | | ' || replace(regexp_replace(t, '{license_scan.SENTENCE_END}', ' | | ', 'g'), ',', ' ~ ') || ' | | ', '{license_scan.NEITHER}', ' ', 'g') AS m FROM docs),
whole AS (SELECT rid, doc_id, m, regexp_replace(regexp_replace(m, '[|~]', ' ', 'g'), ' +', '  ', 'g') AS w FROM marked),
ids AS (
  SELECT rid, doc_id, regexp_extract_all({_replaced("w")}, '{license_scan.IDENTIFIER}', 1) AS s,
         list_transform(regexp_extract_all(m, '{license_scan.NOTICE}', 0), lambda n: {_names}[regexp_replace({_named}, '[|~ ]+', ' ', 'g')]) ||
         list_filter(list_transform(flatten(list_transform(regexp_extract_all(m, '{license_scan.SPDX}', 1), lambda e: string_split(regexp_replace(replace(' ' || e || ' ', ' ', '  '), '{license_scan.JOINS}', '|', 'g'), '|'))),
                                    lambda n: {_spdx}[trim(replace(n, '  ', ' '))]), lambda n: n IS NOT NULL) AS n
  FROM whole),
lines AS (SELECT *, ',' || array_to_string(s, ',') || ',' AS line FROM ids),
ruled AS (SELECT doc_id, s, n, list_filter([{_rules}], lambda x: x IS NOT NULL) || list_filter(n, lambda x: x <> 'reserved') AS g FROM lines)
SELECT doc_id, array_to_string(s || n, ',') AS sentence_ids,
       CASE WHEN len(g) > 0 THEN array_to_string(list_filter(g, lambda x, i: list_position(g, x) = i), ',') WHEN list_contains(n, 'reserved') THEN 'proprietary' ELSE '' END AS licenses
FROM ruled
""",
    "op11_fill_in_middle": r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
units AS (
  SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM docs),
cuts AS (
  SELECT doc_id, t, u, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM units),
made AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM cuts)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM made
""",
    "op12_url_filter": rf"""
WITH rest AS (
  SELECT row_number() OVER () AS rid, page_id, url, coalesce(url, '') AS t, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS r FROM pages),
split AS (
  SELECT rid, page_id, url, t, translate(regexp_extract(r, '^([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
slots AS (
  SELECT *, list_reverse(string_split(host, '.')) AS h, list_filter(string_split(path, '/'), lambda x: x <> '') AS f, regexp_extract(path, '\.([A-Za-z0-9]+)$', 1) AS e,
         list_sort(list_distinct(list_filter(list_transform(string_split(regexp_extract(t, '(?s)^[^?#]*\?([^#]*)', 1), '&'), lambda x: regexp_extract(x, '(?s)^([^=]*)', 1)), lambda x: x <> ''))) AS q,
         regexp_replace(regexp_extract(t, '(?s)#(.*)$', 1), '[0-9]+', '0', 'g') AS g
  FROM split),
urls AS (
  SELECT rid, page_id, url, host, path, CASE WHEN host = '' THEN [] ELSE list_sort(list_filter([
           'scheme ' || translate(regexp_extract(t, '(?s)^(.*?)://', 1), '{url_filter.UPPER}', '{url_filter.LOWER}'), {", ".join(f"'host{k} ' || h[{k + 1}]" for k in range(url_filter.HOST_SLOTS))},
           {", ".join(f"'path{k} ' || regexp_replace(f[{k + 1}], '[0-9]+', '0', 'g')" for k in range(url_filter.PATH_SLOTS))},
           'ending ' || nullif(e, ''), CASE WHEN len(q) > 0 THEN 'query ' || array_to_string(q, ' ') END, 'fragment ' || nullif(g, '')], lambda x: x IS NOT NULL)) END AS k
  FROM slots),
judged AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS blocked FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
examples AS (SELECT DISTINCT url, k, blocked FROM urls JOIN judged ON page_id = doc_id WHERE len(k) > 0),
total AS (SELECT count(*) AS n, sum(blocked) AS b FROM examples),
combos AS (
  SELECT list_filter(k, lambda x, i: (mask >> (i - 1)::BIGINT) & 1 = 1) AS c, blocked FROM (SELECT k, blocked, unnest(range(1, 1 << len(k))) AS mask FROM examples)),
counted AS (SELECT c, count(*) AS n, sum(blocked) AS b FROM combos GROUP BY c),
rules AS (
  SELECT c, counted.b / counted.n AS confidence, counted.b / total.n AS support FROM counted, total
  WHERE counted.b >= ceil(greatest({url_filter.LEAST_SUPPORT}::DOUBLE, {url_filter.LEAST_COUNT}::DOUBLE / total.n) * total.n) AND counted.b / counted.n >= {url_filter.LEAST_CONFIDENCE}::DOUBLE
    AND counted.b / counted.n / (total.b / total.n) >= {url_filter.LEAST_LIFT}::DOUBLE),
met AS (
  SELECT rid, min(r) AS r FROM (SELECT urls.rid, {{'a': -confidence, 'b': -support, 'l': len(c), 'c': c}} AS r FROM urls JOIN rules ON list_has_all(urls.k, rules.c)) GROUP BY rid),
given AS (SELECT rid, max_by({{'rule': rule, 'verdict': verdict}}, length(rule)) AS g
  FROM urls JOIN (VALUES {", ".join(f"('{r}', '{v}')" for r, v in url_filter.GIVEN)}) AS x(rule, verdict)
    ON ('.' || host) LIKE '%.' || split_part(rule, '/', 1) AND starts_with(path, substr(rule, instr(rule, '/'))) GROUP BY rid)
SELECT page_id, host, path, g.rule AS rule, CASE WHEN g IS NOT NULL THEN g.verdict WHEN r IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, array_to_string(r.c, ' & ') AS mined
FROM urls LEFT JOIN met USING (rid) LEFT JOIN given USING (rid)
""",
    "op13_hard_negatives": r"""
WITH rows AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, b.vec_id AS vec_id, b.rid AS rid, a.label = b.label AS alike, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.rid <> b.rid AND len(a.v) = len(b.v)),
positives AS (SELECT * FROM scored WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, rid) <= 5),
ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.rid ORDER BY n.score DESC, n.vec_id, n.rid)::INT AS rank
  FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.alike AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
""",
}
