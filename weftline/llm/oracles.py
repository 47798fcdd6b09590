"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _op11() -> str:
    """The counts, the tests of cutoffs and the verdicts in SQL, with the rules' parameters."""
    from . import quality as q

    risk, n_rules, steps = q.LIMIT / len(q.RULES), len(q.RULES), []
    for r, (part, whole, scale, cutoffs) in enumerate(q.RULES.values()):
        passes = "<" if cutoffs[0] > cutoffs[-1] else ">"
        level = f"CASE WHEN {whole} > 0 THEN len(list_filter({list(cutoffs)}, lambda c: ({scale} * {part}) // {whole} {passes} c)) ELSE {len(cutoffs)} END"
        before = f"c{r - 1}" if r else "counts"
        steps.append(rf"""
m{r} AS (SELECT *, {level} AS level, {"caught" if r else "false"} AS had FROM {before}),
f{r} AS (
  SELECT lang, level, count(*) FILTER (good AND held) AS gh, count(*) FILTER (good AND NOT held AND NOT had) AS gt,
    count(*) FILTER (NOT good AND NOT held AND NOT had) AS bt
  FROM m{r} JOIN marks USING (doc_id) WHERE NOT base_failed GROUP BY ALL
), s{r} AS (
  SELECT lang, level, sum(gh) OVER upto AS k, sum(gh) OVER e AS n,
    sum(bt) OVER upto * sum(gt) OVER e - {q.COST} * sum(gt) OVER upto * sum(bt) OVER e AS gain, (SELECT count(DISTINCT lang) FROM f{r}) * {n_rules} AS tests
  FROM f{r} WINDOW e AS (PARTITION BY lang), upto AS (PARTITION BY lang ORDER BY level ROWS UNBOUNDED PRECEDING)
), t{r} AS (
  SELECT *, CASE WHEN k >= n * {risk} THEN 1 ELSE list_sum(list_transform(range(0, k::BIGINT + 1),
    lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({risk}) + (n - j) * ln(1 - {risk})))) END AS p
  FROM s{r} WHERE level < {len(cutoffs)}
), p{r} AS (SELECT *, bool_and(p <= {q.DELTA} / tests) OVER (PARTITION BY lang ORDER BY level ROWS UNBOUNDED PRECEDING) AS ok FROM t{r}),
b{r} AS (SELECT lang, arg_max(level, (gain, -level)) AS best FROM p{r} WHERE ok AND gain > 0 GROUP BY lang),
c{r} AS (SELECT m{r}.* EXCLUDE (level, had{", caught" if r else ""}), had OR coalesce(level <= best, false) AS caught FROM m{r} LEFT JOIN b{r} USING (lang))""")
    return rf"""
WITH texts AS (SELECT row_number() OVER () AS d, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
words AS (SELECT d, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
grams AS (SELECT d, i, array_to_string(w[i : i + 2], ' ') AS g FROM words, unnest(range(1, len(w) - 1)) AS x(i)),
again AS (SELECT d, i FROM (SELECT d, i, count(*) OVER (PARTITION BY d, g) AS n FROM grams) WHERE n > 1),
repeats AS (SELECT d, count(DISTINCT p) AS n FROM (SELECT d, unnest(range(i, i + 3)) AS p FROM again) GROUP BY d),
lines AS (SELECT d, x FROM (SELECT d, unnest(string_split(t, chr(10))) AS x FROM texts) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
doubled AS (SELECT d, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n FROM lines GROUP BY d),
base AS (
  SELECT d, doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(doubled.n, 0)::BIGINT AS n_dup_lines,
    coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM texts JOIN words USING (d) LEFT JOIN repeats USING (d) LEFT JOIN doubled USING (d)
), counts AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
marks AS (SELECT doc_id, min(quality) > 0 AS good, contains('02468ace', md5(doc_id::VARCHAR)[1]) AS held FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
{",".join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT caught AS kept FROM c{n_rules - 1}"""


SQL: dict[str, str] = {
    "op2_minhash_near_dedup": rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s
  FROM words, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT d.doc_id, coalesce(any_value(z.n), 0)::BIGINT AS n_shingles, min(r.b)::BIGINT AS component_id, d.doc_id = min(r.b) AS kept
FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op4_arc_to_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT page_id, strlen(h)::BIGINT AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to FROM m""",
    "op10_decontamination": rf"""
WITH items AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0
), words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), places AS (
  SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM words, (SELECT DISTINCT k FROM windows), unnest(range(1, len(w) - k + 2)) AS t(i)
), found AS (SELECT doc_id, i, k, item_id FROM places JOIN windows USING (k, s)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(ids.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids.l, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM words LEFT JOIN hits h USING (doc_id) LEFT JOIN ids USING (doc_id)""",
    "op11_quality_rules": _op11(),
}
