"""The registered queries as DuckDB SQL."""

from __future__ import annotations

from ..functions.text import IRREGULAR, STOPWORDS, UNCHANGED, WEAK_EDGES
from ..operators.evaluation import sample_numbers
from .queries import CATEGORY, PAIRS, SAMPLE, TERMS, TYPOS, WORDS


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


STOP, WEAK, QUERY_TERMS = _in(STOPWORDS), _in(WEAK_EDGES), _in(TERMS)


def _stem(w: str) -> str:
    irregular = " ".join(f"WHEN {w} = '{k}' THEN '{v}'" for k, v in IRREGULAR.items())
    return f"""CASE WHEN length({w}) <= 3 OR {w} IN {_in(UNCHANGED)} THEN {w} {irregular}
      WHEN ends_with({w}, 'ies') AND length({w}) > 4 THEN left({w}, -3) || 'y'
      WHEN ends_with({w}, 'sses') OR ends_with({w}, 'xes') OR ends_with({w}, 'ches') OR ends_with({w}, 'shes') OR ends_with({w}, 'zes') THEN left({w}, -2)
      WHEN ends_with({w}, 's') AND NOT ends_with({w}, 'ss') AND NOT ends_with({w}, 'us') AND NOT ends_with({w}, 'is') THEN left({w}, -1)
      ELSE {w} END"""


def _content(w: str) -> str:
    return f"(length({w}) > 1 AND {w} NOT IN {STOP})"


def _words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z0-9]+')"


DOCS = "docs AS (SELECT doc_id AS id, source AS category, split_part(text, chr(10), 1) AS title, substr(text, length(split_part(text, chr(10), 1)) + 1) AS abstract FROM documents)"

INDEX = f"""{DOCS},
tok AS (SELECT id, 3 AS weight, unnest({_words('title')}) AS w FROM docs UNION ALL SELECT id, 1 AS weight, unnest({_words('abstract')}) AS w FROM docs),
content AS (SELECT id, weight, w FROM tok WHERE {_content('w')}),
stems AS (SELECT w, {_stem('w')} AS term FROM (SELECT DISTINCT w FROM content)),
weighted AS (SELECT id, weight, term FROM content JOIN stems USING (w)),
post AS (SELECT term, id, least(sum(weight), 65535)::BIGINT AS tf FROM weighted GROUP BY term, id),
lens AS (SELECT docs.id, docs.category, coalesce(l.len, 0)::BIGINT AS doc_len FROM docs LEFT JOIN (SELECT id, sum(weight) AS len FROM weighted GROUP BY id) l USING (id)),
coll AS (SELECT count(*) AS num_docs, sum(doc_len)::DOUBLE / count(*) AS avg_len FROM lens),
norms AS (SELECT id, category, doc_len, (1.2e0 * (0.25e0 + 0.75e0 * doc_len / CASE WHEN avg_len = 0 THEN 1.0e0 ELSE avg_len END))::FLOAT::DOUBLE AS norm FROM lens, coll),
idfs AS (SELECT term, df, ln(1.0e0 + (num_docs - df + 0.5e0) / (df + 0.5e0)) AS idf FROM (SELECT term, count(*) AS df FROM post GROUP BY term), coll)"""

VOCABULARY = f"""least_n AS (SELECT greatest(2, count(*) // 20000) AS m FROM docs),
vocab AS (
  SELECT w AS key, count(DISTINCT id) AS weight FROM content GROUP BY w HAVING count(DISTINCT id) >= (SELECT m FROM least_n))"""

PHRASES = f"""titles AS (SELECT id, {_words('title')} AS w FROM docs),
grams AS (
  SELECT w[i:i + n - 1] AS g FROM (SELECT w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM titles, (VALUES (2), (3)) t(n) WHERE len(w) >= n)),
phrase AS (
  SELECT array_to_string(g, ' ') AS phrase, len(g) AS n_words, count(*) AS n FROM grams
  WHERE {_content('g[1]')} AND g[1] NOT IN {WEAK} AND {_content('g[-1]')} AND g[-1] NOT IN {WEAK} AND len(list_filter(g, lambda x: length(x) < 2)) = 0 GROUP BY ALL),
weighted_phrases AS (SELECT phrase AS key, (n * n_words)::BIGINT AS weight FROM phrase WHERE n >= (SELECT m FROM least_n))"""

ALL = f"{INDEX}, {VOCABULARY}, {PHRASES}"


def _scores(value: str) -> str:
    return f"""{INDEX},
scored AS (SELECT id, category, round(sum({value}), 9) AS score FROM post JOIN idfs USING (term) JOIN norms USING (id) WHERE term IN {QUERY_TERMS} GROUP BY id, category)"""


BM25 = "idf * 2.2e0 * tf / (tf + norm)"
RANKED = f"WITH {_scores(BM25)} SELECT id, category, round(score, 6) AS score FROM scored"


def _osa_cte(name: str, pairs: str) -> str:
    row = """list_reduce(list_transform(generate_series(1, length(b)), lambda j: [j]),
        lambda cur, x: list_append(cur, least(last[x[1] + 1] + 1, cur[-1] + 1,
          last[x[1]] + CASE WHEN substr(a, i + 1, 1) = substr(b, x[1], 1) THEN 0 ELSE 1 END,
          CASE WHEN i > 0 AND x[1] > 1 AND substr(a, i + 1, 1) = substr(b, x[1] - 1, 1) AND substr(a, i, 1) = substr(b, x[1], 1) THEN before[x[1] - 1] + 1 ELSE 1000 END)),
        [i + 1])"""
    return f"""{name}_rows AS (
  SELECT a, b, 0::BIGINT AS i, generate_series(0, length(b)) AS before, generate_series(0, length(b)) AS last FROM (SELECT DISTINCT a, b FROM {pairs} WHERE a <> '' AND b <> '')
  UNION ALL
  SELECT a, b, i + 1, last, {row} FROM {name}_rows WHERE i < length(a)),
{name} AS (SELECT a, b, last[-1] AS distance FROM {name}_rows WHERE i = length(a))"""


_WORD_ROWS = ", ".join(f"('{w}')" for w in WORDS)
FUZZY = f"""asked(word) AS (VALUES {_WORD_ROWS}),
near AS (SELECT word AS a, key AS b FROM asked, vocab WHERE abs(length(word) - length(key)) <= 2 AND levenshtein(word, key) <= 4),
{_osa_cte('osa', 'near')},
close AS (SELECT a AS word, b AS key, distance, weight FROM osa JOIN vocab ON b = key WHERE distance <= 2)"""
CORRECT = f"""{FUZZY},
fixed AS (
  SELECT word, arg_min(key, (distance, -weight, key)) AS correction FROM close
  WHERE length(word) >= 3 AND word NOT IN (SELECT key FROM vocab) AND distance <= CASE WHEN length(word) <= 4 THEN 1 ELSE 2 END GROUP BY word)"""

_TYPOS = TYPOS.replace("'", "''")
QUERY_FIX = f"""typed AS (SELECT unnest({_words(f"'{_TYPOS}'")}) AS word, generate_subscripts({_words(f"'{_TYPOS}'")}, 1) AS pos),
asked AS (SELECT DISTINCT word FROM typed WHERE {_content('word')}),
near AS (SELECT word AS a, key AS b FROM asked, vocab WHERE abs(length(word) - length(key)) <= 2 AND levenshtein(word, key) <= 4),
{_osa_cte('osa', 'near')},
close AS (SELECT a AS word, b AS key, distance, weight FROM osa JOIN vocab ON b = key),
known AS (SELECT word, coalesce(df, 0) AS df FROM (SELECT word, {_stem('word')} AS term FROM asked) LEFT JOIN idfs USING (term)),
absent AS (
  SELECT word, arg_min(key, (distance, -weight, key)) AS fix FROM close JOIN known USING (word)
  WHERE df = 0 AND length(word) >= 3 AND word NOT IN (SELECT key FROM vocab) AND distance <= CASE WHEN length(word) <= 4 THEN 1 ELSE 2 END GROUP BY word),
rare AS (
  SELECT word, arg_min(key, (distance, -weight, key)) AS fix, arg_min(weight, (distance, -weight, key)) AS weight, any_value(df) AS df FROM close JOIN known USING (word)
  WHERE df > 0 AND length(word) >= 3 AND word NOT IN (SELECT key FROM vocab) AND distance <= 1 GROUP BY word),
fixes AS (SELECT word, fix FROM absent UNION ALL SELECT word, fix FROM rare WHERE weight >= 2 * df)"""

TITLE = "split_part(text, chr(10), 1)"
RECORDS = f"""rec AS (
  SELECT doc_id, CASE doc_id % 3
      WHEN 0 THEN 'cs/' || yymm || substr(number, 3, 3) WHEN 1 THEN yymm || '.' || number ELSE 'x' || number END AS id,
    {TITLE} AS title, substr(text, length({TITLE}) + 1) AS abstract, source || '  writer' AS authors, source || ' ' || lang AS categories
  FROM (SELECT *, lpad((doc_id % 100000)::VARCHAR, 5, '0') AS number, lpad((doc_id % 100)::VARCHAR, 2, '0') || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') AS yymm FROM documents))"""
MONTH = r"""CASE WHEN regexp_matches(id, '^\d{4}\.\d{4,5}') THEN CASE WHEN substr(id, 1, 2)::INT >= 91 THEN '19' ELSE '20' END || substr(id, 1, 2) || '-' || substr(id, 3, 2)
  WHEN regexp_matches(id, '^[a-z\-]+(\.[A-Z]{2})?/\d{7}') THEN
    CASE WHEN regexp_extract(id, '/(\d{2})', 1)::INT >= 91 THEN '19' ELSE '20' END || regexp_extract(id, '/(\d{2})', 1) || '-' || regexp_extract(id, '/\d{2}(\d{2})', 1)
  ELSE '0000-00' END"""


def _clean(c: str) -> str:
    # all white space of Unicode by name, since the expression engine's own class holds ASCII only
    return rf"trim(regexp_replace({c}, '[\t-\r\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"


HIT = f"({_stem('lower(p)')}) IN {QUERY_TERMS} AND regexp_matches(p, '^[A-Za-z0-9]')"
SPLIT = "'[A-Za-z0-9]+|[^A-Za-z0-9]+'"
#: Pieces of a text in order, and the group of each: a hit is a group of its own, what lies between hits another.
PIECES = f"""piece AS (
  SELECT id, n, p, {HIT} AS hit FROM (SELECT id, unnest(regexp_extract_all(t, {SPLIT})) AS p, generate_subscripts(regexp_extract_all(t, {SPLIT}), 1) AS n FROM src)),
part AS (SELECT *, 2 * sum(hit::INT) OVER (PARTITION BY id ORDER BY n) - hit::INT AS grp FROM piece),
marked AS (SELECT id, grp, string_agg(p, '' ORDER BY n) AS text, bool_or(hit) AS hit FROM part GROUP BY id, grp)"""
WINDOW = f"""word AS (SELECT id, n, hit::INT AS hit, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS k, count(*) OVER (PARTITION BY id) AS words FROM piece WHERE regexp_matches(p, '^[A-Za-z0-9]')),
best AS (
  SELECT id, arg_max(k, (total, -k)) AS start, any_value(words) AS words FROM (SELECT id, k, words, sum(hit) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN CURRENT ROW AND 44 FOLLOWING) AS total FROM word)
  WHERE k <= greatest(words - 45, 0) GROUP BY id),
span AS (
  SELECT best.id, start, best.words, CASE WHEN start > 0 THEN b.n ELSE 1 END AS lo, CASE WHEN start + 45 < best.words THEN e.n ELSE 1000000000 END AS hi,
    (SELECT coalesce(sum(hit), 0) FROM word w WHERE w.id = best.id AND w.k BETWEEN start AND start + 44) AS hits
  FROM best JOIN word b ON b.id = best.id AND b.k = start JOIN word e ON e.id = best.id AND e.k = least(start + 44, best.words - 1)),
shown AS (
  SELECT s.id, s.start, s.hits, CASE WHEN s.lo > 1 THEN '... ' ELSE '' END AS dots, CASE WHEN s.start + 45 < s.words THEN ' ...' ELSE '' END AS more, p.n, p.p, p.hit
  FROM span s JOIN piece p ON p.id = s.id AND p.n BETWEEN s.lo AND s.hi)"""
BRACKET = "CASE WHEN hit THEN '[' || p || ']' ELSE p END"


def _known_item(sample: int | None = None) -> str:
    modes = {"bm25": BM25, "tf": "tf", "match": "1.0e0"}
    scores = ", ".join(f"round(sum({v}), 9) AS {m}" for m, v in modes.items())
    source, chosen = "docs", ""
    if sample is not None:
        # positions among n documents, for the sizes of table at hand
        places = ", ".join(f"({n}, {i})" for n in (200, 1000, 10_000) for i in sample_numbers(n, sample))
        chosen = f"places(n, i) AS (VALUES {places}),\nchosen AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM docs) JOIN places USING (n, i)),\n"
        source = "chosen"
    ranks = " UNION ALL ".join(f"SELECT '{m}' AS mode, s.qid, sum((s.{m} > o.{m})::INT) + 1 + (sum((s.{m} = o.{m})::INT) - 1) / 2.0e0 AS rank FROM met s JOIN met o ON s.qid = o.qid AND o.id = o.qid GROUP BY s.qid" for m in modes)
    return f"""WITH {INDEX.replace(f"SELECT id, 3 AS weight, unnest({_words('title')}) AS w FROM docs UNION ALL ", "")},
{chosen}asked AS (SELECT DISTINCT id AS qid, {_stem('w')} AS term FROM (SELECT id, unnest({_words('title')}) AS w FROM {source}) WHERE {_content('w')}),
met AS (SELECT qid, id, {scores} FROM asked JOIN post USING (term) JOIN idfs USING (term) JOIN norms USING (id) GROUP BY qid, id),
ranks AS ({ranks})
SELECT mode, round(sum((rank <= 1)::INT)::DOUBLE / n, 6) AS recall_1, round(sum((rank <= 10)::INT)::DOUBLE / n, 6) AS recall_10, round(sum(CASE WHEN rank <= 10 THEN 1.0e0 / rank ELSE 0 END) / n, 6) AS mrr_10
FROM ranks, (SELECT count(*) AS n FROM {source}) GROUP BY mode, n"""


def _percentile(f: str) -> str:
    # DuckDB rounds halves away from zero, so halves to even are spelled out
    x = f"{f}e0 * (count(*) - 1)"
    return f"list_sort(list(v))[CASE WHEN {x} - floor({x}) = 0.5 THEN 2 * round(({x}) / 2) ELSE round({x}) END::BIGINT + 1]::BIGINT"


def _suggest(prefix_sql: str) -> str:
    return f"WITH {ALL}, {prefix_sql}"


SINGLE = """ph AS (SELECT key, row_number() OVER (ORDER BY weight DESC, key) AS r FROM weighted_phrases WHERE starts_with(key, 'th') ORDER BY r LIMIT 8),
wo AS (SELECT key, row_number() OVER (ORDER BY weight DESC, key) AS r FROM vocab WHERE starts_with(key, 'th') ORDER BY r LIMIT 8),
allof AS (SELECT key, 0 AS src, r FROM wo WHERE r <= 8 - least((SELECT count(*) FROM ph), 4) UNION ALL SELECT key, 1, r FROM ph),
uniq AS (SELECT key, min((src, r)) AS o FROM allof WHERE key <> 'th' GROUP BY key)
SELECT row_number() OVER (ORDER BY o) - 1 AS pos, key AS suggestion FROM uniq ORDER BY o LIMIT 8"""
MULTI = """two AS (SELECT key, row_number() OVER (ORDER BY weight DESC, key) AS r FROM weighted_phrases WHERE starts_with(key, 'zebra th') ORDER BY r LIMIT 8),
one AS (SELECT 'zebra ' || key AS key, row_number() OVER (ORDER BY weight DESC, key) AS r FROM weighted_phrases WHERE starts_with(key, 'th') ORDER BY r LIMIT 8),
wo AS (SELECT 'zebra ' || key AS key, row_number() OVER (ORDER BY weight DESC, key) AS r FROM vocab WHERE starts_with(key, 'th') ORDER BY r LIMIT 8),
n AS (SELECT (SELECT count(*) FROM two WHERE key <> 'zebra th') AS n2, (SELECT count(*) FROM (SELECT key FROM two UNION SELECT key FROM one) WHERE key <> 'zebra th') AS n1),
allof AS (SELECT key, 0 AS src, r FROM two UNION ALL SELECT key, 1, r FROM one, n WHERE n2 < 4 UNION ALL SELECT key, 2, r FROM wo, n WHERE n2 < 4 AND n1 < 4),
uniq AS (SELECT key, min((src, r)) AS o FROM allof WHERE key <> 'zebra th' GROUP BY key)
SELECT row_number() OVER (ORDER BY o) - 1 AS pos, key AS suggestion FROM uniq ORDER BY o LIMIT 8"""

_STORE = f"SELECT doc_id AS id, {TITLE} AS title, substr(text, length({TITLE}) + 1) AS abstract FROM documents"
_PAIR_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in PAIRS)

SEARCH = f"""{_scores(BM25)}, page AS (SELECT id, score FROM scored ORDER BY score DESC, id LIMIT 10), {RECORDS},
src AS (SELECT id, abstract AS t FROM docs WHERE id IN (SELECT id FROM page)), {PIECES}, {WINDOW},
snip AS (SELECT id, any_value(dots) || string_agg({BRACKET}, '' ORDER BY n) || any_value(more) AS snippet FROM shown GROUP BY id),
tp AS (SELECT id, n, p, {HIT} AS hit FROM (SELECT id, unnest(regexp_extract_all(title, {SPLIT})) AS p, generate_subscripts(regexp_extract_all(title, {SPLIT}), 1) AS n FROM docs WHERE id IN (SELECT id FROM page))),
head AS (SELECT id, string_agg({BRACKET}, '' ORDER BY n) AS title FROM tp GROUP BY id)
SELECT page.id, rec.arxiv_id, 'https://arxiv.org/abs/' || rec.arxiv_id AS url, coalesce(head.title, '') AS title, coalesce(snip.snippet, rec.abstract) AS snippet, rec.authors, rec.category, rec.published, round(page.score, 6) AS score FROM page JOIN (SELECT doc_id, id AS arxiv_id, abstract, authors, split_part(categories, ' ', 1) AS category, {MONTH} AS published FROM rec) rec ON rec.doc_id = page.id LEFT JOIN head ON head.id = page.id LEFT JOIN snip ON snip.id = page.id"""

ORACLE_SQL = {
    "tokens_words": f"SELECT doc_id, generate_subscripts({_words('text')}, 1) - 1 AS pos, unnest({_words('text')}) AS word FROM documents",
    "tokens_terms": f"""WITH t AS (SELECT doc_id, generate_subscripts({_words('text')}, 1) AS k, unnest({_words('text')}) AS w FROM documents)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos, {_stem('w')} AS term FROM t WHERE {_content('w')}""",
    "stem_vocab": f"SELECT word, {_stem('word')} AS stem, {_content('word')} AS is_content FROM (SELECT DISTINCT unnest({_words('text')}) AS word FROM documents)",
    "normalise_docs": f"""WITH {RECORDS} SELECT id AS arxiv_id, {_clean('title')} AS title, {_clean('abstract')} AS abstract, {_clean('authors')} AS authors, {_clean('categories')} AS categories,
  CASE WHEN {_clean('categories')} = '' THEN 'unknown' ELSE split_part({_clean('categories')}, ' ', 1) END AS primary_category, {MONTH} AS published FROM rec""",
    "published_month": f"WITH {RECORDS} SELECT doc_id, id, {MONTH} AS published FROM rec",
    "ingest_dedup": f"""WITH {RECORDS}, old AS (SELECT id FROM rec WHERE starts_with(categories, 'src0 ')),
first AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY doc_id) AS k FROM rec WHERE title <> '' AND abstract <> '')
SELECT id, doc_id, title FROM first WHERE k = 1 AND id NOT IN (SELECT id FROM old)""",
    "store_count": "SELECT count(*) AS n FROM documents",
    "get_documents": f"SELECT * FROM ({_STORE}) WHERE id IN (3, 17, 42, 99)",
    "keyset_page": f"SELECT id, title FROM ({_STORE}) WHERE id > 20 ORDER BY id LIMIT 25",
    "naive_search": f"SELECT id FROM ({_STORE}) WHERE (contains(lower(title), 'thing') OR contains(lower(abstract), 'thing')) AND (contains(lower(title), 'anon') OR contains(lower(abstract), 'anon')) ORDER BY id LIMIT 10",
    "postings": f"WITH {INDEX} SELECT term, id, tf FROM post",
    "doc_norm": f"WITH {INDEX} SELECT id, category, doc_len, round(norm, 6) AS norm FROM norms",
    "term_idf": f"WITH {INDEX} SELECT term, df, round(idf, 6) AS idf FROM idfs",
    "vocabulary": f"WITH {INDEX}, {VOCABULARY} SELECT key, weight FROM vocab",
    "title_phrases": f"WITH {ALL} SELECT phrase, sum(n)::BIGINT AS n FROM phrase GROUP BY phrase",
    "phrase_weights": f"WITH {ALL} SELECT key, weight FROM weighted_phrases",
    "category_counts": f"WITH {DOCS} SELECT category, count(*) AS papers FROM docs GROUP BY category",
    "engine_stats": f"""WITH {ALL} SELECT (SELECT num_docs FROM coll) AS documents, (SELECT round(avg_len, 1) FROM coll) AS average_length, (SELECT count(DISTINCT category) FROM docs) AS categories,
  (SELECT count(*) FROM idfs) AS terms, (SELECT count(*) FROM post) AS postings, (SELECT count(*) FROM vocab) AS suggestion_words, (SELECT count(*) FROM weighted_phrases) AS suggestion_phrases""",
    "score_bm25": RANKED,
    "score_tf": f"WITH {_scores('tf')} SELECT id, category, round(score, 6)::DOUBLE AS score FROM scored",
    "score_match": f"WITH {_scores('1.0e0')} SELECT id, category, round(score, 6) AS score FROM scored",
    "rank_bm25_topk": f"WITH {_scores(BM25)} SELECT id, category, round(score, 6) AS score FROM (SELECT * FROM scored ORDER BY score DESC, id LIMIT 10)",
    "rank_category": f"WITH {_scores(BM25)} SELECT id, category, round(score, 6) AS score FROM (SELECT * FROM scored WHERE category = '{CATEGORY}' ORDER BY score DESC, id LIMIT 10)",
    "rank_page": f"WITH {_scores(BM25)} SELECT id, category, round(score, 6) AS score FROM (SELECT * FROM scored ORDER BY score DESC, id LIMIT 10 OFFSET 20)",
    "match_total": f"WITH {_scores(BM25)} SELECT '' AS category, count(*) AS total FROM scored UNION ALL SELECT '{CATEGORY}', count(*) FROM scored WHERE category = '{CATEGORY}'",
    "complete_words": f"WITH {INDEX}, {VOCABULARY} SELECT key, weight FROM vocab WHERE starts_with(key, 'th') ORDER BY weight DESC, key LIMIT 8",
    "complete_phrases": f"WITH {ALL} SELECT key, weight FROM weighted_phrases WHERE starts_with(key, 'th') ORDER BY weight DESC, key LIMIT 8",
    "suggest_single": _suggest(SINGLE),
    "suggest_multi": _suggest(MULTI),
    "edit_distance": f"""WITH RECURSIVE pairs AS (SELECT DISTINCT a, 'thing' AS b FROM (SELECT unnest({_words('text')}) AS a FROM benchmark) WHERE {_content('a')} UNION ALL SELECT * FROM (VALUES {_PAIR_ROWS}) t(a, b)),
{_osa_cte('osa', 'pairs')} SELECT a, b, distance FROM pairs JOIN osa USING (a, b)""",
    "fuzzy_candidates": f"WITH RECURSIVE {INDEX}, {VOCABULARY}, {FUZZY} SELECT word, key, distance, weight FROM close",
    "spell_correct": f"WITH RECURSIVE {INDEX}, {VOCABULARY}, {CORRECT} SELECT word, correction FROM asked LEFT JOIN fixed USING (word)",
    "correct_query": f"""WITH RECURSIVE {INDEX}, {VOCABULARY}, {QUERY_FIX},
made AS (SELECT pos, coalesce(CASE WHEN {_content('word')} THEN fix END, word) AS w, {_content('word')} AS c, fix FROM typed LEFT JOIN fixes USING (word))
SELECT string_agg(w, ' ' ORDER BY pos) FILTER (WHERE c) AS content, CASE WHEN bool_or(fix IS NOT NULL) THEN string_agg(w, ' ' ORDER BY pos) END AS corrected FROM made""",
    "highlight_title": f"WITH {DOCS}, src AS (SELECT id, title AS t FROM docs), {PIECES} SELECT id, row_number() OVER (PARTITION BY id ORDER BY grp) - 1 AS pos, text, hit FROM marked",
    "best_snippet": f"""WITH {DOCS}, src AS (SELECT id, abstract AS t FROM docs), {PIECES}, {WINDOW},
found AS (SELECT id, start, hits, any_value(dots) || string_agg(p, '' ORDER BY n) || any_value(more) AS snippet FROM shown GROUP BY id, start, hits)
SELECT docs.id, coalesce(start, 0)::BIGINT AS start, coalesce(hits, 0)::BIGINT AS hits, coalesce(snippet, abstract) AS snippet FROM docs LEFT JOIN found USING (id)""",
    "search": f"WITH {SEARCH}",
    "stored_search": f"WITH {SEARCH.replace(' AS score FROM page JOIN', ' AS score, (SELECT count(*) FROM scored) AS total FROM page JOIN')}",
    "known_item_eval": _known_item(),
    "known_item_sample": _known_item(SAMPLE),
    "jsonl_source": f"WITH {RECORDS} SELECT id, title, abstract, authors, categories FROM rec",
    "oai_source": f"""WITH {RECORDS} SELECT id, array_to_string({_words('title')}, ' ') AS title, array_to_string({_words('abstract')}, ' ') AS abstract, 'A. B. ' || split_part(authors, ' ', 1) || '; Writer' AS authors, categories
  FROM rec WHERE doc_id % 10 <> 0""",
    "store_ingest": f"""WITH {RECORDS}, first AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY doc_id) AS k FROM rec WHERE title <> '' AND abstract <> ''),
kept AS (SELECT * FROM first WHERE k = 1)
SELECT row_number() OVER (ORDER BY doc_id) AS id, id AS arxiv_id, {_clean('title')} AS title, split_part(categories, ' ', 1) AS primary_category, (SELECT count(*) FROM kept) AS added, 0::BIGINT AS added_again FROM kept""",
    "word_lookup": f"WITH {INDEX}, {VOCABULARY}, asked(word) AS (VALUES {_WORD_ROWS}) SELECT word, coalesce(weight, 0) AS weight, weight IS NOT NULL AS known FROM asked LEFT JOIN vocab ON key = word",
    "percentiles": f"SELECT source AS category, {_percentile('0.5')} AS p50, {_percentile('0.95')} AS p95, {_percentile('0.99')} AS p99 FROM (SELECT source, length(text) AS v FROM documents) GROUP BY source",
}
