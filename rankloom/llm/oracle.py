"""DuckDB SQL that gives the rows of the queries by plain counting, where SQL can express them."""

from __future__ import annotations

from rankloom.llm import license_scan
from rankloom.llm.common import WORD

_WORD = WORD.replace(r"\x00", r"\x{00}").replace(r"\x2F", r"\x{2F}")
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return f"regexp_extract_all({_LOWER.format(f'coalesce({text}, {chr(39) * 2})')}, '{_WORD}')"


_COMPONENTS = """
reach(node, seen) AS (
    SELECT a, b FROM links
    UNION
    SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen
),
least AS (SELECT node, least(node, min(seen)) AS component FROM reach GROUP BY node)
"""

EMBEDDING_DEDUP = f"""
WITH RECURSIVE
good AS (
    SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
      AND len([x FOR x IN embedding IF x <> 0]) > 0
),
links AS (
    SELECT p.vec_id AS a, q.vec_id AS b
    FROM good p JOIN good q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.v) = len(q.v)
    WHERE list_cosine_similarity(p.v, q.v) >= 0.98
),
{_COMPONENTS},
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(component, e.vec_id) AS component_id,
       coalesce(component, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN counts ON counts.a = e.vec_id LEFT JOIN least ON least.node = e.vec_id
"""

URL_FILTER = """
WITH split AS (
    SELECT page_id, len(regexp_extract_all(html, '%%%|\\*\\*\\*|###|\\$\\$\\$|&amp;&amp;&amp;')) >= 10 AS bad,
           CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest
    FROM pages
),
parts AS (
    SELECT page_id, bad, rest,
           coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
           coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
           regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1) AS query
    FROM split
),
forms AS (
    SELECT *,
           CASE WHEN rest IS NOT NULL THEN
               regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\\.', '')
               || regexp_replace(path, '/+$', '')
               || coalesce('?' || nullif(array_to_string(list_sort(
                      [p FOR p IN string_split(query, '&')
                       IF p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)')]), '&'), ''), '')
           END AS canonical
    FROM parts
),
listed AS (
    SELECT DISTINCT canonical FROM forms
    WHERE rest IS NOT NULL AND bad
),
judged AS (
    SELECT page_id, host, path, canonical IS NOT NULL AND canonical IN (SELECT canonical FROM listed) AS found,
           CASE
               WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/')
                   THEN 'www.example.com/en/'
               WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/')
                   THEN 'example.com/en/'
               WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
               WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
               WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
           END AS rule
    FROM forms
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN found THEN 'block' ELSE 'allow' END AS verdict,
       found AS listed
FROM judged
"""

DECONTAMINATE = f"""
WITH doc AS (SELECT doc_id, {_words('text')} AS words FROM documents),
item AS (SELECT item_id, {_words('text')} AS words FROM benchmark),
pattern AS (
    SELECT DISTINCT item_id, len(words[s : s + least(10, len(words)) - 1]) AS size,
           array_to_string(words[s : s + least(10, len(words)) - 1], ' ') AS gram
    FROM (SELECT item_id, words, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS s FROM item WHERE len(words) > 0)
),
sizes AS (SELECT DISTINCT size FROM pattern),
place AS (
    SELECT doc_id, s, size, array_to_string(words[s : s + size - 1], ' ') AS gram
    FROM (
        SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS s
        FROM doc, sizes WHERE len(words) >= size
    )
),
found AS (SELECT doc_id, s, p.size, item_id FROM place JOIN pattern p USING (size, gram)),
hit AS (
    SELECT doc_id, count(DISTINCT w) AS n_hit
    FROM (SELECT doc_id, unnest(range(s, s + size)) AS w FROM found) GROUP BY doc_id
),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def _license_scan() -> str:
    templates = [*(t._replace(exact=True) for t in license_scan.PHRASES), *license_scan.NOTICES]
    rows = ", ".join(f"({k}, '{t.label}', '{t.text}', {t.exact})" for k, t in enumerate(templates))
    return f"""
WITH template(id, label, body, exact) AS (VALUES {rows}),
part AS (
    SELECT id, label, exact, unnest(range(1, len(w))) AS place, w, len(w) - 1 AS grams
    FROM (SELECT *, string_split(body, ' ') AS w FROM template)
),
doc AS (SELECT doc_id, {_words('text')} AS words FROM documents),
pair AS (
    SELECT doc_id, s AS pos, words[s] AS first, words[s + 1] AS second
    FROM (SELECT doc_id, words, unnest(range(1, len(words))) AS s FROM doc)
),
vote AS (
    SELECT doc_id, id, label, exact, grams, pos - place AS diagonal, list(DISTINCT place) AS places
    FROM pair JOIN part ON pair.first = w[place] AND pair.second = w[place + 1]
    GROUP BY ALL
),
kept AS (
    SELECT *, CASE WHEN exact OR diagonal - lag(diagonal) OVER d <= {license_scan.DRIFT} IS NOT TRUE THEN 1 ELSE 0 END AS fresh
    FROM vote WHERE NOT exact OR len(places) = grams
    WINDOW d AS (PARTITION BY doc_id, id ORDER BY diagonal)
),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, id ORDER BY diagonal) AS span FROM kept),
spans AS (
    SELECT doc_id, id, label, exact, span, min(diagonal) AS start,
           len(list_distinct(flatten(list(places)))) / min(grams) AS coverage
    FROM numbered GROUP BY ALL
),
found AS (
    SELECT doc_id, count(*) FILTER (exact) AS n_base, min(start) FILTER (exact) AS first_word,
           max(start) FILTER (exact) AS last_word,
           string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels,
           string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact OR coverage >= {license_scan.COVERAGE}) AS labels,
           max(coverage) AS score
    FROM spans GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0)::DOUBLE AS score
FROM doc LEFT JOIN found USING (doc_id)
"""


NGRAM_JOIN = f"""
WITH RECURSIVE
doc AS (SELECT doc_id, {_words('text')} AS words FROM documents),
gram AS (
    SELECT DISTINCT doc_id, array_to_string(words[s : s + least(5, len(words)) - 1], ' ') AS gram
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - least(5, len(words)) + 2)) AS s FROM doc WHERE len(words) > 0)
),
size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
common AS (
    SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n
    FROM gram p JOIN gram q ON p.gram = q.gram AND p.doc_id <> q.doc_id GROUP BY ALL
),
alike AS (
    SELECT a, b, common.n = x.n AND common.n = y.n AS equal
    FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
    WHERE common.n / (x.n + y.n - common.n) >= 0.8
),
links AS (SELECT a, b FROM alike),
{_COMPONENTS},
counts AS (SELECT a, count(*) AS n, min(b) FILTER (equal) AS twin FROM alike GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(twin, doc_id)) AS class_id, coalesce(n, 0) AS n_links,
       coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM doc LEFT JOIN counts ON counts.a = doc_id LEFT JOIN least ON least.node = doc_id
"""

LINE_DEDUP = f"""
WITH line AS (
    SELECT doc_id, row, place, lines[place] AS line, {_LOWER.format("trim(lines[place], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
    FROM (
        SELECT doc_id, row, lines, unnest(range(1, len(lines) + 1)) AS place
        FROM (SELECT doc_id, row_number() OVER () AS row, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
    )
),
shared AS (
    SELECT key, max(doc_id) AS last
    FROM line WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
),
marked AS (
    SELECT line.*, shared.key IS NOT NULL AND doc_id <> last AS gone FROM line LEFT JOIN shared USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row, doc_id
"""

COLLOCATIONS = f"""
WITH piece AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents
),
run AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM piece),
total AS (SELECT lang, sum(len(w)) AS n FROM run GROUP BY lang),
place AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS s FROM run WHERE len(w) > 0),
gram AS (
    SELECT lang, w[s : s + size - 1] AS words
    FROM place, (VALUES (1), (2), (3), (4)) AS sizes(size) WHERE s + size - 1 <= len(w)
),
counted AS (SELECT lang, words, count(*) AS n FROM gram GROUP BY ALL HAVING count(*) >= 30),
candidate AS (SELECT lang, words, n AS a FROM counted WHERE len(words) > 1),
cut AS (SELECT *, unnest(range(1, len(words))) AS k FROM candidate),
weighed AS (
    SELECT cut.*, x.n AS l, y.n AS r, 2000000::HUGEINT * a // (x.n + y.n) AS score
    FROM cut JOIN counted x ON x.lang = cut.lang AND x.words = cut.words[1 : k]
             JOIN counted y ON y.lang = cut.lang AND y.words = cut.words[k + 1 :]
),
weakest AS (
    SELECT * FROM weighed QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1
),
inside AS (
    SELECT DISTINCT lang, words[s : s + size - 1] AS words, a AS around
    FROM (SELECT lang, words, a, size, unnest(range(1, len(words) - size + 2)) AS s
          FROM candidate, (VALUES (2), (3)) AS sizes(size) WHERE size < len(words))
),
cover AS (SELECT lang, words, max(around) AS around FROM inside GROUP BY ALL),
kept AS (
    SELECT weakest.*, array_to_string(words, ' ') AS phrase
    FROM weakest LEFT JOIN cover USING (lang, words)
    WHERE around IS NULL OR 100::HUGEINT * around < 80::HUGEINT * a
)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a, l, r, total.n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN total ON total.lang = kept.lang
QUALIFY rank <= 2000
"""

SQL = {
    "op4_embedding_dedup": EMBEDDING_DEDUP,
    "op7_url_filter": URL_FILTER,
    "op8_decontaminate": DECONTAMINATE,
    "op9_license_scan": _license_scan(),
    "op10_ngram_join": NGRAM_JOIN,
    "op11_line_dedup": LINE_DEDUP,
    "op12_collocations": COLLOCATIONS,
}
