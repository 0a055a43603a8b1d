"""SQL for the queries that SQL can express, to be run on the same tables."""

from __future__ import annotations

from askloom.llm.urlfilter import RULES, Rule

WORD = r"[^\x20\x09-\x0D]"

QUALITY = f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}+') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM texts WHERE len(words) >= 8),
again AS (
  SELECT doc_id, i FROM starts
  QUALIFY count(*) OVER (PARTITION BY doc_id, array_to_string(words[i:i + 7], ' ')) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, unnest(range(8)) AS j FROM again) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS again
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
counts AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_marks,
         coalesce(lines.n, 0)::BIGINT AS n_lines, coalesce(lines.again, 0)::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM texts LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 20 * n_words OR 100 * n_marks > 40 * n_words
            OR word_chars > 15 * n_words OR 100 * n_dup_lines > 50 * n_lines) AS kept
FROM judged
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MARK = """["'']?"""


def _rest(url: str) -> str:
    return f"CASE WHEN contains({url}, '://') THEN substr({url}, instr({url}, '://') + 3) END"


def _host(url: str) -> str:
    return f"coalesce(translate(regexp_extract({_rest(url)}, '^[^/?#]*', 0), '{UPPER}', '{LOWER}'), '')"


def _path(url: str) -> str:
    return f"coalesce(regexp_extract({_rest(url)}, '^[^/?#]*([^?#]*)', 1), '')"


def _address(url: str) -> str:
    host = rf"regexp_replace({_host(url)}, '^(www|m)\.', '')"
    path = rf"regexp_replace({_path(url)}, '(/|\.html?)$', '')"
    query = rf"coalesce(regexp_extract({_rest(url)}, '^[^?#]*\?([^#]*)', 1), '')"
    kept = (
        f"list_sort(list_filter(string_split({query}, '&'), lambda q: q <> '' AND NOT "
        r"regexp_matches(q, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)')))"
    )
    asked = f"CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END"
    return f"CASE WHEN {host} <> '' THEN {host} || {path} || {asked} END"


def _tag(name: str, has: str, value: str) -> str:
    tags = rf"regexp_extract_all(html, '(?i)<{name}\b[^>]*>')"
    return f"regexp_extract(list_filter({tags}, lambda x: regexp_matches(x, '(?i){has}'))[1], '(?i){value}', 1)"


def _rule(host: str, path: str, rules: tuple[Rule, ...]) -> str:
    fits = ", ".join(
        f"CASE WHEN ({host} = '{r.host}' OR ends_with({host}, '.{r.host}')) AND starts_with({path}, '{r.path}') "
        f"THEN {{'n': {len(r.host + r.path)}, 'allows': {str(r.verdict == 'allow').lower()}, 'rule': '{r.host + r.path}'}} END"
        for r in rules
    )
    return f"list_max(list_filter([{fits}], lambda x: x IS NOT NULL))"


def url_filter(rules: tuple[Rule, ...] = RULES) -> str:
    canonical = _tag("link", rf"\brel\s*=\s*{_MARK}\s*canonical\b", rf"\bhref\s*=\s*{_MARK}\s*([^\"''\s>]+)")
    refresh = _tag("meta", rf"\bhttp-equiv\s*=\s*{_MARK}\s*refresh\b", rf"\burl\s*=\s*{_MARK}([^\"''\s>]+)")
    scheme = "regexp_extract(url, '^([^:/?#]+)://', 1)"
    return rf"""
WITH RECURSIVE judged AS (
  SELECT page_id, url, {_host("url")} AS host, {_path("url")} AS path, {_address("url")} AS address,
         list_filter([{canonical}, {refresh}], lambda x: x <> '') AS links FROM pages),
ruled AS (SELECT *, {_rule("host", "path", rules)} AS fit FROM judged),
found AS (SELECT address, url, unnest(links) AS href FROM judged),
linked AS (
  SELECT address, CASE WHEN contains(href, '://') THEN href WHEN starts_with(href, '//') THEN {scheme} || ':' || href
                       WHEN starts_with(href, '/') THEN {scheme} || '://' || {_host("url")} || href END AS link FROM found),
edges AS (SELECT address AS a, {_address("link")} AS b FROM linked WHERE link IS NOT NULL),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (
  SELECT address AS id, address AS seen FROM judged WHERE address IS NOT NULL
  UNION SELECT b, b FROM edges
  UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON e.a = r.seen),
told AS (
  SELECT address, fit FROM ruled
  UNION ALL SELECT {_address("link")}, {_rule(_host("link"), _path("link"), rules)} FROM linked WHERE link IS NOT NULL),
heard AS (
  SELECT id, bool_or(NOT fit.allows) AND NOT bool_or(fit.allows) AS blocked
  FROM reach JOIN told ON told.address = reach.seen WHERE fit IS NOT NULL GROUP BY id)
SELECT page_id, host, path, fit.rule AS rule,
       CASE WHEN fit.allows THEN 'allow' WHEN NOT fit.allows THEN 'block'
            WHEN heard.blocked THEN 'block' ELSE 'allow' END AS verdict, address
FROM ruled LEFT JOIN heard ON heard.id = ruled.address
"""


def _forest(name: str, leaves: str) -> str:
    """Nodes ``grp, level, idx, h, n`` over leaves ``grp, idx, h``, ``n`` in the level."""
    return f"""
{name} AS (
  SELECT grp, 0 AS level, idx, h, count(*) OVER (PARTITION BY grp) AS n FROM {leaves}
  UNION ALL
  SELECT grp, level + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), (n + 15) // 16
  FROM {name} WHERE n > 1 GROUP BY grp, level, idx // 16, n)"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || ({value}::VARCHAR), '-')"


def _leaf(text: str) -> str:
    fields = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text)))
    return f"sha256({fields})"


def _steps(nodes: str, of: str, level: int) -> str:
    """Per document and level of ``nodes`` what stands before and after its node in the run."""
    return f"""
  SELECT d.key, {level} + own.level AS level,
         coalesce(string_agg(near.h, '' ORDER BY near.idx) FILTER (near.idx < own.idx), '') AS before,
         coalesce(string_agg(near.h, '' ORDER BY near.idx) FILTER (near.idx > own.idx), '') AS after
  FROM {of} d JOIN {nodes} own ON own.grp = d.grp AND own.n > 1 AND own.idx = d.idx // (16 ** own.level)::BIGINT
  JOIN {nodes} near ON near.grp = own.grp AND near.level = own.level AND near.idx // 16 = own.idx // 16
  GROUP BY d.key, own.level, own.idx"""


_BITS = "list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b)"
_CODES = "list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)"

MERKLE = f"""
WITH RECURSIVE codes AS (SELECT list_transform(range(256), lambda b: {_BITS}) AS codes),
rows AS (
  SELECT documents.*, row_number() OVER () AS key,
         xor(4294967295, list_reduce({_CODES}, lambda c, b: xor(c // 256, codes[xor(c % 256, b) + 1]), 4294967295)) AS crc
  FROM documents, codes),
docs AS (
  SELECT key, doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS grp, {_leaf("text")} AS h,
         CASE WHEN crc % 5 = 0 THEN {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS tampered, source FROM rows),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS idx FROM docs),
{_forest("trees", "leaves")},
subroots AS (SELECT 0 AS grp, grp AS idx, h FROM trees WHERE n = 1),
{_forest("top", "subroots")},
in_top AS (SELECT l.key, 0 AS grp, l.grp AS idx FROM leaves l),
steps AS ({_steps("trees", "leaves", 0)}
  UNION ALL {_steps("top", "in_top", 100)}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY level) AS no FROM steps),
folds AS (
  SELECT key, 0 AS no, coalesce(tampered, h) AS h FROM leaves
  UNION ALL
  SELECT f.key, f.no + 1, sha256(s.before || f.h || s.after) FROM folds f JOIN numbered s ON s.key = f.key AND s.no = f.no + 1),
proofs AS (SELECT key, string_agg(before || after, '' ORDER BY no) AS proof, max(no) AS steps FROM numbered GROUP BY key),
root AS (SELECT h FROM top WHERE n = 1)
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, root.h AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
       f.h AS folded_root, f.h = root.h AS verified
FROM leaves l JOIN subroots s ON s.idx = l.grp CROSS JOIN root LEFT JOIN proofs p ON p.key = l.key
JOIN folds f ON f.key = l.key AND f.no = coalesce(p.steps, 0)
"""

EXACT_DEDUP = r"""
WITH texts AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM texts
"""


ORACLE_SQL = {"op6_quality": QUALITY, "op10_url_filter": url_filter(), "op11_merkle_manifest": MERKLE, "op13_exact_dedup": EXACT_DEDUP}
