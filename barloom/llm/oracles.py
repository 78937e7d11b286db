"""DuckDB SQL for the queries of this package that SQL can express."""

from barloom.llm.quality import BOILERPLATE, LineRules
from barloom.llm.queries import SHOWN, URL_RULES
from barloom.llm.url_filter import TreeRules

_R = LineRules()
_NO_PHRASE = " AND ".join(f"NOT contains(low, '{p}')" for p in BOILERPLATE)


def _count(text: str, characters: str) -> str:
    """Code points of text that are among characters."""
    return f"(length({text}) - length(translate({text}, '{characters}', '')))"


_VISIBLE = "length(regexp_replace({}, '[\\x20\\x09-\\x0D]', '', 'g'))"

OP4 = f"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS body FROM documents),
words AS (SELECT k, list_filter(regexp_split_to_array(body, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM docs),
windows AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
twice AS (SELECT k, i FROM windows JOIN (SELECT k, g FROM windows GROUP BY ALL HAVING count(*) > 1) USING (k, g)),
covered AS (SELECT k, count(DISTINCT i + d) AS n FROM twice, (VALUES (0), (1), (2)) t(d) GROUP BY 1),
lines AS (SELECT k, l, trim(l, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS bare FROM (SELECT k, unnest(string_split(body, chr(10))) AS l FROM docs) WHERE {_VISIBLE.format("l")} > 0),
facts AS (SELECT k, l, bare, {_count("bare", " ")} AS spaces, length(replace(bare, ' ', '')) AS visible, lower(bare) AS low FROM lines),
good AS (
    SELECT k, sum({_VISIBLE.format("l")}) AS n FROM facts
    WHERE {_count("bare", "|»›•")} < {_R.navigation_marks} AND {_count("bare", "#*$%&|<>")} <= {_R.max_symbol_share}::DOUBLE * visible
        AND (spaces < {_R.heading_words} OR regexp_matches(right(bare, 4), '[.!?…:;。！？][\x22''”’»)\\]]*$')) AND (spaces >= {_R.boilerplate_words} OR ({_NO_PHRASE}))
    GROUP BY 1
),
dup AS (SELECT k, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY 1),
base AS (
    SELECT doc_id, len(w) AS n_words, {_VISIBLE.format("body")} AS word_chars, {_count("body", "#*$%&|<>")} AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, coalesce(good.n, 0) AS good
    FROM docs JOIN words USING (k) LEFT JOIN covered USING (k) LEFT JOIN dup USING (k) LEFT JOIN good USING (k)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, NOT failed AND word_chars - good <= {_R.max_lost_share}::DOUBLE * word_chars AS kept
FROM (SELECT *, n_words < {_R.min_words} OR n_repeat_words > {_R.max_repeat_share}::DOUBLE * n_words AS failed FROM base)
"""

OP1 = r"""
WITH RECURSIVE words AS (
    SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
),
shingles AS (SELECT DISTINCT k, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT k, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT k, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM shingles a JOIN shingles b USING (s) WHERE a.k <> b.k GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.k = a JOIN sizes y ON y.k = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT k, k AS r FROM words UNION SELECT reach.k, b FROM reach JOIN links ON a = r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least_id AS component_id
FROM words LEFT JOIN sizes USING (k) JOIN (SELECT reach.k, min(o.doc_id) AS least_id FROM reach JOIN words o ON o.k = r GROUP BY 1) USING (k)
"""

_T = TreeRules()
_FITS = [f"WHEN (host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '/{p}') THEN" for d, _, p in (r.partition("/") for _, r in sorted(URL_RULES, key=lambda r: -len(r[1])))]
_BY_RULE = [r for r in sorted(URL_RULES, key=lambda r: -len(r[1]))]
_RULE = "CASE " + " ".join(f"{f} '{r}'" for f, (_, r) in zip(_FITS, _BY_RULE)) + " END"
_SAYS = "CASE " + " ".join(f"{f} '{v}'" for f, (v, _) in zip(_FITS, _BY_RULE)) + " END"

OP8 = f"""
WITH RECURSIVE seen AS (
    SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
),
cut AS (
    SELECT *, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '^[0-9a-fA-F-]{{16,}}$') THEN '*' ELSE regexp_replace(x, '[0-9]+', '#', 'g') END) AS template FROM seen
),
known AS (SELECT page_id, max((quality = 0 OR toxic = 1)::INTEGER) AS bad FROM (SELECT page_id, {SHOWN} AS doc_id FROM pages) JOIN labels USING (doc_id) GROUP BY 1),
counts AS (SELECT host, template, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad FROM cut LEFT JOIN known USING (page_id) GROUP BY ALL),
deepest AS (SELECT max(len(template)) AS depth FROM counts),
step AS (
    SELECT 0 AS level, host, template, template AS node, labelled, bad FROM counts
    UNION ALL
    (
        WITH placed AS (SELECT *, array_to_string(node[1:level], '/') AS above, node[level + 1] AS here FROM step WHERE level < (SELECT depth FROM deepest)),
        children AS (SELECT host, above, here, sum(labelled) AS n, sum(bad) AS b FROM placed WHERE here IS NOT NULL GROUP BY ALL),
        siblings AS (SELECT host, above, sum(n) AS all_n, sum(b) AS all_b FROM children GROUP BY ALL),
        compared AS (SELECT host, above, here, n, all_n - n AS rest, abs(b / greatest(n, 1) - (all_b - b) / greatest(all_n - n, 1)) AS gap, all_b / greatest(all_n, 1) AS share FROM children JOIN siblings USING (host, above)),
        told AS (SELECT host, above, here, n, b, n < {_T.own} AND (n = 0 OR rest = 0 OR gap <= {_T.merge_z}::DOUBLE * sqrt(share * (1 - share) * (1.0::DOUBLE / greatest(n, 1) + 1.0::DOUBLE / greatest(rest, 1)))) AS pool FROM compared JOIN (SELECT host, above, here, b FROM children) USING (host, above, here)),
        celled AS (SELECT host, above, here, n, b, (1000 * b // greatest(n, 1))::BIGINT AS cell FROM told WHERE NOT pool),
        cells AS (SELECT host, above, cell, sum(n)::BIGINT AS n, sum(b)::BIGINT AS b, count(*) AS children FROM celled GROUP BY ALL),
        runs AS (
            SELECT host, above, list_reduce(list({{'n': n, 'b': b, 'starts': [cell]}} ORDER BY cell), lambda r, x:
                CASE WHEN abs(x.b / greatest(x.n, 1) - r.b / greatest(r.n, 1)) <= {_T.merge_z}::DOUBLE * sqrt((x.b + r.b) / greatest(greatest(x.n, 1) + greatest(r.n, 1), 1) * (1 - (x.b + r.b) / greatest(greatest(x.n, 1) + greatest(r.n, 1), 1)) * (1.0::DOUBLE / greatest(x.n, 1) + 1.0::DOUBLE / greatest(r.n, 1)))
                THEN {{'n': r.n + x.n, 'b': r.b + x.b, 'starts': r.starts}} ELSE {{'n': x.n, 'b': x.b, 'starts': list_concat(r.starts, x.starts)}} END).starts AS starts
            FROM cells GROUP BY ALL
        ),
        parts AS (SELECT host, above, cell, children, len(list_filter(starts, lambda s: s <= cell)) AS run FROM cells JOIN runs USING (host, above)),
        met AS (SELECT host, above, cell, run FROM (SELECT *, sum(children) OVER (PARTITION BY host, above, run) AS members FROM parts) WHERE members > 1),
        renamed AS (SELECT host, above, here, '*' AS segment FROM told WHERE pool UNION ALL SELECT host, above, here, '*' || run FROM celled JOIN met USING (host, above, cell))
        SELECT level + 1, host, template, CASE WHEN segment IS NOT NULL THEN list_concat(node[1:level], [segment], node[level + 2:]) ELSE node END, labelled, bad FROM placed LEFT JOIN renamed USING (host, above, here)
    )
),
nodes AS (SELECT * FROM step WHERE level = (SELECT depth FROM deepest)),
leaves AS (SELECT host, node, sum(labelled) AS n, sum(bad) AS b FROM nodes GROUP BY ALL),
hosts AS (SELECT host, (sum(b) + {_T.prior}::DOUBLE * (SELECT coalesce(sum(b) / nullif(sum(n), 0), 0) FROM leaves)) / (sum(n) + {_T.prior}::DOUBLE) AS share FROM leaves GROUP BY 1),
judged AS (SELECT l.host, node, (b + {_T.prior}::DOUBLE * share) / (n + {_T.prior}::DOUBLE) >= {_T.reject}::DOUBLE AS reject FROM leaves l JOIN hosts USING (host))
SELECT c.page_id, c.host, c.path, {_RULE.replace("host", "c.host").replace("path", "c.path")} AS rule,
    coalesce({_SAYS.replace("host", "c.host").replace("path", "c.path")}, CASE WHEN reject THEN 'block' ELSE 'allow' END) AS verdict
FROM cut c JOIN nodes n ON n.host = c.host AND n.template = c.template JOIN judged j ON j.host = n.host AND j.node = n.node
"""

OP9 = r"""
WITH lines AS (
    SELECT doc_id, i - 1 AS line, list_filter(regexp_split_to_array(l[i], '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)
),
firsts AS (SELECT w, min((doc_id, line)) AS first FROM lines WHERE len(w) > 0 GROUP BY 1),
variants AS (
    SELECT w, first, -1 AS place, array_to_string(w, ' ') AS v FROM firsts WHERE len(w) >= 8
    UNION ALL SELECT w, first, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') FROM (SELECT w, first, unnest(range(1, len(w) + 1)) AS i FROM firsts WHERE len(w) >= 8)
),
near AS (SELECT DISTINCT a.w FROM variants a JOIN variants b ON a.v = b.v AND (a.place = b.place OR a.place = -1 OR b.place = -1) AND b.first < a.first),
gone AS (
    SELECT doc_id, count(*) AS n, string_agg(line, ',' ORDER BY line) AS numbers FROM lines JOIN firsts USING (w)
    WHERE (doc_id, line) <> first OR w IN (SELECT w FROM near) GROUP BY 1
)
SELECT doc_id, coalesce(n, 0) AS n_removed, coalesce(numbers, '') AS removed FROM documents LEFT JOIN gone USING (doc_id)
"""

_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || {0}, '-')"
_HEAD = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_SMALL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _tree(name: str, leaves: str) -> str:
    """Nodes (tree, level, place, h, n) over leaves (tree, place, h, n): eight neighbours make one."""
    return f"""{name} AS (
    SELECT 0 AS level, tree, place, h, n FROM {leaves}
    UNION ALL SELECT level + 1, tree, place // 8, sha256(string_agg(h, '' ORDER BY place)), n FROM {name} WHERE n > 8 ** level GROUP BY level, tree, place // 8, n
)"""


_ROOT = "place = 0 AND n <= 8 ** level AND (level = 0 OR n > 8 ** (level - 1))"

OP11 = f"""
WITH RECURSIVE crcs AS (
    SELECT doc_id, xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT),
        lambda a, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(a, b)), 4294967295::BIGINT)) AS crc FROM (SELECT DISTINCT doc_id FROM documents)
),
docs AS (
    SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({_HEAD} || {_FIELD.format("text")}) AS leaf,
        CASE WHEN crc % 3 = 0 THEN sha256({_HEAD} || {_FIELD.format(_SMALL.format("text"))}) END AS tampered FROM documents LEFT JOIN crcs USING (doc_id)
),
leaves AS (SELECT *, leaf AS h, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n, row_number() OVER () AS k FROM docs),
{_tree("nodes", "leaves")},
subroots AS (SELECT 0 AS tree, tree AS below, h, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE {_ROOT}),
{_tree("above", "subroots")},
steps AS (
    SELECT k, t.level, t.place, l.place // (8 ** t.level)::BIGINT AS own, t.h FROM leaves l JOIN nodes t ON t.tree = l.tree AND t.n > 8 ** t.level AND t.place // 8 = l.place // (8 ** (t.level + 1))::BIGINT
    UNION ALL
    SELECT k, 100 + t.level, t.place, r.place // (8 ** t.level)::BIGINT, t.h FROM leaves l JOIN subroots r ON r.below = l.tree JOIN above t ON t.n > 8 ** t.level AND t.place // 8 = r.place // (8 ** (t.level + 1))::BIGINT
),
sides AS (
    SELECT k, row_number() OVER (PARTITION BY k ORDER BY level) AS step, coalesce(string_agg(h, '' ORDER BY place) FILTER (place < own), '') AS l, coalesce(string_agg(h, '' ORDER BY place) FILTER (place > own), '') AS r
    FROM steps GROUP BY k, level
),
fold AS (SELECT k, 0 AS step, coalesce(tampered, leaf) AS h FROM leaves UNION ALL SELECT f.k, f.step + 1, sha256(s.l || f.h || s.r) FROM fold f JOIN sides s ON s.k = f.k AND s.step = f.step + 1),
ends AS (SELECT k, arg_max(h, step) AS folded_root FROM fold GROUP BY 1),
proofs AS (SELECT k, string_agg(l || r, '' ORDER BY step) AS proof FROM sides GROUP BY 1)
SELECT doc_id, leaf, s.h AS subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves d JOIN subroots s ON s.below = d.tree JOIN ends USING (k) LEFT JOIN proofs USING (k), (SELECT h AS root FROM above WHERE {_ROOT})
"""

OP12 = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_SMALL.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
),
found AS (SELECT k, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS all_n FROM found GROUP BY ALL HAVING count(DISTINCT k) >= 3),
counts AS (SELECT lang, source, term, count(*) AS n FROM found SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(all_n)::HUGEINT AS total FROM kept GROUP BY 1),
sizes AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS own FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
shares AS (
    SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (own + v) AS p, 1 + (1000000000::HUGEINT * (all_n + 1)) // (total + v) AS q
    FROM sizes JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)
),
sums AS (SELECT lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS s FROM shares a JOIN shares b USING (lang, term) GROUP BY ALL),
pairs AS (SELECT lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s, 0) AS BIGINT) AS "value" FROM groups a JOIN groups b USING (lang) LEFT JOIN sums x USING (lang) WHERE a.source <> b.source AND (x.lang IS NULL OR (x.source = a.source AND x.item = b.source))),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS "value" FROM shares WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY "value" DESC, item) AS INTEGER) AS rank FROM (FROM pairs UNION ALL FROM terms) QUALIFY part = 'pair' OR rank <= 200
"""

OP13 = r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents) WINDOW w AS (PARTITION BY t)
"""

ORACLES: dict[str, str] = {"op1_ngram_join": OP1, "op4_quality_rules": OP4, "op8_url_filter": OP8, "op9_line_dedup": OP9, "op11_merkle_manifest": OP11, "op12_source_divergence": OP12, "op13_exact_dedup": OP13}
