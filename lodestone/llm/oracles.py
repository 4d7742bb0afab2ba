"""DuckDB SQL that states what the queries return."""

from __future__ import annotations

from lodestone.llm.licences import ANCHORS, RULES, SENTENCES, known

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def licences() -> str:
    """Known sentences found by their words, wherever lines end; then one step per ordered rule.

    Written on its own terms: words are numbered, a sentence is joined by its first three words, and
    its first and last word must stand at cuts (line ends, or blanks behind a stop).
    """
    rows = ", ".join(f"({_text(k)}, {_text(v)})" for k, v in known(SENTENCES).items())
    may = " OR ".join(f"contains(lower(text), {_text(a)})" for a in ANCHORS if " " not in a)
    sql = [
        f"WITH book AS (SELECT words, id, array_to_string(words[1:3], ' ') AS lead FROM (SELECT string_split(sentence, ' ') AS words, id FROM (VALUES {rows}) b(sentence, id)))",
        "docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents)",
        r"""bare AS (SELECT r, regexp_replace(replace(lower(text), '|', ','), '(^|\n)([^a-z0-9\n]*)@?(dnl|rem)([ \t\r\n]|$)', '\1\2\4', 'g') AS t FROM docs WHERE """ + may + ")",
        r"""tokens AS (SELECT r, list_filter(regexp_extract_all(regexp_replace(regexp_replace(t, '([.!?:;])[ \t\r\n]+', ' | ', 'g'), '\n', ' | ', 'g'), '[a-z0-9]+|\|'), lambda x: x <> '') AS k FROM bare)""",
        "places AS (SELECT r, k, unnest(range(1, len(k) + 1)) AS p FROM tokens)",
        "words AS (SELECT r, p, k[p] AS word, p = 1 OR k[p - 1] = '|' AS opens, row_number() OVER (PARTITION BY r ORDER BY p) AS i FROM places WHERE k[p] <> '|')",
        "line AS (SELECT r, list(word ORDER BY i) AS w, list(opens ORDER BY i) AS o FROM words GROUP BY r)",
        "starts AS (SELECT r, i, w, o, array_to_string(w[i:i + 2], ' ') AS lead FROM (SELECT r, w, o, unnest(range(1, len(w) + 1)) AS i FROM line) WHERE o[i])",
        "found AS (SELECT r, i, i + len(words) AS stop, id FROM starts JOIN book USING (lead) WHERE w[i:i + len(words) - 1] = words AND (i + len(words) > len(w) OR o[i + len(words)]))",
        "one AS (SELECT r, i, id FROM found f WHERE NOT EXISTS (SELECT 1 FROM found g WHERE g.r = f.r AND g.i <= f.i AND g.stop >= f.stop AND g.stop - g.i > f.stop - f.i))",
        "seq AS (SELECT r, count(*) AS n, string_agg(id, ' ' ORDER BY i) AS ids, ' ' || string_agg(id, '  ' ORDER BY i) || ' ' AS rest FROM one GROUP BY r)",
    ]
    # one row a rule, in order, applied by recursion
    ordered = ", ".join(f"({i}, {_text(name)}, {_text(' ' + '  '.join(names) + ' ')})" for i, (name, names) in enumerate(RULES))
    sql += [
        f"rules(k, licence, want) AS (VALUES {ordered})",
        "steps(r, k, n, ids, rest, took) AS (SELECT r, 0, n, ids, rest, [] :: VARCHAR[] FROM seq UNION ALL "
        "SELECT s.r, s.k + 1, s.n, s.ids, replace(s.rest, u.want, ' | '), CASE WHEN contains(s.rest, u.want) AND NOT list_contains(s.took, u.licence) THEN list_append(s.took, u.licence) ELSE s.took END FROM steps s JOIN rules u ON u.k = s.k)",
        f"done AS (SELECT * FROM steps WHERE k = {len(RULES)})",
    ]
    return ", ".join(sql).replace("WITH ", "WITH RECURSIVE ", 1) + (
        " SELECT doc_id, coalesce(n, 0) AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(array_to_string(took, ' '), '') AS licences, "
        "coalesce(trim(regexp_replace(replace(rest, '|', ' '), ' +', ' ', 'g')), '') AS left_over FROM docs LEFT JOIN done USING (r)"
    )


DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, {AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM b WHERE len(w) > 0)
),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
found AS (
  SELECT doc_id, p, n, item_id
  FROM (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS words FROM places, (SELECT DISTINCT n FROM windows) WHERE p + n - 1 <= len(w))
  JOIN windows USING (n, words)
),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id :: VARCHAR AS i FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) :: BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) :: BIGINT AS size, substr(md5(coalesce(doc_id :: VARCHAR, '')), 1, 9) AS h FROM documents
),
by_source AS (SELECT source, sum(size) :: BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, ([5.0, 2.0, 1.0] :: DOUBLE[])[((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3) + 1] AS weight, 3.0 :: DOUBLE * source_size AS most FROM by_source),
reached AS (SELECT *, most / weight AS reach FROM weighed),
levels AS (
  SELECT *, ((sum(source_size) OVER ()) :: DOUBLE - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS raw
  FROM reached WINDOW o AS (ORDER BY reach, source IS NULL, source)
),
level AS (SELECT first(raw ORDER BY reach, source IS NULL, source) AS level FROM levels WHERE raw < reach),
goals AS (
  SELECT l.source, l.source_size,
         CASE WHEN v.level IS NULL OR l.raw >= l.reach AND NOT EXISTS (
                SELECT 1 FROM levels e WHERE e.raw < e.reach AND (e.reach, e.source IS NULL, e.source) < (l.reach, l.source IS NULL, l.source))
              THEN l.most ELSE least(v.level * l.weight, l.most) END AS target
  FROM levels l, level v
),
budget AS (SELECT *, target - floor(target / greatest(source_size, 1)) * source_size AS rest FROM goals),
bars AS (SELECT source, h, sum(size) AS bar FROM sized WHERE size > 0 GROUP BY source, h),
running AS (SELECT *, sum(bar) OVER (PARTITION BY source ORDER BY h) AS upto FROM bars),
edge AS (
  SELECT g.source, r.h AS cut, r.bar - (g.rest - r.upto + r.bar) <= g.rest - r.upto + r.bar AS keep_cut
  FROM running r JOIN budget g ON r.source IS NOT DISTINCT FROM g.source WHERE r.upto > g.rest AND r.upto - r.bar <= g.rest
),
copied AS (
  SELECT s.doc_id, s.size, g.source_size, g.target,
         (floor(g.target / greatest(g.source_size, 1)) :: BIGINT + (coalesce(s.h < e.cut OR (s.h = e.cut AND e.keep_cut), false)) :: BIGINT) AS copies
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source LEFT JOIN edge e ON s.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, copies, size * copies AS taken FROM copied
"""

JOIN = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT s.a, s.b FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b WHERE 100 * o >= 75 * (x.n + y.n - o)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON least.a = d.doc_id
"""

DIVERGENCE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
grid AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
p AS (
  SELECT lang, source, term, n, (1 + (1000000000 * (n + 5) :: HUGEINT) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v)) :: BIGINT AS p,
         (1 + (1000000000 * (sum(n) OVER (PARTITION BY lang, term) + 5) :: HUGEINT) // (sum(n) OVER (PARTITION BY lang) + 5 * v)) :: BIGINT AS q
  FROM grid JOIN v USING (lang)
),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) :: BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(x.value, 0) AS value
  FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source LEFT JOIN apart x ON x.lang = g.lang AND x.source = g.source AND x.item = o.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank :: INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
WHERE part = 'pair' OR rank <= 50
"""

DOMINANCE = """
WITH bytes AS (SELECT sale_id, list_transform(range(1, length(CAST(sale_id AS VARCHAR)) + 1), lambda i: ascii(substr(CAST(sale_id AS VARCHAR), i :: INT, 1)) :: BIGINT) AS b FROM (SELECT DISTINCT sale_id FROM sales)),
crc AS (
  SELECT sale_id, CASE WHEN sale_id IS NULL THEN 0 ELSE xor(list_reduce(b, lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda t, i: CASE WHEN t % 2 = 1 THEN xor(t >> 1, 3988292384) ELSE t >> 1 END), 4294967295 :: BIGINT), 4294967295) END AS c
  FROM bytes
),
keyed AS (
  SELECT s.sale_id, date_diff('day', DATE '1970-01-01', s.sold_at :: DATE) * 24 + extract('hour' FROM s.sold_at) AS slot,
         floor(floor(100 * s.total + 0.5) / 100) :: BIGINT AS level, 1 + c % 2 AS w
  FROM sales s JOIN crc ON crc.sale_id IS NOT DISTINCT FROM s.sale_id
),
entries AS (SELECT slot, level, count(*) AS n, sum(w) :: BIGINT AS w FROM keyed WHERE slot IS NOT NULL AND level IS NOT NULL GROUP BY slot, level),
above AS (
  SELECT a.slot, a.level, coalesce(sum(b.n), 0) :: BIGINT AS n_sales, coalesce(sum(b.w), 0) :: BIGINT AS n_rows
  FROM entries a LEFT JOIN entries b ON b.slot <= a.slot AND b.level > a.level GROUP BY ALL
)
SELECT k.sale_id, k.slot :: BIGINT AS slot, k.level, n_sales, n_rows FROM keyed k LEFT JOIN above USING (slot, level)
"""
