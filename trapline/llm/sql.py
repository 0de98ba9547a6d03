"""DuckDB SQL of the queries that SQL can express."""

from trapline.llm.mixing import PARTS, REPEATS
from trapline.llm.sharding import ROUNDS

ORACLES: dict[str, str] = {}

ORACLES["op1_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
sound AS (
  SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e)
    / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links,
  (SELECT min(b) FROM reach r WHERE r.a = v.vec_id) AS component_id,
  (SELECT min(b) FROM reach r WHERE r.a = v.vec_id) = v.vec_id AS kept
FROM v"""


def _draw(*parts: str) -> str:
    text = ", ':', ".join(parts)
    return f"('0x' || md5(concat({text}))[1:4])::BIGINT / 65536e0"


ORACLES["op2_mixing"] = f"""
WITH d AS (
  SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    {_draw("'mix'", "coalesce(doc_id::VARCHAR, '')")} AS draw FROM documents),
c AS (SELECT *, length(bin(size)) * 1000 + (bin(size)[1:3])::INT AS class,
        floor(draw * {PARTS})::INT AS part FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
        WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
l AS (SELECT *, source_size / weight::DOUBLE AS bound,
        (sum(source_size) OVER () - {REPEATS} * coalesce(sum(source_size) OVER before, 0))::DOUBLE
        / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level FROM w
      WINDOW before AS (ORDER BY source_size / weight::DOUBLE, source NULLS LAST
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT level FROM l WHERE level * weight <= {REPEATS} * source_size
      ORDER BY bound, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size,
        least(f.level * weight, ({REPEATS} * source_size)::DOUBLE) AS target,
        {_draw("'mix'", "'offset'", "coalesce(concat('=', source), '')")} AS u FROM l, f),
p AS (SELECT c.*, t.source_size, t.target, t.u,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
        row_number() OVER (PARTITION BY c.source ORDER BY class, part, size, draw, doc_id) AS i
      FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (floor(i * rate + u) - floor((i - 1) * rate + u)))::BIGINT AS taken FROM p"""

ORACLES["op3_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
             sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100
      GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)"""

ORACLES["op4_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
           FROM embeddings WHERE len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank
      FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


def jaccard(words: int, percent: int, source: str = "documents") -> str:
    """Components of documents whose shingle sets share ``percent`` of their union; the last
    relation is called ``joined``."""
    return f"""
w AS (SELECT doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x20\\x09-\\x0D]+') AS ws FROM {source}),
g AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {words}
        THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(
          range(1, len(ws) - {words - 2}), lambda i: array_to_string(ws[i:i + {words - 1}], ' '))) END)
        AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
often AS (SELECT gram FROM g GROUP BY gram HAVING count(*) > 1),
h AS (SELECT doc_id, gram FROM g JOIN often USING (gram)),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM h a JOIN h b
      ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
one AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
        WHERE 100 * i >= {percent} * (x.n + y.n - i)),
links AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one),
reach AS (SELECT DISTINCT a, a AS b FROM links
          UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
joined AS (SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles,
             coalesce(m.component_id, d.doc_id) AS component_id
           FROM {source} d LEFT JOIN n USING (doc_id)
           LEFT JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) m
             USING (doc_id))"""


ORACLES["op5_ngram_join"] = f"WITH RECURSIVE {jaccard(3, 90)}\nSELECT * FROM joined"


def _rounds() -> str:
    """Feistel rounds as nested selects over the columns x, a, b."""
    body = "SELECT *, x % a AS l0, x // a AS r0 FROM start"
    for k in range(ROUNDS):
        left, right = f"l{k}", f"r{k}"
        other, side = (right, "a") if k % 2 == 0 else (left, "b")
        moved = left if k % 2 == 0 else right
        drawn = f"('0x' || md5(concat('7.{k}:', {other}))[1:15])::BIGINT"
        new = f"({moved} + {drawn}) % {side}"
        l_new, r_new = (new, right) if k % 2 == 0 else (left, new)
        body = f"SELECT *, {l_new} AS l{k + 1}, {r_new} AS r{k + 1} FROM ({body})"
    return body


# the checksum byte by byte, from a table of the remainders of the 256 bytes
ORACLES["op7_sharding"] = f"""
WITH RECURSIVE bytes AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1
    THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, v) ORDER BY v) AS t
  FROM (SELECT unnest(range(256)) AS v)),
d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 8 AS size,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
        lambda h: ('0x' || h)::BIGINT), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]),
      4294967295), 4294967295)::BIGINT AS text_crc32 FROM documents, bytes),
c AS (SELECT count(*) AS n FROM d),
sides AS (SELECT n, a, (n + a - 1) // a AS b FROM c, (SELECT unnest(range(1, (
            SELECT ceil(sqrt(n))::BIGINT + 1 FROM c))) AS a)
          WHERE a >= greatest(1, ceil(sqrt(n))::BIGINT // 2)
          ORDER BY a * ((n + a - 1) // a) - n, a DESC LIMIT 1),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id, size, text_crc32) - 1 AS g FROM d),
walk AS (
  SELECT g, g AS x, n, a, b, 0 AS step FROM numbered, sides
  UNION ALL
  SELECT g, r{ROUNDS} * a + l{ROUNDS}, n, a, b, step + 1 FROM (
    WITH start AS (SELECT * FROM walk WHERE step = 0 OR x >= n) {_rounds()})),
placed AS (SELECT g, arg_max(x, step) AS p FROM walk GROUP BY g)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p % 24)::INT AS shard,
  p // 24 AS slot, NULL::INT AS grown_shard
FROM numbered JOIN placed USING (g)"""


# a cell is the set of filters that a document fails, a letter each
ORACLES["op11_filter_audit"] = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (SELECT part, doc_id, concat(
        CASE WHEN len(words) < 50 THEN 'A' ELSE '' END,
        CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END,
        CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text)
          THEN 'C' ELSE '' END,
        CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END,
        CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS cell
      FROM t),
c AS (SELECT part, cell, count(*) AS n, count(*) FILTER (good) AS good,
        count(*) FILTER (toxic) AS toxic
      FROM f LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic
                        FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY part, cell),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
      FROM l a, l b, l c, l d, l e
      WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
s AS (SELECT filter_order, step::INT AS step, filter_order[step:step] AS own,
        CASE WHEN step = 1 THEN '0' ELSE filter_order[1:step - 1] END AS before
      FROM o, (SELECT unnest(range(1, 6)) AS step)),
h AS (SELECT *, contains(cell, own) AS fails,
        len(list_intersect(string_split(cell, ''), string_split(before, ''))) > 0 AS gone
      FROM c, s),
r AS (SELECT part, filter_order, step, own,
        sum(CASE WHEN fails OR gone THEN 0 ELSE n END)::BIGINT AS kept,
        sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN cell = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM h GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r"""

#: Remainders of the 256 bytes, and from them the checksum of the bytes of an expression.
CRC_TABLE = """(SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1
    THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, v) ORDER BY v) AS t
  FROM (SELECT unnest(range(256)) AS v))"""


def _crc32(value: str) -> str:
    return f"""xor(list_reduce(list_transform(regexp_extract_all(hex(encode({value})), '..'),
        lambda h: ('0x' || h)::BIGINT), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]),
      4294967295), 4294967295)"""


def _discounts(level: str) -> str:
    """Discounts d1 to d3 from the counts of counts n1 to n4 of a relation."""
    y = "(n1 / (n1 + 2 * n2)::DOUBLE)"
    return f"""
d_{level} AS (SELECT CASE WHEN good THEN a ELSE 0.5e0 END AS d1, CASE WHEN good THEN b ELSE 1e0 END AS d2,
    CASE WHEN good THEN c ELSE 1.5e0 END AS d3
  FROM (SELECT a, b, c, coalesce(least(n1, n2, n3, n4) > 0 AND a BETWEEN 0 AND 1
          AND b BETWEEN 0 AND 2 AND c BETWEEN 0 AND 3, FALSE) AS good
        FROM (SELECT n1, n2, n3, n4, 1 - 2 * {y} * n2 / n1 AS a, 2 - 3 * {y} * n3 / n2 AS b,
                3 - 4 * {y} * n4 / n3 AS c
              FROM (SELECT {", ".join(f"count(*) FILTER (n = {k}) AS n{k}" for k in range(1, 5))}
                    FROM {level}))))"""


# ' ' is the end token and '  ' the begin token; no word holds a space
ORACLES["op12_lm_scoring"] = f"""
WITH d AS (SELECT doc_id, {_crc32("doc_id::VARCHAR")}::BIGINT % 5 = 1 AS held_out,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
           FROM documents, {CRC_TABLE}),
t AS (SELECT doc_id, held_out, unnest(list_append(words, ' ')) AS w,
        unnest(list_prepend('  ', words)) AS v FROM d),
words AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
size AS (SELECT coalesce(sum(c), 0)::BIGINT AS total, count(*) AS kinds FROM words),
pairs AS (SELECT v, w, count(*) AS n FROM t WHERE NOT held_out GROUP BY v, w),
singles AS (SELECT w, count(*) AS n FROM pairs GROUP BY w),
{_discounts("pairs")},
{_discounts("singles")},
contexts AS (SELECT v, sum(n) AS whole, sum(CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END) AS rest
             FROM pairs, d_pairs GROUP BY v),
root AS (SELECT sum(n) AS whole, sum(CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END) AS rest
         FROM singles, d_singles),
p AS (SELECT t.doc_id, t.held_out, c.c, coalesce(c.c, 0) AS known, total, kinds,
        (coalesce(s.n - CASE s.n WHEN 1 THEN e.d1 WHEN 2 THEN e.d2 ELSE e.d3 END, 0)
          + root.rest / (kinds + 1)) / root.whole AS single,
        coalesce(g.n - CASE g.n WHEN 1 THEN f.d1 WHEN 2 THEN f.d2 ELSE f.d3 END, 0) AS seen,
        x.whole, x.rest
      FROM t CROSS JOIN size CROSS JOIN root CROSS JOIN d_singles e CROSS JOIN d_pairs f
      LEFT JOIN words c USING (w) LEFT JOIN singles s USING (w) LEFT JOIN contexts x USING (v)
      LEFT JOIN pairs g ON g.v = t.v AND g.w = t.w)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, total AS train_tokens,
  round(sum(log10((known + 0.5e0) / (total + 0.5e0 * (kinds + 1)))), 6) AS base_score,
  round(sum(log10(CASE WHEN whole IS NULL THEN single ELSE (seen + rest * single) / whole END)), 6)
    AS score
FROM p GROUP BY doc_id, held_out, total"""

ORACLES["op13_infill"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
             regexp_extract_all(coalesce(text, ''),
               '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents),
u AS (SELECT doc_id, text, units, len(units)::BIGINT AS n,
        ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS x,
        ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS y,
        ('0x' || h[17:24])::BIGINT % 100 AS cut, ('0x' || h[25:32])::BIGINT % 100 AS swap FROM d),
p AS (SELECT doc_id, n, text,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>')
          OR contains(text, '<M>') OR cut >= 50 THEN 'plain'
          WHEN swap < 80 THEN 'spm' ELSE 'psm' END AS form,
        array_to_string(list_slice(units, 1, least(x, y)), '') AS prefix,
        array_to_string(list_slice(units, least(x, y) + 1, greatest(x, y)), '') AS middle,
        array_to_string(list_slice(units, greatest(x, y) + 1, n), '') AS suffix FROM u)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM p"""
