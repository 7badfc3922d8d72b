"""SQL counterparts of the queries that SQL can express."""

from __future__ import annotations

from firmweave.llm.chat import CONTROLS, END, PLANTED, SEP, TRAINED_ROLE, TURN

ORACLES: dict[str, str] = {}

ORACLES["op1_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), sources AS (
  SELECT source, sum(size)::HUGEINT AS s,
         (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w
  FROM sized GROUP BY source
), ranked AS (
  SELECT *,
         sum(s) OVER () - 3 * coalesce(sum(s) OVER before, 0) AS left_words,
         sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS left_weight
  FROM sources
  WINDOW before AS (ORDER BY s / w, source ASC NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), held AS (
  SELECT *, 3 * s * left_weight <= left_words * w AS at_cap FROM ranked
), targets AS (
  SELECT source, s,
         CASE WHEN at_cap THEN (3 * s)::DOUBLE
              ELSE w * max(CASE WHEN NOT at_cap THEN left_words::DOUBLE / left_weight::DOUBLE END)
                       OVER () END AS target
  FROM held
), rates AS (
  SELECT *, CASE WHEN s > 0 THEN least(target / s::DOUBLE, 3.0) ELSE 0 END AS rate FROM targets
)
SELECT doc_id, size, s::BIGINT AS source_size, target,
       (size * copies)::BIGINT AS taken, copies
FROM (
  SELECT d.doc_id, d.size, r.s, r.target,
         (floor(r.rate)::BIGINT
          + CASE WHEN ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE
                      / 4503599627370496.0 < r.rate - floor(r.rate) THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
)
"""

ORACLES["op9_warc"] = """
WITH typed AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), firsts AS (
  SELECT *, CASE WHEN payload_bytes >= 100
                 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id
  FROM typed
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id
            THEN first_id END AS refers_to
FROM firsts
"""

# All links by counting shared shingles, then the smallest id reachable over them.
ORACLES["op10_ngram_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), grams AS (
  SELECT DISTINCT doc_id,
         unnest(CASE WHEN len(w) >= 5
                     THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                     WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * met >= 80 * (x.n + y.n - met)
), edges AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reached AS (
  SELECT doc_id AS node, doc_id AS other FROM documents WHERE doc_id IS NOT NULL
  UNION
  SELECT r.node, e.b FROM reached r JOIN edges e ON e.a = r.other
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes USING (doc_id)
LEFT JOIN (SELECT node, min(other) AS component_id FROM reached GROUP BY node) c ON c.node = d.doc_id
"""


def _centroid_rounds(count: int, rounds: int, dim: int, seed: int) -> str:
    """All distances measured in every round; the rounds are written one after the other."""
    near = """
, n{r} AS (
  SELECT row, min(struct_pack(d := d, k := k)) AS b FROM (
    SELECT v.row, c.k, sum((v.x - c.x) * (v.x - c.x)) AS d
    FROM v JOIN c{r} c USING (i) GROUP BY v.row, c.k) GROUP BY row
)"""
    update = """
, c{s} AS MATERIALIZED (
  SELECT c.k, c.i, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.x) AS x
  FROM c{r} c LEFT JOIN (
    SELECT n.b.k AS k, v.i, sum(v.x) AS s, count(*) AS n FROM v JOIN n{r} n USING (row) GROUP BY 1, 2
  ) m ON m.k = c.k AND m.i = c.i
)"""
    steps = "".join(near.format(r=r) + update.format(r=r, s=r + 1) for r in range(rounds))
    return f"""
WITH kept AS (
  SELECT vec_id, embedding, row_number() OVER () AS row FROM embeddings
  WHERE len(embedding) = {dim}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}
), v AS MATERIALIZED (
  SELECT row, i, floor(1024 * embedding[i]::DOUBLE)::HUGEINT AS x
  FROM kept, range(1, {dim + 1}) AS t(i)
), c0 AS MATERIALIZED (
  SELECT k, i, x FROM v JOIN (
    SELECT row, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR), embedding) - 1 AS k
    FROM kept WHERE vec_id IS NOT NULL QUALIFY k < {count}) USING (row)
){steps}{near.format(r=rounds)}
, shown AS (
  SELECT k, sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY k
)
SELECT vec_id, n.b.k::INTEGER AS cluster, n.b.d::BIGINT AS distance,
       (sum(n.b.d) OVER (PARTITION BY n.b.k))::BIGINT AS cluster_inertia,
       (sum(n.b.d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
FROM n{rounds} n JOIN kept USING (row) JOIN shown ON shown.k = n.b.k
"""


ORACLES["op11_centroid_search"] = _centroid_rounds(8, 10, 64, 3)


def _merkle(fanout: int, levels: int, top_levels: int) -> str:
    """The levels are written one after the other; ``fanout`` ** ``levels`` leaves a group at most."""

    def field(column: str) -> str:
        return f"coalesce(octet_length(encode({column}::VARCHAR))::VARCHAR || ':' || {column}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"

    def climb(name: str, count: int) -> str:
        return "".join(f"""
, {name}{k + 1} AS MATERIALIZED (
  SELECT grp, idx // {fanout} AS idx, sha256(string_agg(h, '' ORDER BY idx)) AS h,
         (max(n) + {fanout - 1}) // {fanout} AS n
  FROM {name}{k} WHERE n > 1 GROUP BY grp, idx // {fanout}
), {name}_by{k} AS (
  SELECT a.grp, a.idx,
         coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM {name}{k} a JOIN {name}{k} b
    ON a.grp = b.grp AND a.idx // {fanout} = b.idx // {fanout} WHERE a.n > 1 GROUP BY a.grp, a.idx
)""" for k in range(count))

    def folded(name: str, count: int, start: str, place: str) -> str:
        """Joins and folded expressions over the levels of a tree."""
        return "".join(f"""
, {start}{k + 1} AS (
  SELECT p.* EXCLUDE (f, proof), CASE WHEN b.grp IS NULL THEN f ELSE sha256(l || f || r) END AS f,
         CASE WHEN b.grp IS NULL THEN proof ELSE proof || l || r END AS proof
  FROM {start}{k} p LEFT JOIN {name}_by{k} b
    ON b.grp = p.{place.format('grp')} AND b.idx = p.{place.format('idx')} // {fanout ** k}
)""" for k in range(count))

    def union(name: str, count: int) -> str:
        return " UNION ALL ".join(f"SELECT grp, h FROM {name}{k} WHERE n = 1" for k in range(count + 1))

    return f"""
WITH RECURSIVE bits AS (
  SELECT i, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT i, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM bits WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8
), rows AS (
  SELECT *, xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT),
                lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295) AS crc,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered
  FROM documents, crc
), leaves AS (
  SELECT coalesce('=' || lang, '') AS grp, doc_id, {leaf('text')} AS h,
         CASE WHEN crc % 3 = 0 THEN {leaf('lowered')} END AS changed
  FROM rows
), n0 AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS idx,
         count(*) OVER (PARTITION BY grp) AS n
  FROM leaves
){climb('n', levels)}
, subroots AS ({union('n', levels)}), t0 AS MATERIALIZED (
  SELECT '' AS grp, grp AS name, h, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n
  FROM subroots
){climb('t', top_levels)}
, tops AS ({union('t', top_levels)}), p0 AS (
  SELECT n0.grp, n0.idx, doc_id, n0.h AS leaf, t0.h AS subroot, '' AS tgrp, t0.idx AS tidx,
         coalesce(changed, n0.h) AS f, '' AS proof
  FROM n0 JOIN t0 ON t0.name = n0.grp
){folded('n', levels, 'p', '{}')}
, q0 AS (SELECT * FROM p{levels}){folded('t', top_levels, 'q', 't{}')}
SELECT doc_id, leaf, subroot, tops.h AS root, sha256(proof) AS proof_sha256,
       f AS folded_root, f = tops.h AS verified
FROM q{top_levels}, tops
"""


ORACLES["op12_merkle_manifest"] = _merkle(8, 6, 2)


def _chat() -> str:
    def escaped(column: str) -> str:
        out = f"replace({column}, '\\', '\\\\')"
        for c in CONTROLS:
            out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
        return out

    marks = len(TURN + SEP + END)
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}')
), keyed AS (
  SELECT *, sha256(octet_length(encode(role))::VARCHAR || ':' || role || text) AS digest,
         length({escaped('role')}) + length({escaped('text')}) + {marks} AS size
  FROM turns
), whole AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns, sum(size)::BIGINT AS formatted_chars,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, digest) AS t,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, digest)
                  FILTER (role = '{TRAINED_ROLE}'), '') AS learnt
  FROM keyed GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(t) AS turns_sha256, length(learnt)::BIGINT AS loss_chars,
       sha256(learnt) AS loss_sha256, formatted_chars
FROM whole
"""


ORACLES["op13_chat_prefix_tree"] = _chat()
