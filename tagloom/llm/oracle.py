"""The operators whose rows SQL determines, as DuckDB SQL over the same tables."""

from __future__ import annotations

from tagloom.llm.hostfilter import LEAST_BAD, RULES, STRONGEST, TWO_LABEL_SUFFIXES, WEAKEST, Z

def _codes_sql(rounds: int) -> str:
    """Product codes; squared distances of integers are exact in doubles."""
    assign = """
a{r} AS MATERIALIZED (
    SELECT p.vec_id, p.part, min(
        (list_inner_product(p.v, p.v) + list_inner_product(b.v, b.v)
         - 2 * list_inner_product(p.v, b.v))::HUGEINT * 256 + b.idx) AS best
    FROM parts p JOIN b{r} b ON b.part = p.part GROUP BY p.vec_id, p.part
)"""
    move = """
m{r} AS (
    SELECT part, idx, list(m ORDER BY pos) AS v FROM (
        SELECT p.part, a.best % 256 AS idx, t.pos,
               floor(sum(p.v[t.pos])::DOUBLE / count(*)) AS m
        FROM a{r} a JOIN parts p ON p.vec_id = a.vec_id AND p.part = a.part,
             unnest(range(1, len(p.v) + 1)) AS t(pos)
        GROUP BY 1, 2, 3) GROUP BY part, idx
),
b{s} AS MATERIALIZED (
    SELECT b.part, b.idx, coalesce(m.v, b.v) AS v
    FROM b{r} b LEFT JOIN m{r} m ON m.part = b.part AND m.idx = b.idx
)"""
    steps = [
        """
kept AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS MATERIALIZED (
    SELECT vec_id, label, t.part, v[t.part * (len(v) // 4) + 1:(t.part + 1) * (len(v) // 4)] AS v
    FROM kept, unnest([0, 1, 2, 3]) AS t(part)
),
b0 AS MATERIALIZED (
    SELECT part, idx, v FROM (
        SELECT part, v, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS idx FROM parts
    ) WHERE idx < 256
)"""
    ]
    for r in range(rounds):
        steps += [assign.format(r=r), move.format(r=r, s=r + 1)]
    steps.append(assign.format(r=rounds))
    steps.append(
        f"""
coded AS (
    SELECT vec_id, string_agg(format('{{:02x}}', (best % 256)::BIGINT), '' ORDER BY part) AS code,
           sum(best // 256)::BIGINT AS error
    FROM a{rounds} GROUP BY vec_id
),
whole AS (
    SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, idx, pos)) AS codebooks_sha256
    FROM (SELECT part, idx, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM b{rounds})
)"""
    )
    return (
        "WITH "
        + ",".join(steps)
        + """
SELECT c.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY k.label)::BIGINT AS label_error,
       w.codebooks_sha256
FROM coded c JOIN kept k ON k.vec_id = c.vec_id CROSS JOIN whole w"""
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# HUGEINT products and whole division keep the shares exact.
_AUDIT = f"""
WITH read AS (
    SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                              '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
    FROM documents
),
in_documents AS (
    SELECT row, lang, source, term, count(*) AS n
    FROM (SELECT row, lang, source, unnest(terms) AS term FROM read) GROUP BY ALL
),
kept AS (
    SELECT lang, term, sum(n) AS total FROM in_documents GROUP BY lang, term HAVING count(*) >= 30
),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
cells AS (
    SELECT d.lang, d.source, d.term, sum(d.n) AS n
    FROM in_documents d JOIN kept k ON k.lang = d.lang AND k.term = d.term GROUP BY ALL
),
sizes AS (SELECT lang, source, sum(n) AS n FROM cells GROUP BY ALL),
shares AS MATERIALIZED (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
           1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (coalesce(s.n, 0) + 5 * l.v) AS p,
           1 + (1000000000 * (k.total + 5)::HUGEINT) // (l.n + 5 * l.v) AS q
    FROM (SELECT DISTINCT lang, source FROM read) g
    JOIN langs l ON l.lang = g.lang
    JOIN kept k ON k.lang = g.lang
    LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source
    LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
           coalesce((SELECT sum(abs(x.p - y.p)) FROM shares x JOIN shares y
                     ON y.lang = x.lang AND y.term = x.term
                     WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
    FROM (SELECT DISTINCT lang, source FROM read) a
    JOIN (SELECT DISTINCT lang, source FROM read) b ON b.lang = a.lang AND b.source <> a.source
    UNION ALL
    SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM found)
WHERE part = 'pair' OR rank <= 50"""

_SUFFIXES = ", ".join(f"'{suffix}'" for suffix in TWO_LABEL_SUFFIXES)


def _shrunk(children: str, parents: str, on: str) -> str:
    """A level of the reputation: children, their parents' mean, and the weight of that mean."""
    return f"""
SELECT j.*, w.weight, (w.weight * j.prior + j.k) / (w.weight + j.n) AS mean
FROM (SELECT c.*, p.mean AS prior FROM {children} c JOIN {parents} p USING ({on})) j,
     (SELECT coalesce(least({STRONGEST}, greatest({WEAKEST}, 1 / nullif(r, 0) - 1)), {STRONGEST}) AS weight
      FROM (SELECT CASE WHEN sum(v * (n - 1)) > 0
                        THEN greatest(0, sum((k - n * prior) ** 2 - v) / sum(v * (n - 1))) END AS r
            FROM (SELECT c.n, c.k, p.mean AS prior, c.n * p.mean * (1 - p.mean) AS v
                  FROM {children} c JOIN {parents} p USING ({on})))) w"""


_HOSTS = f"""
WITH rest AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest
    FROM pages
),
parsed AS MATERIALIZED (
    SELECT page_id,
           coalesce(translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
           coalesce(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2), '') AS path
    FROM rest
),
outcomes AS (
    SELECT doc_id AS page_id, max((coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1)::INT) AS bad
    FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id
),
named AS (
    SELECT host, n, k, rtrim(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS name
    FROM (SELECT host, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS k
          FROM parsed JOIN outcomes USING (page_id) GROUP BY host)
),
counts AS MATERIALIZED (
    SELECT host, n, k, '' AS top,
           CASE WHEN regexp_matches(name, '^[0-9]+(\\.[0-9]+){{3}}$') OR name LIKE '[%' THEN name
                WHEN two IN ({_SUFFIXES}) THEN regexp_extract(name, '([^.]*\\.)?[^.]*\\.[^.]*$')
                ELSE two END AS domain,
           CASE WHEN regexp_matches(name, '^[0-9]+(\\.[0-9]+){{3}}$') OR name LIKE '[%' THEN name
                WHEN two IN ({_SUFFIXES}) THEN two ELSE regexp_extract(name, '[^.]*$') END AS suffix
    FROM (SELECT *, regexp_extract(name, '([^.]*\\.)?[^.]*$') AS two FROM named)
),
whole AS (SELECT '' AS top, sum(k) / sum(n) AS mean FROM counts),
suffix_counts AS (SELECT suffix, '' AS top, sum(n) AS n, sum(k) AS k FROM counts GROUP BY suffix),
suffixes AS ({_shrunk("suffix_counts", "whole", "top")}),
domain_counts AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM counts GROUP BY ALL),
domains AS ({_shrunk("domain_counts", "suffixes", "suffix")}),
hosts AS ({_shrunk("counts", "domains", "domain, suffix")}),
bounds AS (
    SELECT host, a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound
    FROM (SELECT host, weight * prior + k AS a, weight * (1 - prior) + n - k AS b FROM hosts)
),
ruled AS (
    SELECT p.page_id, p.host, p.path, b.bound, r.rule, r.verdict,
           row_number() OVER (PARTITION BY p.row ORDER BY length(r.rule) DESC) AS nth
    FROM (SELECT *, row_number() OVER () AS row FROM parsed) p
    LEFT JOIN bounds b ON b.host = p.host
    LEFT JOIN (VALUES {", ".join(f"('{verdict}', '{rule}')" for verdict, rule in RULES)}) r(verdict, rule)
    ON (p.host = split_part(r.rule, '/', 1) OR ends_with(p.host, '.' || split_part(r.rule, '/', 1)))
       AND starts_with(p.path, substr(r.rule, instr(r.rule, '/')))
)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN bound >= {LEAST_BAD} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled WHERE nth = 1"""


# White space between words, as the operators take them.
_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

_REPEATS = f"""
WITH split AS MATERIALIZED (
    SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS words FROM documents
),
windows AS MATERIALIZED (
    SELECT row, i, array_to_string(words[i:i + 34], ' ') AS w
    FROM split, unnest(range(1, len(words) - 33)) AS t(i)
),
repeated AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
covered AS (
    SELECT DISTINCT row, unnest(range(i, i + 35)) AS j FROM windows WHERE w IN (SELECT w FROM repeated)
),
each AS (SELECT row, unnest(words) AS word, generate_subscripts(words, 1) AS j FROM split),
kept AS (
    SELECT row, string_agg(word, ' ' ORDER BY j) AS text, count(*) AS n
    FROM each ANTI JOIN covered USING (row, j) GROUP BY row
)
SELECT s.doc_id, len(s.words)::BIGINT AS n_words, (len(s.words) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON k.row = s.row"""


def _linked(links: str) -> str:
    """CTEs of the smallest id reachable over ``links(a, b)``, which hold every link both ways."""
    return f"""
links AS MATERIALIZED ({links}),
reached AS (
    SELECT a AS node, a AS seen FROM (SELECT DISTINCT a FROM links)
    UNION
    SELECT r.node, l.b FROM reached r JOIN links l ON l.a = r.seen
),
classes AS (SELECT node, min(seen) AS component FROM reached GROUP BY node)"""


_NEAR = """
    SELECT x.vec_id AS a, y.vec_id AS b FROM known x JOIN known y ON y.label = x.label AND y.vec_id <> x.vec_id
    WHERE len(x.v) = len(y.v) AND list_inner_product(x.v, y.v)
          / sqrt(list_inner_product(x.v, x.v) * list_inner_product(y.v, y.v)) >= 0.98"""
_VECTORS = f"""
WITH RECURSIVE known AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND label IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
{_linked(_NEAR)},
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.component, e.vec_id) AS component_id,
       e.vec_id = coalesce(c.component, e.vec_id) AS kept
FROM embeddings e LEFT JOIN classes c ON c.node = e.vec_id LEFT JOIN counts n ON n.a = e.vec_id"""

_ALIKE = """
    SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y ON y.s = x.s AND y.doc_id <> x.doc_id
    JOIN sizes m ON m.doc_id = x.doc_id JOIN sizes n ON n.doc_id = y.doc_id
    GROUP BY x.doc_id, y.doc_id, m.n, n.n HAVING 100 * count(*) >= 75 * (m.n + n.n - count(*))"""
_LOWERED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_SHINGLES = f"""
WITH RECURSIVE lowered AS MATERIALIZED (
    SELECT doc_id, {_WORDS.replace("coalesce(text, '')", _LOWERED)} AS words FROM documents
),
shingles AS MATERIALIZED (
    SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS s
    FROM lowered, unnest(range(1, greatest(len(words) - 3, 2))) AS t(i) WHERE len(words) > 0
),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
{_linked(_ALIKE)}
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, coalesce(c.component, d.doc_id) AS component_id,
       d.doc_id = coalesce(c.component, d.doc_id) AS kept
FROM lowered d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN classes c ON c.node = d.doc_id"""


ORACLE_SQL: dict[str, str] = {
    "op2_lattice": _VECTORS,
    "op4_minhash": _SHINGLES,
    "op5_superkmers": _REPEATS,
    "op11_codes": _codes_sql(4),
    "op12_divergence": _AUDIT,
    "op13_hosts": _HOSTS,
}
