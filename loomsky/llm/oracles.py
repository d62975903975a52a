"""DuckDB SQL with the results of the search and of the Merkle manifest."""

from __future__ import annotations

from .merkle import LOWER, UPPER
from .search import TERM

_WORDS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')"

SEARCH_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, unnest({_WORDS}) AS term FROM documents),
i AS (SELECT row_number() OVER () AS item, item_id, unnest({_WORDS}) AS term FROM benchmark),
n AS (SELECT r, count(*) AS n FROM d GROUP BY r),
tf AS (SELECT r, doc_id, term, n, count(*) AS tf FROM d JOIN n USING (r) GROUP BY r, doc_id, term, n),
whole AS (SELECT count(DISTINCT r) AS docs, count(*) AS terms FROM d),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term, docs),
scored AS (SELECT item, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
  FROM i JOIN tf USING (term) JOIN w USING (term), whole GROUP BY item, item_id, r, doc_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20"""


def merkle_sql(levels: int = 5, source_levels: int = 4) -> str:
    """SQL of the Merkle manifest for sources of at most 16 ** ``levels`` rows and 16 ** ``source_levels`` sources."""
    crc = """tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""

    def leaf(text: str) -> str:
        return "sha256(concat(" + ", ".join(f"coalesce(octet_length(encode(CAST({f} AS VARCHAR))) || ':' || {f}, '-')" for f in ["doc_id", "source", "lang", "n_chars", text]) + "))"

    up: list[str] = []

    def rise(k: int, tree: str) -> None:
        up.append(f"""c{k} AS (SELECT *, count(*) OVER (PARTITION BY {tree}) AS c FROM n{k}),
u{k} AS (SELECT {tree}, r // 16 AS r, any_value(c) AS c, list(h ORDER BY r) AS l FROM c{k} GROUP BY {tree}, r // 16),
n{k + 1} AS (SELECT {tree}, r, CASE WHEN c > 1 THEN sha256(array_to_string(l, '')) ELSE l[1] END AS h FROM u{k})""")

    walk: list[str] = []

    def step(k: int, tree: str) -> None:
        others = "array_to_string(u.l[:p.r % 16], '')", "array_to_string(u.l[p.r % 16 + 2:], '')"
        walk.append(f"""p{k + 1} AS (SELECT p.* REPLACE (p.r // 16 AS r, CASE WHEN u.c > 1 THEN concat(p.proof, {others[0]}, {others[1]}) ELSE p.proof END AS proof,
  CASE WHEN u.c > 1 THEN sha256(concat({others[0]}, p.f, {others[1]})) ELSE p.f END AS f) FROM p{k} p JOIN u{k} u ON u.{tree} = p.{tree} AND u.r = p.r // 16)""")

    for k in range(levels):
        rise(k, "tree")
        step(k, "tree")
    m = levels
    sub = f"""s AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS r FROM n{m}),
n{m + 1} AS (SELECT 0 AS top, r, h FROM s)"""
    up.append(sub)
    walk.append(f"p{m + 1} AS (SELECT p.* REPLACE (s.r AS r), 0 AS top, s.h AS subroot FROM p{m} p JOIN s USING (tree))")
    for k in range(m + 1, m + 1 + source_levels):
        rise(k, "top")
        step(k, "top")
    end = m + 1 + source_levels
    return f"""WITH {crc},
rows AS (SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 5 = 0 AS hit, translate(text, '{UPPER}', '{LOWER}') AS low FROM documents, tab),
leaves AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {leaf("text")} AS leaf, CASE WHEN hit THEN {leaf("low")} ELSE {leaf("text")} END AS claimed FROM rows),
p0 AS (SELECT doc_id, tree, leaf, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, claimed AS f, '' AS proof FROM leaves),
n0 AS (SELECT tree, r, leaf AS h FROM p0),
{(',' + chr(10)).join(up)},
{(',' + chr(10)).join(walk)}
SELECT doc_id, leaf, subroot, n{end}.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = n{end}.h AS verified FROM p{end}, n{end}"""


MERKLE_SQL = merkle_sql()
