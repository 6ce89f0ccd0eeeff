"""SQL that is written step by step, for DuckDB: rounds of codebooks, levels of a tree."""

from __future__ import annotations

from . import merkle, vectorcodes


def vector_codes_sql(width: int = 64, parts: int = vectorcodes.PARTS, rounds: int = vectorcodes.ROUNDS, entries: int = vectorcodes.ENTRIES) -> str:
    """The same in SQL: every part against every entry, round after round. The tables' vectors have 64 components."""
    d = width // parts
    far = " + ".join(f"(v.x[{i}] - b.x[{i}]) * (v.x[{i}] - b.x[{i}])" for i in range(1, d + 1))
    mean = ", ".join(f"floor(sum(v.x[{i}])::DOUBLE / count(*))::BIGINT" for i in range(1, d + 1))
    steps = [f"""
k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * {vectorcodes.SCALE})::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
v AS (SELECT r, p, list_slice(x, p * {d} + 1, p * {d} + {d}) AS x FROM k, (SELECT unnest(range({parts})) AS p) z),
b0 AS (SELECT p, r - 1 AS e, x FROM v WHERE r <= {entries})"""]  # fmt: skip
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, p, m % {entries} AS e, m // {entries} AS d FROM (SELECT v.r, v.p, min(({far}) * {entries} + b.e) AS m FROM v JOIN b{i} b ON v.p = b.p GROUP BY v.r, v.p) z)")
        if i < rounds:
            steps.append(f"""b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(s.x, b.x) AS x FROM b{i} b LEFT JOIN
  (SELECT a.p, a.e, [{mean}] AS x FROM a{i} a JOIN v ON v.r = a.r AND v.p = a.p GROUP BY a.p, a.e) s ON s.p = b.p AND s.e = b.e)""")
    return f"""
WITH {", ".join(steps)},
c AS (SELECT k.vec_id, k.label, string_agg(printf('%02x', a.e), '' ORDER BY a.p) AS code, sum(a.d)::BIGINT AS error FROM a{rounds} a JOIN k ON k.r = a.r GROUP BY k.r, k.vec_id, k.label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256 FROM c"""


def merkle_sql(levels: int = 12, arity: int = merkle.ARITY) -> str:
    """The manifest in SQL: every level of the groups' trees, then of the one above; enough for arity ** levels rows.

    A tree that is done stays as it is for the rest of its levels: one node, whose digest is its child's.
    """
    field = lambda x: f"coalesce(octet_length(encode({x}))::VARCHAR || ':' || {x}, '-')"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    row = lambda text: f"sha256({' || '.join(map(field, ('doc_id::VARCHAR', 'source', 'lang', 'n_chars::VARCHAR', text)))})"
    bits = ["c0 AS (SELECT unnest(range(256)) AS i, i AS c)"]
    bits += [f"c{k + 1} AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM c{k})" for k in range(8)]
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"
    steps = bits + [f"""
d AS (SELECT doc_id, lang, {row("text")} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {row(low)} END AS changed FROM documents, (SELECT list(c ORDER BY i) AS crc FROM c8) z),
p AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
g0 AS (SELECT g, i, leaf AS d FROM p)"""]  # fmt: skip

    def level(name: str, k: int, group: str) -> list[str]:
        run = f"PARTITION BY {group}, i // {arity} ORDER BY i ROWS BETWEEN"
        return [
            f"{name}s{k} AS (SELECT *, coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after, count(*) OVER (PARTITION BY {group}) AS n FROM {name}{k})",
            f"{name}{k + 1} AS (SELECT {group}, i // {arity} AS i, CASE WHEN max(n) = 1 THEN max(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM {name}s{k} GROUP BY {group}, i // {arity})",
        ]

    for k in range(levels):
        steps += level("g", k, "g")
    steps.append(f"t0 AS (SELECT 0 AS z, g AS i, d FROM g{levels})")
    for k in range(levels):
        steps += level("t", k, "z")
    steps.append("f0 AS (SELECT *, i AS at, coalesce(changed, leaf) AS f, '' AS proof FROM p)")
    for k in range(2 * levels):
        name, j = ("g", k) if k < levels else ("t", k - levels)
        on = "s.g = f.g AND s.i = f.at" if name == "g" else "s.i = f.at"
        at = "f.at" if k != levels - 1 else f"f.at * 0 + f.g * {arity}"  # the subroot's place is its group's
        steps.append(f"f{k + 1} AS (SELECT f.doc_id, f.leaf, f.g, {at} // {arity} AS at, CASE WHEN s.n = 1 THEN f.f ELSE sha256(s.before || f.f || s.after) END AS f, f.proof || s.before || s.after AS proof FROM f{k} f JOIN {name}s{j} s ON {on})")
    return f"""
WITH {", ".join(steps)}
SELECT f.doc_id, f.leaf, u.d AS subroot, r.d AS root, sha256(f.proof) AS proof_sha256, f.f AS folded_root, f.f = r.d AS verified
FROM f{2 * levels} f JOIN t0 u ON u.i = f.g, t{levels} r"""
