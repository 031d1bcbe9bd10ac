"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

#: Levels the SQL can fold in each of its two trees (2^20 rows a language, 2^10 languages).
LEVELS, TOP_LEVELS = 20, 10


def _tree(name: str, key: str, levels: int) -> str:
    """CTEs ``{name}1`` … of a tree's levels over ``{name}0`` ({key}, pos, h), and
    ``{name}_path`` ({key}, pos, path): a node's siblings with their side, level by level."""
    out = []
    for k in range(levels):
        out.append(f"""{name}{k + 1} AS MATERIALIZED (
  SELECT {key}, pos // 2 AS pos, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE min(h) END AS h
  FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS n FROM {name}{k}) GROUP BY {key}, pos // 2, n)""")
    at = lambda k: f"(x.pos // {1 << k})"
    joins = "\n".join(f"  LEFT JOIN {name}{k} s{k} ON s{k}.{key} IS NOT DISTINCT FROM x.{key} AND s{k}.pos = xor({at(k)}, 1)" for k in range(levels))
    steps = ", ".join(f"struct_pack(more := {1 << k} < x.n, left_side := {at(k)} % 2 = 1, h := s{k}.h)" for k in range(levels))
    out.append(f"""{name}_path AS MATERIALIZED (
  SELECT x.{key}, x.pos, list_filter([{steps}], lambda s: s.more) AS path
  FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS n FROM {name}0) x
{joins})""")
    return ",\n".join(out)


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a string of ASCII characters."""
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = f"list_reduce(list_prepend(xor(a, b), [0::BIGINT for _ in range(8)]), lambda c, _i: {bit})"
    codes = f"[ascii(substr({text}, i::INT, 1))::BIGINT for i in range(1, length({text}) + 1)]"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: {byte}), 4294967295)"


def manifest() -> str:
    field = lambda x: f"coalesce(strlen(({x})::VARCHAR) || ':' || ({x})::VARCHAR, '-')"
    leaf = lambda n: "sha256(" + " || ".join(field(x) for x in ("doc_id", "source", "lang", n, "text")) + ")"
    return f"""
WITH leaves AS MATERIALIZED (
  SELECT doc_id, lang, {leaf('n_chars')} AS leaf,
    CASE WHEN {_crc32('doc_id::VARCHAR')} % 7 = 0 AND n_chars IS NOT NULL THEN {leaf('n_chars + 1')} END AS tampered
  FROM documents),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
l0 AS MATERIALIZED (SELECT lang, pos, leaf AS h FROM placed),
{_tree('l', 'lang', LEVELS)},
t0 AS MATERIALIZED (
  SELECT 0 AS one, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, h, lang FROM l{LEVELS}),
{_tree('t', 'one', TOP_LEVELS)},
proofs AS (
  SELECT p.doc_id, p.leaf, p.tampered, t0.h AS subroot, (SELECT h FROM t{TOP_LEVELS}) AS root, l_path.path || t_path.path AS path
  FROM placed p JOIN l_path ON l_path.lang IS NOT DISTINCT FROM p.lang AND l_path.pos = p.pos
  JOIN t0 ON t0.lang IS NOT DISTINCT FROM p.lang JOIN t_path ON t_path.pos = t0.pos),
folded AS (
  SELECT *, list_reduce(list_prepend(struct_pack(more := true, left_side := false, h := coalesce(tampered, leaf)), path),
    lambda a, s: struct_pack(more := true, left_side := false,
      h := sha256(CASE WHEN s.h IS NULL THEN a.h WHEN s.left_side THEN s.h || a.h ELSE a.h || s.h END))).h AS folded_root
  FROM proofs)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda s: coalesce(s.h, '')), ''), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified
FROM folded"""


def collocations() -> str:
    return """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
words AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
f AS MATERIALIZED (
  SELECT lang, size, phrase, count(*) AS f FROM (
    SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
    FROM words, range(1, 5) s(size))
  GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE size >= 2 AND f >= 30),
halves AS MATERIALIZED (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS p, array_to_string(w[k + 1:], ' ') AS q
  FROM cand, range(1, 4) s(k) WHERE k < size),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a // (l.f::HUGEINT + r.f))::BIGINT AS score
  FROM halves c JOIN f l ON l.lang = c.lang AND l.phrase = c.p JOIN f r ON r.lang = c.lang AND r.phrase = c.q),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, a, unnest(list_transform(range(1, size - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
    FROM cand, range(2, 4) s(m) WHERE m < size)
  GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN longer x ON x.lang = b.lang AND x.phrase = b.phrase
  WHERE x.most IS NULL OR 100::HUGEINT * x.most < 80::HUGEINT * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""


def warc_records() -> str:
    five = "('0x' || substr(hex, (1 + 5 * (i // 4))::INT, 5))::BIGINT"
    return f"""
WITH pages_of AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
    row_number() OVER w AS k, first_value(page_id) OVER w AS top
  FROM pages WINDOW w AS (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST))
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((({five}) >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1) for i in range(32)], '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN top END AS refers_to
FROM pages_of"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_merkle_manifest": manifest(),
        "op12_collocations": collocations(),
        "op13_warc_bundles": warc_records(),
    }
