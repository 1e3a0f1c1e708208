"""The SQL of op11 and op12: a Merkle tree level by level, and the cheapest edits by recursion back and forth over a conversation's rows."""

from __future__ import annotations

_A_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: Levels of the trees of sources and of the tree over them: more than any table here needs; what is one node already stays.
_DEPTH, _TOP = 7, 3
_NEVER = 1_000_000


def crc32(text: str) -> str:
    """The unsigned crc32 of an ASCII string."""
    step = "lambda x, i: xor(x >> 1, (x & 1) * 3988292384::UBIGINT)"
    byte = f"lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 1, 2, 3, 4, 5, 6, 7]::UBIGINT[]), {step})"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::UBIGINT)), {byte}), 4294967295::UBIGINT)"


def _tree(name: str, source: str, depth: int) -> str:
    """Levels of trees: name0 and so on (g, i, h, n) and their runs; source: g, i, h."""
    out = [f"{name}0 AS (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS n FROM {source})"]
    for k in range(1, depth + 1):
        out.append(f"{name}r{k} AS (SELECT g, i // 16 AS i, list(h ORDER BY i) AS run, any_value(n) AS n FROM {name}{k - 1} GROUP BY g, i // 16)")
        out.append(f"{name}{k} AS (SELECT g, i, CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS h, CASE WHEN n > 1 THEN (n + 15) // 16 ELSE 1 END AS n FROM {name}r{k})")
    return ",\n".join(out)


def _climb(name: str, source: str, depth: int, to: str) -> str:
    """From source (x, g, i, f: what is folded, p: the siblings so far) up to the top of its tree."""
    steps, before, after = [], "array_to_string(run[:c.i % 16], '')", "array_to_string(run[c.i % 16 + 2:], '')"
    for k in range(1, depth + 1):
        out = to if k == depth else f"{name}c{k}"
        steps.append(f"{out} AS (SELECT x, c.g, c.i // 16 AS i, CASE WHEN n > 1 THEN sha256({before} || f || {after}) ELSE f END AS f, CASE WHEN n > 1 THEN p || {before} || {after} ELSE p END AS p FROM {source} c JOIN {name}r{k} r ON c.g IS NOT DISTINCT FROM r.g AND c.i // 16 = r.i)")
        source = out
    return ",\n".join(steps)


def _value(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


_HEAD = " || ".join(_value(c) for c in ("doc_id", "source", "lang", "n_chars"))
OP11 = f"""
WITH d AS (
  SELECT row_number() OVER () AS x, doc_id, source AS g, sha256({_HEAD} || {_value('text')}) AS leaf,
         CASE WHEN {crc32('doc_id::VARCHAR')} % 5 = 0 THEN sha256({_HEAD} || {_value(f'translate(text, {_A_Z})')}) END AS found
  FROM documents
), l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, found NULLS FIRST) - 1 AS i FROM d),
{_tree('s', '(SELECT g, i, leaf AS h FROM l)', _DEPTH)},
subroots AS (SELECT g, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i FROM s{_DEPTH}),
{_tree('t', '(SELECT 0 AS g, i, h FROM subroots)', _TOP)},
own AS (SELECT x, g, i, coalesce(found, leaf) AS f, '' AS p FROM l),
{_climb('s', 'own', _DEPTH, 'up')},
over AS (SELECT x, 0 AS g, subroots.i AS i, f, p FROM up JOIN subroots ON up.g IS NOT DISTINCT FROM subroots.g),
{_climb('t', 'over', _TOP, 'topmost')}
SELECT doc_id, leaf, subroots.h AS subroot, t{_TOP}.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = t{_TOP}.h AS verified
FROM l JOIN topmost USING (x) JOIN subroots ON l.g IS NOT DISTINCT FROM subroots.g, t{_TOP}
"""

_KEY = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
_THEN, _NEXT = (2, 2, 3, 2), "uuau"


def _relaxed(f: list[str]) -> list[str]:
    u, a = f"least({f[2]}, 5 + {f[3]})", f"least({f[3]}, 5 + {f[2]})"
    return [f"least({f[0]}, 5 + {u})", f"least({f[1]}, 5 + {u})", u, a]


def _least(q: int) -> str:
    """The cost of a row in state q with what follows: deleted, kept, renamed."""
    then, more = f"f.f{_THEN[q]}", "CASE WHEN f.cut THEN 5 ELSE 0 END"
    system = f"WHEN f.k = 's' THEN {more} + f.f1" if q == 0 else ""
    keep = f"CASE WHEN f.k = '{_NEXT[q]}' THEN {more} + {then} {system} ELSE {_NEVER} END"
    return f"least(2 + f.f{q}, {keep}, CASE WHEN f.k = '-' THEN {_NEVER} ELSE 1 + {more} + {then} END) AS g{q}"


_COSTS = ", ".join(_least(q) for q in range(4))
_RELAXED = ", ".join(f"{x} AS f{q}" for q, x in enumerate(_relaxed([f"g{q}" for q in range(4)])))
OP12 = f"""
WITH RECURSIVE c AS (
  SELECT row_number() OVER () AS x, dense_rank() OVER (ORDER BY conv_id) AS g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32(_KEY)} % 20 AS k FROM conversations
), m AS (
  SELECT g, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM c WHERE k <> 0
), o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, md5(text)) AS i, rtrim(text, {_SPACES}) AS bare FROM m),
f AS (
  SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again, coalesce(nullif(left(role, 1), ''), ' ') AS initial,
         lag(coalesce(nullif(left(role, 1), ''), ' ')) OVER (PARTITION BY g ORDER BY i) AS before
  FROM o
), r AS (
  SELECT g, i, role, text, before || initial NOT IN ('su', 'ua', 'au') AS illegal, turn, blank, again, NOT blank AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS cut,
         CASE WHEN blank OR again THEN '-' WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'x' END AS k
  FROM f
), h AS (
  SELECT g, any_value(conv_id) AS conv_id, coalesce(any_value(n), 0) AS n, coalesce(any_value(gaps), 0) AS gaps, coalesce(any_value(blank), 0) AS blank, coalesce(any_value(dup), 0) AS duplicate, coalesce(any_value(cut), 0) AS truncated, coalesce(any_value(illegal), 0) AS illegal
  FROM c LEFT JOIN (SELECT g, count(*) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS dup, count(*) FILTER (cut) AS cut, count(*) FILTER (illegal) AS illegal FROM r GROUP BY g) USING (g) GROUP BY g
), b AS (
  SELECT g, n AS i, 0 AS f0, 10 AS f1, 5 AS f2, 0 AS f3 FROM h
  UNION ALL
  SELECT g, i, {_RELAXED} FROM (SELECT f.g, f.i - 1 AS i, {_COSTS} FROM (SELECT b.*, r.k, r.cut FROM b JOIN r ON r.g = b.g AND r.i = b.i) f)
), a AS (
  SELECT g, 0::BIGINT AS i, 0 AS q, '' AS audit, []::VARCHAR[] AS lines, true AS going FROM h
  UNION ALL
  SELECT g, CASE e WHEN 'D' THEN i + 1 WHEN 'I' THEN i WHEN 'K' THEN i + 1 ELSE i + 1 END AS i,
         CASE WHEN e = '' OR e = 'D' THEN q WHEN e = 'K' AND k = 's' THEN 1 WHEN q = 2 THEN 3 ELSE 2 END AS q,
         audit || e,
         CASE e WHEN 'I' THEN list_append(lines, said || ':') WHEN 'K' THEN list_append(lines, role || ':' || text) WHEN 'R' THEN list_append(lines, said || ':' || text) ELSE lines END AS lines,
         e <> '' AS going
  FROM (
    SELECT *, CASE WHEN q = 2 THEN 'assistant' ELSE 'user' END AS said,
           CASE WHEN k IS NULL THEN CASE WHEN q IN (0, 3) THEN '' ELSE 'I' END
                WHEN 2 + t[q + 1] = f[q + 1] THEN 'D'
                WHEN 5 + f[CASE WHEN q = 2 THEN 4 ELSE 3 END] = f[q + 1] THEN 'I'
                WHEN k <> '-' AND (k = CASE WHEN q = 2 THEN 'a' ELSE 'u' END AND more + t[CASE WHEN q = 2 THEN 4 ELSE 3 END] = f[q + 1] OR k = 's' AND q = 0 AND more + t[2] = f[q + 1]) THEN 'K'
                ELSE 'R' END AS e
    FROM (SELECT a.*, r.k, r.role, r.text, CASE WHEN r.cut THEN 5 ELSE 0 END AS more, [x.f0, x.f1, x.f2, x.f3] AS f, [y.f0, y.f1, y.f2, y.f3] AS t
          FROM a JOIN b x ON x.g = a.g AND x.i = a.i LEFT JOIN b y ON y.g = a.g AND y.i = a.i + 1 LEFT JOIN r ON r.g = a.g AND r.i = a.i + 1 WHERE going)
  )
)
SELECT conv_id, gaps::BIGINT AS gaps, blank, duplicate, truncated, illegal, b.f0::BIGINT AS cost, audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256
FROM h JOIN b ON b.g = h.g AND b.i = 0 JOIN a ON a.g = h.g AND NOT going
"""
