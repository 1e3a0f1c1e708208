"""The SQL of op8: figures, votes, and expectation-maximisation over the counts of vote patterns as a recursion."""

from __future__ import annotations

_WORD = r"'[^\x20\x09-\x0D]+'"
_SOME = "n_words >= 20"


def _vote(bad: str, good: str | None = None) -> str:
    return f"CASE WHEN {bad} THEN -1 ELSE 0 END" if good is None else f"CASE WHEN {_SOME} AND ({bad}) THEN -1 WHEN {_SOME} AND ({good}) THEN 1 ELSE 0 END"


def _share(of: str, among: str = "n_words") -> str:
    return f"{of} / greatest({among}, 1)"


#: The rules of quality.rules, in their order.
_VOTES = [
    _vote("n_words < 20"),
    _vote(f"{_share('n_repeat_words')} > 0.3"),
    _vote(f"{_share('n_dup_lines', 'n_lines')} > 0.3 AND n_lines >= 4"),
    _vote(f"{_share('n_upper', 'n_letters')} > 0.5 AND n_letters >= 50"),
    _vote(f"{_share('n_symbols')} > 0.1", f"{_share('n_symbols')} < 0.02"),
    _vote(f"{_share('n_lettered')} < 0.8", f"{_share('n_lettered')} > 0.9"),
    _vote(f"{_share('n_marks', 'word_chars')} > 0.25", f"{_share('n_marks', 'word_chars')} < 0.1"),
    _vote(f"{_share('word_chars')} < 3 OR {_share('word_chars')} > 10", f"{_share('word_chars')} BETWEEN 3.5 AND 7"),
    _vote(f"{_share('n_short')} < 0.03 OR {_share('n_short')} > 0.6", f"{_share('n_short')} > 0.1 AND {_share('n_short')} < 0.5"),
]
_RULES = range(len(_VOTES))
_LOGIT = "ln(share / (1 - share)) + " + " + ".join(f"v{k} * ln(acc[{k + 1}] / (1 - acc[{k + 1}]))" for k in _RULES)


def _accuracy(k: int) -> str:
    right = f"sum(CASE WHEN v{k} > 0 THEN n * post WHEN v{k} < 0 THEN n * (1 - post) ELSE 0 END)"
    return f"least(0.99, greatest(0.55, ({right} + 16) / (sum(CASE WHEN v{k} <> 0 THEN n ELSE 0 END) + 20)))"


OP8 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
p AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1)) GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, {_WORD}) GROUP BY r),
f AS (
  SELECT r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters, len(list_filter(w, lambda x: strlen(x) <= 3)) AS n_short,
         len(list_filter(w, lambda x: strlen(x) > length(x) OR regexp_matches(x, '[A-Za-z]'))) AS n_lettered, length(regexp_replace(array_to_string(w, ''), '[A-Za-z0-9]|[^\x00-\x7F]', '', 'g')) AS n_marks
  FROM d LEFT JOIN p USING (r) LEFT JOIN l USING (r)
), v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {", ".join(f"{x} AS v{k}" for k, x in zip(_RULES, _VOTES, strict=True))} FROM f),
c AS (SELECT {", ".join(f"v{k}" for k in _RULES)}, count(*)::DOUBLE AS n FROM v GROUP BY ALL),
em AS (
  SELECT 0 AS round, 0.8::DOUBLE AS share, [{", ".join(["0.8"] * len(_VOTES))}]::DOUBLE[] AS acc, 1::DOUBLE AS moved
  UNION ALL
  SELECT round + 1, least(0.95, greatest(0.05, (good + 16) / (total + 20))) AS share, new AS acc, list_max(list_transform(range(1, {len(_VOTES) + 1}), lambda k: abs(new[k] - acc[k]))) AS moved
  FROM (
    SELECT round, any_value(acc) AS acc, sum(n) AS total, sum(n * post) AS good,
           [{", ".join(_accuracy(k) for k in _RULES)}]::DOUBLE[] AS new
    FROM (SELECT *, 1 / (1 + exp(-({_LOGIT}))) AS post FROM em, c WHERE round < 200 AND moved >= 1e-9) GROUP BY round
  )
), e AS (SELECT share, acc FROM em QUALIFY row_number() OVER (ORDER BY round DESC) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 1 / (1 + exp(-({_LOGIT}))) >= 0.5 AS kept FROM v, e
"""
