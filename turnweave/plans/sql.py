"""Pieces of SQL (DuckDB dialect) from which the checking queries are put together."""

from __future__ import annotations

from turnweave.config import TokenConfig

CFG = TokenConfig()


def lst(values) -> str:
    return "[" + ", ".join(str(v) for v in values) + "]"


#: Rectangular sides as in rectangular_sides.
V1 = """v1 AS (
  SELECT row_id, dialogue_id, t, list_transform("A", lambda r, i: list_resize(r, t, CASE WHEN i = 1 THEN 3 ELSE 2048 END)) AS a,
    list_transform("B", lambda r, i: list_resize(r, t, CASE WHEN i = 1 THEN 3 ELSE 2048 END)) AS b
  FROM (SELECT *, least(len("A"[2]), len("B"[2])) AS t FROM dialogue_tokens WHERE len("A") = 9 AND len("B") = 9) WHERE t > 0)"""

MAIN = """main AS (
  SELECT row_id, 0 AS speaker_rank, list_concat(a, b[2:]) AS m FROM v1 UNION ALL SELECT row_id, 1, list_concat(b, a[2:]) FROM v1)"""


def rep(value: str, n: str) -> str:
    return f"list_resize(CAST([] AS INTEGER[]), CAST({n} AS BIGINT), CAST({value} AS INTEGER))"


def delay(m: str) -> str:
    d, init, pad, most = lst(CFG.delays), lst(CFG.initials), lst(CFG.pads), max(CFG.delays)
    return f"list_transform({m}, lambda r, i: list_concat(list_concat({rep(f'{init}[i]', f'{d}[i] + 1')}, r), {rep(f'{pad}[i]', f'{most} - {d}[i]')}))"


def undelay(m: str) -> str:
    d, most = lst(CFG.delays), max(CFG.delays)
    return f"CASE WHEN len({m}[1]) - {most} >= 1 THEN list_transform({m}, lambda r, i: r[{d}[i] + 1 : {d}[i] + len(r) - {most}]) END"


def labels(m: str) -> str:
    return f"list_transform({m}, lambda r, i: list_transform(r, lambda x: CASE WHEN x < {lst(CFG.initials)}[i] THEN x ELSE -1 END))"


def parts(source: str, keys: str, m: str, most: int) -> str:
    """Near-equal parts of matrix ``m`` as (keys, part, m)."""
    return f"""(SELECT {keys}, k AS part, list_transform(m, lambda r: r[k * base + least(k, extra) + 1 : (k + 1) * base + least(k + 1, extra)]) AS m
  FROM (SELECT {keys}, m, n, t // n AS base, t % n AS extra, unnest(range(n)) AS k FROM (SELECT {keys}, m, t, (t + {most} - 1) // {most} AS n FROM (SELECT {keys}, {m} AS m, len({m}[1]) AS t FROM {source}) WHERE t > 0)))"""


def rows(source: str, keys: str, m: str = "m") -> str:
    """A matrix as rows (keys, r, n, digest)."""
    return f"SELECT {keys}, CAST(r AS INTEGER) AS r, CAST(len(s) AS INTEGER) AS n, md5(array_to_string(list_transform(s, lambda x: CAST(x AS VARCHAR)), ',')) AS digest FROM (SELECT {keys}, unnest(range(len({m}))) AS r, unnest({m}) AS s FROM {source})"
