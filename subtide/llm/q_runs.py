"""Queries over repeated consecutive events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from subtide.llm.runs import collapse_runs


def p6_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cue = spark.read.parquet(f"{sf_dir}/cue.parquet")
    return collapse_runs(cue).select("file_id", "first_seq", "last_seq", "n_events", "from_ms", "to_ms", "duration_ms")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cue = spark.read.parquet(f"{sf_dir}/cue.parquet")
    return collapse_runs(cue, min_events=2).select("file_id", "first_seq", "last_seq")


QUERIES = {"p6_found": p6_found, "p6_runs": p6_runs}

#: At most two edits by characters (the function of SQL counts bytes): what is left between
#: the common start and end is two characters at most, or its ends are edited and its middle is equal.
_START = "len(list_filter(range(1, least(length(l), length(pl)) + 1), lambda i: left(l, i) = left(pl, i)))"
_END = f"len(list_filter(range(1, least(length(l), length(pl)) - {_START} + 1), lambda i: right(l, i) = right(pl, i)))"
_CORE = "substr({x}, {s} + 1, length({x}) - {s} - {e})"
_A, _B = (_CORE.format(x=x, s=_START, e=_END) for x in ("l", "pl"))
_MIDDLES = " OR ".join(
    f"substr({_A}, {1 + a}, length({_A}) - {a + b}) = substr({_B}, {1 + c}, length({_B}) - {c + d})" for a, c in ((1, 1), (1, 0), (0, 1)) for b, d in ((1, 1), (1, 0), (0, 1))
)
_NEAR = f"(greatest(length({_A}), length({_B})) <= 2 OR {_MIDDLES})"

_RUNS = """WITH e AS (SELECT file_id, seq, v.s AS s, v.e AS e, v.c AS c FROM (
    SELECT file_id, seq, min(struct_pack(s := start_ms, e := end_ms, c := content)) AS v FROM cue WHERE file_id IS NOT NULL AND seq IS NOT NULL GROUP BY file_id, seq)),
  p AS (SELECT *, lower(regexp_replace(c, '</?i>|\\{\\\\an[1-9]\\}', '', 'g')) AS plain FROM e),
  k AS (SELECT *, regexp_replace(plain, '[^\\p{L}]+', '', 'g') AS l, regexp_replace(plain, '[^\\p{Nd}]+', '', 'g') AS d,
    c IS NULL OR regexp_matches(c, '^[\\t-\\r \\x{85}\\p{Z}]*\\z') AS blank FROM p),
  n AS (SELECT *, lag(seq) OVER w AS ps, lag(c) OVER w AS pc, lag(l) OVER w AS pl, lag(d) OVER w AS pd, lag(blank) OVER w AS pb FROM k WINDOW w AS (PARTITION BY file_id ORDER BY seq)),
  a AS (SELECT *, CASE WHEN ps = seq - 1 AND NOT blank AND NOT pb AND (c = pc OR (d = pd AND ((l = pl AND l || d <> '')
    OR (length(l) >= 12 AND length(pl) >= 12 AND abs(length(l) - length(pl)) <= 2 AND @near)))) THEN 0 ELSE 1 END AS opens FROM n),
  r AS (SELECT *, sum(opens) OVER (PARTITION BY file_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM a),
  g AS (SELECT file_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n_events, min(s) AS from_ms, max(e) AS to_ms FROM r GROUP BY file_id, run)""".replace("@near", _NEAR)

ORACLES = {
    "p6_found": f"{_RUNS} SELECT file_id, first_seq, last_seq FROM g WHERE n_events > 1",
    "p6_runs": f"{_RUNS} SELECT file_id, first_seq, last_seq, n_events, from_ms, to_ms, to_ms - from_ms AS duration_ms FROM g",
}
