"""SQL that several queries' oracles share."""

from __future__ import annotations


def peaks_sql(name: str, source: str, key: str, distance: int, height: str = "-1e308", prominence: str = "-1e308") -> str:
    """CTEs that end in ``name`` (key, at): peaks of ``source`` (key, at from 0 on, v), the highest first at least ``distance`` apart.

    ``height`` and ``prominence`` are expressions on a key's largest value ``hi``. For use under WITH RECURSIVE.
    """
    n = name
    return f"""
{n}_0 AS (SELECT {key}, "at", v, max(v) OVER (PARTITION BY {key}) AS hi, CASE WHEN v = lag(v) OVER w THEN 0 ELSE 1 END AS flip FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY "at")),
{n}_1 AS (SELECT *, sum(flip) OVER (PARTITION BY {key} ORDER BY "at") AS run FROM {n}_0),
{n}_2 AS (SELECT {key}, run, v, hi, (min("at") + max("at")) // 2 AS "at" FROM {n}_1 GROUP BY {key}, run, v, hi),
{n}_3 AS (SELECT *, lag(v) OVER w AS before, lead(v) OVER w AS after FROM {n}_2 WINDOW w AS (PARTITION BY {key} ORDER BY run)),
{n}_4 AS (SELECT {key}, "at", v, hi, row_number() OVER (PARTITION BY {key} ORDER BY v DESC, "at" DESC) AS k FROM {n}_3 WHERE v > before AND v > after AND v >= {height}),
{n}_5 AS (SELECT DISTINCT {key}, 0::BIGINT AS k, []::BIGINT[] AS kept FROM {n}_4 UNION ALL
  SELECT r.{key}, p.k, CASE WHEN len(list_filter(r.kept, lambda a: abs(a - p."at") < {distance})) = 0 THEN list_append(r.kept, p."at"::BIGINT) ELSE r.kept END FROM {n}_5 r JOIN {n}_4 p ON p.{key} = r.{key} AND p.k = r.k + 1),
{n}_6 AS (SELECT {key}, unnest(arg_max(kept, k)) AS "at" FROM {n}_5 GROUP BY {key}),
{n}_7 AS (SELECT p.{key}, p."at", q.v, q.hi, coalesce((SELECT max(s."at") FROM {source} s WHERE s.{key} = p.{key} AND s."at" < p."at" AND s.v > q.v), -1) AS l, coalesce((SELECT min(s."at") FROM {source} s WHERE s.{key} = p.{key} AND s."at" > p."at" AND s.v > q.v), 9223372036854775807) AS r FROM {n}_6 p JOIN {n}_4 q ON q.{key} = p.{key} AND q."at" = p."at"),
{n} AS (SELECT p.{key}, p."at", any_value(p.v) AS v FROM {n}_7 p JOIN {source} s ON s.{key} = p.{key} AND s."at" > p.l AND s."at" < p.r GROUP BY p.{key}, p."at" HAVING any_value(p.v) - greatest(min(CASE WHEN s."at" <= p."at" THEN s.v END), min(CASE WHEN s."at" >= p."at" THEN s.v END)) >= {prominence.replace("hi", "any_value(p.hi)")})"""
