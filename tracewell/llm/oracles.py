"""SQL, as DuckDB runs it, for the queries that SQL can express."""

from __future__ import annotations

from .mixing import P, WEIGHTS, WORD, mixed, permuted
from .urlfilter import CONTRACT_RULES, UNWANTED

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def topk_sql(k: int = 5, query_mod: int = 50, scale: int = 256) -> str:
    return f"""
WITH v AS (SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rn, q.vec_id AS query_id, v.vec_id, CAST(CASE WHEN len(q.e) = 0 THEN 0 ELSE list_dot_product(q.e, v.e) END AS BIGINT) AS score FROM v q JOIN v ON v.rn <> q.rn AND len(v.e) = len(q.e) WHERE q.vec_id % {query_mod} = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= {k}"""


def url_sql() -> str:
    def fits(pattern: str) -> str:
        host, slash, path = pattern.partition("/")
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{path}')"

    ordered = sorted(CONTRACT_RULES, key=lambda r: -len(r.pattern))
    rule = "".join(f" WHEN {fits(r.pattern)} THEN '{r.pattern}'" for r in ordered)
    verdict = "".join(f" WHEN rule = '{r.pattern}' THEN '{r.verdict}'" for r in ordered)
    return f"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_UPPER.lower()}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT *, CASE{rule} END AS rule FROM h)
SELECT page_id, host, path, rule, CASE{verdict} WHEN regexp_matches(host || path, '(^|\\.)({"|".join(UNWANTED)})\\.') THEN 'block' ELSE 'allow' END AS verdict FROM r"""


def mix_sql(block: int = 32, factor: float = 1.5, docs_a_bucket: int = 1024, salt: int = 31) -> str:
    """A source's slots are those that the shards' draws gave it; only the sums over shards matter to a document."""
    steps: list[tuple[str, str]] = []
    permuted(lambda name, sql: steps.append((name, sql)), "index", "blocks", "sid")
    ctes, last = [], "ranks"
    for name, sql in steps:
        ctes.append(f"step_{name} AS (SELECT *, {sql} AS {name} FROM {last})")
        last = f"step_{name}"
    weight = f"list_extract([{', '.join(map(str, WEIGHTS))}], CAST((sid - 1) % {len(WEIGHTS)} + 1 AS INTEGER))"
    made = f"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM s0),
s2 AS (SELECT *, CAST({weight} AS DOUBLE) AS weight, source_size * 2.0 AS cap FROM s1),
s3 AS (SELECT *, sum(cap) OVER w AS capped, sum(weight) OVER w AS weighed, sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight FROM s2 WINDOW w AS (ORDER BY cap / weight, sid)),
s4 AS (SELECT *, (CAST({factor} AS DOUBLE) * CAST(all_size AS DOUBLE) - (capped - cap)) / (all_weight - (weighed - weight)) AS before FROM s3),
s5 AS (SELECT *, before * weight >= cap AS stops FROM s4),
s6 AS (SELECT *, (SELECT arg_min(before, (cap / weight, sid)) FROM s5 WHERE NOT stops) AS level FROM s5),
s7 AS (SELECT sid, source, source_size, weight, CASE WHEN stops THEN cap ELSE level * weight END AS target, CAST(ceil(source_size / {float(block)}) AS BIGINT) AS blocks FROM s6),
s8 AS (SELECT *, CASE WHEN source_size > 0 THEN least(2 * blocks, CAST(round(target * blocks / source_size) AS BIGINT)) ELSE 0 END AS quota FROM s7),
u0 AS (SELECT sid, CAST(sum(quota) OVER (ORDER BY sid) AS BIGINT) AS hi, quota, CAST(sum(quota) OVER () AS BIGINT) AS n FROM s8 WHERE quota > 0),
u1 AS (SELECT sid, CAST(floor((hi - quota) / CAST(n AS DOUBLE) * {P}) AS BIGINT) AS lo, CAST(floor(hi / CAST(n AS DOUBLE) * {P}) AS BIGINT) AS hi FROM u0),
u2 AS (SELECT {mixed("id", salt)} AS u FROM (SELECT unnest(range(coalesce((SELECT max(n) FROM u0), 0))) AS id)),
u3 AS (SELECT sid, count(*) AS drawn FROM u2 JOIN u1 ON u >= lo AND u < hi GROUP BY sid),
a0 AS (SELECT s8.*, coalesce(drawn, 0) AS drawn, least(coalesce(drawn, 0), 2 * blocks) AS kept FROM s8 LEFT JOIN u3 ON u3.sid = s8.sid),
a1 AS (SELECT *, 2 * blocks - kept AS room, CASE WHEN 2 * blocks > kept THEN weight ELSE 0.0 END AS w, sum(drawn - kept) OVER () AS spare FROM a0),
a2 AS (SELECT *, sum(room) OVER o - room AS filled, sum(w) OVER () - (sum(w) OVER o - w) AS rest FROM a1 WINDOW o AS (ORDER BY room / weight, sid)),
a3 AS (SELECT *, CASE WHEN w > 0 THEN CAST(spare - filled AS DOUBLE) / rest END AS open FROM a2),
a4 AS (SELECT *, w * open >= room AS fills FROM a3),
a5 AS (SELECT *, CASE WHEN w = 0 THEN 0.0 WHEN fills THEN CAST(room AS DOUBLE) ELSE coalesce((SELECT arg_min(open, (room / weight, sid)) FROM a4 WHERE NOT fills), 0.0) * w END AS share FROM a4),
a6 AS (SELECT *, CAST(round(sum(share) OVER (ORDER BY sid)) AS BIGINT) AS upto FROM a5),
sources AS (SELECT *, kept + least(upto - coalesce(lag(upto) OVER (ORDER BY sid), 0), room) AS all_slots FROM a6),
ranks AS (SELECT sid, blocks, r % blocks AS index FROM (SELECT sid, blocks, unnest(range(all_slots)) AS r FROM sources WHERE all_slots > 0)),
{", ".join(ctes)},
times AS (SELECT sid, block, count(*) AS times FROM {last} GROUP BY sid, block),
d0 AS (SELECT z.*, sources.sid, sources.source_size, sources.target, sources.drawn, {mixed(f"((coalesce(doc_id, 0) % {P}) + {P}) % {P}", 5)} % ((SELECT count(*) FROM sized) // {docs_a_bucket} + 1) AS bucket FROM sized z JOIN sources ON sources.source IS NOT DISTINCT FROM z.source),
d1 AS (SELECT *, row_number() OVER () AS rn, CAST(sum(size) OVER (PARTITION BY sid ORDER BY bucket, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS BIGINT) AS start FROM d0),
b AS (SELECT rn, sid, start, size, unnest(range(start // {block}, (start + size - 1) // {block} + 1)) AS block FROM d1 WHERE size > 0),
t AS (SELECT rn, CAST(sum((least(start + size, (b.block + 1) * {block}) - greatest(start, b.block * {block})) * times) AS BIGINT) AS taken FROM b JOIN times ON times.sid = b.sid AND times.block = b.block GROUP BY rn)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, drawn FROM d1 LEFT JOIN t ON t.rn = d1.rn"""
    return made.replace(" div ", " // ")


def spelling_sql(drop: int = 97, letters: int = 5, least: int = 3) -> str:
    """crc32 is folded over the UTF-8 bytes of code points below 256; near words share a spelling with one letter left out."""
    run = f"[A-Za-z\u00c0-\u00ff]{{{letters},}}"
    return f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '{run}')) AS r FROM documents),
r1 AS (SELECT doc_id, translate(r, '{_UPPER}', '{_UPPER.lower()}') AS r, count(*) AS n FROM runs GROUP BY ALL),
r2 AS (SELECT *, flatten(list_transform(string_split(doc_id || ':' || r, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c)::BIGINT >> 6), 128 + (unicode(c)::BIGINT & 63)] END)) AS bytes FROM r1),
r3 AS (SELECT r, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM r2, crc),
r4 AS (SELECT CASE WHEN h % {drop} = 0 THEN left(r, CAST(h % len(r) AS INTEGER)) || substr(r, CAST(h % len(r) AS INTEGER) + 2) ELSE r END AS word, n FROM r3),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM r4 WHERE len(word) >= {letters} GROUP BY word HAVING sum(n) >= {least}),
less AS (SELECT word, n, len(word) AS size, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, CAST(unnest(range(1, len(word) + 1)) AS INTEGER) AS i FROM words)),
near AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.size = b.size AND a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT DISTINCT l.word, l.n, w.word, w.n FROM less l JOIN words w ON w.word = l.rest UNION SELECT DISTINCT w.word, w.n, l.word, l.n FROM less l JOIN words w ON w.word = l.rest),
best AS (SELECT word, n, count(*) AS n_near, max(other_n) AS most FROM near GROUP BY word, n),
form AS (SELECT best.word, min(other) AS form, most AS form_n FROM best JOIN near ON near.word = best.word AND other_n = most WHERE most >= 2 * best.n GROUP BY best.word, most),
chain AS (SELECT word, form AS root FROM form UNION ALL SELECT chain.word, form.form FROM chain JOIN form ON form.word = chain.root),
ends AS (SELECT word, root FROM chain WHERE root NOT IN (SELECT word FROM form))
SELECT words.word, form.form, coalesce(ends.root, words.word) AS root, words.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM words LEFT JOIN best ON best.word = words.word LEFT JOIN form ON form.word = words.word LEFT JOIN ends ON ends.word = words.word"""


def ranked_sql(k: int = 10, b: int = 75) -> str:
    def terms(text: str) -> str:
        return f"regexp_extract_all(translate({text}, '{_UPPER}', '{_UPPER.lower()}'), '[0-9a-z\\x{{80}}-\\x{{10ffff}}]+')"

    return f"""
WITH d0 AS (SELECT row_number() OVER () AS d, doc_id, {terms("text")} AS w FROM documents),
d1 AS (SELECT d, doc_id, CAST(len(w) AS BIGINT) AS n FROM d0 WHERE len(w) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words FROM d1),
d2 AS (SELECT d, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT d, unnest(w) AS term FROM d0) GROUP BY ALL),
i0 AS (SELECT row_number() OVER () AS i, item_id, {terms("text")} AS w FROM benchmark),
i1 AS (SELECT i, item_id, term, count(*) AS q FROM (SELECT i, item_id, unnest(w) AS term FROM i0) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM d2, total WHERE term IN (SELECT term FROM i1) GROUP BY term, docs),
norm AS (SELECT d, doc_id, {100 - b} + ({b} * n * docs) // words AS m FROM d1, total),
s AS (SELECT i, item_id, doc_id, d, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM i1 JOIN weights USING (term) JOIN d2 USING (term) JOIN norm USING (d) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, d) AS INTEGER) AS rank FROM s WHERE score > 0) WHERE rank <= {k}"""
