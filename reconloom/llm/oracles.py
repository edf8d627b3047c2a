"""DuckDB SQL for the queries that SQL can express."""

#: Lower-cases A-Z only.
_NORMAL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DEDUP_SQL = f"""
WITH d AS (SELECT doc_id, {_NORMAL} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""

MIX_SQL = r"""
WITH b AS (
  SELECT doc_id, source, coalesce('v' || source, 'n') AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
h AS (SELECT *, md5('mix0|' || coalesce(doc_id::VARCHAR, '') || '|' || size) AS h FROM b),
n AS (SELECT k, greatest(1, least(4096, count(*) // 512)) AS shards FROM b GROUP BY k),
base AS (SELECT h.*, (('0x' || substr(h, 1, 8))::BIGINT % shards)::INT AS shard FROM h JOIN n ON h.k = n.k),
sh AS (SELECT k, any_value(source) AS source, shard, sum(size)::BIGINT AS votes FROM base GROUP BY k, shard),
so AS (SELECT k, any_value(source) AS source, sum(votes)::BIGINT AS source_size FROM sh GROUP BY k),
w AS (
  SELECT *, 3 * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS total,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight
  FROM so),
r AS (
  SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest,
         (sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weights
  FROM w),
f AS (SELECT arg_min(rest, struct_pack(a := cap / weight, b := k)) AS fl, arg_min(weights, struct_pack(a := cap / weight, b := k)) AS fw FROM r WHERE NOT rest * weight > cap * weights),
t AS (
  SELECT r.*, CASE WHEN rest * weight > cap * weights OR fl IS NULL THEN cap::DOUBLE ELSE (fl * weight) / fw END AS target,
         greatest(1, ceil(total / 16777216))::BIGINT AS block
  FROM r, f),
p AS (
  SELECT *, floor(total / block)::BIGINT AS seats, sum(target) OVER () AS vv, sum(CASE WHEN target > 0 THEN 1 ELSE 0 END) OVER () AS nn FROM t),
q AS (
  SELECT *, CASE WHEN target > 0 THEN greatest(0, floor(target * (seats - nn / 2) / vv + 0.5) - 1) ELSE 0 END::BIGINT AS low,
         CASE WHEN target > 0 THEN floor(target * (seats + nn / 2) / vv + 0.5) + 1 ELSE 0 END::BIGINT AS high
  FROM p),
q2 AS (SELECT *, seats - (sum(low) OVER ())::BIGINT AS open FROM q),
won AS (
  SELECT k, count(*) AS won FROM (
    SELECT k, open, row_number() OVER (ORDER BY target / (2 * i + 1) DESC, k, i) AS rk
    FROM (SELECT k, open, target, unnest(range(low, high)) AS i FROM q2))
  WHERE rk <= open GROUP BY k),
quota AS (SELECT q2.k, source_size, target, block, low + coalesce(won, 0) AS blocks FROM q2 LEFT JOIN won ON q2.k = won.k),
s1 AS (
  SELECT sh.k, sh.shard, sh.votes, source_size, target, block, blocks,
         sum(votes::DOUBLE) OVER (PARTITION BY sh.k) AS vv, sum(CASE WHEN votes > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY sh.k) AS nn
  FROM sh JOIN quota ON sh.k = quota.k),
s2 AS (
  SELECT *, CASE WHEN votes > 0 THEN greatest(0, floor(votes::DOUBLE * (blocks - nn / 2) / vv + 0.5) - 1) ELSE 0 END::BIGINT AS low,
         CASE WHEN votes > 0 THEN floor(votes::DOUBLE * (blocks + nn / 2) / vv + 0.5) + 1 ELSE 0 END::BIGINT AS high
  FROM s1),
s3 AS (SELECT *, blocks - (sum(low) OVER (PARTITION BY k))::BIGINT AS open FROM s2),
won2 AS (
  SELECT k, shard, count(*) AS won FROM (
    SELECT k, shard, open, row_number() OVER (PARTITION BY k ORDER BY votes / (2 * i + 1) DESC, shard, i) AS rk
    FROM (SELECT k, shard, open, votes, unnest(range(low, high)) AS i FROM s3))
  WHERE rk <= open GROUP BY k, shard),
pl AS (
  SELECT s3.k, s3.shard, source_size, target, votes, least((low + coalesce(won, 0)) * block, 3 * votes) AS quota
  FROM s3 LEFT JOIN won2 ON s3.k = won2.k AND s3.shard = won2.shard),
pa AS (SELECT *, CASE WHEN votes > 0 THEN quota // votes ELSE 0 END AS passes FROM pl),
c AS (
  SELECT base.*, sum(size) OVER (PARTITION BY k, shard ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM base)
SELECT c.doc_id, c.size, pa.source_size, pa.target,
       (passes * size + greatest(0, least(size, quota - passes * votes - (e - size))))::BIGINT AS taken
FROM c JOIN pa ON c.k = pa.k AND c.shard = pa.shard
"""

TOP_K_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.row, q.vec_id AS query_id, d.vec_id, list_dot_product(q.w, d.w)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND d.row <> q.row AND len(q.w) = len(d.w)),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

FIM_SQL = r"""
WITH b AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS y,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM b),
p AS (
  SELECT *, array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


def cluster_sql(k: int = 8, rounds: int = 10) -> str:
    """Centroid clustering: a pair of tables for each round, then the last assignment."""
    parts = [
        """v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, w) - 1 AS c, w FROM (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h, w FROM v ORDER BY h, w LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (
  SELECT r, min(d) AS d, arg_min(c, struct_pack(d := d, c := c)) AS c FROM (
    SELECT v.r, z.c, list_sum(list_transform(range(1, 65), lambda j: (v.w[j] - z.w[j]) * (v.w[j] - z.w[j])))::BIGINT AS d FROM v, c{i} z) GROUP BY r)"""
        )
        if i < rounds:
            parts.append(
                f"""m{i} AS (
  SELECT c, list(m ORDER BY j) AS w FROM (
    SELECT c, j, ((sum(x) - (((sum(x) % count(*)) + count(*)) % count(*))) // count(*))::BIGINT AS m
    FROM (SELECT a.c, unnest(v.w) AS x, unnest(range(1, 65)) AS j FROM v JOIN a{i} a ON v.r = a.r) GROUP BY c, j) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT z.c, coalesce(m{i}.w, z.w) AS w FROM c{i} z LEFT JOIN m{i} ON z.c = m{i}.c)"""
            )
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT v.vec_id, a.c::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(z.w, ',')) AS centroid_sha256
FROM v JOIN a{rounds} a ON v.r = a.r JOIN c{rounds} z ON z.c = a.c"""
    )
