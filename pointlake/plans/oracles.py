"""The registered queries as plain SQL over the same tables."""

from __future__ import annotations

_POINTS = """
points AS (
  SELECT CAST(label % 4 AS BIGINT) AS shard, CAST(label AS BIGINT) AS root_id, vec_id AS pid,
         embedding[1] AS x, embedding[2] AS y, embedding[3] AS z, embedding
  FROM embeddings)
"""

_EDGES = (
    _POINTS
    + """,
pairs AS (
  SELECT a.shard, a.root_id, a.pid, b.pid AS neighbour,
         (CAST(a.x AS DOUBLE) - CAST(b.x AS DOUBLE)) * (CAST(a.x AS DOUBLE) - CAST(b.x AS DOUBLE))
       + (CAST(a.y AS DOUBLE) - CAST(b.y AS DOUBLE)) * (CAST(a.y AS DOUBLE) - CAST(b.y AS DOUBLE))
       + (CAST(a.z AS DOUBLE) - CAST(b.z AS DOUBLE)) * (CAST(a.z AS DOUBLE) - CAST(b.z AS DOUBLE)) AS d
  FROM points a JOIN points b ON a.root_id = b.root_id AND a.pid <> b.pid),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY root_id, pid ORDER BY d, neighbour) AS r FROM pairs),
edges AS (
  SELECT DISTINCT shard, root_id, least(pid, neighbour) AS src, greatest(pid, neighbour) AS dst
  FROM ranked WHERE r <= 3)
"""
)

# Rounds of merges over (round, root_id, pid, cluster), as agglomerate() defines them.
_WARD_WEIGHTS = """
        cells AS (SELECT c.cluster, v.i, avg(v.v) AS m FROM cur c JOIN cell v ON v.pid = c.pid GROUP BY ALL),
        sizes AS (SELECT cluster, count(*) AS n FROM cur GROUP BY ALL),
        links AS (
          SELECT DISTINCT least(a.cluster, b.cluster) AS a, greatest(a.cluster, b.cluster) AS b
          FROM edges e JOIN cur a ON a.pid = e.src JOIN cur b ON b.pid = e.dst WHERE a.cluster <> b.cluster),
        weighed AS (
          SELECT l.a, l.b, sqrt(2.0 * s.n * t.n / (s.n + t.n) * sum((x.m - y.m) * (x.m - y.m))) AS w
          FROM links l JOIN cells x ON x.cluster = l.a JOIN cells y ON y.cluster = l.b AND y.i = x.i
          JOIN sizes s ON s.cluster = l.a JOIN sizes t ON t.cluster = l.b GROUP BY l.a, l.b, s.n, t.n)
"""
_COSINE_WEIGHTS = """
        weighed AS (
          SELECT least(a.cluster, b.cluster) AS a, greatest(a.cluster, b.cluster) AS b, max(e.w) AS w
          FROM apart e JOIN cur a ON a.pid = e.src JOIN cur b ON b.pid = e.dst WHERE a.cluster <> b.cluster GROUP BY ALL)
"""


def _merged(weights: str, threshold: float, votes: int = 1) -> str:
    return f"""
      WITH RECURSIVE {_EDGES},
      cell AS (
        SELECT pid, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS i FROM points),
      length AS (SELECT pid, sqrt(sum(v * v)) AS n FROM cell GROUP BY pid),
      apart AS (
        SELECT e.src, e.dst, 0.5 * sum((a.v / p.n - b.v / q.n) * (a.v / p.n - b.v / q.n)) AS w
        FROM edges e JOIN cell a ON a.pid = e.src JOIN cell b ON b.pid = e.dst AND b.i = a.i
        JOIN length p ON p.pid = e.src JOIN length q ON q.pid = e.dst GROUP BY e.src, e.dst),
      turns AS (
        SELECT 0 AS turn, shard, root_id, pid, pid AS cluster FROM points
        UNION ALL
        (WITH cur AS (SELECT * FROM turns),
        {weights},
        near AS (
          SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY w, dst) AS r
          FROM (SELECT a AS src, b AS dst, w FROM weighed UNION ALL SELECT b, a, w FROM weighed) WHERE w < {threshold}),
        proposals AS (
          SELECT least(src, dst) AS keep, greatest(src, dst) AS gone, count(*) AS votes FROM near WHERE r = 1 GROUP BY ALL HAVING count(*) >= {votes}),
        ranked AS (
          SELECT keep, gone, CASE votes WHEN 2 THEN 0 ELSE 1 + ((keep % 1000003) * 7919 + (gone % 1000003) * 104729
                   + (SELECT max(turn) FROM cur) * 15485863) % 1000003 END AS p FROM proposals),
        picks AS (
          SELECT keep, gone, row_number() OVER (PARTITION BY node ORDER BY p, keep, gone) AS r
          FROM (SELECT keep AS node, * FROM ranked UNION ALL SELECT gone AS node, * FROM ranked)),
        merges AS (SELECT keep, gone FROM picks WHERE r = 1 GROUP BY ALL HAVING count(*) = 2)
        SELECT c.turn + 1, c.shard, c.root_id, c.pid, coalesce(m.keep, c.cluster)
        FROM cur c LEFT JOIN merges m ON m.gone = c.cluster WHERE EXISTS (SELECT 1 FROM merges))),
      merged AS (SELECT shard, root_id, pid, cluster FROM turns WHERE turn = (SELECT max(turn) FROM turns))
    """


def _condensed_sql(weights: str, threshold: float, votes: int = 1) -> str:
    return f"""
      {_merged(weights, threshold, votes)},
      centres AS (
        SELECT m.cluster, avg(CAST(x AS DOUBLE)) AS mx, avg(CAST(y AS DOUBLE)) AS my, avg(CAST(z AS DOUBLE)) AS mz,
               avg(CAST(embedding[1] AS DOUBLE)) AS first
        FROM merged m JOIN points p ON p.pid = m.pid GROUP BY m.cluster),
      placed AS (
        SELECT m.shard, m.root_id, m.cluster, p.x, p.y, p.z, c.first,
               row_number() OVER (PARTITION BY m.cluster ORDER BY
                 round(sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)), 9), p.pid) AS r
        FROM merged m JOIN points p ON p.pid = m.pid JOIN centres c ON c.cluster = m.cluster)
      SELECT shard, root_id, row_number() OVER (PARTITION BY root_id ORDER BY cluster) - 1 AS condensed_id,
             round(CAST(x AS DOUBLE), 5) AS x, round(CAST(y AS DOUBLE), 5) AS y, round(CAST(z AS DOUBLE), 5) AS z,
             round(CAST(CAST(first AS FLOAT) AS DOUBLE), 4) AS first
      FROM placed WHERE r = 1
    """


_WARD = _condensed_sql(_WARD_WEIGHTS, 1.6)

_SYNAPSES = """
synapses AS (
  SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey AS x, l_suppkey AS y, l_orderkey AS z,
         l_quantity AS size, CAST(l_returnflag = 'R' AS BIGINT) AS reviewed
  FROM lineitem),
segments AS (
  SELECT o_orderkey * 8 + 1 AS id, o_custkey AS pt_root_id, o_totalprice AS size FROM orders),
lake AS (
  SELECT s.id, g.pt_root_id, g.pt_root_id % 16 AS pt_root_id_partition, s.x, s.y, s.z, s.size,
         g.size AS size_right, s.reviewed
  FROM synapses s LEFT JOIN segments g ON s.id = g.id)
"""

_TOPK = """
SELECT v.vec_id, round(sqrt(sum((CAST(v.e AS DOUBLE) - CAST(q.e AS DOUBLE)) * (CAST(v.e AS DOUBLE) - CAST(q.e AS DOUBLE)))), 5)
         AS distance
FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings) v
JOIN (SELECT unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings
      WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) q ON v.i = q.i
GROUP BY v.vec_id
ORDER BY sum((CAST(v.e AS DOUBLE) - CAST(q.e AS DOUBLE)) * (CAST(v.e AS DOUBLE) - CAST(q.e AS DOUBLE))), v.vec_id
LIMIT 100
"""

_SIZES = """
sizes AS (
  SELECT 'text' AS format, CAST(sum(strlen(text)) AS BIGINT) AS size_bytes FROM documents
  UNION ALL SELECT 'lang', CAST(sum(strlen(lang)) AS BIGINT) FROM documents
  UNION ALL SELECT 'source', CAST(sum(strlen(source)) AS BIGINT) FROM documents)
"""

ORACLES: dict[str, str] = {
    "csv_dump_scan": """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
               strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority,
               CAST(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 0 ELSE -1 END AS BIGINT) AS is_open
        FROM orders""",
    "left_join_enrich": """
        SELECT s.id, s.part_id, s.size, coalesce(g.pt_root_id, -1) AS pt_root_id, g.size AS size_right
        FROM (SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey AS part_id, l_quantity AS size FROM lineitem) s
        LEFT JOIN (SELECT o_orderkey * 8 + 1 AS id, o_custkey AS pt_root_id, o_totalprice AS size FROM orders) g
          ON s.id = g.id""",
    "id_partition": """
        SELECT l_orderkey, l_linenumber, coalesce(id, -1000000) AS id,
               coalesce(((id % 64) + 64) % 64, -1) AS id_partition
        FROM (SELECT l_orderkey, l_linenumber,
                     CASE WHEN l_linenumber <> 7 THEN l_partkey - 1000 END AS id FROM lineitem)""",
    "wkb_decode": """
        SELECT l_orderkey, l_partkey AS x, CAST(trunc(l_extendedprice) AS BIGINT) AS y, -l_suppkey AS z FROM lineitem""",
    "partitioned_lookup": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
        WHERE l_partkey IN (3, 77, 500, 1024, 1999)""",
    "zorder_rows": "SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice FROM lineitem",
    "zorder_merged": "SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice FROM lineitem",
    "dump_lake_rows": f"""
        WITH {_SYNAPSES}
        SELECT id, coalesce(pt_root_id, -1) AS pt_root_id, coalesce(pt_root_id_partition, -1) AS pt_root_id_partition, x, y, z, size, size_right, reviewed FROM lake""",
    "dump_lake_groups": f"""
        WITH {_SYNAPSES}
        SELECT pt_root_id, count(*) AS len FROM lake
        WHERE pt_root_id IN (SELECT unnest(range(0, 1000, 3)))
        GROUP BY pt_root_id HAVING count(*) > 1 AND count(*) < 1000""",
    "group_having": """
        SELECT l_partkey, count(*) AS len FROM lineitem WHERE l_returnflag = 'R'
        GROUP BY l_partkey HAVING count(*) > 8 AND count(*) < 15""",
    "limit_slice": """
        SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100""",
    "sort_rows": "SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_size, p_partkey",
    "mean_vector": """
        SELECT label, CAST(pos AS BIGINT) AS pos, round(CAST(CAST(avg(CAST(v AS DOUBLE)) AS FLOAT) AS DOUBLE), 5) AS value
        FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
        WHERE pos < 32 GROUP BY label, pos""",
    "mean_vector_nulls": """
        SELECT label, CAST(pos AS BIGINT) AS pos, round(CAST(CAST(avg(CAST(v AS DOUBLE)) AS FLOAT) AS DOUBLE), 5) AS value
        FROM (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
        WHERE pos < 32 AND (vec_id + pos) % 7 <> 0 GROUP BY label, pos""",
    "gzip_dump_scan": """
        SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN 'no note'
                 ELSE p_brand || ', "' || p_type || '"' || chr(10) || p_partkey END AS note, CAST(p_size AS BIGINT) AS p_size
        FROM part""",
    "replaced_tables": """
        WITH rows AS (SELECT l_partkey, l_quantity, l_partkey % 16 AS p, l_linenumber AS n FROM lineitem),
        ways AS (
          SELECT 'table' AS way, * FROM rows WHERE p < 3 AND n = 1
          UNION ALL SELECT 'z-order', * FROM rows WHERE p < 3 AND n = 1
          UNION ALL SELECT 'partitions', * FROM rows WHERE p >= 3 OR n = 1)
        SELECT way, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS keys, round(sum(l_quantity), 2) AS quantity
        FROM ways GROUP BY way""",
    "ann_recall": """
        WITH far AS (
          SELECT q.vec_id AS query_id, v.vec_id, round(list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS distance
          FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM far)
        SELECT query_id, rank, vec_id, round(distance, 4) AS distance, true AS enough FROM ranked WHERE rank <= 10""",
    "ann_maintained": """
        WITH far AS (
          SELECT q.vec_id AS query_id, v.vec_id, round(list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS distance
          FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM far)
        SELECT query_id, rank, vec_id, round(distance, 4) AS distance FROM ranked WHERE rank <= 10""",
    "ann_ivf": "SELECT vec_id AS query_id, 10 AS n, CAST(0 AS DOUBLE) AS least FROM embeddings WHERE vec_id % 100 = 0",
    "relabel_mapping": """
        SELECT l_returnflag, count(DISTINCT l_suppkey) AS labels, count(DISTINCT l_suppkey) AS names,
               count(DISTINCT l_suppkey) AS pairs, count(DISTINCT l_suppkey) AS known, true AS moved
        FROM lineitem GROUP BY l_returnflag""",
    "centroid_rep_point": f"""
        WITH {_POINTS},
        means AS (
          SELECT root_id, avg(CAST(x AS DOUBLE)) AS mx, avg(CAST(y AS DOUBLE)) AS my, avg(CAST(z AS DOUBLE)) AS mz
          FROM points GROUP BY root_id),
        ranked AS (
          SELECT p.root_id, pid, x, y, z, row_number() OVER (
                   PARTITION BY p.root_id
                   ORDER BY round(sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)), 9), pid) AS r
          FROM points p JOIN means m ON p.root_id = m.root_id)
        SELECT root_id, pid, round(CAST(x AS DOUBLE), 5) AS x, round(CAST(y AS DOUBLE), 5) AS y,
               round(CAST(z AS DOUBLE), 5) AS z
        FROM ranked WHERE r = 1""",
    "group_dist": f"""
        WITH {_POINTS},
        means AS (
          SELECT root_id, avg(CAST(x AS DOUBLE)) AS mx, avg(CAST(y AS DOUBLE)) AS my FROM points GROUP BY root_id)
        SELECT pid, round(sqrt((x - mx) * (x - mx) + (y - my) * (y - my)), 5) AS dist_to_mean
        FROM points p JOIN means m ON p.root_id = m.root_id""",
    "topk_l2": _TOPK,
    "ann_full_probe": _TOPK,
    "knn_edges": f"WITH {_EDGES} SELECT shard, root_id, src, dst FROM edges",
    "small_object_edges": f"""
        WITH {_POINTS},
        small AS (
          SELECT shard, pid, CAST(floor(pid / 4) AS BIGINT) * 4
                   + least(pid % 4, CAST(floor(pid / 4) AS BIGINT) % 4) AS root_id FROM points)
        SELECT a.shard, a.root_id, a.pid AS src, b.pid AS dst
        FROM small a JOIN small b ON a.shard = b.shard AND a.root_id = b.root_id AND a.pid < b.pid""",
    "components": f"""
        WITH RECURSIVE {_EDGES},
        linked AS (
          SELECT root_id, src, dst FROM edges UNION ALL SELECT root_id, dst, src FROM edges),
        reach AS (
          SELECT root_id, pid, pid AS node FROM points
          UNION SELECT r.root_id, r.pid, l.dst FROM reach r JOIN linked l ON r.root_id = l.root_id AND r.node = l.src)
        SELECT p.shard, p.root_id, p.pid, min(r.node) AS component
        FROM points p JOIN reach r ON p.root_id = r.root_id AND p.pid = r.pid
        GROUP BY p.shard, p.root_id, p.pid""",
    "condense_ward": _WARD,
    "condense_ward_mutual": _condensed_sql(_WARD_WEIGHTS, 1.6, votes=2),
    "condense_ward_joins": _WARD,
    "condense_cosine": _condensed_sql(_COSINE_WEIGHTS, 0.8),
    "agglomerate_ratio": f"""
        {_merged(_WARD_WEIGHTS, 1.6)}
        SELECT count(DISTINCT cluster) / count(*) AS ratio FROM merged""",
    "condensation_cover": f"""
        WITH {_POINTS}
        SELECT shard, root_id, count(*) AS n_points, round(sum(CAST(x AS DOUBLE)), 5) AS sum_x,
               CAST(0 AS BIGINT) AS gaps
        FROM points GROUP BY shard, root_id""",
    "sample_per_group": f"""
        WITH {_POINTS}
        SELECT root_id, pid FROM (
          SELECT root_id, pid, row_number() OVER (
                   PARTITION BY root_id ORDER BY (pid * 7919 + 104729) % 1000003, pid) AS r
          FROM points) WHERE r <= 20""",
    "relabel": """
        SELECT l_returnflag, n, count(*) AS labels
        FROM (SELECT l_returnflag, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)
        GROUP BY l_returnflag, n""",
    "pca_facts": """
        SELECT round(sum(v), 5) AS variance, true AS falling, true AS uncorrelated
        FROM (SELECT i, var_pop(v) AS v FROM (
                SELECT CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)
              GROUP BY i)""",
    "pca_full_norm": """
        WITH cells AS (
          SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
        means AS (SELECT i, avg(v) AS m FROM cells GROUP BY i)
        SELECT vec_id, round(sqrt(sum((v - m) * (v - m))), 5) AS length
        FROM cells JOIN means USING (i) GROUP BY vec_id""",
    "sum_squares": "SELECT CAST(sum(l_partkey * l_partkey) AS BIGINT) AS sum_squares FROM lineitem",
    "array_stats": """
        SELECT vec_id, round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS std, round(sum(v), 5) AS sum,
               count(*) AS size
        FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY vec_id""",
    "remaining_items": """
        SELECT o_orderkey AS item FROM orders
        WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
    "fanout_status": """
        SELECT o_orderkey AS item, CASE WHEN o_orderkey % 10 IN (3, 5, 7) THEN 'failed' ELSE 'ok' END AS status,
               CASE WHEN o_orderkey % 10 NOT IN (3, 5, 7) THEN o_orderkey * o_orderkey ELSE -1 END AS result,
               CASE WHEN o_orderkey % 10 IN (3, 5, 7) THEN 'ValueError: item ' || o_orderkey END AS error
        FROM orders""",
    "unpivot_sizes": f"WITH {_SIZES} SELECT format, size_bytes FROM sizes",
    "projected_size": f"""
        WITH {_SIZES}
        SELECT format, round(size_bytes * (50000 / 8.0) / (1024.0 * 1024 * 1024), 6) AS projected_size_gigabytes
        FROM sizes""",
    "union_distinct": """
        SELECT l_partkey AS part_id FROM lineitem UNION SELECT p_partkey FROM part""",
    "distinct_ratio": """
        SELECT round(count(DISTINCT (l_partkey, l_suppkey)) / count(*), 6) AS ratio FROM lineitem""",
    "pack_coords": """
        SELECT l_orderkey, CAST(1 AS BIGINT) AS shard, concat_ws('|', l_partkey, l_suppkey, l_linenumber) AS point
        FROM lineitem""",
    "name_to_id": """
        SELECT url, CAST(split_part(split_part('/shards/3/' || page_id || '.csv', '/', 4), '.', 1) AS BIGINT) AS page_id
        FROM pages""",
    "zip_shard_points": f"""
        WITH {_POINTS}
        SELECT shard, root_id, row_number() OVER (PARTITION BY shard, root_id ORDER BY pid) - 1 AS pid,
               pid AS node_id, round(CAST(x AS DOUBLE), 5) AS x, round(CAST(embedding[64] AS DOUBLE), 5) AS last
        FROM points""",
    "shard_metrics": f"""
        WITH {_POINTS}
        SELECT shard, CAST(1 AS BIGINT) AS has_bytes, count(DISTINCT root_id) AS n_objects, count(*) AS n_points
        FROM points GROUP BY shard""",
    "storage_bytes": """
        SELECT format, true AS same_bytes, true AS projected
        FROM (VALUES ('zipped_csv'), ('raw'), ('condensed'), ('maps')) f(format)""",
    "shards_lake_points": f"""
        WITH {_POINTS}
        SELECT shard, root_id, count(*) AS n FROM points GROUP BY shard, root_id""",
}
