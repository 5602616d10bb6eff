"""The same results in plain SQL, for the queries that SQL can express."""

OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), i AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), links AS (
  SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), reach AS (
  SELECT DISTINCT x AS node, x AS root FROM links
  UNION SELECT l.y, r.root FROM reach r JOIN links l ON l.x = r.node
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
LEFT JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) r ON r.node = d.doc_id
"""

OP3 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || doc_id || ':' || md5(coalesce(text, ''))) AS ord
  FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), placed AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place, 2.0::DOUBLE * source_size AS room FROM sums
), weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM placed
), levels AS (
  SELECT *, row_number() OVER (ORDER BY room / weight, place) AS room_at,
         (sum(source_size) OVER () * 1.5::DOUBLE
          - coalesce(sum(room) OVER (ORDER BY room / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
         / sum(weight) OVER (ORDER BY room / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), first AS (
  SELECT min_by(level, room_at) AS level FROM levels WHERE level * weight < room
), targets AS (
  SELECT l.source, l.source_size, CASE WHEN f.level IS NULL THEN room ELSE least(room, f.level * weight) END AS target
  FROM levels l, first f
), laid AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (least(greatest(round(target) - before, 0), size)
        + least(greatest(round(target) - before - source_size, 0), size))::BIGINT AS taken
FROM laid
"""

OP8 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (w ORDER BY doc_id DESC) = 1 AS kept, text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
WINDOW w AS (PARTITION BY text_sha256)
"""


def _escaped(text: str) -> str:
    out = f"replace(coalesce({text}, ''), '\\', '\\\\')"
    for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]"):
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP10 = f"""
WITH rows_ AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text), '')) AS loss_sha256,
       sum(8 + length(replace({_escaped("role")}, chr(10), '\\' || chr(10))) + 1 + length({_escaped("text")}) + 7)::BIGINT AS formatted_chars
FROM rows_ GROUP BY conv_id
"""

OP2 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p
), r AS (
  SELECT *, first_value(page_id) OVER w AS first_id, row_number() OVER w AS place
  FROM d WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST)
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND place > 1 THEN first_id END AS refers_to
FROM r
"""

OP11 = r"""
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM documents
), tf AS (
  SELECT doc_id, t, count(*) AS tf FROM w GROUP BY doc_id, t
), d AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id
), c AS (
  SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM d
), m AS (
  SELECT doc_id, 100 - 75 + (75 * n * big_n) // big_l AS m FROM d, c
), q AS (
  SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark) GROUP BY item_id, t
), df AS (
  SELECT t, count(*) AS df FROM tf WHERE t IN (SELECT t FROM q) GROUP BY t
), wt AS (
  SELECT t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, c
), s AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN wt USING (t) JOIN tf USING (t) JOIN m USING (doc_id) GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0
QUALIFY rank <= 10
"""


def _op13(k: int = 16, rounds: int = 3, dims: int = 64) -> str:
    """Full scans in each round: all vectors with all centroids."""
    apart = "list_sum(list_transform(range(1, len(e.v) + 1), lambda i: (e.v[i] - c.v[i]) * (e.v[i] - c.v[i])))::BIGINT"
    steps = [
        f"""e AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dims}
), c0 AS (
  SELECT c, v FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM e) WHERE c < {k}
)"""
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS (SELECT e.r, min(struct_pack(d := {apart}, c := c.c)) AS m FROM e, c{i} AS c GROUP BY e.r)")
        if i < rounds:
            steps.append(f"""s{i} AS (
  SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n
  FROM (SELECT a.m.c AS c, unnest(e.v) AS x, unnest(range(1, {dims} + 1)) AS i FROM a{i} AS a JOIN e ON e.r = a.r) GROUP BY c, i
), c{i + 1} AS (
  SELECT c.c, coalesce(n.v, c.v) AS v
  FROM c{i} AS c LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{i} GROUP BY c) AS n ON n.c = c.c
)""")
    return f"""
WITH {", ".join(steps)}
SELECT e.vec_id, a.m.c::INTEGER AS cluster, a.m.d AS distance, sum(a.m.d) OVER (PARTITION BY a.m.c)::BIGINT AS cluster_inertia,
       sum(a.m.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN e ON e.r = a.r JOIN c{rounds} AS c ON c.c = a.m.c
"""


ORACLE = {"op1_ngram_jaccard_join": OP1, "op2_warc": OP2, "op3_source_mixing": OP3, "op8_exact_dedup": OP8, "op10_chat_formatting": OP10, "op11_sketch_search": OP11, "op13_heap_clusters": _op13()}
