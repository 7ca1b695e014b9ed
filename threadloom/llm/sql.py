"""DuckDB SQL of those pN_ queries that SQL can express over whole tables."""

from threadloom.plans.problems import SAME_MESSAGE as _SAME

_BASKETS = """
links AS (SELECT DISTINCT m.fragment_id, m.node_id FROM semantic_fragment_node m
          JOIN semantic_fragments f ON f.fragment_id = m.fragment_id JOIN semantic_node s ON s.node_id = m.node_id WHERE s.user_id IS NOT NULL),
totals AS (SELECT user_id, count(*) AS n FROM semantic_fragments GROUP BY user_id),
counts AS (SELECT l.node_id, s.user_id, count(*) AS c FROM links l JOIN semantic_node s USING (node_id) GROUP BY ALL),
pairs AS (SELECT a.node_id AS node_lo, b.node_id AS node_hi, count(*) AS n_common FROM links a JOIN links b ON a.fragment_id = b.fragment_id AND a.node_id < b.node_id GROUP BY ALL),
scored AS (SELECT ca.user_id, p.node_lo, p.node_hi, p.n_common, ca.c AS n_lo, cb.c AS n_hi, t.n AS n_total,
                  ln(p.n_common * t.n / (ca.c::DOUBLE * cb.c)) / -ln(p.n_common / t.n::DOUBLE) AS npmi
           FROM pairs p JOIN counts ca ON ca.node_id = p.node_lo JOIN counts cb ON cb.node_id = p.node_hi AND cb.user_id = ca.user_id JOIN totals t ON t.user_id = ca.user_id
           WHERE p.n_common >= 4 AND p.n_common < t.n)
"""

_TURNS = (
    """
WITH RECURSIVE """
    + _SAME
    + """,
m AS (SELECT c.conversation_uuid, kept.mk, c.msg_index AS idx, c.created_at AS made, c.delivery_id,
        nullif(nullif(lower(replace(replace(replace(trim(c.parent_message_uuid), '-', ''), '{', ''), '}', '')), ''), '00000000000040008000000000000000') AS parent,
        CASE WHEN lower(regexp_replace(c.sender, '^\\s+|\\s+$', '', 'g')) IN ('human', 'user') THEN 0 WHEN lower(regexp_replace(c.sender, '^\\s+|\\s+$', '', 'g')) IN ('assistant', 'model') THEN 1 ELSE -1 END AS role,
        coalesce(length(regexp_replace(c.text, '[\\s\\x{00a0}\\x{0085}\\x{1680}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]', '', 'g')) > 0, false) AS shown
      FROM kept JOIN chat_message c USING (delivery_id) WHERE c.conversation_uuid IS NOT NULL),
conv AS (SELECT conversation_uuid, count(*) AS n, count(parent) AS linked, count(idx) AS n_idx, count(DISTINCT idx) AS d_idx, min(idx) AS lo, max(idx) AS hi,
         count(made) AS n_made, count(DISTINCT made) AS d_made FROM m GROUP BY ALL),
mode AS (SELECT conversation_uuid, n, CASE WHEN linked > 0 THEN CASE WHEN linked = n - 1 THEN 'links' END
         WHEN n_idx = n AND d_idx = n THEN CASE WHEN lo = 0 AND hi = n - 1 THEN 'index' END
         WHEN n_made = n AND d_made = n THEN 'time' END AS mode FROM conv),
tree AS (SELECT m.conversation_uuid, m.mk, 0 AS place, true AS main FROM m JOIN mode USING (conversation_uuid) WHERE mode = 'links' AND parent IS NULL
         UNION ALL
         SELECT h.conversation_uuid, h.mk, t.place + 1, t.main AND h.heir FROM tree t JOIN (
             SELECT conversation_uuid, mk, parent, row_number() OVER (PARTITION BY conversation_uuid, parent ORDER BY made DESC NULLS LAST, delivery_id DESC) = 1 AS heir FROM m WHERE parent IS NOT NULL
         ) h ON h.conversation_uuid = t.conversation_uuid AND h.parent = t.mk),
whole AS (SELECT conversation_uuid FROM tree JOIN mode USING (conversation_uuid) GROUP BY conversation_uuid, n HAVING count(*) = n),
placed AS (SELECT conversation_uuid, mk, place FROM tree SEMI JOIN whole USING (conversation_uuid) WHERE main
           UNION ALL SELECT conversation_uuid, mk, idx FROM m JOIN mode USING (conversation_uuid) WHERE mode = 'index'
           UNION ALL SELECT conversation_uuid, mk, row_number() OVER (PARTITION BY conversation_uuid ORDER BY made) - 1 FROM m JOIN mode USING (conversation_uuid) WHERE mode = 'time'),
good AS (SELECT p.conversation_uuid FROM placed p JOIN m ON m.conversation_uuid = p.conversation_uuid AND m.mk = p.mk GROUP BY ALL
         HAVING bool_and(m.role = p.place % 2 AND m.shown) AND count(*) % 2 = 0)
SELECT conversation_uuid, place::INTEGER AS turn_no,
       CASE WHEN NOT regexp_matches(mk, '^(hash|alone):') THEN regexp_replace(mk, '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') END AS message_uuid
FROM placed SEMI JOIN good USING (conversation_uuid)
"""
)

_SESSIONS = (
    "WITH "
    + _SAME
    + """,
r AS (SELECT c.account_uuid, epoch_us(c.created_at) AS t, c.delivery_id,
        CASE WHEN lower(regexp_replace(c.sender, '^\\s+|\\s+$', '', 'g')) IN ('human', 'user') THEN 0 WHEN lower(regexp_replace(c.sender, '^\\s+|\\s+$', '', 'g')) IN ('assistant', 'model') THEN 1 ELSE -1 END AS role
      FROM kept JOIN chat_message c USING (delivery_id) WHERE c.account_uuid IS NOT NULL AND c.created_at IS NOT NULL),
p AS (SELECT *, t - lag(t) OVER (PARTITION BY account_uuid ORDER BY t, delivery_id) AS pause FROM r),
classes AS (SELECT floor(log2(pause::DOUBLE) * 8 + 1e-9) AS c, count(*)::DOUBLE AS w FROM p WHERE pause > 0 GROUP BY 1),
sides AS (SELECT c, sum(w) OVER (ORDER BY c) AS w0, sum(w * c) OVER (ORDER BY c) AS s0, sum(w) OVER () AS w1, sum(w * c) OVER () AS s1 FROM classes),
best AS (SELECT c FROM sides WHERE w1 > w0 ORDER BY round(w0 * (w1 - w0) * pow(s0 / w0 - (s1 - s0) / (w1 - w0), 2) / pow(w1, 2), 9) DESC, c LIMIT 1),
gap AS (SELECT pow(2.0::DOUBLE, (max(c) + 1) / 8) AS gap FROM best),
s AS (SELECT p.*, sum(CASE WHEN pause IS NULL OR pause > coalesce(gap, 'inf'::DOUBLE) THEN 1 ELSE 0 END) OVER (PARTITION BY account_uuid ORDER BY t, delivery_id) - 1 AS session_no FROM p, gap),
n AS (SELECT *, row_number() OVER w - 1 AS turn_no, max((role = 0)::INT) OVER e AS asks, max((role = 1)::INT) OVER e AS answers FROM s
      WINDOW w AS (PARTITION BY account_uuid, session_no ORDER BY t, delivery_id), e AS (PARTITION BY account_uuid, session_no))
SELECT account_uuid, session_no::BIGINT AS session_no, turn_no::BIGINT AS turn_no, delivery_id, role::TINYINT AS role FROM n WHERE asks = 1 AND answers = 1
"""
)

_TERMS = """
words AS (SELECT fragment_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM semantic_fragments),
tfs AS (SELECT fragment_id, term, count(*) AS tf FROM words GROUP BY fragment_id, term),
counts AS (SELECT *, sum(tf) OVER (PARTITION BY fragment_id) AS dl FROM tfs),
stats AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM counts GROUP BY term),
totals AS (SELECT sum(cf) AS total, (SELECT count(DISTINCT fragment_id) FROM counts) AS n FROM stats),
"""


def _scores(mu: str) -> str:
    return (
        "WITH "
        + _TERMS
        + f"""
smooth AS (SELECT c.*, s.df, s.cf / t.total::DOUBLE AS bg, (c.tf + {mu} * (s.cf / t.total::DOUBLE)) / (c.dl + {mu}) AS p
           FROM counts c JOIN stats s USING (term), totals t WHERE s.df >= 2),
scores AS (SELECT fragment_id, term, tf, df, p * ln(p / bg) AS score FROM smooth)
"""
    )


_NEAR = """
u AS (SELECT fragment_id AS id, embedding::DOUBLE[] AS v FROM semantic_fragments WHERE embedding IS NOT NULL AND len(embedding) = 128
      AND len(list_filter(embedding, lambda x : x IS NOT NULL AND isfinite(x::DOUBLE))) = 128 AND list_sum(list_transform(embedding, lambda x : abs(x))) > 0),
near AS (SELECT q.id AS query_id, o.id AS other_id, list_cosine_similarity(q.v, o.v) AS cosine, row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.v, o.v) DESC, o.id) AS place
         FROM u q JOIN u o ON q.id <> o.id WHERE q.id IN (SELECT fragment_id FROM asked) QUALIFY place <= 10)
"""

# NaN is tested as text: the engine takes isnan of a column from file statistics, which leave NaN out.
_WALK = """WITH RECURSIVE hits AS (
  SELECT search_id, fragment_id, CASE WHEN score::VARCHAR <> 'nan' THEN score::DOUBLE END AS s0, NULL::DOUBLE AS s1, NULL::DOUBLE AS s2 FROM lexical_hit
  UNION ALL SELECT search_id, fragment_id, NULL, CASE WHEN score::VARCHAR <> 'nan' THEN score END, CASE WHEN npmi::VARCHAR <> 'nan' THEN npmi END FROM graph_hit),
items AS (SELECT search_id, fragment_id, max(s0) AS s0, max(s1) AS s1, max(s2) AS s2 FROM hits WHERE search_id IS NOT NULL AND fragment_id IS NOT NULL GROUP BY ALL),
sizes AS (SELECT search_id, count(*) AS n FROM items GROUP BY ALL),
long AS (SELECT search_id, fragment_id, unnest([0, 1, 2]) AS s, unnest([s0, s1, s2]) AS v FROM items),
tops AS (SELECT search_id, s, max(v) AS top FROM long GROUP BY ALL),
steps AS (SELECT a.search_id, a.s, a.fragment_id AS i, b.fragment_id AS j FROM long a JOIN tops t USING (search_id, s) JOIN long b ON b.search_id = a.search_id AND b.s = a.s
          WHERE CASE WHEN t.top IS NULL OR a.v = t.top THEN true WHEN a.v IS NULL THEN b.v IS NOT NULL ELSE b.v >= a.v END),
reach AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY search_id, s, i) / 3 AS p FROM steps),
chance AS (SELECT search_id, i, j, sum(p) AS p FROM reach GROUP BY ALL),
walk AS (SELECT 0 AS step, search_id, fragment_id, 1.0::DOUBLE / n AS x FROM items JOIN sizes USING (search_id)
         UNION ALL
         SELECT w.step + 1, w.search_id, c.j, 0.5::DOUBLE / any_value(z.n) + 0.5::DOUBLE * sum(w.x * c.p) FROM walk w JOIN chance c ON c.search_id = w.search_id AND c.i = w.fragment_id JOIN sizes z ON z.search_id = w.search_id
         WHERE w.step < 30 GROUP BY w.step, w.search_id, c.j),
-- items nobody steps to have the restart's share alone
final AS (SELECT i.search_id, i.fragment_id, coalesce(w.x, 0.5::DOUBLE / z.n) AS weight FROM items i JOIN sizes z USING (search_id) LEFT JOIN (SELECT * FROM walk WHERE step = 30) w USING (search_id, fragment_id))
"""

ORACLE = {
    "p4_found": _WALK + "SELECT search_id, fragment_id FROM final QUALIFY row_number() OVER (PARTITION BY search_id ORDER BY round(weight, 12) DESC, fragment_id) <= 3",
    "p4_ranking": _WALK + "SELECT search_id, fragment_id, round(weight, 9) AS weight FROM final",
    # exact neighbours; at the size of the comparison every list is probed, so the index loses none
    "p7_found": "WITH asked AS (SELECT fragment_id FROM fragment_probe WHERE purpose = 'neighbour')," + _NEAR + "SELECT DISTINCT least(query_id, other_id) AS fragment_lo, greatest(query_id, other_id) AS fragment_hi FROM near",
    "p7_neighbours": "WITH asked AS (SELECT fragment_id FROM semantic_fragments WHERE fragment_id % 100 = 0)," + _NEAR + "SELECT query_id, place::INTEGER AS place, other_id, round(cosine, 5) AS cosine FROM near",
    "p1_found": _TURNS,
    "p1_sessions": _SESSIONS,
    "p2_found": "WITH " + _BASKETS + "SELECT node_lo, node_hi FROM scored WHERE npmi >= 0.51",
    "p2_associations": "WITH " + _BASKETS + "SELECT user_id, node_lo, node_hi, n_common, n_lo, n_hi, n_total, round(npmi, 6) AS npmi FROM scored WHERE npmi >= 0.51",
    "p3_found": _scores("2000.0")
    + """SELECT fragment_id, arg_max(term, score) AS term FROM scores WHERE fragment_id IN (SELECT fragment_id FROM fragment_probe WHERE purpose = 'keyword') GROUP BY fragment_id""",
    "p3_scores": _scores("50.0") + "SELECT fragment_id, term, tf, df, round(score, 6) AS score FROM scores",
    "p8_round_trip": "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents",
}
