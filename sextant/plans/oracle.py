"""DuckDB statements equal to the registered queries (same column names and rounding).

They are the correctness oracle: written independently in plain SQL over
the same parquet views (windows, joins, recursive CTEs for components), not
generated from the Spark plans.
"""

from __future__ import annotations

from sextant.plans import queries as Qy
from sextant.operators.density import iter_dbscan_rounds
from sextant.operators.evaluate import EOS, SCORER_VOCAB


def _dbl(x: float) -> str:
    """An exact double literal (shortest round-trip text)."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


#: White space of Unicode and four control characters, as a range list for a regular expression.
SPACES = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# ---------------------------------------------------------------- shared CTE builders

def tokens_ctes(src_sql: str) -> str:
    """CTEs ``src(id, text)`` .. ``tok(id, i, text, pos, dep, head)``: the rule annotator."""
    return rf"""
src AS ({src_sql}),
sent0 AS (SELECT id, regexp_split_to_array(text, '[.!?\n]') AS arr FROM src),
sent AS (SELECT id, unnest(arr) AS sent, unnest(range(len(arr))) AS si FROM sent0),
wrd0 AS (SELECT id, si, regexp_split_to_array(sent, '\s+') AS arr FROM sent),
wrd AS (SELECT id, si, unnest(arr) AS w, unnest(range(len(arr))) AS wi FROM wrd0),
tok1 AS MATERIALIZED (
  SELECT id, si, text, (row_number() OVER (PARTITION BY id ORDER BY si, wi) - 1)::INT AS i,
         CASE WHEN length(text) >= 5 AND regexp_matches(lower(text), '(ing|ed|er|ir|ar|en)$') THEN 'VERB'
              WHEN length(text) >= 5 AND regexp_matches(lower(text), '(tion|ment|s|ung|keit|ción|heit)$') THEN 'NOUN'
              ELSE 'X' END AS pos
  FROM (SELECT id, si, wi, replace(w, ',', '') AS text FROM wrd) WHERE text <> ''),
dobj AS (
  SELECT n.id, n.i, max(v.i) AS head FROM tok1 n
  JOIN tok1 v ON v.id = n.id AND v.si = n.si AND v.i BETWEEN n.i - 5 AND n.i - 1 AND v.pos = 'VERB'
  WHERE n.pos = 'NOUN' GROUP BY n.id, n.i),
comp AS (
  SELECT m.id, m.i, min(d.i) AS head FROM tok1 m
  JOIN dobj d ON d.id = m.id AND d.i BETWEEN m.i + 1 AND m.i + 2 AND d.head < m.i
  GROUP BY m.id, m.i),
neg AS (
  SELECT g.id, g.i, min(v.i) AS head FROM tok1 g
  JOIN tok1 v ON v.id = g.id AND v.si = g.si AND v.i BETWEEN g.i + 1 AND g.i + 3 AND v.pos = 'VERB'
  WHERE lower(g.text) IN ('no', 'pas', 'nicht') GROUP BY g.id, g.i),
tok AS MATERIALIZED (
  SELECT t.id, t.i, t.text, t.pos,
         CASE WHEN d.head IS NOT NULL THEN 'dobj' WHEN c.head IS NOT NULL THEN 'compound'
              WHEN g.head IS NOT NULL THEN 'neg' ELSE '' END AS dep,
         coalesce(d.head, c.head, g.head, t.i)::INT AS head
  FROM tok1 t LEFT JOIN dobj d USING (id, i) LEFT JOIN comp c USING (id, i) LEFT JOIN neg g USING (id, i))"""


PAIRS_CTES = r""",
dob AS (
  SELECT o.id, o.i AS oi, o.text AS otext, v.i AS vi, v.text AS vtext, v.dep AS vdep, v.head AS vhead,
         (row_number() OVER (PARTITION BY o.id ORDER BY o.i) - 1)::INT AS pair_no
  FROM tok o JOIN tok v ON v.id = o.id AND v.i = o.head WHERE o.dep = 'dobj'),
omods AS (
  SELECT d.id, d.oi, string_agg(m.text, '_' ORDER BY m.i) AS mods FROM dob d
  JOIN tok m ON m.id = d.id AND m.head = d.oi AND m.i < d.oi AND m.dep IN ('compound', 'amod')
  GROUP BY d.id, d.oi),
onegs0 AS (
  SELECT d.id, d.oi, n.i, n.text FROM dob d JOIN tok n ON n.id = d.id AND n.dep = 'neg' AND n.head = d.vi
  UNION
  SELECT d.id, d.oi, n.i, n.text FROM dob d JOIN tok n ON n.id = d.id AND n.dep = 'neg' AND n.head = d.vhead
  WHERE d.vdep = 'xcomp'),
onegs AS (SELECT id, oi, string_agg(text, '_' ORDER BY i DESC) AS negs FROM onegs0 GROUP BY id, oi),
pairs AS (
  SELECT d.id, d.pair_no, d.oi AS token_i,
         CASE WHEN g.negs IS NULL THEN d.vtext ELSE g.negs || '_' || d.vtext END AS action,
         CASE WHEN m.mods IS NULL THEN d.otext ELSE m.mods || '_' || d.otext END AS object
  FROM dob d LEFT JOIN omods m USING (id, oi) LEFT JOIN onegs g USING (id, oi)),
cand AS (
  SELECT s.id, coalesce(p.action || '-' || p.object, 'NONE') AS candidate_intent
  FROM src s LEFT JOIN pairs p ON p.id = s.id AND p.pair_no = 0)"""

DOC_SRC = "SELECT doc_id AS id, text FROM documents"


def doc_candidates_sql() -> str:
    return "WITH " + tokens_ctes(DOC_SRC) + PAIRS_CTES + """,
dc AS (SELECT d.doc_id AS id, d.source AS cluster_id, d.lang AS intent, c.candidate_intent
       FROM documents d JOIN cand c ON c.id = d.doc_id)"""


TOP_CTES = """,
kept AS (SELECT * FROM dc WHERE candidate_intent IS NOT NULL AND NOT contains(candidate_intent, 'NONE')),
kcnt AS (SELECT cluster_id, candidate_intent, count(*) AS cnt, min(id) AS first_id FROM kept GROUP BY ALL),
krank AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY cnt DESC, first_id) AS rn FROM kcnt),
gen AS (SELECT cl.cluster_id, coalesce(k.candidate_intent, '') AS generated
        FROM (SELECT DISTINCT cluster_id FROM dc) cl LEFT JOIN krank k ON k.cluster_id = cl.cluster_id AND k.rn = 1)"""


def hashed_ctes(dim: int, prefix: str = "h") -> str:
    return rf"""
{prefix}w AS (SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+'),
                lambda x: x <> '')) AS w FROM documents),
{prefix}c AS (SELECT id, (('0x' || substr(md5(w), 1, 8))::BIGINT % {dim})::INT AS bucket, count(*) AS cnt
        FROM {prefix}w GROUP BY ALL),
{prefix}n AS (SELECT id, sqrt(sum(cnt * cnt)) AS nrm FROM {prefix}c GROUP BY id),
{prefix}v AS (SELECT id, bucket, cnt, cnt / nrm AS wt FROM {prefix}c JOIN {prefix}n USING (id)),
{prefix}p AS (SELECT a.id AS i, b.id AS j, round(greatest(least(1 - sum(a.wt * b.wt), 2), 0), 9) AS dist
        FROM {prefix}v a JOIN {prefix}v b ON a.bucket = b.bucket AND a.id < b.id GROUP BY a.id, b.id)"""


VEC_CTES = """
v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label AS cluster_id FROM embeddings),
vn AS (SELECT id, e, cluster_id, sqrt(list_dot_product(e, e)) AS nrm FROM v),
vp AS (SELECT a.id AS i, b.id AS j,
              round(greatest(least(1 - CASE WHEN a.nrm * b.nrm = 0 THEN 0
                                           ELSE list_dot_product(a.e, b.e) / (a.nrm * b.nrm) END, 2), 0), 9) AS dist,
              sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS ed
       FROM vn a JOIN vn b ON a.id < b.id)"""


def dbscan_ctes(p: str, nodes: str, pairs: str, eps: str, ms: int, key: str | None = None) -> str:
    """CTEs ``{p}_lab(key.., id, degree, is_core, root)`` and ``{p}_num(key.., id, cluster_id)``.

    ``pairs`` holds ``(key.., i, j)`` with i < j already within the radius
    (``eps`` is applied when not None, on a ``dist`` column).
    """
    k = f"{key}, " if key else ""
    kk = (lambda a, b: f"{a}.{key} = {b}.{key} AND ") if key else (lambda a, b: "")
    where = f" WHERE dist <= {eps}" if eps is not None else ""
    part = f"PARTITION BY {key} " if key else ""
    return f""",
{p}_e AS (SELECT {k}i, j FROM {pairs}{where} UNION ALL SELECT {k}j AS i, i AS j FROM {pairs}{where}),
{p}_deg AS (SELECT {'n.' + key + ', ' if key else ''}n.id, 1 + count(e.j) AS degree FROM {nodes} n
            LEFT JOIN {p}_e e ON {kk('e', 'n')}e.i = n.id GROUP BY ALL),
{p}_core AS (SELECT {k}id FROM {p}_deg WHERE degree >= {ms}),
{p}_ce AS (SELECT {'e.' + key + ', ' if key else ''}e.i, e.j FROM {p}_e e
           JOIN {p}_core a ON {kk('a', 'e')}a.id = e.i JOIN {p}_core b ON {kk('b', 'e')}b.id = e.j),
{p}_cc({k}id, root) USING KEY ({k}id) AS (
  SELECT {k}id, id FROM {p}_core
  UNION
  SELECT {'ce.' + key + ', ' if key else ''}ce.j, min(w.root) FROM {p}_cc w
  JOIN {p}_ce ce ON {kk('ce', 'w')}ce.i = w.id
  JOIN recurring.{p}_cc r ON {kk('r', 'ce')}r.id = ce.j
  GROUP BY ALL HAVING min(w.root) < min(r.root)),
{p}_border AS (SELECT {'e.' + key + ', ' if key else ''}e.i AS id, min(c.root) AS root FROM {p}_e e
               JOIN {p}_cc c ON {kk('c', 'e')}c.id = e.j
               ANTI JOIN {p}_core x ON {kk('x', 'e')}x.id = e.i GROUP BY ALL),
{p}_lab AS (SELECT {'n.' + key + ', ' if key else ''}n.id, n.degree, n.degree >= {ms} AS is_core,
                   coalesce(c.root, b.root) AS root FROM {p}_deg n
            LEFT JOIN {p}_cc c ON {kk('c', 'n')}c.id = n.id LEFT JOIN {p}_border b ON {kk('b', 'n')}b.id = n.id),
{p}_num AS (SELECT {k}id, CASE WHEN root IS NULL THEN -1
                   ELSE (dense_rank() OVER ({part}ORDER BY root) - 1) END::INT AS cluster_id FROM {p}_lab)"""


def _sweep_values() -> str:
    rows = ", ".join(f"({i}, {_dbl(e)})" for i, e in enumerate(Qy.sweep_eps()))
    return f"sweps AS (SELECT * FROM (VALUES {rows}) t(param_idx, eps))"


def sweep_ctes() -> str:
    return ("WITH RECURSIVE " + VEC_CTES + ",\n" + _sweep_values() + """,
spairs AS (SELECT s.param_idx, p.i, p.j FROM vp p JOIN sweps s ON p.dist <= s.eps),
snodes AS (SELECT s.param_idx, v.id FROM v, sweps s)""" +
            dbscan_ctes("sw", "snodes", "spairs", None, Qy.SWEEP_MS, "param_idx"))


def silhouette_ctes(labels: str) -> str:
    """``sil(param_idx, id, cluster_id, s)`` for labels ``(param_idx, id, cluster_id)`` over ``vp``."""
    return f""",
lab AS ({labels}),
sz AS (SELECT param_idx, cluster_id, count(*) AS size FROM lab GROUP BY ALL),
ed2 AS (SELECT i, j, ed FROM vp UNION ALL SELECT j, i, ed FROM vp),
sums AS (SELECT a.param_idx, a.id, b.cluster_id, sum(d.ed) AS s FROM lab a JOIN ed2 d ON d.i = a.id
         JOIN lab b ON b.param_idx = a.param_idx AND b.id = d.j GROUP BY ALL),
pr AS (SELECT a.param_idx, a.id, a.cluster_id AS own, o.size AS own_size
       FROM lab a JOIN sz o ON o.param_idx = a.param_idx AND o.cluster_id = a.cluster_id),
ab0 AS (SELECT pr.param_idx, pr.id, pr.own, pr.own_size,
               max(CASE WHEN s.cluster_id = pr.own THEN s.s END) AS own_sum,
               min(CASE WHEN s.cluster_id <> pr.own THEN s.s / z.size END) AS b
        FROM pr LEFT JOIN sums s ON s.param_idx = pr.param_idx AND s.id = pr.id
        LEFT JOIN sz z ON z.param_idx = s.param_idx AND z.cluster_id = s.cluster_id
        GROUP BY pr.param_idx, pr.id, pr.own, pr.own_size),
ab AS (SELECT param_idx, id, own, own_size, own_sum / (own_size - 1) AS a, b FROM ab0),
sil AS (SELECT param_idx, id, own AS cluster_id,
               CASE WHEN own_size <= 1 OR b IS NULL OR greatest(coalesce(a, 0), b) = 0 THEN 0.0
                    ELSE (b - a) / greatest(a, b) END AS s FROM ab)"""


def db_ctes(labels_cte: str) -> str:
    """``dbi(param_idx, davies_bouldin)`` for labels in CTE ``labels_cte``."""
    return f""",
ld AS (SELECT l.param_idx, l.cluster_id, l.id, v.e FROM {labels_cte} l JOIN v ON v.id = l.id),
cd AS (SELECT param_idx, cluster_id, d, avg(x) AS c FROM
         (SELECT param_idx, cluster_id, unnest(e) AS x, unnest(range(len(e))) AS d FROM ld) GROUP BY ALL),
cen AS (SELECT param_idx, cluster_id, list(c ORDER BY d) AS c FROM cd GROUP BY ALL),
spr AS (SELECT ld.param_idx, ld.cluster_id,
               avg(sqrt(list_sum(list_transform(list_zip(ld.e, cen.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS s
        FROM ld JOIN cen USING (param_idx, cluster_id) GROUP BY ALL),
cc2 AS (SELECT a.param_idx, a.cluster_id AS ka, b.cluster_id AS kb,
               sqrt(list_sum(list_transform(list_zip(a.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d
        FROM cen a JOIN cen b ON a.param_idx = b.param_idx),
rat AS (SELECT c.param_idx, c.ka, max(CASE WHEN c.d = 0 THEN 0 ELSE (sa.s + sb.s) / c.d END) AS r, max(c.d) AS dmax
        FROM cc2 c JOIN spr sa ON sa.param_idx = c.param_idx AND sa.cluster_id = c.ka
        JOIN spr sb ON sb.param_idx = c.param_idx AND sb.cluster_id = c.kb GROUP BY ALL),
dbi AS (SELECT r.param_idx, CASE WHEN max(abs(s.s)) <= 1e-8 OR max(r.dmax) <= 1e-8 THEN 0.0 ELSE avg(r.r) END
               AS davies_bouldin
        FROM rat r JOIN spr s ON s.param_idx = r.param_idx AND s.cluster_id = r.ka GROUP BY ALL)"""


def scores_sql() -> str:
    """Per sweep attempt: n_clusters, silhouette, balanced, davies_bouldin (degenerate guarded)."""
    return sweep_ctes() + """,
summ AS (SELECT param_idx, count(*) AS n_clusters, sum(size) AS n_rows FROM
           (SELECT param_idx, cluster_id, count(*) AS size FROM sw_num GROUP BY ALL) GROUP BY ALL),
good AS (SELECT param_idx FROM summ WHERE NOT (n_clusters < 2 OR n_clusters > n_rows - 1)),
glab AS (SELECT n.param_idx, n.id, n.cluster_id FROM sw_num n JOIN good USING (param_idx))""" + \
        silhouette_ctes("SELECT * FROM glab") + db_ctes("glab") + """,
gsz AS (SELECT param_idx, cluster_id, count(*) AS size FROM glab GROUP BY ALL),
pen AS (SELECT g.param_idx, sum(abs(g.size / t.n - 1.0 / t.k)) * 0.5 * stddev_samp(g.size) / avg(g.size) AS penalty
        FROM gsz g JOIN (SELECT param_idx, sum(size) AS n, count(*) AS k FROM gsz GROUP BY ALL) t USING (param_idx)
        GROUP BY ALL),
msil AS (SELECT param_idx, avg(s) AS silhouette FROM sil GROUP BY ALL),
scores AS (
  SELECT m.param_idx, m.n_clusters,
         CASE WHEN g.param_idx IS NULL THEN '-inf'::DOUBLE ELSE s.silhouette END AS silhouette,
         CASE WHEN g.param_idx IS NULL THEN '-inf'::DOUBLE ELSE s.silhouette - p.penalty END AS balanced,
         CASE WHEN g.param_idx IS NULL THEN 'inf'::DOUBLE ELSE d.davies_bouldin END AS davies_bouldin
  FROM summ m LEFT JOIN good g USING (param_idx) LEFT JOIN msil s USING (param_idx)
  LEFT JOIN pen p USING (param_idx) LEFT JOIN dbi d USING (param_idx))"""


def kmeans_ctes(steps: int) -> str:
    """``asg{n}(id, cluster_id)`` and ``cen{n}(cluster_id, c)`` for n = 0..steps."""
    parts = [VEC_CTES + """,
cen0 AS (SELECT cluster_id, arg_min(e, id) AS c FROM v GROUP BY cluster_id)"""]

    def assign(n):
        return f""",
dd{n} AS (SELECT v.id, c.cluster_id,
                 list_sum(list_transform(list_zip(v.e, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2
          FROM v, cen{n} c),
asg{n} AS (SELECT id, arg_min(cluster_id, struct_pack(d := d2, k := cluster_id)) AS cluster_id FROM dd{n} GROUP BY id)"""

    def update(n):
        return f""",
upd{n} AS (SELECT a.cluster_id, d, avg(x) AS x FROM
             (SELECT id, unnest(e) AS x, unnest(range(len(e))) AS d FROM v) u JOIN asg{n} a USING (id) GROUP BY ALL),
cen{n + 1} AS (SELECT c.cluster_id, coalesce(u.c, c.c) AS c FROM cen{n} c
               LEFT JOIN (SELECT cluster_id, list(x ORDER BY d) AS c FROM upd{n} GROUP BY ALL) u USING (cluster_id))"""

    for n in range(steps):
        parts.append(assign(n))
        parts.append(update(n))
    parts.append(assign(steps))
    return "WITH " + "".join(parts)


def iter_dbscan_sql() -> str:
    p = Qy.ITER_PARAMS
    rounds = iter_dbscan_rounds(p["initial_distance"], p["initial_minimum_samples"], p["delta_distance"],
                                p["delta_minimum_samples"], p["max_iteration"])
    ctes = ["WITH RECURSIVE " + hashed_ctes(Qy.DOC_DIM).lstrip() + """,
allids AS (SELECT doc_id AS id FROM documents),
asg0 AS (SELECT NULL::BIGINT AS id, NULL::INT AS cluster_id WHERE false)"""]
    for r, (eps, ms) in enumerate(rounds, start=1):
        prev = f"asg{r - 1}"
        offset = " + ".join(["0"] + [f"(SELECT count(*) FROM r{q}_kept)" for q in range(1, r)])
        ctes.append(f""",
r{r}_nodes AS (SELECT id FROM allids ANTI JOIN {prev} USING (id)),
r{r}_pairs AS (SELECT i, j, dist FROM hp SEMI JOIN r{r}_nodes a ON a.id = hp.i SEMI JOIN r{r}_nodes b ON b.id = hp.j
               WHERE dist <= {_dbl(eps)})""")
        ctes.append(dbscan_ctes(f"r{r}", f"r{r}_nodes", f"r{r}_pairs", None, ms))
        ctes.append(f""",
r{r}_sz AS (SELECT root, count(*) AS size FROM r{r}_lab WHERE root IS NOT NULL GROUP BY root),
r{r}_kept AS (SELECT root, (row_number() OVER (ORDER BY root) - 1) AS rk FROM r{r}_sz
              WHERE size <= {p['threshold']} AND (SELECT count(*) FROM r{r}_nodes) >= 5),
asg{r} AS (SELECT * FROM {prev} UNION ALL
           SELECT l.id, (k.rk + {offset})::INT AS cluster_id FROM r{r}_lab l JOIN r{r}_kept k USING (root))""")
    last = f"asg{len(rounds)}"
    return "".join(ctes) + f"""
SELECT a.id AS doc_id, coalesce(s.cluster_id, -1)::INT AS cluster_id FROM allids a LEFT JOIN {last} s USING (id)"""


def prompts_sql() -> str:
    conv_src = "SELECT conv_id * 1000000 + turn AS id, text FROM conversations"
    return "WITH RECURSIVE " + tokens_ctes(conv_src).lstrip() + PAIRS_CTES + """,
dc AS (SELECT c.conv_id * 1000000 + c.turn AS id, c.role AS cluster_id, c.text, k.candidate_intent
       FROM conversations c JOIN cand k ON k.id = c.conv_id * 1000000 + c.turn)""" + TOP_CTES + """,
cands AS (SELECT cl.cluster_id, coalesce(string_agg(k.candidate_intent, ', ' ORDER BY k.rn), '') AS candidates
          FROM (SELECT DISTINCT cluster_id FROM dc) cl LEFT JOIN krank k ON k.cluster_id = cl.cluster_id AND k.rn <= 3
          GROUP BY cl.cluster_id),
u AS (SELECT dc.cluster_id, dc.id AS rank, dc.text,
             len(list_filter(regexp_split_to_array(dc.text, '\\s+'), lambda w: w <> '')) AS w,
             CASE WHEN length(dc.text) = 0 OR regexp_matches(dc.text, '\\s$') THEN 1 ELSE 0 END AS extra,
             len(list_filter(regexp_split_to_array(c.candidates, '\\s+'), lambda w: w <> '')) AS wc,
             c.candidates, row_number() OVER (PARTITION BY dc.cluster_id ORDER BY dc.id) AS rn
      FROM dc JOIN cands c USING (cluster_id)),
pk(cluster_id, rn, prompt_no, cost) AS (
  SELECT cluster_id, rn, 0, w + extra FROM u WHERE rn = 1
  UNION ALL
  SELECT u.cluster_id, u.rn,
         CASE WHEN 1 + u.w + 14 + u.wc + pk.cost > 512 THEN pk.prompt_no + 1 ELSE pk.prompt_no END,
         CASE WHEN 1 + u.w + 14 + u.wc + pk.cost > 512 THEN u.w + u.extra ELSE pk.cost + u.w + u.extra END
  FROM pk JOIN u ON u.cluster_id = pk.cluster_id AND u.rn = pk.rn + 1),
packed AS (
  SELECT u.cluster_id, pk.prompt_no, min(u.rank) AS first_rank, max(u.rank) AS last_rank,
         count(*)::INT AS n_utterances,
         'Given these utterances: ' || string_agg(u.text, ', ' ORDER BY u.rank)
           || '. What is the best fitting intent, if any, among the following: ' || any_value(u.candidates) AS prompt
  FROM pk JOIN u USING (cluster_id, rn) GROUP BY u.cluster_id, pk.prompt_no)"""


def report_ctes(cluster_sql: str, dim: int) -> str:
    """Label report CTEs over ``rows(id, cluster_id, intent, candidate_intent)``."""
    return f""",
rows AS ({cluster_sql}),
kept AS (SELECT * FROM rows WHERE candidate_intent IS NOT NULL AND NOT contains(candidate_intent, 'NONE')),
kcnt AS (SELECT cluster_id, candidate_intent, count(*) AS cnt, min(id) AS first_id FROM kept GROUP BY ALL),
krank AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY cnt DESC, first_id) AS rn FROM kcnt),
gen AS (SELECT cl.cluster_id, coalesce(k.candidate_intent, '') AS generated
        FROM (SELECT DISTINCT cluster_id FROM rows) cl LEFT JOIN krank k ON k.cluster_id = cl.cluster_id AND k.rn = 1),
icnt AS (SELECT cluster_id, intent, count(*) AS cnt, min(id) AS first_id FROM rows WHERE intent IS NOT NULL GROUP BY ALL),
mcgt AS (SELECT cluster_id, arg_max(intent, struct_pack(c := cnt, f := -first_id)) AS most_common_gt
         FROM icnt GROUP BY cluster_id),
rep0 AS (SELECT g.cluster_id, g.generated, m.most_common_gt,
                lower(translate(coalesce(g.generated, ''), '_-', '  ')) AS gc,
                lower(translate(coalesce(m.most_common_gt, ''), '_-', '  ')) AS tc
         FROM gen g LEFT JOIN mcgt m USING (cluster_id)),
tx AS (SELECT DISTINCT gc AS t FROM rep0 UNION SELECT DISTINCT tc FROM rep0),
txw AS (SELECT t, unnest(list_filter(regexp_split_to_array(lower(t), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')) AS w
        FROM tx),
txc AS (SELECT t, (('0x' || substr(md5(w), 1, 8))::BIGINT % {dim})::INT AS bucket, count(*) AS cnt FROM txw GROUP BY ALL),
txv AS (SELECT t, bucket, cnt / sqrt(sum(cnt * cnt) OVER (PARTITION BY t)) AS wt FROM txc),
cosv AS (SELECT r.cluster_id, sum(a.wt * b.wt) AS c FROM rep0 r JOIN txv a ON a.t = r.gc
         JOIN txv b ON b.t = r.tc AND b.bucket = a.bucket GROUP BY ALL),
srcw AS (SELECT r.cluster_id, unnest(list_filter(regexp_split_to_array(lower(r.gc), '[^\\p{{L}}\\p{{N}}_]+'),
                lambda x: x <> '')) AS w FROM rep0 r),
srcn AS (SELECT r.cluster_id, count(s.w) AS n FROM rep0 r LEFT JOIN srcw s USING (cluster_id) GROUP BY ALL),
srcc AS (SELECT cluster_id, w, count(*) AS c FROM srcw GROUP BY ALL),
tgtw AS (SELECT r.cluster_id, unnest(list_append(list_filter(regexp_split_to_array(lower(r.tc),
                '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> ''), '{EOS}')) AS w FROM rep0 r),
bart AS (SELECT t.cluster_id, avg(ln((coalesce(c.c, 0) + 1) / (n.n + {SCORER_VOCAB}))) AS b FROM tgtw t
         JOIN srcn n USING (cluster_id) LEFT JOIN srcc c ON c.cluster_id = t.cluster_id AND c.w = t.w GROUP BY ALL),
rep AS (SELECT r.cluster_id, r.generated, r.most_common_gt, coalesce(c.c, 0.0) AS cosine_sim, b.b AS bart_score
        FROM rep0 r LEFT JOIN cosv c USING (cluster_id) JOIN bart b USING (cluster_id))"""


SOURCE_ROWS = "SELECT id, cluster_id, intent, candidate_intent FROM dc"


def _source_report() -> str:
    return doc_candidates_sql() + report_ctes(SOURCE_ROWS, Qy.DOC_DIM)


def _score_sql(src_expr: str, tgt_expr: str, keys: list[str], from_sql: str, name: str) -> str:
    """CTE ``{name}(keys.., score)``: copy-scorer mean log-probability of tgt given src."""
    k = ", ".join(keys)
    pre = f"{name}_"
    return f""",
{pre}in AS (SELECT {k}, {src_expr} AS src, {tgt_expr} AS tgt FROM {from_sql}),
{pre}sw AS (SELECT {k}, unnest(list_filter(regexp_split_to_array(lower(src), '[^\\p{{L}}\\p{{N}}_]+'),
              lambda x: x <> '')) AS w FROM {pre}in),
{pre}sn AS (SELECT i.{keys[0]}{''.join(', i.' + x for x in keys[1:])}, count(s.w) AS n FROM {pre}in i
             LEFT JOIN {pre}sw s USING ({k}) GROUP BY ALL),
{pre}sc AS (SELECT {k}, w, count(*) AS c FROM {pre}sw GROUP BY ALL),
{pre}tw AS (SELECT {k}, unnest(list_append(list_filter(regexp_split_to_array(lower(tgt), '[^\\p{{L}}\\p{{N}}_]+'),
              lambda x: x <> ''), '{EOS}')) AS w FROM {pre}in),
{name} AS (SELECT t.{keys[0]}{''.join(', t.' + x for x in keys[1:])},
                  avg(ln((coalesce(c.c, 0) + 1) / (n.n + {SCORER_VOCAB}))) AS score
           FROM {pre}tw t JOIN {pre}sn n USING ({k}) LEFT JOIN {pre}sc c USING ({k}, w) GROUP BY ALL)"""


def _pipeline_sql() -> str:
    return ("WITH RECURSIVE " + tokens_ctes(DOC_SRC).lstrip() + PAIRS_CTES + "," + hashed_ctes(Qy.DOC_DIM) +
            """,
dn AS (SELECT doc_id AS id FROM documents)""" +
            dbscan_ctes("pl", "dn", "hp", _dbl(Qy.PIPE_EPS), Qy.PIPE_MS) +
            report_ctes("""SELECT d.doc_id AS id, n.cluster_id, d.lang AS intent, c.candidate_intent
                           FROM documents d JOIN pl_num n ON n.id = d.doc_id JOIN cand c ON c.id = d.doc_id""",
                        Qy.DOC_DIM) +
            """
SELECT cluster_id, generated, most_common_gt, round(cosine_sim, 6) AS cosine_sim, round(bart_score, 6) AS bart_score
FROM rep""")


def build() -> dict[str, str]:
    s: dict[str, str] = {}
    s["normalize_text"] = r"""
SELECT doc_id, array_to_string(list_filter(list_transform(
         string_split(lower(regexp_replace(text, '[^\p{L}\p{N}_\s]', ' ', 'g')), ' '),
         lambda t: regexp_replace(t, '^\s+|\s+$', '', 'g')), lambda t: t <> ''), ' ') AS normalized
FROM documents"""
    s["word_count"] = r"""
SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::INT AS n_words FROM documents"""
    s["render_extraction_prompt"] = """
SELECT conv_id, turn, 'Given the following utterance: ' || text || '. The intent was to' AS prompt FROM conversations"""
    s["clean_generated"] = """
SELECT o_orderkey, lower(translate(coalesce(o_orderpriority, ''), '_-', '  ')) AS cleaned FROM orders"""
    pas = "lower(translate(array_to_string(regexp_extract_all({x}, '[A-Z][^A-Z]*'), ' '), '_-', '  '))"
    s["clean_intent_pascal"] = f"""
SELECT p_partkey, {pas.format(x="upper(substr(p_name, 1, 1)) || substr(p_name, 2)")} AS name_clean,
       {pas.format(x='p_brand')} AS brand_clean, {pas.format(x='p_type')} AS type_clean FROM part"""
    s["clean_intent_plain"] = """
SELECT p_partkey, lower(translate(p_name, '_-', '  ')) AS name_clean, lower(translate(p_type, '_-', '  ')) AS type_clean
FROM part"""
    ev_rows = ", ".join(f"('{ds}', '{raw}', '{rd}')" for ds, m in Qy.EVENT_READABLE.items() for raw, rd in m.items())
    s["readable_lookup"] = f"""
WITH rd AS (SELECT * FROM (VALUES {ev_rows}) t(dataset, raw, readable))
SELECT e.event_id, e.event_type, coalesce(rd.readable, e.event_type) AS readable
FROM events e LEFT JOIN rd ON rd.dataset = 'events' AND rd.raw = e.event_type"""
    s["label_broadcast"] = doc_candidates_sql() + TOP_CTES + """
SELECT dc.id AS doc_id, dc.cluster_id, gen.generated FROM dc JOIN gen USING (cluster_id)"""
    s["token_heads"] = "WITH " + tokens_ctes(DOC_SRC) + """
SELECT t.id AS doc_id, t.i, t.text, t.pos, t.dep, t.head, h.text AS head_text
FROM tok t LEFT JOIN tok h ON h.id = t.id AND h.i = t.head WHERE t.dep <> ''"""
    s["action_object"] = "WITH " + tokens_ctes(DOC_SRC) + """,
arcs AS (SELECT t.id, t.i, s.pos AS spos, lower(s.text) AS stext, e.pos AS epos, lower(e.text) AS etext
         FROM tok t JOIN tok s ON s.id = t.id AND s.i = least(t.i, t.head)
         JOIN tok e ON e.id = t.id AND e.i = greatest(t.i, t.head) WHERE t.dep = 'dobj'),
act AS (SELECT id, arg_max(stext, i) AS action FROM arcs WHERE spos = 'VERB' GROUP BY id),
obj AS (SELECT id, arg_max(etext, i) AS object FROM arcs WHERE epos = 'NOUN' GROUP BY id)
SELECT s.id AS doc_id, coalesce(a.action, 'NONE') AS action, coalesce(o.object, 'NONE') AS object,
       coalesce(a.action, 'NONE') || '-' || coalesce(o.object, 'NONE') AS candidate_intent
FROM src s LEFT JOIN act a USING (id) LEFT JOIN obj o USING (id)"""
    s["action_object_ext"] = doc_candidates_sql() + "\nSELECT id AS doc_id, candidate_intent FROM dc"
    s["action_object_all"] = "WITH " + tokens_ctes(DOC_SRC) + PAIRS_CTES + """
SELECT id AS doc_id, pair_no, action || '-' || object AS pair FROM pairs"""
    s["object_phrase"] = "WITH " + tokens_ctes(DOC_SRC) + PAIRS_CTES + "\nSELECT id AS doc_id, token_i, object FROM pairs"
    s["action_phrase"] = "WITH " + tokens_ctes(DOC_SRC) + PAIRS_CTES + "\nSELECT id AS doc_id, token_i, action FROM pairs"
    s["candidate_filter"] = doc_candidates_sql() + """
SELECT id AS doc_id, candidate_intent FROM dc WHERE candidate_intent IS NOT NULL AND NOT contains(candidate_intent, 'NONE')"""
    s["top_candidates"] = doc_candidates_sql() + TOP_CTES + """
SELECT cl.cluster_id, coalesce(string_agg(k.candidate_intent, ', ' ORDER BY k.rn), '') AS candidates
FROM (SELECT DISTINCT cluster_id FROM dc) cl LEFT JOIN krank k ON k.cluster_id = cl.cluster_id AND k.rn <= 3
GROUP BY cl.cluster_id"""
    s["label_most_frequent"] = doc_candidates_sql() + TOP_CTES + "\nSELECT cluster_id, generated FROM gen"
    s["most_common_global"] = doc_candidates_sql() + """,
kept AS (SELECT * FROM dc WHERE candidate_intent IS NOT NULL AND NOT contains(candidate_intent, 'NONE')),
cnt AS (SELECT candidate_intent, count(*) AS cnt, min(id) AS first_id FROM kept GROUP BY ALL)
SELECT candidate_intent, cnt, row_number() OVER (ORDER BY cnt DESC, first_id) AS rank
FROM cnt ORDER BY cnt DESC, first_id LIMIT 10"""
    s["majority_intent"] = """
WITH c AS (SELECT source AS cluster_id, lang, count(*) AS cnt, min(doc_id) AS first_id FROM documents
           WHERE lang IS NOT NULL GROUP BY ALL)
SELECT cluster_id, arg_max(lang, struct_pack(c := cnt, f := -first_id)) AS most_common_gt FROM c GROUP BY cluster_id"""
    s["first_label"] = doc_candidates_sql() + "\nSELECT cluster_id, arg_min(candidate_intent, id) AS generated FROM dc GROUP BY cluster_id"
    conv_src = "SELECT conv_id * 1000000 + turn AS id, text FROM conversations"
    s["majority_response"] = "WITH " + tokens_ctes(conv_src) + PAIRS_CTES + """,
r AS (SELECT c.conv_id, c.turn, k.candidate_intent FROM conversations c JOIN cand k ON k.id = c.conv_id * 1000000 + c.turn),
rc AS (SELECT conv_id, candidate_intent, count(*) AS cnt, min(turn) AS first_turn FROM r GROUP BY ALL)
SELECT conv_id, arg_max(candidate_intent, struct_pack(c := cnt, f := -first_turn)) AS generated FROM rc GROUP BY conv_id"""
    s["intent_coverage"] = """
WITH c AS (SELECT source AS cluster_id, lang, count(*) AS cnt, min(doc_id) AS first_id FROM documents
           WHERE lang IS NOT NULL GROUP BY ALL),
m AS (SELECT cluster_id, arg_max(lang, struct_pack(c := cnt, f := -first_id)) AS intent FROM c GROUP BY cluster_id),
i AS (SELECT DISTINCT lang AS intent FROM documents)
SELECT i.intent, count(m.cluster_id) AS n_clusters FROM i LEFT JOIN m USING (intent) GROUP BY i.intent"""
    s["hashed_embedding"] = "WITH " + hashed_ctes(Qy.DOC_DIM).lstrip().split(",\nhp AS")[0] + """
SELECT id AS doc_id, bucket, cnt, round(wt, 6) AS weight FROM hv"""
    s["cosine_range_join"] = "WITH " + VEC_CTES + f"""
SELECT i, j, round(dist, 6) AS dist FROM vp WHERE dist <= {_dbl(Qy.EMB_EPS)}"""
    s["cosine_pairs"] = "WITH " + VEC_CTES + f""",
both_ AS (SELECT i, j, dist FROM vp UNION ALL SELECT j, i, dist FROM vp)
SELECT i AS vec_id, count(*) FILTER (WHERE dist <= {_dbl(Qy.EMB_EPS)}) AS n_within, round(min(dist), 6) AS nn_dist
FROM both_ GROUP BY i"""
    s["euclidean_pairs"] = "WITH " + VEC_CTES + """,
both_ AS (SELECT i, j, ed FROM vp UNION ALL SELECT j, i, ed FROM vp)
SELECT i AS vec_id, round(min(ed), 6) AS nn_dist, round(avg(ed), 6) AS mean_dist FROM both_ GROUP BY i"""
    cent = """,
cd AS (SELECT cluster_id, d, avg(x) AS c FROM (SELECT cluster_id, unnest(e) AS x, unnest(range(len(e))) AS d FROM v)
       GROUP BY ALL),
cen AS (SELECT cluster_id, list(c ORDER BY d) AS c FROM cd GROUP BY ALL),
sims AS (SELECT v.id, v.cluster_id,
                CASE WHEN sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(c.c, c.c)) = 0 THEN 0.0
                     ELSE list_dot_product(v.e, c.c) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(c.c, c.c)))
                END AS cos_sim
         FROM v JOIN cen c USING (cluster_id))"""
    s["cluster_centroids"] = "WITH " + VEC_CTES + cent + "\nSELECT cluster_id, d::INT AS dim, round(c, 6) AS center FROM cd"
    s["centroid_similarity"] = "WITH " + VEC_CTES + cent + "\nSELECT id AS vec_id, cluster_id, round(cos_sim, 6) AS cos_sim FROM sims"
    s["order_by_centroid"] = "WITH " + VEC_CTES + cent + """
SELECT id AS vec_id, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY round(cos_sim, 12) DESC, id) AS rank
FROM sims"""
    s["dedup_keep_first"] = "SELECT source AS cluster_id, min(doc_id) AS first_id FROM documents GROUP BY source, text"
    s["kmeans_assign"] = kmeans_ctes(0) + "\nSELECT id AS vec_id, cluster_id FROM asg0"
    s["kmeans_update"] = kmeans_ctes(1) + """
SELECT cluster_id, d::INT AS dim, round(x, 6) AS center FROM upd0"""
    s["kmeans_lloyd"] = kmeans_ctes(Qy.LLOYD_STEPS) + f"\nSELECT id AS vec_id, cluster_id FROM asg{Qy.LLOYD_STEPS}"
    s["dbscan_core"] = "WITH RECURSIVE " + VEC_CTES + """,
vnodes AS (SELECT id FROM v)""" + dbscan_ctes("d", "vnodes", "vp", _dbl(Qy.EMB_EPS), Qy.EMB_MS) + """
SELECT id AS vec_id, degree, is_core FROM d_lab"""
    s["dbscan"] = "WITH RECURSIVE " + VEC_CTES + """,
vnodes AS (SELECT id FROM v)""" + dbscan_ctes("d", "vnodes", "vp", _dbl(Qy.EMB_EPS), Qy.EMB_MS) + """
SELECT id AS vec_id, cluster_id FROM d_num"""
    s["dbscan_sweep"] = sweep_ctes() + "\nSELECT param_idx, id AS vec_id, cluster_id FROM sw_num"
    s["iter_dbscan"] = iter_dbscan_sql()
    s["cluster_size_cap"] = "WITH RECURSIVE " + hashed_ctes(Qy.CAP_DIM).lstrip() + """,
dn AS (SELECT doc_id AS id FROM documents)""" + dbscan_ctes("c", "dn", "hp", _dbl(Qy.CAP_EPS), Qy.CAP_MS) + f""",
csz AS (SELECT cluster_id, count(*) AS size FROM c_num GROUP BY cluster_id)
SELECT n.id AS doc_id, CASE WHEN z.size > {Qy.CAP_THRESHOLD} OR n.cluster_id = -1 THEN -1 ELSE n.cluster_id END::INT
       AS cluster_id FROM c_num n JOIN csz z USING (cluster_id)"""
    s["dense_renumber"] = """
SELECT l_orderkey, l_linenumber, (dense_rank() OVER (ORDER BY l_suppkey) - 1)::BIGINT AS new_id FROM lineitem"""
    s["cluster_sizes"] = "SELECT label AS cluster_id, count(*) AS size FROM embeddings GROUP BY label"
    s["size_penalty"] = """
WITH z AS (SELECT label, count(*) AS size FROM embeddings GROUP BY label),
t AS (SELECT sum(size) AS n, count(*) AS k FROM z)
SELECT round(sum(abs(size / n - 1.0 / k)) * 0.5 * stddev_samp(size) / avg(size), 6) AS penalty FROM z, t"""
    lab0 = "SELECT 0 AS param_idx, id, cluster_id FROM v"
    s["silhouette_samples"] = "WITH " + VEC_CTES + silhouette_ctes(lab0) + """
SELECT id AS vec_id, cluster_id, round(s, 6) AS silhouette FROM sil"""
    s["silhouette_score"] = "WITH " + VEC_CTES + silhouette_ctes(lab0) + "\nSELECT round(avg(s), 6) AS silhouette FROM sil"
    s["balanced_score"] = "WITH " + VEC_CTES + silhouette_ctes(lab0) + """,
z AS (SELECT cluster_id, count(*) AS size FROM v GROUP BY ALL),
t AS (SELECT sum(size) AS n, count(*) AS k FROM z),
pen AS (SELECT sum(abs(size / n - 1.0 / k)) * 0.5 * stddev_samp(size) / avg(size) AS p FROM z, t)
SELECT round(avg(s) - (SELECT p FROM pen), 6) AS balanced FROM sil"""
    s["davies_bouldin"] = "WITH " + VEC_CTES + ",\nlab0 AS (" + lab0 + ")" + db_ctes("lab0") + """
SELECT round(davies_bouldin, 6) AS davies_bouldin FROM dbi"""
    s["attempt_guard"] = sweep_ctes() + """,
sz AS (SELECT param_idx, cluster_id, count(*) AS size FROM sw_num GROUP BY ALL),
summ AS (SELECT param_idx, count(*) AS n_clusters, sum(size) AS n_rows FROM sz GROUP BY ALL)
SELECT param_idx, n_clusters, (n_clusters < 2 OR n_clusters > n_rows - 1) AS degenerate FROM summ"""
    s["score_attempts"] = scores_sql() + """
SELECT param_idx, n_clusters, round(silhouette, 6) AS silhouette, round(balanced, 6) AS balanced,
       round(davies_bouldin, 6) AS davies_bouldin FROM scores"""
    s["best_attempt"] = scores_sql() + """
SELECT 'silhouette' AS measure, arg_max(param_idx, struct_pack(v := silhouette, n := -param_idx)) AS param_idx,
       round(max(silhouette), 6) AS score FROM scores
UNION ALL
SELECT 'balanced', arg_max(param_idx, struct_pack(v := balanced, n := -param_idx)), round(max(balanced), 6) FROM scores
UNION ALL
SELECT 'davies_bouldin', arg_max(param_idx, struct_pack(v := -davies_bouldin, n := -param_idx)),
       round(min(davies_bouldin), 6) FROM scores"""
    s["alignment_check"] = sweep_ctes() + """
SELECT n.param_idx, count(*) FILTER (WHERE v.id IS NULL) AS labels_without_vector,
       (SELECT count(DISTINCT id) FROM v) - count(DISTINCT v.id) AS vectors_without_label
FROM sw_num n LEFT JOIN v USING (id) GROUP BY n.param_idx"""
    s["pack_prompts"] = prompts_sql() + """
SELECT cluster_id, prompt_no, first_rank, last_rank, n_utterances,
       len(list_filter(regexp_split_to_array(prompt, '\\s+'), lambda w: w <> '')) AS n_words, prompt FROM packed"""
    s["label_by_prompt"] = prompts_sql() + """,
said AS (SELECT cluster_id, prompt_no, split_part(prompt[25:], '. What is the best fitting intent, if any, among the following: ', 1) AS said FROM packed),
hits AS (SELECT s.cluster_id, s.prompt_no, k.rn, k.candidate_intent,
                list_sum(list_transform(list_filter(string_split(k.candidate_intent, '-'), lambda p: p <> ''),
                                        lambda p: (length(said) - length(replace(said, p, ''))) // length(p))) AS n
         FROM said s JOIN krank k ON k.cluster_id = s.cluster_id AND k.rn <= 3),
answers AS (SELECT cluster_id, prompt_no, arg_max(candidate_intent, struct_pack(n := coalesce(n, 0), r := -rn)) AS answer FROM hits GROUP BY ALL),
tally AS (SELECT cluster_id, answer, count(*) AS n, min(prompt_no) AS f FROM answers GROUP BY ALL),
most AS (SELECT cluster_id, arg_max(answer, struct_pack(n := n, f := -f)) AS answer FROM tally GROUP BY cluster_id)
SELECT cl.cluster_id, coalesce(m.answer, '') AS generated
FROM (SELECT DISTINCT cluster_id FROM dc) cl LEFT JOIN most m USING (cluster_id)"""
    s["label_cosine"] = _source_report() + "\nSELECT cluster_id, round(cosine_sim, 6) AS cosine_sim FROM rep"
    per_intent = """,
ints AS (SELECT DISTINCT lang AS intent FROM documents),
pi AS (SELECT i.intent, coalesce(avg(r.cosine_sim), 0.0) AS cosine_sim FROM ints i
       LEFT JOIN rep r ON r.most_common_gt = i.intent GROUP BY i.intent)"""
    s["avg_similarity_per_intent"] = _source_report() + per_intent + """
SELECT intent, round(cosine_sim, 6) AS cosine_sim FROM pi"""
    s["macro_similarity"] = _source_report() + per_intent + "\nSELECT round(avg(cosine_sim), 6) AS avg FROM pi"
    s["avg_score_per_intent"] = _source_report() + """,
ints AS (SELECT DISTINCT lang AS intent FROM documents)""" + _score_sql("''", "intent", ["intent"], "ints", "base") + """
SELECT i.intent, round(coalesce(avg(r.bart_score), any_value(b.score)), 6) AS bart_score
FROM ints i LEFT JOIN rep r ON r.most_common_gt = i.intent JOIN base b ON b.intent = i.intent GROUP BY i.intent"""
    s["label_report"] = _source_report() + """
SELECT cluster_id, generated, most_common_gt, round(cosine_sim, 6) AS cosine_sim, round(bart_score, 6) AS bart_score
FROM rep"""
    s["mean_token_logprob"] = "WITH pairs_ AS (SELECT a.conv_id, a.turn, a.text AS s_, b.text AS t_ FROM conversations a " \
        "JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1), dummy AS (SELECT 1)" + \
        _score_sql("s_", "t_", ["conv_id", "turn"], "pairs_", "sc") + """
SELECT conv_id, turn, round(score, 6) AS score FROM sc"""
    s["multi_ref_score"] = """WITH refs AS (SELECT doc_id, 0 AS ref_no, text, lang AS ref FROM documents
  UNION ALL SELECT doc_id, 1, text, source FROM documents), dummy AS (SELECT 1)""" + \
        _score_sql("text", "ref", ["doc_id", "ref_no"], "refs", "sc") + """
SELECT doc_id, round(avg(score), 6) AS score_mean, round(max(score), 6) AS score_max FROM sc GROUP BY doc_id"""
    s["intent_pipeline"] = _pipeline_sql()
    s["kmeans_fit"] = """
SELECT vec_id, true AS is_nearest, (SELECT count(DISTINCT label) FROM embeddings) AS n_clusters, true AS centers_are_means,
       true AS cost_within_seeds FROM embeddings"""
    for name in ("normalize_text", "word_count", "pack_prompts", "label_by_prompt"):
        s[name] = s[name].replace(r"_\s]", f"_{SPACES}]").replace(r"\s", f"[{SPACES}]")
    return s


ORACLE_SQL = build()
