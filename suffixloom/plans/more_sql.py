"""SQL of the queries that chain cosines, sample by hashes or sweep thresholds."""

from __future__ import annotations

from .model_queries import _CLASS, _CUT, _P4, _UNI, _with_neighbours
from .queries import _COS, _RS, SQL
from .views import _CTES, with_views

SQL["file_clusters"] = SQL["knn_tries"]

# Tilings with chains of cosines

_CHAIN = f"""
, dp AS (SELECT word, morphs, ends, score, array_to_string(morphs[1:i], '') AS x, array_to_string(morphs[1:i + 1], '') AS y FROM (SELECT *, unnest(range(1, len(morphs))) AS i FROM done)),
ch AS (SELECT dp.word, morphs, ends, score, va.vec IS NOT NULL AS kx, vb.vec IS NOT NULL AS ky, {_COS.format("va.vec", "vb.vec")} AS c FROM dp LEFT JOIN vc va ON va.word = x LEFT JOIN vc vb ON vb.word = y)
"""


def _chained(score: str, having: str = "") -> str:
    head = with_views("", "st", "tm", "tr", "wf", "vc").rstrip() + _RS.rstrip() + _CHAIN
    return head + f", sc AS (SELECT word, morphs, ends, score + {score} AS score FROM ch GROUP BY word, morphs, ends, score {having})"


_BEST = " SELECT word, array_to_string(morphs, '+') AS seg, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, ends) AS r FROM sc) WHERE r = 1"

SQL["resegment_binomial_np"] = _chained("count(*) FILTER (coalesce(c, -1) >= 0.25) * ln(0.85) + count(*) FILTER (NOT coalesce(c, -1) >= 0.25) * ln(0.15)") + _BEST
SQL["resegment_binomial_c"] = _chained("sum(ln(CASE WHEN c IS NULL OR c <= 0 THEN 0.05 ELSE c END))") + _BEST
SQL["resegment_semantic"] = _chained("trunc(trunc(sum(CASE WHEN kx OR ky THEN -1.0 ELSE coalesce(c, 0.0) END)) / 3) * ln(10)") + _BEST
SQL["chained_splits"] = _chained("0", "HAVING min(coalesce(c, -1)) >= 0.25") + " SELECT word, array_to_string(morphs, '+') AS seg FROM sc"

_ALLO = (
    _RS.replace("v AS (SELECT count(*) AS v FROM tm)", f"ctr AS (SELECT {_CLASS.format('first')} AS first, {_CLASS.format('second')} AS second, sum(n) AS n FROM tr GROUP BY 1, 2),\nctm AS (SELECT {_CLASS.format('morph')} AS morph, sum(n) AS n FROM tm GROUP BY 1),\nv AS (SELECT count(*) AS v FROM ctm)")
    .replace("AS DOUBLE)), af.morph\n", f"AS DOUBLE)), {_CLASS.format('af.morph')}\n")
    .replace("JOIN tm a ON", "JOIN ctm a ON")
    .replace("LEFT JOIN tr ON tr.first = rt.prev AND tr.second = af.morph", f"LEFT JOIN ctr tr ON tr.first = rt.prev AND tr.second = {_CLASS.format('af.morph')}")
    .replace("LEFT JOIN tr ON tr.first = rt.prev AND tr.second = 'END'", "LEFT JOIN ctr tr ON tr.first = rt.prev AND tr.second = 'END'")
)
SQL["resegment_allomorph"] = (
    with_views("", "st", "tm", "tr", "wf").rstrip() + _ALLO + "SELECT word, array_to_string(morphs, '+') AS seg, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, ends) AS r FROM done) WHERE r = 1"
)

# Decoders

_TILE, _ = _CTES["tile"]
_GOLD = _TILE.replace("wf", "lex").replace("FROM tile JOIN", "FROM gt JOIN").replace("tile.", "gt.")
SQL["decode_gold"] = (
    with_views("", "lex", "pd", "seg", "mt").rstrip()
    + f", gt AS ({_GOLD}), gb AS (SELECT * FROM (SELECT word, morphs, row_number() OVER (PARTITION BY word ORDER BY score DESC, ends) AS r FROM gt WHERE b = length(word)) WHERE r = 1), "
    "gold AS (SELECT mt.word, any_value(seg.morphs) AS morphs FROM mt JOIN seg ON mt.word = seg.word LEFT JOIN pd ON pd.morph = mt.morph GROUP BY mt.word HAVING count(*) = count(pd.morph)) "
    "SELECT lex.word, array_to_string(coalesce(gold.morphs, gb.morphs, [lex.word]), '+') AS seg FROM lex LEFT JOIN gold ON gold.word = lex.word LEFT JOIN gb ON gb.word = lex.word"
)
SQL["decode_sweep"] = (
    with_views("", "wf", "mc").rstrip()
    + """, th AS (SELECT unnest([0, 1, 5, 9, 25]) AS t), pt AS (SELECT t, morph, n / CAST(sum(n) OVER (PARTITION BY t) AS DOUBLE) AS p FROM th JOIN mc ON n > t),
ts AS (
  SELECT t, word, length(morph) AS b, [morph] AS morphs, [length(morph)] AS ends, log10(p) AS score FROM wf JOIN pt ON starts_with(wf.word, morph)
  UNION ALL
  SELECT ts.t, ts.word, b + length(pt.morph), list_append(morphs, pt.morph), list_append(ends, b + length(pt.morph)), score + log10(p)
  FROM ts JOIN pt ON ts.t = pt.t AND substring(ts.word, b + 1, length(pt.morph)) = pt.morph WHERE b < length(ts.word)
), tb AS (SELECT t, word, morphs, score, row_number() OVER (PARTITION BY t, word ORDER BY score DESC, ends) AS r FROM ts WHERE b = length(word))
SELECT CAST(th.t AS INT) AS threshold, wf.word, array_to_string(coalesce(morphs, [wf.word]), '+') AS seg, round(score, 9) AS score FROM wf CROSS JOIN th LEFT JOIN tb ON tb.t = th.t AND tb.word = wf.word AND r = 1"""
)

# Splits by vectors

_CUTS = (
    "SELECT word, [i, length(word)] AS es FROM (SELECT word, unnest(range(1, length(word))) AS i FROM vc) "
    "UNION ALL SELECT word, [i, j, length(word)] FROM (SELECT word, i, unnest(range(i + 1, length(word))) AS j FROM (SELECT word, unnest(range(1, length(word))) AS i FROM vc)) "
    "UNION ALL SELECT word, [i, j, k, length(word)] FROM (SELECT word, i, j, unnest(range(j + 1, length(word))) AS k FROM (SELECT word, i, unnest(range(i + 1, length(word))) AS j FROM (SELECT word, unnest(range(1, length(word))) AS i FROM vc)))"
)
_LADDER = "[0.3, 0.25, 0.2, 0.15000000000000002, 0.10000000000000002, 0.05000000000000002, 1.3877787807814457e-17, -0.04999999999999999]"
SQL["multisplit_top10"] = (
    with_views("", "vc").rstrip()
    + f""", sp AS ({_CUTS}), sq AS (SELECT word, es, unnest(range(1, len(es))) AS i FROM sp),
sr AS (SELECT sq.word, es, {_COS.format("va.vec", "vb.vec")} AS c FROM sq JOIN vc va ON va.word = substring(sq.word, 1, es[i]) JOIN vc vb ON vb.word = substring(sq.word, 1, es[i + 1])),
ss AS (SELECT word, es, len(es) AS m, min(c) AS least, sum(c) / len(es) AS score FROM sr WHERE c < 1 GROUP BY word, es HAVING count(*) = len(es) - 1),
sv AS (SELECT *, list_max(list_filter(CAST({_LADDER} AS DOUBLE[]), lambda x: x < least)) AS t FROM ss),
sw AS (SELECT *, max(t) OVER (PARTITION BY word, m) AS threshold FROM sv WHERE t IS NOT NULL),
sx AS (SELECT word, array_to_string([substring(word, CASE WHEN i = 1 THEN 1 ELSE es[i - 1] + 1 END, es[i] - CASE WHEN i = 1 THEN 0 ELSE es[i - 1] END) for i in range(1, len(es) + 1)], '-') AS seg, score FROM sw WHERE least > threshold),
sy AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, seg) AS r FROM sx),
sz AS (SELECT word, list(seg ORDER BY r) AS segs FROM sy WHERE r <= 10 GROUP BY word)
SELECT word, array_to_string(list_concat(segs, [segs[-1] for i in range(0, 10 - len(segs))]), '+') AS splits FROM sz"""
)

# Samplers

_U_CUTS, _U_PLACE = _UNI.format("word || '|cuts|42'"), _UNI.format("word || '|' || k || '|42'")
_PIECES = "[substring(word, CASE WHEN i = 1 THEN 1 ELSE es[i - 1] + 1 END, es[i] - CASE WHEN i = 1 THEN 0 ELSE es[i - 1] END) for i in range(1, len(es) + 1)]"
_RANDOM = (
    f", rc AS (SELECT word, CAST(floor({_U_CUTS} * length(word)) AS INT) AS c FROM w), "
    f"rk AS (SELECT word, c, k, row_number() OVER (PARTITION BY word ORDER BY {_U_PLACE}, k) AS r FROM (SELECT word, c, unnest(range(1, length(word))) AS k FROM rc)), "
    "re AS (SELECT word, list(k ORDER BY k) AS ks FROM rk WHERE r <= c GROUP BY word), "
    f"rs AS (SELECT word, {_PIECES} AS morphs FROM (SELECT w.word, list_append(coalesce(ks, CAST([] AS BIGINT[])), length(w.word)) AS es FROM w LEFT JOIN re ON re.word = w.word))"
)
SQL["random_splits"] = with_views("", "w").rstrip() + _RANDOM + " SELECT word, array_to_string(morphs, '+') AS seg FROM rs"


def _steps(old_similarity: str | None = None, presence: bool = True) -> str:
    """The joint score of the segmentations (kind, word, morphs) in ``both`` and the Metropolis step from ``old`` to ``new``."""
    sim = f"CASE WHEN y IS NULL THEN 0.0 ELSE log10({_CUT}) END"
    if old_similarity is not None:
        sim = f"CASE WHEN kind = 'old' THEN {old_similarity} ELSE {sim} END"
    pres = "+ sum(log10(coalesce(freq, 1e-7) / (SELECT sum(freq) FROM lex)))" if presence else ""
    u = _UNI.format("a.word || '|1|accept|42'")
    return f"""
, bx AS (SELECT kind, word, morphs, i, array_to_string(morphs[1:i], '') AS x, CASE WHEN i < len(morphs) THEN array_to_string(morphs[1:i + 1], '') END AS y FROM (SELECT *, unnest(range(1, greatest(len(morphs), 2))) AS i FROM "both")),
bc AS (SELECT kind, bx.word, x, y, {_COS.format("va.vec", "vb.vec")} AS c FROM bx LEFT JOIN vc va ON va.word = x LEFT JOIN vc vb ON vb.word = y),
bp AS (SELECT kind, bc.word, sum(log10({_P4})) + sum({sim}) {pres} AS prior FROM bc LEFT JOIN tn ON tn.trie_id = substring(bc.word, 1, 3) AND tn.prefix = x LEFT JOIN lex ON lex.word = x GROUP BY 1, 2),
bl AS (SELECT kind, word, sum(log10(coalesce(p, 1e-7))) AS lik FROM (SELECT kind, word, unnest(morphs) AS morph FROM "both") t LEFT JOIN pr ON pr.morph = t.morph GROUP BY 1, 2),
bs2 AS (SELECT b.kind, b.word, b.morphs, lik + prior AS score FROM "both" b JOIN bp ON bp.kind = b.kind AND bp.word = b.word JOIN bl ON bl.kind = b.kind AND bl.word = b.word)
SELECT word, array_to_string(CASE WHEN accepted THEN m1 ELSE m0 END, '+') AS seg, accepted FROM (
SELECT a.word, a.morphs AS m0, b.morphs AS m1, b.score > a.score OR {u} < pow(10, least(b.score - a.score, 0)) AS accepted FROM bs2 a JOIN bs2 b ON a.word = b.word WHERE a.kind = 'old' AND b.kind = 'new')"""


_VIEWS = ("w", "seg", "pr", "tn", "lex", "vc")
SQL["metropolis_step"] = with_views("", *_VIEWS).rstrip() + _RANDOM + ", \"both\" AS (SELECT 'old' AS kind, word, morphs FROM seg UNION ALL SELECT 'new', word, morphs FROM rs)" + _steps()
_U_BIASED = _UNI.format("word || '|biased|42'")
SQL["metropolis_binary"] = (
    with_views("", *_VIEWS).rstrip()
    + f", bk AS (SELECT word, CAST(floor({_U_BIASED} * CASE WHEN length(word) > 4 THEN 5 ELSE length(word) END) AS INT) AS k FROM w), "
    "\"both\" AS (SELECT 'old' AS kind, word, [word] AS morphs FROM bk WHERE k > 0 UNION ALL SELECT 'new', word, [substring(word, 1, length(word) - k), substring(word, length(word) - k + 1, k)] FROM bk WHERE k > 0)"
    + _steps("-6.0", presence=False)
)
SQL["block_presence"] = (
    with_views("", "bd", "pk", "tw", "tn", "lex", "mt").rstrip()
    + """, b1 AS (SELECT trie_id, min(prefix) AS candidate FROM bd GROUP BY 1), bo AS (SELECT bd.trie_id, bd.prefix FROM bd LEFT JOIN b1 ON b1.trie_id = bd.trie_id AND b1.candidate = bd.prefix WHERE b1.trie_id IS NULL),
oc AS (SELECT p.trie_id, p.word, list_sort(list(p.k)) AS cuts FROM pk p JOIN bo b ON p.trie_id = b.trie_id AND substring(p.word, 1, p.k) = b.prefix WHERE p.k < length(p.word) GROUP BY 1, 2),
oe AS (SELECT tw.trie_id, tw.word, list_append(coalesce(cuts, CAST([] AS BIGINT[])), length(tw.word)) AS es FROM tw LEFT JOIN oc ON oc.trie_id = tw.trie_id AND oc.word = tw.word),
ot AS (SELECT trie_id, unnest("""
    + _PIECES
    + """) AS token FROM oe),
ad AS (SELECT DISTINCT trie_id, morph AS token FROM mt EXCEPT SELECT trie_id, token FROM ot), rm AS (SELECT DISTINCT trie_id, token FROM ot EXCEPT SELECT trie_id, morph FROM mt),
ta AS (SELECT ad.trie_id, count(DISTINCT ad.token) AS n FROM ad JOIN b1 ON b1.trie_id = ad.trie_id JOIN rm ON rm.trie_id = ad.trie_id AND rm.token = candidate || ad.token GROUP BY 1),
ms AS (SELECT coalesce(t.prefix, lex.word) AS word, coalesce(freq, 0) + CAST(0.1 AS DOUBLE) AS mass FROM (SELECT DISTINCT prefix FROM tn) t FULL JOIN lex ON t.prefix = lex.word)
SELECT b1.trie_id, candidate, coalesce(n, 0) AS n_tails, round(coalesce(n, 0) * log10(mass / (SELECT sum(mass) FROM ms)), 9) AS "new", round(coalesce(n, 0) * CAST(-5.23357304130864 AS DOUBLE), 9) AS "old"
FROM b1 LEFT JOIN ta ON ta.trie_id = b1.trie_id LEFT JOIN ms ON ms.word = candidate"""
)

_BLOCK = """
, b1 AS (SELECT trie_id, min(prefix) AS prefix FROM bd GROUP BY 1), bo AS (SELECT bd.trie_id, bd.prefix FROM bd LEFT JOIN b1 ON b1.trie_id = bd.trie_id AND b1.prefix = bd.prefix WHERE b1.trie_id IS NULL),
oc AS (SELECT p.trie_id, p.word, list_sort(list(p.k)) AS cuts FROM pk p JOIN bo b ON p.trie_id = b.trie_id AND substring(p.word, 1, p.k) = b.prefix WHERE p.k < length(p.word) GROUP BY 1, 2),
oe AS (SELECT tw.trie_id, tw.word, list_append(coalesce(cuts, CAST([] AS BIGINT[])), length(tw.word)) AS es FROM tw SEMI JOIN b1 ON b1.trie_id = tw.trie_id LEFT JOIN oc ON oc.trie_id = tw.trie_id AND oc.word = tw.word),
tk AS (SELECT 'now' AS side, trie_id, morph, count(*) AS k FROM (SELECT trie_id, unnest({pieces}) AS morph FROM oe) GROUP BY 2, 3 UNION ALL SELECT 'was', trie_id, morph, count(*) FROM mt SEMI JOIN b1 ON b1.trie_id = mt.trie_id GROUP BY 2, 3),
ow AS (SELECT trie_id, morph, k AS o FROM tk WHERE side = 'was'), dz AS (SELECT trie_id, sum(o) AS d FROM ow GROUP BY 1),
tb AS (SELECT tk.side, tk.trie_id, tk.morph, tk.k, CAST(coalesce(mc.n, 0) - coalesce(ow.o, 0) AS DOUBLE) AS base,
  CAST((SELECT sum(n) FROM mc) - d + coalesce(sum(tk.k) OVER (PARTITION BY tk.side, tk.trie_id ORDER BY tk.morph ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS size
  FROM tk LEFT JOIN mc ON mc.morph = tk.morph LEFT JOIN ow ON ow.trie_id = tk.trie_id AND ow.morph = tk.morph JOIN dz ON dz.trie_id = tk.trie_id),
sc AS (SELECT side, trie_id, sum(log10(CASE WHEN base > 0 THEN base / (size + 0.1) ELSE 0.1 * pow(0.037, length(morph) + 1) / (size + 0.1) END) + coalesce(list_sum([log10((base + j) / (size + j + 0.1)) for j in range(1, k)]), 0)) AS score FROM tb GROUP BY 1, 2),
bk AS (SELECT b1.trie_id, b1.prefix, x.score - y.score AS d_dp, -log10({p4}) AS d_poisson, -coalesce(ns.score, 0) AS d_similarity
  FROM b1 JOIN sc x ON x.trie_id = b1.trie_id AND x.side = 'now' JOIN sc y ON y.trie_id = b1.trie_id AND y.side = 'was' JOIN tn ON tn.trie_id = b1.trie_id AND tn.prefix = b1.prefix LEFT JOIN ns ON ns.trie_id = b1.trie_id AND ns.prefix = b1.prefix),
bz AS (SELECT *, d_dp + d_poisson + d_similarity > 0 OR {u} < pow(10, least(d_dp + d_poisson + d_similarity, 0)) AS accepted FROM bk)
""".format(pieces=_PIECES, p4=_P4, u=_UNI.format("trie_id || '|1|block|42'"))

_BLOCK_VIEWS = ("pk", "tw", "mt", "mc")
SQL["block_step"] = _with_neighbours("", *_BLOCK_VIEWS).rstrip() + _BLOCK + "SELECT trie_id, prefix, round(d_dp, 9) AS d_dp, round(d_poisson, 9) AS d_poisson, round(d_similarity, 9) AS d_similarity, accepted FROM bz"
SQL["block_bounds"] = _with_neighbours("", *_BLOCK_VIEWS).rstrip() + _BLOCK + "SELECT bd.trie_id, bd.prefix FROM bd LEFT JOIN bz ON bz.trie_id = bd.trie_id AND bz.prefix = bd.prefix AND accepted WHERE bz.trie_id IS NULL"

#: A sweep under the bigram DP model with separated tables: level by level, against counts without the word's own.
SQL["gibbs_sweep_1"] = (
    with_views("", "mk", "bg").rstrip()
    + """, gs AS MATERIALIZED (SELECT m[1] AS morph, count(*) AS n FROM mk GROUP BY 1), gf AS MATERIALIZED (SELECT morph, count(*) AS n FROM (SELECT unnest(m[2:]) AS morph FROM mk) GROUP BY 1),
gb AS MATERIALIZED (SELECT first, second, n FROM bg), gm AS MATERIALIZED (SELECT word, m, (SELECT sum(n) FROM gs) - 1 AS n_s, (SELECT sum(n) FROM gf) - (len(m) - 1) AS n_f FROM mk),
of AS MATERIALIZED (SELECT word, morph, count(*) AS k FROM (SELECT word, unnest(m[2:]) AS morph FROM mk) GROUP BY 1, 2),
ob AS MATERIALIZED (SELECT word, m[i] AS first, m[i + 1] AS second, count(*) AS k FROM (SELECT word, m, unnest(range(1, len(m))) AS i FROM mk) GROUP BY 1, 2, 3),
sweep AS (
  SELECT word, word AS lft, CAST([] AS VARCHAR[]) AS tail, false AS done, 0 AS level FROM mk
  UNION ALL
  SELECT word, stem, CASE WHEN suffix = '$' THEN tail ELSE list_prepend(suffix, tail) END, suffix = '$', level + 1 FROM (
    SELECT *, row_number() OVER (PARTITION BY word ORDER BY prob, idx) AS r FROM (
      SELECT *, sum(prob) OVER (PARTITION BY word ORDER BY prob, idx ROWS UNBOUNDED PRECEDING) AS cdf, lead(idx) OVER (PARTITION BY word ORDER BY prob, idx) IS NULL AS last FROM (
        SELECT *, weight / sum(weight) OVER (PARTITION BY word) AS prob FROM (
          SELECT *, pow(10, log10(CASE WHEN ns > 0 THEN ns / (n_s + 0.01) ELSE 0.01 * pow(0.037, length(stem) + 1) / (n_s + 0.01) END) + log10(CASE WHEN ns > 0 AND nsf > 0 THEN nsf / ns + 0.01
            ELSE 0.01 * CASE WHEN nf > 0 THEN nf / (n_f + 0.01) ELSE 0.01 * pow(0.037, CASE WHEN suffix = '$' THEN 0 ELSE length(suffix) END + 1) / (n_f + 0.01) END END)) AS weight FROM (
            SELECT c.word, c.tail, c.level, c.idx, c.stem, c.suffix, CAST(gm.n_s AS DOUBLE) AS n_s, CAST(gm.n_f AS DOUBLE) AS n_f,
              CAST(coalesce(gs.n, 0) - CASE WHEN gm.m[1] = c.stem THEN 1 ELSE 0 END AS DOUBLE) AS ns, CAST(coalesce(gf.n, 0) - coalesce(of.k, 0) AS DOUBLE) AS nf, CAST(coalesce(gb.n, 0) - coalesce(ob.k, 0) AS DOUBLE) AS nsf
            FROM (SELECT word, tail, level, idx, substring(lft, 1, length(lft) - idx) AS stem, CASE WHEN idx = 0 THEN '$' ELSE substring(lft, length(lft) - idx + 1, idx) END AS suffix FROM (
              SELECT word, lft, tail, level, unnest(range(0, CASE WHEN length(lft) >= 6 THEN 5 WHEN length(lft) > 1 THEN length(lft) - 1 ELSE length(lft) END)) AS idx FROM sweep WHERE NOT done)) c
            JOIN gm ON gm.word = c.word LEFT JOIN gs ON gs.morph = c.stem LEFT JOIN gf ON gf.morph = c.suffix LEFT JOIN gb ON gb.first = c.stem AND gb.second = c.suffix
            LEFT JOIN of ON of.word = c.word AND of.morph = c.suffix LEFT JOIN ob ON ob.word = c.word AND ob.first = c.stem AND ob.second = c.suffix))))
    WHERE cdf > """
    + _UNI.format("word || '|1|' || level || '|42'")
    + """ OR last) WHERE r = 1
)
SELECT word, array_to_string(list_prepend(lft, tail), '+') AS seg FROM sweep WHERE done"""
)
