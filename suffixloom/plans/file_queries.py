"""Registered queries that write files or models to the shared folder and read them again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sources
from ..operators import counts, splits, trie, vectors
from ..sources import sinks
from ..sources.tables import Tables
from .queries import SQL, _weighted, query, r9, seg
from .views import Views, with_views


def _written(v: Views, lines: DataFrame) -> DataFrame:
    """The lines, written as text files and read again."""
    path = Tables(v.spark, "files").path()
    sinks.write_text(lines, path)
    return sources.text_lines(v.spark, path)


def _lexicon_lines(v: Views) -> DataFrame:
    return v.lexicon().select(F.concat_ws(" ", F.col("freq").cast("string"), "word").alias("value"))


@query("SELECT word, freq FROM lex WHERE freq >= 20 AND length(word) > 1", "lex")
def file_word_list(v: Views) -> DataFrame:
    return sources.parse_word_list(_written(v, _lexicon_lines(v)), 20)


@query("SELECT word, freq, CAST(freq AS DOUBLE) / (SELECT sum(freq) FROM lex) AS share FROM lex WHERE freq >= 20", "lex")
def file_corpus(v: Views) -> DataFrame:
    rows = sources.parse_word_list(_written(v, _lexicon_lines(v)), 0, 0)
    corpus = sources.last_by_order(rows, "word", "freq", "freq")
    total = corpus.agg(F.sum("freq").alias("total"))
    return corpus.crossJoin(F.broadcast(total)).where("freq >= 20").select("word", "freq", (F.col("freq") / F.col("total")).alias("share"))


@query("SELECT DISTINCT word FROM lex", "lex")
def file_targets(v: Views) -> DataFrame:
    return sources.decode_targets(_written(v, _lexicon_lines(v)))


@query("SELECT word FROM w WHERE word < 'n'", "w")
def file_until_blank(v: Views) -> DataFrame:
    words = v.words().select("word", (F.col("word") >= "n").cast("int").alias("after"))
    blank = v.spark.createDataFrame([(" ", "0n")], "word string, line_no string")
    lines = words.select("word", F.concat(F.col("after").cast("string"), "word").alias("line_no"))
    path = Tables(v.spark, "files").path()
    lines.unionByName(blank).write.option("sep", "\t").csv(path)
    read = v.spark.read.schema("word string, line_no string").option("sep", "\t").csv(path)
    return sources.until_blank(read.select(F.coalesce("word", F.lit("")).alias("value"), "line_no")).select(F.col("value").alias("word"))


@query("SELECT CAST(freq AS DOUBLE) AS freq, array_to_string(morphs, '+') AS seg FROM sf", "sf")
def file_segmented(v: Views) -> DataFrame:
    lines = _weighted(v).select(F.concat_ws(" ", F.col("freq").cast("string"), F.array_join("morphs", "+")).alias("value"))
    return sources.parse_segmented(_written(v, lines)).select("freq", seg())


@query("SELECT prefix, CAST(count(DISTINCT CASE WHEN k = length(word) THEN '$' ELSE substring(word, k + 1, 1) END) AS INT) AS n_children FROM (SELECT word, substring(word, 1, k) AS prefix, k FROM pk) GROUP BY prefix", "pk")
def file_hand_segmented(v: Views) -> DataFrame:
    rows = sources.parse_hand_segmented(_written(v, v.segments().select(F.array_join("morphs", "+").alias("value"))))
    return trie.trie_nodes(trie.single(rows.select("word"))).select("prefix", "n_children")


def _cluster_lines(v: Views) -> DataFrame:
    vs = v.vectors()
    near = vectors.nearest(vs.where("vec_id % 20 = 0").select("word"), vs, 5)
    rows = near.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour"))).alias("ns"))  # five of a word
    return rows.select(F.concat_ws(" ", "word", F.transform("ns", lambda n: n["neighbour"])).alias("value"))


@query(None)
def file_clusters(v: Views) -> DataFrame:
    return trie.trie_nodes(sources.parse_clusters(_written(v, _cluster_lines(v))))


def _vector_lines(v: Views) -> DataFrame:
    return v.vectors().select(F.concat_ws(" ", "word", F.transform("vec", lambda x: x.cast("string"))).alias("value"))


@query("SELECT word, round(list_sum(CAST(vec AS DOUBLE[])), 6) AS total, CAST(len(vec) AS INT) AS n FROM vc", "vc")
def file_vectors(v: Views) -> DataFrame:
    rows = sources.parse_vectors(_written(v, _vector_lines(v)))
    return rows.select("word", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"), F.size("vec").alias("n"))


@query("SELECT word FROM vc", "vc")
def file_vector_words(v: Views) -> DataFrame:
    return _written(v, _vector_lines(v)).select(F.split("value", " ")[0].alias("word"))


@query("SELECT word FROM vc SEMI JOIN wf USING (word)", "vc", "wf")
def file_vector_rows(v: Views) -> DataFrame:
    rows = _written(v, _vector_lines(v)).withColumn("word", F.split("value", " ")[0])
    return rows.join(v.frequent(), "word", "left_semi").select("word")


@query("SELECT count(*) AS n FROM lex", "lex")
def file_line_count(v: Views) -> DataFrame:
    return _written(v, _lexicon_lines(v)).agg(F.count("*").alias("n"))


@query("SELECT '1 ' || translate(word, 'öçüığş', 'OCUIGS') AS value FROM w", "w")
def file_first_column(v: Views) -> DataFrame:
    return _written(v, sinks.result_lines(v.segments())).select(F.concat(F.lit("1 "), F.split("value", "\t")[0]).alias("value"))


@query("SELECT word || chr(9) || array_to_string(morphs, ' ') AS value FROM sf", "sf")
def file_result_rows(v: Views) -> DataFrame:
    lines = _weighted(v).select(F.concat_ws(" ", F.col("freq").cast("string"), F.array_join("morphs", "+")).alias("value"))
    s = F.split("value", " ")[1]
    return _written(v, lines).select(F.concat_ws("\t", F.replace(s, F.lit("+"), F.lit("")), F.replace(s, F.lit("+"), F.lit(" "))).alias("value"))


@query("SELECT array_to_string(morphs, '+') AS value FROM seg SEMI JOIN wf USING (word)", "seg", "wf")
def file_baseline_rows(v: Views) -> DataFrame:
    rows = _written(v, v.segments().select(F.array_join("morphs", "+").alias("value"))).withColumn("word", F.replace("value", F.lit("+"), F.lit("")))
    return rows.join(v.frequent(), "word", "left_semi").select("value")


@query("SELECT trie_id, prefix, n_children, is_word FROM tn", "tn")
def model_tries(v: Views) -> DataFrame:
    path = Tables(v.spark, "model").path()
    sinks.write_tries(v.nodes(), path)
    return sources.load_tries(v.spark, path).select("trie_id", "prefix", "n_children", "is_word")


@query("SELECT morph, n FROM mc WHERE n > 25", "mc")
def model_counts(v: Views) -> DataFrame:
    path = Tables(v.spark, "model").path()
    sinks.write_model({"counts": v.counts(), "segments": v.segments(), "bigrams": counts.init_bigrams(v.segments())}, path)
    return sources.load_table(v.spark, path, "counts", 25).select("morph", "n")


@query(SQL["cosine_table"])
def model_maps(v: Views) -> DataFrame:
    """The three maps, stored and read again."""
    path = Tables(v.spark, "model").path()
    sinks.write_model({"branches": v.nodes(), "words": v.trie_words(), "cosines": vectors.cosine_table(v.words(), v.vectors())}, path)
    pairs = splits.prefix_pairs(sources.load_table(v.spark, path, "words"))
    return pairs.join(sources.load_table(v.spark, path, "cosines"), ["left", "prefix"], "left").select("left", "prefix", r9("cosine").alias("cosine"))


@query("SELECT word, [array_to_string(morphs, '+')] AS segs FROM seg", "seg")
def model_samples(v: Views) -> DataFrame:
    path = Tables(v.spark, "model").path()
    sinks.write_model({"samples": sinks.word_segmentations(v.segments().unionByName(v.segments()))}, path)
    return sources.load_table(v.spark, path, "samples").select("word", "segs")


@query("SELECT morph || ' : ' || CAST(n AS VARCHAR) AS value FROM mc WHERE n > 25", "mc")
def dump_counts(v: Views) -> DataFrame:
    return _written(v, sinks.dump_lines(v.counts().where("n > 25"), "n"))


@query("SELECT morph, round(p, 9) AS p FROM pd", "pd")
def dump_probs(v: Views) -> DataFrame:
    parts = F.split("value", " : ")
    return _written(v, sinks.dump_lines(v.decode_probs(), "p")).select(parts[0].alias("morph"), r9(parts[1].cast("double")).alias("p"))


@query("SELECT first, second, round((tr.n + 1) / CAST(tm.n + (SELECT count(*) FROM tm) AS DOUBLE), 9) AS p FROM tr JOIN tm ON tr.first = tm.morph", "tr", "tm")
def dump_transitions(v: Views) -> DataFrame:
    rows = _weighted(v)
    probs = counts.laplace_transitions(counts.transition_counts(rows, F.col("freq")), counts.transition_morphs(rows, F.col("freq")))
    value = F.col("value")
    pair, p = F.split(value, ":")[0], F.split(value, ":")[1]
    return _written(v, sinks.transition_lines(probs)).select(F.split(pair, "->")[0].alias("first"), F.split(pair, "->")[1].alias("second"), r9(p.cast("double")).alias("p"))


_GER = "replace(replace(replace(replace({0}, 'ä', 'ae'), 'ö', '{1}'), 'ü', 'ue'), 'ß', 'ss')"


@query(f"SELECT {_GER.format('word', 'oe')} || chr(9) || {_GER.format(chr(97) + 'rray_to_string(morphs, ' + chr(39) + ' ' + chr(39) + ')', 'O')} AS value FROM seg", "seg")
def sink_results_german(v: Views) -> DataFrame:
    return sinks.result_lines(v.segments(), "ger")


def _nested(v: Views) -> DataFrame:
    return vectors.nested_segment(v.lexicon(), v.vectors(), 0.05)


@query(None)
def nested_totals(v: Views) -> DataFrame:
    return sinks.nested_totals(_nested(v))


@query(None)
def nested_lines(v: Views) -> DataFrame:
    rows = _nested(v)
    both = sinks.nested_results(rows).withColumn("file", F.lit("results")).unionByName(sinks.nested_absents(rows).withColumn("file", F.lit("absents")))
    return both.unionByName(sinks.nested_stems(rows).withColumn("file", F.lit("stems"))).select("file", "value")


_NESTED_CTE = (
    """, cc AS (SELECT a.word AS x, b.word AS y, list_dot_product(CAST(a.vec AS DOUBLE[]), CAST(b.vec AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.vec AS DOUBLE[]), CAST(a.vec AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.vec AS DOUBLE[]), CAST(b.vec AS DOUBLE[])))) AS c
  FROM vc a JOIN vc b ON starts_with(b.word, a.word) AND a.word <> b.word),
fold AS (
  SELECT lex.word, freq, length(lex.word) AS stem, 1 AS k, CAST([] AS BIGINT[]) AS cuts FROM lex JOIN vc ON lex.word = vc.word
  UNION ALL
  SELECT f.word, f.freq, CASE WHEN c > 0.05 AND c < 0.99 THEN length(f.word) - k ELSE stem END, k + 1,
         CASE WHEN c > 0.05 AND c < 0.99 THEN list_prepend(length(f.word) - k, cuts) ELSE cuts END
  FROM fold f LEFT JOIN cc ON cc.x = substring(f.word, 1, length(f.word) - k) AND cc.y = substring(f.word, 1, stem)
  WHERE length(f.word) >= 3 AND k <= length(f.word) - 2
),
ended AS (SELECT word, freq, list_append(cuts, length(word)) AS es FROM fold WHERE length(word) < 3 OR k = length(word) - 1),
nest AS (SELECT lex.word, lex.freq, e.word IS NOT NULL AS found, [substring(e.word, CASE WHEN i = 1 THEN 1 ELSE es[i - 1] + 1 END, es[i] - CASE WHEN i = 1 THEN 0 ELSE es[i - 1] END) for i in range(1, len(es) + 1)] AS morphs FROM lex LEFT JOIN ended e ON e.word = lex.word)
"""
)


def _nested_sql(query_: str) -> str:
    return with_views("", "lex", "vc").rstrip() + _NESTED_CTE + query_


SQL["nested_segment"] = _nested_sql("SELECT word, freq, found, CASE WHEN found THEN array_to_string(morphs, '+') END AS seg FROM nest")
SQL["nested_totals"] = _nested_sql(
    "SELECT kind, key, CAST(sum(freq) AS BIGINT) AS mass FROM (SELECT 'result' AS kind, array_to_string(morphs, '+') AS key, freq FROM nest WHERE found "
    "UNION ALL SELECT 'stem', morphs[1], freq FROM nest WHERE found UNION ALL SELECT 'affix', unnest(morphs[2:]), freq FROM nest WHERE found "
    "UNION ALL SELECT 'absent', word, freq FROM nest WHERE NOT found) GROUP BY 1, 2"
)
SQL["nested_lines"] = _nested_sql(
    "SELECT 'results' AS file, freq || ' ' || array_to_string(morphs, '+') AS value FROM nest WHERE found UNION ALL SELECT 'absents', freq || ' ' || word FROM nest WHERE NOT found "
    "UNION ALL SELECT 'stems', CAST(sum(freq) AS BIGINT) || ' ' || morphs[1] FROM nest WHERE found GROUP BY morphs[1]"
)
