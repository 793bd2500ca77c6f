"""Likelihoods, posteriors and sampling.

Sampling is seeded by hashes of (word, sweep, level), so results don't depend on partitioning.  A sweep draws every word
against a snapshot of the counts and then recounts: the published approximation for distributed Gibbs sampling.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scores import hash_uniform, log10, poisson
from ..params import DEFAULT, Params
from ..sources.tables import Tables
from .counts import init_bigrams, init_unigrams
from .splits import binary_splits


def _totals(table: DataFrame, name: str) -> DataFrame:
    """One row: the tokens and the types of a table."""
    return table.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias(f"N_{name}"), F.count("*").cast("double").alias(f"T_{name}"))


def own_counts(segments: DataFrame, separated: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What each word's segmentation has put into the tables: stems, suffixes, bigrams (each with word and k), and its tokens."""
    marked = segments.select("word", F.when(F.size("morphs") == 1, F.concat("morphs", F.array(F.lit("$")))).otherwise(F.col("morphs")).alias("m"))
    tokens = marked.select("word", F.posexplode("m").alias("pos", "morph"))
    count_of = lambda rows: rows.groupBy("word", "morph").agg(F.count("*").cast("double").alias("k"))
    pairs = marked.select("word", F.explode(F.expr("transform(sequence(1, size(m) - 1), i -> struct(m[i - 1] as stem, m[i] as suffix))")).alias("p"))
    bigrams = pairs.groupBy("word", "p.stem", "p.suffix").agg(F.count("*").cast("double").alias("k"))
    size = F.size("m").cast("double")
    if not separated:
        one = count_of(tokens)
        return one, one, bigrams, marked.select("word", size.alias("d_s"), size.alias("d_f"))
    return count_of(tokens.where("pos = 0")), count_of(tokens.where("pos > 0")), bigrams, marked.select("word", F.lit(1.0).alias("d_s"), (size - 1).alias("d_f"))


def with_counts(candidates: DataFrame, stems: DataFrame, suffixes: DataFrame, bigrams: DataFrame, own=None) -> DataFrame:
    """Candidates with ns, nf, nsf and the totals, which are one row each.

    ``own`` are the counts of each candidate's ``word``, which are taken out first; emptied entries stay in the tables.
    """
    rows = candidates.join(stems.select(F.col("morph").alias("stem"), F.col("n").cast("double").alias("ns")), "stem", "left")
    rows = rows.join(suffixes.select(F.col("morph").alias("suffix"), F.col("n").cast("double").alias("nf")), "suffix", "left")
    rows = rows.join(bigrams.select(F.col("first").alias("stem"), F.col("second").alias("suffix"), F.col("n").cast("double").alias("nsf")), ["stem", "suffix"], "left")
    contexts = bigrams.agg(F.count_distinct("first").cast("double").alias("B"))
    rows = rows.crossJoin(F.broadcast(_totals(stems, "s"))).crossJoin(F.broadcast(_totals(suffixes, "f"))).crossJoin(F.broadcast(contexts))
    rows = rows.fillna(0.0, ["ns", "nf", "nsf"])
    if own is None:
        return rows
    s, f, b, sizes = own
    rows = rows.join(s.select("word", F.col("morph").alias("stem"), F.col("k").alias("ks")), ["word", "stem"], "left")
    rows = rows.join(f.select("word", F.col("morph").alias("suffix"), F.col("k").alias("kf")), ["word", "suffix"], "left")
    rows = rows.join(b.withColumnRenamed("k", "kb"), ["word", "stem", "suffix"], "left").join(sizes, "word", "left")
    rows = rows.fillna(0.0, ["ks", "kf", "kb", "d_s", "d_f"])
    for n, k in (("ns", "ks"), ("nf", "kf"), ("nsf", "kb"), ("N_s", "d_s"), ("N_f", "d_f")):
        rows = rows.withColumn(n, F.col(n) - F.col(k))
    return rows.drop("ks", "kf", "kb", "d_s", "d_f")


def _len(x: str) -> Column:
    return F.when(F.col(x) == "$", 0).otherwise(F.length(x))


def unigram_likelihood(model: str, separated: bool, p: Params = DEFAULT) -> Column:
    """log10 of P(stem) P(suffix) of a candidate.  In a unified table the stem is counted before the suffix is scored."""
    a, g, d = p.alpha, p.gamma, p.discount
    one = F.lit(0.0 if separated else 1.0)
    nf = F.col("nf") + F.when(F.col("stem") == F.col("suffix"), one).otherwise(0.0)
    tf = F.col("T_f") + (F.lit(0.0) if separated else F.when(F.col("ns") == 0, 1.0).otherwise(0.0))

    def term(n: Column, total: Column, types: Column, length: Column, bare: bool = False) -> Column:
        if model == "ml":
            total = F.nullif(total, F.lit(0.0))
            return F.when(n > 0, n / total).otherwise(p.smoothing / total)
        if model == "dp":
            return F.when(n > 0, n / (total + a)).otherwise(a * F.pow(F.lit(g), length + 1) / (total + a))
        seen = (n - d) / (total if bare else total + a)
        return F.when(n > 0, seen).otherwise((a + d * types) * F.pow(F.lit(g), length + 1) / (total + a))

    stem = term(F.col("ns"), F.col("N_s"), F.col("T_s"), _len("stem"), separated)
    suffix = term(nf, F.col("N_f") + one, tf, _len("suffix"))
    return log10(stem) + log10(suffix)


def bigram_likelihood(model: str, separated: bool, p: Params = DEFAULT, fix_precedence: bool = False) -> Column:
    """log10 of P(stem) P(suffix | stem) with back-off to the suffix's own probability."""
    a, g, d = p.alpha, p.gamma, p.discount
    one = F.lit(0.0 if separated else 1.0)
    ns, nsf, n_s = F.col("ns"), F.col("nsf"), F.nullif(F.col("N_s"), F.lit(0.0)) if model == "ml" else F.col("N_s")
    nf = F.col("nf") + F.when(F.col("stem") == F.col("suffix"), one).otherwise(0.0)
    n_f = F.col("N_f") + one
    tf = F.col("T_f") + (F.lit(0.0) if separated else F.when(ns == 0, 1.0).otherwise(0.0))
    base_s, base_f = F.pow(F.lit(g), _len("stem") + 1), F.pow(F.lit(g), _len("suffix") + 1)
    safe = F.when(ns > 0, ns).otherwise(1.0)
    if model == "ml":
        stem = F.when(ns > 0, ns / n_s).otherwise(p.smoothing / n_s)
        back = F.when(nf > 0, nf / n_f).otherwise(p.smoothing / n_f)
        cond = F.when((ns > 0) & (nsf > 0), nsf / safe).otherwise(back)
    elif model == "dp":
        stem = F.when(ns > 0, ns / (n_s + a)).otherwise(a * base_s / (n_s + a))
        back = a * F.when(nf > 0, nf / (n_f + a)).otherwise(a * base_f / (n_f + a))
        seen = nsf / (safe + a) if fix_precedence else nsf / safe + a
        cond = F.when((ns > 0) & (nsf > 0), seen).otherwise(back)
    else:
        weight = a + d * F.col("B")
        stem = F.when(ns > 0, (ns - d) / (n_s + a)).otherwise((a + d * F.col("T_s")) * base_s / (n_s + a))
        back = weight * F.when(nf > 0, nf - d).otherwise((a + d * tf) * base_f) / (n_f + a)
        seen = (nsf - d) / (safe + a) if fix_precedence else (nsf - d) / safe + a
        cond = F.when((ns > 0) & (nsf > 0), seen).otherwise(back)
    return log10(stem) + log10(cond)


def count_tables(segments: DataFrame, separated: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stem, suffix and bigram tables; the first two are the same table if they aren't separated.  ``$`` follows whole words."""
    marked = segments.withColumn("morphs", F.when(F.size("morphs") == 1, F.concat("morphs", F.array(F.lit("$")))).otherwise(F.col("morphs")))
    bigrams = init_bigrams(marked, mark=False)
    if not separated:
        one = init_unigrams(marked).select("morph", "n")
        return one, one, bigrams
    both = init_unigrams(marked, separated=True)
    return both.where("kind = 'stem'").select("morph", "n"), both.where("kind = 'suffix'").select("morph", "n"), bigrams


def normalised(rows: DataFrame, score: Column) -> DataFrame:
    """(word, left, idx, stem, suffix, prob): 10 to the score, over the sum for the word."""
    rows = rows.withColumn("weight", F.pow(F.lit(10.0), score))
    total = F.sum("weight").over(W.partitionBy("word"))
    return rows.select("word", "left", "idx", "stem", "suffix", F.try_divide("weight", total).alias("prob"))


def posterior(segments: DataFrame, tables: tuple[DataFrame, DataFrame, DataFrame], grams: str, model: str, separated: bool, p: Params = DEFAULT, min_stem: int = 2, left: DataFrame | None = None, own=None) -> DataFrame:
    """(word, left, idx, stem, suffix, prob): the distribution over binary splits under the counts without the word's own.

    ``left`` (word, left) is the part of each word that is split, the whole word by default; ``own`` are ``own_counts``.
    """
    left = segments.select("word", F.col("word").alias("left")) if left is None else left
    cands = binary_splits(left.select(F.col("left").alias("word")).distinct(), min_stem).withColumnRenamed("word", "left")
    rows = with_counts(left.join(cands, "left"), *tables, own=own or own_counts(segments, separated))
    return normalised(rows, unigram_likelihood(model, separated, p) if grams == "uni" else bigram_likelihood(model, separated, p))


def draw(candidates: DataFrame, sweep: int, level: int, seed: int) -> DataFrame:
    """One candidate a word: inverse of the distribution function over ascending (probability, idx)."""
    w = W.partitionBy("word").orderBy("prob", "idx")
    u = hash_uniform(F.col("word"), F.lit(str(sweep)), F.lit(str(level)), F.lit(str(seed)))
    rows = candidates.withColumn("cdf", F.sum("prob").over(w)).withColumn("last", F.lead("idx").over(w).isNull()).withColumn("u", u)
    rows = rows.where("cdf > u OR last").withColumn("rank", F.row_number().over(w)).where("rank = 1")
    return rows.select("word", "left", "idx", "stem", "suffix")


def gibbs_sweep(segments: DataFrame, grams: str, model: str, separated: bool, sweep: int = 1, p: Params = DEFAULT) -> DataFrame:
    """(word, morphs) after one sweep: every word is split again and again at its left part until it stays whole.

    A word's own counts are out while it is drawn; the counts of the others are those before the sweep.
    """
    store = Tables(segments.sparkSession, "gibbs")
    segments = store.table(segments.select("word", "morphs"))
    tables = tuple(store.table(t) for t in count_tables(segments, separated))
    own = tuple(store.table(t) for t in own_counts(segments, separated))
    state = segments.select("word", F.col("word").alias("left"), F.array().cast("array<string>").alias("tail"), F.lit(False).alias("done"))
    for level in count():
        open_ = state.where("NOT done").select("word", "left")
        if level and open_.isEmpty():
            break
        drawn = draw(posterior(segments, tables, grams, model, separated, p, left=open_, own=own), sweep, level, p.seed)
        drawn = drawn.select("word", "stem", "suffix", (F.col("suffix") == "$").alias("whole"))
        state = store.table(state.join(drawn, "word", "left").select(
            "word",
            F.when(F.col("done"), F.col("left")).otherwise(F.coalesce("stem", "left")).alias("left"),
            F.when(F.col("done") | F.coalesce("whole", F.lit(True)), F.col("tail")).otherwise(F.concat(F.array("suffix"), F.col("tail"))).alias("tail"),
            (F.col("done") | F.coalesce("whole", F.lit(True))).alias("done"),
        ))
    return state.select("word", F.concat(F.array("left"), F.col("tail")).alias("morphs"))


def gibbs(segments: DataFrame, grams: str, model: str, separated: bool, sweeps: int = 10, p: Params = DEFAULT) -> DataFrame:
    """(word, morphs) after so many sweeps; after each of them the counts are those of its segmentations."""
    for k in range(1, sweeps + 1):
        segments = gibbs_sweep(segments, grams, model, separated, k, p)
    return segments


def changed(counts: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """Counts (morph, n) after the tokens (morph) of ``gone`` are taken out and those of ``new`` are put in."""
    signed = counts.select("morph", "n").unionByName(gone.select("morph", F.lit(-1).cast("bigint").alias("n"))).unionByName(new.select("morph", F.lit(1).cast("bigint").alias("n")))
    return signed.groupBy("morph").agg(F.sum("n").alias("n"))


def metropolis(old: DataFrame, new: DataFrame, sweep: int, seed: int) -> DataFrame:
    """(word, morphs, accepted): ``new`` (word, morphs, score) replaces ``old`` if better, or by chance 10^(new - old)."""
    u = hash_uniform(F.col("word"), F.lit(str(sweep)), F.lit("accept"), F.lit(str(seed)))
    rows = old.select("word", F.col("morphs").alias("m0"), F.col("score").alias("s0")).join(new.select("word", F.col("morphs").alias("m1"), F.col("score").alias("s1")), "word")
    take = (F.col("s1") > F.col("s0")) | (u < F.pow(F.lit(10.0), F.col("s1") - F.col("s0")))
    return rows.select("word", F.when(take, F.col("m1")).otherwise(F.col("m0")).alias("morphs"), take.alias("accepted"))


def sequential_dp(segments: DataFrame, alpha: float, gamma: float) -> DataFrame:
    """(word, pos, morph, score): log10 of each token's probability as tables fill in the order of (word, pos)."""
    rows = segments.select("word", F.posexplode("morphs").alias("pos", "morph"))
    order = ("word", "pos")
    before = F.row_number().over(W.partitionBy("morph").orderBy(*order)) - 1
    rows = numbered(rows.withColumn("n", before), order, "total")
    p = F.when(F.col("n") > 0, F.col("n") / (F.col("total") + alpha)).otherwise(alpha * F.pow(F.lit(gamma), F.length("morph") + 1) / (F.col("total") + alpha))
    return rows.select("word", "pos", "morph", F.log10(p).alias("score"))


def numbered(rows: DataFrame, order: tuple[str, ...], name: str) -> DataFrame:
    """The rows with the number of rows before each in a global order: numbers within slices, and the rows of earlier slices.

    A slice holds what begins with the same three letters; only one row for each slice is put in one order.
    """
    rows = rows.withColumn("slice", F.substring(F.col(order[0]), 1, 3))
    sizes = rows.groupBy("slice").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row for each slice
    own = F.row_number().over(W.partitionBy("slice").orderBy(*order)) - 1
    return rows.withColumn("own", own).join(before.select("slice", "before"), "slice").withColumn(name, F.col("own") + F.col("before")).drop("slice", "own", "before")


def own_tokens(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, morph, k) and (word, d): the tokens of each word's segmentation, by morph and in all."""
    tokens = segments.select("word", F.explode("morphs").alias("morph")).groupBy("word", "morph").agg(F.count("*").alias("k"))
    return tokens, segments.select("word", F.size("morphs").alias("d"))


def p2_likelihood(cands: DataFrame, segments: DataFrame, own: tuple[DataFrame, DataFrame], p: Params = DEFAULT) -> DataFrame:
    """The splits with ``lik``, log10 of the probability of their tokens one after another; ``$`` is no token.

    Counts are without the word's own tokens and grow by each token that is scored.
    """
    table = segments.select(F.explode("morphs").alias("morph")).groupBy("morph").agg(F.count("*").alias("n"))
    total = table.agg(F.sum("n").cast("double").alias("N"))
    tokens, sizes = own
    rows = cands
    for name, n, k in (("stem", "ns", "ks"), ("suffix", "nf", "kf")):
        rows = rows.join(table.select(F.col("morph").alias(name), F.col("n").alias(n)), name, "left")
        rows = rows.join(tokens.select("word", F.col("morph").alias(name), F.col("k").alias(k)), ["word", name], "left")
    rows = rows.join(sizes, "word", "left").crossJoin(F.broadcast(total)).fillna(0, ["ns", "nf", "ks", "kf", "d"])
    ns, size = F.col("ns") - F.col("ks"), F.col("N") - F.col("d")
    nf = F.col("nf") - F.col("kf") + F.when(F.col("stem") == F.col("suffix"), 1).otherwise(0)
    prob = lambda n, t, x: F.log10(F.when(n > 0, n / (t + p.alpha)).otherwise(p.alpha * F.pow(F.lit(p.gamma), F.length(x) + 1) / (t + p.alpha)))
    lik = prob(ns, size, "stem") + F.when(F.col("suffix") == "$", 0.0).otherwise(prob(nf, size + 1, "suffix"))
    return rows.withColumn("lik", lik).drop("ns", "nf", "ks", "kf", "d", "N")


def forward_weights(segments: DataFrame, scored: DataFrame, min_stem: int = 2) -> DataFrame:
    """(word, z): for each length of a left part the sum of the weights of all its recursive splits.

    ``scored`` (word, p, i, s) has the weight s of cutting the last i letters off the first p.  A left part of ``min_stem``
    letters weighs 1; the counts are the same at all levels.
    """
    ss = scored.groupBy("word").agg(F.collect_list(F.struct("p", "i", "s")).alias("ss"))  # four for each letter of a word
    inner = "aggregate(filter(ss, x -> x.p = p), 0D, (t, x) -> t + x.s * z[x.p - x.i - 1])"
    fold = f"aggregate(sequence(1, length(word)), cast(array() as array<double>), (z, p) -> concat(z, array(if(p = {min_stem}, 1D, {inner}))))"
    rows = segments.select("word").join(ss, "word", "left").withColumn("ss", F.coalesce("ss", F.array().cast("array<struct<p:int,i:int,s:double>>")))
    return rows.select("word", F.expr(fold).alias("z"))


def block_step(segments: DataFrame, bounds: DataFrame, toggled: DataFrame, nodes: DataFrame, neighbour_score: DataFrame, p: Params = DEFAULT, sweep: int = 1) -> DataFrame:
    """(trie_id, prefix, d_dp, d_poisson, d_similarity, accepted): a step that toggles each trie's boundary in ``toggled``.

    Every trie is judged against the same snapshot of counts; its old tokens are taken out first, and its new ones fill
    the tables one by one in the order of the morphs.  A boundary adds the logarithm of its node's Poisson probability
    and its ``neighbour_score`` (trie_id, prefix, score).
    """
    from .trie import segment

    words = segments.select("trie_id", "word")
    kept = bounds.join(toggled, ["trie_id", "prefix"], "left_anti").unionByName(toggled.join(bounds, ["trie_id", "prefix"], "left_anti"))
    touched = toggled.select("trie_id").distinct()
    old = segments.join(touched, "trie_id", "left_semi").select("trie_id", "word", "morphs")
    new = segment(words.join(touched, "trie_id", "left_semi"), kept)
    counts = segments.select(F.explode("morphs").alias("morph")).groupBy("morph").agg(F.count("*").alias("of_all"))
    total = counts.agg(F.sum("of_all").cast("double").alias("N"))
    tokens = lambda segs, name: segs.select("trie_id", F.explode("morphs").alias("morph")).groupBy("trie_id", "morph").agg(F.count("*").alias(name))
    own = tokens(old, "o")
    size = own.groupBy("trie_id").agg(F.sum("o").alias("D"))

    def score(segs: DataFrame, name: str) -> DataFrame:
        rows = tokens(segs, "k").join(counts, "morph", "left").join(own, ["trie_id", "morph"], "left").join(size, "trie_id").crossJoin(F.broadcast(total)).fillna(0, ["of_all", "o"])
        before = F.coalesce(F.sum("k").over(W.partitionBy("trie_id").orderBy("morph").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        base, n = (F.col("of_all") - F.col("o")).cast("double"), (F.col("N") - F.col("D") + before).cast("double")
        # a morph that isn't known pays for its form once; its other tokens, and those of known morphs, for their count
        rows = rows.withColumn("base", base).withColumn("size", n)
        fresh = p.block_alpha * F.pow(F.lit(p.gamma), F.length("morph") + 1) / (F.col("size") + p.block_alpha)
        first = F.when(F.col("base") > 0, F.col("base") / (F.col("size") + p.block_alpha)).otherwise(fresh)
        rest = F.expr(f"aggregate(if(k > 1, sequence(1L, k - 1), cast(array() as array<bigint>)), 0D, (s, j) -> s + log10((base + j) / (size + j + {p.block_alpha}D)))")
        return rows.groupBy("trie_id").agg(F.sum(F.log10(first) + rest).alias(name))

    sign = toggled.join(bounds.withColumn("had", F.lit(True)), ["trie_id", "prefix"], "left").withColumn("sign", F.when(F.col("had"), -1.0).otherwise(1.0)).drop("had")
    prior = sign.join(nodes.select("trie_id", "prefix", "n_children"), ["trie_id", "prefix"], "left").join(neighbour_score, ["trie_id", "prefix"], "left")
    prior = prior.select("trie_id", "prefix", (F.col("sign") * log10(poisson(F.coalesce("n_children", F.lit(0)), p.poisson_lambda))).alias("d_poisson"), (F.col("sign") * F.coalesce("score", F.lit(0.0))).alias("d_similarity"))
    rows = score(old, "was").join(score(new, "now"), "trie_id").join(prior, "trie_id").withColumn("d_dp", F.col("now") - F.col("was"))
    d = F.col("d_dp") + F.col("d_poisson") + F.col("d_similarity")
    u = hash_uniform(F.col("trie_id"), F.lit(str(sweep)), F.lit("block"), F.lit(str(p.seed)))
    return rows.select("trie_id", "prefix", "d_dp", "d_poisson", "d_similarity", ((d > 0) | (u < F.pow(F.lit(10.0), F.least(d, F.lit(0.0))))).alias("accepted"))


def after_block_step(bounds: DataFrame, steps: DataFrame) -> DataFrame:
    """The boundaries after the accepted steps."""
    taken = steps.where("accepted").select("trie_id", "prefix")
    return bounds.join(taken, ["trie_id", "prefix"], "left_anti").unionByName(taken.join(bounds, ["trie_id", "prefix"], "left_anti"))
