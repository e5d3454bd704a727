"""Further queries: weights, distributions, sets of sequences, genomes, motifs, bins and model selection."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.functions import scalar as S
from strandwork.operators import annotations, clustering, distributions, evaluation, genome, intervals, kmers, models, motifs, ordered, sets, stats, weights
from strandwork.plans import views as V
from strandwork.plans.queries import CURVE, DNA, KMERS, PFM, PWM, SCORED, SIDES, _pwms, _sides, query, r6

# --- sequences ----------------------------------------------------------------------------------------

BRAND_KMERS = "bk AS (SELECT id, class_id, weight, t.i - 1 AS pos, substring(seq, t.i, {k}) AS kmer FROM brands, LATERAL (SELECT unnest(generate_series(1, length(seq) - {k} + 1)) AS i) t)"


@query("SELECT kmer, CAST(sum(weight) AS DOUBLE) AS weight FROM bk GROUP BY kmer", V.BRANDS, BRAND_KMERS.format(k=4))
def p6_weighted_windows(spark, d) -> DataFrame:
    return weights.window_weights(V.brands(spark, d), "seq", 4, "weight")


@query("SELECT id, seq FROM brands WHERE id BETWEEN 20 AND 60 OR id IN (3, 77, 150)", V.BRANDS)
def p7_parts(spark, d) -> DataFrame:
    return V.brands(spark, d).where(F.col("id").between(20, 60) | F.col("id").isin(3, 77, 150)).select("id", "seq")


@query("SELECT seq_id, length(seq) - length(replace(seq, 'A', '')) AS a, length(seq) - length(replace(seq, 'C', '')) AS c, length(seq) AS n FROM seqs", V.SEQS)
def p12_permuted(spark, d) -> DataFrame:
    """Symbols of the permuted sequences: the order is random, the symbols stay."""
    mixed = V.seqs(spark, d).select("seq_id", S.permuted(F.col("seq"), 5).alias("seq"))

    def count(c):
        return (F.length("seq") - F.length(F.replace("seq", F.lit(c), F.lit("")))).cast("bigint")

    return mixed.select("seq_id", count("A").alias("a"), count("C").alias("c"), F.length("seq").cast("bigint").alias("n"))


_ANN = "ann AS (SELECT user_id, list(struct_pack(t := event_type, i := event_id) ORDER BY event_id) AS a FROM events GROUP BY user_id)"


@query("SELECT user_id, [x.i FOR x IN a IF x.t = 'click'][1] AS first_click, len([x.i FOR x IN a IF x.t = 'click']) AS clicks, len(a) + 1 AS n FROM ann", _ANN)
def p15_annotations(spark, d) -> DataFrame:
    each = F.array_sort(F.collect_list(F.struct("event_id", "event_type")))
    rows = V.table(spark, d, "events").groupBy("user_id").agg(each.alias("e"))
    mine = F.transform("e", lambda x: annotations.annotation(x["event_type"], x["event_id"]))
    ann = rows.select("user_id", annotations.annotate(mine, annotations.annotation(F.lit("end"), F.lit("x"))).alias("a"))
    return ann.select("user_id", annotations.lookup(F.col("a"), "click")["id"].cast("bigint").alias("first_click"), annotations.count_of(F.col("a"), "click").cast("bigint").alias("clicks"), annotations.count_of(F.col("a")).cast("bigint").alias("n"))


@query("SELECT CAST(user_id % 7 AS VARCHAR) AS grp, min(event_id) FILTER (event_type = 'click') AS click, min(event_id) FILTER (event_type = 'error') AS error FROM events WHERE event_type IN ('click', 'error') GROUP BY 1")
def p16_annotation_matrix(spark, d) -> DataFrame:
    e = V.table(spark, d, "events").where(F.col("event_type").isin("click", "error"))
    ann = e.select("event_id", F.array(annotations.annotation(F.lit("grp"), F.col("user_id") % 7), annotations.annotation(F.lit("kind"), F.col("event_type"))).alias("a"))
    return annotations.index_matrix(ann, "a", "grp", "kind", "event_id", ["click", "error"])


@query("SELECT weight, t.i - 1 AS pos, string_agg(substring(seq, t.i, 1), '' ORDER BY id) AS col FROM (SELECT * FROM brands WHERE class_id = 0), LATERAL (SELECT unnest(generate_series(1, length(seq))) AS i) t GROUP BY ALL", V.BRANDS)
def p21_aligned_columns(spark, d) -> DataFrame:
    cols = annotations.aligned_columns(V.brands(spark, d).where("class_id = 0"), ["weight"], "id", "seq")
    return cols.select("weight", F.col("pos").cast("bigint").alias("pos"), F.col("column").alias("col"))


@query("SELECT 'x' AS k, CAST(sum(greatest(0, length(seq) - 99)) AS BIGINT) AS n, CAST(sum(greatest(0, length(seq) - 99) * weight) AS DOUBLE) AS weight FROM seqs", V.SEQS)
def f3_elements_of_length(spark, d) -> DataFrame:
    return weights.elements_of_length(V.seqs(spark, d), "seq", 100, "weight").select(F.lit("x").alias("k"), "n", "weight")


_RANKED = "rk AS (SELECT id, score, rank() OVER (ORDER BY score DESC) - 1 AS sp, row_number() OVER (ORDER BY score DESC, id) - 1 AS io, count(*) OVER () AS n, min(score) OVER () AS lo, max(score) OVER () AS hi FROM scores)"
_AT = "th AS (SELECT max(CASE WHEN k = least(n - 1, CAST(ceil(0.9 * n) AS BIGINT)) THEN score END) AS t, max(CASE WHEN k = ceil(0.1 * (n - 1)) THEN score END) AS p1, max(CASE WHEN k = ceil(0.9 * (n - 1)) THEN score END) AS p9 FROM (SELECT score, row_number() OVER (ORDER BY score) - 1 AS k, count(*) OVER () AS n FROM scores))"
_L = math.log(0.1 / 0.9)
_SP = weights._SPREAD


@query(
    f"""SELECT id, round((score - lo) / (hi - lo), 6) AS range, round(0.1 + 0.8 * (ln(score) - ln(lo)) / (ln(hi) - ln(lo)), 6) AS log_range, round(CASE WHEN score >= t THEN 0.5 + 0.5 * (score - t) / (hi - t) ELSE 0.5 - 0.5 * (t - score) / (t - lo) END, 6) AS linear,
 CASE WHEN score >= t THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS step, round(1 / (1 + exp(-(({_L!r} - {-_L!r}) / (p1 - p9) * score + {_L!r} - ({_L!r} - {-_L!r}) / (p1 - p9) * p1))), 6) AS percentile_logistic,
 round(1 / (1 + exp(-({_SP!r} / (1 - hi / t) / t) * score + {_SP!r} / (1 - hi / t))), 6) AS sigmoid FROM rk, th""",
    V.SCORES, _RANKED, _AT,
)
def p20_value_weights(spark, d) -> DataFrame:
    x = V.scores(spark, d)
    modes = ("range", "log_range", "linear", "step", "percentile_logistic", "sigmoid")
    for m in modes:
        x = weights.interpolate(x, "score", m, 0.1, out=m)
    return x.select("id", *(r6(m).alias(m) for m in modes))


@query(
    f"""SELECT id, round(CASE WHEN sp = m THEN 0 ELSE 1 / (1 + (sp / m) / (1 - sp / m) * 0.9 / 0.1) END, 6) AS rank_log,
 round(1 / (1 + exp(b / t * io + b)), 6) AS rank_sigmoid FROM rk, (SELECT CAST(max(sp) AS DOUBLE) AS m, max(io) AS last, -floor(0.1 * count(*)) AS t, {-_SP!r} / (1 - -max(io) / -floor(0.1 * count(*))) AS b FROM rk)""",
    V.SCORES, _RANKED,
)
def p20_rank_weights(spark, d) -> DataFrame:
    x = V.scores(spark, d)
    for m in ("rank_log", "rank_sigmoid"):
        x = weights.interpolate(x, "score", m, 0.1, out=m)
    return x.select("id", r6("rank_log").alias("rank_log"), r6("rank_sigmoid").alias("rank_sigmoid"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) - 1 AS place FROM lineitem")
def w2_argsort(spark, d) -> DataFrame:
    x = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return ordered.numbered(x, [], ["l_extendedprice", "l_orderkey", "l_linenumber"], "place").select("l_orderkey", "l_linenumber", F.col("place").cast("bigint").alias("place"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k <= 5")
def t4_top_lists(spark, d) -> DataFrame:
    return ordered.top(V.table(spark, d, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 5).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("SELECT id, seq FROM brands ORDER BY weight DESC, length(seq), seq, id LIMIT 25", V.BRANDS)
def t5_sorted(spark, d) -> DataFrame:
    return ordered.sorted_by(V.brands(spark, d), "weight desc", "length(seq)", "seq asc", "id").limit(25).select("id", "seq")


@query("SELECT kmer FROM bk WHERE class_id = 0 INTERSECT SELECT kmer FROM bk WHERE class_id = 1", V.BRANDS, BRAND_KMERS.format(k=5))
def u4_shared_kmers(spark, d) -> DataFrame:
    b = V.brands(spark, d)
    return sets.shared([kmers.kmers(b.where(F.col("class_id") == c), "seq", 5).select("kmer") for c in (0, 1)])


@query("SELECT seq_id, round(h, 0) AS h FROM (SELECT id AS seq_id, CAST(x - CASE WHEN x >= 2147483648 THEN 4294967296 ELSE 0 END AS DOUBLE) AS h FROM (SELECT id, list_sum([(instr('ACGT', substring(seq, i, 1)) - 1) * CAST(pow(31, 8 - i) AS BIGINT) FOR i IN generate_series(1, 8)])::BIGINT % 4294967296 AS x FROM brands))", V.BRANDS)
def x1_code_hash(spark, d) -> DataFrame:
    return V.brands(spark, d).select(F.col("id").alias("seq_id"), S.code_hash(F.col("seq")).cast("double").alias("h"))


@query("SELECT id, substring(seq, 2, 1) || '-' || substring(seq, 3, 1) || '-' || substring(seq, 4, 1) AS txt FROM brands", V.BRANDS)
def x2_text(spark, d) -> DataFrame:
    return V.brands(spark, d).select("id", S.to_text(F.col("seq"), "-", 1, 3).alias("txt"))


_CNT = "cn AS (SELECT class_id, pos, sym, CAST(sum(weight) AS DOUBLE) AS cnt FROM cells GROUP BY ALL)"


@query("SELECT class_id, string_agg(sym, '' ORDER BY pos) AS consensus FROM (SELECT class_id, pos, sym, row_number() OVER (PARTITION BY class_id, pos ORDER BY cnt DESC, sym) AS k FROM cn) WHERE k = 1 GROUP BY class_id", V.BRANDS, PFM, _CNT)
def x3_consensus(spark, d) -> DataFrame:
    return motifs.consensus(kmers.position_counts(V.brands(spark, d), "seq", F.col("weight"), ["class_id"]), ["class_id"])


@query("SELECT class_id, 7 - pos AS pos, translate(sym, 'ACGT', 'TGCA') AS sym, cnt FROM cn", V.BRANDS, PFM, _CNT)
def x4_reverse_matrix(spark, d) -> DataFrame:
    counts = kmers.position_counts(V.brands(spark, d), "seq", F.col("weight"), ["class_id"])
    return motifs.reverse_matrix(counts, ["class_id"]).select("class_id", F.col("pos").cast("bigint").alias("pos"), "sym", "cnt")


_CODES = {c: sum(1 << "ACGT".index(b) for b in s) for c, s in S.IUPAC.items()}
_CASE = " ".join(f"WHEN '{c}' THEN {m}" for c, m in _CODES.items())


@query(f"SELECT c_custkey, (a & b) = a AS inside FROM (SELECT c_custkey, CASE x {_CASE} END AS a, CASE y {_CASE} END AS b FROM (SELECT c_custkey, substring('{''.join(_CODES)}', CAST(c_custkey % 15 + 1 AS BIGINT), 1) AS x, substring('{''.join(_CODES)}', CAST(c_custkey % 11 + 5 AS BIGINT), 1) AS y FROM customer))")
def x5_ambiguity(spark, d) -> DataFrame:
    codes = F.lit("".join(_CODES))
    c = F.col("c_custkey")
    pick = [F.substring(codes, (c % m + a).cast("int"), F.lit(1)) for m, a in ((15, 1), (11, 5))]
    return V.table(spark, d, "customer").select("c_custkey", S.iupac_within(*pick).alias("inside"))


# --- distributions ------------------------------------------------------------------------------------

_ARR = "ar AS (SELECT user_id, list(value ORDER BY event_id) AS v FROM events GROUP BY user_id)"


def _arrays(spark, d) -> DataFrame:
    e = V.table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("e"))
    return e.select("user_id", F.transform("e", lambda x: x["value"]).alias("v"))


@query("SELECT user_id, round(list_max(v) + ln(list_sum([exp(x - list_max(v)) FOR x IN v])), 6) AS log_sum, round(1 / list_sum([exp(x - list_max(v)) FOR x IN v]), 6) AS top, round(v[1] / list_sum(v), 6) AS first FROM ar", _ARR)
def m1_normalisation(spark, d) -> DataFrame:
    x = _arrays(spark, d).select("user_id", distributions.softmax(F.col("v")).alias("s"), distributions.normalised(F.col("v")).alias("n"))
    return x.select("user_id", r6("s.log_sum").alias("log_sum"), r6(F.array_max("s.p")).alias("top"), r6(F.col("n")[0]).alias("first"))


@query("SELECT user_id, list_max(v) AS most, list_min(v) AS least, round(list_sum(v), 6) AS total, list_position(v, list_max(v)) - 1 AS argmax, list_position(v, list_min(v)) - 1 AS argmin FROM ar", _ARR)
def m3_array_summary(spark, d) -> DataFrame:
    x = _arrays(spark, d).select("user_id", distributions.array_summary(F.col("v")).alias("s"))
    return x.select("user_id", "s.most", "s.least", r6("s.total").alias("total"), F.col("s.argmax").cast("bigint").alias("argmax"), F.col("s.argmin").cast("bigint").alias("argmin"))


_JOINT = "jt AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) / (SELECT count(*) FROM lineitem) AS p FROM lineitem GROUP BY ALL), jm AS (SELECT a, b, p, sum(p) OVER (PARTITION BY a) * sum(p) OVER (PARTITION BY b) AS q FROM jt)"


@query("SELECT round(2 * sum(p * ln(p / q)), 6) AS d1, round((sum(p * (p / q)) - 1) / 1.0, 6) AS d2 FROM jm", _JOINT)
def m4_divergence(spark, d) -> DataFrame:
    li = V.table(spark, d, "lineitem")
    n = li.count()
    cells = li.groupBy(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b")).agg((F.count("*") / n).alias("p"))
    d1 = distributions.divergence_from_independence(cells, "a", "b", "p", 1.0).withColumnRenamed("divergence", "d1")
    d2 = distributions.divergence_from_independence(cells, "a", "b", "p", 2.0).withColumnRenamed("divergence", "d2")
    return d1.crossJoin(d2).select(r6("d1").alias("d1"), r6("d2").alias("d2"))


@query("SELECT round(sum(p.prob * ln(p.prob / q.prob)), 6) AS kl, round(sum((p.prob - q.prob) * ln(p.prob / q.prob)), 6) AS symmetric_kl, round(-sum(p.prob * ln(p.prob)), 6) AS entropy FROM pwm p JOIN pwm q USING (pos, sym) WHERE p.class_id = 0 AND q.class_id = 1", V.BRANDS, PFM, PWM)
def m5_model_divergence(spark, d) -> DataFrame:
    """Over all words of the motif's length; independent places add up, which is what the SQL does."""
    _, (a, b) = _pwms(spark, d)
    return distributions.compare_models(spark, DNA, len(a.logs), a.score, b.score).select(*(r6(c).alias(c) for c in ("kl", "symmetric_kl", "entropy")))


@query("SELECT round(sum(b.weight * s), 4) AS log_likelihood, round(2 * sum(b.weight * s) - 48, 4) AS aic, round(2 * sum(b.weight * s) - 24 * ln(count(*)), 4) AS bic FROM ll JOIN brands b USING (id) WHERE m = 0", V.BRANDS, PFM, PWM + SCORED)
def m6_criteria(spark, d) -> DataFrame:
    x, (a, _) = _pwms(spark, d)
    return distributions.criteria(x, a.score(F.col("seq")), 24, F.col("weight")).select(*(F.round(c, 4).alias(c) for c in ("log_likelihood", "aic", "bic")))


@query("SELECT a.sym || b.sym AS part, round(a.prob * b.prob, 6) AS prob FROM pwm a JOIN pwm b ON a.class_id = 0 AND b.class_id = 0 AND a.pos = 2 AND b.pos = 3", V.BRANDS, PFM, PWM)
def m7_marginal(spark, d) -> DataFrame:
    _, (a, _) = _pwms(spark, d)
    return distributions.marginal(spark, DNA, len(a.logs), a.score, 2, 2).select("part", r6("prob").alias("prob"))


@query("SELECT class_id, pos, round((2 + sum(prob * log2(prob))) / 2, 6) AS information FROM pwm GROUP BY class_id, pos", V.BRANDS, PFM, PWM)
def m8_information(spark, d) -> DataFrame:
    p = kmers.probabilities(kmers.position_counts(V.brands(spark, d), "seq", F.col("weight"), ["class_id"]), DNA, ["class_id", "pos"], 4.0)
    return p.groupBy("class_id", F.col("pos").cast("bigint").alias("pos")).agg(r6(distributions.information(F.collect_list("prob"))).alias("information"))


@query("SELECT class_id, pos, sym, round(p * (2 + sum(p * log2(p)) OVER (PARTITION BY class_id, pos)), 6) AS height FROM (SELECT *, cnt / sum(cnt) OVER (PARTITION BY class_id, pos) AS p FROM cn)", V.BRANDS, PFM, _CNT)
def k9_logo_heights(spark, d) -> DataFrame:
    h = motifs.logo_heights(kmers.position_counts(V.brands(spark, d), "seq", F.col("weight"), ["class_id"]), ["class_id"])
    return h.select("class_id", F.col("pos").cast("bigint").alias("pos"), "sym", r6("height").alias("height"))


# --- evaluation ---------------------------------------------------------------------------------------


@query("SELECT score, round(fp / neg, 6) AS fpr, round(tp / pos, 6) AS tpr, round(tp / (tp + fp), 6) AS precision FROM cur, tot", V.SCORES, CURVE)
def e1_curve(spark, d) -> DataFrame:
    return evaluation.rates(V.scores(spark, d)).select("score", *(r6(c).alias(c) for c in ("fpr", "tpr", "precision")))


@query("SELECT class_id, round(corr(score, weight), 6) AS r FROM scores GROUP BY class_id", V.SCORES)
def e10_score_weight_correlation(spark, d) -> DataFrame:
    return stats.weighted_pearson(V.scores(spark, d), "score", "weight", None, ["class_id"]).select("class_id", r6("r").alias("r"))


@query("SELECT id, CASE WHEN s0 - ln(1 + exp(0.5)) >= s1 + 0.5 - ln(1 + exp(0.5)) THEN 0 ELSE 1 END AS predicted FROM (SELECT id, max(CASE WHEN m = 0 THEN s END) AS s0, max(CASE WHEN m = 1 THEN s END) AS s1 FROM ll GROUP BY id)", V.BRANDS, PFM, PWM + SCORED)
def c4_shifted_classes(spark, d) -> DataFrame:
    x, pair = _pwms(spark, d)
    a, b = (m.score(F.col("seq")) + w for m, w in zip(pair, weights.threshold_weights(0.5)))
    return x.select("id", a.alias("a"), b.alias("b")).select("id", evaluation.argmax_class(["a", "b"]).cast("int").alias("predicted"))


@query("SELECT id, CASE WHEN o = 'x' THEN 0 ELSE 1 END AS class_id FROM (SELECT o_orderkey AS id, CASE WHEN o_orderstatus IN ('F', 'P') THEN 'x' ELSE 'y' END AS o FROM orders)")
def c6_merged_classes(spark, d) -> DataFrame:
    x = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    return evaluation.merged_classes(x, "o_orderstatus", {"F": 0, "P": 0, "O": 1}).select("id", "class_id")


@query("SELECT id, count(*) OVER (PARTITION BY class_id ORDER BY md5(CAST(id AS VARCHAR)) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 0.4 * count(*) OVER (PARTITION BY class_id) AS first_part FROM brands", V.BRANDS)
def v6_split_by_elements(spark, d) -> DataFrame:
    """In the order of the ids' digests, as random as any and the same everywhere."""
    x = V.brands(spark, d).withColumn("one", F.lit(1.0)).withColumn("h", F.md5(F.col("id").cast("string").cast("binary")))
    return sets.split_by_quota(x, ["class_id"], ["h"], "one", 0.4).select("id", "first_part")


@query("SELECT class_id, fold, count(*) AS n FROM (SELECT class_id, CAST(('0x' || substring(md5('0:' || CAST(id AS VARCHAR)), 1, 8)) AS BIGINT) % 5 AS fold FROM brands) GROUP BY ALL", V.BRANDS)
def v1_folds(spark, d) -> DataFrame:
    return sets.folds(V.brands(spark, d), "id", 5).groupBy("class_id", F.col("fold").cast("bigint").alias("fold")).agg(F.count("*").alias("n"))


# --- genomes, intervals -------------------------------------------------------------------------------


@query("SELECT s.id, b.seq_id, substring(b.seq, CAST(s.pos % 700 - 12 + 1 AS BIGINT), 25) AS win FROM (SELECT id, pos FROM signal) s JOIN seqs b ON b.seq_id = s.id % 200 WHERE s.pos % 700 - 12 >= 0 AND s.pos % 700 - 12 + 25 <= length(b.seq)", V.SEQS, V.SIGNAL)
def j11_peak_windows(spark, d) -> DataFrame:
    g = V.seqs(spark, d).select(F.col("seq_id").alias("chrom"), "seq")
    peaks = V.signal(spark, d).select("id", (F.col("id") % 200).alias("chrom"), (F.col("pos") % 700).alias("top"))
    return genome.around(g, peaks, 25, size=256).select("id", F.col("chrom").alias("seq_id"), F.col("window").alias("win"))


@query("SELECT id, count(*) OVER (PARTITION BY chrom ORDER BY \"start\" + \"end\", \"start\", \"end\", id ROWS UNBOUNDED PRECEDING) - 1 AS number FROM (SELECT chrom, \"start\", \"end\", min(id) AS id FROM intervals GROUP BY ALL)", V.INTERVALS)
def j12_order_numbers(spark, d) -> DataFrame:
    x = V.intervals(spark, d).groupBy("chrom", "start", "end").agg(F.min("id").alias("id"))
    return genome.order_numbers(x, "chrom", "start", "end").select("id", F.col("number").cast("bigint").alias("number"))


@query("SELECT l_id, r_id, CASE WHEN r_id % 2 = 1 THEN re - least(le, re) ELSE greatest(ls, rs) - rs END AS \"from\", CASE WHEN r_id % 2 = 1 THEN re - greatest(ls, rs) ELSE least(le, re) - rs END AS \"to\" FROM both_", V.INTERVALS, SIDES)
def j13_lifted(spark, d) -> DataFrame:
    left, right = _sides(spark, d)
    return genome.lifted(left, right.withColumn("r_strand", F.when(F.col("r_id") % 2 == 1, "-").otherwise("+")), ["chrom"], 64)


@query("SELECT user_id AS target FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'view'")
def j14_in_all_sets(spark, d) -> DataFrame:
    e = V.table(spark, d, "events")
    return genome.in_all(*(e.where(F.col("event_type") == t).select(F.col("user_id").alias("target")) for t in ("click", "error", "view")))


_BINS = "bs AS (SELECT chrom, CAST(floor(pos / 3600) AS BIGINT) AS bin, value, pos FROM signal)"


@query("SELECT a.chrom, a.bin, a.n, b.top FROM (SELECT chrom, bin, count(*) AS n FROM bs GROUP BY ALL) a JOIN (SELECT chrom, bin, max(value) AS top FROM bs WHERE value > 50 GROUP BY ALL) b USING (chrom, bin)", V.SIGNAL, _BINS)
def j8_merged_bins(spark, d) -> DataFrame:
    b = V.signal(spark, d).withColumn("bin", F.floor(F.col("pos") / 3600))
    return genome.merged_bins(b.groupBy("chrom", "bin").agg(F.count("*").alias("n")), b.where("value > 50").groupBy("chrom", "bin").agg(F.max("value").alias("top")))


@query("SELECT chrom, bin, top AS most, round(top + ln(s), 6) AS log_sum FROM (SELECT chrom, bin, top, sum(exp(value - top)) AS s FROM (SELECT *, max(value) OVER (PARTITION BY chrom, bin) AS top FROM bs) GROUP BY ALL)", V.SIGNAL, _BINS)
def a23_bin_scores(spark, d) -> DataFrame:
    x = V.signal(spark, d)
    bins = x.select("chrom", F.floor(F.col("pos") / 3600).alias("bin")).distinct()
    return intervals.bin_scores(x, bins, ["chrom"], "pos", "value", 3600).select("chrom", "bin", "most", r6("log_sum").alias("log_sum"))


@query(
    """SELECT b.chrom, b.bin, round(any_value(b.least), 6) AS least, round(any_value(b.mean), 6) AS mean, round(any_value(b.most), 6) AS most, round(any_value(b.mean0), 6) AS mean0, round(coalesce(avg(v) FILTER (s.pos >= b.bin * 3600), 0), 6) AS mean_after, coalesce(max(v) FILTER (s.pos >= b.bin * 3600), 0) AS most_after,
 round(coalesce(avg(v) FILTER (s.pos <= b.bin * 3600), 0), 6) AS mean_before, coalesce(max(v) FILTER (s.pos <= b.bin * 3600), 0) AS most_before
 FROM (SELECT chrom, bin, coalesce(min(v), 0) AS least, coalesce(avg(v), 0) AS mean, coalesce(max(v), 0) AS most, avg(coalesce(v, 0)) AS mean0 FROM (SELECT chrom, bin, CASE WHEN id % 4 > 0 THEN value END AS v FROM signal JOIN (SELECT DISTINCT chrom, CAST(floor(pos / 3600) AS BIGINT) AS bin FROM signal) x USING (chrom) WHERE floor(pos / 3600) = bin) GROUP BY ALL) b
 LEFT JOIN (SELECT chrom, pos, CASE WHEN id % 4 > 0 THEN value END AS v FROM signal) s ON s.chrom = b.chrom AND s.pos BETWEEN b.bin * 3600 - 1000 AND b.bin * 3600 + 1000 GROUP BY b.chrom, b.bin""",
    V.SIGNAL,
)
def a22_missing_values(spark, d) -> DataFrame:
    x = V.signal(spark, d).withColumn("value", F.when(F.col("id") % 4 > 0, F.col("value")))
    out = intervals.window_features(x, ["chrom"], "pos", "value", 3600, 1000)
    return out.select("chrom", "bin", *(r6(c).alias(c) for c in ("least", "mean", "most", "mean0", "mean_after")), "most_after", r6("mean_before").alias("mean_before"), "most_before")


@query("SELECT chrom, bin, round(1 - exp(sum(ln(1 - p)) OVER w), 6) AS \"any\", round(avg(p) OVER w, 6) AS mean FROM (SELECT chrom, bin, count(*) / 100.0 AS p FROM bs GROUP BY ALL) WINDOW w AS (PARTITION BY chrom ORDER BY bin RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)", V.SIGNAL, _BINS)
def a24_neighbouring_bins(spark, d) -> DataFrame:
    p = V.signal(spark, d).groupBy("chrom", F.floor(F.col("pos") / 3600).alias("bin")).agg((F.count("*") / 100.0).alias("p"))
    return intervals.combine_neighbours(p, ["chrom"], "bin", "p", 2).select("chrom", "bin", r6("any").alias("any"), r6("mean").alias("mean"))


@query("SELECT id, chrom FROM (SELECT i.id, i.chrom, i.cov, i.\"end\" - i.\"start\" AS n, (SELECT coalesce(sum((least(r.\"end\", i.\"start\") - greatest(r.\"start\", i.\"start\" - 10)) * r.cov), 0) / 10.0 FROM run r WHERE r.chrom = i.chrom AND r.\"start\" < i.\"start\" AND r.\"end\" > i.\"start\" - 10 AND r.cov <> 0) AS l, (SELECT coalesce(sum((least(r.\"end\", i.\"end\" + 10) - greatest(r.\"start\", i.\"end\")) * r.cov), 0) / 10.0 FROM run r WHERE r.chrom = i.chrom AND r.\"start\" < i.\"end\" + 10 AND r.\"end\" > i.\"end\" AND r.cov <> 0) AS r FROM intervals i WHERE i.flag = 'A') WHERE n < 40 AND CASE WHEN greatest(l, r) = 0 THEN cov > 0 ELSE cov / greatest(l, r) >= CAST(0.1 AS DOUBLE) END", V.INTERVALS, 'ev AS (SELECT chrom, "start" AS p, cov AS d FROM intervals UNION ALL SELECT chrom, "end", -cov FROM intervals), del AS (SELECT chrom, p, sum(d) AS d FROM ev GROUP BY 1, 2 HAVING sum(d) <> 0), run AS (SELECT chrom, p AS "start", lead(p) OVER w AS "end", CAST(sum(d) OVER w AS BIGINT) AS cov FROM del WINDOW w AS (PARTITION BY chrom ORDER BY p))')
def f10_denoised_introns(spark, d) -> DataFrame:
    x = V.intervals(spark, d)
    runs = intervals.coverage(x, ["chrom"], "start", "end", "cov")
    introns = x.where("flag = 'A'").select("id", "chrom", "start", "end", F.col("cov").alias("reads"))
    return genome.denoised(introns, runs, 10, 0.1, 40, 64).select("id", "chrom")


_TR = 'tr AS (SELECT DISTINCT l_orderkey AS t, l_linenumber * 100 + 1 AS s, l_linenumber * 100 + CAST(l_quantity AS BIGINT) AS e FROM lineitem WHERE l_quantity >= 2)'


@query(
    """SELECT p.t AS transcript, p.parts, round(g.tie, 6) AS tie, round(coalesce(u.covered, 0) / p.n, 6) AS tpc, round(coalesce(u.mass, 0) / p.n, 6) AS avg_cov, CAST(CASE WHEN coalesce(u.covered, 0) < p.n THEN 0 ELSE u.low END AS BIGINT) AS min_cov FROM (SELECT t, count(*) AS parts, sum(e - s) AS n FROM tr GROUP BY t) p
 LEFT JOIN (SELECT t, avg(CASE WHEN (a, b) IN (SELECT (e, s) FROM it) THEN 1.0 ELSE 0.0 END) AS tie FROM (SELECT t, lag(e) OVER (PARTITION BY t ORDER BY s, e) AS a, s AS b FROM tr) WHERE a IS NOT NULL GROUP BY t) g USING (t)
 LEFT JOIN (SELECT t, sum(least(e, z) - greatest(s, a)) AS covered, sum((least(e, z) - greatest(s, a)) * cov) AS mass, min(cov) AS low FROM tr JOIN cv ON s < z AND a < e GROUP BY t) u USING (t)""",
    _TR, "cv AS (SELECT x * 20 AS a, x * 20 + 13 + x % 7 AS z, x % 5 + 1 AS cov FROM range(0, 60) t(x))", "it AS (SELECT DISTINCT x.e, y.s FROM tr x JOIN tr y ON x.t = y.t AND x.s + 100 = y.s WHERE x.t % 3 = 0)",
)
def a29_transcript_evidence(spark, d) -> DataFrame:
    li = V.table(spark, d, "lineitem").where("l_quantity >= 2")
    first = F.col("l_linenumber").cast("bigint") * 100
    tr = li.select(F.col("l_orderkey").alias("transcript"), F.lit("c").alias("chrom"), F.lit("+").alias("strand"), (first + 1).alias("start"), (first + F.col("l_quantity").cast("bigint")).alias("end")).distinct()
    x = tr.where("transcript % 3 = 0")
    introns = x.alias("x").join(x.alias("y"), (F.col("x.transcript") == F.col("y.transcript")) & (F.col("x.start") + 100 == F.col("y.start"))).select("x.chrom", "x.strand", F.col("x.end").alias("start"), F.col("y.start").alias("end")).distinct().withColumn("reads", F.lit(3))
    runs = spark.range(60).select(F.lit("c").alias("chrom"), (F.col("id") * 20).alias("start"), (F.col("id") * 20 + 13 + F.col("id") % 7).alias("end"), (F.col("id") % 5 + 1).alias("cov"))
    out = genome.evidence(tr, introns, runs, 64)
    return out.select("transcript", "parts", r6("tie").alias("tie"), r6("tpc").alias("tpc"), r6("avg_cov").alias("avg_cov"), F.col("min_cov").cast("bigint").alias("min_cov"))


@query("SELECT item, CASE WHEN n > 1 THEN 'D' WHEN n = 1 THEN 'S' WHEN f THEN 'F' ELSE 'M' END AS status FROM (SELECT l_partkey AS item, count(DISTINCT l_suppkey) FILTER (l_returnflag = 'A') AS n, bool_or(l_returnflag = 'R') AS f FROM lineitem GROUP BY 1)")
def a27_completeness(spark, d) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "Complete").when(F.col("l_returnflag") == "R", "Fragmented").otherwise("Missing")
    return genome.gene_completeness(V.table(spark, d, "lineitem").select(F.col("l_partkey").alias("item"), kind.alias("status"), F.col("l_suppkey").alias("gene")))


_PK = "sure AS (SELECT l_suppkey AS chrom, l_partkey * 17 AS s, l_partkey * 17 + CAST(l_quantity AS BIGINT) AS e, l_partkey * 17 + CAST(l_quantity AS BIGINT) // 2 AS m FROM lineitem WHERE l_returnflag = 'A'), rel AS (SELECT l_suppkey AS chrom, l_partkey * 17 AS s, l_partkey * 17 + CAST(l_quantity AS BIGINT) + 60 AS e FROM lineitem WHERE l_returnflag = 'R'), bn AS (SELECT DISTINCT l_suppkey AS chrom, l_partkey * 17 // 50 * 50 AS b FROM lineitem)"


@query(
    """SELECT chrom, b AS "start", CASE WHEN EXISTS (SELECT 1 FROM sure p WHERE p.chrom = bn.chrom AND p.s < b + 200 AND p.e > b AND m BETWEEN b AND b + 50) THEN 'S' WHEN EXISTS (SELECT 1 FROM sure p WHERE p.chrom = bn.chrom AND least(b + 200, p.e) - greatest(b, p.s) >= 25) THEN 'B'
 WHEN EXISTS (SELECT 1 FROM rel p WHERE p.chrom = bn.chrom AND least(b + 200, p.e) - greatest(b, p.s) >= 1) THEN 'A' ELSE 'U' END AS label FROM bn""",
    _PK,
)
def n9_bin_labels(spark, d) -> DataFrame:
    li = V.table(spark, d, "lineitem")
    q = F.col("l_quantity").cast("bigint")
    at = F.col("l_partkey") * 17
    peaks = li.select(F.col("l_suppkey").alias("chrom"), at.alias("start"), (at + q).alias("end"), (at + F.floor(q / 2)).alias("summit"), "l_returnflag")
    bins = li.select(F.col("l_suppkey").alias("chrom"), (F.floor(at / 50) * 50).alias("start")).distinct()
    relaxed = peaks.where("l_returnflag = 'R'").withColumn("end", F.col("end") + 60)
    return genome.bin_labels(bins, relaxed, peaks.where("l_returnflag = 'A'"), 50, 200)


@query("SELECT a.id, a.pos AS first, b.pos AS second FROM bk a JOIN bk b ON a.id = b.id AND a.kmer = reverse(translate(b.kmer, 'ACGT', 'TGCA')) AND b.pos - a.pos BETWEEN 3 AND 5", V.BRANDS, BRAND_KMERS.format(k=2))
def w13_inverted_repeats(spark, d) -> DataFrame:
    x = genome.inverted_repeats(V.brands(spark, d), "id", "seq", 2, 3, 5)
    return x.select("id", F.col("first").cast("bigint").alias("first"), F.col("second").cast("bigint").alias("second"))


# --- motifs -------------------------------------------------------------------------------------------


@query("SELECT DISTINCT b.id, q.kmer FROM bk b JOIN (SELECT DISTINCT kmer FROM bk WHERE id <= 20) q ON hamming(b.kmer, q.kmer) <= 1", V.BRANDS, BRAND_KMERS.format(k=6))
def j10_words_in_sequences(spark, d) -> DataFrame:
    b = V.brands(spark, d)
    words = kmers.kmers(b.where("id <= 20"), "seq", 6).select("kmer").distinct()
    return motifs.containing(b, "id", "seq", words, 6, 1)


@query("SELECT a.seq AS a, b.seq AS b FROM (SELECT DISTINCT seq FROM brands WHERE id <= 300) a, (SELECT DISTINCT seq FROM brands WHERE id <= 300) b WHERE a.seq < b.seq AND hamming(a.seq, b.seq) <= 2", V.BRANDS)
def j9_two_mismatches(spark, d) -> DataFrame:
    return kmers.neighbourhood(V.brands(spark, d).where("id <= 300").select("seq").distinct(), "seq", DNA, 2)


_SUM = " + ".join(f"ln(p{i}.prob)" for i in range(8))
_JOIN = " ".join(f"JOIN pwm p{i} ON p{i}.class_id = 0 AND p{i}.pos = {i} AND p{i}.sym = substring(w, {i + 1}, 1)" for i in range(8))
_STRANDS = "st AS (SELECT id, class_id, '+' AS strand, seq AS w FROM brands UNION ALL SELECT id, class_id, '-', reverse(translate(seq, 'ACGT', 'TGCA')) FROM brands)"
_HITS = f", hs AS (SELECT st.id, st.class_id, st.strand, w, round({_SUM}, 9) AS s FROM st {_JOIN}), bg AS (SELECT s FROM hs WHERE class_id = 1), lim AS (SELECT min(s) AS t FROM (SELECT s, min(k) AS first, any_value(n) AS n FROM (SELECT s, row_number() OVER (ORDER BY s) - 1 AS k, count(*) OVER () AS n FROM bg) GROUP BY s) WHERE first >= ceil(n * 0.95))"


def _rounded(model):
    """The matrix with a score that is the same in both engines."""

    class Rounded(models.PWM):
        def score(self, seq):
            return F.round(super().score(seq), 9)

    return Rounded(model.alphabet, model.logs)


@query("SELECT id, strand, round(s, 6) AS score, round((SELECT count(*) FROM bg WHERE bg.s >= hs.s) / (SELECT count(*) FROM bg), 6) AS p FROM hs, lim WHERE class_id = 0 AND s >= t", V.BRANDS, PFM, PWM, _STRANDS + _HITS)
def z1_occurrences(spark, d) -> DataFrame:
    x, (a, _) = _pwms(spark, d)
    found = motifs.occurrences(x.where("class_id = 0"), x.where("class_id = 1"), "id", "seq", _rounded(a), 0.05)
    return found.select("id", "strand", r6("score").alias("score"), r6("p").alias("p"))


@query("SELECT t.i - 1 AS pos, substring(w, t.i, 1) AS sym, CAST(count(*) AS DOUBLE) AS cnt FROM hs, lim, LATERAL (SELECT unnest(generate_series(1, 8)) AS i) t WHERE class_id = 0 AND s >= t GROUP BY ALL".replace("s >= t ", "s >= lim.t "), V.BRANDS, PFM, PWM, _STRANDS + _HITS)
def z2_sites_matrix(spark, d) -> DataFrame:
    x, (a, _) = _pwms(spark, d)
    found = motifs.occurrences(x.where("class_id = 0"), x.where("class_id = 1"), "id", "seq", _rounded(a), 0.05)
    return motifs.sites_matrix(found).select(F.col("pos").cast("bigint").alias("pos"), "sym", "cnt")


@query("SELECT id, strand, round(s, 6) AS score FROM hs WHERE s >= -10.5", V.BRANDS, PFM, PWM, _STRANDS + _HITS)
def f9_prefiltered_scan(spark, d) -> DataFrame:
    x, (a, _) = _pwms(spark, d)
    return motifs.scan(x, "id", "seq", _rounded(a), -10.5, True, 4, 2).select("id", "strand", r6("score").alias("score"))


_POS = "t AS (SELECT DISTINCT user_id AS id, event_id % 400 AS a FROM events WHERE event_type = 'click'), q AS (SELECT DISTINCT user_id AS id, event_id % 400 + 2 AS b FROM events WHERE event_type <> 'click'), nr AS (SELECT t.id, a, b FROM t JOIN q ON t.id = q.id AND abs(a - b) <= 3), tp AS (SELECT DISTINCT id, a + i AS x FROM t, range(0, 6) r(i)), qp AS (SELECT DISTINCT id, b + i AS x FROM q, range(0, 6) r(i))"


@query(
    """SELECT round(hit / n, 6) AS sn, round(rt / m, 6) AS ppv, round(hit / (n + m - rt), 6) AS pc, round(x / nt, 6) AS n_sn, round(x / nq, 6) AS n_ppv, round(x / (nt + nq - x), 6) AS n_pc FROM (SELECT (SELECT count(*) FROM (SELECT DISTINCT id, a FROM nr)) AS hit, (SELECT count(*) FROM (SELECT DISTINCT id, b FROM nr)) AS rt, (SELECT count(*) FROM t) AS n, (SELECT count(*) FROM q) AS m,
 (SELECT count(*) FROM tp JOIN qp USING (id, x)) AS x, (SELECT count(*) FROM tp) AS nt, (SELECT count(*) FROM qp) AS nq)""",
    _POS,
)
def z3_assessment(spark, d) -> DataFrame:
    e = V.table(spark, d, "events")
    truth = e.where("event_type = 'click'").select(F.col("user_id").alias("id"), (F.col("event_id") % 400).alias("pos"))
    predicted = e.where("event_type <> 'click'").select(F.col("user_id").alias("id"), (F.col("event_id") % 400 + 2).alias("pos"))
    return motifs.assess(truth, predicted, 6, 3).select(*(r6(c).alias(c) for c in ("sn", "ppv", "pc", "n_sn", "n_ppv", "n_pc")))


_MOT = "mc AS (SELECT p_type AS motif, t.i - 1 AS pos, substring(seq, t.i, 1) AS sym, CAST(count(*) AS DOUBLE) AS cnt FROM brands JOIN part ON p_partkey = id, LATERAL (SELECT unnest(generate_series(1, 8)) AS i) t GROUP BY ALL), gd AS (SELECT motif, pos, sym, coalesce(cnt, 0) AS cnt FROM (SELECT motif, pos, sym FROM (SELECT DISTINCT motif, pos FROM mc), (SELECT unnest(['A','C','G','T']) AS sym)) LEFT JOIN mc USING (motif, pos, sym)), pr AS (SELECT motif, pos, sym, cnt / sum(cnt) OVER (PARTITION BY motif, pos) AS p, (cnt + 0.25) / (sum(cnt) OVER (PARTITION BY motif, pos) + 1) AS s FROM gd)"
_COL = "co AS (SELECT x.motif AS a, y.motif AS b, x.pos - y.pos AS o, x.pos, sqrt(sum((x.p - y.p) * (x.p - y.p))) / sqrt(2) AS e, sum((x.s - y.s) * ln(x.s / y.s)) / 2 AS k, CASE WHEN sum((x.p - 0.25) ** 2) > 0 AND sum((y.p - 0.25) ** 2) > 0 THEN sum((x.p - 0.25) * (y.p - 0.25)) / sqrt(sum((x.p - 0.25) ** 2) * sum((y.p - 0.25) ** 2)) ELSE 0 END AS r FROM pr x JOIN pr y ON x.sym = y.sym AND x.motif < y.motif GROUP BY ALL), av AS (SELECT a, b, o, avg(e) AS e, avg(k) AS k, 1 - avg(r) AS r FROM co GROUP BY a, b, o HAVING count(*) >= 6)"


@query("SELECT a, b, round(min(e), 6) AS euclidean, round(min(k), 6) AS kl, round(min(r), 6) AS pearson FROM av GROUP BY a, b", V.BRANDS, _MOT, _COL)
def g7_pfm_distances(spark, d) -> DataFrame:
    """Distances of the position matrices of all part types."""
    x = V.brands(spark, d).join(V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("motif")), "id")
    counts = kmers.position_counts(x, "seq", None, ["motif"])
    out = None
    for kind in ("euclidean", "kl", "pearson"):
        one = motifs.matrix_distances(counts, kind=kind, least=6).select("a", "b", r6("d").alias(kind))
        out = one if out is None else out.join(one, ["a", "b"])
    return out


@query("SELECT id, CAST(levenshtein(seq, 'ACGTTGCA') AS DOUBLE) AS cost FROM brands", V.BRANDS)
def g9_alignment(spark, d) -> DataFrame:
    """Global alignments at unit costs, which are edit distances."""
    x = V.brands(spark, d).withColumn("other", F.lit("ACGTTGCA"))
    return clustering.align_columns(x, "seq", "other").select("id", "cost")


# --- models -------------------------------------------------------------------------------------------


@query(
    """SELECT id, round(sum(lp), 5) AS score FROM (SELECT b.id, t.i, ln((coalesce(c.n, 0) + 0.25) / (x.n + 1)) AS lp FROM brands b, LATERAL (SELECT unnest(generate_series(1, 8)) AS i) t
 JOIN (SELECT t.i, CASE WHEN t.i > 1 THEN substring(seq, t.i - 1, 1) ELSE '' END AS ctx, sum(weight) AS n FROM brands, LATERAL (SELECT unnest(generate_series(1, 8)) AS i) t GROUP BY ALL) x ON x.i = t.i AND x.ctx = CASE WHEN t.i > 1 THEN substring(b.seq, t.i - 1, 1) ELSE '' END
 LEFT JOIN (SELECT t.i, CASE WHEN t.i > 1 THEN substring(seq, t.i - 1, 1) ELSE '' END AS ctx, substring(seq, t.i, 1) AS sym, sum(weight) AS n FROM brands, LATERAL (SELECT unnest(generate_series(1, 8)) AS i) t GROUP BY ALL) c ON c.i = t.i AND c.ctx = x.ctx AND c.sym = substring(b.seq, t.i, 1)) GROUP BY id""",
    V.BRANDS,
)
def l3_inhomogeneous_markov(spark, d) -> DataFrame:
    x = V.brands(spark, d)
    model = models.Dependent.markov(x, "seq", DNA, 8, 1, 1.0, F.col("weight"))
    return x.select("id", F.round(model.score(F.col("seq")), 5).alias("score"))


@query("SELECT id, round(sum(CASE WHEN t.i <= 4 THEN ln(a.prob) ELSE ln(b.prob) END), 6) AS score FROM brands, LATERAL (SELECT unnest(generate_series(1, 8)) AS i) t JOIN pwm a ON a.class_id = 0 AND a.pos = (t.i - 1) % 4 AND a.sym = substring(seq, t.i, 1) JOIN pwm b ON b.class_id = 1 AND b.pos = (t.i - 1) % 4 AND b.sym = substring(seq, t.i, 1) GROUP BY id", V.BRANDS, PFM, PWM)
def l9_product(spark, d) -> DataFrame:
    x, (a, b) = _pwms(spark, d)
    parts = [models.PWM(m.alphabet, m.logs[:4]) for m in (a, b)]
    return x.select("id", r6(models.product_score(F.col("seq"), [(parts[0], 0, 4), (parts[1], 4, 4)])).alias("score"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(sum(-ln(sd) - 0.5 * ln(2 * pi()) - (value - m) ** 2 / (2 * sd * sd)), 3) AS log_likelihood FROM (SELECT event_type, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM events WINDOW w AS (PARTITION BY event_type)) GROUP BY event_type")
def l21_fitted_gaussians(spark, d) -> DataFrame:
    e = V.table(spark, d, "events")
    fitted = models.fit_gaussians(e, ["event_type"], "value")
    return fitted.select("event_type", r6("mean").alias("mean"), r6("sd").alias("sd"), F.round("log_likelihood", 3).alias("log_likelihood"))


@query()
def c7_gen_dis_mix(spark, d) -> DataFrame:
    """Supervised posterior with a product-Dirichlet prior; tests hold the other principles against closed forms."""
    x = V.brands(spark, d)
    model = models.GenDisMix.fit(x, "seq", DNA, 8, steps=12)
    return x.select("id", F.round(model.score(F.col("seq")), 3).alias("score"))


_PRED = """pd AS (SELECT chrom, strand, "start", "end", min(id) AS id, max(cov) AS score, count(*) AS evidence FROM intervals GROUP BY ALL HAVING max(cov) >= 3),
 pf AS (SELECT *, CASE WHEN max("end") OVER (PARTITION BY chrom, strand ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > "start" THEN 0 ELSE 1 END AS f FROM pd), pc AS (SELECT *, sum(f) OVER (PARTITION BY chrom, strand ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS k FROM pf)"""


@query('SELECT id, chrom, strand, "start", "end", score, evidence, members FROM (SELECT *, count(*) OVER (PARTITION BY chrom, strand, k) AS members, row_number() OVER (PARTITION BY chrom, strand, k ORDER BY score DESC, id, "start" DESC) AS place FROM pc) WHERE place = 1', V.INTERVALS, _PRED)
def n1_filtered_predictions(spark, d) -> DataFrame:
    return genome.filter_predictions(V.intervals(spark, d), "score >= 3", F.col("cov"))


@query("SELECT event_id, user_id FROM events WHERE value > 40 AND event_type LIKE 'c%' OR user_id % 10 = 3")
def f4_expression(spark, d) -> DataFrame:
    return sets.filtered(V.table(spark, d, "events"), "value > 40 AND event_type LIKE 'c%' OR user_id % 10 = 3").select("event_id", "user_id")


_TWO = "sc AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{a}{b}', CAST({v} AS DOUBLE))" for n, f in (("gc", lambda a, b: (a in "GC") + (b in "GC")), ("step", lambda a, b: DNA.index(a) - DNA.index(b))) for a in DNA for b in DNA for v in [f(a, b)]) + ") v(scale, pair, x))"


@query("SELECT seq_id, scale, round(avg(x), 6) AS mean, max(x) AS most FROM km JOIN sc ON pair = kmer GROUP BY ALL", V.SEQS, KMERS.format(k=2), _TWO)
def p17_scales(spark, d) -> DataFrame:
    """Any number of scales as a table: sixteen rows to a scale meet the pairs."""
    rows = [("gc", a + b, float((a in "GC") + (b in "GC"))) for a in DNA for b in DNA] + [("step", a + b, float(DNA.index(a) - DNA.index(b))) for a in DNA for b in DNA]
    scales = spark.createDataFrame(rows, "scale string, pair string, x double")
    return kmers.pair_scales(V.seqs(spark, d), "seq_id", "seq", scales).select("seq_id", "scale", r6("mean").alias("mean"), "most")


@query(
    """SELECT l AS transcript, min(r) AS other, any_value(f1) AS f1 FROM (SELECT l, r, round(f1, 6) AS f1, max(round(f1, 6)) OVER (PARTITION BY l) AS top FROM (SELECT a.t AS l, b.t AS r, 2.0 * sum(least(a.e, b.e) - greatest(a.s, b.s)) / (any_value(x.n) + any_value(y.n)) AS f1 FROM ta a JOIN tb b ON a.c = b.c AND a.s < b.e AND b.s < a.e
 JOIN (SELECT t, sum(e - s) AS n FROM ta GROUP BY t) x ON x.t = a.t JOIN (SELECT t, sum(e - s) AS n FROM tb GROUP BY t) y ON y.t = b.t GROUP BY a.t, b.t)) WHERE f1 = top GROUP BY l""",
    V.INTERVALS, """tx AS (SELECT id // 10 AS t, chrom AS c, "start" AS s, "end" AS e, flag FROM intervals), ta AS (SELECT t, c, s, e FROM tx WHERE flag = 'A'), tb AS (SELECT t, c, s, e FROM tx WHERE flag = 'R')""",
)
def j7_transcript_matches(spark, d) -> DataFrame:
    x = V.intervals(spark, d).select(F.floor(F.col("id") / 10).alias("transcript"), "chrom", F.lit("+").alias("strand"), "start", "end", "flag")
    found = genome.transcript_matches(x.where("flag = 'A'").drop("flag"), x.where("flag = 'R'").drop("flag"))
    return found.select("transcript", "other", r6("f1").alias("f1"))


@query("SELECT t.i - 1 AS pos, substring(w, t.i, 1) AS sym, CAST(sum(weight) AS DOUBLE) AS cnt FROM (SELECT kmer AS w, sum(weight) AS weight FROM bk GROUP BY kmer), LATERAL (SELECT unnest(generate_series(1, 5)) AS i) t GROUP BY ALL", V.BRANDS, BRAND_KMERS.format(k=5))
def l11_windows_matrix(spark, d) -> DataFrame:
    fit = lambda x: kmers.position_counts(x, "seq", F.col("weight"))
    return models.fit_on_windows(V.brands(spark, d), "seq", 5, fit).select(F.col("pos").cast("bigint").alias("pos"), "sym", "cnt")


@query()
def z6_discovery(spark, d) -> DataFrame:
    """A motif of all texts' sequences, from the best of the enriched words; tests plant one and find it."""
    x = V.brands(spark, d)
    seed = motifs.seeds(x.where("class_id = 0"), x.where("class_id = 1"), "seq", "id", 4, 1)[0]
    model, share = motifs.discover(x.where("class_id = 0"), "seq", 5, seed, steps=3)
    rows = [(i, c, float(v), share) for i, row in enumerate(model.logs) for c, v in zip(DNA, row)]
    return spark.createDataFrame(rows, "pos int, sym string, log_prob double, share double")
