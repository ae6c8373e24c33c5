"""Topics as long tables: phi (topic, word, p) and theta (doc_id, topic, p), and what is asked of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .embedding import cosine_top_k

EPS = 1e-12


def phi_from(assigned: DataFrame, beta: float = 0.01) -> DataFrame:
    """phi of tokens (topic, word): (n + beta) / (N + beta V) over the whole vocabulary.

    The counts are kept as one row a word, so tokens are read once; a word's row yields those of its topics.
    """
    per = cut(_maps(assigned.groupBy("topic", "word").agg(F.count("*").alias("n")), "word"))
    n = per.select(F.explode("counts").alias("c")).groupBy("c.topic").agg(F.sum("c.n").alias("total"))
    every = n.agg(F.collect_list(F.struct("topic", "total")).alias("topics")).join(per.agg(F.count("*").alias("v")), F.lit(True))  # one row of K topics
    grid = per.join(F.broadcast(every), F.lit(True)).select("word", "v", "m", F.explode("topics").alias("t"))
    return grid.select("t.topic", "word", ((F.coalesce(F.try_element_at("m", F.col("t.topic")), F.lit(0)) + F.lit(beta)) / (F.col("t.total") + F.lit(beta) * F.col("v"))).alias("p"))


def theta_from(assigned: DataFrame, topics: DataFrame, alpha: float = 0.1) -> DataFrame:
    """theta of tokens (doc_id, topic): (n + alpha) / (N + alpha K) for the K given topics."""
    per = _maps(assigned.groupBy("doc_id", "topic").agg(F.count("*").alias("n")), "doc_id")
    k = topics.select("topic").distinct().agg(F.collect_list(F.struct("topic")).alias("topics"), F.count("*").alias("k"))  # one row of K topics
    grid = per.join(F.broadcast(k), F.lit(True)).select("doc_id", "total", "k", "m", F.explode("topics").alias("t"))
    return grid.select("doc_id", "t.topic", ((F.coalesce(F.try_element_at("m", F.col("t.topic")), F.lit(0)) + F.lit(alpha)) / (F.col("total") + F.lit(alpha) * F.col("k"))).alias("p"))


def _maps(n: DataFrame, by: str) -> DataFrame:
    """(by, counts, total, m) of counts (by, topic, n): the rows of each, their sum, and the counts of topics that aren't null."""
    per = n.groupBy(by).agg(F.collect_list(F.struct("topic", "n")).alias("counts"), F.sum("n").alias("total"))
    return per.withColumn("m", F.map_from_entries(F.filter("counts", lambda c: c["topic"].isNotNull())))


def _ranked(rows: DataFrame, x: str) -> DataFrame:
    """(topic, x, r, size): ranks of the values x from 1 within a topic, ties sharing their mean, and the topic's rows.

    Equal values are counted first. What is left is dealt by ranges, so no task holds a topic: a value's rank is the rows
    of the ranges before its own, and those before it in its range.
    """
    c = cut(rows.groupBy("topic", x).agg(F.count("*").alias("c")).repartitionByRange("topic", x).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("topic").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = c.groupBy("topic", "part").agg(F.sum("c").alias("s")).withColumns({"done": F.coalesce(F.sum("s").over(before), F.lit(0)), "size": F.sum("s").over(Window.partitionBy("topic"))})
    here = Window.partitionBy("topic", "part").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    j = c.withColumn("own", F.coalesce(F.sum("c").over(here), F.lit(0))).join(F.broadcast(parts.drop("s")), ["topic", "part"])
    return j.select("topic", x, (F.col("done") + F.col("own") + 1 + (F.col("c") - 1) / 2).alias("r"), "size")


def _quantiles(phi: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """rows of phi with f and x, the quantiles in their topics of p and of a word's exclusivity e; all rows if none are given.

    rows are topic, word, p and e of a few, if given.
    """
    e = exclusive(phi)
    f, x = (_ranked(e, c).select("topic", c, (F.col("r") / F.col("size")).alias(q)) for c, q in (("p", "f"), ("e", "x")))
    out = e if rows is None else rows
    return out.join(f, ["topic", "p"]).join(x, ["topic", "e"])


def exclusive(phi: DataFrame) -> DataFrame:
    """phi with e, the topic's share of a word's p over all topics; summed by size, so that e is the same in each reading."""
    total = F.aggregate(F.array_sort(F.collect_list("p").over(Window.partitionBy("word"))), F.lit(0.0), lambda s, p: s + p)
    return phi.withColumn("e", F.round(F.col("p") / total, 12))  # sums of another order tie alike


def frex(phi: DataFrame, w: float = 0.5) -> DataFrame:
    """(topic, word, score): the harmonic mean of a word's frequency and exclusivity quantiles in its topic."""
    return _quantiles(phi).select("topic", "word", (1 / (w / F.col("f") + (1 - w) / F.col("x"))).alias("score"))


def lift(phi: DataFrame, vocab: DataFrame) -> DataFrame:
    """(topic, word, score): p over the word's share of the corpus (vocab: word, cf)."""
    total = vocab.agg(F.sum("cf").alias("total"))
    share = vocab.join(F.broadcast(total), F.lit(True)).select("word", (F.col("cf") / F.col("total")).alias("share"))
    return phi.join(share, "word").select("topic", "word", (F.col("p") / F.col("share")).alias("score"))


def score(phi: DataFrame) -> DataFrame:
    """(topic, word, score): p * (ln p - the mean of ln p over topics)."""
    lp = F.log(F.greatest("p", F.lit(EPS)))
    return phi.select("topic", "word", (F.col("p") * (lp - F.avg(lp).over(Window.partitionBy("word")))).alias("score"))


def relevance(phi: DataFrame, vocab: DataFrame, lam: float = 0.6) -> DataFrame:
    """(topic, word, score): lam ln p + (1 - lam) (ln p - ln share), both held at 1e-12."""
    total = vocab.agg(F.sum("cf").alias("total"))
    share = vocab.join(F.broadcast(total), F.lit(True)).select("word", (F.col("cf") / F.col("total")).alias("share"))
    lp, lw = F.log(F.greatest("p", F.lit(EPS))), F.log(F.greatest("share", F.lit(EPS)))
    return phi.join(share, "word").select("topic", "word", (lam * lp + (1 - lam) * (lp - lw)).alias("score"))


def exclusivity(phi: DataFrame, n: int = 10, w: float = 0.7) -> DataFrame:
    """(topic, score): the sum over a topic's n likeliest words of the harmonic mean of exclusivity and frequency ranks."""
    first = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("p"), "word"))
    top = exclusive(phi).withColumn("k", first).where(F.col("k") <= n)
    return _quantiles(phi, F.broadcast(top)).groupBy("topic").agg(F.sum(1 / (w / F.col("x") + (1 - w) / F.col("f"))).alias("score"))


def diversity(top: DataFrame) -> DataFrame:
    """One row: the share of distinct words among all topics' top words (topic, rank, word)."""
    return top.agg((F.countDistinct("word") / F.count("*")).alias("diversity"))


def inverted_rbo(top: DataFrame, p: float = 0.9) -> DataFrame:
    """One row: 1 less the mean rank-biased overlap of pairs of topics' lists (extrapolated at their common depth)."""
    a = top.select(F.col("topic").alias("i"), F.col("rank").alias("ra"), "word")
    b = top.select(F.col("topic").alias("j"), F.col("rank").alias("rb"), "word")
    depth = top.agg(F.max("rank").alias("depth"))
    names = top.select("topic").distinct()
    pairs = names.select(F.col("topic").alias("i")).join(names.select(F.col("topic").alias("j")), F.col("i") < F.col("j"))
    # an overlap counts from the greater of its two ranks on
    met = a.join(b, "word").where("i < j").select("i", "j", F.greatest("ra", "rb").alias("at"))
    steps = pairs.join(F.broadcast(depth), F.lit(True)).select("i", "j", "depth", F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("d"))
    seen = steps.join(met, ["i", "j"], "left").groupBy("i", "j", "depth", "d").agg(F.count(F.when(F.col("at") <= F.col("d"), 1)).alias("x"))
    rbo = seen.groupBy("i", "j", "depth").agg((F.sum(F.col("x") / F.col("d") * F.pow(F.lit(p), F.col("d"))) * (1 - p) / p).alias("s"), F.max(F.when(F.col("d") == F.col("depth"), F.col("x"))).alias("x"))
    each = rbo.select((F.col("s") + F.col("x") / F.col("depth") * F.pow(F.lit(p), F.col("depth"))).alias("rbo"))
    return each.agg((1 - F.avg("rbo")).alias("inverted_rbo"))


def sizes(theta: DataFrame) -> DataFrame:
    """(topic, docs, mass): documents whose first greatest topic it is, and the sum of its shares."""
    best = theta.groupBy("doc_id").agg(F.min_by("topic", F.struct((-F.col("p")).alias("a"), "topic")).alias("topic"))
    n = best.groupBy("topic").agg(F.count("*").alias("docs"))
    return theta.groupBy("topic").agg(F.sum("p").alias("mass")).join(n, "topic", "left").select("topic", F.coalesce("docs", F.lit(0)).alias("docs"), "mass")


def prevalence(theta: DataFrame, meta: DataFrame, by: str) -> DataFrame:
    """(group, topic, n, mean, se): se is the sample deviation over the root of n, 0 for one document."""
    j = theta.join(meta.select("doc_id", F.col(by).alias("group")), "doc_id").groupBy("group", "topic")
    return j.agg(F.count("*").alias("n"), F.avg("p").alias("mean"), F.coalesce(F.stddev_samp("p") / F.sqrt(F.count("*")), F.lit(0.0)).alias("se"))


def over_time(theta: DataFrame, meta: DataFrame, time: str) -> DataFrame:
    """(time, topic, share): mean shares of a time's documents, scaled to sum to 1."""
    m = theta.join(meta.select("doc_id", F.col(time).alias("time")), "doc_id").groupBy("time", "topic").agg(F.avg("p").alias("m"))
    total = F.sum("m").over(Window.partitionBy("time"))
    return m.select("time", "topic", (F.col("m") / F.when(total == 0, 1.0).otherwise(total)).alias("share"))


def crosstab(theta: DataFrame, meta: DataFrame, by: str) -> DataFrame:
    """(topic, value, n): documents by their greatest topic and a covariate; nulls are a value."""
    best = theta.groupBy("doc_id").agg(F.min_by("topic", F.struct((-F.col("p")).alias("a"), "topic")).alias("topic"))
    return best.join(meta.select("doc_id", F.col(by).alias("value")), "doc_id").groupBy("topic", "value").agg(F.count("*").alias("n"))


def correlation(theta: DataFrame, least: float | None = None) -> DataFrame:
    """(a, b, r): correlations of topics' shares over documents for a < b, 0 where undefined; least keeps greater ones."""
    x, y = theta.select("doc_id", F.col("topic").alias("a"), F.col("p").alias("x")), theta.select("doc_id", F.col("topic").alias("b"), F.col("p").alias("y"))
    r = x.join(y, "doc_id").where("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("r"))
    r = r.select("a", "b", F.when(F.isnan("r") | F.col("r").isNull(), 0.0).otherwise(F.col("r")).alias("r"))
    return r if least is None else r.where(F.col("r") > least)


def find_thoughts(theta: DataFrame, n: int = 3) -> DataFrame:
    """(topic, rank, doc_id, p): each topic's likeliest documents, ties to the smaller id."""
    w = Window.partitionBy("topic").orderBy(F.desc("p"), "doc_id")
    return theta.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("topic", "rank", "doc_id", "p")


def topics_for_term(phi: DataFrame, word: str) -> DataFrame:
    return phi.where(F.col("word") == word).select("topic", "p").orderBy(F.desc("p"), "topic")


def significance(phi: DataFrame, background: DataFrame | None = None) -> DataFrame:
    """(topic, kl): divergence from the uniform distribution, or from background (word, p)."""
    if background is None:
        n = phi.groupBy("topic").agg(F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0)).alias("h"), F.count("*").alias("v"))
        return n.select("topic", (F.col("h") + F.log("v")).alias("kl"))
    j = phi.join(background.select("word", F.col("p").alias("q")), "word")
    return j.groupBy("topic").agg(F.sum(F.when(F.col("p") > 0, F.col("p") * F.log(F.col("p") / F.greatest("q", F.lit(EPS)))).otherwise(0.0)).alias("kl"))


def js_polarization(group_phi: DataFrame) -> DataFrame:
    """(topic, js): for phi by group, (entropy of the mean - mean entropy) / ln G, from 0 to 1."""
    h = lambda c: -F.sum(F.when(F.col(c) > 0, F.col(c) * F.log(c)).otherwise(0.0))
    g = group_phi.groupBy("topic").agg(F.countDistinct("group").alias("g"))
    mix = group_phi.groupBy("topic", "word").agg(F.sum("p").alias("s")).join(F.broadcast(g), "topic").withColumn("m", F.col("s") / F.col("g")).groupBy("topic").agg(h("m").alias("hm"))
    own = group_phi.groupBy("topic", "group").agg(h("p").alias("h")).groupBy("topic").agg(F.avg("h").alias("ha"))
    return mix.join(own, "topic").join(g, "topic").select("topic", F.when(F.col("g") > 1, (F.col("hm") - F.col("ha")) / F.log("g")).otherwise(0.0).alias("js"))


def hellinger(group_phi: DataFrame, a, b) -> DataFrame:
    """(topic, distance) between two groups' distributions."""
    s = F.sqrt(F.sum(F.when(F.col("group") == a, F.col("p")).otherwise(0.0)))
    t = F.sqrt(F.sum(F.when(F.col("group") == b, F.col("p")).otherwise(0.0)))
    d = group_phi.groupBy("topic", "word").agg(s.alias("s"), t.alias("t"))
    return d.groupBy("topic").agg(F.sqrt(F.sum((F.col("s") - F.col("t")) * (F.col("s") - F.col("t"))) / 2).alias("distance"))


def bimodality(theta: DataFrame) -> DataFrame:
    """(topic, bimodality): (skewness^2 + 1) / kurtosis of shares, by population moments."""
    return theta.groupBy("topic").agg(((F.pow(F.skewness("p"), 2) + 1) / (F.kurtosis("p") + 3)).alias("bimodality"))


def entropy(phi: DataFrame) -> DataFrame:
    """(topic, entropy), 1 for a uniform topic."""
    e = phi.groupBy("topic").agg((-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0))).alias("h"), F.count("*").alias("v"))
    return e.select("topic", (F.col("h") / F.log("v")).alias("entropy"))


def _dense(table: DataFrame, by: str, topics: list) -> DataFrame:
    """(by, x): the shares of the topics in order, one array a row."""
    m = table.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("topic", "p"))).alias("m"))
    return m.select(by, F.transform(F.array(*[F.lit(t) for t in topics]), lambda t: F.coalesce(F.try_element_at("m", t), F.lit(0.0))).alias("x"))


def word_probabilities(words: DataFrame, phi: DataFrame, theta: DataFrame) -> DataFrame:
    """(doc_id, word, n, p) of a bag: p under the document's mixture. Words and documents that lack a side are left out.

    phi and theta meet the bag as arrays over the topics, so no row is multiplied by their number. Documents come first:
    a bag that is dealt by documents meets their mixtures where it lies, and only what has both is dealt by words.
    """
    topics = sorted(r["topic"] for r in theta.select("topic").distinct().collect())  # K rows
    j = words.join(_dense(theta, "doc_id", topics).withColumnRenamed("x", "b"), "doc_id").join(_dense(phi, "word", topics).withColumnRenamed("x", "a"), "word")
    return j.select("doc_id", "word", "n", F.aggregate(F.zip_with("a", "b", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x).alias("p"))


def perplexity(words: DataFrame, phi: DataFrame, theta: DataFrame) -> DataFrame:
    """One row (tokens, log_likelihood, perplexity) of a bag (doc_id, word, n); words phi lacks don't count."""
    each = word_probabilities(words, phi, theta)
    return each.agg(F.sum("n").alias("tokens"), F.sum(F.col("n") * F.log("p")).alias("log_likelihood")).withColumn("perplexity", F.exp(-F.col("log_likelihood") / F.col("tokens")))


def document_residuals(words: DataFrame, phi: DataFrame, theta: DataFrame) -> DataFrame:
    """(doc_id, n, novelty): the mean of -ln p over a document's known tokens; without any, 0 tokens and NaN."""
    each = word_probabilities(words, phi, theta).groupBy("doc_id").agg(F.sum("n").alias("n"), (-F.sum(F.col("n") * F.log("p")) / F.sum("n")).alias("novelty"))
    return words.select("doc_id").distinct().join(each, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("novelty", F.lit(float("nan"))).alias("novelty"))


def nearest_documents(theta: DataFrame, queries: DataFrame, n: int = 5) -> DataFrame:
    """(query, rank, doc_id, distance): Hellinger-nearest documents of the queries (doc_id), ties to the smaller id.

    Roots of mixtures are unit vectors whose inner product is the Bhattacharyya coefficient, so they are searched as vectors.
    """
    topics = sorted(r["topic"] for r in theta.select("topic").distinct().collect())  # K rows
    roots = _dense(theta, "doc_id", topics).select("doc_id", F.transform("x", lambda p: F.sqrt(p)).alias("root"))
    q = roots.join(queries.select("doc_id").distinct(), "doc_id", "left_semi")
    near = cosine_top_k(q, roots, n, "doc_id", "root")
    return near.select("query", "rank", F.col("id").alias("doc_id"), F.sqrt(F.greatest(1 - F.col("cosine"), F.lit(0.0))).alias("distance"))


def approximate_distribution(windows: DataFrame, weights: DataFrame, topics: DataFrame, least: float = 0.0) -> DataFrame:
    """(doc_id, topic, p): windows (doc_id, start, tokens) scored by the cosine of their counts with topics' weights (topic, word, weight).

    Scores at or below least don't count; a document without any evidence is uniform over topics.
    """
    n = windows.select("doc_id", "start", F.explode("tokens").alias("word")).groupBy("doc_id", "start", "word").agg(F.count("*").alias("n"))
    size = n.groupBy("doc_id", "start").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("a"))
    length = weights.groupBy("topic").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("b"))
    s = n.join(weights, "word").groupBy("doc_id", "start", "topic").agg(F.sum(F.col("n") * F.col("weight")).alias("d")).join(size, ["doc_id", "start"]).join(F.broadcast(length), "topic")
    s = s.withColumn("s", F.col("d") / (F.col("a") * F.col("b"))).where(F.col("s") > least).groupBy("doc_id", "topic").agg(F.sum("s").alias("s"))
    grid = windows.select("doc_id").distinct().join(F.broadcast(topics.select("topic").distinct()), F.lit(True)).join(s, ["doc_id", "topic"], "left").na.fill(0.0, ["s"])
    w = Window.partitionBy("doc_id")
    total = F.sum("s").over(w)
    return grid.select("doc_id", "topic", F.when(total > 0, F.col("s") / total).otherwise(1.0 / F.count("*").over(w)).alias("p"))


def contrastive_words(words: DataFrame, theta: DataFrame, phi: DataFrame, meta: DataFrame, by: str) -> DataFrame:
    """(topic, group, word, weight): a group's words under each topic, weighted by the topic's responsibility for them."""
    p = words.join(phi.select("topic", "word", F.col("p").alias("pw")), "word").join(theta.select("doc_id", "topic", F.col("p").alias("pt")), ["doc_id", "topic"])
    r = p.withColumn("r", F.col("pw") * F.col("pt")).withColumn("share", F.col("r") / F.sum("r").over(Window.partitionBy("doc_id", "word")))
    return r.join(meta.select("doc_id", F.col(by).alias("group")), "doc_id").groupBy("topic", "group", "word").agg(F.sum(F.col("n") * F.col("share")).alias("weight"))


def prevalence_with_draws(draws: DataFrame, meta: DataFrame, by: str) -> DataFrame:
    """(group, topic, mean, se) over posterior draws: the mean within-draw variance over n, plus (1 + 1 / m) times the variance between draws."""
    each = draws.join(meta.select("doc_id", F.col(by).alias("group")), "doc_id").groupBy("draw", "group", "topic").agg(F.avg("p").alias("m"), (F.coalesce(F.var_samp("p"), F.lit(0.0)) / F.count("*")).alias("v"))
    out = each.groupBy("group", "topic").agg(F.avg("m").alias("mean"), F.avg("v").alias("within"), F.coalesce(F.var_samp("m"), F.lit(0.0)).alias("between"), F.count("*").alias("draws"))
    return out.select("group", "topic", "mean", F.sqrt(F.col("within") + (1 + 1 / F.col("draws")) * F.col("between")).alias("se"))


def draw_quantiles(draws: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(topic, low, mean, high) of each draw's mean share, with linear interpolation."""
    m = draws.groupBy("draw", "topic").agg(F.avg("p").alias("m"))
    return m.groupBy("topic").agg(F.expr(f"percentile(m, {low})").alias("low"), F.avg("m").alias("mean"), F.expr(f"percentile(m, {high})").alias("high"))


def merge_labels(labels: DataFrame, groups: list[list[int]]) -> DataFrame:
    """(doc_id, topic): each group takes its least id, chains resolve, and the ids left are renumbered from 0; -1 stays."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    for g in groups:
        low = min(find(x) for x in g)
        for x in g:
            root[find(x)] = low
    pairs = [(x, find(x)) for x in root]
    to = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for p in pairs for v in p]), F.col("topic")), F.col("topic")) if pairs else F.col("topic")
    moved = labels.withColumn("topic", to)
    kept = sorted(r["topic"] for r in moved.select("topic").distinct().where("topic >= 0").collect())
    dense = F.create_map(*[F.lit(v) for i, x in enumerate(kept) for v in (x, i)]) if kept else None
    return moved.withColumn("topic", F.coalesce(F.element_at(dense, F.col("topic")), F.col("topic"))) if kept else moved


def pair_diversity(top: DataFrame) -> DataFrame:
    """One row: the share of distinct word pairs among all topics' pairs of top words."""
    a, b = top.select("topic", F.col("word").alias("x")), top.select("topic", F.col("word").alias("y"))
    p = a.join(b, "topic").where("x < y")
    return p.agg((F.countDistinct("x", "y") / F.count("*")).alias("pair_diversity"))


def shrink(phi: DataFrame, strength: float = 0.5) -> DataFrame:
    """phi drawn towards each word's mean over topics, then scaled to sum to 1."""
    m = (1 - strength) * F.col("p") + strength * F.avg("p").over(Window.partitionBy("word"))
    s = phi.withColumn("p", m)
    return s.select("topic", "word", (F.col("p") / F.sum("p").over(Window.partitionBy("topic"))).alias("p"))


def label_topics(phi: DataFrame, vocab: DataFrame, n: int = 7) -> DataFrame:
    """(ranking, topic, word, rank): leading words by probability, FREX, lift and score."""
    from .vocabulary import top_words

    parts = [top_words(df.select("topic", "word", "score"), "topic", "score", n).select(F.lit(name).alias("ranking"), "topic", "word", "rank")
             for name, df in (("prob", phi.withColumnRenamed("p", "score")), ("frex", frex(phi)), ("lift", lift(phi, vocab)), ("score", score(phi)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
