"""One query for each operator, and the same in DuckDB's SQL where that can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import evaluate, fusion, labels, mining, pairs, profile, retrieve
from millrace.operators.scratch import new_path, stored
from millrace.plans import adapters as A
from millrace.sources import tracker
from millrace.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


BEST = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id)"


def topk(source: str, n: int, where: str = "TRUE") -> str:
    return f"SELECT query_id, candidate_id, score, rank FROM (SELECT *, {BEST} AS rank FROM {source} WHERE {where}) WHERE rank <= {n}"


def dense(n: int, source: str = "queries", where: str = "c.created_at < q.cutoff") -> str:
    return topk(f"(SELECT query_id, c.id AS candidate_id, round(list_dot_product(q.vec, c.vec), 6) AS score FROM {source} q JOIN vectors c ON {where})", n)


# ---- retrieval

@query(with_(A.VECTORS, A.QUERIES) + dense(10))
def dense_topk(spark, sf):
    return retrieve.dense_topk(A.vector_queries(spark, sf), A.vectors(spark, sf), 10)


@query(with_(A.VECTORS, A.QUERIES, f"wide AS ({dense(100, where='TRUE')})") + topk("(SELECT w.query_id, candidate_id, score FROM wide w JOIN vectors c ON c.id = candidate_id JOIN queries q ON q.query_id = w.query_id WHERE c.created_at < q.cutoff)", 10))
def dense_topk_postfilter(spark, sf):
    return retrieve.dense_topk_postfilter(A.vector_queries(spark, sf), A.vectors(spark, sf), 10)


def blended(n: int, alpha: float) -> str:
    return topk(f"(SELECT query_id, c.id AS candidate_id, round({1 - alpha}::DOUBLE * list_dot_product(q.vec, c.vec) + {alpha}::DOUBLE * coalesce(list_dot_product(q.vec, t.vec), 0), 6) AS score FROM queries q JOIN vectors c ON c.created_at < q.cutoff LEFT JOIN titles t ON t.id = c.id)", n)


@query(with_(A.VECTORS, A.QUERIES, A.TITLES) + blended(10, 0.3))
def title_weighted_topk(spark, sf):
    return retrieve.title_weighted_topk(A.vector_queries(spark, sf), A.vectors(spark, sf), A.titles(spark, sf), 10)


WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
ATOMIC = "list_filter(list_transform(regexp_extract_all(lower(text), '\\S+'), lambda x: trim(x, '\"''`(),.:;!?[]{}<>*#|')), lambda x: x <> '')"
BOTH = f"flatten(list_transform({ATOMIC}, lambda x: CASE WHEN len(regexp_extract_all(x, '[a-z0-9]+')) > 1 THEN list_concat([x], regexp_extract_all(x, '[a-z0-9]+')) ELSE [x] END))"


def bm25_ctes(tokens: str) -> tuple[str, ...]:
    return (
        A.ISSUES, A.TEXTS, f"toks AS (SELECT id, created_at, {tokens} AS t FROM texts)", "stats AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM toks)",
        "tf AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(t) AS token FROM toks) GROUP BY ALL)", "df AS (SELECT token, count(*) AS df FROM tf GROUP BY token)",
        "raw AS (SELECT token, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, stats)", "idf AS (SELECT token, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)",
    )


def bm25_hits(n: int) -> str:
    return (
        "wanted AS (SELECT id AS query_id, created_at AS cutoff, token, tf AS qtf FROM tf JOIN toks USING (id) WHERE id % 100 = 0), "
        "postings AS (SELECT token, tf.id, created_at, idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len(t) / avgdl)) AS weight FROM tf JOIN toks ON toks.id = tf.id JOIN idf USING (token), stats), "
        f"bm25 AS (SELECT * FROM ({topk('(SELECT query_id, p.id AS candidate_id, round(sum(qtf * weight), 6) AS score FROM wanted w JOIN postings p ON p.token = w.token AND p.created_at < w.cutoff GROUP BY ALL)', n)}) WHERE score > 0)"
    )


def bm25_sql(tokens: str, n: int = 10) -> str:
    return with_(*bm25_ctes(tokens), bm25_hits(n)) + "SELECT query_id, candidate_id, score, rank FROM bm25"


def bm25(spark, sf, name: str, n: int = 10, postings: DataFrame | None = None) -> DataFrame:
    tokens = T.TOKENIZERS[name](F.col("text"))
    docs = A.texts(spark, sf)
    postings = retrieve.bm25_postings(docs, tokens) if postings is None else postings
    asked = docs.where("id % 100 = 0").select(F.col("id").alias("query_id"), "text", F.col("created_at").alias("cutoff"))
    return retrieve.bm25_topk(asked, postings, tokens, n)


@query(with_(*bm25_ctes(WORDS)) + "SELECT token, df, round(idf, 6) AS idf FROM idf")
def bm25_idf(spark, sf):
    """How often a word is in its document isn't asked, so no table of documents and words is made."""
    words = A.texts(spark, sf).select(F.array_distinct(T.tok_words(F.col("text"))).alias("token"))
    return retrieve.bm25_idf(words).select("token", "df", F.round("idf", 6).alias("idf"))


@query(bm25_sql(WORDS))
def bm25_topk_words(spark, sf):
    return bm25(spark, sf, "words")


@query(bm25_sql(ATOMIC))
def bm25_topk_atomic(spark, sf):
    return bm25(spark, sf, "atomic")


@query(bm25_sql(BOTH))
def bm25_topk_both(spark, sf):
    return bm25(spark, sf, "both")


def fused(*names: str, n: int = 10) -> str:
    union = " UNION ALL ".join(f"SELECT query_id, candidate_id, rank FROM {x}" for x in names)
    return topk(f"(SELECT query_id, candidate_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM ({union}) GROUP BY ALL)", n)


@query(with_(A.VECTORS, A.QUERIES, *bm25_ctes(WORDS), bm25_hits(50), f"dense AS ({dense(50)})") + fused("dense", "bm25"))
def rrf_hybrid(spark, sf):
    return fusion.rrf([retrieve.dense_topk(A.vector_queries(spark, sf), A.vectors(spark, sf), fusion.DEPTH), bm25(spark, sf, "words", fusion.DEPTH)], 10)


@query(with_(A.VECTORS, A.QUERIES, A.TITLES, *bm25_ctes(WORDS), bm25_hits(50), f"titled AS ({blended(50, 0.3)})") + fused("titled", "bm25"))
def field_aware_hybrid(spark, sf):
    titled = retrieve.title_weighted_topk(A.vector_queries(spark, sf), A.vectors(spark, sf), A.titles(spark, sf), fusion.DEPTH)
    return fusion.rrf([titled, bm25(spark, sf, "words", fusion.DEPTH)], 10)


@query(with_(A.VECTORS, A.QUERIES, A.TITLES, f"d AS ({dense(50)})", f"t AS ({blended(50, 0.3)})", f"p AS ({topk('(SELECT query_id, c.id AS candidate_id, round(list_dot_product(q.vec, c.vec), 6) AS score FROM queries q JOIN titles c ON c.id < q.query_id)', 50)})") + fused("d", "t", "p"))
def rrf_three_lists(spark, sf):
    q, v, t = A.vector_queries(spark, sf), A.vectors(spark, sf), A.titles(spark, sf)
    own = t.select("id", "vec", A.minutes("id").alias("created_at"))
    return fusion.rrf([retrieve.dense_topk(q, v, 50), retrieve.title_weighted_topk(q, v, t, 50), retrieve.dense_topk(q, own, 50)], 10)


# A stand-in for a cross-encoder's scores, the same in both engines: the share of common words.
@query(with_(*bm25_ctes(WORDS), bm25_hits(50), "w AS (SELECT id, list_distinct(t) AS s FROM toks)") + topk("(SELECT query_id, candidate_id, round(len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))), 6) AS score FROM bm25 JOIN w a ON a.id = query_id JOIN w b ON b.id = candidate_id)", 10))
def rerank_apply(spark, sf):
    """The index has the words of each document once, so texts are not tokenized again."""
    postings = retrieve.bm25_postings(A.texts(spark, sf), T.tok_words(F.col("text")))
    hits = stored(bm25(spark, sf, "words", 50, postings).select("query_id", "candidate_id"), "hits")
    words = postings.where("not word").select("id", F.col("token").alias("s"))
    a, b = words.select(F.col("id").alias("query_id"), F.col("s").alias("a")), words.select(F.col("id").alias("candidate_id"), F.col("s").alias("b"))
    scores = hits.join(a, "query_id").join(b, "candidate_id").select("query_id", "candidate_id", F.round(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")), 6).alias("score"))
    return retrieve.rerank(hits, scores, 10)


@query(with_(A.ISSUES, A.VECTORS, "queries AS (SELECT id AS query_id, vec, NULL::TIMESTAMP AS cutoff FROM vectors WHERE id % 100 = 0)", f"hits AS ({dense(20, where='TRUE')})") + "SELECT query_id, candidate_id, score, rank, title, state, strftime(created_at, '%Y-%m-%d') AS created FROM hits JOIN issues ON number = candidate_id")
def search_duplicates(spark, sf):
    """Live search: no cutoff, at most 20, with metadata."""
    q = A.vector_queries(spark, sf).withColumn("cutoff", F.lit(None).cast("timestamp_ntz"))
    meta = A.issues(spark, sf).select(F.col("number").alias("id"), "title", "state", F.date_format("created_at", "yyyy-MM-dd").alias("created"))
    return retrieve.with_metadata(retrieve.dense_topk(q, A.vectors(spark, sf), 20), meta)


# ---- pairs

MARKED = "marked AS (SELECT DISTINCT i.number FROM issues i LEFT JOIN issue_labels l ON l.issue_number = i.number AND lower(l.label) = '*duplicate' WHERE upper(i.state_reason) = 'DUPLICATE' OR l.issue_number IS NOT NULL)"
# DuckDB's regular expressions have no flag d, and need none: only a line feed ends a line there.
FOUND = " UNION ALL ".join(f"SELECT issue_number, id, created_at, {i} AS i, '{name}' AS pattern, regexp_extract(body, '{before.replace('(?imd)', '(?im)')}{pairs.reference()}', 1) AS ref FROM comments" for i, (name, before) in enumerate(pairs.PATTERNS))
EXTRACTED = f"""extracted AS (SELECT issue_number AS number, ref::BIGINT AS canonical, pattern FROM (SELECT *, row_number() OVER (PARTITION BY issue_number ORDER BY i, created_at DESC, id DESC) AS r
    FROM ({FOUND}) WHERE ref <> '' AND ref::BIGINT <> issue_number) WHERE r = 1)"""
CLASSIFIED = """classified AS (SELECT m.number, e.canonical, e.pattern, i.created_at, CASE WHEN e.canonical IS NULL THEN 'no_canonical_in_text' WHEN c.number IS NULL THEN 'canonical_not_in_corpus'
    WHEN c.created_at >= i.created_at THEN 'canonical_newer_than_query' ELSE 'usable' END AS status
    FROM marked m JOIN issues i ON i.number = m.number LEFT JOIN extracted e ON e.number = m.number LEFT JOIN issues c ON c.number = e.canonical)"""
PAIR_CTES = with_(A.ISSUES, A.LABELS, A.COMMENTS, MARKED, EXTRACTED, CLASSIFIED)


def classified(spark, sf):
    issues = A.issues(spark, sf)
    marked = pairs.duplicate_ids(issues, A.issue_labels(spark, sf))
    return pairs.classified(marked, pairs.extract_canonical(A.comments(spark, sf)), issues), marked


@query(with_(A.ISSUES, A.LABELS, MARKED) + "SELECT number FROM marked")
def duplicate_ids(spark, sf):
    return pairs.duplicate_ids(A.issues(spark, sf), A.issue_labels(spark, sf))


@query(with_(A.COMMENTS, EXTRACTED) + "SELECT number, canonical, pattern FROM extracted")
def extract_canonical(spark, sf):
    return pairs.extract_canonical(A.comments(spark, sf))


@query(PAIR_CTES + "SELECT status, count(*) AS n FROM classified GROUP BY status")
def pair_funnel(spark, sf):
    return pairs.funnel(classified(spark, sf)[0])


@query(PAIR_CTES + "SELECT pattern, count(*) AS n FROM classified WHERE pattern IS NOT NULL GROUP BY pattern")
def pattern_hits(spark, sf):
    return pairs.pattern_hits(classified(spark, sf)[0])


SPLIT = "SELECT number AS duplicate, canonical, pattern, created_at, CASE WHEN row_number() OVER (ORDER BY created_at, number) <= floor(count(*) OVER () * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM classified WHERE status = 'usable'"


@query(PAIR_CTES + SPLIT)
def pair_split(spark, sf):
    return pairs.split(classified(spark, sf)[0])


@query(PAIR_CTES + "SELECT count(*) AS chained_canonicals FROM classified WHERE status = 'usable' AND canonical IN (SELECT number FROM marked)")
def chained_count(spark, sf):
    rows, marked = classified(spark, sf)
    return pairs.chained(rows.where("status = 'usable'"), marked)


META = "count(*) AS duplicate_marked, " + ", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in ("no_canonical_in_text", "canonical_not_in_corpus", "canonical_newer_than_query", "usable"))


@query(PAIR_CTES + f"SELECT *, floor(usable * 0.8::DOUBLE)::BIGINT AS train, usable - floor(usable * 0.8::DOUBLE)::BIGINT AS test FROM (SELECT {META} FROM classified)")
def pair_meta(spark, sf):
    return pairs.pair_meta(classified(spark, sf)[0])


# ---- evaluation

def placed(hits: str, depth: int = 10) -> str:
    return f"SELECT p.duplicate, p.canonical, h.place FROM pairs p LEFT JOIN (SELECT query_id, candidate_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM {hits} WHERE candidate_id <> query_id AND rank <= {depth}) h ON h.query_id = p.duplicate AND h.candidate_id = p.canonical"


METRICS = "round(avg(CASE WHEN place <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN place <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(CASE WHEN place <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10, round(avg(coalesce(1.0::DOUBLE / place, 0)), 6) AS mrr, count(*) AS n"


def known(spark, sf):
    return A.vectors(spark, sf).select(F.col("id").alias("number"))


@query(with_(A.VECTORS, A.QUERIES, A.PAIRS, f"hits AS ({dense(10)})", f"places AS ({placed('hits')})") + f"SELECT {METRICS}, (SELECT count(*) FROM pairs) - count(*) AS skipped FROM places")
def eval_recall_mrr(spark, sf):
    truth = A.vector_pairs(spark, sf)
    hits = retrieve.dense_topk(A.vector_queries(spark, sf), A.vectors(spark, sf), 10)
    return evaluate.metrics(evaluate.canonical_ranks(hits, truth, known(spark, sf), 10), truth.count())


@query(with_(A.VECTORS, A.PAIRS, "hits AS (SELECT duplicate AS query_id, canonical AS candidate_id, 1 AS rank FROM pairs)", f"places AS ({placed('hits')})") + f"SELECT {METRICS} FROM places")
def eval_oracle(spark, sf):
    truth = A.vector_pairs(spark, sf)
    return evaluate.metrics(evaluate.canonical_ranks(evaluate.oracle_hits(truth), truth, known(spark, sf), 10))


# What any draw must be: SQL says how many rows are earlier, and that none is late or drawn twice.
@query(with_(A.VECTORS, A.PAIRS, "earlier AS (SELECT p.duplicate, count(v.id) AS n FROM pairs p JOIN vectors q ON q.id = p.duplicate LEFT JOIN vectors v ON v.created_at < q.created_at GROUP BY ALL)") + "SELECT duplicate, least(n, 10) AS drawn, least(n, 10) AS different, 0 AS late FROM earlier")
def eval_random(spark, sf):
    truth, v = A.vector_pairs(spark, sf), A.vectors(spark, sf)
    made = v.select(F.col("id").alias("candidate_id"), F.col("created_at").alias("c_created"))
    hits = evaluate.random_hits(truth, v, 10).join(made, "candidate_id").join(v.select(F.col("id").alias("query_id"), "created_at"), "query_id")
    return hits.groupBy(F.col("query_id").alias("duplicate")).agg(F.count(F.lit(1)).alias("drawn"), F.count_distinct("candidate_id").alias("different"), F.count_if(F.col("c_created") >= F.col("created_at")).alias("late"))


TWO = (A.VECTORS, A.QUERIES, A.TITLES, A.PAIRS, f"da AS ({dense(50)})", f"tb AS ({blended(50, 0.3)})", f"a AS ({placed('da', 50)})", f"b AS ({placed('tb', 50)})")


def two_rankings(spark, sf, depth: int = 50):
    q, v, truth = A.vector_queries(spark, sf), A.vectors(spark, sf), A.vector_pairs(spark, sf)
    a = evaluate.canonical_ranks(retrieve.dense_topk(q, v, depth), truth, known(spark, sf), depth)
    return a, evaluate.canonical_ranks(retrieve.title_weighted_topk(q, v, A.titles(spark, sf), depth), truth, known(spark, sf), depth)


@query(with_(*TWO, "f AS (SELECT a.place IS NOT NULL AS x, b.place IS NOT NULL AS y FROM a JOIN b USING (duplicate, canonical))") + "SELECT count(*) FILTER (x AND y) AS found_both, count(*) FILTER (x AND NOT y) AS only_a, count(*) FILTER (NOT x AND y) AS only_b, count(*) FILTER (NOT x AND NOT y) AS neither, round(avg(x::INT), 6) AS recall_a, round(avg(y::INT), 6) AS recall_b, round(avg((x OR y)::INT), 6) AS recall_union FROM f")
def eval_overlap_ceiling(spark, sf):
    return evaluate.ceiling(*two_rankings(spark, sf))


ALPHAS = (0.0, 0.15, 0.3, 0.45, 0.6, 0.8, 1.0)
SWEEP = " UNION ALL ".join(f"SELECT {a}::DOUBLE AS alpha, {METRICS} FROM ({placed(f'({blended(10, a)})')})" for a in ALPHAS)


@query(with_(A.VECTORS, A.QUERIES, A.TITLES, A.PAIRS) + SWEEP)
def eval_alpha_sweep(spark, sf):
    q, v, t, truth = A.vector_queries(spark, sf), A.vectors(spark, sf), A.titles(spark, sf), A.vector_pairs(spark, sf)
    rows = [evaluate.metrics(evaluate.canonical_ranks(retrieve.title_weighted_topk(q, v, t, 10, a), truth, known(spark, sf), 10)).select(F.lit(a).alias("alpha"), "*") for a in ALPHAS]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


P_VALUE = "round(least(1.0, 2 * (SELECT sum(exp(lgamma(gained + lost + 1) - lgamma(i + 1) - lgamma(gained + lost - i + 1) - (gained + lost) * ln(2))) FROM range(0, 1000) t(i) WHERE i <= least(gained, lost))), 6) AS p"


@query(with_(*TWO, "c AS (SELECT count(*) FILTER (coalesce(a.place, 99) > 10 AND b.place <= 10) AS gained, count(*) FILTER (a.place <= 10 AND coalesce(b.place, 99) > 10) AS lost FROM a JOIN b USING (duplicate, canonical))") + f"SELECT gained, lost, {P_VALUE} FROM c")
def mcnemar_exact(spark, sf):
    return evaluate.with_p(evaluate.mcnemar(*two_rankings(spark, sf)))


@query("SELECT round(quantile_cont(value, 0.5), 1) AS p50, round(list_sort(list(value))[floor(0.95 * count(*))::BIGINT + 1], 1) AS p95, count(*) AS n FROM events WHERE value IS NOT NULL")
def latency_percentiles(spark, sf):
    return evaluate.latency(A.table(spark, sf, "events"))


# ---- labels

VOTED = """sums AS (SELECT query_id, label, round(sum(greatest(0.0, score)), 6) AS votes FROM hits JOIN vlabels ON issue_number = candidate_id GROUP BY ALL),
    voted AS (SELECT query_id, label, round(votes / CASE WHEN sum(votes) OVER (PARTITION BY query_id) > 0 THEN sum(votes) OVER (PARTITION BY query_id) ELSE 1 END, 3) AS confidence, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) AS rank FROM sums)"""
VLABELS = "vlabels AS (SELECT id AS issue_number, label FROM vectors)"


def vote(spark, sf, n: int, digits: int | None = 3, live: bool = False):
    q, v = A.vector_queries(spark, sf), A.vectors(spark, sf)
    hits = retrieve.dense_topk(q.withColumn("cutoff", F.lit(None).cast("timestamp_ntz")) if live else q, v, 25)
    return labels.knn_vote(hits, v.select(F.col("id").alias("issue_number"), "label"), n, digits)


@query(with_(A.VECTORS, A.QUERIES, VLABELS, f"hits AS ({dense(25)})", VOTED) + "SELECT query_id, label, confidence, rank FROM voted WHERE rank <= 5")
def knn_label_vote(spark, sf):
    return vote(spark, sf, 5)


@query(with_(A.VECTORS, A.QUERIES, VLABELS, f"hits AS ({dense(25, where='TRUE')})", VOTED.replace(", 3) AS confidence", ", 5) AS confidence")) + "SELECT query_id, label, confidence, rank FROM voted WHERE rank <= 4")
def knn_label_serving(spark, sf):
    return vote(spark, sf, 4, None, live=True).withColumn("confidence", F.round("confidence", 5))


@query(with_(A.VECTORS, A.QUERIES, VLABELS, f"hits AS ({dense(25)})", VOTED, "pred AS (SELECT query_id, label FROM voted WHERE rank <= 3)", "gold AS (SELECT id AS query_id, label FROM vectors WHERE id % 100 = 0)",
    "per AS (SELECT g.query_id, count(*) FILTER (p.label = g.label) AS hits, count(p.label) AS preds, 1 AS golds FROM gold g LEFT JOIN pred p USING (query_id) GROUP BY ALL)", "s AS (SELECT count(*) AS issues_scored, sum(hits)::DOUBLE AS h, sum(preds)::DOUBLE AS p, sum(golds)::DOUBLE AS g, count(*) FILTER (hits > 0) AS e FROM per)")
    + "SELECT issues_scored, round(h / p, 4) AS precision, round(h / g, 4) AS recall, round(2 * (h / p) * (h / g) / (h / p + h / g), 4) AS f1, round(e::DOUBLE / issues_scored, 4) AS any_correct FROM s")
def label_metrics(spark, sf):
    gold = A.vectors(spark, sf).where("id % 100 = 0").select(F.col("id").alias("query_id"), "label")
    return labels.label_metrics(vote(spark, sf, 3), gold)


@query(with_(A.LABELS) + "SELECT label, count(*) AS n FROM issue_labels WHERE NOT starts_with(label, '*') AND label NOT IN ('info-needed', 'triage-needed', 'verified') GROUP BY label")
def content_labels(spark, sf):
    return A.issue_labels(spark, sf).where(labels.is_content(F.col("label"))).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# ---- training data

@query(with_(A.ISSUES, A.TEXTS, A.TEXT_PAIRS) + "SELECT duplicate, canonical, md5(a.text) AS a_md5, md5(p.text) AS p_md5 FROM text_pairs JOIN texts a ON a.id = duplicate JOIN texts p ON p.id = canonical WHERE length(a.text) >= 20 AND length(p.text) >= 20")
def training_pairs(spark, sf):
    out = mining.training_pairs(A.text_pairs(spark, sf), A.texts(spark, sf).select("id", "text"))
    return out.select("duplicate", "canonical", F.md5("a").alias("a_md5"), F.md5("p").alias("p_md5"))


@query(with_(A.ISSUES, A.TEXTS, A.VECTORS, A.QUERIES, A.PAIRS, "anchors AS (SELECT duplicate, canonical, a.text AS a, p.text AS p FROM pairs JOIN texts a ON a.id = duplicate JOIN texts p ON p.id = canonical WHERE length(a.text) >= 20 AND length(p.text) >= 20)",
    f"hits AS ({dense(61)})", "pool AS (SELECT query_id FROM hits GROUP BY query_id HAVING max(rank) > 60)",
    "forbidden AS (SELECT x.duplicate, y.duplicate AS negative FROM pairs x JOIN pairs y USING (canonical) UNION SELECT duplicate, canonical FROM pairs)")
    + """SELECT duplicate, canonical, negative, place FROM (SELECT duplicate, canonical, candidate_id AS negative, row_number() OVER (PARTITION BY duplicate, canonical ORDER BY rank) AS place
    FROM hits JOIN anchors ON duplicate = query_id JOIN texts n ON n.id = candidate_id WHERE query_id IN (SELECT query_id FROM pool) AND rank BETWEEN 6 AND 60 AND candidate_id <> query_id
    AND (query_id, candidate_id) NOT IN (SELECT duplicate, negative FROM forbidden) AND length(n.text) >= 20 AND n.text <> a AND n.text <> p) WHERE place <= 3""")  # fmt: skip
def hard_negatives(spark, sf):
    truth = stored(A.vector_pairs(spark, sf), "truth")
    return mining.hard_negatives(truth, truth, A.vectors(spark, sf), A.texts(spark, sf).select("id", "text"))


@query("WITH neg AS (" + SQL["hard_negatives"] + "), " + ", ".join((A.ISSUES, A.TEXTS)) + " SELECT duplicate, canonical, negative, place, md5(a.text || chr(10) || p.text || chr(10) || n.text) AS texts_md5 FROM neg JOIN texts a ON a.id = duplicate JOIN texts p ON p.id = canonical JOIN texts n ON n.id = negative")
def triplets(spark, sf):
    out = mining.triplets(hard_negatives(spark, sf), A.texts(spark, sf).select("id", "text"))
    return out.select("duplicate", "canonical", "negative", "place", F.md5(F.concat_ws("\n", "a", "p", "n")).alias("texts_md5"))


@query(with_(A.ISSUES, A.TEXTS, A.VECTORS, A.QUERIES, f"hits AS ({dense(50)})") + "SELECT t.id AS q, substr(t.text, 1, 500) AS qt, coalesce(array_to_string(list(candidate_id ORDER BY rank) FILTER (candidate_id IS NOT NULL), ','), '') AS c FROM texts t JOIN queries q ON q.query_id = t.id LEFT JOIN hits h ON h.query_id = t.id GROUP BY t.id, t.text")
def rerank_task(spark, sf):
    asked = A.vector_queries(spark, sf)
    hits = retrieve.dense_topk(asked, A.vectors(spark, sf), 50)
    texts = A.texts(spark, sf).select(F.col("id").alias("query_id"), F.substring("text", 1, 500).alias("text")).join(asked.select("query_id"), "query_id", "left_semi")
    return mining.rerank_task(hits, texts).select("q", "qt", F.array_join(F.col("c").cast("array<string>"), ",").alias("c"))


@query(with_(A.ISSUES, A.TEXTS, A.VECTORS, A.QUERIES, f"hits AS ({dense(50)})") + "SELECT id, md5(text) AS text_md5 FROM texts WHERE id IN (SELECT candidate_id FROM hits)")
def rerank_task_texts(spark, sf):
    hits = retrieve.dense_topk(A.vector_queries(spark, sf), A.vectors(spark, sf), 50)
    return mining.task_texts(hits, A.texts(spark, sf).select("id", "text")).select("id", F.md5("text").alias("text_md5"))


@query(with_(A.TEXT_PAIRS) + "SELECT duplicate, canonical, row_number() OVER (ORDER BY md5(duplicate || ':' || canonical || ':0'), duplicate, canonical) <= 20 AS held_out FROM text_pairs")
def hold_out(spark, sf):
    return mining.hold_out(A.text_pairs(spark, sf), 20)


# ---- text

@query("""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<details>.*?</details>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13))) AS cleaned_md5 FROM pages""")
def text_clean(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", F.md5(T.strip_boilerplate(F.col("html"))).alias("cleaned_md5"))


@query(with_(A.ISSUES) + f"SELECT number, md5(substr({A.COMPOSED}, 1, 8000)) AS text_md5, length(substr({A.COMPOSED}, 1, 2000)) AS n FROM issues")
def text_compose(spark, sf):
    return A.issues(spark, sf).select("number", F.md5(T.issue_text(F.col("title"), F.col("body"))).alias("text_md5"), F.length(T.issue_text(F.col("title"), F.col("body"), 2000)).alias("n"))


_CLEAN = A.COMPOSED.replace("regexp_replace(body,", "regexp_replace(regexp_replace(body, '\\n{3,}', chr(10) || chr(10), 'g'),")


@query(with_(A.ISSUES) + f"SELECT number, regexp_replace(substr(substr({_CLEAN}, 1, 600), length(title) + 1), '^\\s+|\\s+$', '', 'g') AS snippet FROM issues")
def snippet(spark, sf):
    return A.issues(spark, sf).select("number", T.snippet(F.col("title"), F.col("body")).alias("snippet"))


TOKENS = " UNION ALL ".join(f"SELECT '{n}' AS tokenizer, id, len({t}) AS n, md5(array_to_string({t}, ' ')) AS tokens_md5 FROM texts" for n, t in (("atomic", ATOMIC), ("both", BOTH), ("words", WORDS)))


@query(with_(A.ISSUES, A.TEXTS) + TOKENS)
def tokenizers(spark, sf):
    docs = A.texts(spark, sf)
    per = [F.struct(F.lit(n).alias("tokenizer"), f(F.col("text")).alias("t")) for n, f in sorted(T.TOKENIZERS.items())]
    return docs.select("id", F.explode(F.array(*per)).alias("x")).select("x.tokenizer", "id", F.size("x.t").alias("n"), F.md5(F.array_join("x.t", " ")).alias("tokens_md5"))


# ---- upserts, profile, export

LATEST = "SELECT user_id, event_id, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"


@query(LATEST)
def upsert_latest(spark, sf):
    return tracker.latest(A.table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "ts", "event_type", "value")


@query("""WITH a AS (SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type <> 'purchase') WHERE r = 1),
    b AS (SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'purchase') WHERE r = 1)
    SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_id, b.event_id) AS event_id, CASE WHEN a.ts IS NULL OR b.ts >= a.ts THEN b.ts ELSE a.ts END AS ts, CASE WHEN a.ts IS NULL OR b.ts >= a.ts THEN b.event_type ELSE a.event_type END AS event_type FROM a FULL JOIN b ON a.user_id = b.user_id""")
def upsert_keeping(spark, sf):
    """A second batch updates users but keeps the event_id first stored, as created_at is kept."""
    events = A.table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    one = lambda df: tracker.latest(df, ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return tracker.upsert(one(events.where("event_type <> 'purchase'")), one(events.where("event_type = 'purchase'")), "user_id", "ts", kept=("event_id",))


@query(with_(A.LABELS) + "SELECT issue_number, label FROM issue_labels WHERE issue_number % 10 <> 0 UNION ALL SELECT DISTINCT doc_id, 'fresh-' || lang FROM documents WHERE doc_id % 20 = 0")
def replace_labels(spark, sf):
    d = A.table(spark, sf, "documents")
    touched = d.where("doc_id % 10 = 0").select(F.col("doc_id").alias("issue_number"))
    fresh = d.where("doc_id % 20 = 0").select(F.col("doc_id").alias("issue_number"), F.concat(F.lit("fresh-"), "lang").alias("label"))
    return tracker.replace_labels(A.issue_labels(spark, sf), touched, fresh)


@query(LATEST)
def stream_upsert(spark, sf):
    at = new_path(spark, "stream")
    schema = A.table(spark, sf, "events").schema
    table = ingest.VersionedTable(spark, f"{at}/events", schema)
    order = [F.desc("ts"), F.desc("event_id")]
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf}/events.parquet*")
    ingest.stream_upsert(source, table, lambda old, new: tracker.latest(old.unionByName(new), ["user_id"], order), f"{at}/checkpoint")
    return table.read().select("user_id", "event_id", "ts", "event_type", "value")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus")
def state_counts(spark, sf):
    return profile.state_counts(A.table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "status"), "status")


@query("SELECT count(*) AS n_rows, count(*) FILTER (l_orderkey IS NULL) AS null_keys, min(l_shipdate) AS least, max(l_shipdate) AS most, (SELECT count(*) FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)) AS orphans FROM lineitem")
def integrity_checks(spark, sf):
    return profile.integrity(A.table(spark, sf, "lineitem"), A.table(spark, sf, "orders"), "l_orderkey", "o_orderkey", "l_shipdate")


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_vectors(spark, sf):
    return profile.missing(A.table(spark, sf, "documents").select(F.col("doc_id").alias("id")), A.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")))


@query(with_(A.ISSUES) + f"SELECT number AS n, substr({A.COMPOSED}, 1, 2000) AS t FROM issues WHERE number NOT IN (SELECT vec_id FROM embeddings) AND length({A.COMPOSED}) > 0")
def text_export(spark, sf):
    return tracker.text_export(A.issues(spark, sf), A.vectors(spark, sf))


@query("SELECT round(avg(length(html)), 4) AS mean_before, quantile_cont(length(html), 0.5) AS median_before, sum(length(html))::BIGINT AS total_before, round(avg(length(a)), 4) AS mean_after, quantile_cont(length(a), 0.5) AS median_after, sum(length(a))::BIGINT AS total_after, round(100 * avg((a = html)::INT), 4) AS percent_unchanged FROM (SELECT html, regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g') AS a FROM pages)")
def text_volume(spark, sf):
    return profile.volume(A.table(spark, sf, "pages"), F.col("html"), F.regexp_replace("html", "(?is)<script.*?</script>", " "))


@query("SELECT count(*) AS n, " + ", ".join(f"round(avg(regexp_matches(text, '{p}')::INT), 6) AS {name}" for name, p in profile.SIGNALS) + " FROM documents")
def text_signals(spark, sf):
    return profile.signals(A.table(spark, sf, "documents"))


@query(with_(A.TEXT_PAIRS) + "SELECT a.source AS label, count(*) AS n, count(*) FILTER (a.source = b.source) AS same FROM text_pairs JOIN documents a ON a.doc_id = duplicate JOIN documents b ON b.doc_id = canonical GROUP BY a.source")
def label_agreement(spark, sf):
    return profile.agreement(A.text_pairs(spark, sf), A.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("label")))


@query("SELECT count(*) AS n, count(*) FILTER (c > 3) AS truncated FROM (SELECT conv_id, count(*) AS c FROM conversations GROUP BY conv_id)")
def thread_truncation(spark, sf):
    threads = A.table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("comment_count"))
    return profile.truncated(threads.withColumn("comments_fetched", F.least(F.col("comment_count"), F.lit(3))))


@query(with_(A.VECTORS, A.TITLES, "s AS (SELECT round(list_dot_product(v.vec, t.vec), 6) AS s FROM vectors v JOIN titles t ON t.id = v.id)") + "SELECT count(s) AS n, round(avg(s), 6) AS mean, min(s) AS least, max(s) AS most FROM s")
def model_cosine(spark, sf):
    return profile.model_cosine(A.vectors(spark, sf).select("id", "vec"), A.titles(spark, sf))


@query("SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1")
def yearly_counts(spark, sf):
    return profile.per_year(A.table(spark, sf, "orders"), "o_orderdate")


@query(with_(A.ISSUES, A.LABELS) + f"SELECT number, title, regexp_replace(substr(substr({_CLEAN}, 1, 600), length(title) + 1), '^\\s+|\\s+$', '', 'g') AS snippet, state, state_reason, url, coalesce(string_agg(label, ',' ORDER BY label), '') AS labels, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM issues LEFT JOIN (SELECT DISTINCT * FROM issue_labels) ON issue_number = number GROUP BY ALL")
def export_bundle(spark, sf):
    return tracker.serving(A.issues(spark, sf), A.issue_labels(spark, sf))


@query(with_(A.ISSUES) + "SELECT count(*) AS issues, strftime(min(created_at), '%Y-%m-%d') AS first, strftime(max(created_at), '%Y-%m-%d') AS last FROM issues WHERE number IN (SELECT vec_id FROM embeddings)")
def export_manifest(spark, sf):
    issues = A.issues(spark, sf).join(A.vectors(spark, sf).select(F.col("id").alias("number")), "number", "left_semi")
    return tracker.manifest(issues, {})


@query(with_(A.ISSUES) + "SELECT number, title, substr(body, 1, 2000) AS body, strftime(created_at, '%Y-%m-%d') AS created, NULL::VARCHAR AS error FROM issues WHERE number = 7 UNION ALL SELECT -1, NULL, NULL, NULL, 'issue -1 not found'")
def fetch_issue(spark, sf):
    issues = A.issues(spark, sf)
    return tracker.fetch_issue(issues, 7).unionByName(tracker.fetch_issue(issues, -1))


@query("SELECT doc_id AS number, 'c' || doc_id AS title, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at, 25 AS comment_count, 20 AS comments_fetched, 20 AS comments, 6 AS least_comment, 2 AS labels FROM documents")
def flatten_nodes(spark, sf):
    """Nested nodes, cut as an API call cuts them, and taken apart into the three tables."""
    d = A.table(spark, sf, "documents")
    iso = F.concat(F.date_format(A.minutes("doc_id"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    comment = lambda i: F.struct((F.col("doc_id") * 100 + i).alias("databaseId"), F.struct(F.lit("a").alias("login")).alias("author"), F.lit("b").alias("body"), iso.alias("createdAt"))
    nodes = d.select(F.col("doc_id").alias("number"), F.concat(F.lit("c"), F.col("doc_id"), F.lit("\0")).alias("title"), F.lit(None).cast("string").alias("body"), F.lit("OPEN").alias("state"), F.lit(None).cast("string").alias("stateReason"), F.lit("u").alias("url"),
        iso.alias("createdAt"), iso.alias("updatedAt"), F.lit(None).cast("string").alias("closedAt"), F.struct(F.lit("a").alias("login")).alias("author"),
        F.struct(F.array(F.struct(F.lit("x").alias("name")), F.struct(F.col("lang").alias("name"))).alias("nodes")).alias("labels"),
        F.struct(F.lit(25).alias("totalCount"), F.transform(F.sequence(F.lit(1), F.lit(25)), comment).alias("nodes")).alias("comments"))
    cut = tracker.fetched(nodes)
    c = tracker.comments_from(cut).groupBy("issue_number").agg(F.count(F.lit(1)).alias("comments"), F.min(F.col("id") % 100).alias("least_comment"))
    n = tracker.labels_from(cut).groupBy("issue_number").agg(F.count(F.lit(1)).alias("labels"))
    out = tracker.issues_from(cut).join(c.withColumnRenamed("issue_number", "number"), "number").join(n.withColumnRenamed("issue_number", "number"), "number")
    return out.select("number", "title", "created_at", "comment_count", "comments_fetched", "comments", "least_comment", "labels")
