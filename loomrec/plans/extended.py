"""Further registered queries: ingest rules, content-based recall, diagnostics, delivery and commerce state."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomrec.operators import candidates as C
from loomrec.operators import evaluation as E
from loomrec.operators import events as V
from loomrec.operators import ingest as G
from loomrec.operators import ranking as R
from loomrec.operators import recall as B
from loomrec.operators import retrieval as T
from loomrec.operators import semantic as M
from loomrec.operators.tables import once
from loomrec.operators import workflow as X
from loomrec.plans import queries as Q
from loomrec.plans.queries import CFREC, PARTS, SEEDS, TOK, query
from loomrec.sources import star as S

# ingest


@query("conflict_merge", """SELECT item_id, min_by(title, ord) FILTER (trim(title) <> '') title, min_by(brand, ord) FILTER (trim(brand) <> '') brand, array_to_string(list_sort(list(DISTINCT src)), ',') sources, count(*) n_rows FROM (
SELECT p_partkey item_id, CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_name END title, p_brand brand, 'a' src, 1 ord FROM part UNION ALL SELECT p_partkey, p_name || ' (2)', p_type, 'b', 2 FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, p_name || ' (3)', NULL, 'c', 3 FROM part WHERE p_partkey % 9 = 0) GROUP BY 1""")
def conflict_merge(s, d):
    i = S.items(s, d)
    one = lambda df, title, brand, src, n: df.select("item_id", title.alias("title"), brand.alias("brand"), F.array(F.lit(src)).alias("sources"), F.lit(n).alias("ord"))
    rows = one(i, F.when(F.col("item_id") % 3 == 0, " ").otherwise(F.col("title")), F.col("brand"), "a", 1)
    rows = rows.unionByName(one(i.filter("item_id % 2 = 0"), F.concat("title", F.lit(" (2)")), F.col("category"), "b", 2))
    rows = rows.unionByName(one(i.filter("item_id % 9 = 0"), F.concat("title", F.lit(" (3)")), F.lit(None).cast("string"), "c", 3))
    return G.merge_conflicts(rows, "item_id", "ord", ["title", "brand"], ["sources"]).withColumn("sources", F.array_join("sources", ","))


@query("interaction_ingest_cap", "$BASE SELECT category, user_id, item_id, ts, line FROM (SELECT category, user_id, item_id, ts, row_number() OVER (PARTITION BY category ORDER BY ts, ord) AS line FROM raw JOIN items USING (item_id) WHERE ts >= 788918400000) WHERE line <= 100")
def interaction_ingest_cap(s, d):
    j = S.raw_interactions(s, d).join(S.items(s, d).select("item_id", "category"), "item_id")
    return G.ingest(j, "category", 788918400000, 100).select("category", "user_id", "item_id", "ts", "line")


@query("universe_import", "$BASE SELECT (SELECT count(*) FROM raw WHERE item_id IN (SELECT item_id FROM pos)) by_item, (SELECT count(*) FROM raw SEMI JOIN pos USING (user_id, item_id, ts)) by_key")
def universe_import(s, d):
    raw, pos = S.raw_interactions(s, d), S.train_positives(s, d)
    n = lambda keys, name: G.in_universe(raw, pos, keys).agg(F.count("*").alias(name))
    return n(["item_id"], "by_item").crossJoin(n(["user_id", "item_id", "ts"], "by_key"))  # one row each


@query("row_keys_and_shards", "$BASE SELECT md5(concat_ws('|', user_id, item_id, ts)) row_key, CAST(('0x' || md5(CAST(user_id AS VARCHAR))[1:8]) AS BIGINT) % 16 shard FROM ex")
def row_keys_and_shards(s, d):
    raw = S.raw_interactions(s, d).dropDuplicates(["user_id", "item_id", "ts"])
    return raw.select(G.row_key("user_id", "item_id", "ts").alias("row_key"), G.stable_shard(F.col("user_id"), 16).alias("shard"))


@query("candidate_import_plan", f"""$BASE, {PARTS}, f AS (SELECT user_id, item_id, source, score, CAST(source <> 'popular' AS INT) accepted FROM parts) SELECT user_id, item_id, source, score, CASE WHEN accepted = 1 THEN row_number() OVER (PARTITION BY user_id, source, accepted ORDER BY score DESC, item_id) END AS rank, accepted FROM f""")
def candidate_import_plan(s, d):
    return G.import_plan(G.reject_fields(_scored(s, d), ["label", "is_positive", "target"]), {"itemcf", "category"})


@query("window_catalog", "$BASE SELECT item_id, max(CAST(split = 'train' AS INT)) in_train, count(DISTINCT split) n_windows, 1 - max(CAST(split = 'train' AS INT)) only_later FROM inter GROUP BY 1")
def window_catalog(s, d):
    return G.window_catalog(S.interactions(s, d))


@query("family_sample")
def family_sample(s, d):
    return G.family_sample(S.items(s, d), 5, 50)


@query("label_coverage", f"$BASE, {CFREC} SELECT count(*) positives, count(c.user_id) covered, count(DISTINCT h.user_id) users, count(DISTINCT c.user_id) covered_users FROM (SELECT DISTINCT * FROM held) h LEFT JOIN cfrec c USING (user_id, item_id)")
def label_coverage(s, d):
    c = Q._cf_recall(s, d).select("user_id", "item_id", F.col("user_id").alias("found"))
    j = Q._held(s, d).distinct().join(c, ["user_id", "item_id"], "left")
    return j.agg(F.count("*").alias("positives"), F.count("found").alias("covered"), F.countDistinct("user_id").alias("users"), F.countDistinct("found").alias("covered_users"))


# content-based recall

HASHED = f"""hx AS (SELECT item_id AS key, unnest({TOK.format(c='title')}) t FROM items), hn AS (SELECT key, t, count(*) n FROM hx GROUP BY ALL),
hv AS (SELECT key, CAST(('0x' || md5(t)[1:8]) AS BIGINT) % 64 dim, sum(n * CASE WHEN CAST(('0x' || md5(t)[9:9]) AS BIGINT) < 8 THEN 1 ELSE -1 END) v FROM hn GROUP BY ALL HAVING v <> 0), hw AS (SELECT key, dim, v / sqrt(sum(v * v) OVER (PARTITION BY key)) w FROM hv)"""


@query("hashed_item_vectors", f"$BASE, {HASHED} SELECT key, dim, round(w, 6) w FROM hw")
def hashed_item_vectors(s, d):
    return M.hashed_vectors(S.items(s, d), "item_id", "title").withColumn("w", F.round("w", 6))


@query("sparse_cosine_neighbours", f"$BASE, {HASHED} SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM (SELECT a.key query, b.key, round(sum(a.w * b.w), 6) score FROM hw a JOIN hw b USING (dim) GROUP BY ALL) WHERE score > 0 QUALIFY rank <= 10")
def sparse_cosine_neighbours(s, d):
    v = M.hashed_vectors(S.items(s, d), "item_id", "title")
    return M.sparse_cosine(v, v, 10)


@query("field_lengths", f"$BASE SELECT count(*) n_items, round(avg(len({TOK.format(c='title')})), 6) avg_title, round(avg(len({TOK.format(c='category')})), 6) avg_category FROM items")
def field_lengths(s, d):
    return M.field_lengths(S.items(s, d), ["title", "category"])


def _field(name, weight):
    return f"SELECT item_id, token, {weight} * count(*) / (0.25 + 0.75 * any_value(l) / (SELECT avg(len({TOK.format(c=name)})) FROM items)) wtf FROM (SELECT item_id, len({TOK.format(c=name)}) l, unnest({TOK.format(c=name)}) token FROM items) GROUP BY item_id, token"


@query("bm25f_recall", f"""$BASE, bq AS (SELECT DISTINCT item_id query, unnest({TOK.format(c="title || ' ' || category")}) token FROM items), bp AS (SELECT item_id, token, sum(wtf) wtf FROM ({_field('title', 2.0)} UNION ALL {_field('category', 1.0)}) GROUP BY ALL), bd AS (SELECT token, count(*) df FROM bp GROUP BY 1)
SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item_id) AS rank FROM (SELECT query, item_id, round(sum(ln(1 + ((SELECT count(*) FROM items) - df + 0.5) / (df + 0.5)) * wtf / (1.2 + wtf)), 6) score FROM bp JOIN bd USING (token) JOIN bq USING (token) GROUP BY ALL) QUALIFY rank <= 10""")
def bm25f_recall(s, d):
    i = S.items(s, d)
    q = i.select(F.col("item_id").alias("query"), F.explode(F.array_distinct(T.all_tokens(F.concat_ws(" ", "title", "category")))).alias("token"))
    return M.bm25f(i, q, {"title": 2.0, "category": 1.0}, 10)


IDF = """tk AS (SELECT item_id, category, unnest(list_distinct(list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda t: length(t) >= 2))) token FROM items), ti AS (SELECT token, ln(((SELECT count(*) FROM items) + 1.0) / (count(*) + 1)) idf FROM tk GROUP BY 1),
tp AS (SELECT * FROM tk JOIN ti USING (token)), ov AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, item_id) AS rank FROM (SELECT a.item_id seed, b.item_id, round(avg(b.idf) + 0.5 * max(CAST(a.category = b.category AS INT)), 6) score FROM tp a JOIN tp b USING (token) WHERE a.item_id <> b.item_id AND a.item_id IN (SELECT item_id FROM seeds) GROUP BY ALL) QUALIFY rank <= 20)"""


def _idf(s, d):
    return M.idf_overlap(C.seeds(S.recent_positives(s, d)), S.items(s, d), 20)


@query("idf_overlap_recall", f"$BASE, {SEEDS}, {IDF} SELECT * FROM ov")
def idf_overlap_recall(s, d):
    return _idf(s, d)


@query("title_expansion_best_seed", f"$BASE, {SEEDS}, {IDF} SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (SELECT user_id, o.item_id, o.seed, o.score FROM seeds s JOIN ov o ON o.seed = s.item_id QUALIFY row_number() OVER (PARTITION BY user_id, o.item_id ORDER BY o.score DESC, seed_rank) = 1) QUALIFY rank <= 20")
def title_expansion_best_seed(s, d):
    return M.best_seed(_idf(s, d), C.seeds(S.recent_positives(s, d)), 20)


@query("metadata_neighbours", """$BASE, mb AS (SELECT item_id, coalesce(pop, 0) pop, unnest([{'b': 'b:' || brand, 'w': 1.0}, {'b': 'c:' || category, 'w': 0.5}]) x FROM items LEFT JOIN pop USING (item_id)), mh AS (SELECT item_id, pop, x.b b, x.w w FROM mb QUALIFY row_number() OVER (PARTITION BY x.b ORDER BY pop DESC, item_id) <= 10)
SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM (SELECT m.item_id src, h.item_id dst, round(sum(h.w) + ln(1 + max(h.pop)) / 100, 6) score FROM mb m JOIN mh h ON m.x.b = h.b WHERE m.item_id <> h.item_id GROUP BY ALL) QUALIFY rank <= 10""")
def metadata_neighbours(s, d):
    return M.metadata_neighbours(S.items(s, d), Q._pop(s, d), 10, 10)


@query("user_mean_vectors", f"""$BASE, {SEEDS}, vd AS (SELECT vec_id + 1 item_id, unnest(range(len(embedding))) dim, unnest(embedding) x FROM embeddings), mv AS (SELECT user_id, dim, sum(pow(0.8, seed_rank - 1) * x) / sum(pow(0.8, seed_rank - 1)) m FROM seeds JOIN vd USING (item_id) GROUP BY ALL)
SELECT user_id, dim, round(m / sqrt(n), 6) value FROM (SELECT *, sum(m * m) OVER (PARTITION BY user_id) n FROM mv) WHERE n > 0""")
def user_mean_vectors(s, d):
    v = S.table(s, d, "embeddings").select((F.col("vec_id") + 1).alias("item_id"), F.col("embedding").alias("vector"))
    return M.mean_vectors(C.seeds(S.recent_positives(s, d)), v)


@query("two_tower_rows", "$BASE, f AS (SELECT item_id FROM train GROUP BY 1 HAVING count(*) >= 3) SELECT user_id, item_id target, pos - 1 n_history FROM seq WHERE pos >= 2 AND item_id IN (SELECT item_id FROM f)")
def two_tower_rows(s, d):
    vocab = B.vocabulary(Q._train(s, d), 3).select("item_id")
    return S.recent_positives(s, d).filter("pos >= 2").join(vocab, "item_id", "left_semi").select("user_id", F.col("item_id").alias("target"), (F.col("pos") - 1).alias("n_history"))


@query("weighted_walks")
def weighted_walks(s, d):
    return M.weighted_walks(B.item_graph(S.recent_positives(s, d)), 4).select("start", "walk", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


@query("underfill_repair", f"""$BASE, {PARTS}, have AS (SELECT user_id, item_id, rank, 0 step FROM parts WHERE source = 'itemcf' AND rank <= 10), extra AS (SELECT user_id, item_id, rank, 1 step FROM parts WHERE source = 'popular' AND (user_id, item_id) NOT IN (SELECT user_id, item_id FROM have))
SELECT user_id, item_id, step, rank ord, row_number() OVER (PARTITION BY user_id ORDER BY step, rank, item_id) AS slot FROM (FROM have UNION ALL FROM extra) QUALIFY slot <= 15""")
def underfill_repair(s, d):
    return C.fill_ladder([Q._cf_recall(s, d).filter("rank <= 10"), Q._popular(s, d)], 15)


@query("catalog_discovery", "$BASE, c AS (SELECT category, row_number() OVER (ORDER BY md5(category || ':7')) cat FROM (SELECT DISTINCT category FROM items)) SELECT category, item_id, r, row_number() OVER (ORDER BY r, cat) AS slot FROM (SELECT i.category, item_id, cat, row_number() OVER (PARTITION BY i.category ORDER BY item_id) r FROM items i JOIN c USING (category)) WHERE r BETWEEN 2 AND 4 QUALIFY slot <= 60")
def catalog_discovery(s, d):
    return C.discovery(S.items(s, d), seed=7, offset=1, per_category=3, n=60)


# ranking and diagnostics


def _scored(s, d):
    long = None
    for name, df in Q._parts(s, d).items():
        p = df.select("user_id", "item_id", F.col("score"), "rank", F.lit(name).alias("source"))
        long = p if long is None else long.unionByName(p)
    return long


@query("movement_guard", f"$BASE, {PARTS} SELECT user_id, item_id, movement, deferred, row_number() OVER (PARTITION BY user_id ORDER BY deferred, final_rank) AS slot FROM (SELECT *, CAST(abs(movement) > 2 AS INT) deferred FROM ranked) QUALIFY slot <= 10")
def movement_guard(s, d):
    return R.movement_guard(Q._ranked(s, d), 2, 10)


@query("model_semantic_blend", f"$BASE, {PARTS} SELECT user_id, item_id, round(0.3 * coalesce(max(score) FILTER (source = 'itemcf'), 0) + 0.7 * coalesce(max(score) FILTER (source = 'category'), 0) + 3.7e-10, 6) score FROM parts WHERE source <> 'popular' GROUP BY ALL")
def model_semantic_blend(s, d):
    p = Q._parts(s, d)
    return R.blended(p["itemcf"], p["category"])


@query("deep_fm_scores", f"$BASE, {PARTS}, x AS (SELECT user_id, item_id, coarse a, CAST(n_sources AS DOUBLE) b, 1.0 / coarse_rank c FROM coarse WHERE coarse_rank <= 20) SELECT user_id, item_id, round(0.1 + (0.5 * a + 0.2 * b + 0.3 * c) + (a * b * (0.1 * 0.2 + 0.3 * -0.1) + a * c * (0.1 * 0.4 + 0.3 * 0.2) + b * c * (0.2 * 0.4 + -0.1 * 0.2)) + (0.6 * greatest(0.0, 0.5 * a - 0.4 * b + 0.1 * c) - 0.2 * greatest(0.0, -0.3 * a + 0.2 * b + 0.5 * c)) + 3.7e-10, 6) score FROM x")
def deep_fm_scores(s, d):
    x = Q._coarse(s, d).filter("coarse_rank <= 20").select("user_id", "item_id", F.col("coarse").alias("a"), F.col("n_sources").cast("double").alias("b"), (1.0 / F.col("coarse_rank")).alias("c"))
    out = R.deep_fm(x, ["a", "b", "c"], [0.5, 0.2, 0.3], [[0.1, 0.3], [0.2, -0.1], [0.4, 0.2]], [[0.5, -0.4, 0.1], [-0.3, 0.2, 0.5]], [0.6, -0.2], 0.1)
    return out.select("user_id", "item_id", "score")


@query("pointwise_logistic")
def pointwise_logistic(s, d):
    truth = Q._held(s, d).distinct().withColumn("label", F.lit(1.0))
    rows = Q._coarse(s, d).filter("coarse_rank <= 30").join(truth, ["user_id", "item_id"], "left").na.fill(0.0, ["label"])
    flat = rows.select("label", F.col("coarse").cast("double").alias("coarse"), F.col("n_sources").cast("double").alias("n_sources"))
    rows = once(("labelled-features", d), lambda: flat)  # fitting reads them once for statistics and once for its blocks
    return s.createDataFrame(sorted(R.logistic_weights(rows, ["coarse", "n_sources"], "label").items()), "feature string, weight double")


@query("source_restricted_hits", f"$BASE, {PARTS}, t AS (SELECT user_id, item_id FROM (SELECT user_id, item_id, max(score) score FROM parts WHERE source IN ('itemcf', 'category') GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) <= 10) SELECT count(*) n_users, count(h) hit_users, round(count(h) / count(*), 6) hit_rate FROM (SELECT DISTINCT user_id FROM held) LEFT JOIN (SELECT DISTINCT user_id, 1 h FROM t JOIN held USING (user_id, item_id)) USING (user_id)")
def source_restricted_hits(s, d):
    return E.restricted_hit_rate(_scored(s, d), Q._held(s, d), {"itemcf", "category"}, 10)


@query("candidate_signatures", f"$BASE, {CFREC} SELECT user_id, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY rank)) signature, count(*) n FROM cfrec GROUP BY 1")
def candidate_signatures(s, d):
    return E.list_signature(Q._cf_recall(s, d))


@query("stage_latency", "WITH b AS (SELECT event_type stage, value FROM events UNION ALL SELECT 'total', value FROM events) SELECT stage, n, round(a, 4) average, value p95 FROM (SELECT stage, value, row_number() OVER (PARTITION BY stage ORDER BY value) i, count(*) OVER (PARTITION BY stage) n, avg(value) OVER (PARTITION BY stage) a FROM b) WHERE i - 1 = round_even((n - 1) * 0.95, 0)")
def stage_latency(s, d):
    return E.stage_latency(S.table(s, d, "events"), "event_type", "value")


@query("diagnostic_gate", f"$BASE, {CFREC}, st AS (SELECT CASE WHEN rank <= 10 THEN 'topk' WHEN rank IS NOT NULL THEN 'pool' WHEN e.user_id IS NOT NULL THEN 'raw' ELSE 'miss' END stage FROM (SELECT DISTINCT * FROM held) h LEFT JOIN cfrec c USING (user_id, item_id) LEFT JOIN (SELECT DISTINCT s.user_id, dst item_id FROM seeds s JOIN cf ON src = s.item_id) e ON e.user_id = h.user_id AND e.item_id = h.item_id) SELECT count(*) targets, count(*) FILTER (stage = 'miss') missed, count(*) FILTER (stage = 'topk') on_top, CASE WHEN count(*) FILTER (stage = 'miss') * 2 > count(*) THEN 'recall' WHEN count(*) FILTER (stage IN ('pool', 'raw')) > count(*) FILTER (stage = 'topk') THEN 'ranking' ELSE 'none' END bottleneck FROM st")
def diagnostic_gate(s, d):
    return E.diagnostic_gate(Q.miss_stages(s, d))


@query("marginal_over_baseline", f"$BASE, {PARTS}, x AS (SELECT user_id, item_id FROM parts WHERE source = 'itemcf' AND (user_id, item_id) NOT IN (SELECT user_id, item_id FROM parts WHERE source = 'popular')) SELECT (SELECT count(*) FROM x) extra_rows, count(*) extra_hits, count(DISTINCT user_id) extra_users FROM x SEMI JOIN held USING (user_id, item_id)")
def marginal_over_baseline(s, d):
    p = Q._parts(s, d)
    return E.marginal_over_baseline(p["itemcf"], p["popular"], Q._held(s, d))


@query("shadow_comparison", f"$BASE, {PARTS} SELECT user_id, count(*) n, CAST(count(*) FILTER (coarse_rank > 10) AS BIGINT) n_new, max(CASE WHEN coarse_rank <= 10 THEN abs(final_rank - coarse_rank) END) largest_move FROM ranked WHERE final_rank <= 10 GROUP BY 1")
def shadow_comparison(s, d):
    r = Q._ranked(s, d)
    return E.shadow_comparison(r.withColumn("rank", F.col("final_rank")), r.withColumn("rank", F.col("coarse_rank")))


@query("session_scorecard", "SELECT conv_id, n_turns, n_user, n_assistant, filled, avg_chars, round(least(n_user, n_assistant) - 0.1 * (n_turns - least(n_user, n_assistant)), 6) reward FROM (SELECT conv_id, count(*) n_turns, count(*) FILTER (role = 'user') n_user, count(*) FILTER (role = 'assistant') n_assistant, round(avg(CAST(length(coalesce(text, '')) > 0 AS INT)), 6) filled, round(avg(length(coalesce(text, ''))), 4) avg_chars FROM conversations GROUP BY 1)")
def session_scorecard(s, d):
    return E.session_scorecard(S.table(s, d, "conversations"))


@query("small_to_big", f"{Q.BM25} SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, parent) AS rank FROM (SELECT query, doc % 20 parent, max(score) score, count(*) n_children FROM ({Q.BM25_TOP.format(k=30)}) GROUP BY ALL) QUALIFY rank <= 5")
def small_to_big(s, d):
    posts, q, n, a = Q._posts(s, d)
    return M.small_to_big(T.bm25(posts, q, 30, n, a).select("query", (F.col("doc") % 20).alias("parent"), "score"), 5)


@query("evidence_context_limit", f"""{Q.BM25}, ev AS (SELECT query, doc, rank, coalesce(length(text), 0) length FROM ({Q.BM25_TOP.format(k=10)}) JOIN documents ON doc_id = doc)
SELECT query, doc, rank, least(length, 2000 - before) used FROM (SELECT *, sum(length) OVER (PARTITION BY query ORDER BY rank) - length before FROM ev) WHERE before < 2000""")
def evidence_context_limit(s, d):
    posts, q, n, a = Q._posts(s, d)
    sized = T.bm25(posts, q, 10, n, a).join(S.table(s, d, "documents").select(F.col("doc_id").alias("doc"), F.coalesce(F.length("text"), F.lit(0)).alias("length")), "doc")
    return M.context_limit(sized, 2000).select("query", "doc", "rank", "used")


# delivery and commerce state


@query("version_guard", "WITH st AS (SELECT user_id, max(event_id) version, 'stored' origin FROM events WHERE event_id % 2 = 0 GROUP BY 1), up AS (SELECT user_id, max(event_id) version, 'update' origin FROM events WHERE event_id % 5 = 0 GROUP BY 1) SELECT user_id, CASE WHEN up.version > coalesce(st.version, -1) THEN up.version ELSE st.version END AS version, CASE WHEN up.version > coalesce(st.version, -1) THEN up.origin ELSE st.origin END AS origin, CASE WHEN up.version > coalesce(st.version, -1) THEN 1 ELSE 0 END updated FROM st FULL JOIN up USING (user_id)")
def version_guard(s, d):
    last = lambda cond, name: S.table(s, d, "events").filter(cond).groupBy("user_id").agg(F.max("event_id").alias("version")).withColumn("origin", F.lit(name))
    return X.apply_newer(last("event_id % 2 = 0", "stored"), last("event_id % 5 = 0", "update"), ["user_id"], "version")


@query("current_events_page", "$BASE, l AS (SELECT * FROM fb QUALIFY row_number() OVER (PARTITION BY profile_id, item_id ORDER BY ts DESC, event_id DESC) = 1) SELECT event_id, profile_id, item_id, kind FROM l WHERE event_id > 100 ORDER BY event_id LIMIT 50")
def current_events_page(s, d):
    return X.current_events(S.feedback_events(s, d), ["profile_id", "item_id"], 100, 50).select("event_id", "profile_id", "item_id", "kind")


@query("outbox_backoff", "WITH e AS (SELECT event_id, ts, event_id % 11 attempts, event_type = 'purchase' done FROM events) SELECT event_id, CAST(least(300, pow(2, attempts)) AS BIGINT) wait FROM e WHERE NOT done AND ts + to_seconds(CAST(least(300, pow(2, attempts)) AS BIGINT)) <= (SELECT max(ts) FROM events)")
def outbox_backoff(s, d):
    e = S.feedback_events(s, d).select("event_id", F.col("ts").alias("created"), (F.col("event_id") % 11).alias("attempts"), (F.col("kind") == "LIKE").alias("done"))
    return X.outbox_due(e, Q._now(s, d)).select("event_id", "wait")


@query("lease_due_scan", "SELECT o_orderkey task_id, CASE o_orderstatus WHEN 'O' THEN 'PENDING' ELSE 'PROCESSING' END state FROM orders WHERE (o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1997-01-01') OR (o_orderstatus = 'P' AND o_orderdate + INTERVAL 30 DAY < TIMESTAMP '1997-01-01') ORDER BY o_orderdate, o_orderkey LIMIT 50")
def lease_due_scan(s, d):
    o = S.table(s, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.create_map(F.lit("O"), F.lit("PENDING"), F.lit("P"), F.lit("PROCESSING"))[F.col("o_orderstatus")].alias("state"), F.col("o_orderdate").alias("due"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("lease_until"))
    return X.leases_due(o, F.lit("1997-01-01").cast("timestamp_ntz")).select("task_id", "state")


@query("consumer_dedup", "SELECT l_orderkey message_id, l_suppkey % 5 consumer, min(l_linenumber) delivery, count(*) deliveries FROM lineitem GROUP BY 1, 2")
def consumer_dedup(s, d):
    m = S.table(s, d, "lineitem").select(F.col("l_orderkey").alias("message_id"), (F.col("l_suppkey") % 5).alias("consumer"), F.col("l_linenumber").alias("delivery"))
    return X.consumed_once(m)


@query("order_state_guard", "SELECT o_orderstatus, o_orderpriority, CASE WHEN o_orderstatus = 'O' AND o_orderpriority <> '5-LOW' THEN 'F' ELSE o_orderstatus END state_after, count(*) n FROM orders GROUP BY ALL")
def order_state_guard(s, d):
    wanted = F.when(F.col("o_orderpriority") != "5-LOW", "F")
    return X.guarded_transition(S.table(s, d, "orders"), "o_orderstatus", wanted, "O").groupBy("o_orderstatus", "o_orderpriority", "state_after").agg(F.count("*").alias("n"))


@query("payment_guard", "SELECT o_orderkey order_id, CASE WHEN abs(round(p, 2) - o_totalprice) <= 1000 AND settled = 1 THEN 1 ELSE 0 END accepted FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) p, min(CAST(l_returnflag <> 'R' AS INT)) settled FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def payment_guard(s, d):
    o = S.table(s, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("amount"))
    p = S.table(s, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_extendedprice").alias("amount"), (F.col("l_returnflag") != "R").alias("settled"))
    return X.paid_matches(o, p, 1000.0).select("order_id", "accepted")


@query("pool_balance", "SELECT l_suppkey pool, CAST(sum(l_quantity) AS BIGINT) total, CAST(sum(CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS BIGINT) available, CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) returned, CAST(sum(CASE WHEN NOT (l_linestatus = 'O' AND l_returnflag = 'N') AND l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS BIGINT) sold, 1 balanced FROM lineitem GROUP BY 1")
def pool_balance(s, d):
    state = F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N"), "available").when(F.col("l_returnflag") == "R", "returned").otherwise("sold")
    log = S.table(s, d, "lineitem").select(F.col("l_suppkey").alias("pool"), F.col("l_quantity").cast("long").alias("qty"), state.alias("state"))
    return X.pool_balance(log).drop("reserved")


@query("coupon_eligibility", "SELECT o_orderpriority, count(*) n, round(sum(o_totalprice), 2) amount FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' AND o_totalprice >= 100000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def coupon_eligibility(s, d):
    o = S.table(s, d, "orders").select(F.col("o_orderpriority").alias("segment"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("amount"))
    c = s.createDataFrame([(p, 100000.0) for p in ("1-URGENT", "2-HIGH")], "segment string, least double")
    c = c.withColumn("starts", F.lit("1995-01-01").cast("timestamp_ntz")).withColumn("ends", F.lit("1996-01-01").cast("timestamp_ntz"))
    return V.coupon_matches(o, c).groupBy(F.col("segment").alias("o_orderpriority")).agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount"))
