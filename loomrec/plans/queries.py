"""Registered queries: each wires operators to the derived tables, beside the DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrec.operators import candidates as C
from loomrec.operators import cleaning as K
from loomrec.operators import evaluation as E
from loomrec.operators import events as V
from loomrec.operators import ranking as R
from loomrec.operators import recall as B
from loomrec.operators import retrieval as T
from loomrec.operators import vector_join as N
from loomrec.operators.tables import once, shared_tables
from loomrec.sources import star as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

BASE = """
raw AS (SELECT o_custkey user_id, l_partkey item_id, epoch_ms(l_shipdate) ts, 1 + CAST(l_quantity AS BIGINT) % 5 rating,
  l_returnflag = 'N' verified, CAST(l_linenumber AS BIGINT) helpful, l_orderkey * 10 + l_linenumber ord FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ex AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY user_id, item_id, ts ORDER BY ord) = 1),
la AS (SELECT * FROM ex QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, ord DESC) = 1),
ra AS (SELECT *, row_number() OVER (ORDER BY ts, user_id, item_id) row_num, count(*) OVER () n FROM la),
inter AS (SELECT * EXCLUDE (n), CASE WHEN row_num <= n - 2 * greatest(1, n // 10) THEN 'train' WHEN row_num <= n - greatest(1, n // 10) THEN 'valid' ELSE 'test' END split,
  CAST(rating >= 4 AS INT) label_binary, CAST(rating >= 4 AND verified AS INT) label_strong,
  round(round(rating / 5.0, 4) + CASE WHEN verified THEN 0.2 ELSE 0 END + least(helpful, 10) / 50.0, 6) label_strength FROM ra),
train AS (SELECT * FROM inter WHERE split = 'train'),
pos AS (SELECT * FROM train WHERE label_binary = 1),
held AS (SELECT user_id, item_id FROM inter WHERE split <> 'train' AND label_binary = 1),
items AS (SELECT p_partkey item_id, p_name title, p_brand brand, p_type category, list_prepend(p_type, string_split(p_name, ' ')) categories, p_retailprice price FROM part),
pop AS (SELECT item_id, count(*) pop, count(*) FILTER (verified) verified_pop, count(*) FILTER (ts >= CAST(trunc(hi - greatest(1, hi - lo) * 0.2) AS BIGINT)) recent_pop,
  round(sum(0.5 + (ts - lo) / greatest(1, hi - lo)), 6) decay_pop FROM pos, (SELECT min(ts) lo, max(ts) hi FROM pos) GROUP BY item_id),
back AS (SELECT user_id, item_id, row_num, label_strong strong, row_number() OVER (PARTITION BY user_id ORDER BY row_num DESC) b FROM pos),
seq AS (SELECT user_id, item_id, row_num, c - b + 1 pos, c len, strong FROM (SELECT *, count(*) OVER (PARTITION BY user_id) c FROM back WHERE b <= 50)),
fb AS (SELECT event_id, ts, user_id profile_id, CASE event_type WHEN 'view' THEN 'EXPOSURE' WHEN 'click' THEN 'CLICK' WHEN 'purchase' THEN 'LIKE' WHEN 'error' THEN 'DISLIKE' ELSE 'WHY' END kind,
  CAST(props->>'$.k' AS BIGINT) item_id, value FROM events)
"""


def query(name: str, sql: str | None = None):
    def put(f):
        def run(s, d):
            with shared_tables():  # what several parts of a query read is stored once
                return f(s, d)

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql.replace("$BASE", "WITH " + BASE)
        return f

    return put


def _pop(s, d):
    return once(("popularity", d), lambda: B.popularity(S.train_positives(s, d)))


def _train(s, d):
    return S.interactions(s, d).filter("split = 'train'")


def _held(s, d):
    return S.interactions(s, d).filter("split != 'train' and label_binary = 1").select("user_id", "item_id")


# sources and cleaning


@query("interactions_canonical", "$BASE SELECT user_id, item_id, ts, rating, verified, row_num, split, label_binary, label_strong, CAST(label_strength AS DOUBLE) label_strength FROM inter")
def interactions_canonical(s, d):
    return S.interactions(s, d).select("user_id", "item_id", "ts", "rating", "verified", "row_num", "split", "label_binary", "label_strong", F.col("label_strength").cast("double"))


@query("text_length_buckets", "SELECT CASE WHEN n = 0 THEN '0' WHEN n <= 200 THEN '1-200' WHEN n <= 1000 THEN '201-1000' WHEN n <= 5000 THEN '1001-5000' ELSE '5001+' END bucket, count(*) n FROM (SELECT length(trim(coalesce(text, ''))) n FROM documents) GROUP BY 1")
def text_length_buckets(s, d):
    return S.table(s, d, "documents").groupBy(K.length_bucket(F.length(K.clean_text(F.col("text")))).alias("bucket")).agg(F.count("*").alias("n"))


@query("item_text_composition", "$BASE SELECT item_id, concat_ws(chr(10), nullif(trim(title), ''), array_to_string(categories, ' '), nullif(trim(brand), '')) item_text FROM items")
def item_text_composition(s, d):
    return K.item_text(S.items(s, d))


@query("observed_items", "SELECT p_partkey item_id, p_name title FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
def observed_items(s, d):
    seen = S.table(s, d, "lineitem").select(F.col("l_partkey").alias("item_id")).distinct()
    return S.items(s, d).join(seen, "item_id", "left_semi").select("item_id", "title")


@query("exact_dedup_keep_last", "$BASE SELECT (SELECT count(*) FROM raw) raw_rows, (SELECT count(*) FROM ex) exact_rows, (SELECT count(*) FROM la) latest_rows")
def exact_dedup_keep_last(s, d):
    raw = S.raw_interactions(s, d)
    ex = K.exact_dedup(raw)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(raw, "raw_rows").crossJoin(n(ex, "exact_rows")).crossJoin(n(K.keep_last(ex), "latest_rows"))  # one row each


@query("k_core_filter")
def k_core_filter(s, d):
    return K.k_core(K.keep_last(S.raw_interactions(s, d)).select("user_id", "item_id"), 20, 20)


@query("split_summary", "$BASE SELECT coalesce(split, 'all') split, count(*) n_rows, count(DISTINCT user_id) n_users, count(DISTINCT item_id) n_items FROM inter GROUP BY ROLLUP (split)")
def split_summary(s, d):
    return K.split_summary(S.interactions(s, d))


@query("train_readiness", "$BASE SELECT CAST(sum(n) AS BIGINT) positive_rows, count(*) positive_users, count(*) FILTER (d >= 2) ready_users FROM (SELECT user_id, count(*) n, count(DISTINCT item_id) d FROM pos GROUP BY 1)")
def train_readiness(s, d):
    return K.train_readiness(S.interactions(s, d))


@query("calendar_split", "$BASE SELECT split, count(*) n FROM (SELECT CASE WHEN ts < 852076800000 THEN 'train' WHEN ts < 883612800000 THEN 'valid' WHEN ts < 915148800000 THEN 'test' END split FROM raw) WHERE split IS NOT NULL GROUP BY 1")
def calendar_split(s, d):
    split = K.calendar_split(F.col("ts"), 852076800000, 883612800000, 915148800000)
    return S.raw_interactions(s, d).select(split.alias("split")).filter("split is not null").groupBy("split").agg(F.count("*").alias("n"))


@query("window_coverage_bitmap", "$BASE SELECT bits, count(*) n_users FROM (SELECT user_id, bit_or(CASE split WHEN 'train' THEN 1 WHEN 'valid' THEN 2 ELSE 4 END) bits FROM inter GROUP BY 1) GROUP BY 1")
def window_coverage_bitmap(s, d):
    return K.coverage_bits(S.interactions(s, d), "user_id").groupBy("bits").agg(F.count("*").alias("n_users"))


@query("user_sequences", "$BASE SELECT user_id, count(*) sequence_len, count(*) FILTER (label_binary = 1) positive_len, count(*) FILTER (label_strong = 1) strong_len, array_to_string(list(item_id ORDER BY row_num)[-50:], ',') recent_items, coalesce(array_to_string((list(item_id ORDER BY row_num) FILTER (label_binary = 1))[-50:], ','), '') recent_positive_items FROM inter GROUP BY 1")
def user_sequences(s, d):
    q = K.user_sequences(S.interactions(s, d))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return q.select("user_id", "sequence_len", "positive_len", "strong_len", text("recent_items"), text("recent_positive_items"))


@query("leave_one_positive_out", "$BASE SELECT user_id, max_by(item_id, row_num) held_out, count(*) - 1 rest_positive FROM inter WHERE label_binary = 1 GROUP BY 1 HAVING count(*) >= 2")
def leave_one_positive_out(s, d):
    out = K.leave_one_out(K.user_sequences(S.interactions(s, d), 100_000))
    n = K.user_sequences(S.interactions(s, d), 100_000).select("user_id", (F.col("positive_len") - 1).alias("rest_positive"))
    return out.join(n, "user_id").select("user_id", "held_out", "rest_positive")


@query("modal_category", "$BASE SELECT user_id, category modal_category FROM (SELECT user_id, category, count(*) c FROM train JOIN items USING (item_id) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY c DESC, category) = 1")
def modal_category(s, d):
    return K.modal_value(_train(s, d).join(S.items(s, d).select("item_id", "category"), "item_id"), "user_id", "category")


@query("item_quality", """$BASE SELECT item_id, category, events, positives, positive_users, row_number() OVER (ORDER BY positives DESC, item_id) global_rank, row_number() OVER (PARTITION BY category ORDER BY positives DESC, item_id) category_rank,
CASE WHEN positives = 0 THEN 'none' WHEN positives < 5 THEN 'long_tail' WHEN positives < 15 THEN 'mid' ELSE 'hot' END hotness, CASE WHEN length(title) = 0 THEN 'no_text' WHEN positive_users >= 10 THEN 'strong' WHEN positive_users >= 3 THEN 'usable' WHEN positives > 0 THEN 'sparse' ELSE 'cold' END quality
FROM (SELECT i.item_id, i.category, i.title, count(t.item_id) events, count(*) FILTER (label_binary = 1) positives, count(DISTINCT user_id) FILTER (label_binary = 1) positive_users FROM items i LEFT JOIN train t USING (item_id) GROUP BY ALL)""")
def item_quality(s, d):
    return K.item_quality(_train(s, d), S.items(s, d))


@query("user_quality", """$BASE SELECT user_id, events, positives, max_item_users, avg_item_users, CAST(max_item_users > 1 AS INT) shares_items, CASE WHEN positives >= 20 THEN 'heavy' WHEN positives >= 10 THEN 'two_tower' WHEN positives >= 5 THEN 'medium' WHEN positives >= 1 THEN 'cold' ELSE 'fallback' END bucket
FROM (SELECT user_id, count(*) events, count(*) FILTER (label_binary = 1) positives, max(u) max_item_users, round(avg(u), 6) avg_item_users FROM train JOIN (SELECT item_id, count(DISTINCT user_id) u FROM train GROUP BY 1) USING (item_id) GROUP BY 1)""")
def user_quality(s, d):
    return K.user_quality(_train(s, d))


@query("universe_coverage", "$BASE SELECT min_freq, count(*) FILTER (f >= min_freq) n_items, round(sum(CASE WHEN f >= min_freq THEN f ELSE 0 END) / sum(f), 6) coverage FROM (SELECT item_id, count(*) f FROM train GROUP BY 1), (SELECT unnest([1, 5, 10, 20]) min_freq) GROUP BY 1")
def universe_coverage(s, d):
    return K.universe_coverage(_train(s, d), [1, 5, 10, 20])


@query("activity_segments", "$BASE SELECT user_id, history, CASE WHEN r <= floor(n * 0.2) THEN 'hot' WHEN r <= floor(n * 0.5) THEN 'warm' ELSE 'cold' END segment FROM (SELECT *, row_number() OVER (ORDER BY history DESC, user_id) r, count(*) OVER () n FROM (SELECT user_id, count(*) history FROM inter GROUP BY 1))")
def activity_segments(s, d):
    return K.activity_segments(S.interactions(s, d))


@query("stratified_sample")
def stratified_sample(s, d):
    return K.stratified_sample(K.activity_segments(S.interactions(s, d)), "segment", "user_id", K.largest_remainder({"hot": 2, "warm": 3, "cold": 5}, 50))


@query("label_artifact", "$BASE SELECT split, count(*) n, count(*) FILTER (label = 1) n_positive FROM (SELECT i.split, CASE WHEN h.user_id IS NULL THEN 0 ELSE 1 END label FROM inter i LEFT JOIN held h USING (user_id, item_id)) GROUP BY 1")
def label_artifact(s, d):
    j = S.interactions(s, d).join(_held(s, d).withColumn("label", F.lit(1)), ["user_id", "item_id"], "left")
    return j.groupBy("split").agg(F.count("*").alias("n"), F.count("label").alias("n_positive"))


@query("eval_label_aggregation", "$BASE SELECT user_id, count(*) n, array_to_string(list(DISTINCT split ORDER BY split), ',') splits, min(ts) first_ts, max(ts) last_ts FROM inter WHERE label_binary = 1 AND split <> 'train' GROUP BY 1")
def eval_label_aggregation(s, d):
    h = S.interactions(s, d).filter("label_binary = 1 and split != 'train'")
    return h.groupBy("user_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("split")), ",").alias("splits"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


# recall builders


@query("popularity_view", "$BASE SELECT * FROM pop")
def popularity_view(s, d):
    return _pop(s, d)


@query("popular_by_category", "$BASE SELECT category, item_id, pop, recent_pop, r AS rank FROM (SELECT category, item_id, pop, recent_pop, row_number() OVER (PARTITION BY category ORDER BY pop DESC, item_id) r FROM pop JOIN items USING (item_id)) WHERE r <= 10")
def popular_by_category(s, d):
    j = _pop(s, d).join(S.items(s, d).select("item_id", "category"), "item_id").select("category", "item_id", "pop", "recent_pop")
    return B.top_k(j, ["category"], [F.col("pop").desc(), F.col("item_id")], 10)


CF = """cooc AS (SELECT a.item_id a, b.item_id b, count(*) c FROM seq a JOIN seq b USING (user_id) WHERE a.item_id < b.item_id GROUP BY ALL), iu AS (SELECT item_id, count(*) n FROM seq GROUP BY 1),
half AS (SELECT a src, b dst, c cooc, x.n src_users, y.n dst_users, round(c / sqrt(x.n * y.n), 6) score FROM cooc JOIN iu x ON a = x.item_id JOIN iu y ON b = y.item_id),
edges AS (SELECT * FROM half UNION ALL SELECT dst, src, cooc, dst_users, src_users, score FROM half),
cf AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) rank FROM edges QUALIFY rank <= 10)"""


def _cf(s, d):
    return once(("itemcf", d), lambda: B.itemcf(S.recent_positives(s, d), 10))


def _cf_short(s, d):
    """The columns that recall reads; the counts behind the scores are then neither shuffled nor stored."""
    return once(("itemcf-short", d), lambda: B.itemcf(S.recent_positives(s, d), 10).select("src", "dst", "score", "rank"))


@query("itemcf_edges", f"$BASE, {CF} SELECT * FROM cf")
def itemcf_edges(s, d):
    return _cf(s, d)


@query("itemcf_coverage", f"$BASE, {CF} SELECT (SELECT count(*) FROM cf) n_edges, (SELECT count(DISTINCT src) FROM cf) n_seeds, c covered_users, n n_users, round(c / n, 6) user_share FROM (SELECT count(DISTINCT user_id) n, count(DISTINCT user_id) FILTER (item_id IN (SELECT src FROM cf)) c FROM seq)")
def itemcf_coverage(s, d):
    return B.edge_coverage(_cf(s, d), S.recent_positives(s, d))


@query("augmented_pairs", """$BASE SELECT a src, b dst, count(*) support, round(sum(1 / ln(1.0 + len)), 6) score FROM (SELECT x.user_id, x.item_id a, y.item_id b, x.len FROM seq x JOIN seq y USING (user_id) WHERE x.strong = 1 AND x.item_id <> y.item_id
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY x.pos DESC, y.pos DESC) <= 30) GROUP BY 1, 2""")
def augmented_pairs(s, d):
    return B.observed_pairs(S.recent_positives(s, d))


@query("augmented_pseudo_edges", "$BASE, h AS (SELECT category, brand, item_id, pop FROM pop JOIN items USING (item_id) QUALIFY row_number() OVER (PARTITION BY category, brand ORDER BY pop DESC, item_id) <= 6) SELECT a.item_id src, b.item_id dst, round(ln(1 + b.pop) / 10, 6) score FROM h a JOIN h b USING (category, brand) WHERE a.item_id <> b.item_id")
def augmented_pseudo_edges(s, d):
    return B.metadata_pseudo_edges(S.items(s, d), _pop(s, d))


@query("augmented_blend")
def augmented_blend(s, d):
    hot = _pop(s, d).filter("pop >= 20").select("item_id")
    return B.blended_edges(B.observed_pairs(S.recent_positives(s, d)), B.metadata_pseudo_edges(S.items(s, d), _pop(s, d)), 10, 0.3, 3, hot)


SW = "hot AS (SELECT item_id FROM seq GROUP BY 1 HAVING count(DISTINCT user_id) > 500), e AS (SELECT DISTINCT user_id, item_id FROM seq WHERE item_id NOT IN (SELECT item_id FROM hot)), w AS (SELECT *, count(*) OVER (PARTITION BY user_id) n FROM e)"


@query("swing_standard", f"""$BASE, {SW}, uv AS (SELECT a.user_id u, b.user_id v, a.n nu, b.n nv, count(*) o FROM w a JOIN w b USING (item_id) WHERE a.user_id < b.user_id GROUP BY ALL HAVING count(*) >= 2)
SELECT x.item_id src, y.item_id dst, round(sum(1 / (sqrt(nu) * sqrt(nv)) / (1 + o)), 6) score FROM uv JOIN e x ON x.user_id = u JOIN e x2 ON x2.user_id = v AND x2.item_id = x.item_id JOIN e y ON y.user_id = u AND y.item_id > x.item_id JOIN e y2 ON y2.user_id = v AND y2.item_id = y.item_id GROUP BY 1, 2""")
def swing_standard(s, d):
    return B.swing(S.recent_positives(s, d))


@query("swing_approximate", f"$BASE, {SW} SELECT a.item_id src, b.item_id dst, round(count(*) / (1 + sum(1.0 / a.n)), 6) score FROM w a JOIN w b USING (user_id) WHERE a.item_id < b.item_id GROUP BY 1, 2")
def swing_approximate(s, d):
    return B.swing(S.recent_positives(s, d), standard=False)


SIM = """se AS (SELECT DISTINCT user_id, item_id FROM seq WHERE item_id IN (SELECT item_id FROM seq GROUP BY 1 HAVING count(DISTINCT user_id) <= 5000)), nn AS (SELECT user_id, count(*) n FROM se GROUP BY 1),
ov AS (SELECT a.user_id, b.user_id other, count(*) overlap FROM se a JOIN se b USING (item_id) WHERE a.user_id <> b.user_id GROUP BY ALL),
sim AS (SELECT o.*, round(overlap / sqrt(a.n * b.n), 6) sim FROM (SELECT * FROM ov QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY overlap DESC, other) <= {n}) o JOIN nn a USING (user_id) JOIN nn b ON b.user_id = other)"""


@query("usercf_candidates", f"$BASE, {SIM.format(n=10)} SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) rank FROM (SELECT s.user_id, e.item_id, round(sum(sim), 6) score FROM sim s JOIN seq e ON e.user_id = other WHERE NOT EXISTS (SELECT 1 FROM seq x WHERE x.user_id = s.user_id AND x.item_id = e.item_id) GROUP BY ALL) QUALIFY rank <= 10")
def usercf_candidates(s, d):
    return B.usercf(S.recent_positives(s, d))


@query("usercf_iuf_candidates")
def usercf_iuf_candidates(s, d):
    return B.usercf(S.recent_positives(s, d), weighted=True)


@query("iuf_weights", "$BASE SELECT item_id, round(greatest(ln(((SELECT count(DISTINCT user_id) FROM seq) + 1.0) / (count(DISTINCT user_id) + 1)), 1e-6), 9) iuf FROM seq GROUP BY 1")
def iuf_weights(s, d):
    return B.iuf(S.recent_positives(s, d)).select("item_id", F.round("iuf", 9).alias("iuf"))


@query("recursive_cf", f"""$BASE, {SIM.format(n=8)}, p AS (SELECT user_id, other, round(sum(sim), 6) sim FROM (SELECT user_id, other, sim FROM sim UNION ALL SELECT a.user_id, b.other, 0.5 * a.sim * b.sim FROM sim a JOIN sim b ON b.user_id = a.other WHERE b.other <> a.user_id) GROUP BY ALL)
SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) rank FROM (SELECT s.user_id, e.item_id, round(sum(sim), 6) score FROM p s JOIN seq e ON e.user_id = other WHERE NOT EXISTS (SELECT 1 FROM seq x WHERE x.user_id = s.user_id AND x.item_id = e.item_id) GROUP BY ALL) QUALIFY rank <= 10""")
def recursive_cf(s, d):
    return B.recursive_cf(S.recent_positives(s, d))


@query("rating_prediction_error")
def rating_prediction_error(s, d):
    t = S.interactions(s, d)
    return E.error_metrics(B.pearson_prediction(t.filter("split = 'train'").select("user_id", "item_id", "rating"), t.filter("split = 'valid'").select("user_id", "item_id", "rating")))


@query("item_graph", """$BASE, g AS (SELECT a.item_id src, b.item_id dst, round(sum((b.pos / b.len) / (b.pos - a.pos) * CASE WHEN b.strong = 1 THEN 1.5 ELSE 1 END), 6) score, count(*) support, count(*) FILTER (b.strong = 1) strong_support
FROM seq a JOIN seq b USING (user_id) WHERE b.pos > a.pos AND b.pos <= a.pos + 3 AND a.item_id <> b.item_id GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) rank FROM g QUALIFY rank <= 10""")
def item_graph(s, d):
    return B.item_graph(S.recent_positives(s, d))


@query("co_visit_transitions", """$BASE, g AS (SELECT a.item_id src, b.item_id dst, sum(1 / (b.pos - a.pos)) w, count(DISTINCT user_id) users FROM seq a JOIN seq b USING (user_id) WHERE b.pos > a.pos AND b.pos <= a.pos + 3 GROUP BY ALL), p AS (SELECT item_id dst, count(*) p FROM seq GROUP BY 1)
SELECT src, dst, round(w / sqrt(p), 6) score, users, row_number() OVER (PARTITION BY src ORDER BY round(w / sqrt(p), 6) DESC, dst) rank FROM g JOIN p USING (dst) QUALIFY rank <= 10""")
def co_visit_transitions(s, d):
    return B.co_visit(S.recent_positives(s, d))


@query("session_transitions", "$BASE SELECT src, dst, count(*) n FROM (SELECT item_id src, lead(item_id) OVER (PARTITION BY user_id ORDER BY pos) dst FROM seq) WHERE dst IS NOT NULL GROUP BY 1, 2")
def session_transitions(s, d):
    return B.session_transition(S.recent_positives(s, d))


@query("multi_interest", "$BASE SELECT a.item_id src, b.item_id dst, round(sum(1 + CASE WHEN a.pos > a.len - 3 AND b.pos > b.len - 3 THEN 0.5 ELSE 0 END), 6) score FROM seq a JOIN seq b USING (user_id) WHERE a.item_id < b.item_id GROUP BY 1, 2")
def multi_interest(s, d):
    return B.multi_interest(S.recent_positives(s, d))


@query("skip_gram_pairs", "$BASE SELECT a.item_id center, b.item_id context, count(*) n FROM seq a JOIN seq b USING (user_id) WHERE a.pos <> b.pos AND abs(a.pos - b.pos) <= 2 GROUP BY 1, 2")
def skip_gram_pairs(s, d):
    return B.skip_gram_pairs(S.recent_positives(s, d))


@query("category_buckets", """$BASE SELECT bucket, item_id, pop, recent_pop, row_number() OVER (PARTITION BY bucket ORDER BY pop DESC, item_id) rank FROM (SELECT item_id, coalesce(pop, 0) pop, coalesce(recent_pop, 0) recent_pop,
unnest(list_distinct(list_prepend('main::' || category, list_transform(categories, lambda c: 'path::' || c)))) bucket FROM items LEFT JOIN pop USING (item_id)) QUALIFY rank <= 20""")
def category_buckets(s, d):
    return B.category_buckets(S.items(s, d), _pop(s, d))


PROFILE = "prof AS (SELECT user_id, category, round(w / sum(w) OVER (PARTITION BY user_id), 6) share FROM (SELECT user_id, category, sum(1 / sqrt(len - pos + 1)) w FROM seq JOIN items USING (item_id) GROUP BY ALL)), profile AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY share DESC, category) rank FROM prof QUALIFY rank <= 3)"


@query("category_profiles", f"$BASE, {PROFILE} SELECT * FROM profile")
def category_profiles(s, d):
    return B.category_profile(S.recent_positives(s, d), S.items(s, d))


@query("token_inverted_index", "$BASE SELECT item_id, pop, token, row_number() OVER (PARTITION BY token ORDER BY pop DESC, item_id) rank FROM (SELECT item_id, coalesce(pop, 0) pop, unnest(list_distinct(list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda t: length(t) >= 2))) token FROM items LEFT JOIN pop USING (item_id)) QUALIFY rank <= 30")
def token_inverted_index(s, d):
    return B.inverted_index(S.items(s, d), _pop(s, d))


@query("negative_sampling_table", "$BASE, f AS (SELECT item_id, count(*) freq FROM train GROUP BY 1 HAVING count(*) >= 3) SELECT item_id, freq, round(pow(freq, 0.75) / (SELECT sum(pow(freq, 0.75)) FROM f), 9) p_negative FROM f")
def negative_sampling_table(s, d):
    return B.vocabulary(_train(s, d), 3)


@query("example_age_weights", "$BASE SELECT user_id, round(sum(greatest(0.1, pow(0.5, ((SELECT max(ts) FROM train) - ts) / 86400000.0 / 180))), 6) weight FROM train GROUP BY 1")
def example_age_weights(s, d):
    return B.example_ages(_train(s, d))


@query("als_recommendations")
def als_recommendations(s, d):
    return B.als_factors(S.train_positives(s, d))


@query("item_word2vec")
def item_word2vec(s, d):
    return B.item_skip_grams(S.recent_positives(s, d)).select("item_id", F.size("vector").alias("dim"), "vector")


# candidates

SEEDS = "seeds AS (SELECT user_id, item_id, len - pos + 1 seed_rank FROM seq WHERE len - pos < 5)"
CFREC = f"{CF}, {SEEDS}, cfrec AS (SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) rank FROM (SELECT s.user_id, dst item_id, round(max(pow(0.8, seed_rank - 1) * score), 6) score FROM seeds s JOIN cf ON src = s.item_id WHERE NOT EXISTS (SELECT 1 FROM seq x WHERE x.user_id = s.user_id AND x.item_id = dst) GROUP BY ALL) WHERE score > 0 QUALIFY rank <= 30)"


def _cf_recall(s, d):
    seq = S.recent_positives(s, d)
    return C.recall_from_edges(C.seeds(seq), _cf_short(s, d), seq, F.pow(F.lit(0.8), F.col("seed_rank") - 1), 10, 30)


@query("seed_extraction", f"$BASE, {SEEDS} SELECT * FROM seeds")
def seed_extraction(s, d):
    return C.seeds(S.recent_positives(s, d))


@query("itemcf_recall", f"$BASE, {CFREC} SELECT * FROM cfrec")
def itemcf_recall(s, d):
    return _cf_recall(s, d)


def _from_edges(edges: str, weight: str, how: str, floor: float) -> str:
    return f"""linked AS ({edges}), rec AS (SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) rank FROM (SELECT s.user_id, dst item_id, round({how}({weight} * e.score), 6) score FROM seeds s JOIN linked e ON e.src = s.item_id
WHERE e.rank <= 10 AND NOT EXISTS (SELECT 1 FROM seq x WHERE x.user_id = s.user_id AND x.item_id = dst) GROUP BY ALL) WHERE score > {floor} QUALIFY rank <= 30)"""


CO_VISIT_REC = _from_edges(ORACLE_SQL["co_visit_transitions"], "1 / sqrt(seed_rank * 1.0)", "max", 0)
GRAPH_REC = _from_edges(ORACLE_SQL["item_graph"], "1", "sum", 0.05)


def _graph_recall(s, d):
    seq = S.recent_positives(s, d)
    return C.recall_from_edges(C.seeds(seq), B.co_visit(seq), seq, 1 / F.sqrt(F.col("seed_rank") * 1.0), 10, 30)


@query("co_visit_recall", f"$BASE, {SEEDS}, {CO_VISIT_REC} SELECT * FROM rec")
def co_visit_recall(s, d):
    return _graph_recall(s, d)


@query("graph_recall_summed", f"$BASE, {SEEDS}, {GRAPH_REC} SELECT * FROM rec")
def graph_recall_summed(s, d):
    seq = S.recent_positives(s, d)
    return C.recall_from_edges(C.seeds(seq), B.item_graph(seq), seq, F.lit(1.0), 10, 30, "sum", 0.05)


def _cat_recall(s, d):
    seq, items = S.recent_positives(s, d), S.items(s, d)
    return C.from_buckets(B.category_profile(seq, items), B.category_buckets(items, _pop(s, d)), seq, 15, 20)


@query("category_recall", f"""$BASE, {PROFILE}, b AS (SELECT category, item_id, coalesce(pop, 0) pop, coalesce(recent_pop, 0) recent_pop FROM items LEFT JOIN pop USING (item_id) QUALIFY row_number() OVER (PARTITION BY category ORDER BY coalesce(pop, 0) DESC, item_id) <= 15)
SELECT user_id, item_id, score, place AS rank FROM (SELECT p.user_id, b.item_id, round(b.pop * (1 + p.share) + 0.01 * b.recent_pop, 6) score, row_number() OVER (PARTITION BY p.user_id ORDER BY round(b.pop * (1 + p.share) + 0.01 * b.recent_pop, 6) DESC, b.item_id) AS place FROM profile p JOIN b USING (category) LEFT JOIN seq x ON x.user_id = p.user_id AND x.item_id = b.item_id WHERE x.user_id IS NULL QUALIFY place <= 20)""")
def category_recall(s, d):
    return _cat_recall(s, d)


@query("category_long_tail", f"$BASE, {PROFILE} SELECT user_id, item_id, category, r FROM profile JOIN (SELECT category, item_id, row_number() OVER (PARTITION BY category ORDER BY coalesce(pop, 0) DESC, item_id) r FROM items LEFT JOIN pop USING (item_id)) USING (category) WHERE r > 10 AND r <= 15")
def category_long_tail(s, d):
    return C.long_tail(B.category_profile(S.recent_positives(s, d), S.items(s, d)), S.items(s, d), _pop(s, d), 10, 5)


@query("token_overlap_recall")
def token_overlap_recall(s, d):
    return C.token_overlap(C.seeds(S.recent_positives(s, d), 3), S.items(s, d), 20, 3)


def _popular(s, d):
    seq = S.recent_positives(s, d)
    return C.popular_fallback(seq.select("user_id").distinct(), _pop(s, d), seq, 40, 20)


@query("popular_fallback", "$BASE, h AS (SELECT item_id, pop FROM pop ORDER BY pop DESC, item_id LIMIT 40) SELECT u.user_id, h.item_id, h.pop, row_number() OVER (PARTITION BY u.user_id ORDER BY h.pop DESC, h.item_id) rank FROM (SELECT DISTINCT user_id FROM seq) u CROSS JOIN h LEFT JOIN seq x ON x.user_id = u.user_id AND x.item_id = h.item_id WHERE x.user_id IS NULL QUALIFY rank <= 20")
def popular_fallback(s, d):
    return _popular(s, d)



PARTS = f"""{CFREC}, {PROFILE}, cb AS (SELECT category, item_id, coalesce(pop, 0) pop, coalesce(recent_pop, 0) recent_pop FROM items LEFT JOIN pop USING (item_id) QUALIFY row_number() OVER (PARTITION BY category ORDER BY coalesce(pop, 0) DESC, item_id) <= 15),
catrec AS (SELECT user_id, item_id, score, place rank FROM (SELECT p.user_id, b.item_id, round(b.pop * (1 + p.share) + 0.01 * b.recent_pop, 6) score, row_number() OVER (PARTITION BY p.user_id ORDER BY round(b.pop * (1 + p.share) + 0.01 * b.recent_pop, 6) DESC, b.item_id) AS place FROM profile p JOIN cb b USING (category) LEFT JOIN seq x ON x.user_id = p.user_id AND x.item_id = b.item_id WHERE x.user_id IS NULL QUALIFY place <= 20)),
ph AS (SELECT item_id, pop FROM pop ORDER BY pop DESC, item_id LIMIT 40), poprec AS (SELECT u.user_id, ph.item_id, ph.pop, row_number() OVER (PARTITION BY u.user_id ORDER BY ph.pop DESC, ph.item_id) AS rank FROM (SELECT DISTINCT user_id FROM seq) u CROSS JOIN ph LEFT JOIN seq x ON x.user_id = u.user_id AND x.item_id = ph.item_id WHERE x.user_id IS NULL QUALIFY row_number() OVER (PARTITION BY u.user_id ORDER BY ph.pop DESC, ph.item_id) <= 20),
parts AS (SELECT user_id, item_id, score, rank, 'itemcf' source, 0 src_no FROM cfrec UNION ALL SELECT user_id, item_id, score / 100, rank, 'category', 1 FROM catrec UNION ALL SELECT user_id, item_id, pop / 200.0, rank, 'popular', 2 FROM poprec),
merged AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (SELECT user_id, item_id, sum(CAST(floor(score * 1e6 + 0.5) AS BIGINT)) / 1e6 score, string_agg(source, ',' ORDER BY src_no) sources, count(*) n_sources FROM parts GROUP BY ALL)),
coarse AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY coarse DESC, item_id) coarse_rank FROM (SELECT user_id, item_id, count(*) n_sources, string_agg(source, ',' ORDER BY source) sources,
  round(sum(CASE source WHEN 'itemcf' THEN 1.5 WHEN 'popular' THEN 0.5 ELSE 1 END * least(100, greatest(0, score)) + CASE source WHEN 'itemcf' THEN 0.1 ELSE 0 END + 1 / (60.0 + rank)) + (count(*) - 1) * 0.05 + 3.7e-10, 6) coarse FROM parts GROUP BY ALL)),
cut AS (SELECT c.*, coalesce(decay_pop, 0) dp FROM coarse c LEFT JOIN pop USING (item_id) WHERE coarse_rank <= 40),
fine0 AS (SELECT *, CASE WHEN max(dp) OVER w > min(dp) OVER w THEN round((dp - min(dp) OVER w) / (max(dp) OVER w - min(dp) OVER w), 6) ELSE 0 END feature FROM cut WINDOW w AS (PARTITION BY user_id)),
fine1 AS (SELECT *, round(coarse + round(CASE WHEN contains(sources, 'itemcf') THEN 0.1 + CASE WHEN n_sources >= 2 THEN 0.05 ELSE 0 END ELSE 0 END - CASE WHEN sources = 'popular' THEN 0.1 ELSE 0 END, 6) + 0.2 * feature + 3.7e-10, 6) fine FROM fine0),
fine2 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY fine DESC, item_id) fine_rank, round(fine + round(CASE WHEN n_sources >= 2 THEN 0.03 ELSE 0 END - CASE WHEN sources = 'popular' THEN 0.04 ELSE 0 END, 6), 6) final FROM fine1),
ranked AS (SELECT user_id, item_id, sources, coarse, fine, final, coarse_rank, fine_rank, final_rank, coarse_rank - final_rank movement FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY final DESC, item_id) final_rank FROM fine2) WHERE final_rank <= 20)"""

def _parts(s, d):
    return {"itemcf": _cf_recall(s, d), "category": _cat_recall(s, d).withColumn("score", F.col("score") / 100), "popular": _popular(s, d).withColumn("score", F.col("pop") / 200.0)}


def _merged(s, d):
    return C.merge_sources(_parts(s, d))


@query("merged_candidates", f"""$BASE, {PARTS} SELECT * FROM merged""")
def merged_candidates(s, d):
    return _merged(s, d)


@query("pool_with_minimums")
def pool_with_minimums(s, d):
    return C.limit_pool(_merged(s, d), 20, {"itemcf": 8}, {"popular": 10})


@query("balanced_pool")
def balanced_pool(s, d):
    return C.balanced_pool(_merged(s, d), 20, ["itemcf", "category", "popular"])


@query("fallback_ladder", f"""$BASE, {PARTS} SELECT user_id, item_id, step, ord, row_number() OVER (PARTITION BY user_id ORDER BY step, ord, item_id) AS slot FROM (SELECT user_id, item_id, min((src_no, rank)) m, src_no_min step, rank_min ord FROM (SELECT user_id, item_id, src_no, rank, first_value(src_no) OVER w src_no_min, first_value(rank) OVER w rank_min FROM parts WHERE src_no > 0 OR rank <= 10 WINDOW w AS (PARTITION BY user_id, item_id ORDER BY src_no, rank)) GROUP BY ALL) QUALIFY slot <= 20""")
def fallback_ladder(s, d):
    return C.fill_ladder([_cf_recall(s, d).filter("rank <= 10"), _cat_recall(s, d), _popular(s, d)], 20)


@query("diverse_popular", "$BASE SELECT item_id, category, pop, r category_rank FROM (SELECT item_id, category, pop, row_number() OVER (PARTITION BY category ORDER BY pop DESC, item_id) r FROM pop JOIN items USING (item_id)) ORDER BY CAST(r > 5 AS INT), pop DESC, item_id LIMIT 50")
def diverse_popular(s, d):
    return C.diverse_popular(S.items(s, d), _pop(s, d), 5, 50)


@query("pool_interleave", f"""$BASE, {PARTS} SELECT user_id, item_id, r, p, row_number() OVER (PARTITION BY user_id ORDER BY r, p, item_id) AS slot FROM (SELECT user_id, item_id, rank r, src_no p FROM parts QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY rank, src_no) = 1) QUALIFY slot <= 20""")
def pool_interleave(s, d):
    return C.interleave([_cf_recall(s, d), _cat_recall(s, d), _popular(s, d)], 20)


@query("constraint_search", "$BASE SELECT item_id, category, price, coalesce(pop, 0) pop, CASE WHEN category = (SELECT min(category) FROM items) AND contains(lower(title), 'a') THEN 0 ELSE 1 END relaxed FROM items LEFT JOIN pop USING (item_id) WHERE price <= 1500 ORDER BY relaxed, pop DESC, item_id LIMIT 50")
def constraint_search(s, d):
    first = S.items(s, d).agg(F.min("category")).first()[0]
    return C.constraint_search(S.items(s, d), _pop(s, d), 1500.0, first, "a", 50)


# ranking


def _coarse(s, d):
    long, parts = None, _parts(s, d)
    for name, df in parts.items():
        p = df.select("user_id", "item_id", "score", "rank", F.lit(name).alias("source"))
        long = p if long is None else long.unionByName(p)
    return R.coarse_rank(long, {"itemcf": 1.5, "popular": 0.5}, {"itemcf": 0.1}, names=list(parts))


def _ranked(s, d):
    return R.three_stage(_coarse(s, d), _pop(s, d), 40, 20)


@query("coarse_ranking", f"""$BASE, {PARTS} SELECT * FROM coarse""")
def coarse_ranking(s, d):
    return _coarse(s, d)


@query("three_stage_ranking", f"""$BASE, {PARTS} SELECT * FROM ranked""")
def three_stage_ranking(s, d):
    return _ranked(s, d)


@query("source_minimum_guarantee", f"""$BASE, {PARTS} SELECT user_id, item_id, final, guaranteed, row_number() OVER (PARTITION BY user_id ORDER BY final DESC, item_id) slot FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY guaranteed DESC, final_rank) AS pick FROM (SELECT *, CAST(own = 1 AND sum(own) OVER (PARTITION BY user_id ORDER BY final_rank ROWS UNBOUNDED PRECEDING) <= 3 AND sum(own) OVER (PARTITION BY user_id) >= 3 AS INT) guaranteed FROM (SELECT *, CAST(contains(sources, 'category') AS INT) own FROM ranked))) WHERE pick <= 10""")
def source_minimum_guarantee(s, d):
    return R.source_minimum(_ranked(s, d), "category", 3, 10)


@query("policy_cap_guard", f"""$BASE, {PARTS} SELECT user_id, item_id, flagged, deferred, row_number() OVER (PARTITION BY user_id ORDER BY deferred, final_rank) AS slot FROM (SELECT *, CAST(flagged = 1 AND sum(flagged) OVER (PARTITION BY user_id ORDER BY final_rank ROWS UNBOUNDED PRECEDING) > 3 AS INT) deferred FROM (SELECT *, CAST(sources = 'popular' AS INT) flagged FROM ranked)) QUALIFY slot <= 10""")
def policy_cap_guard(s, d):
    return R.cap_share(_ranked(s, d), F.col("sources") == "popular", 0.3, 10)


@query("ltr_scoring")
def ltr_scoring(s, d):
    f = R.ltr_features(_coarse(s, d).filter("coarse_rank <= 30"), _pop(s, d), S.items(s, d))
    return R.linear_score(f, {"coarse": 0.8, "n_sources": 0.3, "log_pop": 0.2, "recency": 0.4, "is_itemcf": 0.5}, -1.0)


def _feedback(s, d):
    h = _held(s, d).join(S.interactions(s, d).filter("split = 'valid'").select("user_id", "item_id", "verified"), ["user_id", "item_id"])
    return h.select("user_id", "item_id", F.when(F.col("verified"), 1).otherwise(-1).alias("sign"), F.lit(10.0).alias("age_days"))


@query("constraint_filter")
def constraint_filter(s, d):
    return R.constraint_filter(_ranked(s, d), S.items(s, d), _feedback(s, d).filter("sign < 0"), 1400.0, 5)


@query("feedback_neighbour_rerank", f"""$BASE, {PARTS}, fbk AS (SELECT h.user_id, h.item_id, CASE WHEN i.verified THEN 1 ELSE -1 END sign, 10.0 age FROM held h JOIN (SELECT user_id, item_id, verified FROM inter WHERE split = 'valid') i USING (user_id, item_id)) SELECT user_id, item_id, final, adjusted, row_number() OVER (PARTITION BY user_id ORDER BY adjusted DESC, item_id) slot FROM (SELECT r.user_id, r.item_id, final, round(final + 0.3 * (coalesce(up, 0) - coalesce(down, 0)) + 3.7e-10, 6) adjusted FROM ranked r LEFT JOIN (SELECT f.user_id, dst item_id, max(score) FILTER (sign > 0) up, max(score) FILTER (sign < 0) down FROM fbk f JOIN cf ON src = f.item_id GROUP BY ALL) b USING (user_id, item_id))""")
def feedback_neighbour_rerank(s, d):
    return R.neighbour_rerank(_ranked(s, d), _feedback(s, d), _cf_short(s, d))


@query("preference_rerank", f"""$BASE, {PARTS}, fbk AS (SELECT h.user_id, h.item_id, CASE WHEN i.verified THEN 1 ELSE -1 END sign, 10.0 age FROM held h JOIN (SELECT user_id, item_id, verified FROM inter WHERE split = 'valid') i USING (user_id, item_id)), lk AS (SELECT user_id, brand, category, sign * pow(0.5, age / 30) w FROM fbk JOIN items USING (item_id)), pref AS (SELECT user_id, item_id, preference, adjusted, row_number() OVER (PARTITION BY user_id ORDER BY adjusted DESC, item_id) slot FROM (SELECT *, round(final + preference + 3.7e-10, 6) adjusted FROM (SELECT r.user_id, r.item_id, final, round(greatest(-0.25, least(0.25, 0.1 * coalesce(bw, 0) + 0.05 * coalesce(cw, 0))) + 3.7e-10, 6) preference FROM ranked r JOIN items i USING (item_id) LEFT JOIN (SELECT user_id, brand, sum(w) bw FROM lk GROUP BY ALL) b ON b.user_id = r.user_id AND b.brand = i.brand LEFT JOIN (SELECT user_id, category, sum(w) cw FROM lk GROUP BY ALL) c ON c.user_id = r.user_id AND c.category = i.category))) SELECT * FROM pref""")
def preference_rerank(s, d):
    return R.preference_rerank(_ranked(s, d), S.items(s, d), _feedback(s, d))


@query("exploration_reserve", f"""$BASE, {PARTS}, fbk AS (SELECT h.user_id, h.item_id, CASE WHEN i.verified THEN 1 ELSE -1 END sign, 10.0 age FROM held h JOIN (SELECT user_id, item_id, verified FROM inter WHERE split = 'valid') i USING (user_id, item_id)), lk AS (SELECT user_id, brand, category, sign * pow(0.5, age / 30) w FROM fbk JOIN items USING (item_id)), pref AS (SELECT user_id, item_id, preference, adjusted, row_number() OVER (PARTITION BY user_id ORDER BY adjusted DESC, item_id) slot FROM (SELECT *, round(final + preference + 3.7e-10, 6) adjusted FROM (SELECT r.user_id, r.item_id, final, round(greatest(-0.25, least(0.25, 0.1 * coalesce(bw, 0) + 0.05 * coalesce(cw, 0))) + 3.7e-10, 6) preference FROM ranked r JOIN items i USING (item_id) LEFT JOIN (SELECT user_id, brand, sum(w) bw FROM lk GROUP BY ALL) b ON b.user_id = r.user_id AND b.brand = i.brand LEFT JOIN (SELECT user_id, category, sum(w) cw FROM lk GROUP BY ALL) c ON c.user_id = r.user_id AND c.category = i.category))) SELECT user_id, item_id, new, row_number() OVER (PARTITION BY user_id ORDER BY slot) place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN new = 1 AND r <= 2 THEN 0 ELSE 1 END, slot) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY user_id, new ORDER BY slot) r FROM (SELECT *, CAST(preference <= 0 AS INT) new FROM pref))) WHERE pick <= 10""")
def exploration_reserve(s, d):
    return R.exploration_reserve(preference_rerank(s, d), 10)


@query("first_screen_diversity")
def first_screen_diversity(s, d):
    return R.first_screen(_ranked(s, d), S.items(s, d))


@query("marginal_relevance_feed")
def marginal_relevance_feed(s, d):
    return R.marginal_relevance(_ranked(s, d), S.items(s, d))


# evaluation

MET = """h AS (SELECT DISTINCT * FROM held), m AS (SELECT user_id, count(*) m FROM h GROUP BY 1),
hits AS (SELECT c.user_id, rank, row_number() OVER (PARTITION BY c.user_id ORDER BY rank) hh FROM cfrec c JOIN h USING (user_id, item_id) WHERE rank <= 20), per AS (SELECT user_id, count(*) hits, sum(1 / log2(rank + 1)) dcg, min(rank) f, sum(hh / rank) ap FROM hits GROUP BY 1),
j AS (SELECT user_id, coalesce(hits, 0) / m r, coalesce(dcg, 0) / list_sum(list_transform(range(1, least(m, 20) + 1), lambda i: 1 / log2(i + 1))) n, coalesce(1 / f, 0) mrr, coalesce(ap, 0) / least(m, 20) ap, CASE WHEN hits > 0 THEN 1.0 ELSE 0 END hit FROM m LEFT JOIN per USING (user_id))"""
COLS = "count(*) n_users, round(avg(r), 6) recall, round(avg(n), 6) ndcg, round(avg(mrr), 6) mrr, round(avg(ap), 6) map, round(avg(hit), 6) hit_rate"


@query("ranking_metrics", f"$BASE, {CFREC}, {MET} SELECT {COLS} FROM j")
def ranking_metrics(s, d):
    return E.ranking_metrics(_cf_recall(s, d), _held(s, d), 20)


@query("ranking_metrics_by_segment", f"""$BASE, {CFREC}, {MET}, s AS (SELECT user_id, CASE WHEN r <= floor(n * 0.2) THEN 'hot' WHEN r <= floor(n * 0.5) THEN 'warm' ELSE 'cold' END segment FROM (SELECT *, row_number() OVER (ORDER BY history DESC, user_id) r, count(*) OVER () n FROM (SELECT user_id, count(*) history FROM inter GROUP BY 1)))
SELECT segment, {COLS} FROM j JOIN s USING (user_id) GROUP BY ROLLUP (segment)""")
def ranking_metrics_by_segment(s, d):
    truth = _held(s, d).join(K.activity_segments(S.interactions(s, d)).select("user_id", "segment"), "user_id")
    return E.ranking_metrics(_cf_recall(s, d), truth, 20, "segment")


@query("recall_cutoffs", f"$BASE, {CFREC} SELECT cutoff, round(avg(h / m), 6) recall, round(avg(CASE WHEN h > 0 THEN 1.0 ELSE 0 END), 6) hit_rate FROM (SELECT d.user_id, cutoff, count(DISTINCT d.item_id) m, count(c.rank) FILTER (c.rank <= cutoff) h FROM (SELECT DISTINCT * FROM held) d CROSS JOIN (SELECT unnest([5, 10, 20, 30]) cutoff) LEFT JOIN cfrec c ON c.user_id = d.user_id AND c.item_id = d.item_id GROUP BY ALL) GROUP BY 1")
def recall_cutoffs(s, d):
    return E.recall_at_cutoffs(_cf_recall(s, d), _held(s, d), [5, 10, 20, 30])


def _long(s, d):
    long = None
    for name, df in _parts(s, d).items():
        p = df.select("user_id", "item_id", F.lit(name).alias("source"))
        long = p if long is None else long.unionByName(p)
    return long


@query("source_marginal_hits", f"""$BASE, {PARTS} SELECT source, count(*) hit_users, count(*) FILTER (n = 1) only_here FROM (SELECT *, count(*) OVER (PARTITION BY user_id) n FROM (SELECT DISTINCT user_id, source FROM parts JOIN (SELECT DISTINCT * FROM held) USING (user_id, item_id))) GROUP BY 1""")
def source_marginal_hits(s, d):
    return E.source_marginal(_long(s, d), _held(s, d))


@query("source_jaccard", f"""$BASE, {PARTS} SELECT a, b, shared, round(shared / (na + nb - shared), 6) jaccard FROM (SELECT x.source a, y.source b, count(*) shared FROM parts x JOIN parts y USING (user_id, item_id) WHERE x.source < y.source GROUP BY ALL) JOIN (SELECT source a, count(*) na FROM parts GROUP BY 1) USING (a) JOIN (SELECT source b, count(*) nb FROM parts GROUP BY 1) USING (b)""")
def source_jaccard(s, d):
    return E.source_jaccard(_long(s, d))


@query("method_source_overlap", f"$BASE, {CFREC}, {CO_VISIT_REC} SELECT count(*) n_rows, count(h) shared, round(count(h) / count(*), 6) overlap FROM cfrec LEFT JOIN (SELECT user_id, item_id, 1 h FROM rec) USING (user_id, item_id)")
def method_source_overlap(s, d):
    return B.source_overlap(_cf_recall(s, d), _graph_recall(s, d))


@query("nearest_rank_p95", "SELECT event_type, n, value nearest FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) i, count(*) OVER (PARTITION BY event_type) n FROM events) WHERE i - 1 = round_even((n - 1) * 0.95, 0)")
def nearest_rank_p95(s, d):
    return E.nearest_rank(S.table(s, d, "events"), "event_type", "value", 0.95)


@query("miss_stages", f"$BASE, {CFREC} SELECT CASE WHEN rank <= 10 THEN 'topk' WHEN rank IS NOT NULL THEN 'pool' WHEN e.user_id IS NOT NULL THEN 'raw' ELSE 'miss' END stage, count(*) n FROM (SELECT DISTINCT * FROM held) h LEFT JOIN cfrec c USING (user_id, item_id) LEFT JOIN (SELECT DISTINCT s.user_id, dst item_id FROM seeds s JOIN cf ON src = s.item_id) e ON e.user_id = h.user_id AND e.item_id = h.item_id GROUP BY 1")
def miss_stages(s, d):
    seq, cf = S.recent_positives(s, d), _cf_recall(s, d)
    raw = C.seeds(seq).join(_cf_short(s, d).select(F.col("src").alias("item_id"), "dst"), "item_id").select("user_id", F.col("dst").alias("item_id"))
    return E.miss_stage(_held(s, d), cf, cf, raw, 10)


@query("popularity_buckets", "$BASE SELECT CASE WHEN r <= 10 THEN 'top_10' WHEN r <= 50 THEN 'top_50' WHEN r <= 200 THEN 'beyond_50' ELSE 'not_in_top' END bucket, count(*) n FROM held LEFT JOIN (SELECT item_id, row_number() OVER (ORDER BY pop DESC, item_id) r FROM pop) USING (item_id) GROUP BY 1")
def popularity_buckets(s, d):
    return E.popularity_buckets(_held(s, d), _pop(s, d))


@query("graded_ndcg", f"$BASE, {CFREC}, g AS (SELECT user_id, item_id, rank, pow(2, CASE WHEN price < 1200 THEN 2 WHEN price < 1500 THEN 1 ELSE 0 END) - 1 g FROM cfrec JOIN items USING (item_id) WHERE rank <= 10), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY g DESC, item_id) best FROM g) SELECT user_id, round(CASE WHEN sum(g / log2(best + 1)) > 0 THEN sum(g / log2(rank + 1)) / sum(g / log2(best + 1)) ELSE 0 END, 6) ndcg FROM b GROUP BY 1")
def graded_ndcg(s, d):
    j = _cf_recall(s, d).join(S.items(s, d).select("item_id", "price"), "item_id")
    return E.graded_ndcg(j, F.when(F.col("price") < 1200, 2).when(F.col("price") < 1500, 1).otherwise(0), 10)


@query("bootstrap_interval")
def bootstrap_interval(s, d):
    u = _held(s, d).groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", (F.pmod(F.col("n"), F.lit(3)) - 1).cast("double").alias("diff"))
    return E.bootstrap_interval(u, 200)


# retrieval


@query("chunking")
def chunking(s, d):
    return T.chunk_records(S.table(s, d, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max(F.length("chunk")).alias("longest"), F.sum(F.length("chunk")).alias("chars"))


TOK = "list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda t: length(t) >= 2)"
POSTS = f"docs AS (SELECT doc_id doc, {TOK.format(c='text')} t FROM documents), post AS (SELECT doc, dl, token, count(*) tf FROM (SELECT doc, len(t) dl, unnest(t) token FROM docs) GROUP BY ALL), q AS (SELECT item_id query, unnest(list_slice(list_distinct_in_order, 1, 12)) token FROM (SELECT item_id, list_filter(t, lambda x, i: list_position(t, x) = i) list_distinct_in_order FROM (SELECT item_id, {TOK.format(c='text')} t FROM benchmark)))"


def _posts(s, d, most=12):
    docs = S.table(s, d, "documents")
    posts = T.postings(docs, "doc_id", "text")
    stats = docs.agg(F.count("*").alias("n"), F.avg(F.size(T.all_tokens(F.col("text")))).alias("a")).first()
    return posts, T.query_tokens(S.table(s, d, "benchmark"), "item_id", "text", most), stats["n"], stats["a"]


BM25 = f"WITH {POSTS}, n AS (SELECT count(*) n, avg(len(t)) a FROM docs), f AS (SELECT token, count(*) df FROM post GROUP BY 1), sc AS (SELECT query, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) score FROM q JOIN post USING (token) JOIN f USING (token), n GROUP BY ALL)"
BM25_TOP = "SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) rank FROM sc QUALIFY rank <= {k}"


@query("bm25_retrieval", f"{BM25} {BM25_TOP.format(k=10)}")
def bm25_retrieval(s, d):
    posts, q, n, a = _posts(s, d)
    return T.bm25(posts, q, 10, n, a)


@query("tfidf_retrieval", f"WITH {POSTS}, f AS (SELECT token, ln(((SELECT count(*) FROM docs) + 1.0) / (count(*) + 1)) idf FROM post GROUP BY 1), w AS (SELECT doc, token, tf * idf w, idf FROM post JOIN f USING (token)), nm AS (SELECT doc, sqrt(sum(w * w)) n FROM w GROUP BY 1) SELECT query, doc, round(dot / n, 6) score, row_number() OVER (PARTITION BY query ORDER BY round(dot / n, 6) DESC, doc) AS rank FROM (SELECT query, doc, sum(w * idf) dot FROM w JOIN q USING (token) GROUP BY ALL) JOIN nm USING (doc) WHERE n > 0 QUALIFY rank <= 10")
def tfidf_retrieval(s, d):
    posts, q, n, _ = _posts(s, d)
    return T.tfidf_cosine(posts, q, 10, n)


@query("hybrid_fusion")
def hybrid_fusion(s, d):
    posts, q, n, a = _posts(s, d, None)  # whole texts ask
    posts = once(("postings", d), lambda p=posts: p)  # read by both searches, more than once each
    lex, dense = T.bm25(posts, q, 10, n, a), T.tfidf_cosine(posts, q, 10, n)
    rrf = T.reciprocal_rank_merge([lex, dense], ["query", "doc"]).withColumnRenamed("score", "rrf")
    return T.weighted_fusion(lex, dense, ["query", "doc"]).join(rrf, ["query", "doc"])


@query("evidence_quotas", f"""{BM25}, ev AS (SELECT query, doc % 20 item_id, CAST(doc % 3 AS VARCHAR) field, doc chunk_no, score FROM ({BM25_TOP.format(k=50)})), one AS (SELECT *, row_number() OVER (PARTITION BY query, item_id, field ORDER BY score DESC, chunk_no) field_rank FROM ev QUALIFY field_rank <= 2)
SELECT *, row_number() OVER (PARTITION BY query, item_id ORDER BY score DESC, field, chunk_no) item_rank FROM one QUALIFY item_rank <= 4""")
def evidence_quotas(s, d):
    posts, q, n, a = _posts(s, d)
    ev = T.bm25(posts, q, 50, n, a).select("query", (F.col("doc") % 20).alias("item_id"), (F.col("doc") % 3).cast("string").alias("field"), F.col("doc").alias("chunk_no"), "score")
    return T.evidence_quota(ev, 2, 4)


@query("vector_neighbours", "SELECT query, item, rank FROM (SELECT a.vec_id query, b.vec_id item, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) DESC, b.vec_id) rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 AND list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > 0) WHERE rank <= 10")
def vector_neighbours(s, d):
    v = S.table(s, d, "embeddings")
    return N.vector_top_k(v, v.filter("vec_id % 100 = 0"), "vec_id", "embedding", 10).select("query", "item", "rank")


# events and projections

NOW = "(SELECT max(ts) FROM events)"


def _now(s, d):
    return F.lit(S.feedback_events(s, d).agg(F.max("ts")).first()[0])


@query("idempotent_events", "$BASE SELECT count(*) n, count(DISTINCT profile_id) profiles FROM (SELECT * FROM fb QUALIFY row_number() OVER (PARTITION BY profile_id, item_id, kind ORDER BY ts, event_id) = 1)")
def idempotent_events(s, d):
    return V.idempotent(S.feedback_events(s, d), ["profile_id", "item_id", "kind"]).agg(F.count("*").alias("n"), F.countDistinct("profile_id").alias("profiles"))


VER = "v AS (SELECT *, CAST(sum(CASE WHEN kind IN ('LIKE', 'DISLIKE', 'REVERSAL') THEN 1 ELSE 0 END) OVER (PARTITION BY profile_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS version FROM fb)"


@query("preference_versions", f"$BASE, {VER} SELECT event_id, profile_id, version FROM v")
def preference_versions(s, d):
    return V.with_version(S.feedback_events(s, d)).select("event_id", "profile_id", "version")


@query("preference_projection", f"$BASE, {VER} SELECT profile_id, item_id, kind, version FROM (SELECT * FROM v WHERE kind IN ('LIKE', 'DISLIKE') QUALIFY row_number() OVER (PARTITION BY profile_id, item_id ORDER BY version DESC, event_id DESC) = 1) WHERE ts > {NOW} - INTERVAL 180 DAY")
def preference_projection(s, d):
    return V.preferences(S.feedback_events(s, d), _now(s, d)).drop("ts")


@query("feedback_reversal", "$BASE SELECT profile_id, item_id, max_by(kind, (ts, event_id)) kind, max(event_id) last_event FROM fb WHERE kind IN ('LIKE', 'DISLIKE') AND event_id % 7 <> 0 GROUP BY 1, 2")
def feedback_reversal(s, d):
    e = S.feedback_events(s, d)
    return V.reversed_preferences(e, e.filter("event_id % 7 = 0").select(F.col("event_id").alias("reverses_event_id")))


@query("event_sessions", "$BASE SELECT profile_id, CAST(max(sn) AS BIGINT) n_sessions FROM (SELECT profile_id, sum(CASE WHEN g IS NULL OR g > INTERVAL 24 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY profile_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) sn FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY profile_id ORDER BY ts, event_id) g FROM fb)) GROUP BY 1")
def event_sessions(s, d):
    return V.sessionized(S.feedback_events(s, d)).groupBy("profile_id").agg(F.max("session_no").cast("long").alias("n_sessions"))


@query("session_profile_merge", f"""$BASE, {VER}, p AS (SELECT * FROM v WHERE kind IN ('LIKE', 'DISLIKE') QUALIFY row_number() OVER (PARTITION BY profile_id, item_id ORDER BY version DESC, event_id DESC) = 1), s AS (SELECT * FROM p WHERE ts > {NOW} - INTERVAL 1 DAY), q AS (SELECT * FROM p WHERE ts > {NOW} - INTERVAL 180 DAY)
SELECT profile_id, item_id, coalesce(s.kind, q.kind) kind, greatest(s.version, q.version) AS version, CASE WHEN s.kind IS NOT NULL THEN 'session' ELSE 'profile' END AS scope FROM s FULL JOIN q USING (profile_id, item_id)""")
def session_profile_merge(s, d):
    e, now = S.feedback_events(s, d), _now(s, d)
    return V.session_over_profile(V.preferences(e, now, 1), V.preferences(e, now))


@query("exposure_set", f"$BASE SELECT DISTINCT profile_id, item_id FROM fb WHERE kind = 'CLICK' AND ts > {NOW} - INTERVAL 24 HOUR UNION SELECT profile_id, item_id FROM fb WHERE kind = 'EXPOSURE' AND ts > {NOW} - INTERVAL 24 HOUR")
def exposure_set(s, d):
    e, now = S.feedback_events(s, d), _now(s, d)
    delivered = e.filter((F.col("kind") == "CLICK") & (F.col("ts") > now - F.expr("INTERVAL 24 HOURS")))
    return V.exposure_set(delivered, e, now)


@query("session_activity", "SELECT conv_id session_id, min(turn) first_seq, max(turn) last_seq, count(*) n_entries, count(*) FILTER (role = 'user') user_entries, max_by(role, turn) last_role, CAST(sum(length(text)) AS BIGINT) chars FROM conversations GROUP BY 1")
def session_activity(s, d):
    return V.session_activity(S.table(s, d, "conversations"))


@query("checkpoint_recovery", "SELECT conv_id, turn, role, coalesce(c, -1) AS checkpoint FROM conversations LEFT JOIN (SELECT conv_id, max(turn) c FROM conversations WHERE (turn + 1) % 3 = 0 GROUP BY 1) USING (conv_id) WHERE turn > coalesce(c, -1)")
def checkpoint_recovery(s, d):
    return V.after_checkpoint(S.table(s, d, "conversations"))


@query("timeline_merge", "$BASE, u AS (SELECT 'event' kind, profile_id AS owner, event_id seq, kind what FROM fb UNION ALL SELECT 'turn', conv_id, turn, role FROM conversations) SELECT *, row_number() OVER (PARTITION BY owner ORDER BY seq, kind, what) place FROM u")
def timeline_merge(s, d):
    return V.timeline(S.feedback_events(s, d), S.table(s, d, "conversations"))


@query("run_monitor", """$BASE SELECT profile_id, phase, n, total, failed, n_items, concat_ws(',', CASE WHEN n > 10 THEN 'busy' END, CASE WHEN total > 1000 THEN 'slow' END, CASE WHEN failed = 1 THEN 'failed' END) signals FROM (SELECT profile_id,
CASE WHEN kind = 'EXPOSURE' THEN 'recall' WHEN kind IN ('CLICK', 'WHY') THEN 'interaction' WHEN kind = 'LIKE' THEN 'feedback' ELSE 'error' END phase, count(*) n, round(sum(value), 4) total, max(CAST(kind = 'DISLIKE' AS INT)) failed, count(DISTINCT item_id) n_items FROM fb GROUP BY 1, 2)""")
def run_monitor(s, d):
    return V.run_monitor(S.feedback_events(s, d))


@query("item_availability", "SELECT l_partkey item_id, count(*) n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) qty FROM lineitem GROUP BY 1")
def item_availability(s, d):
    return V.availability(S.table(s, d, "lineitem").select(F.col("l_partkey").alias("item_id"), F.col("l_quantity").cast("long").alias("qty")))


@query("guarded_stock_replay")
def guarded_stock_replay(s, d):
    log = S.table(s, d, "lineitem").select(F.col("l_partkey").alias("item_id"), F.col("l_quantity").cast("long").alias("qty"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return V.guarded_stock(log, 300)


@query("task_summary", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'O') pending, count(*) FILTER (o_orderstatus = 'F') finished, count(*) FILTER (o_orderstatus = 'P') in_review FROM orders GROUP BY 1")
def task_summary(s, d):
    return V.task_summary(S.table(s, d, "orders"))


@query("stalled_orders", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY ORDER BY o_orderdate, o_orderkey LIMIT 50")
def stalled_orders(s, d):
    o = S.table(s, d, "orders")
    now = F.lit(o.agg(F.max("o_orderdate")).first()[0])
    return o.filter((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < now - F.expr("INTERVAL 365 DAYS"))).orderBy("o_orderdate", "o_orderkey").limit(50).select("o_orderkey", "o_orderdate")


@query("catalog_page", "SELECT p_partkey item_id, p_name title FROM part WHERE p_type = (SELECT min(p_type) FROM part) AND p_partkey > 20 ORDER BY 1 LIMIT 20")
def catalog_page(s, d):
    i = S.items(s, d)
    first = i.agg(F.min("category")).first()[0]
    return i.filter((F.col("category") == first) & (F.col("item_id") > 20)).orderBy("item_id").limit(20).select("item_id", "title")


def flagship(s: SparkSession, d: str) -> DataFrame:
    return popular_by_category(s, d)
