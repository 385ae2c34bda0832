"""Further registered queries: seeded recall, pools of providers, model reranking, records and log projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomrec.operators import cleaning as K
from loomrec.operators import records as D
from loomrec.operators import recall as B
from loomrec.operators import rerank as N
from loomrec.operators import seeded as P
from loomrec.operators import semantic as M
from loomrec.operators.tables import once
from loomrec.plans import queries as Q
from loomrec.plans.queries import PARTS, SW, query
from loomrec.sources import star as S

# seeded recall: seen is the whole recent sequence, positive or not

RECENT = """recent AS (SELECT user_id, item_id, c - b + 1 pos, c len FROM (SELECT *, count(*) OVER (PARTITION BY user_id) c FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY row_num DESC) b FROM train) WHERE b <= 50)),
strong_first AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY m) - 1 seed_rank FROM (SELECT user_id, item_id, min(tier * 1000 + back) m FROM (
  SELECT user_id, item_id, 0 tier, row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) back FROM seq WHERE strong = 1 QUALIFY back <= 10 UNION ALL SELECT user_id, item_id, 1, len - pos + 1 FROM seq WHERE len - pos < 10) GROUP BY ALL))"""


def _lists(pairs: str, k: int, both: bool) -> str:
    mirror = f" UNION ALL SELECT dst, src, score FROM ({pairs})" if both else ""
    return f"lists AS (SELECT src, dst, score, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) rank FROM (SELECT src, dst, score FROM ({pairs}){mirror}) QUALIFY rank <= {k})"


def _seeded(seeds: str, decay: float, floor: float = 0.0, per_user: int = 1000) -> str:
    value = f"e.score * pow({decay}, s.seed_rank)"
    return f"""SELECT user_id, item_id, score, seed_item, seed_rank, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (
SELECT s.user_id, e.dst item_id, round({value}, 6) score, s.item_id seed_item, s.seed_rank FROM {seeds} s JOIN lists e ON e.src = s.item_id LEFT JOIN recent x ON x.user_id = s.user_id AND x.item_id = e.dst WHERE x.user_id IS NULL AND e.rank <= 20 AND {value} >= {floor}
QUALIFY row_number() OVER (PARTITION BY s.user_id, e.dst ORDER BY round({value}, 6) DESC, s.seed_rank) = 1) QUALIFY rank <= {per_user}"""


def _recent(s, d):
    return once(("recent", d), lambda: K.recent_events(Q._train(s, d), 50))


@query("strong_first_seeds", f"$BASE, {RECENT} SELECT * FROM strong_first")
def strong_first_seeds(s, d):
    return P.strong_first_seeds(S.recent_positives(s, d))


@query("swing_recall", f"$BASE, {RECENT}, {SW}, {_lists('SELECT a.item_id src, b.item_id dst, round(count(*) / (1 + sum(1.0 / a.n)), 6) score FROM w a JOIN w b USING (user_id) WHERE a.item_id < b.item_id GROUP BY 1, 2', 20, True)} {_seeded('strong_first', 1.0)}")
def swing_recall(s, d):
    seq = S.recent_positives(s, d)
    return P.seeded_recall(P.strong_first_seeds(seq), P.neighbour_lists(B.swing(seq, standard=False), 20), _recent(s, d))


@query("two_tower_seed_recall", f"""$BASE, {RECENT}, mb AS (SELECT item_id, coalesce(pop, 0) pop, unnest([{{'b': 'b:' || brand, 'w': 1.0}}, {{'b': 'c:' || category, 'w': 0.5}}]) x FROM items LEFT JOIN pop USING (item_id)), mh AS (SELECT item_id, pop, x.b b, x.w w FROM mb QUALIFY row_number() OVER (PARTITION BY x.b ORDER BY pop DESC, item_id) <= 10),
{_lists('SELECT m.item_id src, h.item_id dst, round(sum(h.w) + ln(1 + max(h.pop)) / 100, 6) score FROM mb m JOIN mh h ON m.x.b = h.b WHERE m.item_id <> h.item_id GROUP BY ALL', 10, False)} {_seeded('strong_first', 0.8, 0.2)}""")
def two_tower_seed_recall(s, d):
    """Lists by item metadata stand for the lists of a trained tower, which has the same shape."""
    edges = M.metadata_neighbours(S.items(s, d), Q._pop(s, d), 10, 10)
    return P.seeded_recall(P.strong_first_seeds(S.recent_positives(s, d)), edges, _recent(s, d), decay=0.8, floor=0.2)


@query("graph_walk_seed_recall", f"""$BASE, {RECENT}, g AS (SELECT a.item_id src, b.item_id dst, sum(1 / (b.pos - a.pos)) w FROM seq a JOIN seq b USING (user_id) WHERE b.pos > a.pos AND b.pos <= a.pos + 3 GROUP BY ALL), p AS (SELECT item_id dst, count(*) p FROM seq GROUP BY 1),
{_lists('SELECT src, dst, round(w / sqrt(p), 6) score FROM g JOIN p USING (dst)', 10, False)} {_seeded('strong_first', 0.8, 0.01)}""")
def graph_walk_seed_recall(s, d):
    seq = S.recent_positives(s, d)
    return P.seeded_recall(P.strong_first_seeds(seq), B.co_visit(seq), _recent(s, d), decay=0.8, floor=0.01)


@query("session_transition_recall", f"$BASE, {RECENT}, seeds AS (SELECT user_id, item_id, len - pos seed_rank FROM recent WHERE len - pos < 10), {_lists('SELECT src, dst, CAST(count(*) AS DOUBLE) score FROM (SELECT item_id src, lead(item_id) OVER (PARTITION BY user_id ORDER BY pos) dst FROM seq) WHERE dst IS NOT NULL GROUP BY 1, 2', 20, False)} {_seeded('seeds', 0.8, 0.0, 30)}")
def session_transition_recall(s, d):
    seen = _recent(s, d)
    edges = B.session_transition(S.recent_positives(s, d)).withColumn("score", F.col("n").cast("double"))
    return P.seeded_recall(P.recent_seeds(seen, 10), P.neighbour_lists(edges, 20, both=False), seen, per_user=30, decay=0.8)


@query("multi_interest_recall", f"$BASE, {RECENT}, seeds AS (SELECT user_id, item_id, len - pos seed_rank FROM seq WHERE len - pos < 20), {_lists('SELECT a.item_id src, b.item_id dst, round(sum(1 + CASE WHEN a.pos > a.len - 3 AND b.pos > b.len - 3 THEN 0.5 ELSE 0 END), 6) score FROM seq a JOIN seq b USING (user_id) WHERE a.item_id < b.item_id GROUP BY 1, 2', 20, True)} {_seeded('seeds', 0.8, 0.0, 30)}")
def multi_interest_recall(s, d):
    seq = S.recent_positives(s, d)
    return P.seeded_recall(P.recent_seeds(seq, 20), P.neighbour_lists(B.multi_interest(seq), 20), _recent(s, d), per_user=30, decay=0.8)


@query("co_visit_sets", f"$BASE, {RECENT}, own AS (SELECT DISTINCT user_id, item_id FROM recent), ok AS (SELECT item_id FROM own GROUP BY 1 HAVING count(*) <= 500) SELECT src, dst, score, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM (SELECT a.item_id src, b.item_id dst, CAST(count(*) AS DOUBLE) score FROM own a JOIN own b USING (user_id) JOIN ok ON ok.item_id = b.item_id WHERE a.item_id <> b.item_id GROUP BY 1, 2) WHERE score >= 2 QUALIFY rank <= 20")
def co_visit_sets(s, d):
    return P.co_visit_sets(_recent(s, d), 500, 2.0)


# pools of providers

MICRO = 3.7e-10  # beside the fourth decimal of a millionth: sums of rounded parts then fall alike on both sides


@query("provided_pool", f"""$BASE, {RECENT}, {PARTS}, one AS (SELECT p.user_id, p.item_id, round(p.score + 3.7e-10, 6) score, source, src_no FROM parts p LEFT JOIN recent x ON x.user_id = p.user_id AND x.item_id = p.item_id WHERE x.user_id IS NULL),
firsts AS (SELECT user_id, item_id, min(src_no) f FROM one GROUP BY 1, 2), held_by AS (SELECT user_id, f, sum(count(*)) OVER (PARTITION BY user_id ORDER BY f) h FROM firsts GROUP BY 1, 2),
lst AS (SELECT user_id, coalesce(min(f) FILTER (h >= 30), 2) AS last_step, max(h) most FROM held_by GROUP BY 1),
agg AS (SELECT user_id, item_id, min(src_no) f, round(sum(score), 6) score, string_agg(source, ',' ORDER BY src_no) sources, CAST(max(most) < 30 AS INT) underfilled FROM one JOIN lst USING (user_id) WHERE src_no <= last_step GROUP BY 1, 2)
SELECT user_id, item_id, score, sources, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank, max(CAST(f > 0 AS INT)) OVER (PARTITION BY user_id) fallback_used, underfilled FROM agg QUALIFY rank <= 30""")
def provided_pool(s, d):
    parts, _ = P.available({n: (lambda df=df: df.withColumn("score", F.round(F.col("score") + MICRO, 6))) for n, df in Q._parts(s, d).items()})
    return P.provided_pool({"itemcf": parts["itemcf"]}, {"category": parts["category"], "popular": parts["popular"]}, _recent(s, d), 30)


@query("extra_candidate_merge", f"""$BASE, {PARTS}, long AS (SELECT user_id, item_id, 'itemcf' source, 100.0 - rank score, '' category, 0 late FROM cfrec UNION ALL SELECT user_id, item_id, CASE WHEN item_id % 2 = 0 THEN 'itemcf' ELSE 'popular' END, 110.0 - rank, 'p', 1 FROM poprec),
best AS (SELECT user_id, item_id, source, max(score) score, min(late) late, max(category) category FROM long GROUP BY 1, 2, 3)
SELECT user_id, item_id, string_agg(source, ',' ORDER BY late, source) sources, string_agg(format('{{:.4f}}', CAST(score AS DOUBLE)), ',' ORDER BY late, source) source_scores, nullif(max(category), '') category FROM best GROUP BY 1, 2""")
def extra_candidate_merge(s, d):
    own = Q._cf_recall(s, d).select("user_id", "item_id", F.lit("itemcf").alias("source"), (100.0 - F.col("rank")).alias("score"), F.lit("").alias("category"))
    source = F.when(F.col("item_id") % 2 == 0, "itemcf").otherwise("popular")
    extra = Q._popular(s, d).select("user_id", "item_id", source.alias("source"), (110.0 - F.col("rank")).alias("score"), F.lit("p").alias("category"))
    return P.merge_extra(own, extra)


# reranking

COLD = "cold AS (SELECT c.user_id, c.item_id, round(0.8 * coarse + 0.3 * n_sources, 6) cold_score, coarse_rank, CAST(h.user_id IS NOT NULL AS INT) label FROM coarse c LEFT JOIN held h USING (user_id, item_id)), kept AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cold_score DESC, coarse_rank, item_id) cold_rank FROM cold QUALIFY cold_rank <= 15)"


def _labelled(s, d):
    held = Q._held(s, d).withColumn("label", F.lit(1))
    return once(("labelled", d), lambda: Q._coarse(s, d).join(held, ["user_id", "item_id"], "left").na.fill(0, ["label"]))


def _cold(rows):
    return N.cold_rank(rows, 0.8 * F.col("coarse") + 0.3 * F.col("n_sources"), "coarse_rank", 15)


@query("item_feature_rerank", f"""$BASE, {PARTS} SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY reranked DESC, item_id) rerank FROM (SELECT *, round(coarse + delta, 6) reranked FROM (SELECT user_id, item_id, coarse, multi_source, popular_only, round(multi_source * 0.25 + popular_only * -0.5, 6) delta FROM (
SELECT user_id, item_id, coarse, CAST(contains(sources, ',') AS INT) multi_source, CAST(sources = 'popular' AS INT) popular_only FROM coarse)))""")
def item_feature_rerank(s, d):
    rows = Q._coarse(s, d).select("user_id", "item_id", "coarse", "sources")
    return N.feature_rerank(rows, N.source_features(F.col("sources")), {"multi_source": 0.25, "popular_only": -0.5}, "coarse").drop("sources")


@query("model_rerank", f"""$BASE, {PARTS} SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY model_final DESC, item_id) model_rank FROM (SELECT *, round(fine + ltr_score + deep_score, 6) model_final FROM (SELECT user_id, item_id, fine, round(0.02 * len(string_split(sources, ',')), 6) ltr_score,
CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY fine DESC, item_id) <= 10 THEN round(0.1 / (1 + exp(-coarse)), 6) ELSE 0.0 END deep_score FROM ranked))""")
def model_rerank(s, d):
    rows = Q._ranked(s, d).select("user_id", "item_id", "fine", "coarse", "sources")
    return N.model_rerank(rows, "fine", 0.02 * F.size(F.split("sources", ",")), 0.1 / (1 + F.exp(-F.col("coarse"))), 10).drop("coarse", "sources")


@query("cold_ranking", f"$BASE, {PARTS}, {COLD} SELECT * FROM kept")
def cold_ranking(s, d):
    return _cold(_labelled(s, d)).select("user_id", "item_id", "cold_score", "coarse_rank", "label", "cold_rank")


@query("cold_survival", f"$BASE, {PARTS}, {COLD} SELECT *, CASE WHEN positive_before > 0 THEN round(positive_after / positive_before, 6) ELSE 0 END positive_survival FROM (SELECT count(*) rows_before, count(*) FILTER (label = 1) positive_before FROM cold), (SELECT count(*) rows_after, count(*) FILTER (label = 1) positive_after FROM kept)")
def cold_survival(s, d):
    rows = _labelled(s, d)
    return N.survival(rows, _cold(rows))


@query("pairwise_perceptron")
def pairwise_perceptron(s, d):
    rows = _labelled(s, d).withColumn("is_itemcf", F.contains("sources", F.lit("itemcf")).cast("int"))
    weights = N.pairwise_perceptron(rows, ["coarse", "is_itemcf", "n_sources"])
    return s.createDataFrame(sorted(weights.items()), "feature string, weight double")


@query("rank_array_metrics", f"""$BASE, {PARTS}, r AS (SELECT coarse_rank rank FROM held LEFT JOIN coarse USING (user_id, item_id)) SELECT count(*) n, round(avg(CAST(coalesce(rank <= 10, false) AS INT)), 6) hit_10, round(avg(CAST(coalesce(rank <= 50, false) AS INT)), 6) hit_50, round(avg(CAST(coalesce(rank <= 100, false) AS INT)), 6) hit_100,
round(avg(CAST(rank IS NOT NULL AS INT)), 6) coverage, round(avg(coalesce(1 / rank, 0)), 6) mrr, round(avg(CASE WHEN rank <= 100 THEN 1 / log2(rank + 1) ELSE 0 END), 6) ndcg_100 FROM r""")
def rank_array_metrics(s, d):
    ranks = Q._held(s, d).join(Q._coarse(s, d).select("user_id", "item_id", F.col("coarse_rank").alias("rank")), ["user_id", "item_id"], "left")
    return N.rank_metrics(ranks)


# records and logs


@query("record_profiles", """$BASE, n AS (SELECT item_id, nullif(trim(title), '') title, nullif(trim(category), '') category, trim(array_to_string(categories, ' > ')) category_path, nullif(trim(brand), '') store FROM items),
m AS (SELECT *, trim(string_split(category_path, '>')[1]) main_category FROM n)
SELECT item_id, main_category, concat_ws(' | ', title, main_category, store) compact, CASE WHEN length(p) > 90 THEN rtrim(substr(p, 1, 90), ' ' || chr(10)) ELSE p END profile FROM (SELECT *, concat_ws(chr(10), 'Title: ' || title, 'Category: ' || category_path, 'Store: ' || store) p FROM m)""")
def record_profiles(s, d):
    r = D.normalise_records(S.items(s, d).withColumnRenamed("categories", "categories_path"))
    return r.select("item_id", "main_category", D.compact_text(["title", "main_category", "store"]).alias("compact"), D.profile_text(90).alias("profile"))


@query("source_line_filter", "$BASE SELECT user_id, item_id, ord line FROM raw WHERE ord IN (SELECT ord FROM train)")
def source_line_filter(s, d):
    rows = S.raw_interactions(s, d).select("user_id", "item_id", F.col("ord").alias("line"))
    return D.source_lines(rows, Q._train(s, d).select(F.col("ord").alias("line")))


@query("split_boundaries", "$BASE SELECT boundary, row_num, user_id, item_id, ts FROM inter JOIN (SELECT split boundary, max(row_num) row_num FROM inter GROUP BY 1) USING (row_num)")
def split_boundaries(s, d):
    i = S.interactions(s, d)
    places = i.groupBy(F.col("split").alias("boundary")).agg(F.max("row_num").alias("row_num"))
    return D.rows_at(i, places).select("boundary", "row_num", "user_id", "item_id", "ts")


@query("turn_projection", "SELECT conv_id session_id, CAST(turn // 2 AS BIGINT) turn_no, min(turn) first_seq, max(turn) last_seq, max_by(role, turn) last_role, count(*) n_entries FROM conversations GROUP BY 1, 2")
def turn_projection(s, d):
    e = S.table(s, d, "conversations").select(F.col("conv_id").alias("session_id"), F.floor(F.col("turn") / 2).cast("long").alias("turn_no"), F.col("turn").alias("seq"), "role")
    return D.turn_projection(e)


@query("tool_call_projection", "$BASE SELECT session_id, tool_call_id, max(kind) FILTER (r = 1) status, min(ts) created_at, max(ts) updated_at, count(*) n_events FROM (SELECT profile_id session_id, item_id tool_call_id, kind, ts, row_number() OVER (PARTITION BY profile_id, item_id ORDER BY ts DESC, event_id DESC) r FROM fb WHERE item_id IS NOT NULL) GROUP BY 1, 2")
def tool_call_projection(s, d):
    log = S.feedback_events(s, d).select(F.col("profile_id").alias("session_id"), F.col("item_id").alias("tool_call_id"), F.col("kind").alias("status"), "ts", F.col("event_id").alias("seq"))
    return D.tool_call_projection(log)


@query("batch_append", "$BASE SELECT event_id // 20 AS batch, event_id, kind, item_id FROM fb WHERE event_id // 20 NOT IN (SELECT event_id // 20 FROM fb WHERE NOT coalesce(kind <> 'WHY' OR item_id % 7 <> 0, false))")
def batch_append(s, d):
    e = S.feedback_events(s, d).select(F.floor(F.col("event_id") / 20).cast("long").alias("batch"), "event_id", "kind", "item_id")
    return D.append_batches(e, (F.col("kind") != "WHY") | (F.col("item_id") % 7 != 0)).select("batch", "event_id", "kind", "item_id")


@query("pool_user_profiles", """$BASE, nu AS (SELECT item_id, count(DISTINCT user_id) k FROM pos GROUP BY 1) SELECT *, CASE WHEN positive_count >= 10 AND unique_item_count >= 5 AND shared_item = 1 THEN 'heavy' WHEN positive_count >= 4 AND unique_item_count >= 2 THEN 'medium' ELSE 'fallback' END bucket FROM (
SELECT user_id, count(*) positive_count, count(DISTINCT item_id) unique_item_count, count(DISTINCT category) category_count, max(CAST(k > 1 AS INT)) shared_item FROM pos JOIN nu USING (item_id) LEFT JOIN items USING (item_id) GROUP BY 1)""")
def pool_user_profiles(s, d):
    return D.pool_profiles(S.train_positives(s, d), S.items(s, d), (10, 5), (4, 2))
