"""Every operator as a query over the star schema, each with the same question in DuckDB SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.metrics import dot
from ..operators import baskets as bk
from ..operators import cleaning, collaborative, content, factors, gradient, graph, rules, split
from ..scratch import Scratch
from ..sources import readers
from ..sources.readers import table
from . import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MIN_SUPPORT, MIN_CONFIDENCE = 0.005, 0.1


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


POSTINGS = """each as (select distinct l_orderkey as basket_id, p_brand as stock from lineitem join part on l_partkey = p_partkey),
postings as (select * from each where basket_id in (select basket_id from each group by basket_id having count(*) >= 2)),
total as (select count(distinct basket_id) as n from postings)"""
RATINGS = """ratings as (select o_custkey as userId, l_partkey as movieId, cast(ceil(l_quantity / 10) as double) as rating, cast(epoch(l_shipdate) as bigint) as timestamp,
 l_orderkey, l_linenumber, l_quantity, l_extendedprice from lineitem join orders on l_orderkey = o_orderkey)"""
LAST = RATINGS + """, last as (select userId, movieId, rating from (select *, row_number() over (partition by userId, movieId order by timestamp desc, l_orderkey desc, l_linenumber desc, l_quantity desc, l_extendedprice desc) as k from ratings) where k = 1)"""
PARTS = RATINGS + """, ranked as (select *, row_number() over (partition by userId order by timestamp, l_orderkey, l_linenumber, l_quantity, l_extendedprice, movieId) as k, count(*) over (partition by userId) as n from ratings),
parts as (select * exclude (k, n), case when n < 5 then 'excluded' when k <= floor(n * 0.8::double) then 'train' when k <= floor(n * 0.8::double) + floor(n * 0.1::double) then 'val' else 'test' end as part from ranked)"""
SPLIT_ORDER = [*views.TIME_ORDER, "movieId"]
ITEMSETS = POSTINGS + f""", least as (select n, {MIN_SUPPORT} as s from total),
s1 as (select [stock] as items, count(*) as c from postings, least group by stock, n, s having count(*) / n >= s),
s2 as (select [a.stock, b.stock] as items, count(*) as c from postings a join postings b on a.basket_id = b.basket_id and a.stock < b.stock, least group by a.stock, b.stock, n, s having count(*) / n >= s),
s3 as (select [a.stock, b.stock, d.stock] as items, count(*) as c from postings a join postings b on a.basket_id = b.basket_id and a.stock < b.stock join postings d on d.basket_id = b.basket_id and b.stock < d.stock, least group by a.stock, b.stock, d.stock, n, s having count(*) / n >= s),
s4 as (select [a.stock, b.stock, d.stock, e.stock] as items, count(*) as c from postings a join postings b on a.basket_id = b.basket_id and a.stock < b.stock join postings d on d.basket_id = b.basket_id and b.stock < d.stock join postings e on e.basket_id = d.basket_id and d.stock < e.stock, least group by a.stock, b.stock, d.stock, e.stock, n, s having count(*) / n >= s),
sets as (select * from s1 union all select * from s2 union all select * from s3 union all select * from s4)"""
RULES = ITEMSETS + f""", masks as (select items, c, unnest(generate_series(1, cast(pow(2, len(items)) as bigint) - 2)) as m from sets where len(items) >= 2),
sides as (select list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 1) as a, list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 0) as b, c from masks),
rules as (select array_to_string(s.a, ',') as antecedent, array_to_string(s.b, ',') as consequent, s.c as joint, x.c as antecedent_count, y.c as consequent_count,
 s.c / n as support, s.c / x.c as confidence, (s.c / x.c) / (y.c / n) as lift from sides s join sets x on x.items = s.a join sets y on y.items = s.b, total where s.c / x.c >= {MIN_CONFIDENCE})"""
RULE_COLUMNS = "antecedent, consequent, joint, antecedent_count, consequent_count, round(support, 9) as support, round(confidence, 9) as confidence, round(lift, 9) as lift"
VECTORS = """vectors as (select vec_id as id, list_transform(embedding, lambda x: cast(x as double)) as f from embeddings)"""
LOG = """log as (select case when o_orderstatus = 'F' then 'C' else '' end || cast(l_orderkey as varchar) as invoice,
 case when p_size = 1 then 'b' when p_size = 3 then '' else ' ' || lower(p_brand) end as code,
 case when p_size = 2 then '  ' when p_size = 4 then 'Postage' else ' ' || p_name || '  . ' end as description,
 case when l_tax = 0.01 then 'many' else cast(cast(l_quantity as int) - 2 as varchar) end as quantity,
 case when p_size = 5 then '0' else '1.25' end as price, case when p_size = 6 then '' else cast(o_custkey as varchar) end as customer
 from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey),
reasoned as (select invoice, upper(trim(code)) as stock, description, case
 when invoice[1] in ('C', 'A') then 'cancellation_or_adjustment' when trim(description) = '' then 'blank_description'
 when try_cast(quantity as double) is null or try_cast(price as double) is null then 'bad_number' when cast(quantity as double) <= 0 then 'quantity'
 when cast(price as double) <= 0 then 'price' when trim(customer) = '' then 'blank_customer' when trim(code) = '' then 'blank_code'
 when upper(trim(description)) = 'POSTAGE' or upper(trim(code)) = 'B' then 'non_product' end as reason from log),
kept as (select invoice, stock, case when trim(regexp_replace(t, '[.,;:!?]+$', '')) = '' then t else trim(regexp_replace(t, '[.,;:!?]+$', '')) end as d
 from (select invoice, stock, upper(trim(regexp_replace(description, '\\s+', ' ', 'g'))) as t from reasoned where reason is null)),
canonical as (select stock, d as description from (select stock, d, row_number() over (partition by stock order by count(*) desc, d) as k from kept group by stock, d) where k = 1),
lines as (select distinct invoice, stock from kept),
retail as (select * from lines join canonical using (stock) where invoice in (select invoice from lines group by invoice having count(*) >= 2)),
dictionary as (select row_number() over (order by count(*) desc, stock) - 1 as idx, stock, description, count(*) as n from retail group by stock, description)"""


def _plain(r: DataFrame) -> DataFrame:
    """Rules with sides as text and rounded metrics."""
    return r.select(F.array_join("antecedent", ",").alias("antecedent"), F.array_join("consequent", ",").alias("consequent"), "joint", "antecedent_count", "consequent_count", *[F.round(c, 9).alias(c) for c in ("support", "confidence", "lift")])


def _pair_rules(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """Both directions of every pair, from one self-join of postings."""
    index = views.postings(spark, sf)
    n = index.agg(F.count_distinct("basket_id")).first()[0]
    single = index.groupBy("stock").agg(F.count(F.lit(1)).alias("c"))
    both = index.join(index.withColumnRenamed("stock", "other"), "basket_id").where("stock <> other").groupBy("stock", "other").agg(F.count(F.lit(1)).alias("joint"))
    r = both.join(single.toDF("stock", "antecedent_count"), "stock").join(single.toDF("other", "consequent_count"), "other")
    r = r.select(F.array("stock").alias("antecedent"), F.array("other").alias("consequent"), "joint", "antecedent_count", "consequent_count")
    return rules.with_metrics(r, F.lit(n)).where((F.col("support") >= MIN_SUPPORT) & (F.col("confidence") >= MIN_CONFIDENCE)), n


PAIR_RULES = POSTINGS + f""", single as (select stock, count(*) as c from postings group by stock),
pairs as (select a.stock as x, b.stock as y, count(*) as joint from postings a join postings b on a.basket_id = b.basket_id and a.stock <> b.stock group by all),
rules as (select x as antecedent, y as consequent, joint, s.c as antecedent_count, t.c as consequent_count, joint / n as support, joint / s.c as confidence, (joint / s.c) / (t.c / n) as lift
 from pairs join single s on s.stock = x join single t on t.stock = y, total where joint / n >= {MIN_SUPPORT} and joint / s.c >= {MIN_CONFIDENCE})"""


@query(f"with {PAIR_RULES} select {RULE_COLUMNS} from rules")
def assoc_rules_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(_pair_rules(spark, sf)[0])


@query(f"with {PAIR_RULES} select {RULE_COLUMNS} from rules where lift > 1")
def assoc_rules_lift_gt1(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(rules.lift_above(_pair_rules(spark, sf)[0]))


@query(f"with {PAIR_RULES} select consequent as antecedent, antecedent as consequent, joint, consequent_count as antecedent_count, antecedent_count as consequent_count, round(support, 9) as support, round(joint / consequent_count, 9) as confidence, round((joint / consequent_count) / (antecedent_count / n), 9) as lift from rules, total")
def rule_reverse(spark: SparkSession, sf: str) -> DataFrame:
    r, n = _pair_rules(spark, sf)
    return _plain(rules.reverse(r, F.lit(n)))


@query(f"with {POSTINGS}, single as (select stock, count(*) as c from postings group by stock), want as (select distinct p_brand as x, 'Brand#11' as y from part where p_brand <> 'Brand#11') select x as antecedent, y as consequent, coalesce(j, 0) as joint, coalesce(s.c, 0) as antecedent_count, coalesce(t.c, 0) as consequent_count, round(coalesce(j, 0) / n, 9) as support, round(coalesce(coalesce(j, 0) / s.c, 0), 9) as confidence, round(coalesce((coalesce(j, 0) / s.c) / (t.c / n), 0), 9) as lift from want left join (select a.stock as x, b.stock as y, count(*) as j from postings a join postings b using (basket_id) group by all) p using (x, y) left join single s on s.stock = x left join single t on t.stock = y, total")
def rule_enrich(spark: SparkSession, sf: str) -> DataFrame:
    index = views.postings(spark, sf)
    n = index.agg(F.count_distinct("basket_id")).first()[0]
    bare = table(spark, sf, "part").select("p_brand").distinct().where("p_brand <> 'Brand#11'").select(F.array("p_brand").alias("antecedent"), F.array(F.lit("Brand#11")).alias("consequent"))
    return _plain(rules.enrich(bare, index, n))


@query(f"with {RULES} select {RULE_COLUMNS} from rules")
def rule_enrich_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Rules of up to four items, known by their sides only, with counts from the postings."""
    b = Scratch(spark, "baskets").save(views.baskets(spark, sf))
    n = b.count()
    bare = rules.generate_rules(bk.frequent_itemsets(b, MIN_SUPPORT), n, MIN_CONFIDENCE).select("antecedent", "consequent")
    return _plain(rules.enrich(bare, bk.postings(b), n))


@query(f"with {ITEMSETS} select array_to_string(items, ',') as items, c as count, round(c / n, 9) as support from sets, total")
def frequent_itemsets(spark: SparkSession, sf: str) -> DataFrame:
    b = Scratch(spark, "baskets").save(views.baskets(spark, sf).select("items"))
    found = bk.frequent_itemsets(b, MIN_SUPPORT)
    return found.select(F.array_join("items", ",").alias("items"), "count", F.round("support", 9).alias("support"))


@query(f"with {ITEMSETS} select array_to_string(items, ',') as items, c as count, round(c / n, 9) as support from sets, total where len(items) <= 3")
def frequent_itemsets_1_3(spark: SparkSession, sf: str) -> DataFrame:
    b = Scratch(spark, "baskets").save(views.baskets(spark, sf).select("items"))
    found = bk.small_itemsets_of(b, b.count(), MIN_SUPPORT, 3)
    return found.select(F.array_join("items", ",").alias("items"), "count", F.round("support", 9).alias("support"))


@query(f"with {RULES} select {RULE_COLUMNS} from rules")
def assoc_rules_all_splits(spark: SparkSession, sf: str) -> DataFrame:
    b = Scratch(spark, "baskets").save(views.baskets(spark, sf).select("items"))
    return _plain(rules.generate_rules(bk.frequent_itemsets(b, MIN_SUPPORT), b.count(), MIN_CONFIDENCE))


@query(f"with {POSTINGS} select stock, count(*) as n from postings group by stock")
def basket_item_counts(spark: SparkSession, sf: str) -> DataFrame:
    return bk.item_counts(views.postings(spark, sf))


@query(f"with {POSTINGS} select stock, count(*) as n from postings group by stock order by n desc, stock limit 5")
def basket_top5(spark: SparkSession, sf: str) -> DataFrame:
    return bk.item_counts(views.postings(spark, sf)).orderBy(F.desc("n"), "stock").limit(5)


@query(f"with {POSTINGS} select stock, count(*) as n from postings group by stock order by n desc, stock limit 10")
def basket_top10(spark: SparkSession, sf: str) -> DataFrame:
    return bk.item_counts(views.postings(spark, sf)).orderBy(F.desc("n"), "stock").limit(10)


@query(f"with {POSTINGS} select count(*) as n from (select basket_id from postings where stock in ('Brand#11', 'Brand#12') group by basket_id having count(*) = 2)")
def count_itemset(spark: SparkSession, sf: str) -> DataFrame:
    return bk.count_itemset(views.postings(spark, sf), ["Brand#11", "Brand#12", "Brand#11"])


@query(f"with {POSTINGS} select stock, count(*) as n, md5(string_agg(cast(basket_id as varchar), ',' order by basket_id)) as ids_md5 from postings group by stock")
def inverted_index(spark: SparkSession, sf: str) -> DataFrame:
    sets = bk.posting_sets(views.postings(spark, sf))
    return sets.select("stock", F.size("basket_ids").cast("long").alias("n"), F.md5(F.array_join(F.transform("basket_ids", lambda x: x.cast("string")), ",")).alias("ids_md5"))


@query(f"with {POSTINGS} select stock, cast(case when basket_id > 0 then (basket_id - 1) // 32768 + 1 else -(-basket_id // 32768) end as bigint) as bucket, count(*) as n, md5(string_agg(cast(basket_id as varchar), ',' order by basket_id)) as ids_md5 from postings group by all")
def inverted_index_bitmaps(spark: SparkSession, sf: str) -> DataFrame:
    ids = bk.bitmap_ids(bk.posting_bitmaps(views.postings(spark, sf)))
    return ids.select("stock", "bucket", F.size("basket_ids").cast("long").alias("n"), F.md5(F.array_join(F.transform("basket_ids", lambda x: x.cast("string")), ",")).alias("ids_md5"))


@query(f"with {POSTINGS} select stock, count(*) as n from postings group by stock")
def bitmap_item_counts(spark: SparkSession, sf: str) -> DataFrame:
    return bk.bitmap_counts(bk.posting_bitmaps(bk.numbered(views.postings(spark, sf))))


@query(f"with {POSTINGS} select count(*) as n from (select basket_id from postings where stock in ('Brand#11', 'Brand#12') group by basket_id having count(*) = 2)")
def count_itemset_bitmaps(spark: SparkSession, sf: str) -> DataFrame:
    return bk.count_in_bitmaps(bk.posting_bitmaps(views.postings(spark, sf)), ["Brand#11", "Brand#12", "Brand#11"])


@query("select cast(l_orderkey as bigint) as basket_id, array_to_string(list(p_brand order by k), ',') as items from (select l_orderkey, p_brand, min(struct_pack(a := l_linenumber, b := l_partkey, c := l_quantity)) as k from lineitem join part on l_partkey = p_partkey group by l_orderkey, p_brand) group by l_orderkey")
def basket_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    raw = lines.groupBy(F.col("l_orderkey").alias("basket_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "p_brand"))), lambda x: x["p_brand"]).alias("raw"))
    return raw.select("basket_id", F.array_join(bk.dedupe("raw"), ",").alias("items"))


@query("""with m as (select p_partkey as id, p_name as title, list_distinct(list_concat(string_split(p_name, ' '), [p_type])) as g from part), liked as (select g from m where id = (select min(p_partkey) from part))
select id, title, round(coalesce(len(list_intersect(m.g, liked.g)) / len(list_distinct(list_concat(m.g, liked.g))), 0), 9) as score from m, liked where id <> (select min(p_partkey) from part) order by score desc, id limit 2""")
def jaccard_top2(spark: SparkSession, sf: str) -> DataFrame:
    m = views.movies(spark, sf)
    liked = m.agg(F.min("id")).first()[0]
    return content.similar_to(m, liked).select("id", "title", F.round("score", 9).alias("score"))


@query("select p_partkey as id, p_name as title from part order by title, id")
def movies_by_title(spark: SparkSession, sf: str) -> DataFrame:
    return views.movies(spark, sf).orderBy(F.expr("title COLLATE UNICODE"), "id").select("id", "title")


@query("select p_partkey as id, p_name as title, row_number() over (order by p_name, p_partkey) as place from part")
def movies_in_title_order(spark: SparkSession, sf: str) -> DataFrame:
    return content.by_title(views.movies(spark, sf))


@query(f"with {LAST} select userId, movieId, rating from last")
def rating_matrix_long(spark: SparkSession, sf: str) -> DataFrame:
    return views.last_ratings(spark, sf)


@query(f"with {RATINGS} select count(*) as n_ratings, count(distinct userId) as n_users, count(distinct movieId) as n_items, max(userId) as max_user, max(movieId) as max_item from ratings")
def dataset_shape(spark: SparkSession, sf: str) -> DataFrame:
    return split.dataset_shape(views.ratings(spark, sf))


@query(f"""with {LAST}, dots as (select a.userId as a, b.userId as b, sum(a.rating * b.rating) as xy, sum(a.rating * a.rating) as xx, sum(b.rating * b.rating) as yy from last a join last b on a.movieId = b.movieId and a.userId <> b.userId group by 1, 2),
sims as (select a, b, round(xy / sqrt(xx * yy), 12) as sim from dots), near as (select * from (select *, row_number() over (partition by a order by sim desc, b) as k from sims where sim > 0) where k <= 20),
votes as (select a, movieId as i, round(sum(sim * rating) / sum(sim), 9) as score from near join last on b = userId group by 1, 2),
fresh as (select v.* from votes v left join last l on v.a = l.userId and v.i = l.movieId where l.userId is null)
select a as userId, i as movieId, round(score, 6) as score, rank from (select *, cast(row_number() over (partition by a order by score desc, i) as int) as rank from fresh) where rank <= 5""")
def user_cf_top5(spark: SparkSession, sf: str) -> DataFrame:
    r = Scratch(spark, "ratings").save(views.last_ratings(spark, sf))
    return collaborative.user_based(r, r.select("userId").distinct()).select("userId", "movieId", F.round("score", 6).alias("score"), "rank")


def _summed(sims: DataFrame) -> DataFrame:
    """Similarities by user: how many, of how many shared entries, their sum and the best."""
    return sims.groupBy("a").agg(F.count(F.lit(1)).alias("pairs"), F.sum("n").alias("shared"), F.round(F.sum("sim"), 4).alias("total"), F.round(F.max("sim"), 6).alias("best"))


@query(f"""with {LAST}, dots as (select a.userId as a, b.userId as b, sum(a.rating * b.rating) as xy, sum(a.rating * a.rating) as xx, sum(b.rating * b.rating) as yy, count(*) as n from last a join last b on a.movieId = b.movieId and a.userId <> b.userId group by 1, 2)
select a, count(*) as pairs, sum(n)::bigint as shared, round(sum(round(xy / sqrt(xx * yy) * n / (n + 1), 12)), 4) as total, round(max(round(xy / sqrt(xx * yy) * n / (n + 1), 12)), 6) as best from dots group by a""")
def user_similarity_weighted(spark: SparkSession, sf: str) -> DataFrame:
    # saved, since both sides of the product come from it
    r = Scratch(spark, "ratings").save(views.last_ratings(spark, sf))
    s = collaborative.similarities(r, "userId", "movieId", strategy="weighted")
    return _summed(s)


@query(f"""with {LAST}, own as (select userId as u, avg(rating) as m from last group by 1), met as (select distinct a.userId as a, b.userId as b from last a join last b on a.movieId = b.movieId and a.userId <> b.userId),
cells as (select a, b, movieId as i from met join last on userId = a union select a, b, movieId from met join last on userId = b),
filled as (select c.a, c.b, coalesce(x.rating, p.m) as x, coalesce(y.rating, q.m) as y, x.rating is not null and y.rating is not null as co from cells c left join last x on x.userId = c.a and x.movieId = c.i left join last y on y.userId = c.b and y.movieId = c.i join own p on p.u = c.a join own q on q.u = c.b)
select a, count(*) as pairs, sum(n)::bigint as shared, round(sum(sim), 4) as total, round(max(sim), 6) as best from (select a, b, count(*) filter (co) as n, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 12) as sim from filled group by a, b) group by a""")
def user_similarity_mean(spark: SparkSession, sf: str) -> DataFrame:
    # saved, since both sides of the product come from it
    r = Scratch(spark, "ratings").save(views.last_ratings(spark, sf))
    s = collaborative.similarities(r, "userId", "movieId", strategy="mean")
    return _summed(s)


@query(f"""with {LAST}, dots as (select a.movieId as a, b.movieId as b, sum(a.rating * b.rating) as xy, sum(a.rating * a.rating) as xx, sum(b.rating * b.rating) as yy from last a join last b on a.userId = b.userId and a.movieId <> b.movieId group by 1, 2),
sims as (select a, b, round(xy / sqrt(xx * yy), 12) as sim from dots), votes as (select l.userId as u, b as i, round(sum(sim * rating), 9) as score from last l join sims on l.movieId = a where sim > 0 group by 1, 2),
fresh as (select v.* from votes v left join last l on v.u = l.userId and v.i = l.movieId where l.userId is null)
select u as userId, i as movieId, round(score, 6) as score, rank from (select *, cast(row_number() over (partition by u order by score desc, i) as int) as rank from fresh) where rank <= 5""")
def item_cf_top5(spark: SparkSession, sf: str) -> DataFrame:
    # saved, since the users come from it too
    r = Scratch(spark, "ratings").save(views.last_ratings(spark, sf))
    return collaborative.item_based(r, r.select("userId").distinct()).select("userId", "movieId", F.round("score", 6).alias("score"), "rank")


@query(f"with {PARTS} select userId, movieId, rating, timestamp, l_orderkey, l_linenumber, part from parts")
def split_by_time(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_by_time(views.ratings(spark, sf), SPLIT_ORDER).select("userId", "movieId", "rating", "timestamp", "l_orderkey", "l_linenumber", "part")


@query(f"with {PARTS} select part, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 1)::double as percent from parts where part <> 'excluded' group by part")
def split_summary(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_summary(split.split_by_time(views.ratings(spark, sf), SPLIT_ORDER))


@query(f"with {RATINGS} select userId, count(*) as count, 'fewer than 5 ratings' as reason from ratings group by userId having count(*) < 5")
def split_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    return split.exclusions(views.ratings(spark, sf))


@query(f"with {PARTS} select round(sqrt(avg(pow(rating - (select avg(rating) from parts where part = 'train'), 2))), 6) as rmse from parts where part = 'test'")
def baseline_rmse(spark: SparkSession, sf: str) -> DataFrame:
    p = split.split_by_time(views.ratings(spark, sf), SPLIT_ORDER)
    return factors.baseline_rmse(p.where("part = 'train'"), p.where("part = 'test'")).select(F.round("rmse", 6).alias("rmse"))


SCORED = f"""{RATINGS}, {VECTORS}, scored as (select r.*, case when p.id is null or q.id is null then 3.0 else least(5.0, greatest(1.0, 3.0 + list_dot_product(p.f, q.f))) end as prediction from ratings r left join vectors p on p.id = userId left join vectors q on q.id = movieId)"""


@query(f"with {SCORED} select userId, movieId, l_orderkey, l_linenumber, rating, round(cast(prediction as double), 6) as prediction from scored")
def mf_predict_fixed(spark: SparkSession, sf: str) -> DataFrame:
    s = factors.score(views.ratings(spark, sf), views.fixed_model(spark, sf))
    return s.select("userId", "movieId", "l_orderkey", "l_linenumber", "rating", F.round("prediction", 6).alias("prediction"))


@query(f"with {SCORED} select round(sqrt(avg(pow(prediction - rating, 2))), 6) as rmse from scored")
def mf_rmse_fixed(spark: SparkSession, sf: str) -> DataFrame:
    s = factors.score(views.ratings(spark, sf), views.fixed_model(spark, sf))
    return factors.rmse(s).select(F.round("rmse", 6).alias("rmse"))


TOPK = f"""{PARTS}, {VECTORS}, seen as (select distinct userId, movieId from parts where part in ('train', 'val')),
pairs as (select p.id as userId, q.id as movieId, p_name as title, 3.0::double + list_dot_product(p.f, q.f) as score from vectors p, vectors q join part on p_partkey = q.id where p.id in (select userId from parts)),
topk as (select * from (select t.*, cast(row_number() over (partition by t.userId order by round(score, 9) desc, t.movieId) as int) as rank from pairs t left join seen s on s.userId = t.userId and s.movieId = t.movieId where s.userId is null) where rank <= 10)"""


@query(f"with {TOPK} select userId, movieId, title, round(score, 6) as score, rank from topk")
def mf_topk_fixed(spark: SparkSession, sf: str) -> DataFrame:
    p = split.split_by_time(views.ratings(spark, sf), SPLIT_ORDER)
    best = factors.top_k(p, views.fixed_model(spark, sf), views.movies(spark, sf), p.where("part in ('train', 'val')"), 10)
    return best.select("userId", "movieId", "title", F.round("score", 6).alias("score"), "rank")


RECALL = f"""{TOPK}, rel as (select distinct userId, movieId from parts where part = 'test' and rating >= 4), pool as (select distinct movieId from parts where part = 'train'),
known as (select * from rel where movieId in (select movieId from pool)),
each as (select k.userId, count(*) as relevant, count(t.movieId) as hits from known k left join topk t on t.userId = k.userId and t.movieId = k.movieId group by 1)"""


def _recall(spark: SparkSession, sf: str) -> factors.Recall:
    # saved, since each side of the result reads it
    p = Scratch(spark, "split").save(split.split_by_time(views.ratings(spark, sf), SPLIT_ORDER).select("userId", "movieId", "rating", "part"))
    return factors.recall_at_k(p.where("part = 'train'"), p.where("part = 'val'"), p.where("part = 'test'"), views.fixed_model(spark, sf), views.movies(spark, sf))


@query(f"with {RECALL} select round(coalesce(avg(hits / relevant), 0), 9) as overall_recall, count(*) as n_users from each")
def recall_at_k_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return _recall(spark, sf).overall.select(F.round("overall_recall", 9).alias("overall_recall"), "n_users")


@query(f"with {RECALL} select userId, relevant, hits, round(hits / relevant, 9) as recall from each")
def recall_per_user(spark: SparkSession, sf: str) -> DataFrame:
    return _recall(spark, sf).per_user.select("userId", "relevant", "hits", F.round("recall", 9).alias("recall"))


@query(f"with {RECALL} select 'unseen item' as kind, movieId as id from rel where movieId not in (select movieId from pool) group by 2 union all select 'user without relevant', userId from parts where part = 'test' and userId not in (select userId from known) group by 2")
def recall_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    r = _recall(spark, sf)
    return r.unseen_ids.select(F.lit("unseen item").alias("kind"), F.col("movieId").alias("id")).union(r.users_without_relevant.select(F.lit("user without relevant"), "userId"))


def _timed(spark: SparkSession, sf: str) -> DataFrame:
    """The last rating of each pair, with its time and place."""
    r = views.ratings(spark, sf)
    last = F.max(F.struct(*[F.col(c) for c in views.TIME_ORDER], F.col("rating"))).alias("last")
    return r.groupBy("userId", "movieId").agg(last).select("userId", "movieId", "last.*")


@query(None)
def als_history(spark: SparkSession, sf: str) -> DataFrame:
    p = Scratch(spark, "split").save(split.split_by_time(_timed(spark, sf), SPLIT_ORDER).select("userId", "movieId", "rating", "part"))
    history, _ = factors.train_with_history(p.where("part = 'train'"), p.where("part = 'val'"), [1, 5, 10, 20])
    return history


@query(None)
def als_best_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    return factors.best_checkpoint(als_history(spark, sf))


def _trained(spark: SparkSession, sf: str) -> gradient.Trained:
    """One run of 20 epochs from seeded factors."""
    p = Scratch(spark, "split").save(split.split_by_time(_timed(spark, sf), SPLIT_ORDER))
    train_rows = p.where("part = 'train'")
    top = p.agg(F.max("userId").alias("u"), F.max("movieId").alias("i")).first()
    return gradient.train_gradient(train_rows, p.where("part = 'val'"), factors.initial_factors(train_rows, top_user=top["u"], top_item=top["i"]))


@query(None)
def mf_history(spark: SparkSession, sf: str) -> DataFrame:
    return _trained(spark, sf).history


@query(None)
def mf_best_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    return factors.best_checkpoint(_trained(spark, sf).history)


#: Steps that SQL can follow: fixed start factors, a batch for each diagonal.
FIXED_STEPS = gradient.GradientOptions(epochs=2, lr=0.05, reg=0.001, batch_size=1_000_000_000, blocks=2)


def _steps_sql(o: gradient.GradientOptions) -> str:
    """(epoch, trainRMSE, valRMSE) by one list of factors and two of moments for each row, step after step."""
    step = """e{t} as materialized (
 select userId, movieId, p.w as pw, q.w as qw, 2.0::double / (select count(*) from fit where d = {d}) * (3.0::double + list_dot_product(p.w, q.w) - rating) as e
 from fit join w{s} p on p.side = 0 and p.id = userId join w{s} q on q.side = 1 and q.id = movieId where d = {d}),
g{t} as materialized (
 select side, id, list(s order by j) as g from (select side, id, j, sum(e * o[j]) as s from (select 0 as side, userId as id, qw as o, e from e{t} union all select 1, movieId, pw, e from e{t}), (select unnest(generate_series(1, 64)) as j) group by side, id, j) group by side, id),
f{t} as (select w{s}.*, list_transform(generate_series(1, 64), lambda j: coalesce(g[j], 0) + {decay}::double * w[j]) as g from w{s} left join g{t} using (side, id)),
h{t} as (select side, id, w, list_transform(generate_series(1, 64), lambda j: 0.9::double * m[j] + 0.1::double * g[j]) as m, list_transform(generate_series(1, 64), lambda j: 0.999::double * v[j] + 0.001::double * g[j] * g[j]) as v from f{t}),
w{t} as materialized (select side, id, list_transform(generate_series(1, 64), lambda j: w[j] - {lr}::double * (m[j] / {c1!r}::double) / (sqrt(v[j] / {c2!r}::double) + 1e-7::double)) as w, m, v from h{t})"""
    steps, errors, t = [], [], 0
    for epoch in range(1, o.epochs + 1):
        for d in range(o.blocks):
            t += 1
            steps.append(step.format(t=t, s=t - 1, d=d, decay=2 * o.reg, lr=o.lr, c1=1 - gradient.BETA1**t, c2=1 - gradient.BETA2**t))
        for part in ("train", "val"):
            guess = "case when p.id is null or q.id is null then 3.0 else least(5.0, greatest(1.0, 3.0 + list_dot_product(p.w, q.w))) end"
            errors.append(f"select {epoch} as epoch, '{part}' as part, sqrt(avg(pow({guess} - rating, 2))) as rmse from parts left join w{t} p on p.side = 0 and p.id = userId left join w{t} q on q.side = 1 and q.id = movieId where part = '{part}'")
    return f"""with {PARTS}, {VECTORS}, fit as materialized (select userId, movieId, rating, ((movieId - userId) % {o.blocks} + {o.blocks}) % {o.blocks} as d from parts where part = 'train'),
w0 as materialized (select side, id, f as w, list_transform(f, lambda x: 0.0::double) as m, list_transform(f, lambda x: 0.0::double) as v from vectors, (select unnest([0, 1]) as side)), {", ".join(steps)},
errors as ({" union all ".join(errors)})
select epoch, round(max(rmse) filter (part = 'train'), 6) as train_rmse, round(max(rmse) filter (part = 'val'), 6) as val_rmse from errors group by epoch"""


@query(_steps_sql(FIXED_STEPS))
def mf_epochs_fixed(spark: SparkSession, sf: str) -> DataFrame:
    p = Scratch(spark, "split").save(split.split_by_time(views.ratings(spark, sf), SPLIT_ORDER))
    done = gradient.train_gradient(p.where("part = 'train'"), p.where("part = 'val'"), views.fixed_model(spark, sf), FIXED_STEPS)
    return done.history.select("epoch", F.round("trainRMSE", 6).alias("train_rmse"), F.round("valRMSE", 6).alias("val_rmse"))


@query(None)
def mf_run_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return gradient.run_pipeline(Scratch(spark, "ratings").save(_timed(spark, sf)), views.movies(spark, sf), SPLIT_ORDER)


@query(None)
def mf_embeddings_validation(spark: SparkSession, sf: str) -> DataFrame:
    # saved, since places, counts and the start come from them
    r = Scratch(spark, "ratings").save(_timed(spark, sf))
    return gradient.train_embedding_model(r, SPLIT_ORDER)[0]


GRAPH = """edges as (select distinct user_id as src, cast(regexp_extract(props, '"k":\\s*(\\d+)', 1) as bigint) + 1000000 as dst from events),
sym as (select src, dst from edges union select dst, src from edges), degree as (select src, count(*) as d from sym group by src), n as (select count(*) as n from degree)"""
RANKS = GRAPH + """, pr(step, id, score) as (select 0, src, 1.0::double / n from degree, n union all
 select step + 1, dst, 0.85 * sum(score / d) + 0.15 / any_value(n) from pr join sym on id = sym.src join degree on degree.src = sym.src, n where step < 50 group by step + 1, dst),
ranks as (select id, score / sum(score) over () as score from pr where step = 50)"""


@query(f"with recursive {RANKS} select id, round(score, 9) as score from ranks")
def pagerank_50(spark: SparkSession, sf: str) -> DataFrame:
    return graph.pagerank(views.edges(spark, sf)).select("id", F.round("score", 9).alias("score"))


@query(f"with recursive {RANKS} select id, round(score, 9) as score from ranks where id <> (select min(src) from edges) and id not in (select dst from sym where src = (select min(src) from edges)) order by round(score, 12) desc, id limit 3")
def friends_top3(spark: SparkSession, sf: str) -> DataFrame:
    e = views.edges(spark, sf)
    return graph.friends(e, graph.pagerank(e), e.agg(F.min("src")).first()[0]).select("id", F.round("score", 9).alias("score"))


@query(f"with {GRAPH} select src as id, array_to_string(list(dst order by dst), ',') as friends, count(*) as degree from sym group by src")
def node_friends(spark: SparkSession, sf: str) -> DataFrame:
    return graph.adjacency(views.edges(spark, sf)).select("id", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("friends"), "degree")


@query(f"with {GRAPH} select src as id, dst as friend, d as degree from sym join degree using (src)")
def node_friends_in_chunks(spark: SparkSession, sf: str) -> DataFrame:
    chunks = graph.adjacency_chunks(views.edges(spark, sf), 20)
    return chunks.select("id", F.explode("neighbours").alias("friend"), "degree")


@query(f"with {GRAPH} select count(*) as n from (select src, dst from edges union select min(src), max(dst) from edges)")
def graph_add_edge(spark: SparkSession, sf: str) -> DataFrame:
    e = views.edges(spark, sf)
    ends = e.agg(F.min("src"), F.max("dst")).first()
    return graph.add_edge(e, ends[0], ends[1]).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {GRAPH} select src as id, row_number() over (order by src) as place from degree")
def nodes_in_order(spark: SparkSession, sf: str) -> DataFrame:
    return graph.in_order(graph.nodes(views.edges(spark, sf)))


@query(f"with {RATINGS} select userId as id, row_number() over (order by userId) as place from (select distinct userId from ratings)")
def users_in_order(spark: SparkSession, sf: str) -> DataFrame:
    return graph.in_order(views.ratings(spark, sf).select(F.col("userId").alias("id")).distinct())


@query(f"with recursive {RANKS} select id, round(score, 9) as score, md5(string_agg(cast(dst as varchar), ',' order by dst)) as friends_md5 from ranks join sym on src = id group by 1, 2")
def friend_lists(spark: SparkSession, sf: str) -> DataFrame:
    e = views.edges(spark, sf)
    f = graph.friend_lists(e, graph.pagerank(e))
    return f.select("id", F.round("score", 9).alias("score"), F.md5(F.array_join(F.transform("friends", lambda x: x.cast("string")), ",")).alias("friends_md5"))


@query("with recursive " + RANKS.replace("edges as (select distinct user_id as src,", "given as (select distinct user_id as src,").replace("from events),", "from events), edges as (select * from given union select min(src), max(dst) from given),", 1) + " select id, round(score, 9) as score from ranks")
def pagerank_after_add_edge(spark: SparkSession, sf: str) -> DataFrame:
    e = views.edges(spark, sf)
    ends = e.agg(F.min("src"), F.max("dst")).first()
    return graph.pagerank(graph.add_edge(e, ends[0], ends[1])).select("id", F.round("score", 9).alias("score"))


@query("with recursive " + RANKS.replace("step < 50", "step < 150").replace("step = 50", "step = 150").replace("edges as (select distinct user_id as src,", "given as (select distinct user_id as src,").replace("from events),", "from events), edges as (select * from given union select min(src), max(dst) from given),", 1) + " select id, round(score, 8) as score from ranks")
def pagerank_pushed(spark: SparkSession, sf: str) -> DataFrame:
    e = views.edges(spark, sf)
    ends = e.agg(F.min("src"), F.max("dst")).first()
    old = Scratch(spark, "ranks").save(graph.pagerank(e))
    return graph.pagerank_update(graph.add_edge(e, ends[0], ends[1]), old, tolerance=1e-10).select("id", F.round("score", 8).alias("score"))


@query(f"with {LOG} select coalesce(reason, 'kept') as reason, count(*) as n from reasoned group by 1")
def retail_waterfall(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.waterfall(cleaning.with_drop_reason(views.retail_log(spark, sf)))


def _retail(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    kept = Scratch(spark, "retail").save(cleaning.kept_lines(cleaning.with_drop_reason(views.retail_log(spark, sf))))
    canonical = cleaning.canonical_descriptions(kept)
    return canonical, cleaning.build_baskets(kept, canonical)


@query(f"with {LOG} select stock, description from canonical")
def retail_canonical_desc(spark: SparkSession, sf: str) -> DataFrame:
    return _retail(spark, sf)[0]


@query(f"with {LOG} select invoice, array_to_string(list(stock order by stock), ',') as stocks, array_to_string(list(description order by stock), ',') as descriptions from retail group by invoice")
def retail_baskets(spark: SparkSession, sf: str) -> DataFrame:
    return _retail(spark, sf)[1].select("invoice", F.array_join("items.stock", ",").alias("stocks"), F.array_join("items.description", ",").alias("descriptions"))


REASON_NAMES = ", ".join(f"('{r}')" for r in cleaning.REASONS)


@query(f"""with {LOG} select 'rows' as section, 'raw' as name, count(*) as n from log union all select 'rows', 'kept', count(*) from kept union all select 'rows', 'in_baskets', count(*) from retail
union all select 'dropped', r, count(reason) from (values {REASON_NAMES}) v(r) left join reasoned on reason = r group by r
union all select 'size', 'baskets', count(distinct invoice) from retail union all select 'size', 'items', count(*) from dictionary union all select 'top', stock, n from dictionary where idx < 10""")
def retail_report(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_log(views.retail_log(spark, sf)).report


@query("""select p_brand as stock, min_by(p_name, p_partkey) as description from part group by p_brand""")
def first_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.first_entries(table(spark, sf, "part").select(F.col("p_brand").alias("stock"), F.col("p_name").alias("description"), F.col("p_partkey").alias("place")))


@query(f"""with {LOG}, first as (select invoice, cast(ltrim(invoice, 'C') as bigint) as place from retail group by invoice) select invoice, row_number() over (order by place) - 1 as nth from first""")
def baskets_in_first_seen_order(spark: SparkSession, sf: str) -> DataFrame:
    log = cleaning.kept_lines(cleaning.with_drop_reason(views.retail_log(spark, sf)))
    kept = Scratch(spark, "retail").save(log.withColumn("place", F.ltrim("invoice", F.lit("C")).cast("long")))
    return cleaning.in_first_seen_order(kept, cleaning.build_baskets(kept, cleaning.canonical_descriptions(kept))).select("invoice", "nth")


@query(f"with {LOG} select cast(idx as int) as idx, stock, description, n from dictionary")
def item_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.item_dictionary(_retail(spark, sf)[1])


@query(f"with {LOG} select invoice, array_to_string(list(idx order by idx), ',') as item_idx from retail join dictionary using (stock) group by invoice")
def encoded_baskets(spark: SparkSession, sf: str) -> DataFrame:
    b = _retail(spark, sf)[1]
    e = cleaning.encode_baskets(b, cleaning.item_dictionary(b))
    return e.select("invoice", F.array_join(F.transform("item_idx", lambda x: x.cast("string")), ",").alias("item_idx"))


@query(f"with {LOG} select invoice, array_to_string(list(stock order by stock), ',') as stocks from retail group by invoice")
def decoded_baskets(spark: SparkSession, sf: str) -> DataFrame:
    b = Scratch(spark, "retail").save(_retail(spark, sf)[1])
    d = cleaning.item_dictionary(b)
    return cleaning.decode_baskets(cleaning.encode_baskets(b, d), d).select("invoice", F.array_join("items.stock", ",").alias("stocks"))


GENRE_LIST = ", ".join("'" + g.replace("'", "''") + "'" for g in readers.GENRES)


@query(f"select p_partkey as id, p_name as title, array_to_string(list_filter([{GENRE_LIST}], lambda x, i: (p_partkey * (i + 2)) % 5 = 0), ',') as genres from part")
def items_from_file(spark: SparkSession, sf: str) -> DataFrame:
    """Parts written as pipe-separated items, with lines that are too short between them, and read back."""
    path = Scratch(spark, "files").folder("items")
    flags = [F.when(F.col("p_partkey") * (i + 3) % 5 == 0, "1").otherwise("0") for i in range(len(readers.GENRES))]
    parts = table(spark, sf, "part")
    lines = parts.select(F.concat_ws("|", "p_partkey", "p_name", F.lit("date"), F.lit(""), F.lit("url"), F.lit("1"), *flags).alias("value"))
    lines.union(parts.select(F.concat_ws("|", "p_partkey", "p_name"))).union(parts.select(F.lit("  "))).write.text(path)
    return readers.read_items(spark, path).select("id", "title", F.array_join("genres", ",").alias("genres"))


@query(f"with {RATINGS} select userId, movieId, rating, timestamp from ratings")
def ratings_from_file(spark: SparkSession, sf: str) -> DataFrame:
    """Ratings written as tab-separated lines, with short and blank ones between them, and read back."""
    path = Scratch(spark, "files").folder("ratings")
    whole, short = F.concat_ws("\t", "userId", "movieId", "rating", "timestamp"), F.concat_ws("\t", "userId", "movieId")
    views.ratings(spark, sf).select(F.explode(F.array(whole, short, F.lit(""))).alias("value")).write.text(path)
    return readers.read_ratings(spark, path)


@query(f"with {GRAPH} select src, dst from edges")
def edges_from_file(spark: SparkSession, sf: str) -> DataFrame:
    path = Scratch(spark, "files").folder("edges")
    views.edges(spark, sf).select("src", "dst").write.csv(path)
    return readers.read_edges(spark, path)


@query(f"with {LOG} select coalesce(reason, 'kept') as reason, count(*) as n from reasoned group by 1")
def retail_from_file(spark: SparkSession, sf: str) -> DataFrame:
    """The log written as CSV with its header, blanks as they are, and read back."""
    scratch = Scratch(spark, "files")
    path = scratch.folder("log")
    log = views.retail_log(spark, sf).withColumns({"InvoiceDate": F.lit("today"), "Country": F.lit("here")}).select(*readers.RETAIL_COLUMNS)
    log.write.options(header="true", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)
    return cleaning.waterfall(cleaning.with_drop_reason(scratch.save(readers.read_retail(spark, path))))


@query(f"with {LOG} select invoice, array_to_string(list(idx order by idx), ',') as item_idx from retail join dictionary using (stock) group by invoice")
def encoded_from_file(spark: SparkSession, sf: str) -> DataFrame:
    """Encoded baskets written as a dataset and read back."""
    done = cleaning.clean_log(views.retail_log(spark, sf))
    path = Scratch(spark, "files").folder("encoded")
    sizes = {(r["section"], r["name"]): r["n"] for r in done.report.where("section in ('rows', 'size')").collect()}
    readers.write_encoded(done.dictionary, cleaning.encode_baskets(done.baskets, done.dictionary), cleaning.provenance("The log", sizes["rows", "in_baskets"], sizes["size", "baskets"]), path)
    return readers.read_encoded(spark, path)[1].select("invoice", F.array_join(F.transform("item_idx", lambda x: x.cast("string")), ",").alias("item_idx"))


@query("""select p_partkey as id, p_name as title, case when p_size % 2 = 0 then 1950 + p_size end as year from part""")
def title_year(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" ("), (F.col("p_size") + 1950).cast("string"), F.lit(")"))).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), tx.title_of(raw).alias("title"), tx.year_of(raw).alias("year"))


@query("""select p_partkey as id, case when p_size = 1 then '?' else upper(p_name) end as description, upper(p_brand) as code from part""")
def description_normalise(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("p_size") == 1, " ? ").otherwise(F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("  ")), F.lit(" .;")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), tx.normal_description(raw).alias("description"), tx.normal_code(F.concat(F.lit(" "), F.lower("p_brand"))).alias("code"))


@query("""select o_orderkey, format('{:.4f}', o_totalprice) as fixed, format('{:.2f}', o_totalprice / 100 * 100) || '%' as percent, format('{:,}', cast(o_orderkey as bigint)) as thousands,
 case when o_totalprice >= 4 then 'high' when o_totalprice <= 2 then 'low' else 'medium' end as bucket, least(5.0, greatest(1.0, o_totalprice / 100000))::double as clamped from orders""")
def format_metrics(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("o_totalprice")
    return table(spark, sf, "orders").select("o_orderkey", tx.fmt(p).alias("fixed"), tx.format_percent(p / 100).alias("percent"), tx.thousands(F.col("o_orderkey")).alias("thousands"), tx.rating_bucket(p).alias("bucket"), tx.clamp(p / 100000, 1.0, 5.0).alias("clamped"))


@query("""select page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) as escaped_md5 from pages""")
def html_escape(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.md5(tx.escape_html(F.col("html"))).alias("escaped_md5"))


@query("""with ids as (select p_partkey as id, p_name as title from part union all select -p_partkey, null from part) select id, coalesce(title, 'Movie #' || id) as name, case when title is null then cast(id as varchar) else cast(id as varchar) || ' ' || chr(8212) || ' ' || title end as item from ids""")
def names_and_items(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    ids = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")).union(p.select(-F.col("p_partkey"), F.lit(None).cast("string")))
    return ids.select("id", tx.title_or_number(F.col("title"), F.col("id")).alias("name"), tx.describe_item(F.col("id").cast("string"), F.col("title")).alias("item"))


@query("""with n as (select max(o_custkey) as n from orders) select cast(unnest(generate_series(1, n)) as int) as id from n""")
def id_list(spark: SparkSession, sf: str) -> DataFrame:
    return readers.id_list(spark, table(spark, sf, "orders").agg(F.max("o_custkey")).first()[0])


@query(None)
def random_movie(spark: SparkSession, sf: str) -> DataFrame:
    return views.movies(spark, sf).select("id", "title").orderBy(F.rand(7)).limit(1)


@query(f"with {VECTORS} select a.id, round(list_dot_product(a.f, a.f), 5) as norm from vectors a")
def vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    v = views.fixed_model(spark, sf).users
    return v.select("id", F.round(dot(F.col("features"), F.col("features")), 5).alias("norm"))
