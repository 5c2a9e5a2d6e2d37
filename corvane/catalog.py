"""All queries over the supplied tables and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import clock as C
from corvane.functions import frames as N
from corvane.functions import text as T
from corvane.operators import best_match as X
from corvane.operators import consistency as K
from corvane.operators import medoid as M
from corvane.operators import pairing as J
from corvane.operators import pools as P
from corvane.operators import repair as R
from corvane.operators import split as S
from corvane.operators import tiers as Q
from corvane.operators import vote as V
from corvane.operators.asof import nearest_keys
from corvane.operators.ranks import checkpointed, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- votes --------------------------------------------------------------------------------------------------

MAJORITY = """counts AS (SELECT item, value, count(*) AS k, min(pos) AS p FROM votes WHERE value <> '' GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY k DESC, p) AS r, max(k) OVER (PARTITION BY item) AS top,
  CAST(sum(k) OVER (PARTITION BY item) AS BIGINT) AS n FROM counts)"""


def event_votes(spark, d) -> DataFrame:
    return t(spark, d, "events").select(F.col("user_id").alias("item"), F.col("event_type").alias("value"), F.col("event_id").alias("pos"))


@query(f"""WITH votes AS (SELECT user_id AS item, event_type AS value, event_id AS pos FROM events), {MAJORITY}
SELECT item, value, top, n, (2 * top - n)::DOUBLE / n AS margin_a, top::DOUBLE / n AS margin_b FROM ranked WHERE r = 1""")
def majority_vote(spark, d):
    return V.majority(event_votes(spark, d))


@query(f"""WITH votes AS (SELECT user_id AS item, event_type AS value, event_id AS pos FROM events WHERE event_type <> 'click' AND value > 50), {MAJORITY},
items AS (SELECT DISTINCT user_id AS item FROM events)
SELECT items.item, value, top, n, coalesce((2 * top - n)::DOUBLE / n, 1.0::DOUBLE) AS margin_a, coalesce(top::DOUBLE / n, 0.0::DOUBLE) AS margin_b
FROM items LEFT JOIN (SELECT * FROM ranked WHERE r = 1) w ON w.item = items.item""")
def vote_margins_with_empty(spark, d):
    e = t(spark, d, "events")
    some = e.filter((F.col("event_type") != "click") & (F.col("value") > 50)).select(F.col("user_id").alias("item"), F.col("event_type").alias("value"), F.col("event_id").alias("pos"))
    return V.margins_with_empty(e.select(F.col("user_id").alias("item")), some)


@query("""SELECT user_id AS item, list(event_type ORDER BY event_id) AS pool FROM events GROUP BY 1""")
def vote_pool_arrays(spark, d):
    return V.pool_arrays(event_votes(spark, d))


@query(f"""WITH both_ AS (SELECT o_custkey AS item, o_orderpriority AS value, o_orderkey AS pos FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT o_custkey, o_orderpriority, 2147483648 + o_orderkey FROM orders WHERE o_orderstatus = 'O'),
has AS (SELECT DISTINCT item FROM both_),
votes AS (SELECT * FROM both_ UNION ALL SELECT o_custkey, o_orderpriority, 4294967296 + o_orderkey FROM orders
  WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT item FROM has)), {MAJORITY}
SELECT item, value, top, n FROM ranked WHERE r = 1""")
def pooled_vote_with_orphans(spark, d):
    o = t(spark, d, "orders")
    part = lambda s: o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("item"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("value"))
    first, second = part("F"), part("O")
    has = first.select("item").union(second.select("item")).distinct()
    return V.majority(P.ordered([first, second, part("P").join(has, "item", "left_anti")])).select("item", "value", "top", "n")


@query("""WITH v AS (SELECT o_custkey AS item, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS k, o_orderpriority AS value,
  CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END AS src FROM orders WHERE o_orderstatus IN ('F', 'O')),
m AS (SELECT item, least(coalesce(max(k) FILTER (src = 0), 0), coalesce(max(k) FILTER (src = 1), 0)) AS m FROM v GROUP BY 1)
SELECT item, value, CAST(row_number() OVER (PARTITION BY item ORDER BY least(k, m + 1), CASE WHEN k > m THEN 0 ELSE src END, src, k) - 1 AS INTEGER) AS pos FROM v JOIN m USING (item)""")
def interleave_pools(spark, d):
    o = t(spark, d, "orders")
    part = lambda s: o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("item"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("value"))
    return V.interleaved(part("F"), part("O")).select("item", "value", "pos")


# --- signals and tiers ----------------------------------------------------------------------------------------

def _count_sql(words) -> str:
    return " + ".join(f"(length(l) - length(replace(l, '{w}', ''))) // {len(w)}" for w in words)


SIGNALS = f"""base AS (SELECT *, doc_id % 100 AS grp, concat(text, ' at ', doc_id % 60, ':', lpad((doc_id % 55)::VARCHAR, 2, '0'), ' near the crosswalk, probably') AS r FROM documents),
one AS (SELECT *, lower(r) AS l FROM base),
sig AS (SELECT grp, CAST(sum(len(regexp_extract_all(r, '[0-9]{{1,2}}:[0-9]{{2}}(\\.[0-9]{{1,3}})?'))) AS BIGINT) AS timestamp_hits,
  CAST(sum({_count_sql(T.PLACE_WORDS)}) AS BIGINT) AS spatial_hits, avg(length(r)) AS avg_reasoning_len,
  sum(({_count_sql(T.HEDGES)})::DOUBLE / len(list_filter(regexp_split_to_array(r, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> ''))) AS h, count(*) AS n FROM one GROUP BY grp)"""


def doc_items(spark, d) -> DataFrame:
    seconds = F.lpad((F.col("doc_id") % 55).cast("string"), 2, "0")
    r = F.concat("text", F.lit(" at "), (F.col("doc_id") % 60).cast("string"), F.lit(":"), seconds, F.lit(" near the crosswalk, probably"))
    return t(spark, d, "documents").select((F.col("doc_id") % 100).alias("grp"), r.alias("reasoning"))


@query(f"WITH {SIGNALS} SELECT grp, timestamp_hits, spatial_hits, avg_reasoning_len, round(h / n, 9) AS generic_ratio FROM sig")
def doc_signals(spark, d):
    return Q.signals(doc_items(spark, d), "grp").withColumn("generic_ratio", F.round("generic_ratio", 9))


@query(f"""WITH {SIGNALS}, med AS (SELECT quantile_cont(avg_reasoning_len, 0.5) AS m FROM sig),
sc AS (SELECT grp, least(timestamp_hits / 6.0::DOUBLE, 2) * 1.2::DOUBLE + least(spatial_hits / 4.0::DOUBLE, 2) + CASE WHEN avg_reasoning_len >= m THEN 0.6::DOUBLE ELSE 0 END - 5 * (h / n) AS s FROM sig, med)
SELECT grp, round(s, 9) AS s_score FROM sc""")
def tier_scores(spark, d):
    return Q.scored(Q.signals(doc_items(spark, d), "grp")).select("grp", F.round("s_score", 9).alias("s_score"))


@query(_SQL["tier_scores"].replace("SELECT grp, round(s, 9) AS s_score FROM sc", """, cut AS (SELECT quantile_cont(s, 0.75) AS hi, quantile_cont(s, 0.25) AS lo FROM sc)
SELECT grp, CASE WHEN s >= hi THEN 'S' WHEN s >= lo THEN 'A' ELSE 'B' END AS tier FROM sc, cut"""))
def tier_assignment(spark, d):
    return Q.tiers(Q.signals(doc_items(spark, d), "grp")).select("grp", "tier")


@query("""WITH g AS (SELECT o_custkey, avg(o_totalprice) AS s FROM orders GROUP BY 1),
c AS (SELECT quantile_cont(s, 0.75) AS hi, quantile_cont(s, 0.25) AS lo FROM g)
SELECT CASE WHEN s >= hi THEN 'S' WHEN s >= lo THEN 'A' ELSE 'B' END AS tier, count(*) AS n FROM g, c GROUP BY 1""")
def percentile_tiers(spark, d):
    g = checkpointed(t(spark, d, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("s")))
    return g.groupBy(Q.tier_of(g, "s").alias("tier")).agg(F.count("*").alias("n"))


TIERED = "CASE doc_id % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'A' WHEN 2 THEN 'B' ELSE 'X' END"


@query(f"""WITH d AS (SELECT doc_id, {TIERED} AS tier FROM documents)
SELECT doc_id, tier, CAST(unnest(generate_series(1, CASE tier WHEN 'S' THEN 3 WHEN 'A' THEN 2 ELSE 1 END)) AS INTEGER) AS copy FROM d""")
def tier_replication(spark, d):
    rows = t(spark, d, "documents").select("doc_id", F.expr(TIERED).alias("tier"))
    return Q.replicate(rows, N.REPEATS)


# --- consistency -------------------------------------------------------------------------------------------------

TALK = """SELECT conv_id AS video_id, turn AS ord, CASE turn % 6 WHEN 0 THEN 'bcq' WHEN 1 THEN 'causal_linkage' WHEN 2 THEN 'temporal_localization'
  WHEN 3 THEN 'temporal_description' WHEN 4 THEN 'scene_description' ELSE 'video_summarization' END AS task,
  CASE turn % 6 WHEN 0 THEN CASE WHEN conv_id % 3 = 0 THEN 'No.' ELSE 'Yes, it is' END WHEN 1 THEN CASE conv_id % 4 WHEN 0 THEN 'There was no accident.' WHEN 3 THEN 'Nothing said' ELSE 'The cars crash.' END
  WHEN 2 THEN concat('{"start": "00:', lpad((conv_id % 60)::VARCHAR, 2, '0'), '", "end": "01:00"}') WHEN 3 THEN concat('It begins at 0:', lpad((conv_id % 25 + 10)::VARCHAR, 2, '0'), ' here')
  ELSE text END AS answer FROM conversations"""


def talk_items(spark, d) -> DataFrame:
    c = t(spark, d, "conversations")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    k, conv = F.col("turn") % 6, F.col("conv_id")
    task = F.when(k == 0, "bcq").when(k == 1, "causal_linkage").when(k == 2, "temporal_localization").when(k == 3, "temporal_description").when(k == 4, "scene_description").otherwise("video_summarization")
    answer = (
        F.when(k == 0, F.when(conv % 3 == 0, "No.").otherwise("Yes, it is"))
        .when(k == 1, F.when(conv % 4 == 0, "There was no accident.").when(conv % 4 == 3, "Nothing said").otherwise("The cars crash."))
        .when(k == 2, F.concat(F.lit('{"start": "00:'), two(conv % 60), F.lit('", "end": "01:00"}')))
        .when(k == 3, F.concat(F.lit("It begins at 0:"), two(conv % 25 + 10), F.lit(" here")))
        .otherwise(F.col("text"))
    )
    return c.select(conv.alias("video_id"), F.col("turn").alias("ord"), task.alias("task"), F.lit("").alias("question"), answer.alias("answer"), F.lit("").alias("reasoning"))


@query(f"""WITH i AS ({TALK}),
f AS (SELECT video_id, task, arg_min(answer, ord) AS a FROM i GROUP BY 1, 2),
y AS (SELECT video_id, count(*) FILTER (task = 'bcq' AND answer LIKE 'Yes%') AS ny, count(*) FILTER (task = 'bcq' AND answer LIKE 'No%') AS nn FROM i GROUP BY 1),
w AS (SELECT y.*, (SELECT a FROM f WHERE f.video_id = y.video_id AND task = 'causal_linkage') AS c, (SELECT a FROM f WHERE f.video_id = y.video_id AND task = 'temporal_localization') AS l,
  (SELECT a FROM f WHERE f.video_id = y.video_id AND task = 'temporal_description') AS td, (SELECT a FROM f WHERE f.video_id = y.video_id AND task = 'scene_description') AS s,
  (SELECT a FROM f WHERE f.video_id = y.video_id AND task = 'video_summarization') AS v FROM y),
k AS (SELECT *, list_distinct(regexp_extract_all(lower(s), '[a-z]{{4,}}')) AS ws, list_distinct(regexp_extract_all(lower(v), '[a-z]{{4,}}')) AS wv FROM w)
SELECT video_id,
  CASE WHEN c IS NULL OR ny + nn = 0 OR c = 'Nothing said' THEN 0.5 WHEN (ny >= nn) = (c = 'The cars crash.') THEN 1 ELSE 0 END::DOUBLE AS polar,
  CASE WHEN l IS NULL OR td IS NULL THEN 0.5 WHEN abs(substr(l, 15, 2)::INT - substr(td, 16, 2)::INT) <= 10 THEN 1 ELSE 0 END::DOUBLE AS timed,
  CASE WHEN s IS NULL OR v IS NULL OR len(ws) = 0 OR len(wv) = 0 THEN 0.5 WHEN len(list_intersect(ws, wv))::DOUBLE / len(list_distinct(list_concat(ws, wv))) >= 0.15 THEN 1 ELSE 0 END::DOUBLE AS texts FROM k""")
def consistency_rules(spark, d):
    c = K.consistency(talk_items(spark, d))
    s = F.col("pair_scores")
    return c.select("video_id", s["bcq|causal_linkage"].alias("polar"), s["temporal_localization|temporal_description"].alias("timed"), s["scene_description|video_summarization"].alias("texts"))


@query(f"""WITH i AS ({TALK}),
f AS (SELECT video_id, task, arg_min(answer, ord) AS a FROM i GROUP BY 1, 2),
y AS (SELECT video_id, count(*) FILTER (task = 'bcq' AND answer LIKE 'Yes%') AS ny, count(*) FILTER (task = 'bcq' AND answer LIKE 'No%') AS nn FROM i GROUP BY 1),
w AS (SELECT y.*, (SELECT a FROM f WHERE f.video_id = y.video_id AND task = 'causal_linkage') AS c FROM y),
p AS (SELECT video_id, CASE WHEN c IS NULL OR ny + nn = 0 OR c = 'Nothing said' THEN 0.5 WHEN (ny >= nn) = (c = 'The cars crash.') THEN 1 ELSE 0 END::DOUBLE AS m FROM w)
SELECT video_id, m AS mean_score, CASE WHEN m < 0.4 THEN 0.5 ELSE 1.0 END::DOUBLE AS downweight FROM p""")
def consistency_downweight(spark, d):
    return K.consistency(talk_items(spark, d), pairs=(("bcq", "causal_linkage"),)).drop("pair_scores")


# --- splits, ids, summaries ------------------------------------------------------------------------------------------

SPLIT = """ids AS (SELECT DISTINCT conv_id FROM conversations),
val AS (SELECT conv_id FROM ids ORDER BY md5(concat('42:', conv_id)), conv_id LIMIT (SELECT greatest(1, floor(count(*) * 0.05))::BIGINT FROM ids))"""


@query(f"""WITH {SPLIT} SELECT conv_id, turn, CASE WHEN conv_id IN (SELECT conv_id FROM val) THEN 'val' ELSE 'train' END AS split FROM conversations""")
def grouped_split(spark, d):
    return S.by_hash(t(spark, d, "conversations").select("conv_id", "turn"), "conv_id")


@query("""SELECT concat(conv_id, '::', role, '::', row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1) AS id, conv_id, turn FROM conversations""")
def record_ids(spark, d):
    c = t(spark, d, "conversations").withColumn("task", F.col("role"))
    return S.record_ids(c, "conv_id", "turn").select("id", "conv_id", "turn")


@query(f"""WITH r AS (SELECT {TIERED} AS tier, lang AS task, CASE WHEN doc_id % 20 = 0 THEN 'val' ELSE 'train' END AS split, 1.0::DOUBLE + doc_id % 3 AS init_weight FROM documents)
SELECT CASE grouping(tier, task, split) WHEN 3 THEN 'tier' WHEN 5 THEN 'task' WHEN 6 THEN 'split' ELSE 'all' END AS kind, coalesce(tier, task, split) AS value, count(*) AS n, avg(init_weight) AS mean_weight
FROM r GROUP BY GROUPING SETS ((tier), (task), (split), ())""")
def stage_summary(spark, d):
    r = t(spark, d, "documents").select(F.expr(TIERED).alias("tier"), F.col("lang").alias("task"), F.expr("if(doc_id % 20 = 0, 'val', 'train')").alias("split"), (1.0 + F.col("doc_id") % 3).cast("double").alias("init_weight"))
    return S.summary(r)


@query("""SELECT conv_id AS video, arg_min(text, turn) AS first_text, arg_max(text, turn) AS last_text FROM conversations WHERE role = 'user' GROUP BY 1""")
def first_last_context(spark, d):
    items = t(spark, d, "conversations").select(F.col("conv_id").alias("video"), F.col("turn").alias("item"), F.col("role").alias("task"), F.col("text").alias("question"), F.col("turn").alias("ord"))
    a, z = J.context_rows(items, "user"), J.context_rows(items, "user", last=True)
    return a.select("video", F.col("question").alias("first_text")).join(z.select("video", F.col("question").alias("last_text")), "video")


# --- parsers --------------------------------------------------------------------------------------------------------------

def wrapped(spark, d) -> DataFrame:
    """Conversation texts with answer and thought tags put in, in five ways."""
    k = F.col("turn") % 5
    s = F.col("text")
    tag = (
        F.when(k == 0, F.concat(F.lit("<think>why\nso</think> <answer> "), s, F.lit(" </answer> end")))
        .when(k == 1, F.concat(F.lit("<think>x</think>"), s))
        .when(k == 2, F.concat(F.lit("lost</think>"), s))
        .when(k == 3, F.concat(F.lit("<answer>a<think>t</think>"), s, F.lit("</answer>")))
        .otherwise(s)
    )
    return t(spark, d, "conversations").select("conv_id", "turn", tag.alias("s"))


WRAPPED = """w AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN concat('<think>why\nso</think> <answer> ', text, ' </answer> end') WHEN 1 THEN concat('<think>x</think>', text)
  WHEN 2 THEN concat('lost</think>', text) WHEN 3 THEN concat('<answer>a<think>t</think>', text, '</answer>') ELSE text END AS s FROM conversations)"""
_TRIM = "regexp_replace({}, '^[ \\t\\n\\x0b\\f\\r]+|[ \\t\\n\\x0b\\f\\r]+$', '', 'g')"
_TAG = "CASE WHEN regexp_matches(s, '(?s)<answer>(.*?)</answer>') THEN regexp_extract(s, '(?s)<answer>(.*?)</answer>', 1) ELSE {} END"
_UNTHINK = "regexp_replace({}, '(?s)<think>.*?</think>', '', 'g')"


@query(f"""WITH {WRAPPED} SELECT conv_id, turn, {_TRIM.format(_UNTHINK.format(_TAG.format('s')))} AS a, {_TRIM.format(_TAG.format('s'))} AS b,
  {_TRIM.format(_TAG.format("regexp_replace(" + _UNTHINK.format('s') + ", '(?s)^.*?</think>', '')"))} AS c FROM w""")
def answer_unwrap(spark, d):
    s = F.col("s")
    return wrapped(spark, d).select("conv_id", "turn", T.unwrap_then_unthink(s).alias("a"), T.unwrap_or_whole(s).alias("b"), T.unwrap_or_unthink(s).alias("c"))


@query("""WITH w AS (SELECT event_id, concat(CASE event_id % 4 WHEN 0 THEN 'Yes, ' WHEN 1 THEN 'No: ' WHEN 2 THEN 'Nothing, yes ' ELSE 'It is B) ' END, event_type) AS s FROM events)
SELECT event_id, CASE WHEN starts_with(lower(s), 'yes') THEN 'yes' WHEN starts_with(lower(s), 'no') THEN 'no' END AS prefix_reader, nullif(regexp_extract(lower(s), '\\b(yes|no)\\b', 1), '') AS word_reader,
  CASE WHEN starts_with(lower(s), 'yes') THEN 'yes' ELSE 'no' END AS truth, nullif(regexp_extract(upper(s), '\\b([A-D])\\b', 1), '') AS letter FROM w""")
def answer_readers(spark, d):
    k = F.col("event_id") % 4
    s = F.concat(F.when(k == 0, "Yes, ").when(k == 1, "No: ").when(k == 2, "Nothing, yes ").otherwise("It is B) "), F.col("event_type"))
    return t(spark, d, "events").select("event_id", T.prefix_polarity(s).alias("prefix_reader"), T.yes_no(s).alias("word_reader"), T.true_polarity(s).alias("truth"), T.letter_standalone(s).alias("letter"))


QUESTION = r"concat('What is part ', p_size % 7, '?\nA. ', p_name, '\nB. ', p_brand, '\nC. ', p_type, '\nD. none of these?\nChoose the correct one')"


@query(f"""WITH p AS (SELECT *, regexp_replace(trim(p_name), '\\?+$', '') AS a FROM part) SELECT p_partkey, a, p_brand AS b, p_type AS c, 'none of these' AS d, substr(regexp_replace(lower(a), '[^a-z0-9 ]', '', 'g'), 1, 55) AS na,
  concat('what is part ', p_size % 7) AS stem FROM p""")
def option_parsing(spark, d):
    q = F.expr(QUESTION.replace("\\n", "\\n"))
    o = T.options(q)
    return t(spark, d, "part").select("p_partkey", o["A"].alias("a"), o["B"].alias("b"), o["C"].alias("c"), o["D"].alias("d"), T.normal_option(o["A"]).alias("na"), T.stem(q).alias("stem"))


@query("""SELECT p_partkey, concat('What is it?\nA. ', p_brand, '\nB. none\nC. ', p_name, '\nD. ', p_type, '\nChoose the correct option.') AS asked, substr(regexp_replace(lower(p_name), '[^a-z0-9 ]', '', 'g'), 1, 55) AS picked FROM part""")
def option_permutations(spark, d):
    o = F.struct(F.col("p_name").alias("A"), F.col("p_brand").alias("B"), F.col("p_type").alias("C"), F.lit("none").alias("D"))
    perm = [1, 3, 0, 2]
    return t(spark, d, "part").select("p_partkey", T.permuted_question(F.lit("What is it?"), o, F.lit(T.DEFAULT_ORDER), perm).alias("asked"), T.permuted_pick(o, F.lit("C"), perm).alias("picked"))


@query("""WITH e AS (SELECT event_id, (event_id % 50)::INT AS m, (event_id % 60)::INT AS s, (event_id % 100)::INT AS c FROM events)
SELECT event_id, m * 60.0::DOUBLE + s + c / 100.0::DOUBLE AS cc, m * 3600.0::DOUBLE + s * 60 + c AS hh, m * 60.0::DOUBLE + s AS first_,
  CASE WHEN m * 3600.0::DOUBLE + s * 60 + c > 2000 * 1.05::DOUBLE AND m * 60.0::DOUBLE + s + c / 100.0::DOUBLE <= 2000 * 1.05::DOUBLE THEN m * 60.0::DOUBLE + s + c / 100.0::DOUBLE ELSE m * 3600.0::DOUBLE + s * 60 + c END AS fit FROM e""")
def clock_readings(spark, d):
    s = F.format_string("%02d:%02d:%02d", F.col("event_id") % 50, F.col("event_id") % 60, F.col("event_id") % 100)
    return t(spark, d, "events").select("event_id", C.hundredths_clock(s).alias("cc"), C.hours_clock(s).alias("hh"), C.first_clock(s).alias("first_"), C.clock_within(s, F.lit(2000)).alias("fit"))


@query("""WITH e AS (SELECT event_id, (event_id % 50 * 60 + event_id % 60)::DOUBLE AS a, (event_id % 50 * 60 + event_id % 60 + event_id % 7)::DOUBLE AS b FROM events)
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS n, a AS s, b AS e, CASE WHEN b > a THEN a END AS w FROM e""")
def clock_pairs(spark, d):
    clock = lambda x: F.format_string("%02d:%02d.00", F.floor(x / 60), x % 60)
    k = F.col("event_id")
    a = (k % 50) * 60 + k % 60
    s = F.concat(F.lit("from "), clock(a), F.lit(" to "), clock(a + k % 7), F.when(k % 3 == 0, " or 59:59").otherwise(""))
    p = C.clock_pairs(s)
    return t(spark, d, "events").select("event_id", F.size(p).alias("n"), p[0]["s"].alias("s"), p[0]["e"].alias("e"), C.question_window(s)["s"].alias("w"))


@query("""SELECT event_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events""")
def json_props(spark, d):
    return t(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


# --- frames and grids ----------------------------------------------------------------------------------------------------------

@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 97 + 1 AS total FROM orders), c AS (SELECT *, least(32, total) AS n FROM o)
SELECT o_orderkey, list_distinct_sorted AS idx FROM (SELECT o_orderkey, list_sort(list_distinct([CASE WHEN n = 1 THEN 0 WHEN i = n - 1 THEN total - 1 ELSE floor(i * ((total - 1)::DOUBLE / (n - 1)))::BIGINT END FOR i IN range(n)])) AS list_distinct_sorted FROM c)""")
def frame_plan_uniform(spark, d):
    return t(spark, d, "orders").select("o_orderkey", N.uniform(F.col("o_orderkey") % 97 + 1, F.lit(N.N_FRAMES)).alias("idx"))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 300 + 40 AS total, o_orderkey % 9 AS a FROM orders),
s AS (SELECT *, greatest(0, least(total - 1, round_even(greatest(0, a - 1) * 10.0, 0)::BIGINT)) AS sf, greatest(0, least(total - 1, round_even((a + 3) * 10.0, 0)::BIGINT)) AS ef FROM o),
n AS (SELECT *, least(16, ef - sf + 1) AS k FROM s),
de AS (SELECT *, list_distinct([CASE WHEN k = 1 THEN sf WHEN i = k - 1 THEN ef ELSE floor(sf + i * ((ef - sf)::DOUBLE / (k - 1)))::BIGINT END FOR i IN range(k)]) AS d FROM n),
po AS (SELECT *, [i FOR i IN range(total) IF i < sf OR i > ef] AS pool FROM de),
un AS (SELECT *, least(32 - len(d), len(pool)) AS m FROM po)
SELECT o_orderkey, list_sort(list_distinct(list_concat(d, [pool[(CASE WHEN m = 1 THEN 0 WHEN i = m - 1 THEN len(pool) - 1 ELSE floor(i * ((len(pool) - 1)::DOUBLE / (m - 1)))::BIGINT END) + 1] FOR i IN range(m)]))) AS idx FROM un""")
def frame_plan_window(spark, d):
    k = F.col("o_orderkey")
    a = (k % 9).cast("double")
    pair = F.array(F.struct(a.alias("s"), (a + 2).alias("e")))
    none = F.lit(None).cast("struct<s:double,e:double>")
    return t(spark, d, "orders").select("o_orderkey", N.plan(F.lit("mcq"), pair, none, k % 300 + 40, F.lit(10.0)).alias("idx"))


GRID = "[0.0::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE, 1.5::DOUBLE, 2.0::DOUBLE]"


@query(f"""WITH e AS (SELECT event_id, (event_id % 21) / 10.0::DOUBLE AS s, (event_id % 21) / 10.0::DOUBLE + (event_id % 4) / 10.0::DOUBLE AS e FROM events),
o AS (SELECT *, coalesce(list_max([g FOR g IN {GRID} IF g <= s + 1e-6]), 0.0::DOUBLE) AS os, coalesce(list_min([g FOR g IN {GRID} IF g >= e - 1e-6]), 2.0::DOUBLE) AS oe FROM e)
SELECT event_id, os, CASE WHEN oe <= os THEN coalesce(list_min([g FOR g IN {GRID} IF g > os]), 2.0::DOUBLE) ELSE oe END AS oe FROM o""")
def snap_outward(spark, d):
    grid = F.array(*(F.lit(x) for x in (0.0, 0.5, 1.0, 1.5, 2.0)))
    s = (F.col("event_id") % 21) / 10.0
    x = N.snap_outward(grid, s, s + (F.col("event_id") % 4) / 10.0)
    return t(spark, d, "events").select("event_id", x["s"].alias("os"), x["e"].alias("oe"))


@query("""WITH k AS (SELECT user_id, list_sort(list_distinct(list(event_id))) AS ks FROM events WHERE event_id % 3 = 0 GROUP BY 1)
SELECT event_id, (SELECT arg_min(x, (abs(x - event_id), x)) FROM (SELECT unnest(ks) AS x)) AS near FROM events JOIN k USING (user_id) WHERE event_id % 3 <> 0""")
def nearest_detection(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id")
    return nearest_keys(e.filter("event_id % 3 <> 0"), e.filter("event_id % 3 = 0"), "user_id", "event_id").select("event_id", "near")


@query("""SELECT a.event_id, arg_min(b.event_id, (abs(b.event_id - a.event_id), b.event_id)) AS near
FROM events a JOIN events b ON a.event_type = b.event_type AND b.event_id % 97 = 5 WHERE a.event_id % 97 <> 5 GROUP BY 1""")
def nearest_in_blocks(spark, d):
    """Few hot groups with sparse keys, in blocks that often hold none."""
    e = t(spark, d, "events").select("event_type", "event_id")
    return nearest_keys(e.filter("event_id % 97 <> 5"), e.filter("event_id % 97 = 5"), "event_type", "event_id", width=128).select("event_id", "near")


# --- pairing, medoids, repair ---------------------------------------------------------------------------------------------

@query("""WITH q AS (SELECT l_orderkey AS video, l_linenumber AS ord, l_partkey, CASE WHEN l_linenumber % 2 = 1 THEN 'bcq' ELSE 'bcq_openended' END AS task, l_quantity::INT % 3 AS k FROM lineitem),
m AS (SELECT x.video, x.ord AS ox, y.ord AS oy, row_number() OVER (PARTITION BY x.video, x.ord ORDER BY y.ord) AS r FROM q x JOIN q y ON x.video = y.video AND x.k = y.k AND x.task = 'bcq' AND y.task = 'bcq_openended'),
f AS (SELECT * FROM m WHERE r = 1), b AS (SELECT *, row_number() OVER (PARTITION BY video, oy ORDER BY ox DESC) AS rr FROM f)
SELECT concat(video, '-', ox) AS item, concat(video, '-', oy) AS sibling FROM f UNION ALL SELECT concat(video, '-', oy), concat(video, '-', ox) FROM b WHERE rr = 1""")
def sibling_pairs(spark, d):
    l = t(spark, d, "lineitem")
    q = F.concat(F.lit("Is it case "), (F.col("l_quantity").cast("int") % 3).cast("string"), F.lit("? "), F.when(F.col("l_linenumber") % 2 == 1, "Answer with yes or no").otherwise("Provide a reason"))
    items = l.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("item"), F.col("l_orderkey").alias("video"), F.when(F.col("l_linenumber") % 2 == 1, "bcq").otherwise("bcq_openended").alias("task"), q.alias("question"), F.col("l_linenumber").alias("ord"))
    return J.stance_siblings(items)


MEDOID = """c AS (SELECT user_id AS item, event_id AS pos, concat(event_type, ' k', event_id % 7, ' m', event_id % 3) AS value FROM events)"""
_F1 = "2.0::DOUBLE * len(list_intersect(string_split(lower(a.value), ' '), string_split(lower(b.value), ' '))) / (len(list_distinct(string_split(lower(a.value), ' '))) + len(list_distinct(string_split(lower(b.value), ' '))))"


def _medoid_sql(pool: str) -> str:
    return f"""WITH {MEDOID}, p AS ({pool}),
u AS (SELECT a.item, a.pos, any_value(a.value) AS v, list_reduce(list_concat([0.0::DOUBLE], list(CASE WHEN a.pos <> b.pos THEN {_F1} ELSE 0 END ORDER BY b.pos)), lambda m, n: m + n) AS u FROM p a JOIN p b ON a.item = b.item GROUP BY 1, 2)
SELECT item, arg_max(v, (u, -pos)) AS value FROM u GROUP BY 1"""


def medoid_pool(spark, d) -> DataFrame:
    v = F.concat_ws(" ", "event_type", F.concat(F.lit("k"), (F.col("event_id") % 7).cast("string")), F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")))
    return t(spark, d, "events").select(F.col("user_id").alias("item"), F.col("event_id").alias("pos"), v.alias("value"))


#: The cap of 48 distinct candidates is the operator's own.
_CAPPED = "SELECT item, value, pos FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY pos) AS k FROM (SELECT item, value, min(pos) AS pos FROM c GROUP BY 1, 2)) WHERE k <= 48"


@query(_medoid_sql(_CAPPED))
def medoid_token(spark, d):
    return M.medoid(medoid_pool(spark, d))


@query(_medoid_sql("SELECT item, value, pos FROM c"))
def medoid_nodedup(spark, d):
    return M.medoid(medoid_pool(spark, d), distinct=False)


@query("""WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL),
p AS (SELECT a.label, a.vec_id, CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE list_cosine_similarity(a.x, b.x) END AS s FROM e a JOIN e b ON a.label = b.label),
u AS (SELECT label, vec_id, sum(s) AS u, count(*) AS n FROM p GROUP BY 1, 2)
SELECT label, arg_max(vec_id, (round(u, 9), -vec_id)) AS vec_id, max(n) AS n, round(max(u) / greatest(max(n) - 1, 1), 9) AS mean_similarity FROM u GROUP BY 1""")
def medoid_embedding(spark, d):
    return M.medoid_vectors(t(spark, d, "embeddings"), "label", "vec_id", "embedding").withColumn("mean_similarity", F.round("mean_similarity", 9))


@query("""WITH m AS (SELECT o_custkey AS grp, o_orderkey AS item, CASE WHEN o_orderkey % 3 = 0 THEN 'No' ELSE 'Yes' END AS p, (o_orderkey % 11) / 11.0::DOUBLE AS m, CASE o_orderkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unknown' END AS v FROM orders),
n AS (SELECT *, count(*) OVER w AS c, row_number() OVER (PARTITION BY grp ORDER BY item) AS r, lead(p) OVER o AS p2, lag(p) OVER o AS p0, lead(m) OVER o AS m2, lag(m) OVER o AS m0, lead(v) OVER o AS v2, lag(v) OVER o AS v0
  FROM m WINDOW w AS (PARTITION BY grp), o AS (PARTITION BY grp ORDER BY item)),
d AS (SELECT *, (v IN ('yes', 'no') AND v <> lower(p)) AS dis, (coalesce(v2, v0) IN ('yes', 'no') AND coalesce(v2, v0) <> lower(coalesce(p2, p0))) AS odis, coalesce(m2, m0) AS om FROM n)
SELECT grp AS "group", item, CASE WHEN c = 2 AND p = coalesce(p2, p0) AND (CASE WHEN dis AND NOT odis THEN true WHEN odis AND NOT dis THEN false WHEN r = 1 THEN m <= om ELSE m < om END)
  THEN CASE WHEN p = 'Yes' THEN 'No' ELSE 'Yes' END ELSE p END AS prediction FROM d""")
def pair_repair(spark, d):
    k = F.col("o_orderkey")
    rows = t(spark, d, "orders").select(F.col("o_custkey").alias("group"), k.alias("item"), k.alias("ord"), F.when(k % 3 == 0, "No").otherwise("Yes").alias("prediction"), ((k % 11) / 11.0).alias("margin_a"), F.when(k % 5 == 0, "yes").when(k % 5 == 1, "no").otherwise("unknown").alias("verdict"))
    return R.pair_repair(rows)


@query("""SELECT d.doc_id AS item, CASE WHEN l.toxic IS NOT NULL AND d.doc_id % 4 <= 2 THEN CASE WHEN l.toxic = 1 THEN 'Yes' ELSE 'No' END ELSE 'Yes' END AS prediction FROM documents d LEFT JOIN labels l USING (doc_id)""")
def uncertain_override(spark, d):
    docs, labels = t(spark, d, "documents"), t(spark, d, "labels")
    pred = docs.select(F.col("doc_id").alias("item"), F.lit("Yes").alias("prediction"))
    verdicts = labels.select(F.col("doc_id").alias("item"), F.when(F.col("toxic") == 1, "yes").otherwise("no").alias("verdict"))
    margins = docs.select(F.col("doc_id").alias("item"), ((F.col("doc_id") % 4) / 4.0).alias("margin_a"))
    return R.override(pred, verdicts, margins)


@query("""SELECT o_orderkey AS item, CASE o_orderkey % 4 WHEN 0 THEN o_orderstatus WHEN 1 THEN o_orderpriority WHEN 2 THEN 'No' ELSE o_orderpriority END AS prediction FROM orders""")
def blank_guard(spark, d):
    k = F.col("o_orderkey")
    o = t(spark, d, "orders")
    pred = o.select(k.alias("item"), F.when(k % 4 == 0, F.col("o_orderstatus")).when(k % 4 == 1, "  ").when(k % 4 == 2, None).otherwise("").alias("prediction"))
    fall = o.select(k.alias("item"), F.when(k % 4 == 2, "").otherwise(F.col("o_orderpriority")).alias("value"))
    return R.guard(pred, fall)


@query("""SELECT o_orderkey, o_orderpriority FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')""")
def resume_anti_join(spark, d):
    done = t(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return P.resume(t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), done, item="o_orderkey")


@query("""WITH l AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) SELECT user_id, event_type, event_id FROM l WHERE r = 1""")
def last_wins(spark, d):
    e = t(spark, d, "events").select("user_id", "event_type", "event_id")
    return P.last_wins(e, "user_id", F.col("event_id"))


@query("""WITH d AS (SELECT doc_id, list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda w: w <> '')) AS xs FROM documents),
b AS (SELECT item_id, list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda w: w <> '')) AS ys FROM benchmark),
p AS (SELECT doc_id, item_id, count(*) AS k FROM (SELECT doc_id, unnest(xs) AS w FROM d) JOIN (SELECT item_id, unnest(ys) AS w FROM b) USING (w) GROUP BY 1, 2),
j AS (SELECT doc_id, item_id, k::DOUBLE / (len(xs) + len(ys) - k) AS j FROM p JOIN d USING (doc_id) JOIN b USING (item_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY j DESC, item_id) AS r FROM j)
SELECT d.doc_id, r.item_id, coalesce(r.j, 0) AS jaccard FROM d LEFT JOIN r ON r.doc_id = d.doc_id AND r.r = 1""")
def best_match(spark, d):
    return X.best_match(t(spark, d, "documents"), t(spark, d, "benchmark"), "doc_id", "item_id")


@query("""WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM benchmark), p AS (SELECT a.item_id AS x, b.item_id AS y, a.w AS wx, b.w AS wy FROM b a JOIN b b ON b.item_id = a.item_id + 1)
SELECT x, y, len(list_intersect(wx, wy))::DOUBLE / greatest(len(list_distinct(list_concat(wx, wy))), 1) AS jaccard FROM p""")
def token_jaccard(spark, d):
    b = t(spark, d, "benchmark").select("item_id", T.long_words(F.col("text")).alias("w"))
    y = b.select((F.col("item_id") - 1).alias("x"), F.col("item_id").alias("y"), F.col("w").alias("wy"))
    return b.select(F.col("item_id").alias("x"), F.col("w").alias("wx")).join(y, "x").select("x", "y", T.jaccard(F.col("wx"), F.col("wy")).alias("jaccard"))


@query("""WITH l AS (SELECT doc_id, toxic, CASE WHEN doc_id % 3 = 0 THEN 'Yes it is' WHEN doc_id % 3 = 1 THEN 'no' ELSE 'unclear' END AS p FROM labels)
SELECT 'bcq' AS task, count(*) AS n, avg((CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END IS NOT DISTINCT FROM nullif(regexp_extract(lower(p), '\\b(yes|no)\\b', 1), ''))::INT::DOUBLE) AS score FROM l""")
def exact_match_eval(spark, d):
    from corvane.operators.evaluate import scores

    k = F.col("doc_id") % 3
    rows = t(spark, d, "labels").select(F.lit("bcq").alias("task"), F.when(F.col("toxic") == 1, "Yes").otherwise("No").alias("answer"), F.when(k == 0, "Yes it is").when(k == 1, "no").otherwise("unclear").alias("prediction"))
    return scores(rows)


@query("""SELECT 0 AS src_ord, doc_id AS id, lang AS task, 'documents' AS source FROM documents UNION ALL SELECT 1, conv_id * 1000 + turn, role, 'conversations' FROM conversations""")
def union_corpus(spark, d):
    a = t(spark, d, "documents").select(F.lit(0).alias("src_ord"), F.col("doc_id").alias("id"), F.col("lang").alias("task"), F.lit("documents").alias("source"))
    return a.unionByName(t(spark, d, "conversations").select(F.lit(1).alias("src_ord"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("task"), F.lit("conversations").alias("source")))


@query("""SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INTEGER) AS k FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 4""")
def top_n_by_score(spark, d):
    w = W.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return t(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).alias("k")).filter("k <= 4")


@query(f"""WITH v AS (SELECT user_id AS item, event_type AS value, event_id AS pos, time_bucket(INTERVAL 1 hour, ts) AS w FROM events),
c AS (SELECT w, item, value, count(*) AS k, min(pos) AS p FROM v GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY w, item ORDER BY k DESC, p) AS r, CAST(sum(k) OVER (PARTITION BY w, item) AS BIGINT) AS n FROM c)
SELECT w AS start, item, value, n FROM r WHERE r = 1""")
def windowed_vote(spark, d):
    from corvane.streaming.votes import windowed_counts, winners

    out = winners(windowed_counts(t(spark, d, "events"), "user_id", "event_type", "ts", "event_id"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "item", "value", "n")


# --- readers and formats ----------------------------------------------------------------------------------------------

def said(spark, d) -> DataFrame:
    """Answers of many shapes made of the orders: k, a text."""
    k = F.col("o_orderkey")
    forms = ["(b) it is", "A. the car", "It was option C, not D", "d", "unknown to me", "No, the van", "it cannot be told", "Yes.", "none of them"]
    text = F.lit(forms[-1])
    for j, x in enumerate(forms[:-1]):
        text = F.when(k % len(forms) == j, x).otherwise(text)
    return t(spark, d, "orders").select(k.alias("k"), text.alias("x"), "o_orderpriority")


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 9 WHEN 0 THEN 'B' WHEN 1 THEN 'A' WHEN 2 THEN 'C' WHEN 3 THEN 'D' END AS leading,
  CASE o_orderkey % 9 WHEN 0 THEN 'B' WHEN 1 THEN 'A' WHEN 2 THEN 'C' WHEN 3 THEN 'D' END AS standalone,
  CASE o_orderkey % 9 WHEN 5 THEN 'no' WHEN 7 THEN 'yes' ELSE 'unknown' END AS verdict, CASE o_orderkey % 9 WHEN 5 THEN 'no' WHEN 7 THEN 'yes' END AS yes_no FROM orders""")
def answer_letters(spark, d):
    x = F.col("x")
    return said(spark, d).select("k", T.letter_leading(x).alias("leading"), T.letter_standalone(x).alias("standalone"), T.verdict(x).alias("verdict"), T.yes_no(x).alias("yes_no"))


@query("""SELECT o_orderkey AS k, concat('<think>', o_orderpriority, '</think>', chr(10), '<answer>', o_orderstatus, '</answer>') AS thought,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('{"start": "00:0', o_orderkey % 7, '", "end": ', o_orderkey % 11, '.5}') ELSE o_orderstatus END AS plain,
  concat(CASE WHEN o_orderkey % 2 = 0 THEN concat('<think>', o_orderpriority, '</think>', chr(10), '<answer>') ELSE '' END,
    CASE WHEN o_orderkey % 3 = 0 THEN concat('{"start": "00:0', o_orderkey % 7, '", "end": ', o_orderkey % 11, '.5}') ELSE o_orderstatus END, CASE WHEN o_orderkey % 2 = 0 THEN '</answer>' ELSE '' END) AS target FROM orders""")
def training_targets(spark, d):
    k = F.col("o_orderkey")
    answer = F.when(k % 3 == 0, F.concat(F.lit('{"start":"00:0'), (k % 7).cast("string"), F.lit('" ,\n "end" :'), (k % 11).cast("string"), F.lit(".5 }"))).otherwise(F.col("o_orderstatus"))
    task = F.when(k % 3 == 0, "temporal_localization").otherwise("open_qa")
    why = F.when(k % 2 == 0, F.col("o_orderpriority"))
    return t(spark, d, "orders").select(k.alias("k"), T.thought_answer(F.col("o_orderpriority"), F.col("o_orderstatus")).alias("thought"), T.target(task, why, answer, False).alias("plain"), T.target(task, why, answer, True).alias("target"))


@query("""SELECT o_orderkey AS k, concat('{"start": ', CAST((o_orderkey % 4001 - 2000) / 8.0::DOUBLE AS VARCHAR), ', "end": "caf\\u00e9 \\ud83d\\ude00 ', o_orderkey, '", "all": [', o_orderkey, ', null, 100.0, {"a": "x, y: z"}]}') AS target FROM orders""")
def json_targets(spark, d):
    """Numbers with zeros behind and with exponents, letters beyond ASCII, escapes and white space in the answers."""
    k = F.col("o_orderkey")
    number = F.format_string("%.5f", (k % 4001 - 2000) / 8.0)
    said = F.concat(F.lit('{ "start":'), number, F.lit(' ,\n"end" : "caf\u00e9 \\ud83d\\ude00 '), k.cast("string"), F.lit('","all":['), k.cast("string"), F.lit(',null,1e2,{"a":"x, y: z"}] }'))
    return t(spark, d, "orders").select("o_orderkey", T.target(F.lit("temporal_localization"), F.lit(""), said, False).alias("target")).withColumnRenamed("o_orderkey", "k")


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN '{"start": "0:05", "end": "0:1' || o_orderkey % 10 || '"}' WHEN 1 THEN '{"start": "1.5", "end": "' || o_orderkey % 50 || '"}'
  WHEN 2 THEN '{"start": "00:01.20", "end": "0:02"}' WHEN 3 THEN '{"start": "0:05", "end": "0:03.1"}' WHEN 4 THEN '{"start": "a", "end": "True"}'
  ELSE concat('{"start": "00:00", "end": "', lpad(CAST((o_orderkey % 200) // 60 AS VARCHAR), 2, '0'), ':', format('{:05.2f}', (o_orderkey % 200) % 60 + 0.125::DOUBLE), '"}') END AS interval FROM orders""")
def answer_intervals(spark, d):
    """JSON alone, in a fence, as a list's head; clocks in any order; nothing of use (JSON with text around it, one clock)."""
    k = F.col("o_orderkey")
    forms = [F.concat(F.lit(' {"start": "0:05", "end": "0:1'), (k % 10).cast("string"), F.lit('"} ')), F.concat(F.lit('So:\n```json\n[{"end": '), (k % 50).cast("string"), F.lit(', "start": 1.5}, 3]\n``` 0:09 0:10')), F.lit("from 00:01.20 on, till 0:02, not 0:07"), F.lit("ends 0:05 begins 0:03.1"), F.lit('{"start": "a", "end": true}'), F.lit('it is {"start": "9", "end": "8"} or so')]
    x = F.lit("about 0:04")
    for j, form in enumerate(forms):
        x = F.when(k % 7 == j, form).otherwise(x)
    return t(spark, d, "orders").select(k.alias("k"), C.interval_json(x, k % 200 + F.lit(0.125)).alias("interval"))


_CLOCK = "concat(lpad(CAST(CAST(floor({0}) AS BIGINT) // 60 AS VARCHAR), 2, '0'), ':', format('{{:05.2f}}', {0} - 60 * (CAST(floor({0}) AS BIGINT) // 60)))"


@query(f"""WITH x AS (SELECT o_orderkey AS k, (o_orderkey % 4001) / 16.0::DOUBLE AS s, (o_orderkey % 997) / 20.0::DOUBLE AS g, (o_orderkey % 5000) / 1000.0::DOUBLE AS h FROM orders)
SELECT k, CAST(format('{{:.1f}}', g) AS DOUBLE) AS tenth, CAST(format('{{:.1f}}', -1 - g) AS DOUBLE) AS negative, CAST(format('{{:.2f}}', h) AS DOUBLE) AS hundredth, CAST(format('{{:.4f}}', h / 7) AS DOUBLE) AS fourth, {_CLOCK.format("s")} AS clock,
  concat(lpad(CAST(CAST(round_even(s, 0) AS BIGINT) // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(CAST(round_even(s, 0) AS BIGINT) % 60 AS VARCHAR), 2, '0')) AS whole FROM x""")
def rounded_numbers(spark, d):
    from corvane.functions.rounding import python_round

    k = F.col("o_orderkey")
    s, g, h = (k % 4001) / 16.0, (k % 997) / 20.0, (k % 5000) / 1000.0
    cols = {"tenth": python_round(g, 1), "negative": python_round(-1 - g, 1), "hundredth": python_round(h, 2), "fourth": python_round(h / 7, 4), "clock": C.minutes_hundredths(s), "whole": C.minutes_seconds(s)}
    return t(spark, d, "orders").select(k.alias("k"), *(c.alias(n) for n, c in cols.items()))


@query(f"""WITH x AS (SELECT o_orderkey AS k, [o_orderkey % 50, o_orderkey % 50 + 7, o_orderkey % 50 + 8, o_orderkey % 50 + 1303] AS idx, o_orderpriority AS q FROM orders)
SELECT k, list_sort(list_distinct(list_transform(idx, lambda i: CAST(format('{{:.1f}}', i / 20.0::DOUBLE) AS DOUBLE)))) AS grid,
  concat('Video duration: ', {_CLOCK.format("(idx[4] / 20.0::DOUBLE)")}, '. 4 frames sampled:', chr(10), list_aggregate(list_transform(idx, lambda i: concat('[t=', {_CLOCK.format("(i / 20.0::DOUBLE)")}, '] <image>')), 'string_agg', chr(10)), chr(10), q) AS prompt FROM x""")
def timed_prompts(spark, d):
    k = F.col("o_orderkey")
    idx = F.array(k % 50, k % 50 + 7, k % 50 + 8, k % 50 + 1303)
    return t(spark, d, "orders").select(k.alias("k"), N.shown_grid(idx, F.lit(20.0)).alias("grid"), N.timed_prompt(idx, F.lit(20.0), F.col("o_orderpriority")).alias("prompt"))


@query("""SELECT l_orderkey AS k, l_linenumber AS n, concat('clips__', l_orderkey, '__', substring(md5(concat('clips/', l_orderkey, '.mp4', l_returnflag)), 1, 8)) AS slug, CAST(l_orderkey AS VARCHAR) AS stem FROM lineitem""")
def file_names(spark, d):
    path = F.concat(F.lit("clips/"), F.col("l_orderkey").cast("string"), F.lit(".mp4"))
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), T.slug(path, F.col("l_returnflag")).alias("slug"), T.file_stem(path).alias("stem"))


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'why ' || o_orderpriority ELSE '' END AS reasoning, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE concat('raw ', o_orderstatus) END AS answer FROM orders""")
def external_answers(spark, d):
    k = F.col("o_orderkey")
    think = F.when(k % 2 == 0, F.concat(F.lit("<think> why "), F.col("o_orderpriority"), F.lit("\n</think>"))).otherwise(F.col("o_orderpriority"))
    answer = F.when(k % 3 == 0, F.concat(F.lit("so <answer>"), F.col("o_orderstatus"), F.lit(" </answer> end"))).otherwise(F.concat(F.lit(" raw "), F.col("o_orderstatus")))
    return t(spark, d, "orders").select(k.alias("k"), T.unwrap_external(think, answer).alias("u")).select("k", "u.reasoning", "u.answer")


@query("""WITH x AS (SELECT o_orderkey AS k, o_orderkey % 97 + 1 AS total FROM orders)
SELECT k, CASE WHEN total <= 8 THEN range(0, total) ELSE list_transform(range(0, 8), lambda i: CAST(round_even(i * (total - 1) / 7.0::DOUBLE, 0) AS BIGINT)) END AS rounded,
  list_transform(range(0, 6), lambda i: i * total // 6) AS even, CAST(greatest(8, least(40, total // 2)) + greatest(8, least(40, total // 2)) % 2 AS BIGINT) AS adaptive FROM x""")
def frame_counts(spark, d):
    k = F.col("o_orderkey")
    total = k % 97 + 1
    return t(spark, d, "orders").select(k.alias("k"), N.uniform_rounded(total, 8).alias("rounded"), N.uniform_even(total, 6).alias("even"), N.adaptive_count(total.cast("double"), F.lit(0.5), 40).alias("adaptive"))


# --- the other operators ----------------------------------------------------------------------------------------------

@query("""WITH q AS (SELECT l_orderkey AS video, l_linenumber AS ord, l_partkey % 3 AS p FROM lineitem),
m AS (SELECT x.video, x.ord AS ox, y.ord AS oy, row_number() OVER (PARTITION BY x.video, x.ord ORDER BY y.ord) AS r FROM q x JOIN q y ON x.video = y.video AND x.ord % 2 = 1 AND y.ord % 2 = 0 AND abs(x.p - y.p) <= 1),
f AS (SELECT * FROM m WHERE r = 1), b AS (SELECT *, row_number() OVER (PARTITION BY video, oy ORDER BY ox DESC) AS rr FROM f)
SELECT concat(video, '-', ox) AS item, concat(video, '-', oy) AS sibling FROM f UNION ALL SELECT concat(video, '-', oy), concat(video, '-', ox) FROM b WHERE rr = 1""")
def choice_pairs(spark, d):
    """Options are four neighbours of a row of six, so questions share three or more if they start at most one apart."""
    l = t(spark, d, "lineitem")
    rows = [F.concat(F.lit(f"{x}. Option no "), (F.col("l_partkey") % 3 + k).cast("string")) for k, x in enumerate(T.LETTERS)]
    q = F.concat_ws("\n", F.lit("Which one?"), *rows, F.lit("Choose the correct option."))
    return J.choice_siblings(l.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("item"), F.col("l_orderkey").alias("video"), F.when(F.col("l_linenumber") % 2 == 1, "mcq").otherwise("mcq_openended").alias("task"), q.alias("question"), F.col("l_linenumber").alias("ord")))


@query("""SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_type WHEN 2 THEN p_name || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ' Choose one now' END ELSE '' END AS listed,
  CASE WHEN p_partkey % 4 = 1 THEN p_type || ' C. ' || p_name || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ' Choose one now' END ELSE '' END AS bracket,
  CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_type WHEN 2 THEN p_name END AS line, 'Which is it?' AS stem, CASE WHEN p_partkey % 5 = 0 THEN 'Choose the correct option.' ELSE 'Choose one now' END AS ask FROM part""")
def option_readings(spark, d):
    k = F.col("p_partkey")
    q = F.concat(F.lit("Which is it?\nA. "), F.col("p_brand"), F.lit("\n B) "), F.col("p_type"), F.lit("\nC. "), F.col("p_name"), F.when(k % 5 == 0, "").otherwise("\nChoose one now"))
    letter = F.element_at(F.array(*map(F.lit, ("A", "b", " C", "E"))), (k % 4 + 1).cast("int"))
    parts = T.question_parts(q)
    return t(spark, d, "part").select(k.alias("k"), T.option_text(q, letter).alias("listed"), T.option_text_bracket(q, letter).alias("bracket"), T.option_line(q, F.upper(letter)).alias("line"), parts["stem"].alias("stem"), parts["order"].alias("ask"))


@query("""SELECT o_orderkey AS k, 'Is ' || o_orderpriority || ' there?' AS cut, lower('Is ' || regexp_replace(o_orderpriority, '[^A-Za-z0-9 ]', '', 'g') || ' there') AS stem,
  CASE WHEN o_orderkey % 3 = 2 THEN ['car', 'red'] ELSE ['red', 'car'] END AS tokens, CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'C' END AS best FROM orders""")
def question_cuts(spark, d):
    k = F.col("o_orderkey")
    q = F.concat(F.lit(" Is "), F.col("o_orderpriority"), F.lit(" there? \n"), F.when(k % 2 == 0, "Provide the result as JSON").otherwise("Answer with yes or no. Provide the reason"))
    said = F.when(k % 3 == 2, "Car, (red) CAR").otherwise("Red car; red")
    o = F.struct(F.when(k % 3 == 0, "a red car").otherwise("a van").alias("A"), F.when(k % 3 == 0, "the red car").otherwise("bus").alias("B"), F.when(k % 3 == 1, "one car").otherwise("tram").alias("C"), F.when(k % 3 == 1, "that car").otherwise("tree").alias("D"))
    return t(spark, d, "orders").select(k.alias("k"), T.cut_format(q).alias("cut"), T.stem(T.cut_format(q)).alias("stem"), T.token_set(said).alias("tokens"), T.best_option(said, o).alias("best"))


@query("""WITH x AS (SELECT o_orderkey AS k, o_orderkey % 50 AS m, o_orderkey % 41 AS c FROM orders)
SELECT k, m * 60 + 7 + c / 100.0::DOUBLE AS qs, CASE WHEN k % 3 = 0 THEN NULL ELSE m * 60 + 9 + c / 100.0::DOUBLE END AS ds, (k % 900) / CASE WHEN k % 2 = 0 THEN 25.0::DOUBLE ELSE 30.0::DOUBLE END AS clip,
  concat('{"start": ', CAST(CAST(CASE WHEN k % 2 = 0 THEN m * 60 + 7 ELSE m * 3600 + 7 * 60 END AS DOUBLE) AS VARCHAR), ', "end": ', CAST(m * 60 + 7 + 0.25::DOUBLE AS VARCHAR), '}') AS target FROM x""")
def clock_targets(spark, d):
    """Windows that a question names, and targets in seconds, whose three-part clocks are read by the clip's length."""
    k = F.col("o_orderkey")
    n = lambda c: F.format_string("%02d", c)
    m, c = n(k % 50), n(k % 41)
    q = F.concat(F.lit("from "), m, F.lit(":07."), c, F.lit(" to "), m, F.lit(":09"), F.when(k % 3 == 0, ":").otherwise("."), c)
    answer = F.concat(F.lit('{"start": "'), m, F.lit(':07:00", "end": "'), m, F.lit(':07.25"}'))
    length = F.when(k % 2 == 0, F.greatest((k % 50 * 60 + 8), F.lit(1)).cast("double")).otherwise(1e9)
    return t(spark, d, "orders").select(k.alias("k"), C.question_window(q)["s"].alias("qs"), C.question_window_dot(F.concat(q, F.lit(" "))).getField("e").alias("ds"), C.clip_seconds(k % 900, F.when(k % 2 == 0, 25.0).otherwise(0.0)).alias("clip"), C.seconds_target(answer, length).alias("target"))


def _spread_sql(a: str, z: str, n: str) -> str:
    return f"list_transform(range(0, {n}), lambda i: CASE WHEN {n} = 1 THEN {a} WHEN i = {n} - 1 THEN {z} ELSE CAST(floor({a} + i * (({z} - {a}) / CAST({n} - 1 AS DOUBLE))) AS BIGINT) END)"


@query(f"""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 300 + 40 AS total, o_orderkey % 9 AS a, o_orderkey % 5 AS form FROM orders),
w AS (SELECT *, CASE form WHEN 0 THEN [a] WHEN 1 THEN [a] WHEN 2 THEN [a, a + 12] ELSE CAST([] AS BIGINT[]) END AS ws, CASE form WHEN 0 THEN 12 WHEN 1 THEN 16 ELSE 8 END AS n FROM o),
s AS (SELECT *, list_transform(ws, lambda x: {{'s': least(total - 1, greatest(0, (x - 1) * 10)), 'e': least(total - 1, (x + 3) * 10)}}) AS spans FROM w),
b AS (SELECT *, flatten(list_transform(spans, lambda v: {_spread_sql("v.s", "v.e", "least(n, v.e - v.s + 1)")})) AS near,
  list_filter(range(0, total), lambda f: len(list_filter(spans, lambda v: f >= v.s AND f <= v.e)) = 0) AS rest FROM s),
c AS (SELECT *, least(32 - len(near), len(rest)) AS more, len(rest) - 1 AS top FROM b),
p AS (SELECT k, total, list_sort(list_distinct(list_concat(near, CASE WHEN more <= 0 THEN CAST([] AS BIGINT[]) ELSE list_transform({_spread_sql("0", "top", "more")}, lambda j: rest[j + 1]) END))) AS idx FROM c),
e AS (SELECT *, list_filter(range(0, total), lambda f: NOT list_contains(idx, f)) AS free FROM p),
f AS (SELECT *, least(32 - len(idx), len(free)) AS m, len(free) - 1 AS z FROM e)
SELECT k, idx, CASE WHEN m > 0 THEN list_sort(list_distinct(list_concat(idx, list_transform({_spread_sql("0", "z", "m")}, lambda j: free[j + 1]))))[1:32] ELSE list_sort(idx)[1:32] END AS filled FROM f""")
def frame_plan_tasks(spark, d):
    """All branches: around the answer's window, the question's, two of the question's, and none."""
    k = F.col("o_orderkey")
    a, total, form = (k % 9).cast("double"), k % 300 + 40, k % 5
    win = lambda x: F.struct(x.alias("s"), (x + 2).alias("e"))
    task = F.element_at(F.array(*map(F.lit, ("temporal_localization", "temporal_description", "causal_linkage", "causal_linkage", "bcq"))), (form + 1).cast("int"))
    pairs = F.when(form == 1, F.array(win(a))).when(form == 2, F.array(win(a), win(a + 12))).when(form == 4, F.array(win(a))).otherwise(F.slice(F.array(win(a)), 1, 0))
    idx = N.plan(task, pairs, F.when(form == 0, win(a)), total, F.lit(10.0))
    return t(spark, d, "orders").select(k.alias("k"), total.alias("total"), idx.alias("idx")).select("k", "idx", N.filled(F.col("idx"), F.col("total")).alias("filled"))


_RINT = "CAST(round_even({0}, 0) AS BIGINT)"


#: Windows from their middle to past the clip's end, some shorter than the frames asked for; rates with fractions; speeds.
@query(f"""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 300 + 40 AS total, CASE o_orderkey % 3 WHEN 0 THEN 12.5 WHEN 1 THEN 30.0 ELSE 23.976 END::DOUBLE AS fps, (o_orderkey % 97) * 0.13::DOUBLE AS ws,
  (o_orderkey % 97) * 0.13::DOUBLE + (o_orderkey % 11) * 0.37::DOUBLE AS we, CASE o_orderkey % 4 WHEN 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS speed, o_orderkey % 1900 + 20 AS wd, o_orderkey % 1080 + 20 AS ht FROM orders),
i AS (SELECT *, greatest(0, CAST(trunc(ws * fps) AS BIGINT)) AS i0, least(total - 1, greatest(1, CAST(trunc(we * fps) AS BIGINT) - 1)) AS i1 FROM o),
m AS (SELECT *, least(8, greatest(2, i1 - i0 + 1)) AS m FROM i), n AS (SELECT *, m - m % 2 AS n FROM m),
x AS (SELECT *, list_transform(range(0, n), lambda j: CASE WHEN j = n - 1 THEN i1 ELSE {_RINT.format("j * ((i1 - i0)::DOUBLE / (n - 1)) + i0")} END) AS idx FROM n)
SELECT k, idx, list_transform(idx, lambda j: j - i0) AS local, greatest(i1 - i0 + 1, idx[-1] - i0 + 1) AS frames, fps * speed AS fps,
  CAST(greatest(32, {_RINT.format("wd * least(1.0::DOUBLE, 640.0::DOUBLE / greatest(wd, ht)) / 32")} * 32) AS INTEGER) AS w, CAST(greatest(32, {_RINT.format("ht * least(1.0::DOUBLE, 640.0::DOUBLE / greatest(wd, ht)) / 32")} * 32) AS INTEGER) AS h FROM x""")
def window_geometry(spark, d):
    k = F.col("o_orderkey")
    s = (k % 97) * 0.13
    rate = F.when(k % 3 == 0, 12.5).when(k % 3 == 1, 30.0).otherwise(23.976)
    f, size = N.window_frames(s, s + (k % 11) * 0.37, rate, k % 300 + 40, 8, F.when(k % 4 == 0, 0.5).otherwise(1.0)), N.fit_size(k % 1900 + 20, k % 1080 + 20, 640)
    return t(spark, d, "orders").select(k.alias("k"), f.alias("f"), size.alias("s")).select("k", "f.idx", "f.local", "f.frames", "f.fps", "s.w", "s.h")


@query(f"""WITH e AS (SELECT event_id, (event_id % 21) / 10.0::DOUBLE AS s, (event_id % 21) / 10.0::DOUBLE + (event_id % 4) / 10.0::DOUBLE AS e FROM events),
o AS (SELECT event_id, list_min(list_transform({GRID}, lambda g: {{'d': abs(g - s), 'k': g}})).k AS ns, list_min(list_transform({GRID}, lambda g: {{'d': abs(g - e), 'k': g}})).k AS ne FROM e)
SELECT event_id, ns, CASE WHEN ne <= ns THEN coalesce(list_min([g FOR g IN {GRID} IF g > ns]), 2.0::DOUBLE) ELSE ne END AS ne FROM o""")
def snap_nearest(spark, d):
    grid = F.array(*(F.lit(x) for x in (0.0, 0.5, 1.0, 1.5, 2.0)))
    s = (F.col("event_id") % 21) / 10.0
    x = N.snap_nearest(grid, s, s + (F.col("event_id") % 4) / 10.0)
    return t(spark, d, "events").select("event_id", x["s"].alias("ns"), x["e"].alias("ne"))


@query("""WITH x AS (SELECT o_orderkey AS k, o_orderkey % 90 AS cls, (o_orderkey % 400) AS x1, (o_orderkey % 100) / 100.0::DOUBLE AS u, (o_orderkey % 20) AS light FROM orders),
y AS (SELECT *, CAST(format('{:.4f}', x1 / 640.0::DOUBLE) AS DOUBLE) AS left_, CAST(format('{:.4f}', (x1 + 55) / 640.0::DOUBLE) AS DOUBLE) AS right_, light >= 12 AND u >= 0.25 AND cls IN (0, 1, 2, 3, 5, 7, 9, 11) AS seen FROM x)
SELECT k, CASE WHEN seen THEN left_ END AS x1, CASE WHEN seen THEN CAST(floor(right_ * 640) AS INTEGER) END AS right_pixel, CASE WHEN u < 0.3 THEN 'off' WHEN u > 0.85 THEN 'corrupt' ELSE 'correct' END AS mode,
  CASE WHEN u > 0.85 THEN [[0, 255, 0], [0, 0, 255], [255, 165, 0], [255, 255, 0]][CAST(floor(u * 4) AS INTEGER) + 1]
    WHEN cls IN (0, 1) THEN [0, 255, 0] WHEN cls IN (2, 5, 7) THEN [0, 0, 255] WHEN cls = 3 THEN [255, 165, 0] WHEN cls IN (9, 11) THEN [255, 255, 0] ELSE [200, 200, 200] END AS colour FROM y""")
def box_cues(spark, d):
    k = F.col("o_orderkey")
    u, left = (k % 100) / 100.0, (k % 400).cast("double")
    box = F.struct((k % 90).cast("int").alias("cls"), left.alias("x1"), F.lit(0.0).alias("y1"), (left + 55).alias("x2"), F.lit(9.0).alias("y2"), u.alias("conf"))
    small = N.scaled_boxes(F.array(box), F.lit(640.0), F.lit(360.0), (k % 20).cast("double"), sorted(N.COLOURS))
    mode = N.cue_mode(u)
    first = lambda c: F.try_element_at(c, F.lit(1))
    return t(spark, d, "orders").select(k.alias("k"), first(small)["x1"].alias("x1"), first(N.pixel_boxes(small, F.lit(640), F.lit(360)))["x2"].alias("right_pixel"), mode.alias("mode"), N.box_colour((k % 90), mode, u).alias("colour"))


@query("""SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events""")
def previous_value(spark, d):
    return P.with_previous(t(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value")


@query("""WITH b AS (SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 6)
SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS k FROM b""")
def top_in_order(spark, d):
    return P.top_in_order(t(spark, d, "events"), "user_id", "value", "event_id", 6).select("user_id", "event_id", "k")


@query("""SELECT user_id AS video, min(event_id) AS ord FROM events GROUP BY 1""")
def first_seen(spark, d):
    from corvane.sources.readers import first_seen as of

    return of(t(spark, d, "events").select(F.col("user_id").alias("video"), F.col("event_id").alias("ord")))


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE doc_id % 7 < 2) AS flagged FROM documents""")
def flag_counts(spark, d):
    return K.flagged(t(spark, d, "documents").select(F.when(F.col("doc_id") % 7 < 2, 0.7).otherwise(1.0).alias("downweight")))


_RICH = """c0 AS (SELECT user_id AS item, event_id AS pos, concat(event_type, ' k', event_id % 7, ' m', event_id % 3) AS value FROM events WHERE user_id % 5 < 4),
x AS (SELECT item, 0 AS part, pos, value FROM c0 WHERE item % 5 < 2 AND pos % 2 = 0 UNION ALL SELECT item, 1, pos, value FROM c0 WHERE item % 5 < 3),
g AS (SELECT item, 0 AS part, pos, value FROM c0 WHERE item % 5 = 3 AND pos % 2 = 0),
n AS (SELECT item, part, pos, value FROM x UNION ALL SELECT item, part, pos, value FROM g WHERE item IN (SELECT item FROM g GROUP BY 1 HAVING count(*) >= 2) UNION ALL
  SELECT item, 1, pos, value FROM c0 WHERE item % 5 = 3 AND item NOT IN (SELECT item FROM g GROUP BY 1 HAVING count(*) >= 2)),
c AS (SELECT item, value, row_number() OVER (PARTITION BY item ORDER BY part, pos) AS pos FROM n)"""


@query(_medoid_sql("""SELECT item, value, pos FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY pos) AS k FROM (SELECT item, value, min(pos) AS pos FROM c GROUP BY 1, 2)) WHERE item % 5 = 2 OR k <= 48""").replace(MEDOID, _RICH))
def descriptive_recipes(spark, d):
    """The compliant form: two tasks with evidence before the rich pool, one with the rich pool alone and without a
    cap, and the temporal task, whose grounded texts speak alone if there are two."""
    from corvane.plans.assemble import open_recipes

    c = medoid_pool(spark, d).filter("item % 5 < 4")
    task = F.element_at(F.array(*map(F.lit, ("open_qa", "causal_linkage", "scene_description", "temporal_description"))), (F.col("item") % 5 + 1).cast("int"))
    items = c.select("item").distinct().withColumn("task", task)
    source = F.when(F.col("item") % 5 == 3, "event").otherwise("evidence")
    pools = c.filter("item % 5 <> 2 and pos % 2 = 0").select(source.alias("source"), F.lit(0).alias("src_ord"), "item", F.lit("samples").alias("kind"), "pos", F.concat(F.lit("<think>hm</think><answer> "), "value", F.lit("</answer>")).alias("value"), task.alias("task"))
    return open_recipes(items, pools, c, compliant=True)


@query("""WITH m AS (SELECT o_custkey AS grp, o_orderkey AS item, CASE o_orderkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'No' ELSE 'Yes' END AS p0, (o_orderkey % 11) / 11.0::DOUBLE AS m, CASE o_orderkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unknown' END AS v FROM orders),
t AS (SELECT *, CASE WHEN v <> 'unknown' AND m <= 0.5 THEN CASE WHEN v = 'yes' THEN 'Yes' ELSE 'No' END ELSE p0 END AS p FROM m),
n AS (SELECT *, count(*) OVER (PARTITION BY grp) AS c, row_number() OVER o AS r, coalesce(lead(p) OVER o, lag(p) OVER o) AS op, coalesce(lead(m) OVER o, lag(m) OVER o) AS om, coalesce(lead(v) OVER o, lag(v) OVER o) AS ov FROM t WINDOW o AS (PARTITION BY grp ORDER BY item)),
q AS (SELECT *, v <> 'unknown' AND v <> lower(p) AS dis, ov <> 'unknown' AND ov <> lower(op) AS odis FROM n),
f AS (SELECT item, CASE WHEN c = 2 AND p = op AND (CASE WHEN dis AND NOT odis THEN true WHEN odis AND NOT dis THEN false WHEN r = 1 THEN m <= om ELSE m < om END) THEN CASE WHEN p = 'Yes' THEN 'No' ELSE 'Yes' END ELSE p END AS p FROM q),
a AS (SELECT item, p FROM f UNION ALL SELECT -f.item - 1, CASE WHEN f.p = 'No' AND f.item % 3 = 0 THEN 'no, it is not' WHEN f.item % 2 = 0 THEN ' ' ELSE 'open text' END FROM f)
SELECT item, CASE WHEN trim(p) <> '' THEN trim(p) WHEN item % 10 = -1 OR item % 10 = 0 THEN 'fall back' ELSE 'No' END AS prediction FROM a""")
def final_answers(spark, d):
    """Override, pair repair, no-stance texts and guard over closed items (each order) and open ones (ids below 0)."""
    from corvane.plans.assemble import finished

    o = t(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("k"))
    k = F.col("k")
    closed = o.select(k.alias("item"), F.when(k % 8 == 0, "").when(k % 8 == 1, "No").otherwise("Yes").alias("prediction"))
    pred = closed.unionByName(o.select((-k - 1).alias("item"), F.when(k % 2 == 0, " ").otherwise("open text").alias("prediction")))
    verdicts = o.select(k.alias("item"), F.when(k % 5 == 0, "yes").when(k % 5 == 1, "no").otherwise("unknown").alias("verdict"))
    margins = o.select(k.alias("item"), ((k % 11) / 11.0).alias("margin_a"))
    texts = o.select((-k - 1).alias("item"), F.when(k % 3 == 0, "no, it is not").otherwise("yes, it is").alias("value"))
    back = pred.filter("item % 10 in (0, -1)").select("item", F.lit("fall back").alias("value"))
    return finished(pred, o.select(F.col("o_custkey").alias("group"), k.alias("item"), k.alias("ord")), verdicts, margins, o.select((-k - 1).alias("item"), k.alias("sibling")), texts, back)


# --- written and read back -----------------------------------------------------------------------------------------

@query("""SELECT doc_id AS id, 'videos/' || source || '/' || doc_id AS video_path, coalesce(lang, 'none') AS task, text AS answer, source AS reasoning, 'B' AS tier, 'challenge' AS source FROM documents WHERE doc_id % 7 <> 0
UNION ALL SELECT -conv_id * 1000 - turn, 'c/' || conv_id, role, text, NULL, 'A', 'external' FROM conversations""")
def merged_corpus(spark, d):
    """The merged corpus as its files give it back: training records and external ones in one form, null fields kept."""
    from corvane.plans.corpus import write_merged
    from corvane.sources.readers import jsonl

    x = t(spark, d, "documents")
    train = x.select(F.concat_ws("/", "source", "doc_id").alias("video_id"), F.coalesce("lang", F.lit("none")).alias("task"), F.concat(F.lit("d"), "doc_id").alias("question"), F.col("text").alias("answer"), F.col("source").alias("reasoning"), F.lit(None).cast("string").alias("tier"), F.when(F.col("doc_id") % 7 == 0, "val").otherwise("train").alias("split"))
    c = t(spark, d, "conversations")
    other = c.select(F.concat(F.lit("c/"), "conv_id").alias("video_path"), F.col("role").alias("task"), F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("question"), F.col("text").alias("answer"), F.lit(None).cast("string").alias("reasoning"))
    path = shared_folder(spark)
    write_merged(train, other, "videos", path, ["none", "user", "assistant"])
    back = jsonl(spark, path, "video_path string, task string, question string, answer string, reasoning string, tier string, source string")
    number = lambda k: F.element_at(F.split("question", "-"), k).cast("long")
    key = F.when(F.col("source") == "external", -number(2) * 1000 - number(3)).otherwise(F.substring("question", 2, 30).cast("long"))
    return back.select(key.alias("id"), "video_path", "task", "answer", "reasoning", "tier", "source")


@query("""SELECT l_orderkey AS item, arg_max(l_returnflag || ' ' || l_partkey, (l_linenumber, l_returnflag || ' ' || l_partkey)) AS value, max(l_linenumber) AS number FROM lineitem GROUP BY 1""")
def pool_log(spark, d):
    """A pool written as three batches by line number, compacted after the second: the last batch of an item counts."""
    from corvane.sources import pool_log as L

    rows = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.concat_ws(" ", "l_returnflag", "l_partkey").alias("value"), F.col("l_linenumber").cast("int").alias("number"))
    path, schema = shared_folder(spark), "item long, value string, number int"
    for k, some in enumerate((F.col("number") <= 2, F.col("number").between(3, 4), F.col("number") > 4)):
        L.append(P.last_wins(rows.filter(some), "item", F.struct("number", "value")).select("item", "value", "number"), path)
        if k == 1:
            L.compact(spark, path, schema)
    return L.current(spark, path, schema)


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS item, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus || ', ' || o_orderdate WHEN o_orderkey % 3 = 1 THEN 'say "' || o_orderpriority || '",' || chr(10) || 'then' ELSE '' END AS prediction FROM orders""")
def submissions(spark, d):
    """Predictions with quotes, commas and line breaks through the CSV sink and scan; a later file overrides an earlier."""
    from corvane.sources import readers, writers

    k = F.col("o_orderkey")
    o = t(spark, d, "orders").select(k.cast("string").alias("item"), F.when(k % 3 == 0, F.concat_ws(", ", "o_orderstatus", F.col("o_orderdate").cast("string"))).when(k % 3 == 1, F.concat(F.lit('say "'), "o_orderpriority", F.lit('",\nthen'))).otherwise("").alias("prediction"), k.alias("k"))
    path = shared_folder(spark)
    writers.submission(o.filter(k % 5 != 1).select("item", F.lit("old").alias("prediction")), f"{path}/part=1")
    writers.submission(o.select("item", "prediction"), f"{path}/part=2")
    return readers.predictions(spark, path)


#: Answers of `digest_client`: by the first digit of the digest of prompt and draw.
_SAID = "md5({0} || '|' || {1})"
_ROTATED = "opts[(k + {0}) % 4 + 1]"


@query(f"""WITH c AS (SELECT conv_id, turn, conv_id || '-' || turn AS item, coalesce(text, '') AS text, (conv_id + turn) % 3 AS form FROM conversations WHERE (conv_id + turn) % 5 <> 0),
v AS (SELECT item, 'bcq' AS task, list_transform(range(5), lambda k: {_SAID.format("text", "k")}) AS m FROM c WHERE form = 0),
s AS (SELECT item, 'bcq_openended' AS task, list_transform(range(5), lambda k: {_SAID.format("text", "k")}) AS m FROM c WHERE form = 1),
o AS (SELECT item, ['one ' || conv_id, 'two', 'three ' || turn, 'four'] AS opts FROM c WHERE form = 2),
q AS (SELECT item, k, opts, md5('Which is it?' || chr(10) || 'A. ' || {_ROTATED.format(0)} || chr(10) || 'B. ' || {_ROTATED.format(1)} || chr(10) || 'C. ' || {_ROTATED.format(2)} || chr(10) || 'D. ' || {_ROTATED.format(3)} || chr(10) || 'Choose the correct option. Answer with the letter.|0') AS m FROM o, range(4) r(k)),
p AS (SELECT item, list(opts[(k + ascii(m[1]) % 4) % 4 + 1] ORDER BY k) AS picks FROM q GROUP BY 1)
SELECT item, task, list_transform(m, lambda x: CASE WHEN x[1] < '8' THEN 'yes' ELSE 'no' END) AS votes, CAST([] AS VARCHAR[]) AS picks, CAST([] AS VARCHAR[]) AS samples FROM v
UNION ALL SELECT item, task, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), list_transform(m, lambda x: CASE WHEN x[1] < '8' THEN 'Yes ' ELSE 'No ' END || x) FROM s
UNION ALL SELECT item, 'mcq', CAST([] AS VARCHAR[]), picks, CAST([] AS VARCHAR[]) FROM p""")
def generator_candidates(spark, d):
    """Votes, samples and picks of the second model for all turns that aren't done yet (a fifth are)."""
    from corvane.plans.candidates import candidates
    from corvane.sources.generate import digest_client

    k = (F.col("conv_id") + F.col("turn")) % 3
    c = t(spark, d, "conversations").withColumn("item", F.concat_ws("-", "conv_id", "turn"))
    listed = F.concat(F.lit("Which is it?\nA. one "), "conv_id", F.lit("\nB. two\nC. three "), "turn", F.lit("\nD. four?\nAnswer with the letter."))
    items = c.select("item", F.when(k == 0, "bcq").when(k == 1, "bcq_openended").otherwise("mcq").alias("task"), F.when(k == 2, listed).otherwise(F.col("text")).alias("question"), F.lit("v").alias("video"))
    done = c.filter((F.col("conv_id") + F.col("turn")) % 5 == 0).select("item", F.lit(None).cast("string").alias("err"))
    return candidates(items, done, "second", digest_client).select("item", "task", "votes", "picks", "samples")


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 97 + 1 AS total, o_orderkey % 3 AS form FROM orders), c AS (SELECT *, least(32, total) AS n FROM o),
p AS (SELECT *, CASE WHEN form = 0 THEN range(0, 64, 2) ELSE list_sort(list_distinct([CASE WHEN n = 1 THEN 0 WHEN i = n - 1 THEN total - 1 ELSE floor(i * ((total - 1)::DOUBLE / (n - 1)))::BIGINT END FOR i IN range(n)])) END AS idx FROM c)
SELECT k, form = 0 AS cached, idx, CASE form WHEN 0 THEN 0 WHEN 1 THEN greatest(0, len(idx) - 5) ELSE len(idx) END AS to_decode, CASE k % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS turns,
  'f/v__' || k || '__' || md5('v/' || k || '.mp4Is it?')[1:8] || '/frame_00000.jpg' AS first_image FROM p""")
def keyframe_stage(spark, d):
    """Records of all orders against a listing in which a third of the sets are whole, a third hold five frames and the
    rest are absent: indices, frames still to be decoded, and copies by tier."""
    from corvane.plans import keyframes as Y

    k = F.col("k")
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    r = o.select("k", F.concat(F.lit("v/"), k, F.lit(".mp4")).alias("video_id"), F.lit("bcq").alias("task"), F.lit("Is it?").alias("question"), F.lit("Yes").alias("answer"), F.lit("").alias("reasoning"), F.lit(1.0).alias("init_weight"), F.when(k % 4 == 0, "S").when(k % 4 == 1, "A").when(k % 4 == 2, "B").alias("tier"))
    slug = T.slug(F.col("video_id"), F.col("question"))
    there = F.when(k % 3 == 0, 32).otherwise(5)
    names = N.let(F.concat(F.lit("f/"), slug, F.lit("/frame_")), lambda own: F.transform(F.sequence(F.lit(0), there - 1), lambda i: F.concat(own, F.lpad(i.cast("string"), 5, "0"), F.lit(".jpg"))))
    listing = r.filter(k % 3 < 2).select(F.explode(names).alias("path"))
    saved = r.filter(k % 3 == 0).select(slug.alias("slug"), F.sequence(F.lit(0), F.lit(62), F.lit(2)).cast("array<bigint>").alias("idx"), F.lit(25.0).alias("fps"))
    staged = Y.named(checkpointed(Y.planned(r, r.select("video_id", (k % 97 + 1).alias("total"), F.lit(30.0).alias("fps")), Y.whole_sets(listing, saved))), "f")
    todo = Y.missing_frames(staged, listing).groupBy("video_id").agg(F.count("*").alias("n"))
    turns = Y.training_turns(staged, True).groupBy(F.col("images")[0].alias("first_image")).agg(F.count("*").cast("int").alias("turns"))
    out = staged.withColumn("first_image", F.col("images")[0]).join(todo, "video_id", "left").join(turns, "first_image")
    return out.select("k", "cached", "idx", F.coalesce("n", F.lit(0)).cast("int").alias("to_decode"), "turns", "first_image")


# --- no SQL: model calls behind fakes, whole plans ---------------------------------------------------------------------

@query()
def generate_with_resume(spark, d):
    from corvane.sources.generate import SCHEMA, fake_client, generate

    work = t(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("item"), F.col("role").alias("task"), F.col("text").alias("prompt"))
    done = spark.createDataFrame([], SCHEMA)
    return generate(work, done, fake_client, n=3)


@query()
def build_corpus(spark, d):
    from corvane.plans.corpus import build_records

    return build_records(talk_items(spark, d).withColumn("reasoning", F.col("answer")))


_ASSEMBLED = f"""i AS (SELECT o_orderkey AS item, o_custkey AS v, o_orderkey % 3 AS k FROM orders),
l AS (SELECT l_orderkey AS item, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag) AS n,
  CASE WHEN l_returnflag = 'N' THEN 'no' ELSE 'yes' END AS said, l_returnflag AS f FROM lineitem),
y AS (SELECT v, min(item) AS y FROM i WHERE k = 1 GROUP BY 1), x AS (SELECT v, max(item) AS x FROM i WHERE k = 0 GROUP BY 1),
votes AS (SELECT i.item, n AS pos, said AS value FROM i JOIN l USING (item) WHERE k < 2 UNION ALL
  SELECT i.item, 1000000 + n, said FROM i JOIN y USING (v) JOIN l ON l.item = y.y WHERE k = 0 UNION ALL
  SELECT y.y, 1000000 + n, said FROM y JOIN x USING (v) JOIN l ON l.item = x.x), {MAJORITY},
won AS (SELECT item, value FROM ranked WHERE r = 1),
c AS (SELECT item, n AS pos, said || ' because ' || f AS value FROM (SELECT i.item, k, n, said, f, said = coalesce(won.value, 'no') AS ok FROM i JOIN l USING (item) LEFT JOIN won USING (item) WHERE k > 0)
  QUALIFY k = 2 OR ok OR NOT bool_or(ok) OVER (PARTITION BY item))"""


def _assembled_sql(pool: str, silent: str) -> str:
    last = "SELECT item, arg_max(v, (u, -pos)) AS value FROM u GROUP BY 1"
    return _medoid_sql(pool).replace(MEDOID, _ASSEMBLED).replace(last, f"""SELECT CAST(i.item AS VARCHAR) AS item, CASE WHEN k > 0 THEN coalesce(m.value, '') WHEN won.value = 'yes' THEN 'Yes' WHEN won.value = 'no' THEN 'No' ELSE '{silent}' END AS prediction
FROM i LEFT JOIN won USING (item) LEFT JOIN ({last}) m USING (item)""")


def assembly_tables(spark, d) -> tuple[DataFrame, DataFrame]:
    """Each customer's orders are questions of three tasks; their lines are what two sources say, in a total order."""
    o = t(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 3).alias("k"))
    task = F.when(F.col("k") == 0, "bcq").when(F.col("k") == 1, "bcq_openended").otherwise("open_qa")
    items = o.select(F.col("o_orderkey").cast("string").alias("item"), F.col("o_custkey").alias("video"), task.alias("task"), F.lit("Is it there? Answer with yes or no").alias("question"), F.col("o_orderkey").alias("ord"))
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag"))
    l = t(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("item"), place.alias("n"), "l_returnflag", (F.col("l_orderkey") % 3).alias("k"))
    said = F.when(F.col("l_returnflag") == "N", "no").otherwise("yes")
    source = F.when(F.col("k") == 0, "base").when(F.col("k") == 1, "second").otherwise("second_desc")
    pools = l.select(source.alias("source"), F.lit(0).alias("src_ord"), "item", F.when(F.col("k") == 0, "votes").otherwise("samples").alias("kind"), F.col("n").alias("pos"), F.when(F.col("k") == 0, said).otherwise(F.concat(said, F.lit(" because "), F.col("l_returnflag"))).alias("value"))
    return items, pools


@query(_assembled_sql("SELECT item, value, pos FROM c", "No"))
def assembled_answers(spark, d):
    """The full recipe: own votes, stances of siblings, medoids of the texts that take the stance that won."""
    from corvane.plans.assemble import choices

    items, pools = assembly_tables(spark, d)
    pred, _ = choices(items, pools, J.stance_siblings(items), items.select("item", F.lit("").alias("prediction")))
    return pred


@query(_assembled_sql(_CAPPED, ""))
def compliant_assembly(spark, d):
    """The recipe of two models, end to end: medoids without repeats, no answer where nothing speaks."""
    from corvane.plans.assemble import compliant_answers

    items, pools = assembly_tables(spark, d)
    return compliant_answers(items, pools, J.stance_siblings(items))
