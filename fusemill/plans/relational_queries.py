"""Reports, balancing, dedupe, resume, splits and the relational features that Spark brings (grouping sets, as-of and
range joins, windows). One SQL text serves both engines where the dialects agree."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from fusemill.operators import entities, reports
from fusemill.registry import register
from fusemill.sources import tables

_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shared(name: str, sql: str, spark_sql: str | None = None) -> None:
    """Register ``sql``, or ``spark_sql`` on Spark's side, over the tables as Parquet."""

    def run(spark, sf_dir, body=spark_sql or sql):
        for t in _TABLES:
            if re.search(rf"\b{t}\b", body):
                tables.table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(body)

    register(name, sql)(run)


def _split():
    """The split of an event's user."""
    return F.element_at(F.array(*map(F.lit, ["train", "dev", "test", "unseen"])), (F.col("user_id") % 4 + 1).cast("int"))


def _judged(spark, sf_dir):
    """Labels with their documents' source."""
    return tables.table(spark, sf_dir, "labels").join(tables.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")


# latency reports (A05, A09, A10, A12): events stand for calls, value for milliseconds
@register(
    "latency_summary",
    """SELECT event_type, count(*) AS n, count(value) AS valid, count(*) - count(value) AS missing, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50,
round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(stddev_samp(value), 6) AS std, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type""",
)
def latency_summary(spark, sf_dir):
    return reports.latency_summary(tables.table(spark, sf_dir, "events"), "event_type", F.col("value"))


_SPLIT = "CASE user_id % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' WHEN 2 THEN 'test' ELSE 'unseen' END"
@register(
    "split_report",
    f"""SELECT coalesce(split, 'all') AS split, count(*) AS n, round(avg(value), 6) AS mean_value, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) * 1.0 / count(*) > 0.1 AS flaky
FROM (SELECT {_SPLIT} AS split, value, event_type FROM events) x GROUP BY GROUPING SETS ((split), ())""",
)
def split_report(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    return reports.by_split(e, _split(), F.col("value"), F.col("event_type") == "error", 0.1)


@register(
    "overlap_counts",
    f"SELECT {_SPLIT} AS split, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
)
def overlap_counts(spark, sf_dir):
    return reports.distinct_members(tables.table(spark, sf_dir, "events"), _split(), "split", "user_id", "users")


@register(
    "judge_rollup",
    "SELECT coalesce(d.source, 'all') AS source, count(*) AS n, round(avg(CAST(l.quality AS DOUBLE)), 6) AS accuracy FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY GROUPING SETS ((d.source), ())",
)
def judge_rollup(spark, sf_dir):
    return reports.rolled_mean(_judged(spark, sf_dir), F.col("source"), F.col("quality"), "source")


# answerability (A21, A27, X05, X06, W23): quality 1 is answerable, toxic is masked by the audit
@register(
    "answerability_manifest",
    "SELECT d.source, count(*) AS n, sum(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END) > 0 AS any_answerable, CAST(sum(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS answerable, CAST(sum(CASE WHEN l.quality = 0 THEN 1 ELSE 0 END) AS BIGINT) AS unanswerable FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY d.source",
)
def answerability_manifest(spark, sf_dir):
    return reports.answerability(_judged(spark, sf_dir), "source", F.col("quality") == 1)


@register(
    "mask_union",
    "SELECT doc_id, min(reason) AS reason FROM (SELECT doc_id, 'audit' AS reason FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'balance' FROM labels WHERE quality = 0) x GROUP BY doc_id",
)
def mask_union(spark, sf_dir):
    labels = tables.table(spark, sf_dir, "labels")
    return reports.masks("doc_id", audit=labels.where("toxic = 1"), balance=labels.where("quality = 0"))


# splits and normalisers
@register(
    "zscore_train",
    """WITH s AS (SELECT avg(CAST(n_chars AS DOUBLE)) AS m, stddev_samp(CAST(n_chars AS DOUBLE)) AS sd FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT doc_id, round((n_chars - m) / CASE WHEN sd < 1e-8 THEN 1.0 ELSE sd END, 6) AS z FROM documents, s""",
)
def zscore_train(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    train = d.join(tables.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return reports.standardised(d, train, ["n_chars"]).select("doc_id", F.col("z_n_chars").alias("z"))


# sweeps (X02, X03, X04, W24, A22, A24)
_GRID = "g AS (SELECT t, a, k FROM (SELECT 1 AS t UNION ALL SELECT 2 UNION ALL SELECT 5) x, (SELECT 7 AS a UNION ALL SELECT 9) y, (SELECT 'support' AS k UNION ALL SELECT 'uniform') z)"
shared(
    "param_grid",
    f"WITH {_GRID} SELECT t, a, k, substr(sha256('{{\"a\":' || a || ',\"k\":\"' || k || '\",\"t\":' || t || '}}'), 1, 16) AS combo_key FROM g",
    f"WITH {_GRID} SELECT t, a, k, substr(sha2(to_json(named_struct('a', a, 'k', k, 't', t)), 256), 1, 16) AS combo_key FROM g",
)


@register(
    "best_trial",
    "SELECT o_custkey AS sweep, o_orderkey AS trial_index, o_totalprice AS score FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_orderstatus <> 'P') x WHERE r = 1",
)
def best_trial(spark, sf_dir):
    done = tables.table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    return reports.best_trials(done, "o_custkey", "o_orderkey", "o_totalprice")


@register(
    "threshold_sweep",
    """WITH t AS (SELECT 0.2 AS thr UNION ALL SELECT 0.5 UNION ALL SELECT 0.8)
SELECT CAST(thr AS DOUBLE) AS threshold, round(avg(CASE WHEN l_discount * 10 >= thr THEN l_tax ELSE 0.0 END), 6) AS mean_objective, round(avg(CAST(CASE WHEN l_discount * 10 < thr THEN 1 ELSE 0 END AS DOUBLE)), 6) AS fallback_rate FROM lineitem, t GROUP BY thr""",
)
def threshold_sweep(spark, sf_dir):
    return reports.threshold_sweep(tables.table(spark, sf_dir, "lineitem"), F.col("l_discount") * 10, F.col("l_tax"), [0.2, 0.5, 0.8])


shared("run_discrepancy", "SELECT a.l_orderkey, a.l_partkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber - 1 WHERE b.l_discount - a.l_discount >= 0.05 AND b.l_tax <= a.l_tax")
# lexicons and dictionaries
@register(
    "entity_lexicon",
    """WITH c AS (SELECT lower(p_type) AS norm, p_name AS surface, count(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2),
d AS (SELECT lower(p_type) AS norm, count(DISTINCT l_orderkey) AS df FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1)
SELECT c.norm, surface, n, df FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY n DESC, surface) AS r FROM c) c JOIN d ON d.norm = c.norm WHERE r <= 5""",
)
def entity_lexicon(spark, sf_dir):
    """Parts stand for entities, their types for norms, orders for chunks."""
    p = tables.table(spark, sf_dir, "part").select("p_partkey", F.lower("p_type").alias("norm"), F.col("p_name").alias("surface"))
    lines = tables.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").alias("chunk_id"))
    return entities.lexicon(lines.join(p, "p_partkey"))


shared(
    "phrase_dictionary",
    """SELECT match_key, canonical, source, df FROM (SELECT *, row_number() OVER (PARTITION BY match_key ORDER BY df, prio, canonical) AS r FROM (
SELECT lower(n_name) AS match_key, lower(n_name) AS canonical, 'canonical' AS source, n_regionkey + 1 AS df, 2 AS prio FROM nation UNION ALL
SELECT lower(r_name), lower(r_name), 'curated', 3, 1 FROM region UNION ALL SELECT lower(p_brand), lower(p_type), 'surface', 2, 3 FROM part) x) y WHERE r = 1""",
)
shared(
    "alias_resolve",
    "SELECT c.c_custkey, coalesce(r.r_name, n.n_name, 'unknown') AS resolved FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey AND n.n_nationkey % 2 = 0",
)
shared("quality_gates", "SELECT count(*) AS chunks, round(avg(CAST(n AS DOUBLE)), 6) AS mean_entities, round(avg(CAST(CASE WHEN n > 3 THEN 1 ELSE 0 END AS DOUBLE)), 6) AS rich_share FROM (SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) x")
shared(
    "mask_reason_counts",
    "SELECT l.quality, l.toxic, d.lang, count(*) AS n FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY CUBE (l.quality, l.toxic, d.lang)",
)
# three-way outer join of a report
shared(
    "report_join",
    """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'EMPTY' ELSE 'OK' END AS status, coalesce(CAST(l.quality AS DOUBLE), 0.0) AS metric, coalesce(b.text, '') AS answer
FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN benchmark b ON b.item_id = coalesce(d.doc_id, l.doc_id)""",
)
# what the reference lacks and Spark has (§2.12)
shared("semi_anti", "SELECT c_custkey, 'buys' AS kind FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT c_custkey, 'idle' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
shared(
    "range_join",
    "SELECT b.band, count(*) AS n FROM lineitem JOIN (SELECT 1 AS band, 0.0 AS lo, 10.0 AS hi UNION ALL SELECT 2, 10.0, 30.0 UNION ALL SELECT 3, 30.0, 60.0) b ON l_quantity >= b.lo AND l_quantity < b.hi GROUP BY b.band",
)
shared("cube_sales", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
shared("rollup_region", "SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)")
shared("intersect_except", "(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
shared("window_frames", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders")
shared(
    "tumbling",
    "SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "SELECT date_trunc('HOUR', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
shared(
    "sessions",
    """SELECT user_id, min(ts) AS started, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events) x) y GROUP BY user_id, s""",
    "SELECT user_id, w.start AS started, n FROM (SELECT user_id, session_window(ts, '30 minutes') AS w, count(*) AS n FROM events GROUP BY user_id, session_window(ts, '30 minutes')) x",
)
shared(
    "json_props",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "SELECT event_id, from_json(props, 'k BIGINT').k AS k FROM events",
)


@register(
    "distinct_users",
    "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
)
def distinct_users(spark, sf_dir):
    return reports.distinct_members(tables.table(spark, sf_dir, "events"), F.col("event_type"), "event_type", "user_id", "users")


@register("asof_price", "SELECT e.event_id, max(o.o_orderdate) AS last_order FROM events e JOIN orders o ON o.o_custkey = e.user_id AND o.o_orderdate <= e.ts GROUP BY 1")
def asof_price(spark, sf_dir):
    """As-of join without a range join: both sides in one ordered window, the last order carried forward."""
    e = tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("ts").alias("t"), "event_id", F.lit(None).cast("timestamp").alias("d"), F.lit(1).alias("kind"))
    o = tables.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t"), F.lit(None).cast("long").alias("event_id"), F.col("o_orderdate").alias("d"), F.lit(0).alias("kind"))
    w = Window.partitionBy("k").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = e.withColumn("d", F.col("d").cast(o.schema["d"].dataType)).unionByName(o).withColumn("last_order", F.last("d", ignorenulls=True).over(w))
    return both.where(F.col("event_id").isNotNull() & F.col("last_order").isNotNull()).select("event_id", "last_order")


@register("resume_anti", "SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = e.event_id)")
def resume_anti(spark, sf_dir):
    done = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"))
    return tables.missing(tables.table(spark, sf_dir, "events").select("event_id"), done, ["event_id"])


@register("dedupe_first", "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber) = 1")
def dedupe_first(spark, sf_dir):
    li = tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return tables.keep_first(li, ["l_orderkey", "l_partkey"], F.col("l_linenumber"))


@register("dedupe_last", "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber DESC) = 1")
def dedupe_last(spark, sf_dir):
    li = tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return tables.keep_last(li, ["l_orderkey", "l_partkey"], F.col("l_linenumber"))


@register(
    "shard_assign",
    """SELECT doc_id, source, greatest(floor(coalesce(b, 0) / 100000), floor(n / 20))::INT AS shard FROM (SELECT doc_id, source, sum(n_chars) OVER w AS b, count(*) OVER w AS n FROM documents
WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
)
def shard_assign(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return tables.shard_numbers(d, F.col("n_chars"), "source", ["doc_id"], 100_000, 20).drop("n_chars")


@register("upsert_docs", "SELECT doc_id, n_chars FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT doc_id, -n_chars FROM documents WHERE doc_id % 10 = 0")
def upsert_docs(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return tables.upsert(d, d.where("doc_id % 10 = 0").withColumn("n_chars", -F.col("n_chars")), ["doc_id"])
