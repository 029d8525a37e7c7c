"""Files of a retrieval run: caches, predictions, trials, score rows, manifests, reports. Sources return typed frames, sinks write through Spark."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fusemill.checkpoint import cut

RESULT = (
    "question_id string, query string, retriever_name string, status string, error string, latency_ms map<string,double>,"
    " chunks array<struct<chunk_id:string,text:string,score:double,metadata:map<string,string>>>"
)
#: Steps of a benchmark's making, in their order (fixed values).
STEPS = ["ingest", "align", "corpus_filter", "answerability_audit"]


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; malformed ones are skipped."""
    whole = spark.read.text(path).where(F.try_parse_json("value").isNotNull())
    return whole.select(F.from_json("value", schema).alias("r")).select("r.*")


def ranked_chunks(chunks: Column) -> Column:
    """Chunks by score descending, then id, with their rank from 0."""
    fit = F.coalesce(chunks, F.array().cast("array<struct<chunk_id:string,text:string,score:double,metadata:map<string,string>>>"))
    before = lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["chunk_id"] < b["chunk_id"], -1).when(a["chunk_id"] > b["chunk_id"], 1).otherwise(0)
    return F.transform(F.array_sort(fit, before), lambda c, k: F.struct(c["chunk_id"].alias("chunk_id"), c["text"].alias("text"), c["score"].alias("score"), k.alias("rank"), c["metadata"].alias("metadata")))


def retrieval_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cached results, ranked anew; the last row of a question wins. A result that is OK without chunks is NO_CONTEXT."""
    rows = _json(spark, path, RESULT).where(F.coalesce("question_id", F.lit("")) != "").withColumn("_at", F.monotonically_increasing_id())
    last = rows.groupBy("question_id").agg(F.max_by(F.struct("query", "retriever_name", "status", "error", "latency_ms", "chunks"), "_at").alias("r")).select("question_id", "r.*")
    status = F.when((F.col("status") == "OK") & (F.coalesce(F.size("chunks"), F.lit(0)) <= 0), "NO_CONTEXT").otherwise(F.col("status"))
    return last.withColumns({"status": status, "chunks": ranked_chunks(F.col("chunks"))})


def trimmed(results: DataFrame, k: int) -> DataFrame:
    """The first ``k`` chunks of results that are OK; others, and all for k of 0 or less, as they are."""
    return results if k <= 0 else results.withColumn("chunks", F.when(F.col("status") == "OK", F.slice("chunks", 1, k)).otherwise(F.col("chunks")))


def prediction_rows(spark: SparkSession, path: str) -> DataFrame:
    """question_id, split, predicted_weight, oracle_curve, valid of predictions; rows whose weight is no number go."""
    rows = _json(spark, path, "question_id string, split string, predicted_weight string, oracle_curve array<double>, is_valid_for_router_training boolean")
    rows = rows.withColumn("predicted_weight", F.col("predicted_weight").try_cast("double")).where(F.col("predicted_weight").isNotNull() & ~F.isnan("predicted_weight"))
    return rows.withColumnRenamed("is_valid_for_router_training", "valid")


def titles(spark: SparkSession, path: str) -> DataFrame:
    """Distinct titles of a text file, or of JSON lines with a field title."""
    raw = _json(spark, path, "title string") if path.endswith(".jsonl") else spark.read.text(path).withColumnRenamed("value", "title")
    return raw.select(F.trim("title").alias("title")).where("title <> ''").distinct()


def corpus_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The corpus' chunks; an empty corpus fails."""
    rows = _json(spark, path, "chunk_id string, doc_id string, source string, title string, url string, text string, section_path array<string>, metadata map<string,string>")
    if rows.isEmpty():
        raise ValueError(f"no chunks: {path}")
    return rows


def vector_meta(spark: SparkSession, path: str) -> DataFrame:
    """row_id and chunk_id of the vector index; other columns aren't read."""
    return spark.read.parquet(path).select("row_id", "chunk_id")


def vector_hits(hits: DataFrame, meta: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits by row of the index as hits by chunk with its text; unknown rows and empty texts go. hits: question_id, row_id, score."""
    known = hits.join(meta, "row_id").join(chunks.select("chunk_id", "text"), "chunk_id")
    return known.where(F.coalesce(F.trim("text"), F.lit("")) != "").select("question_id", "chunk_id", "text", "score")


def trial_rows(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, "trial_index int, combo_key string, status string, objective_score double, elapsed_ms bigint, error string, overrides map<string,string>").where("trial_index IS NOT NULL")


def labelled_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct question ids of JSON lines."""
    return _json(spark, path, "question_id string").select(F.trim("question_id").alias("question_id")).where("question_id <> ''").distinct()


def write_rows(rows: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines, in place of what is there or behind it."""
    rows.write.mode("append" if append else "overwrite").json(path)


def write_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def write_split_predictions(rows: DataFrame, path: str) -> None:
    """JSON lines in one folder for each split."""
    rows.write.mode("overwrite").partitionBy("split").json(path)


def write_manifest(spark: SparkSession, path: str, fields: Mapping[str, object]) -> None:
    """One JSON object, keys in order."""
    spark.createDataFrame([(json.dumps(fields, sort_keys=True, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def corpus_manifest(chunks: DataFrame, artifacts: Mapping[str, str]) -> dict[str, object]:
    """Row count and content hash of the corpus (an exclusive or of the rows' hashes, so that no order matters), and its artifacts."""
    n, mark = chunks.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*chunks.columns))).first()
    return {"chunks": n, "content": f"{(mark or 0) % (1 << 64):016x}", "artifacts": dict(artifacts)}


def leaderboard(trials: DataFrame) -> DataFrame:
    """One row a trial, in order, with a column for each overridden key. trials: trial_index, combo_key, status, objective_score, elapsed_ms, overrides."""
    keys = sorted(r["k"] for r in trials.select(F.explode(F.map_keys("overrides")).alias("k")).distinct().collect())
    return trials.select("trial_index", "combo_key", "status", "objective_score", "elapsed_ms", *[F.col("overrides")[k].alias(k) for k in keys]).orderBy("trial_index")


def write_leaderboard(trials: DataFrame, path: str) -> None:
    leaderboard(trials).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def with_step(steps: DataFrame, new: DataFrame, order: Sequence[str] = tuple(STEPS)) -> DataFrame:
    """``steps`` with ``new`` in place of the steps of its names, in the fixed order, unknown ones last. Columns: step, before, after."""
    at = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("step"))
    merged = steps.join(new.select("step"), "step", "left_anti").unionByName(new)
    return merged.withColumn("place", F.when(at > 0, at).otherwise(len(order) + 1).cast("int")).orderBy("place", "step")


def step_totals(steps: DataFrame) -> DataFrame:
    """start, end, added, dropped, net over steps in order (column place)."""
    sums = lambda c: F.sum(F.greatest(c, F.lit(0)))
    t = steps.agg(F.min_by("before", F.struct("place", "step")).alias("start"), F.max_by("after", F.struct("place", "step")).alias("end"), sums(F.col("after") - F.col("before")).alias("added"), sums(F.col("before") - F.col("after")).alias("dropped"))
    return t.withColumn("net", F.col("end") - F.col("start"))


def run_summary(**artifacts: DataFrame) -> dict[str, int]:
    """Distinct question ids of each artifact of a run."""
    return {name: df.select("question_id").distinct().count() for name, df in artifacts.items()}


def missing_by_artifact(questions: DataFrame, most: int = 10, **artifacts: DataFrame) -> DataFrame:
    """artifact, question_id: the first ids, by name, that each artifact lacks; referential checks before an evaluation."""
    out = None
    for name, df in artifacts.items():
        gone = questions.select("question_id").distinct().join(df.select("question_id").distinct(), "question_id", "left_anti")
        first = gone.orderBy("question_id").limit(most).select(F.lit(name).alias("artifact"), "question_id")
        out = first if out is None else out.unionByName(first)
    return out


def upsert_answers(samples: DataFrame, new: DataFrame, old: DataFrame) -> DataFrame:
    """Every sample with its new answer, else its old one, else a blank. samples: question_id; new, old: question_id, answer."""
    n, o = new.select("question_id", F.col("answer").alias("_new")), old.select("question_id", F.col("answer").alias("_old"))
    joined = samples.join(n, "question_id", "left").join(o, "question_id", "left")
    return joined.withColumn("answer", F.coalesce("_new", "_old", F.lit(""))).drop("_new", "_old")


def retried(questions: DataFrame, cache: DataFrame, retrieve) -> DataFrame:
    """What ``retrieve`` (a frame of questions to a frame of results) gives for the questions the cache lacks; those without any result become ERROR rows."""
    todo = questions.join(cache.select("question_id").distinct(), "question_id", "left_anti")
    got = retrieve(todo)
    lost = todo.select("question_id").join(got.select("question_id").distinct(), "question_id", "left_anti").select("question_id", F.lit("ERROR").alias("status"))
    return got.unionByName(lost, allowMissingColumns=True)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Add row_id from 0 in ``order``, nulls last: rows are counted within the runs of a range partition, then shifted by the runs before.

    The runs are written once: bounds come from a sample and small runs are merged by their size, so a second pass could deal the rows otherwise.
    """
    keys = [F.asc_nulls_last(c) for c in order]
    runs = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()))
    local = runs.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*keys)))
    sizes = {r["_part"]: r["count"] for r in runs.groupBy("_part").count().collect()}
    at, shift = 0, []
    for k in range(max(sizes, default=-1) + 1):
        shift.append(at)
        at += sizes.get(k, 0)
    starts = F.array(*[F.lit(s).cast("long") for s in shift]) if shift else F.array(F.lit(0).cast("long"))
    return local.withColumn("row_id", F.get(starts, F.col("_part")) + F.col("_n") - 1).drop("_part", "_n")
