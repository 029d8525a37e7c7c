"""The router's training table: features, splits, normalisers, labels joined to benchmark items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The features, in the order of their vector; those that are 0 or 1; and the words they look for.
FEATURES = """
content_token_len quoted_span_count numeric_or_date_token_count named_entity_count multi_entity_indicator kg_linkable_entity_ratio noun_phrase_count
relation_cue_density max_dependency_depth coord_subordination_count bridge_composition_indicator comparison_indicator temporal_indicator numeric_count_indicator
""".split()
INDICATORS = [f for f in FEATURES if f.endswith("_indicator")]
RELATION_CUES = """
relate relation between connect influence cause found parent spouse marry head lead own part member locate born die happen award play work hold succeed predecessor
""".split()
COMPARISON_WORDS = "more less older larger smaller taller younger earlier later same different than compared compare vs versus unlike like".split()
TEMPORAL_WORDS = "when before after during since until while latest current yesterday today century decade era ancient modern".split()
MONTHS = "january february march april may june july august september october november december".split()
COUNT_CUES = ["how many", "how much", "number of", "amount of", "count", "total", "sum", "percent", "percentage"]
CONNECTIVES = "and or but while after before although".split()
QUESTION_STOP_WORDS = """
a an the and or but if in is it of on at to as by no we he be do me my up was were are for not with from that this when where who whom which what how why
her him his she has had have did does its any all our own too few per via they them their there been being than then so such
""".split()
_YEAR = r"\b(?:19|20)\d{2}\b"
_NUMBER = r"(?i)\b\d+(?:[.,]\d+)?%?\b|\b(?:first|second|third|fourth|fifth|1st|2nd|3rd|4th|5th|six|ten)\b"


def _any_word(text: Column, words: Sequence[str]) -> Column:
    return text.rlike(r"\b(?:" + "|".join(words) + r")\b")


def query_features(question: Column, entities: Column | None = None, linked: Column | None = None, parse: Column | None = None) -> Column:
    """Struct of the FEATURES of a question, all doubles; an empty question is 0 throughout.

    What patterns can tell is read from the text; the rest comes from what the caller has: ``entities`` (array of names; else runs of capitalised words
    after the first), ``linked`` (number of entities in the graph), ``parse`` (struct of noun_phrases, depth, clauses, bridge; else 0).
    """
    t = F.regexp_replace(F.coalesce(question, F.lit("")), r"^\s+|\s+$", "")
    low = F.lower(t)
    tokens = F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}]+(?:['’][\p{L}]+)?%?)"), F.lit(1))
    content = F.filter(tokens, lambda w: ~w.isin(QUESTION_STOP_WORDS))
    n = F.greatest(F.size(content), F.lit(1)).cast("double")
    names = entities if entities is not None else F.regexp_extract_all(t, F.lit(r"(?<=\s)([A-Z][\p{L}]+(?:\s+[A-Z][\p{L}]+)*)"), F.lit(1))
    distinct_names = F.size(F.array_distinct(F.filter(F.transform(names, lambda x: F.lower(F.trim(x))), lambda x: x != "")))
    numbers = F.size(F.filter(content, lambda w: w.rlike(_YEAR) | w.rlike(_NUMBER))) + F.regexp_count(t, F.lit(_YEAR))
    cues = F.size(F.filter(content, lambda w: w.isin(RELATION_CUES)))
    part = lambda name: F.coalesce(parse[name].cast("double"), F.lit(0.0)) if parse is not None else F.lit(0.0)
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)
    found = F.coalesce(linked.cast("double"), F.lit(0.0)) if linked is not None else F.lit(0.0)
    graded = F.exists(content, lambda w: (F.length(w) > 4) & (w.endswith("er") | w.endswith("est")))
    asks = low.rlike(r"\b(?:how many|how much|number of)\b") | ((numbers > 0) & low.rlike(r"\b(?:how|what).*\b(?:many|much|number)\b"))
    for cue in COUNT_CUES:
        asks = asks | F.contains(low, F.lit(cue))
    values = {
        "content_token_len": F.size(content).cast("double"),
        "quoted_span_count": F.regexp_count(t, F.lit("\"[^\"]+\"|'[^']+'")).cast("double"),
        "numeric_or_date_token_count": numbers.cast("double"),
        "named_entity_count": F.size(names).cast("double"),
        "multi_entity_indicator": flag(distinct_names >= 2),
        "kg_linkable_entity_ratio": F.least(F.lit(1.0), found / F.greatest(F.lit(1.0), F.when(F.size(names) > 0, F.size(names).cast("double")).otherwise(found))),
        "noun_phrase_count": part("noun_phrases"),
        "relation_cue_density": cues / n,
        "max_dependency_depth": part("depth"),
        "coord_subordination_count": part("clauses") + F.size(F.filter(tokens, lambda w: w.isin(CONNECTIVES))),
        "bridge_composition_indicator": flag((cues > 0) & (distinct_names >= 2) & (part("bridge") > 0)),
        "comparison_indicator": flag(_any_word(low, COMPARISON_WORDS) | graded),
        "temporal_indicator": flag(_any_word(low, TEMPORAL_WORDS + MONTHS) | t.rlike(_YEAR)),
        "numeric_count_indicator": flag(asks),
    }
    return F.struct(*[F.when(t == "", 0.0).otherwise(values[f]).alias(f) for f in FEATURES])


def fit_normaliser(rows: DataFrame, features: str = "features") -> dict[str, tuple[float, float]]:
    """Mean and sample deviation of each feature that is no indicator, over ``rows``; a deviation under 1e-8 is 1."""
    aggs = [a for f in FEATURES if f not in INDICATORS for a in (F.avg(F.col(features)[f]).alias(f"m_{f}"), F.stddev_samp(F.col(features)[f]).alias(f"s_{f}"))]
    r = rows.agg(*aggs).first()
    fine = lambda s: s if s is not None and s >= 1e-8 else 1.0
    return {f: (r[f"m_{f}"] or 0.0, fine(r[f"s_{f}"])) for f in FEATURES if f not in INDICATORS}


def normalised(features: Column, normaliser: dict[str, tuple[float, float]]) -> Column:
    """Struct of z-scores; indicators as they are."""
    return F.struct(*[((features[f] - normaliser[f][0]) / normaliser[f][1] if f in normaliser else features[f]).alias(f) for f in FEATURES])


def feature_vector(features: Column) -> Column:
    return F.array(*[F.coalesce(features[f], F.lit(0.0)) for f in FEATURES])


def prefixed(raw: str, norm: str) -> list[Column]:
    """Columns feature_raw__* and feature_norm__* of two structs."""
    return [F.col(c)[f].alias(f"feature_{name}__{f}") for name, c in (("raw", raw), ("norm", norm)) for f in FEATURES]


def active_columns(excluded: Sequence[str], mode: str = "both", n: int = len(FEATURES)) -> list[int]:
    """Places of the features that aren't excluded; none left is refused where the mode needs them."""
    unknown = set(excluded) - set(FEATURES)
    if unknown:
        raise ValueError(f"unknown features: {sorted(unknown)}")
    left = [k for k in range(n) if FEATURES[k] not in excluded]
    if not left and mode in ("both", "query-features"):
        raise ValueError("all features are excluded")
    return left


def split_sizes(n: Column, ratios: Sequence[float]) -> Column:
    """Array of whole sizes that sum to ``n``, by largest remainders; equal remainders go to the later part first."""
    total = float(sum(ratios))
    if total <= 0:
        raise ValueError("split ratios must sum to a positive value")
    exact = [n * F.lit(r / total) for r in ratios]
    whole = [F.floor(x + 1e-9) for x in exact]
    part = [F.round(x - w, 9) for x, w in zip(exact, whole, strict=True)]
    rest = n - sum(whole[1:], whole[0])

    def ahead(i: int) -> Column:
        better = [((part[j] > part[i]) | ((part[j] == part[i]) & F.lit(j > i))).cast("int") for j in range(len(ratios)) if j != i]
        return sum(better[1:], better[0])

    return F.array(*[(w + (ahead(i) < rest).cast("int")).cast("long") for i, w in enumerate(whole)])


def rank_by_hash(rows: DataFrame, keys: list[str], mark: str, tie: str) -> DataFrame:
    """Add k, the place (from 1) within the keys by ``mark`` (lower-case hex), then ``tie``.

    Rows are numbered within the first three digits of the mark, a range of its order, and shifted by the ranges before: a large key is 4,096 tasks.
    """
    head = rows.withColumn("_head", F.substr(F.col(mark), F.lit(1), F.lit(3)))
    sizes = head.groupBy(*keys, "_head").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_head", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = head.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_head").orderBy(mark, tie)))
    return local.join(starts, [*keys, "_head"]).withColumn("k", F.col("_start") + F.col("_r")).drop("_head", "_start", "_r")


def source_of(source: Column) -> Column:
    """Lower case and trimmed; an empty source is unknown."""
    out = F.lower(F.trim(F.coalesce(source, F.lit(""))))
    return F.when(out == "", "unknown").otherwise(out)


def assign_splits(rows: DataFrame, id_col: str, source_col: str, ratios: Sequence[float] = (0.7, 0.15, 0.15), seed: int = 7) -> DataFrame:
    """id, source, split (train, dev, test) of distinct ids, by seeded hash within each source."""
    ids = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col), F.col(source_col)).dropDuplicates([id_col])
    marked = ids.withColumn("_mark", F.sha2(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")), 256))
    counts = marked.groupBy(source_col).agg(F.count(F.lit(1)).alias("_all"))
    sizes = counts.withColumn("_sizes", split_sizes(F.col("_all"), ratios)).drop("_all")
    ranked = rank_by_hash(marked, [source_col], "_mark", id_col).join(sizes, source_col)
    train, dev = F.get("_sizes", F.lit(0)), F.get("_sizes", F.lit(1))
    return ranked.select(id_col, source_col, F.when(F.col("k") <= train, "train").when(F.col("k") <= train + dev, "dev").otherwise("test").alias("split"))


def balance_groups(rows: DataFrame, group: str, id_col: str, seed: int = 42, groups: int = 5) -> DataFrame:
    """Rows of as many ids in each of ``groups`` groups (0 on), as the smallest has, by seeded hash; a group without rows is refused."""
    counts = {r[group]: r["count"] for r in rows.groupBy(group).count().collect()}
    empty = [g for g in range(groups) if not counts.get(g)]
    if empty:
        raise ValueError(f"groups without a row: {empty}")
    marked = rows.withColumn("_mark", F.sha2(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")), 256))
    return rank_by_hash(marked, [group], "_mark", id_col).where(F.col("k") <= min(counts.values())).drop("_mark", "k")


def training_table(items: DataFrame, labels: DataFrame, embeddings: DataFrame, ratios: Sequence[float] = (0.7, 0.15, 0.15), seed: int = 7) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Items with a label, their split, raw and normalised features, vectors and label columns; and the normaliser, fitted on the train split.

    items: question_id, question, dataset_source; labels: question_id and label columns, the last ``pos`` of an id wins; embeddings: question_id, query_embedding.
    """
    last = labels.where(F.coalesce(F.trim("question_id"), F.lit("")) != "").groupBy("question_id").agg(F.max_by(F.struct(*[c for c in labels.columns if c not in ("question_id", "pos")]), "pos").alias("l"))
    met = items.withColumn("dataset_source", source_of(F.col("dataset_source"))).join(last, "question_id")
    splits = assign_splits(met, "question_id", "dataset_source", ratios, seed).drop("dataset_source")
    raw = met.join(splits, "question_id").join(embeddings, "question_id", "left").withColumn("features", query_features(F.col("question")))
    train = raw.where("split = 'train'")
    if train.isEmpty():
        raise ValueError("the train split is empty; change the ratios or the data")
    fitted = fit_normaliser(train)
    full = raw.withColumn("norm", normalised(F.col("features"), fitted))
    return full.select("question_id", "question", "dataset_source", "split", "l.*", *prefixed("features", "norm"), feature_vector(F.col("features")).alias("feature_vector_raw"), feature_vector(F.col("norm")).alias("feature_vector_norm"), "query_embedding"), fitted


def checked_embeddings(items: DataFrame, cache: DataFrame, provider: str, model: str, mode: str = "required") -> DataFrame:
    """question_id, query_embedding from the cache rows of the same text hash, provider and model, the last ``pos`` of an id.

    mode required refuses a missing or empty vector, prefer leaves it null. items: question_id, text_hash; cache: question_id, text_hash, provider, model, embedding, pos.
    """
    fit = cache.where((F.col("provider") == provider) & (F.col("model") == model) & (F.coalesce(F.size("embedding"), F.lit(0)) > 0))
    last = fit.groupBy("question_id", "text_hash").agg(F.max_by("embedding", "pos").alias("query_embedding"))
    out = items.join(last, ["question_id", "text_hash"], "left").select("question_id", "query_embedding")
    if mode == "required":
        n = out.where(F.col("query_embedding").isNull()).count()
        if n:
            raise ValueError(f"{n} questions have no vector of {provider}/{model}")
    return out


def cache_mode(provider: str, mode: str) -> str:
    """auto means required for a remote provider, off for a local one."""
    return mode if mode != "auto" else ("off" if provider == "sentence-transformers" else "required")


def split_ids(rows: DataFrame) -> DataFrame:
    """split, question_ids (sorted), total, eligible, ignored. rows: split, question_id, valid."""
    ids = F.sort_array(F.collect_set("question_id")).alias("question_ids")
    return rows.groupBy("split").agg(ids, F.count(F.lit(1)).alias("total"), F.count_if("valid").alias("eligible"), F.count_if(~F.coalesce("valid", F.lit(False))).alias("ignored"))


def ignored_ids(rows: DataFrame) -> DataFrame:
    """split, question_ids (distinct, sorted), total of the rows that can't train."""
    gone = rows.where(~F.coalesce("valid", F.lit(False)))
    return gone.groupBy("split").agg(F.sort_array(F.collect_set("question_id")).alias("question_ids"), F.count_distinct("question_id").alias("total"))


def eligible(rows: DataFrame, task: str) -> DataFrame:
    """Rows that may train for a task: regression or classification; without a flag of its own classification takes regression's."""
    own = "is_valid_for_router_training_classification"
    flag = own if task == "classification" and own in rows.columns else "is_valid_for_router_training"
    return rows.where(F.coalesce(F.col(flag), F.lit(False)))
