"""Model records as columns: routing decisions, latency keys, verdicts in responses, spans of evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fusemill.functions.text import collapse

_RESPONSE = "struct<error:string,response:struct<status_code:int,body:struct<choices:array<struct<message:struct<content:string>>>>>>"


def route(policy: Column, weight: Column, class_id: Column, confidence: Column, threshold: float, fallback: float) -> Column:
    """struct(dense_weight, run_dense, run_graph, fallback) of a routing policy; null where the policy is unknown or lacks its input.

    Class 1 is the dense branch. The hybrid policy takes the fallback weight while the confidence is below ``threshold``.
    """
    unit = lambda w: F.greatest(F.lit(0.0), F.least(F.lit(1.0), w))
    low = (policy == "hybrid") & (confidence < threshold)
    hard = F.when(class_id.isNotNull(), F.when(class_id == 1, 1.0).otherwise(0.0))
    given = F.when(policy == "50-50", 0.5).when(policy == "dense-only", 1.0).when(policy == "graph-only", 0.0)
    given = given.when(policy == "learned-soft", F.when(weight.isNotNull(), unit(weight))).when(policy == "hard-routing", hard)
    w = given.when((policy == "hybrid") & confidence.isNotNull() & class_id.isNotNull(), F.when(low, unit(F.lit(fallback))).otherwise(hard))
    both = policy.isin("50-50", "learned-soft") | low
    return F.when(w.isNotNull(), F.struct(w.alias("dense_weight"), (both | (w == 1.0)).alias("run_dense"), (both | (w == 0.0)).alias("run_graph"), F.coalesce(low, F.lit(False)).alias("fallback")))


def latency(retriever: Column, raw: Column, routing_input: Column) -> Column:
    """Map of the canonical latency keys that hold for a retriever. raw: map of name to milliseconds as text or number."""
    get = lambda *names: F.coalesce(*[raw[n].try_cast("double") for n in names], F.lit(0.0))
    name, total, added = F.lower(F.trim(F.coalesce(retriever, F.lit("")))), get("total_ms", "total"), F.greatest(F.lit(0.0), F.coalesce(routing_input, F.lit(0.0)))
    single = F.coalesce(raw["total"].try_cast("double"), total)
    fused = ~name.isin("dense", "graph")
    values = {
        "routing_input_ms": added,
        "router_predict_ms": get("routing_predict_ms"),
        "dense_branch_ms": F.when(name == "dense", single).when(fused & F.map_contains_key(raw, F.lit("dense_total")), get("dense_total")),
        "graph_branch_ms": F.when(name == "graph", single).when(fused & F.map_contains_key(raw, F.lit("graph_total")), get("graph_total")),
        "fusion_ms": F.when(fused, get("fusion")),
        "retrieval_stage_total_ms": F.greatest(F.lit(0.0), total + added),
    }
    every = F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*values.values()))
    return F.map_filter(every, lambda _, v: v.isNotNull())


def content(line: Column) -> Column:
    """The first choice's content of a batch response; null after an error, another status than 200, or for a malformed line."""
    r = F.from_json(line, _RESPONSE)
    fine = (F.coalesce(r["error"], F.lit("")) == "") & (r["response"]["status_code"] == 200)
    return F.when(fine, F.get(r["response"]["body"]["choices"], F.lit(0))["message"]["content"])


def verdict(line: Column, field: str = "correct") -> Column:
    """The boolean ``field`` of a response's JSON content; null for anything but true and false."""
    said = F.get_json_object(content(line), f"$.{field}")
    quoted = F.from_json(content(line), f"`{field}` boolean")[field]  # null for text, also for "true"
    return F.when(said.isin("true", "false"), quoted)


def evidence_span(evidence: Column, text: Column) -> Column:
    """struct(start, end) in code points: the text itself, else both with white space collapsed, else -1 twice."""
    span = lambda at, e: F.when(at > 0, F.struct((at - 1).alias("start"), (at - 1 + F.length(e)).alias("end")))
    none = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"))
    found = F.coalesce(span(F.position(evidence, text), evidence), span(F.position(collapse(evidence), collapse(text)), collapse(evidence)))
    return F.when((evidence != "") & (text != ""), F.coalesce(found, none)).otherwise(none)
