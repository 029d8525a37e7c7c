"""Requests to and responses of a model's batch interface, as columns: prompts, bodies, ids, and what comes back. Nothing here calls a model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the wire format.
ANSWER_TOOL, TRIPLES_TOOL = "format_answer", "extract_entities_and_triples"
CONTEXT_SEPARATOR = "\n\n---\n\n"
ENDPOINT = "/v1/chat/completions"
ANSWERABLE_SYSTEM = "You output only structured JSON matching the schema."
ANSWERABLE_FORMAT = (
    '{"type":"json_schema","json_schema":{"name":"answerability","strict":true,"schema":{"type":"object","properties":{"answerable":{"type":"boolean"}},'
    '"required":["answerable"],"additionalProperties":false}}}'
)

_TOOLS = "struct<custom_id:string,error:string,response:struct<status_code:int,body:struct<choices:array<struct<message:struct<tool_calls:array<struct<function:struct<name:string,arguments:string>>>>>>>>>"
_TRIPLE = "struct<subject:string,predicate:string,object:string,confidence:double,evidence:string>"
_ENTITY = "struct<surface:string,type:string>"


def custom_id(*parts: Column) -> Column:
    """Parts joined by ``::``, a ``::`` inside one written as ``__``."""
    return F.concat_ws("::", *[F.replace(p.cast("string"), F.lit("::"), F.lit("__")) for p in parts])


def custom_id_parts(value: Column) -> Column:
    return F.transform(F.split(value, "::"), lambda p: F.replace(p, F.lit("__"), F.lit("::")))


def prefixed_id(value: Column, prefix: str) -> Column:
    """What follows ``prefix::``, read back; null for other ids."""
    return F.when(F.startswith(value, F.lit(f"{prefix}::")), F.replace(F.substr(value, F.lit(len(prefix) + 3)), F.lit("__"), F.lit("::")))


def contexts(chunks: Column, with_paths: bool = False) -> Column:
    """Texts of chunks (text, path_lines); ``with_paths``: those with path lines under a header of them."""

    def one(c: Column) -> Column:
        header = F.concat(F.lit("["), F.array_join(c["path_lines"], " | "), F.lit("]\n\n"))
        return F.concat(F.when(F.coalesce(F.size(c["path_lines"]), F.lit(0)) > 0, header).otherwise(""), c["text"]) if with_paths else c["text"]

    return F.transform(chunks, one)


def messages(question: Column, chunks: Column, status: Column, template: str, system: str, with_paths: bool = False) -> Column:
    """System and user message. A template with {context} and {question} is filled in; any other is the system message and heads the prompt."""
    joined = F.when(status == "OK", F.array_join(contexts(chunks, with_paths), CONTEXT_SEPARATOR)).otherwise("")
    if "{context}" in template and "{question}" in template:
        # the context is put in last, so that nothing inside it is taken for a mark
        before, after = template.split("{context}", 1)
        fill = lambda t: F.replace(F.lit(t), F.lit("{question}"), question)
        user = F.concat(fill(before), joined, fill(after))
    else:
        ask = "Call the format_answer tool with your reasoning and a short final answer."
        user, system = F.concat(F.lit(f"{template}\n\nContext:\n"), joined, F.lit("\n\nQuestion: "), question, F.lit(f"\n\n{ask}")), template
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(system)), message("user", user))


def hash_messages(value: Column) -> Column:
    return F.sha2(F.to_json(value), 256)


def completion_body(value: Column, model: str, temperature: float = 0.0, max_tokens: int = 512, tool: str | None = ANSWER_TOOL) -> Column:
    """JSON body of a completion that must call ``tool``."""
    fields = [F.lit(model).alias("model"), value.alias("messages"), F.lit(temperature).alias("temperature"), F.lit(max_tokens).alias("max_tokens")]
    if tool:
        choice = F.struct(F.lit("function").alias("type"), F.struct(F.lit(tool).alias("name")).alias("function"))
        fields.append(choice.alias("tool_choice"))
    return F.to_json(F.struct(*fields))


def _bullets(values: Column) -> Column:
    listed = F.array_join(F.transform(F.filter(values, lambda a: F.trim(a) != ""), lambda a: F.concat(F.lit("- "), a)), "\n")
    return F.when(F.coalesce(listed, F.lit("")) == "", "(none)").otherwise(listed)


def filled(template: str, **marks: Column) -> Column:
    """The template with each {mark} replaced, null as empty."""
    out = F.lit(template)
    for name, value in marks.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def answerability_body(question: Column, golds: Column, support: Column, template: str, model: str, temperature: float = 0.0, max_tokens: int = 64) -> Column:
    """JSON body that asks whether the support answers the question."""
    user = filled(template, question=question, gold_answers=_bullets(golds), gold_support=support)
    two = F.array(F.struct(F.lit("system").alias("role"), F.lit(ANSWERABLE_SYSTEM).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))
    body = completion_body(two, model, temperature, max_tokens, tool=None)
    return F.concat(F.regexp_replace(body, r"\}$", ""), F.lit(f',"response_format":{ANSWERABLE_FORMAT}}}'))


def judge_body(question: Column, golds: Column, prediction: Column, template: str, model: str, temperature: float = 0.0, max_tokens: int = 64) -> Column:
    """JSON body that asks whether a prediction is right."""
    user = filled(template, question=question, gold_answers=_bullets(golds), prediction=prediction)
    return completion_body(F.array(F.struct(F.lit("user").alias("role"), user.alias("content"))), model, temperature, max_tokens, tool=None)


def batch_line(identity: Column, body: Column) -> Column:
    """One line of a batch's input."""
    quoted = F.regexp_replace(F.to_json(F.array(identity)), r"^\[|\]$", "")
    return F.concat(F.lit('{"custom_id":'), quoted, F.lit(f',"method":"POST","url":"{ENDPOINT}","body":'), body, F.lit("}"))


def _opened(line: Column) -> tuple[Column, Column]:
    """The response and what is wrong with it on the outside."""
    r = F.from_json(line, _TOOLS)
    fault = (
        F.when(F.coalesce(r["error"], F.lit("")) != "", "line_error")
        .when(r["response"].isNull() | (F.coalesce(r["response"]["status_code"], F.lit(0)) != 200), "non_200_response")
        .when(F.coalesce(F.size(r["response"]["body"]["choices"]), F.lit(0)) <= 0, "no_choices")
    )
    return r, fault


def _calls(r: Column, tool: str) -> Column:
    """Arguments of the first choice's calls of ``tool``."""
    calls = F.get(r["response"]["body"]["choices"], F.lit(0))["message"]["tool_calls"]
    fit = F.filter(calls, lambda c: c["function"]["name"] == tool)
    return F.coalesce(F.transform(fit, lambda c: F.coalesce(c["function"]["arguments"], F.lit("{}"))), F.array().cast("array<string>"))


def generation(line: Column) -> Column:
    """struct(custom_id, answer, reasoning, error) of a response that calls the answer tool; answer and reasoning are empty where missing."""
    r, fault = _opened(line)
    calls = _calls(r, ANSWER_TOOL)
    said = F.when(F.trim(F.get(calls, F.lit(0))) == "", "{}").otherwise(F.get(calls, F.lit(0)))
    v = F.try_parse_json(said)
    part = lambda name: F.coalesce(F.trim(F.try_variant_get(v, f"$.{name}", "string")), F.lit(""))
    has = lambda name: F.try_variant_get(v, f"$.{name}", "variant").isNotNull()
    inner = (
        F.when(F.size(calls) <= 0, "no format_answer tool call in response")
        .when(v.isNull(), "invalid tool arguments JSON")
        .when(~F.schema_of_variant(v).startswith("OBJECT"), "tool arguments must be a JSON object")
        .when(~has("answer"), "missing required field: answer")
        .when(~has("reasoning"), "missing required field: reasoning")
    )
    error = F.coalesce(fault, inner)
    return F.struct(F.coalesce(r["custom_id"], F.lit("")).alias("custom_id"), F.when(fault.isNull(), part("answer")).otherwise("").alias("answer"), F.when(fault.isNull(), part("reasoning")).otherwise("").alias("reasoning"), error.alias("error"))


def extraction(line: Column) -> Column:
    """struct(custom_id, entities, triples, error) of a response that calls the triples tool, all calls together."""
    r, fault = _opened(line)
    calls = _calls(r, TRIPLES_TOOL)
    read = F.transform(calls, lambda c: F.from_json(c, f"struct<entities:array<{_ENTITY}>,triples:array<{_TRIPLE}>>", {"mode": "PERMISSIVE"}))
    bad = F.exists(calls, lambda c: F.try_parse_json(c).isNull())
    whole = lambda name, kind: F.flatten(F.transform(read, lambda x: F.coalesce(x[name], F.array().cast(f"array<{kind}>"))))
    error = F.coalesce(fault, F.when(bad, "json_decode_error").when(F.size(calls) <= 0, "no_extract_tool_call"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return F.struct(
        F.coalesce(r["custom_id"], F.lit("")).alias("custom_id"),
        F.when(fault.isNull(), whole("entities", _ENTITY)).otherwise(none(_ENTITY)).alias("entities"),
        F.when(fault.isNull(), whole("triples", _TRIPLE)).otherwise(none(_TRIPLE)).alias("triples"),
        error.alias("error"),
    )


def support_fields(sentences: Column, titles: Column, sent_ids: Column, older: Column) -> Column:
    """Array of (sentence, title, sent_id). Titles and ids of another length than the sentences come from ``older`` (title, sent_id) if that fits, else are '' and -1."""
    n = F.size(F.coalesce(sentences, F.array().cast("array<string>")))
    fits = lambda c: F.coalesce(F.size(c) == n, F.lit(False))

    def one(s: Column, k: Column) -> Column:
        title = F.when(fits(titles), F.get(titles, k)).when(fits(older), F.get(older, k)["title"])
        number = F.when(fits(sent_ids), F.get(sent_ids, k)).when(fits(older), F.get(older, k)["sent_id"])
        return F.struct(s.alias("sentence"), F.coalesce(F.trim(title), F.lit("")).alias("title"), F.coalesce(number, F.lit(-1)).alias("sent_id"))

    return F.transform(F.coalesce(sentences, F.array().cast("array<string>")), one)


def extraction_state(status: Column, attempts: Column, extracted: Column, error: Column) -> Column:
    """struct(status, attempts, error) made consistent: success without an error, a failure with one attempt at least, else pending."""
    done = (status == "success") | (status.isNull() & F.coalesce(extracted, F.lit(False)))
    s = F.when(F.coalesce(done, F.lit(False)), "success").when(F.coalesce(status == "failed", F.lit(False)), "failed").otherwise("pending")
    tries = F.coalesce(attempts, F.lit(0))
    return F.struct(s.alias("status"), F.when(s == "pending", tries).otherwise(F.greatest(tries, F.lit(1))).alias("attempts"), F.when(s == "success", F.lit(None)).otherwise(error).cast("string").alias("error"))


def pending(status: Column, chunk_id: Column, only: Column | None = None) -> Column:
    """Whether a chunk still waits for its extraction, within the ids ``only`` if given."""
    waits = F.coalesce(status, F.lit("")) != "success"
    return waits if only is None else waits & F.array_contains(only, chunk_id)
