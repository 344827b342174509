"""Batch information extraction: records to prompts, prompts to responses of a
pluggable model client, responses to validated entities, attributes and
relations.

Only the client's call leaves the JVM: one client is built for each partition
of each task and fed Arrow batches. Responses are parsed and checked with
built-in functions; by default a bad one fails the job, so nothing is written,
and ``mode="quarantine"`` keeps it with its error in ``_error``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions.text import strip
from lattica.operators import responses
from lattica.plans.model import ATTRIBUTE, ENTITY, RELATION

#: The instructions that models are given; the field names and the three slots
#: are fixed by the records.
PROMPT = """
任务：把一条人物记录整理成一个 JSON 对象，除这个对象外不写别的文字。

对象有三个数组，没有内容的数组写 []：
  "entities"：记录提到的人、地点、作品、官职等，每项 {"name", "category", "evidence"}
  "attributes"：某人的字号、籍贯、职业、擅长、著述或他人评语，每项 {"subject", "attribute", "value", "evidence"}
  "relations"：谁与谁（或何地、何书、何身份）有什么联系，每项 {"source", "relation", "target", "evidence"}

"evidence" 摘录记录中的字句；记录没有写到的，一概不补。

记录编号：{record_id}
人物名：{person_name}
记录：
{source_text}
""".strip()
FENCE = r"(?is)```(?:json)?\s*(.*?)```"
PARTS = {"entities": ENTITY, "attributes": ATTRIBUTE, "relations": RELATION}
OPTIONAL = "evidence"


class Client(Protocol):
    def invoke(self, prompt: str) -> object: ...


def response_text(response: object) -> str:
    """A client's response as text: a string, or the generated_text of the
    first of a list of dicts; anything else as str() has it."""
    if isinstance(response, str):
        return response
    if isinstance(response, list) and response and isinstance(response[0], dict) and "generated_text" in response[0]:
        return str(response[0]["generated_text"])
    return str(response)


def prompt() -> Column:
    parts, rest = [], PROMPT
    for name in ("record_id", "person_name", "source_text"):
        head, _, rest = rest.partition("{" + name + "}")
        parts += [F.lit(head), F.col(name).cast("string")]
    return strip(F.concat(*parts, F.lit(rest)))


def respond(records: DataFrame, client: Callable[[], Client], store: str | None = None) -> DataFrame:
    """The records with the model's ``response``; ``client`` makes one. With a
    ``store`` (a folder, see ``responses``) a prompt is sent once for good, and
    now; without one it is sent whenever the rows are asked for."""
    asked = records.withColumn("_prompt", prompt())
    if store is not None:
        keyed = asked.withColumn("_key", responses.key(F.col("_prompt")))
        got = responses.once(keyed, client, store, response_text)
        return keyed.join(got, F.col("_key") == F.col("key"), "left").select(*records.columns, "response")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields) + ", response string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = client()
        for batch in batches:
            batch["response"] = [response_text(model.invoke(p)) for p in batch.pop("_prompt")]
            yield batch

    return asked.mapInPandas(run, schema)


def content(response: Column) -> Column:
    """The text inside the first fence, or all of it."""
    text = strip(response)
    return F.when(text.rlike(FENCE), strip(F.regexp_extract(text, FENCE, 1))).otherwise(text)


def _part(parsed: Column, name: str) -> Column:
    """An array of structs of a variant; missing is empty."""
    kind = PARTS[name]
    fields = ", ".join(f"{f}: variant" for f in kind.fieldNames())
    items = F.try_variant_get(parsed, f"$.{name}", f"array<struct<{fields}>>")
    return F.transform(items, lambda i: F.struct(*[F.try_variant_get(i[f], "$", "string").alias(f) for f in kind.fieldNames()]))


def _type(value: Column) -> Column:
    return F.schema_of_variant(value)


def _lacks(field: str) -> Callable[[Column], Column]:
    """Whether an item is no object or has no string of that name."""

    def test(item: Column) -> Column:
        value = F.try_variant_get(item, f"$.{field}", "variant")
        wrong = F.when(value.isNull(), F.lit(field != OPTIONAL)).otherwise(_type(value) != "STRING")
        return F.when(item.isNull() | ~_type(item).startswith("OBJECT"), F.lit(True)).otherwise(wrong)

    return test


def _problem(parsed: Column) -> Column:
    """What is wrong with a parsed response; null if nothing is."""
    found = [F.when(parsed.isNull(), F.lit("not JSON")), F.when(~_type(parsed).startswith("OBJECT"), F.lit("not a JSON object"))]
    for name, kind in PARTS.items():
        at = F.try_variant_get(parsed, f"$.{name}", "variant")
        found.append(F.when(at.isNotNull() & ~_type(at).startswith("ARRAY"), F.lit(f"{name} is not an array")))
        items = F.try_variant_get(parsed, f"$.{name}", "array<variant>")
        found += [F.when(F.exists(items, _lacks(f)), F.lit(f"{name}.{f} is missing or no string")) for f in kind.fieldNames()]
    return F.coalesce(*found)


def _filled(kind: T.StructType) -> Callable[[Column], Column]:
    return lambda i: F.struct(*[(F.coalesce(i[f], F.lit("")) if f == OPTIONAL else i[f]).alias(f) for f in kind.fieldNames()])


def parse(responses: DataFrame, mode: str = "abort") -> DataFrame:
    """``response`` becomes entities, attributes and relations."""
    if mode not in ("abort", "quarantine"):
        raise ValueError(f"mode is abort or quarantine, not {mode!r}")
    read = responses.withColumn("_parsed", F.try_parse_json(content(F.col("response")))).withColumn("_error", _problem(F.col("_parsed")))
    if mode == "abort":
        failed = F.raise_error(F.concat(F.lit("invalid response: "), F.col("_error")))
        read = read.withColumn("_parsed", F.when(F.col("_error").isNotNull(), failed).otherwise(F.col("_parsed")))
    out = read
    for name, kind in PARTS.items():
        items = F.coalesce(_part(F.col("_parsed"), name), F.array().cast(f"array<{kind.simpleString()}>"))
        filled = F.transform(items, _filled(kind))
        if mode == "quarantine":
            filled = F.when(F.col("_error").isNull(), filled)
        out = out.withColumn(name, filled)
    return out.drop("_parsed", "response", *(["_error"] if mode == "abort" else []))


def extract(records: DataFrame, client: Callable[[], Client], limit: int | None = None, mode: str = "abort", store: str | None = None) -> DataFrame:
    """The whole job as one plan; a limit keeps the first records by id. A
    ``store`` keeps the responses."""
    if limit is not None:
        if limit < 0:
            raise ValueError("the limit is negative")
        records = records.orderBy("record_id").limit(limit)
    return parse(respond(records, client, store), mode)


def flatten(extracted: DataFrame, part: str) -> DataFrame:
    """A row for each entity, attribute or relation, with its place."""
    return extracted.select("record_id", F.posexplode(part).alias("position", "_x")).select("record_id", "position", "_x.*")
