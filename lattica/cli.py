"""python -m lattica.cli: extract a JSON array of person records into another."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from lattica.functions.ship import ship
from lattica.operators.clients import local_model
from lattica.operators.extraction import extract
from lattica.sources.records import export_array, read_records, write_json


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--input", required=True, help="JSON array of records")
    p.add_argument("--output", required=True, help="a .json file for one array, else a folder of NDJSON")
    p.add_argument("--model-dir", required=True, help="folder of the model")
    p.add_argument("--limit", type=int, default=None, help="take the first records only")
    p.add_argument("--max-new-tokens", type=int, default=768)
    p.add_argument("--temperature", type=float, default=0.1)
    p.add_argument("--device", default="auto")
    p.add_argument("--load-in-4bit", action="store_true")
    p.add_argument("--responses", default=None, help="folder that keeps the model's responses, so that a run that broke off goes on")
    return p


def main(args: Sequence[str] | None = None, client=None, spark: SparkSession | None = None) -> None:
    a = arguments().parse_args(args)
    spark = spark or SparkSession.builder.appName("extract").getOrCreate()
    ship(spark)
    if client is None:
        client = local_model(model_dir=a.model_dir, max_new_tokens=a.max_new_tokens, temperature=a.temperature, device=a.device, load_in_4bit=a.load_in_4bit)
    found = extract(read_records(spark, a.input), client, a.limit, store=a.responses)
    if a.output.endswith(".json"):
        export_array(found, a.output, "record_id")
    else:
        write_json(found, a.output)


if __name__ == "__main__":
    main()
