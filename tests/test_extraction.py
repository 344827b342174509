import json

import pytest

from lattica.operators import extraction as ex
from lattica.sources import records

GOOD = {"entities": [{"name": "文彭", "category": "PERSON", "evidence": "文彭"}], "attributes": [{"subject": "文彭", "attribute": "字", "value": "寿承"}]}


class Stub:
    def invoke(self, prompt):
        rid = prompt.split("记录编号：")[1].split("\n")[0]
        body = json.dumps(GOOD, ensure_ascii=False)
        return f"说明\n```json\n{body}\n```" if rid.endswith("0") else [{"generated_text": body}]


def test_round_trip(spark, tmp_path):
    source = tmp_path / "in.json"
    source.write_text(json.dumps([{"record_id": "r10", "person_name": "文彭", "source_text": "文彭，字寿承。", "text_length": "7"}, {"record_id": 11, "person_name": "x", "source_text": "", "text_length": 0}], ensure_ascii=False), encoding="utf-8")
    got = ex.extract(records.read_records(spark, str(source)), Stub)
    rows = {r.record_id: r for r in got.collect()}
    assert rows["r10"].text_length == 7 and rows["11"].entities[0].name == "文彭"
    assert rows["r10"].attributes[0].evidence == "" and rows["r10"].relations == []
    out = tmp_path / "deep" / "out.json"
    records.export_array(got, str(out), "record_id")
    text = out.read_text(encoding="utf-8")
    assert "文彭" in text and json.loads(text)[0]["record_id"] == "11"
    records.write_json(got, str(tmp_path / "nd"))
    assert spark.read.json(str(tmp_path / "nd")).count() == 2
    assert ex.extract(records.read_records(spark, str(source)), Stub, limit=1).count() == 1
    assert ex.extract(records.read_records(spark, str(source)), Stub, limit=0).count() == 0
    with pytest.raises(ValueError):
        ex.extract(got, Stub, limit=-1)


@pytest.mark.parametrize(
    "response",
    ["no json", "[]", '"x"', '{"entities": {}}', '{"entities": [{"name": "a"}]}', '{"entities": [{"name": 1, "category": "b"}]}', '{"relations": [1]}', '{"entities": [{"name": null, "category": "b"}]}'],
)
def test_bad_responses(spark, response):
    df = spark.createDataFrame([("1", response), ("2", "{}")], "record_id string, response string")
    with pytest.raises(Exception, match="invalid response"):
        ex.parse(df).collect()
    kept = {r.record_id: r for r in ex.parse(df, "quarantine").collect()}
    assert kept["1"]._error and kept["1"].entities is None and kept["2"]._error is None and kept["2"].entities == []


def test_records_must_be_complete(spark, tmp_path):
    bad = tmp_path / "bad.json"
    bad.write_text('[{"record_id": "1", "person_name": "a", "source_text": "b"}]')
    with pytest.raises(Exception, match="lacks text_length"):
        records.read_records(spark, str(bad)).collect()
    bad.write_text('[{"record_id": "1", "person_name": "a", "source_text": "b", "text_length": "x"}]')
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cast"):
        records.read_records(spark, str(bad)).collect()


def test_flatten_and_response_text(spark):
    df = spark.createDataFrame([("1", json.dumps(GOOD))], "record_id string, response string")
    assert [tuple(r) for r in ex.flatten(ex.parse(df), "entities").collect()] == [("1", 0, "文彭", "PERSON", "文彭")]
    assert ex.response_text({"a": 1}) == "{'a': 1}" and ex.response_text([]) == "[]"


def test_command_line_and_clients(spark, tmp_path):
    from lattica import cli
    from lattica.operators.clients import LocalModel
    from lattica.plans.prompts import sparql_prompt

    source = tmp_path / "in.json"
    source.write_text(json.dumps([{"record_id": f"r{i}0", "person_name": "p", "source_text": "t", "text_length": 1} for i in range(3)]), encoding="utf-8")
    out = tmp_path / "new" / "out.json"
    cli.main(["--input", str(source), "--output", str(out), "--model-dir", "none", "--limit", "2"], client=Stub, spark=spark)
    assert [r["record_id"] for r in json.loads(out.read_text(encoding="utf-8"))] == ["r00", "r10"]
    cli.main(["--input", str(source), "--output", str(tmp_path / "nd"), "--model-dir", "none"], client=Stub, spark=spark)
    assert spark.read.json(str(tmp_path / "nd")).count() == 3
    a = cli.arguments().parse_args(["--input", "a", "--output", "b", "--model-dir", "m", "--load-in-4bit"])
    assert (a.max_new_tokens, a.temperature, a.device, a.load_in_4bit, a.limit) == (768, 0.1, "auto", True, None)
    try:
        import transformers  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="transformers"):
            LocalModel("none").invoke("x")
    assert sparql_prompt("谁？").endswith("问题：谁？\nSPARQL：") and sparql_prompt("谁？").count("SELECT") >= 5


class Counting:
    """Writes down each prompt's record; breaks at one record while a file is there."""

    def __init__(self, log, trap):
        self.log, self.trap = log, trap

    def invoke(self, prompt):
        rid = prompt.split("记录编号：")[1].split("\n")[0]
        if rid == "r7" and self.trap.exists():
            raise OSError("the model is gone")
        with self.log.open("a") as out:
            out.write(rid + "\n")
        return json.dumps(GOOD, ensure_ascii=False)


def test_a_prompt_is_sent_once(spark, tmp_path):
    log, trap, store = tmp_path / "log", tmp_path / "trap", f"file://{tmp_path}/store"
    trap.touch()
    table = spark.createDataFrame([(f"r{i % 30}", "x", f"text {i % 30}", 6) for i in range(60)], ex_schema := "record_id string, person_name string, source_text string, text_length long")
    client = lambda: Counting(log, trap)
    with pytest.raises(Exception, match="the model is gone"):
        ex.extract(table, client, store=store)
    before = log.read_text().split()
    trap.unlink()
    got = ex.extract(table, client, store=store)
    parts = [ex.flatten(got, part).count() for part in ("entities", "attributes", "relations")]
    assert parts == [60, 60, 0] and got.columns == ex.extract(table, client).columns
    assert sorted(log.read_text().split()[: len(before)]) == sorted(before) and sorted(log.read_text().split()) == sorted({f"r{i}" for i in range(30)})
    more = spark.createDataFrame([("r30", "x", "text 30", 7), ("r1", "x", "text 1", 6), (None, None, None, None)], ex_schema)
    assert ex.respond(more.where("record_id is not null"), client, store).count() == 2
    assert len(log.read_text().split()) == 31


def test_a_task_goes_on_where_its_earlier_attempt_ended(tmp_path):
    from lattica.operators import responses

    sent, at = [], f"file://{tmp_path}/part-0"

    def ask(prompt):
        if prompt == "p5" and sent.count("broken") == 0:
            sent.append("broken")
            raise OSError
        sent.append(prompt)
        return prompt.upper()

    rows = [(f"k{i}", f"p{i}") for i in range(9)]
    with pytest.raises(OSError):
        list(responses.send(iter(rows), ask, at, every=0.0))
    (tmp_path / "part-0" / ".half.parquet").write_bytes(b"PAR1 broken")
    assert sum(responses.send(iter(rows), ask, at)) == 4
    assert sorted(s for s in sent if s != "broken") == sorted(p for _, p in rows) and responses._known(at) == {k for k, _ in rows}


def test_prompts_of_a_batch_become_texts_one_at_a_time():
    import tracemalloc

    import pyarrow as pa

    from lattica.operators.responses import each

    batch = pa.RecordBatch.from_pydict({"key": [str(i) for i in range(500)], "prompt": ["x" * 100_000] * 500})
    tracemalloc.start()
    n = sum(len(prompt) for _, prompt in each(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 50_000_000 and peak < 5_000_000
