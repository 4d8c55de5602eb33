"""Mixes with filters inside the scan, user's data sources, rows dropped and counted, and samples of unknown shape."""

import json
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from vellum.functions import samples
from vellum.operators import drops
from vellum.sources import datasets

SCHEMA = "id long, name string, score double"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Sources of each kind with ids that tell them apart, one that is broken and one that isn't there."""
    at = tmp_path_factory.mktemp("mix")
    rows = [{"id": i, "name": f"n{i % 7}" if i % 5 else None, "score": float(i), "more": i} for i in range(4000)]
    pq.write_table(pa.Table.from_pylist(rows), at / "a.parquet", row_group_size=250)
    (at / "b.jsonl").write_text("".join(json.dumps({"id": 5000 + i, "name": "é x" * (i % 3), "other": [1]}) + "\n\n" * (i % 2) for i in range(999)) + '{"id": 5999, "name": "last"}')
    (at / "c.json").write_text(json.dumps([{"id": 6000 + i, "score": 0.5} for i in range(10)]))
    (at / "d.csv").write_text('name,id,score\n"two\nlines",7000,1.5\n,7001,\n')
    with pa.OSFile(str(at / "e.arrow"), "wb") as file, pa.ipc.new_file(file, pa.schema([("id", pa.int64())])) as out:
        out.write_table(pa.table({"id": [8000, 8001, None]}))
    (at / "broken.parquet").write_bytes(b"not parquet at all")
    (at / "broken.jsonl").write_text('{"id": 1}\n{"id": \n')
    kinds = [("a.parquet", "parquet"), ("b.jsonl", "jsonl"), ("c.json", "json"), ("d.csv", "csv"), ("e.arrow", "arrow"), ("broken.parquet", "parquet"), ("broken.jsonl", "jsonl"), ("none.parquet", "parquet")]
    return at, [{"path": str(at / name), "data_type": kind, "data_folder": f"/data/{kind}"} for name, kind in kinds]


@pytest.mark.parametrize("split", [3000, 1 << 30])
def test_mix(spark, folder, split):
    """Each row once, however files are cut; files that can't be read are one row each."""
    at, sources = folder
    rows = datasets.mix(spark, sources, SCHEMA, split)
    got = rows.where(datasets.readable()).collect()
    want = [*range(4000), *range(5000, 6000), *range(6000, 6010), 7000, 7001, 8000, 8001]
    assert sorted(r.id for r in got if r.id is not None) == want and sum(r.id is None for r in got) == 1
    by = {r.id: r for r in got}
    assert by[7000].name == "two\nlines" and by[7001].name is None and by[6003].score == 0.5 and by[5001].name == "é x"
    assert by[0].data_folder == "/data/parquet" and by[0].source_file.endswith("a.parquet")
    assert sorted(r.source_file.split("/")[-1] for r in rows.where("unreadable IS NOT NULL").collect()) == ["broken.jsonl", "broken.parquet", "none.parquet"]


def test_mix_filters_in_the_scan(spark, folder, capsys):
    at, sources = folder
    rows = datasets.mix(spark, sources, SCHEMA, 3000)
    plain = [r for r in rows.collect()]
    for condition, keep in (
        ("id >= 3500 AND id < 5010", lambda r: r.id is not None and 3500 <= r.id < 5010), ("name IS NULL", lambda r: r.name is None), ("name = 'n3' OR id = 1", lambda r: r.name == "n3" or r.id == 1),
        ("name LIKE 'n%' AND NOT id IN (1, 2, 3)", lambda r: (r.name or "").startswith("n") and r.id not in (1, 2, 3)), ("name <=> NULL", lambda r: r.name is None),
        ("NOT (name <=> 'n1')", lambda r: r.name != "n1"), ("score > 3990", lambda r: r.score is not None and r.score > 3990), ("name <> 'n1'", lambda r: r.name not in (None, "n1")),
    ):
        got = Counter(r.id for r in rows.where(condition).where(datasets.readable()).collect())
        assert got == Counter(r.id for r in plain if r.unreadable is None and keep(r)), condition
    chosen = rows.where("id >= 3500 AND score > 1")
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line and "score" in line]
    assert filters and not any("(id#" in line and ">= 3500" in line for line in filters), plan
    assert rows.rdd.getNumPartitions() > len(sources)


def test_mix_lists(spark, folder, tmp_path):
    at, sources = folder
    (tmp_path / "mix.json").write_text(json.dumps({"datasets": sources[:1]}))
    assert datasets.mix(spark, str(tmp_path / "mix.json"), SCHEMA).count() == 4000
    yaml = pytest.importorskip("yaml")
    (tmp_path / "mix.yaml").write_text(yaml.safe_dump(sources[2:3]))
    assert datasets.mix(spark, str(tmp_path / "mix.yaml"), SCHEMA).count() == 10
    with pytest.raises(Exception, match="unknown kind"):
        datasets.mix(spark, [{"path": "x", "data_type": "xml"}], SCHEMA).collect()


USER = """
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TIMES = 3

class Steps(DataSourceReader):
    def __init__(self, n):
        self.n = n
    def partitions(self):
        return [InputPartition(i) for i in range(self.n)]
    def read(self, part):
        for k in range(TIMES):
            yield part.value, f"row {k}"

class Mine(DataSource):
    @classmethod
    def name(cls):
        return "mine"
    def schema(self):
        return "part int, text string"
    def reader(self, schema):
        return Steps(int(self.options["n"]))

class Plain:
    pass
"""


def test_custom_class(spark, tmp_path):
    path = tmp_path / "mine.py"
    path.write_text(USER)
    rows = datasets.custom(spark, str(path), "Mine", n=4)
    assert rows.rdd.getNumPartitions() == 4 and rows.count() == 12 and rows.agg(F.max("text")).first()[0] == "row 2"
    with pytest.raises(TypeError, match="must derive from DataSource"):
        datasets.custom(spark, str(path), "Plain")
    with pytest.raises(AttributeError):
        datasets.custom(spark, str(path), "Nobody")
    with pytest.raises(FileNotFoundError):
        datasets.custom(spark, str(tmp_path / "nowhere.py"), "Mine")


def test_drops(spark, tmp_path):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 10 > 0, F.col("id")).alias("n"))
    stage = drops.Drops("length", absent=F.col("n").isNull(), long=F.col("n") > 900, even=F.col("n") % 2 == 0)
    with pytest.raises(ValueError, match="no rows yet"):
        stage.counts()
    kept = stage.kept(rows)
    kept.write.parquet(str(tmp_path / "kept"))
    assert stage.counts() == {"rows": 1000, "absent": 100, "long": 90, "even": 360, "kept": 450}
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 450
    assert drops.report(spark, [stage]).where("reason = 'long'").first().n == 90
    with pytest.raises(ValueError, match="in use"):
        stage.kept(rows)
    none = drops.Drops("empty", absent=F.col("id").isNull())
    none.kept(spark.range(0)).write.format("noop").mode("overwrite").save()
    assert none.counts() == {"rows": 0, "absent": 0, "kept": 0}


AGAIN = """
import os, sys
sys.path.insert(0, {root!r})
from pyspark import TaskContext
from pyspark.sql import functions as F
from vellum.operators import drops
from vellum.session import build_session

spark = build_session("again", "local[2,4]", **{{"spark.sql.shuffle.partitions": "2", "spark.ui.showConsoleProgress": "false"}})

def once(batches):
    done = False
    for batch in batches:
        yield batch
    mark = {mark!r} + str(TaskContext.get().partitionId())
    if not os.path.exists(mark):
        open(mark, "w").close()
        raise RuntimeError("the first attempt fails when its rows have been counted")

stage = drops.Drops("again", odd=F.col("id") % 2 == 1)
stage.kept(spark.range(0, 100, 1, 4)).mapInArrow(once, "id long").write.format("noop").mode("overwrite").save()
print("COUNTS", stage.counts())
"""


def test_tasks_that_run_again_count_once(tmp_path):
    """Each task fails once, after it has counted its rows."""
    root = str(Path(__file__).resolve().parent.parent)
    script = AGAIN.format(root=root, mark=str(tmp_path / "mark"))
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300)
    assert "COUNTS {'rows': 100, 'odd': 50, 'kept': 50}" in out.stdout, out.stderr[-2000:]
    assert len(list(tmp_path.glob("mark*"))) == 4


def variants(spark, values):
    rows = spark.createDataFrame([(i, v if isinstance(v, str) or v is None else json.dumps(v)) for i, v in enumerate(values)], "i int, raw string")
    return rows.select("i", "raw", F.try_parse_json("raw").alias("v"))


RULES = {
    "required": ["page", "box"],
    "properties": {
        "page": {"type": "integer"}, "box": {"type": "array"}, "zoom": {"type": "number", "enum": [1, 2, 0.5]}, "mode": {"type": "string", "enum": ["a", "b", None]},
        "deep": {"type": "object", "required": ["x"], "properties": {"x": {"type": "boolean"}, "y'z": {"type": "string"}}}, "any": {}, "odd": {"type": "tuple"},
    },
}


def brute(value, schema, where=""):
    if not isinstance(value, dict):
        return [(where, "not_object")]
    kinds = {"string": str, "number": (int, float), "integer": int, "boolean": bool, "array": list, "object": dict}
    out = [(where + n, "missing") for n in schema.get("required", ()) if n not in value]
    inner = []
    for n, rule in schema.get("properties", {}).items():
        if n not in value:
            continue
        if rule.get("type") in kinds and not isinstance(value[n], kinds[rule["type"]]):
            out.append((where + n, "type"))
        elif "enum" in rule and value[n] not in rule["enum"]:
            out.append((where + n, "enum"))
        if rule.get("type") == "object" and ("properties" in rule or "required" in rule) and isinstance(value[n], dict):
            inner += brute(value[n], rule, f"{where}{n}.")
    return out + inner


def test_arguments(spark):
    values = [
        {"page": 1, "box": []}, {"page": 1.0, "box": [1, "x"]}, {"page": True, "box": {}}, {"page": 10**30, "box": [1], "zoom": True}, {"box": [], "zoom": 0.5}, {"page": "1", "box": None}, {},
        {"page": 1, "box": [], "mode": None}, {"page": 1, "box": [], "mode": "c"}, {"page": 2, "box": [], "mode": "b", "zoom": 3}, {"page": 1, "box": [], "deep": {"x": 1}}, {"page": 1, "box": [], "deep": {"y'z": 3}},
        {"page": 1, "box": [], "deep": {"x": False, "y'z": "t"}, "any": [1], "odd": 5}, {"page": 1, "box": [], "extra": 1e400 if False else 1e30, "zoom": "1"}, {"page": 1e3, "box": []}, [1], "text", 5, None, {"page": None, "box": []},
    ]
    raw = ["null" if v is None else json.dumps(v) for v in values]
    rows = variants(spark, raw).select("i", samples.problems(F.col("v"), RULES).alias("p"), samples.valid(F.col("v"), RULES).alias("ok"))
    for r in rows.collect():
        assert [tuple(p) for p in r.p] == brute(values[r.i], RULES), values[r.i]
        assert r.ok == (not r.p)
    assert [tuple(p) for p in variants(spark, [None]).select(samples.problems(F.col("v"), RULES).alias("p")).first().p] == [("", "not_object")]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sample_shapes(spark):
    values = [
        {"image": ["a.png", "b.png"], "conversations": [{"from": "human", "value": "<image> What? <image>　"}, {"from": "gpt", "value": "It <image> is.\n"}, {"from": "system", "value": "s"}]},
        {"image": "a.png", "video": "v.mp4", "conversations": [{"role": "user", "content": "x<image>y<image>"}, {"role": "system", "content": "  "}]},
        {"video": ["v.mp4"], "conversations": [{"from": "gpt", "role": "user", "value": "<image>", "content": "no"}]},
        {"caption": "A cat", "image": "c.png"}, {"caption": "A cat", "image": ["c.png"]},
        {"messages": [{"role": "user", "content": [{"type": "image_url", "image_url": {"url": "u"}}, {"type": "audio_url", "audio_url": {"url": "w"}}, {"type": "video_url", "video_url": {"url": "v"}}, {"type": "text", "text": "hm ", "audio_text": "a"}]}, {"role": "assistant", "content": []}]},
        {"video": "v.mp4", "prompt": "say"}, {"conversations": "path.json", "image": "a.png"}, {"other": 1},
    ]
    rows = variants(spark, values)
    file = F.parse_json(F.lit('[{"from": "human", "value": "hi <image>"}]'))
    got = rows.select("i", samples.sample_kind(F.col("v")).alias("kind"), samples.sample_messages(F.col("v"), file).alias("m")).orderBy("i").collect()
    assert [r.kind for r in got] == ["conversations"] * 3 + ["caption"] * 2 + ["messages", "video", "conversations_file", None]
    plain = [r.m and [(m.role, [(p.type, p.text if p.url is None else p.url) for p in m.content]) for m in r.m] for r in got]
    assert plain == [
        [("user", [("image", "a.png"), ("text", "What?"), ("image", "b.png")]), ("assistant", [("text", "It"), ("text", "is.")]), ("assistant", [("text", "s")])],
        [("user", [("text", "x"), ("image", "a.png"), ("text", "y")]), ("system", [])], [("assistant", [("video", "v.mp4")])],
        [("user", [("image", "c.png")]), ("assistant", [("text", "A cat")])], [("user", [("image", "")]), ("assistant", [("text", "A cat")])],
        [("user", [("image", "u"), ("audio", "w"), ("video", "v"), ("text", "hm ")]), ("assistant", [])], [("user", [("video", "v.mp4"), ("text", "say")])],
        [("user", [("text", "hi"), ("image", "a.png")])], None,
    ]
    assert got[5].m[0].content[3].audio_text == "a"
    longer = rows.where("i IN (5, 6, 0)").select("i", samples.with_user_suffix(samples.sample_messages(F.col("v")), "  end ").alias("m")).orderBy("i").collect()
    assert [(r.m[0].content[-1].type, r.m[0].content[-1].text) for r in longer] == [("text", "end"), ("text", "hm\nend"), ("text", "say\nend")]
    assert len(longer[0].m[0].content) == 4 and longer[1].m[1].content == []
    with pytest.raises(Exception, match="role or from"):
        variants(spark, [{"conversations": [{"from": "nobody", "value": "x"}]}]).select(samples.sample_messages(F.col("v"))).collect()


def brute_places(layout):
    def boxes(v):
        if not isinstance(v, list):
            return []
        if len(v) == 4 and all(isinstance(x, (int, float)) for x in v):
            v = [v]
        return [[float(x) for x in b] for b in v if isinstance(b, list) and len(b) == 4]

    def of_object(o):
        if "page" in o or "page_id" in o:
            return [(o.get("page", o.get("page_id")), b) for b in boxes(o.get("bbox_2d", o.get("bbox", o.get("bboxes"))))]
        return [(int(k), b) for k, v in o.items() for b in boxes(v) if k.isdigit()]

    if isinstance(layout, dict):
        return of_object(layout)
    out = []
    for x in layout if isinstance(layout, list) else ():
        out += of_object(x) if isinstance(x, dict) else [(x[0], [float(v) for v in x[1:]])] if isinstance(x, list) and len(x) == 5 else []
    return out


def test_evidence_of_any_shape(spark):
    box = [1, 2.5, 3, 4]
    values = [
        {"page": 2, "bbox": box}, {"page_id": 3, "bboxes": [box, [1, 2], box]}, {"4": box, "x": box, "5": [box]}, [[6, *box], {"page": 7, "bbox_2d": box}, 9, [1, 2]], [], {}, "text", 5, {"page": 1, "bbox_2d": "no"}, [{"8": [box, box]}],
    ]
    got = variants(spark, values).select("i", samples.places_in(F.col("v")).alias("p")).orderBy("i").collect()
    assert [[(p.page, list(p.box)) for p in r.p] for r in got] == [brute_places(v) for v in values]
    assert variants(spark, [None]).select(samples.places_in(F.col("v")).alias("p")).first().p == []
    many = variants(spark, [{"a": {"dpi72": {"1": box}, "dpi144": {"2": []}, "dpi96": {"3": box}}, "b": [[9, *box]]}, {"a": {}, "b": [[9, *box]]}, {"b": None}])
    got = many.select("i", samples.evidence_places(samples.field(F.col("v"), "$.a"), samples.field(F.col("v"), "$.b")).alias("p")).orderBy("i").collect()
    assert [[p.page for p in r.p] for r in got] == [[3], [9], []]
