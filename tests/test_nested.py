"""Nested documents with odd keys and quotes against Python's own reading of them."""

import json

from pyspark.sql import functions as F

from brackwater.functions import nested

DOCS = [
    {"a": {"b": [{"c": 'x"y\\ {title}'}, 2, None, True, 1.5]}, "title": "T", "empty": {}, "none": []},
    {"sections": [{"title": " ", "cards": [{"body": "B1", "kind": "no"}, {"steps": ["s1", {"text": "s2", "id": "no"}]}]}], "meta": {"title": "not reached"}, "fixes": [{"summary": "F", "c": "C"}]},
    [1, [2, ["deep", {"x": [[["deeper"]]]}]]],
    "only a text",
]


def walk(v, path="$"):
    if isinstance(v, dict):
        for k, x in v.items():
            yield from walk(x, f"{path}.{k}")
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from walk(x, f"{path}[{i}]")
    else:
        yield path, v


def plain(v):
    return None if v is None else v if isinstance(v, str) else "true" if v is True else str(v)


def test_leaves_are_those_of_a_plain_walk(spark):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(DOCS)] + [(9, None)], "id int, doc string")
    rows = nested.leaves(df, ["id"], "doc").collect()
    assert {(r.id, r.path, r.text) for r in rows} == {(i, p, plain(v)) for i, d in enumerate(DOCS) for p, v in walk(d)}
    prose = {(r.id, r.text) for r in nested.prose(nested.leaves(df, ["id"], "doc")).collect()}
    assert prose == {(0, "T"), (1, "B1"), (1, "s1"), (1, "s2"), (1, "F"), (1, "C")}


def test_levels_are_not_written(spark, monkeypatch):
    """Only what holds more after a pass is written: nothing of flat documents, and the rest of a deep one."""
    deep = "[" * 20 + '"end", {}, [], {"a": [null]}' + "]" * 20
    df = spark.createDataFrame([(0, json.dumps(DOCS[1])), (1, deep), (2, "{}"), (3, "[]"), (4, "null")], "id int, doc string")
    sizes = []

    def count(rows, name, keep=nested.written):
        kept = keep(rows, name)
        sizes.append(kept.count())
        return kept

    monkeypatch.setattr(nested, "written", count)
    got = {(r.id, r.path, r.text) for r in nested.leaves(df, ["id"], "doc").collect()}
    assert sizes == [1, 1, 0]
    assert got == {(0, p, plain(v)) for p, v in walk(DOCS[1])} | {(1, p, plain(v)) for p, v in walk(json.loads(deep))} | {(4, "$", None)}


def test_fields_are_resolved_and_set(spark):
    doc = json.dumps(DOCS[0])
    asked = ["a.b[0].c", "a.b[9]", "a.x.y", "title[0]", "a.b.c", "", "a.", "a.b[2]", "title"]
    df = spark.createDataFrame([(p, doc) for p in asked], "p string, doc string").select("p", nested.resolved(F.parse_json("doc"), F.col("p")).alias("r"), nested.with_value("doc", "p", F.lit('{"n":"\\"q\\""}')).alias("new"))
    got = {r.p: (r.r.ok, r.r.error, r.new) for r in df.select("p", F.struct("r.ok", "r.error").alias("r"), "new").collect()}
    assert got["a.b[9]"][:2] == (False, "index out of range at a.b[9]") and got["a.x.y"][:2] == (False, "missing a.x")
    assert got["title[0]"][:2] == (False, "not a list at title[0]") and got["a.b.c"][:2] == (False, "missing a.b.c")
    assert got[""][:2] == got["a."][:2] == (False, "empty or malformed path") and got["a.b[2]"][:2] == (True, None)
    for p in ("a.b[0].c", "a.b[2]", "title"):
        want = json.loads(doc)
        exec(f"want{''.join(f'[{s}]' if s.isdigit() else f'[{s!r}]' for s in p.replace('[', '.').replace(']', '').split('.'))} = {{'n': '\"q\"'}}")
        assert got[p][0] and json.loads(got[p][2]) == want
    assert all(got[p][2] is None for p in ("a.b[9]", "a.x.y", "title[0]", "a.b.c", "", "a."))
    assert nested.put("{}", "new", "1") == '{"new":1}' and nested.put(None, "a", "1") is None
