"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest

import corpus_pipeline
from brackwater.llm import common, langid, licenses, media, mixing, nearest, neardup, packing, pii, tokenfile, tokens, toxicity

LONG = "word another thing " * 20_000
ROWS = [
    (1, "Licensed under the MIT License. Mail a.b@c.de now", "en", "s1", 10),
    (2, None, None, None, None),
    (3, "", "en", "s1", 0),
    (4, LONG, "en", None, len(LONG)),
    (5, "same text of more than five words here", "en", "s2", 1),
    (5, "same text of more than five words here", "en", "s2", 1),
    (6, "same text of more than five words here", None, "s2", 1),
    (None, "a row without an id but with text", "en", "s2", 1),
    (7, "\u0000\t\n    emoji \U0001f600 +1 (017) 555-7713", "en", "", 3),
]
CLASH = "score double, size string, taken string, target int, finish int, h string, extra string, sid int, base string, comp int, block int, features int, positive int, letter int, sequence_id int"


def make(spark, rows, clash=False):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if clash:
        df = df.selectExpr("*", *[f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in CLASH.split(", ")])
    return df


def labels_of(spark, rows=((1, 1, 1), (5, 1, 0), (99, 1, 1), (None, 0, 1), (6, None, None))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def run_tokens(spark, d):
    folder = common.new_dir(spark, "tokens")
    return tokenfile.read_digests(tokenfile.write_tokens(d, folder, tokens.vocabulary(tokenfile.VOCABULARY), partitions=3), folder)


OPERATORS = {
    "licenses": lambda s, d: licenses.scan(d),
    "tokens": run_tokens,
    "pii": lambda s, d: pii.find(d),
    "redact": lambda s, d: pii.redact(d),
    "toxicity": lambda s, d: toxicity.scored(d, toxicity.learn(d.select("doc_id", "text"), labels_of(s))),
    "langid": lambda s, d: langid.predict(d, langid.learn(d)),
    "media": lambda s, d: media.describe(media.read_archives(s, media.write_archives(d, common.new_dir(s, "media")))),
    "packing": lambda s, d: packing.pack(d),
    "neardup": lambda s, d: neardup.join(d),
    "mixing": lambda s, d: mixing.mix(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    out = OPERATORS[name](spark, make(spark, ROWS)).collect()
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in out)
    want = sorted((r[0] is None, r[0] or 0) for r in ROWS)
    if name == "packing":
        assert set(ids) == set(want)
    else:
        assert ids == want


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(spark, name):
    out = OPERATORS[name](spark, make(spark, ROWS, clash=True))
    assert out.count() >= len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, make(spark, [])).count() == 0


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
@pytest.mark.parametrize("clash", [False, True], ids=["plain", "clash"])
@pytest.mark.parametrize("rows", [ROWS, []], ids=["odd", "empty"])
def test_stages(spark, tmp_path, stage, rows, clash):
    labels_of(spark).write.parquet(f"{tmp_path}/labels.parquet")
    docs = make(spark, rows, clash)
    out = stage[1](spark, docs, str(tmp_path))
    n = out.count()
    assert (n > 0) == bool(rows)
    if stage is not corpus_pipeline.STAGES[-1]:
        assert out.columns == docs.columns


def test_vectors_that_take_no_part(spark):
    nan = float("nan")
    rows = [(i, [float(i), 1.0]) for i in range(0, 40)] + [(60, None), (80, [nan, 1.0]), (100, [0.0, 0.0]), (120, [None, 1.0]), (140, [float("inf"), 1.0]), (160, [1.0]), (None, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nearest.search(df).collect()
    assert {r.query_id for r in got} == {0, 20} and {r.vec_id for r in got} <= set(range(40)) and len(got) == 40
    assert nearest.search(df.limit(0)).count() == 0
    assert nearest.search(df.filter("vec_id = 0")).count() == 0
