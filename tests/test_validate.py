"""Rules of whole profiles: those asked for give what they give among all, and no others are evaluated."""

from brackwater.operators import validate
from brackwater.plans import validation_queries

DATA = "/root/testdata/sf0.001"


def test_rules_asked_for_are_those_of_all(spark):
    p = validation_queries.profiles(spark, DATA)
    every = {tuple(r) for r in validate.validated(p).collect()}
    assert {r[1] for r in every} >= set(validation_queries.FLAGS["validated_links"]) | {"evidence_support_mismatch", "coverage_low"}
    for flags in [*validation_queries.FLAGS.values(), ("evidence_support_mismatch",), validate.BLOCKING, *[(n,) for n in validate.RULES]]:
        assert {tuple(r) for r in validate.validated(p, flags).collect()} == {r for r in every if r[1] in flags}
    assert {r[1] for r in every if r[2] == "blocking"} <= set(validate.BLOCKING)


def test_only_what_is_asked_for_is_written(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(validate, "written", lambda df, name: kept.setdefault(name, df))
    plan = validation_queries.flags_of(spark, DATA, "validated_links")._jdf.queryExecution().optimizedPlan().toString()
    assert set(kept["repaired"].columns) == {"device", "actions", "requires", "n_surfaces", "repairs"} and "evidence_support_mismatch" not in plan
