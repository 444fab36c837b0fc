"""Fitted priors and margins read scores that are made once."""

from driftfield.plans import place_queries


def test_scores_of_settings_are_made_once(spark):
    df = place_queries.fitted_prior_evidence(spark, "/root/testdata/sf0.001")
    assert "MapInArrow" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert {r.model for r in df.select("model").distinct().collect()} == {"diffusion", "momentum"}
