from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from claimspark.functions.scratch import clear_scratch, materialise, scratch_path, scratch_root
from claimspark.operators.signals import signal_pairs
from claimspark.plans.findings import (
    RULES,
    findings,
    hypothesis_status,
    invalid_findings,
    provider_scores,
)
from claimspark.plans.impact import (
    composite_risk,
    impact_rank,
    impact_summary,
    overpayment,
    report_rollup,
    top_providers,
)
from claimspark.plans.registry import (
    CONCEPTS,
    get_concept,
    get_concepts_for_domain,
    list_concepts,
    run,
    run_validated,
    sweep,
    sweep_all,
)

YEAR = ("2025-01-01", "2025-12-31")
PARAMS = {"provider_npi": "A", "start_date": YEAR[0], "end_date": YEAR[1]}


def test_registry():
    assert len(CONCEPTS) == 14 and set(RULES) == set(CONCEPTS)
    for name, concept in CONCEPTS.items():
        assert concept.name == name and concept.description and concept.domain and callable(concept.operator)
    assert {d: len(get_concepts_for_domain(d)) for d in ("claims", "provider", "member", "eligibility", "temporal", "network")} == {
        "claims": 4, "provider": 2, "member": 2, "eligibility": 2, "temporal": 2, "network": 2}
    assert get_concept("high_cost_claims").domain == "claims" and get_concept("nonexistent") is None
    assert len(list_concepts()) == 14 and all(c["domain"] == "claims" for c in list_concepts("claims"))
    assert list_concepts("claims")[0]["parameters"] == ["provider_npi", "start_date", "end_date"]


def test_errors(build):
    tables = build()
    with pytest.raises(ValueError, match="Unknown semantic concept: nonexistent"):
        run("nonexistent", tables, {})
    with pytest.raises(ValueError, match=r"Missing parameters for high_cost_claims: \['start_date', 'end_date'\]"):
        run("high_cost_claims", tables, {"provider_npi": "1234567890"})


@pytest.fixture
def case(build):
    providers = [{"npi": n, "specialty": "IM", "practice_state": "TX"} for n in "ABC"]
    claims = [{"provider_npi": n, "member_id": f"M{i}", "service_date": f"2025-{m:02d}-0{i + 1}", "procedure_code": c,
               "service_state": "TX", "diagnosis_code": "J", "allowed_amount": 100 + 10 * i, "referring_npi": "B"}
              for n in "ABC" for i in range(4) for m in (3, 4) for c in ("99213",)]
    claims += [{"provider_npi": "A", "member_id": "M0", "service_date": "2025-05-05", "procedure_code": "99215",
                "service_state": "TX", "allowed_amount": a} for a in (400, 300)]
    spans = [{"member_id": f"M{i}", "coverage_start": "2025-01-01", "coverage_end": "2025-04-30",
              "created_date": "2025-03-15"} for i in range(4)]
    mapping = [{"procedure_code": "99215", "expected_specialty": "Surgery"}]
    return build(claims=claims, providers=providers, eligibility=spans, specialty_procedure_map=mapping)


@pytest.mark.parametrize("name", list(CONCEPTS))
def test_single_run_equals_sweep_of_that_provider(case, name):
    single = run(name, case, PARAMS)
    whole = sweep(name, case, *YEAR)
    if name == "doctor_shopping":
        assert sorted(single.collect()) == sorted(whole.collect())
    else:
        expected = whole.where("provider_npi = 'A'").collect()
        assert sorted(map(str, single.collect())) == sorted(map(str, expected))


def test_run_is_ordered(case):
    months = [r.month for r in run("claim_volume_by_period", case, PARAMS).collect()]
    assert months == sorted(months) and len(months) == 3


def test_findings_to_report(case, spark, rows):
    scores = materialise(provider_scores(case, *YEAR), "scores")
    found = findings(scores)
    assert invalid_findings(found).count() == 0
    by_concept = {(r.provider_npi, r.concept): r for r in found.collect()}
    duplicate = by_concept["A", "duplicate_claims"]
    assert (duplicate.severity, duplicate.amount, duplicate.recoverable) == ("low", 700.0, 700.0)
    assert duplicate.metrics["score"] == 2.0 and duplicate.domain == "claims"
    # Peers bill 8% on the highest code, A bills 20%: twelve points.
    assert by_concept["A", "upcoding_pattern"].metrics["score"] == pytest.approx(12.3077)  # not rounded to what is shown

    costs = {r.provider_npi: r for r in overpayment(scores).collect()}
    assert (costs["A"].duplicates, costs["A"].duplicate_copies, costs["A"].coverage_gaps) == (700.0, 300.0, 700.0)
    assert costs["A"].mismatch_review == 700.0 and costs["B"].coverage_gaps == 0.0

    impact = {r.provider_npi: r for r in impact_summary(overpayment(scores), *YEAR).collect()}["A"]
    # All of A's 700 are uncovered, 300 of them further copies: a claim counts once.
    assert impact.impact_low == 700.0
    assert impact.impact_mid == pytest.approx(1400.0 + costs["A"].upcoding)
    assert impact.impact_high == pytest.approx(impact.impact_mid + 700.0)
    assert impact.annualized_exposure == impact.impact_mid

    ranks = rows(impact_rank(found).where("provider_npi = 'A'"), "impact_rank", "concept")
    assert [c for _, c in ranks][:2] == ["coverage_gap_claims", "duplicate_claims"]

    risk = {r.provider_npi: r for r in composite_risk(found).collect()}
    assert 0 < risk["A"].composite_risk_score <= 1 and risk["A"].risk_category in ("critical", "high", "medium", "low")

    report = {r.provider_npi: r for r in report_rollup(scores, *YEAR).collect()}
    assert report["A"].total_findings == sum(1 for p, _ in by_concept if p == "A")
    assert report["A"].top_findings[0].concept == "coverage_gap_claims"
    assert [r.follow_up_rank for r in top_providers(report_rollup(scores, *YEAR), 2).collect()] == [1, 2]

    asked = spark.createDataFrame([("H1", "A", "coverage_gap_claims"), ("H2", "B", "coverage_gap_claims")],
                                  "hypothesis_id string, provider_npi string, concept string")
    assert rows(hypothesis_status(asked, found), "hypothesis_id", "confidence", "status") == [
        ("H1", 0.25, "refuted"), ("H2", 0.0, "refuted")]


def test_sweep_all(case):
    results = sweep_all(case, *YEAR)
    assert set(results) == set(CONCEPTS)
    assert results["duplicate_claims"].count() == 1


def test_hypothesis_bounds(spark, rows):
    found = spark.createDataFrame([("A", c, x) for c, x in (("p", 0.75), ("q", 0.5), ("r", 0.3), ("s", 0.6), ("t", 0.25))],
                                  "provider_npi string, concept string, confidence double")
    asked = found.selectExpr("concept as hypothesis_id", "provider_npi", "concept")
    assert rows(hypothesis_status(asked, found), "hypothesis_id", "status") == [
        ("p", "supported"), ("q", "open"), ("r", "open"), ("s", "open"), ("t", "refuted")]


def test_scratch_is_the_configured_folder(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(configured)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


class _Unset:
    """A session without a scratch setting, on the given master."""

    def __init__(self, spark, master):
        self.conf = {}
        self.sparkContext = self
        self.master, self.applicationId = master, "app"
        self._jvm, self._jsc = spark.sparkContext._jvm, spark.sparkContext._jsc


def test_scratch_without_a_configured_folder(spark):
    assert scratch_root(_Unset(spark, "local[4]")) == "file:/tmp"
    for master in ("local-cluster[3,2,1024]", "spark://host:7077", "yarn"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            scratch_root(_Unset(spark, master))


def test_clear_scratch_leaves_others_alone(spark, tmp_path):
    class Own:
        conf = {"spark.checkpoint.dir": str(tmp_path)}
        sparkContext = spark.sparkContext

    mine = tmp_path / "claimspark" / spark.sparkContext.applicationId / "x"
    other = tmp_path / "claimspark" / "another" / "x"
    for folder in (mine, other):
        folder.mkdir(parents=True)
    assert scratch_path(Own(), "x").startswith(str(mine.parent))
    assert clear_scratch(Own()) and not mine.exists() and other.exists()


@pytest.mark.parametrize("name", list(CONCEPTS))
def test_plans_have_no_cross_join_and_no_single_task_window(case, spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sweep(name, case, *YEAR)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "SinglePartition" not in plan, "no concept gathers all rows in one task"
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_scores_read_the_claims_once(case):
    scores = provider_scores(case, *YEAR)
    assert any("period-claims" in file for file in scores.inputFiles())
    # The claims of the case are rows in memory; a read of them would show these columns.
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "paid_amount" not in plan and "modifier_1" not in plan


def test_few_concepts_read_the_claims_themselves(case, rows):
    few = ["duplicate_claims", "coverage_gap_claims"]
    scores = provider_scores(case, *YEAR, concepts=iter(few))
    assert not any("period-claims" in file for file in scores.inputFiles())
    assert rows(scores) == rows(provider_scores(case, *YEAR).where(F.col("concept").isin(few)))


def test_signal_pairs_read_stored_spikes(case):
    files = " ".join(signal_pairs(case, *YEAR).inputFiles())
    assert "/spikes-" in files and "/costly-claims-" in files


def test_a_score_just_above_a_bound_counts(spark):
    scores = spark.createDataFrame(
        [("A", "billing_spike_detection", 1, 2.003, 0.0, 0.0, 0.0), ("B", "billing_spike_detection", 1, 2.0, 0.0, 0.0, 0.0)],
        "provider_npi string, concept string, row_count long, score double, amount double, recoverable double, certain double",
    )
    assert [(r.provider_npi, r.severity) for r in findings(scores).collect()] == [("A", "high")]


def test_all_findings_are_listed(spark):
    concepts = list(CONCEPTS)
    scores = spark.createDataFrame(
        [("A", c, 1, 1000.0, 1.0, 1.0, 0.0) for c in concepts],
        "provider_npi string, concept string, row_count long, score double, amount double, recoverable double, certain double",
    )
    assert len(report_rollup(scores, *YEAR).first().top_findings) == len(concepts) == 14
    assert len(report_rollup(scores, *YEAR, top=3).first().top_findings) == 3


def test_run_validated(case):
    asked = {"provider_npi": "nobody", "start_date": YEAR[0], "end_date": YEAR[1]}
    found, warnings = run_validated("duplicate_claims", case, asked)
    assert found.count() == 0 and warnings.count() == 1
