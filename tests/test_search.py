import pytest

from nichesearch import BackendRegistry, CandidatePlan, Condition, MethodologySpec, MethodSpec, Prior, RealDataSource, Resolution, UnsupportedStep, VirtualDataSource, default_registry, explain, propose
from nichesearch.plans import priors
from nichesearch.plans.catalogue import Backend
from nichesearch.profile import DataProfile, EnvironmentalProfile, SamplingProfile, SpatialProfile, VolumeProfile
from nichesearch.schema import StepRecord, data_source

SOURCE = RealDataSource("o.csv", ("a.npy",), "presence_absence")
ONLY = RealDataSource("o.csv", ("a.npy",), "presence_only")


def profile(cells=400, nn=1.0, shift=0.1, vif=2.0, extent=3600):
    return DataProfile(
        VolumeProfile(cells, cells, cells, 0, None, 0.0),
        SpatialProfile(extent, 60, 60, cells, 0.1, 7.2, True, nn, 2.0),
        SamplingProfile(1.0, shift, shift),
        EnvironmentalProfile(2, 0.1, vif, 2.0, None),
    )


class Fake(Backend):
    def __init__(self, name, stage, *methods):
        self.name, self.stage, self.methods = name, stage, methods

    def run(self, spec, context, seed):
        raise RuntimeError("broken")


def test_registry(spark):
    r = default_registry()
    assert r.resolve("algorithm", MethodSpec("GLM")).backend is r.resolve("algorithm", MethodSpec("logistic")).backend
    gap = r.resolve("algorithm", MethodSpec("maxent"))
    assert not gap.ok and (gap.gap.code, gap.gap.feature, gap.gap.requested_value) == ("unsupported_algorithm", "algorithm", "maxent")
    assert r.methods_for("algorithm") == ["brt", "gbm", "glm", "logistic"] and len(r.backends_for("algorithm")) == 2
    with pytest.raises(ValueError):
        r.register(Fake("other", "algorithm", "new", "glm"))
    assert not r.resolve("algorithm", MethodSpec("new")).ok
    with pytest.raises(ValueError):
        Resolution(None)
    assert set(r.runtimes().values()) == {"spark"} and r.table(spark).count() == sum(len(b.methods) for s in ("profile", "cleaning", "accessible_area", "predictors", "background", "split", "algorithm") for b in r.backends_for(s))


def test_four_candidates_and_every_one_stays(spark):
    plans, said, gaps = propose(SOURCE, default_registry(), profile=profile(cells=30, nn=0.3))
    assert len(plans) == 4 == len({p.candidate_id for p in plans}) and not said and not gaps
    assert plans[0].candidate_id == "logistic+spatial_block" and plans[-1].candidate_id == "gbm+random_kfold"
    assert plans[0].methodology.split.params == {"block_size": 8} and "small_sample_favours_simple_models" in plans[0].methodology.algorithm.source
    only, _, _ = propose(ONLY, default_registry(), profile=profile())
    assert only[0].methodology.background.params == {"n_background": 3600} and [s for s, _ in only[0].methodology.steps()][3] == "background"


def test_without_a_profile_or_a_backend(spark):
    plans, said, _ = propose(SOURCE, default_registry())
    assert [a.code for a in said] == ["proposed_without_a_profile"] and plans[0].methodology.split.params == {} and "spatial_block" in plans[0].candidate_id
    empty = BackendRegistry()
    plans, _, gaps = propose(SOURCE, empty)
    assert not plans and {g.code for g in gaps} == {f"no_backend_for_{s}" for s in ("cleaning", "accessible_area", "predictors", "split", "algorithm")}


def test_a_budget_draws_by_weight_and_reaches_all(spark):
    drawn = [propose(SOURCE, default_registry(), profile=profile(), max_candidates=1, random_seed=s) for s in range(10)]
    firsts = [p[0][0].candidate_id for p in drawn]
    assert len(set(firsts)) > 1 and firsts.count("gbm+spatial_block") > firsts.count("logistic+random_kfold")
    assert {a.code for p in drawn for a in p[1]} == {"search_space_sampled"}
    assert firsts[5] == propose(SOURCE, default_registry(), profile=profile(), max_candidates=1, random_seed=5)[0][0].candidate_id


def test_ids_stay_distinct_with_more_backends(spark):
    r = default_registry()
    r.register(Fake("clean2", "cleaning", "keep_all"))
    plans, _, _ = propose(SOURCE, r)
    assert len({p.candidate_id for p in plans}) == 8


def test_rules(spark):
    facts = {"profile": profile(cells=30), "objective": "interpolation"}
    n = "profile.volume.n_records"
    cases = [((n, "<", 31), True), ((n, ">", 31), False), ((n, "<=", 30), True), ((n, ">=", 31), False), ((n, "==", 30), True), ((n, "!=", 30), False), (("missing", "!=", 1), False), (("missing", "is_null"), True), (("objective", "not_null"), True), (("missing", "<", 5), False)]
    cases += [(("objective", "<", 5), False), (("objective", "!=", "x"), True), (("objective", "==", "interpolation"), True), (("profile.nothing.at", "is_null"), True), (("objective", "is_null"), False)]
    rules = (*[Prior(f"p{i}", "s", "m", 1.0, "", (Condition(*c),)) for i, (c, _) in enumerate(cases)], Prior("always", "s", "m", 1.0, ""), Prior("both", "s", "m", 1.0, "", (Condition(n, "<", 31), Condition(n, ">", 31))))
    found = {r.prior_id: r.applies for r in priors.applicable(priors.conditions_table(spark, rules), priors.facts_table(spark, facts)).collect()}
    assert found == {f"p{i}": holds for i, (_, holds) in enumerate(cases)} | {"always": True, "both": False}
    with pytest.raises(ValueError):
        Condition("a", "~", 1)
    rows = {(s, m): (w, ids) for s, m, w, ids in explain(default_registry(), profile(cells=30), "interpolation")}
    assert rows["split", "random_kfold"] == (0.5, ["interpolation_tolerates_random_folds"]) and rows["algorithm", "gbm"][0] == -1.0
    inert = (Prior("x", "algorithm", "brt", 9.0, ""), Prior("y", "algorithm", "nothing", 9.0, ""))
    assert all(w == 0 for _, _, w, _ in explain(default_registry(), None, priors=inert))


def test_plans_are_validated_and_immutable():
    m = MethodologySpec(*[MethodSpec("x")] * 5)
    with pytest.raises(ValueError):
        CandidatePlan("c", ONLY, m)
    with pytest.raises(ValueError):
        VirtualDataSource(("a", "b"), (1.0,))
    with pytest.raises(ValueError):
        VirtualDataSource(("a",), (1.0,), n_presences=5)
    with pytest.raises(ValueError):
        RealDataSource("o", (), "presence_only")
    with pytest.raises(ValueError):
        StepRecord("s", "c", "m", "b", "d", 1, -1.0)
    plan = CandidatePlan("c", SOURCE, m)
    with pytest.raises(AttributeError):
        plan.candidate_id = "d"
    assert plan.is_executable and not plan.replace(unsupported_steps=(UnsupportedStep("a", "b", "c"),)).is_executable
    for s in (SOURCE, VirtualDataSource(("a",), (1.0,))):
        assert data_source(s.to_dict()) == s


def test_a_draw_is_hashed_once_and_compared_as_its_number(spark, monkeypatch):
    """One hash a replicate and record in the plan, and the comparison of digits is that of the numbers."""
    from nichesearch.functions import draws
    from nichesearch.operators import selection

    rows = spark.range(2000).selectExpr("id AS record_id", "CAST(id % 2 AS INT) AS label", "id * 0.5D AS score", "'a' AS candidate_id", "0 AS fold")
    given = []
    monkeypatch.setattr(selection, "weighted_auc", lambda drawn, by: given.append(drawn) or drawn.withColumn("weighted_auc", drawn.weight))
    selection.bootstrap_auc(rows, ["candidate_id", "fold"], 3, 1)
    assert given[0]._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    key, u = draws.order_key(1, "bootstrap", rows.record_id), draws.uniform(1, "bootstrap", rows.record_id)
    for p in selection.POISSON:
        assert rows.filter(draws.above(key, p) != (u > p)).isEmpty()
