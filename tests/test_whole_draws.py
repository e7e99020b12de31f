"""All noises, all attempts, all replicates."""

from conftest import DATA, normal, oracle

from spanmill.operators import composed, stats
from spanmill.plans import catalog

SF = f"{DATA}/sf0.001"


def test_redrawn_tries_every_line(spark):
    sql = catalog.ORACLES["q_redrawn"].replace(" WHERE l_linenumber <= 3", "")
    got = catalog.QUERIES["q_redrawn"](spark, SF)
    assert normal(got.collect()) == normal(oracle("sf0.001").execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall())
    assert got.where("attempt > 2").count()


def test_degraded_draws_from_every_waveform(spark, monkeypatch):
    seen, own = [], composed.degraded

    def spied(items, noises, *rest):
        seen.append((items.count(), noises.count()))
        return own(items, noises, *rest)

    monkeypatch.setattr(composed, "degraded", spied)
    out = catalog.QUERIES["q_degraded"](spark, SF)
    items, noises = seen[0]
    assert noises == items == out.count()


def test_bootstrap_has_the_operator_s_replicates(spark, monkeypatch):
    seen, own = [], stats.joint_regression

    def spied(*args, reps=200, **rest):
        seen.append(reps)
        return own(*args, reps=reps, **rest)

    monkeypatch.setattr(stats, "joint_regression", spied)
    assert catalog.QUERIES["q_bootstrap_ci"](spark, SF).count() and seen == [200]
