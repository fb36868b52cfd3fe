"""Both ways of raking end by the same rule."""

import random

import numpy as np
import pandas as pd

from quillon.llm import mixing


def skewed(n):
    r = random.Random(11)
    rows = {(f"s{int(r.paretovariate(0.7)) % 400}", f"l{r.randint(0, 9)}", str(r.randint(0, 7))): int(10 * r.paretovariate(0.6)) for _ in range(n)}
    return pd.DataFrame([(*k, min(v, 10**9)) for k, v in rows.items()], columns=["source", "lang", "topic", "tokens"])


def default_goals(cells):
    goals = {}
    for m, power in zip(mixing.MARGINS, (0.7, 0.7, 0.5), strict=True):
        g = cells.groupby(m)["tokens"].sum().astype(float) ** power
        goals[m] = (g / g.sum()).to_dict()
    return goals


def test_distributed_raking_of_capped_cells_sweeps_on(spark, monkeypatch):
    local = skewed(6000)
    goals = default_goals(local)
    monkeypatch.setattr(mixing, "SWEEPS", 30)
    early = mixing.rake(local, goals, 0.5)
    monkeypatch.setattr(mixing, "SWEEPS", 40)
    local["want"] = mixing.rake(local, goals, 0.5)
    share = local["tokens"] / local["tokens"].sum()
    assert len(local) > 1000 and np.abs((early - local["want"]) / share).max() > 1e-3
    frames = {m: spark.createDataFrame(list(g.items()), f"{m} string, goal double") for m, g in goals.items()}
    got = mixing._rake_distributed(spark.createDataFrame(local.drop(columns="want")), frames, 0.5).toPandas()
    both = got.merge(local, on=list(mixing.MARGINS))
    assert len(both) == len(local) and np.abs((both["fitted"] - both["want"]) / share.min()).max() < 1e-3


def test_distributed_raking_ends_when_margins_are_met(spark, monkeypatch):
    local = pd.DataFrame([(s, g, "1", n) for s, g, n in (("a", "x", 3), ("a", "y", 5), ("b", "x", 7), ("b", "y", 2))], columns=["source", "lang", "topic", "tokens"])
    goals = {"source": dict(a=0.5, b=0.5), "lang": dict(x=0.55, y=0.45), "topic": {"1": 1.0}}
    frames = {m: spark.createDataFrame(list(g.items()), f"{m} string, goal double") for m, g in goals.items()}
    written = []
    keep = mixing.materialize
    monkeypatch.setattr(mixing, "materialize", lambda df, label: written.append(label) or keep(df, label))
    got = mixing._rake_distributed(spark.createDataFrame(local), frames, 0.5).toPandas().merge(local, on=["source", "lang", "topic"])
    assert len(written) < 30
    assert np.allclose(got["fitted"], mixing.rake(got.rename(columns={"tokens_x": "tokens"}), goals, 0.5), atol=1e-9)
