"""The review as a whole."""

from __future__ import annotations

from tidemark.config import FIXTURE
from tidemark.plans import revalidate as R
from tidemark.schemas import KEYS
from tidemark.sources import fixtures
from tidemark.sources.warehouse import Warehouse


def test_all_stages(spark, sf_dir, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    w.init_schema()
    w.replace("prices", fixtures.prices(spark, sf_dir))
    cfg = FIXTURE.with_(bootstrap_n=20, n_perm=10)
    out = R.revalidate(w, cfg, ("momentum", "gbm_expected"))
    for t in ("panel", "signals", "portfolio_returns", "monitoring", "gate_decisions", "validation_results"):
        df = w.read(t)
        n = df.count()
        assert n > 0 and n == df.select(*KEYS[t]).distinct().count(), t
    tests = {(r.model, r.test): r.verdict for r in out["tests"].collect()}
    assert len(tests) == 6 and tests["momentum", "deflated_sharpe"] == "PROVISIONAL"
    strategies = {r.strategy for r in out["champion_challenger"].collect()}
    assert {"momentum", "momentum_gated", "momentum_same_close", "universe_ew", "benchmark_spy", "gbm_weekly"} <= strategies
    text = R.markdown(out["gate"])
    assert text.startswith("| model | weeks | off_share |") and "momentum" in text
    before = w.read("gate_decisions").count()
    R.gate(w, cfg, ["momentum", "gbm_expected"])  # a stage that runs again replaces its own rows
    assert w.read("gate_decisions").count() == before
