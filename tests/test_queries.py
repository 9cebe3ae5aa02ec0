import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as spec  # noqa: E402
import check_oracle  # noqa: E402
from marketladder.plans import registry  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
ROWS = [f"O{i:02d}" for i in range(1, 97)] + [f"V{i:02d}" for i in range(1, 23)]
# The whole set runs with tools/check_oracle.py; these cover each kind of plan.
SAMPLE = [
    "to_base_currency", "normalize_items", "occurrence_number", "price_ratio_median", "discover_plans", "strict_match",
    "price_spread", "region_grid", "snapshot_diff", "diff_fingerprint", "resolve_fallback", "accept_batches",
    "search_rank", "cooldown", "lookup_ttl", "rule_published_match_config", "extract_price_mentions", "scan_snapshot",
]


def test_every_inventory_row_has_a_checked_query():
    assert set(ROWS) <= set(registry.SURVEY.values())
    assert set(registry.QUERIES) == set(registry.ORACLES) <= set(spec.oracle_sql())


def test_entry_without_the_optional_subpackage(monkeypatch):
    """The driver removes the subpackage and the pipeline; the other queries stay."""
    import importlib

    class Absent:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("marketladder.llm"):
                raise ModuleNotFoundError(name, name=name)

    with monkeypatch.context() as patch:
        for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("marketladder.llm")]:
            patch.delitem(sys.modules, name)
        patch.setattr(sys, "meta_path", [Absent(), *sys.meta_path])
        alone = importlib.reload(spec)
        assert set(alone.queries()) == set(registry.QUERIES)
    importlib.reload(spec)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    df = spec.queries()[name](spark, SF_DIR)
    got = check_oracle.bag(df.columns, [tuple(r) for r in df.collect()])
    result = check_oracle.connect(SF_DIR).execute(spec.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == check_oracle.bag(columns, result.fetchall())


def test_entry(spark):
    assert spec.entry(spark).count() > 0
