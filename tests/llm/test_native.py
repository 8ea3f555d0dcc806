"""Operators 1 to 4 use DataFrame functions only: nothing of Python in any plan that they run."""

import re

import pytest

from loadflow.llm import queries
from loadflow.sources import shared


@pytest.mark.parametrize("name", ["op1_mix_sources", "op2_secret_scan", "op3_hilbert_shards", "op4_line_rules"])
def test_no_python_in_plans(spark, sf_dir, name, monkeypatch):
    plans, write = [], shared.written

    def seen(df, row_id=None):
        plans.append(df)
        return write(df, row_id)

    for module in (queries.mixing, queries.secret_scan, queries.sharding, queries.line_rules):
        monkeypatch.setattr(module, "written", seen)
    plans.append(queries.queries()[name](spark, sf_dir))
    assert len(plans) > 1
    for df in plans:
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop|ExistingRDD", df._jdf.queryExecution().executedPlan().toString())
