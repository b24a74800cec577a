"""Every registered query of the library builds over the smallest tables."""

import importlib
import os
import pkgutil

import pytest

from gleaner import plans
from gleaner.plans import registry

FOLDER = "/root/testdata/sf0.001"

for _module in pkgutil.iter_modules(plans.__path__):
    if _module.name.startswith("queries_"):
        importlib.import_module(f"gleaner.plans.{_module.name}")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_builds(spark, name):
    rows = registry.QUERIES[name](spark, FOLDER)
    assert rows.columns and len(set(rows.columns)) == len(rows.columns)
