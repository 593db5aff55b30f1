"""The entry without the removable subpackage or a library that it alone needs."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names_without(module):
    code = f"import sys; sys.modules[{module!r}] = None; import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True)
    return out.stdout.split()


def test_other_queries_stay():
    from flakelens.queries.catalog import CATALOG

    for module in ("public_tokenizers", "flakelens.llm", "corpus_pipeline"):
        count, pipeline = names_without(module)
        assert int(count) >= len(CATALOG) and pipeline == "False"
