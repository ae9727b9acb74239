"""The contract without the corpus queries, or without a library that only they need."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("missing", ["tokenizers", "epispark.llm", "corpus_pipeline"])
def test_the_other_queries_stay(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'oe_edges' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    queries, oracles, present = out.stdout.split()[-3:]
    assert int(queries) > 95 and int(oracles) > 95 and present == "True"
