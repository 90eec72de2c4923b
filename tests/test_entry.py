import subprocess
import sys

import __spark_entry__ as entry

WITHOUT = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("histora.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
assert "feature_health" in e.queries() and not [q for q in e.queries() if q.startswith("op") and q[2].isdigit()] and "pipeline" not in e.queries()
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_entry_imports_without_the_corpus_subpackage():
    subprocess.run([sys.executable, "-c", WITHOUT], check=True, cwd=entry.__file__.rsplit("/", 1)[0])


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


def test_sql_names_exist():
    assert set(entry.oracle_sql()) <= set(entry.queries())
