import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_contract():
    sys.path.insert(0, str(REPO))
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 200
    assert all(callable(f) for f in q.values()) and all("SELECT" in s for s in o.values())


def test_python_functions_reach_workers_without_the_package(tmp_path):
    """Run from another folder, so that the workers cannot import the package."""
    code = (
        f"import sys; sys.path.insert(0, {str(REPO)!r})\n"
        "from rosterlab.session import get_spark\n"
        "from rosterlab.functions.similarity import indel_ratio\n"
        "s = get_spark('w', '2')\n"
        "print('got', s.createDataFrame([('abcd', 'abce')], 'a string, b string').select(indel_ratio('a', 'b')).first()[0])\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "got 75.0" in out.stdout, out.stderr[-2000:]
