import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_registry_loads_before_any_session():
    code = "import __spark_entry__ as S; assert len(S.queries()) > 100 and set(S.oracle_sql()) <= set(S.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
