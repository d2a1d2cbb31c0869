import os
import subprocess
import sys


def test_workers_find_the_package_from_any_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from clauselake.session import local_session, ship_package
spark = local_session(2)
ship_package(spark)
ship_package(spark)
def look(batches):
    import clauselake.vocab
    yield from batches
assert spark.range(3).mapInArrow(look, "id long").count() == 3
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=300)
