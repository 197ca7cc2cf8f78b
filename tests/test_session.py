import os
import subprocess
import sys

SCRIPT = """
from titrate import session
spark = session.build_session("local[1]", 1)
folder = session.checkpoint_dir(spark)
assert folder == session.checkpoint_dir(spark), "one folder for a session"
spark.range(5).write.parquet(folder + "/rows")
assert session.written_table(spark, "t", lambda: spark.read.parquet(folder + "/rows")).count() == 5
"""


def test_local_master_without_a_named_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}
    ran = subprocess.run([sys.executable, "-c", SCRIPT], env=env, cwd=root, capture_output=True, text=True, timeout=120, check=False)
    assert ran.returncode == 0, ran.stderr[-2000:]
