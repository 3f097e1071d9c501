import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from codeweave.session import build_session
spark = build_session("local[2]", 2)
import __spark_entry__ as entry
queries = entry.queries()
for name in {names!r}:
    queries[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
from codeweave.functions.skeleton import skeleton_tree, tree_distance
trees = spark.createDataFrame([("BEGIN a END",)], "s string").select(skeleton_tree("s").alias("t"))
assert trees.select(tree_distance("t", "t")).first()[0] == 0.0
print("all ran")
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Started in an empty folder, so that no worker can import the package."""
    names = ["op9_repetition_rules", "op11_prefix_trie", "op13_jaccard_join"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    (tmp_path / "run.py").write_text(SCRIPT.format(repo=REPO, names=names))
    done = subprocess.run([sys.executable, "run.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]
