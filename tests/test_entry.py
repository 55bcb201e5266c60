import ast
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_does_not_need_the_operators_for_training_data():
    for folder, _, names in os.walk(os.path.join(ROOT, "textloom")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                for node in ast.walk(ast.parse(open(os.path.join(folder, name)).read())):
                    imported = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or "", *(a.name for a in node.names)] if isinstance(node, ast.ImportFrom) else []
                    assert not any("llm" in i.split(".") for i in imported), name
    code = "import sys; sys.modules['textloom.llm'] = None; import __spark_entry__ as e; assert 'p5_found' in e.queries() and 'p4_found' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0


def test_entry(spark):
    import __spark_entry__ as e

    if os.path.exists("/root/testdata/sf0.001"):
        assert e.entry(spark).columns == ["dir_id", "root_id", "depth"]
