import importlib
import subprocess
import sys

import __spark_entry__ as entry


def test_every_operator_and_the_pipeline_are_registered():
    names = entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in names
    assert {"op2_exact_dedup", "op7_url_lists", "op13_hard_negatives"} <= set(entry.oracle_sql())


def test_nothing_else_imports_the_subpackage():
    code = ("import sys, pathlib, importlib\n"
            "for p in pathlib.Path('loomspark').rglob('*.py'):\n"
            "    if 'llm' not in p.parts:\n"
            "        importlib.import_module('.'.join(p.with_suffix('').parts).removesuffix('.__init__'))\n"
            "print(any(m.startswith('loomspark.llm') for m in sys.modules))")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True,
                         cwd=importlib.import_module("os").path.dirname(entry.__file__))
    assert out.stdout.strip().endswith("False"), out.stderr[-500:]


def test_entry_without_the_subpackage(tmp_path):
    import os
    import shutil
    root = os.path.dirname(entry.__file__)
    shutil.copytree(f"{root}/loomspark", tmp_path / "loomspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path,
                         env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    n, llm = out.stdout.split()[-2:]
    assert int(n) > 100 and llm == "False", out.stderr[-500:]
