"""Guards on the library's own source."""

import ast
import os
import pathlib
import re
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).parents[1] / "tempora"
FILES = [f for f in ROOT.rglob("*.py")]
BANNED = re.compile(r"\bF\.(current_timestamp|now|current_date|rand|randn|uuid|localtimestamp)\b|localCheckpoint|crossJoin|\.rdd\b|time\.time\(\)")


@pytest.mark.parametrize("file", FILES, ids=str)
def test_nothing_reads_the_clock_or_chance(file):
    text = file.read_text()
    assert not BANNED.search(text)
    if file.name != "settings.py":
        assert not re.search(r"datetime\.(now|utcnow|today)|date\.today", text)


@pytest.mark.parametrize("file", FILES, ids=str)
def test_layers(file):
    """Operators import no plans; nothing outside the corpus package imports it."""
    names = [n.module or "" for n in ast.walk(ast.parse(file.read_text())) if isinstance(n, ast.ImportFrom)] + [a.name for n in ast.walk(ast.parse(file.read_text())) if isinstance(n, ast.Import) for a in n.names]
    part = file.relative_to(ROOT).parts[0]
    if part != "llm":
        assert not any(n.startswith("tempora.llm") for n in names)
    if part in ("operators", "functions", "sources", "streaming"):
        assert not any(n.startswith("tempora.plans") for n in names)


@pytest.mark.parametrize("gone", [["tempora/llm", "corpus_pipeline.py"], ["tempora/llm"]])
def test_entry_works_without_the_corpus_package(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT.parent, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    for name in gone:
        shutil.rmtree(copy / name) if (copy / name).is_dir() else (copy / name).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and set(e.oracle_sql()) <= set(q); assert not [n for n in q if n.startswith('op') and n[2].isdigit()]"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": str(copy)}, timeout=60)


def test_entry_hides_no_other_error(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT.parent, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    if not (copy / "corpus_pipeline.py").exists():
        pytest.skip("the corpus package has been taken out")
    (copy / "corpus_pipeline.py").write_text("import no_such_module_at_all")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, timeout=60, capture_output=True)
    assert out.returncode != 0 and b"no_such_module_at_all" in out.stderr


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    from tempora.sources import tables

    def session(master, folder=None):
        return N(conf=N(get=lambda *_: folder), sparkContext=N(master=master, getConf=lambda: {}))

    assert tables.shared_folder(session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert tables.shared_folder(session("local[4]")).startswith("file://") and tables.shared_folder(session("local")).startswith("file://")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            tables.shared_folder(session(master))
