"""The registered queries are there with and without the optional part."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest
from conftest import ROOT

SCRIPT = """
import sys
{before}
import __spark_entry__ as entry
assert entry.core_queries().keys() >= entry.core_oracle_sql().keys()
optional = entry.queries().keys() - entry.core_queries().keys()
print("FOUND", len(entry.core_queries()), len(optional))
"""


def found(folder: str, before: str = "") -> tuple[int, int]:
    env = os.environ | {"PYTHONPATH": folder, "PYTHONDONTWRITEBYTECODE": "1"}
    run = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(before=before)],
        cwd=folder, env=env, capture_output=True, text=True, check=False,
    )
    assert run.returncode == 0, run.stderr
    core, optional = run.stdout.rpartition("FOUND")[2].split()
    return int(core), int(optional)


@pytest.fixture(scope="module")
def copy(tmp_path_factory):
    """The repository without the optional part."""
    folder = tmp_path_factory.mktemp("copy")
    for name in ("__spark_entry__.py", "feed_mapping.py"):
        shutil.copy(os.path.join(ROOT, name), folder)
    skip = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(os.path.join(ROOT, "pkgwarden"), folder / "pkgwarden", ignore=skip)
    return folder


def test_without_the_optional_part(copy):
    core, optional = found(str(copy))
    assert core >= 58 and optional == 0


def test_with_what_a_deleted_folder_leaves(copy):
    (copy / "pkgwarden/llm/__pycache__").mkdir(parents=True, exist_ok=True)
    core, optional = found(str(copy))
    assert core >= 58 and optional == 0


def test_without_what_the_optional_part_needs():
    before = "sys.modules['public_tokenizers'] = sys.modules['xxhash'] = None"
    core, optional = found(ROOT, before)
    assert core >= 58 and optional == 0
