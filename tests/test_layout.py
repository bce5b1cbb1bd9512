"""What may import what."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_imports_llm():
    for file in (ROOT / "treelake").rglob("*.py"):
        if "llm" not in file.relative_to(ROOT / "treelake").parts:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", file.read_text()), file


def test_no_local_checkpoints():
    for file in (ROOT / "treelake").rglob("*.py"):
        assert "localCheckpoint" not in file.read_text(), file
