"""Nothing outside the optional subpackage may import it."""

import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def imports(path: Path) -> set[str]:
    found = set()
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            found |= {a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom):
            found |= {f"{node.module or ''}.{a.name}" for a in node.names} | {node.module or ""}
    return found


def test_only_the_entry_names_the_subpackage():
    files = [p for p in (ROOT / "sigloom").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts] + [ROOT / "bench.py"]
    for path in files:
        assert not any("llm" in name.split(".") or name.startswith("corpus_pipeline") for name in imports(path)), path


def test_kernels_need_no_spark():
    assert not any("pyspark" in name for name in imports(ROOT / "sigloom/functions/dsp.py"))
