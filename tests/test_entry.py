"""The registry keeps its promises without the optional operators too."""

import importlib
import sys


def test_entry_without_llm(monkeypatch):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    for name in [m for m in sys.modules if m.startswith("tarn.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tarn.llm", None)
    importlib.reload(e)
    assert "scan_full" in e.queries() and not any(n[:2] == "op" and n[2].isdigit() for n in e.queries()) and "pipeline" not in e.queries()
    monkeypatch.undo()
    importlib.reload(e)
