import pytest

pytest.importorskip("docquarry.llm")
