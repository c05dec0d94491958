from __future__ import annotations

from pactline import session
from pactline.operators.partitions import cut


def test_scratch_tables_can_be_cleared(spark, tmp_path, monkeypatch):
    root = tmp_path / "application"
    monkeypatch.setattr(session, "_scratch_root", lambda _: str(root))
    assert cut(spark.range(3), "numbers").count() == 3
    assert any(root.iterdir())
    session.clear_scratch(spark)
    assert not root.exists()
    session.clear_scratch(spark)
