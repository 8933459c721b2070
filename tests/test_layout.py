"""The training-data operators stand apart, and intermediate tables can be dropped."""

import re
from pathlib import Path

from photonlake.plans.shared import drop_shared, materialise

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_imports_the_training_data_operators():
    for path in (ROOT / "photonlake").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "photonlake").parts:
            assert not re.search(r"(import|from)\b.*\bllm\b", path.read_text()), path


def test_shared_tables(spark):
    df = materialise(spark.range(5).repartition(2))
    assert df.count() == 5
    path = Path(df.inputFiles()[0].removeprefix("file://"))
    assert path.exists()
    drop_shared(spark)
    assert not path.exists()
