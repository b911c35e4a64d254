import subprocess
import sys
from pathlib import Path

import pytest

from rankloom.session import materialise, remove_scratch, scratch_path, scratch_scope

ROOT = Path(__file__).resolve().parents[1]

JOB = """
import sys
sys.path.insert(0, {root!r})
from rankloom.session import local_session, ship
spark = local_session("ship", cores=2, partitions=2, memory="1g")
{ship}
from rankloom.functions.guards import positive_k
def run(batches):
    for batch in batches:
        assert positive_k(1) == 1
        yield batch
found = spark.range(3).mapInArrow(lambda b: run(b), "id long")
sys.path.remove({root!r})
print("rows", found.count())
"""


def test_shipped_to_workers_that_do_not_have_the_package(tmp_path):
    """Only the driver knows the package's folder; workers start elsewhere."""
    script = tmp_path / "job.py"
    script.write_text(JOB.format(root=str(ROOT), ship="ship(spark)"))
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "rows 3" in done.stdout, done.stderr[-2000:]


def test_scopes_remove_what_was_written_inside(spark):
    def there(path):
        return Path(path.removeprefix("file://").removeprefix("file:")).exists()

    before = scratch_path(spark, "before")
    with scratch_scope(spark):
        inner = scratch_path(spark, "inner")
        rows = materialise(spark.range(5).toDF("x"), "inner", inner)
        kept = materialise(rows.where("x > 2"), "kept", before)
        assert there(inner)
    assert not there(inner) and [r.x for r in kept.orderBy("x").collect()] == [3, 4]
    with pytest.raises(RuntimeError, match="stopped"), scratch_scope(spark):
        left = scratch_path(spark, "left")
        materialise(spark.range(1), "left", left)
        raise RuntimeError("stopped")
    assert there(left)
    remove_scratch(spark, left)
    assert not there(left)
    with pytest.raises(ValueError, match="no path"):
        remove_scratch(spark, "/tmp")
