"""Tasks that fail half-way and are repeated: results stay whole, artifacts stay single.

Needs a session of its own, since a local session gives up at the first failure unless told otherwise.
"""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = '''
import sys
from pathlib import Path

import numpy as np
from pyspark import TaskContext
from pyspark.sql import SparkSession

base = Path(sys.argv[1])
spark = (
    SparkSession.builder.master("local[4,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
    .config("spark.checkpoint.dir", str(base / "scratch")).config("spark.sql.warehouse.dir", str(base / "warehouse"))
    .config("spark.ui.showConsoleProgress", "false").getOrCreate()
)
spark.sparkContext.setLogLevel("OFF")

from scoreloom.functions import pixels
from scoreloom.plans import patterns
from scoreloom.session import RunParams, make_namespace, ship_package
from scoreloom.sources.models import LinearModel, Preprocess

ship_package(spark)


class Failing:
    """Breaks in the third micro-batch of every first and second attempt."""

    prep = Preprocess(2)

    def __init__(self, inner):
        self.inner = inner

    def load(self):
        self.calls = 0
        return self

    def logits(self, batch):
        self.calls += 1
        if self.calls == 3 and TaskContext.get().attemptNumber() < 2:
            raise RuntimeError("lost")
        return self.inner.logits(batch)

    def label(self, index):
        return self.inner.label(index)


rng = np.random.default_rng(0)
model = LinearModel(rng.normal(size=(3, 12)), np.zeros(3), {0: "a", 1: "b", 2: "c"}, Preprocess(2))
want = {}
(base / "in").mkdir()
for i in range(40):
    picture = rng.integers(0, 256, (4, 4, 3), dtype=np.uint8)
    target = base / "in" / f"{i:02d}.ppm"
    target.write_bytes(pixels.encode_image(picture, "", "netpbm"))
    z = model.logits(pixels.to_tensor(picture, 2, model.prep.mean, model.prep.std)[None])[0]
    want[str(target)] = "abc"[int(z.argmax())]

make_namespace(spark, "retries")
params = RunParams(
    catalog="", schema="retries", dataset="d", image_dir=str(base / "in"), image_glob="*.ppm", file_glob="*.ppm",
    n_images=None, num_partitions=3, micro_batch=2,
)
for name, go in {
    "direct": lambda out: patterns.direct(spark, params, Failing(model), out),
    "ingest": lambda out: patterns.ingest_then_score(spark, params, Failing(model), out, str(base / "checkpoint")),
    "staged": lambda out: patterns.staged(spark, params, Failing(model), out, str(base / "work"), batch_size=2),
}.items():
    folder = base / name
    run = go(patterns.Output(str(folder), form="netpbm"))
    rows = run.table.collect()
    assert len(rows) == 40 and {r.path: r.label for r in rows} == want, name
    assert run.summary["num_images"] == 40, (name, run.summary)
    assert sorted(p.name for p in folder.iterdir()) == [f"{i:02d}.ppm" for i in range(40)], name
    for p in folder.iterdir():
        assert pixels.decode_image(p.read_bytes()).shape == (4, 4, 3)
print("all whole")
'''


def test_repeated_tasks(tmp_path):
    script = tmp_path / "retries.py"
    script.write_text(SCRIPT)
    root = str(Path(__file__).resolve().parent.parent)
    done = subprocess.run(
        [sys.executable, str(script), str(tmp_path)], capture_output=True, text=True, timeout=300,
        env={**os.environ, "PYTHONPATH": root},
    )
    assert done.stdout.strip().endswith("all whole"), done.stdout[-2000:] + done.stderr[-3000:]
