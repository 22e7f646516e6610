"""What one Python worker holds at a time does not follow the text it is handed."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from scoreloom.llm import bpe, jaccard

MB = 1 << 20
LEVELS = type("Levels", (), {"value": bytes(jaccard.COUNTERS)})


def texts(rows: int, words: int = 300) -> pa.RecordBatch:
    """Rows of about 2 KB each."""
    rng = np.random.default_rng(7)
    said = [" ".join(f"w{x}" for x in rng.integers(100_000, 200_000, words).tolist()) for _ in range(rows)]
    return pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int64()), pa.array(said)], ["doc_id", "text"])


def held(rows) -> int:
    """The most that is held at once while ``rows`` go by."""
    tracemalloc.start()
    try:
        for _ in rows:
            pass
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("run", [jaccard._census(5), jaccard._prefixes(5, 80, LEVELS), jaccard._contents(5, LEVELS)])
def test_word_passes_hold_little(run):
    batch = texts(1000)
    assert held(run([batch])) < 32 * MB


def test_tokens_hold_little():
    letters = bpe.byte_letters()
    pairs = bpe.BytePairs({c: b for c, b in letters.items()}, [])
    batch = texts(800)
    parts = list(bpe._parts([batch], "text"))
    assert len(parts) > 1
    assert held(bpe._ids(pairs, x, "text") for x in parts) < 48 * MB


def test_counters_are_exact():
    batch = texts(300, 40)
    blobs = [b for b in jaccard._census(3)([batch, batch.slice(0, 50)])]
    total = np.zeros(jaccard.COUNTERS, dtype=np.int64)
    width = jaccard.COUNTERS // jaccard.SEGMENTS
    want = total.copy()
    for b in blobs:
        for segment, blob in zip(b.column("segment").to_pylist(), b.column("blob").to_pylist()):
            if segment >= 0:
                assert blob[:1] == b"t"
                both = np.frombuffer(blob, "<u4", offset=1)
                total[segment * width + both[: len(both) // 2]] += both[len(both) // 2 :]
    for rows in (batch, batch.slice(0, 50)):
        for w in jaccard.words(rows.column("text"), jaccard.NOT_SPACE):
            value, _ = jaccard.gram_sets(w, 3)
            want += np.bincount(jaccard._slot(value), minlength=jaccard.COUNTERS)
    assert (total == want).all()
