"""A Python worker lives on after a stage: what the stage freed must not stay with it."""

import subprocess
import sys
from pathlib import Path

import pytest

SCRIPT = r"""
import ctypes, random, re
import pyarrow as pa
import public_tokenizers
from mnemolake.llm import packing

def held():
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

class Rows:
    def selectExpr(self, *a):
        return self
    def mapInArrow(self, run, schema):
        return run

rng = random.Random(3)
words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 11))) for _ in range(150_000)]
def batches():
    for k in range(3):
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(range(1000), pa.int64()), "text": pa.array([" ".join(rng.choices(words, k=500)) for _ in range(1000)])})

run = packing.pieces(Rows(), public_tokenizers.path("word_bpe_49k.json"))
n = 0
for b in run(batches()):
    n += len(b)
    del b
now = held()
pa.default_memory_pool().release_unused()
ctypes.CDLL(None).malloc_trim(0)
print(n, now - held())
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists() or sys.platform != "linux", reason="memory can't be read here")
def test_packing_gives_freed_memory_back():
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= 3000
    assert float(out[1]) < 40
