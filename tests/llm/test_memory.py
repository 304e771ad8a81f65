import subprocess
import sys

import pyarrow as pa
import pytest

from strandlake.llm._memory import released

#: A worker's way: batches of new words, then idle. Prints the MB that it holds more than when it began, and what it remembers.
IDLE = """
import re
import pyarrow as pa
def held():
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"\\nPss_Anon:\\s+(\\d+)", f.read())[1]) / 1024
def texts(n, rows=1000, words=300):
    letters = "abcdefghij"
    for i in range(n):
        numbers = range(i * rows * words, (i + 1) * rows * words)
        made = ["".join(letters[int(d)] for d in str(k)) for k in numbers]
        ids = pa.array(range(rows))
        yield pa.RecordBatch.from_arrays([ids, pa.array([" ".join(made[r * words : (r + 1) * words]) for r in range(rows)])], names=["doc_id", "text"])
"""
PACKING = """
from strandlake.llm import packing
run = lambda n: sum(b.num_rows for b in packing._piece_batches(texts(n, 1000), packing.default_tokenizer(), 2048, 0))
run(0)
began = held()
run(5)
words = packing.WordTokenizer.load(packing.default_tokenizer())
print(held() - began, len(words.known))
"""
TOXICITY = """
import numpy as np
from strandlake.llm import toxicity as tox
model = tox.Classifier(tox.LanguageModel.of(np.ones(28**3)), {"stupid": 0}, np.array([4.0]), -3.0)
run = lambda n: sum(b.num_rows for b in tox._score_batches(texts(n), model, "job"))
run(0)
began = held()
run(2)
print(held() - began, len(tox._readers["job"].known))
"""


def idle(code):
    done = subprocess.run([sys.executable, "-c", IDLE + code], capture_output=True, text=True, check=True, timeout=300)
    return [float(x) for x in done.stdout.split()]


def test_idle_packing_workers_hold_little():
    more, words = idle(PACKING)
    assert more < 60 and words <= 500_000


def test_idle_scoring_workers_hold_little():
    more, tokens = idle(TOXICITY)
    assert more < 60 and tokens <= 500_000


def test_batches_pass_through_released():
    def twice(batches, times):
        for batch in batches:
            for _ in range(times):
                yield batch

    made = [pa.RecordBatch.from_arrays([pa.array([i])], names=["i"]) for i in range(3)]
    assert [b.column(0)[0].as_py() for b in released(twice)(iter(made), times=2)] == [0, 0, 1, 1, 2, 2]
    assert list(released(twice)(iter([]), times=2)) == []

    def fails(batches):
        raise ValueError("as it is")
        yield

    with pytest.raises(ValueError, match="as it is"):
        list(released(fails)(iter(made)))
