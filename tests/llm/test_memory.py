"""What stages hold at a time."""

import random
import tracemalloc

from varileaf.llm import repeats


def test_a_batch_of_texts_takes_little():
    data = random.Random(2).randbytes(repeats.BATCH)
    repeats.segments([data])
    tracemalloc.start()
    repeats.segments([data])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
