import tracemalloc

import numpy as np

from ledgerloom.llm import quality


def test_fit_in_place_makes_no_copy_of_the_sample():
    x = np.random.default_rng(0).random((2000, quality.WIDTH), np.float32)
    labels = np.arange(2000) % 2
    plain = quality.Model.fit(x, labels)
    tracemalloc.start()
    lean = quality.Model.fit(x.copy(), labels, in_place=True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * x.nbytes  # the copy above, and little besides
    assert (lean.vectors == plain.vectors).all() and (lean.axes == plain.axes).all()
