"""Steps of decontamination on many texts together give what they give for each alone."""

import numpy as np
import pytest

from credsieve.llm import decontaminate


def test_numbers_of_many_texts():
    terms = {b"que": 1, "niño".encode(): 2, b"la": 3}
    texts = ["  Que, la\x0bque\n", "", "...", "'NIÑO' x (la) \x1cla", "\x85la", "que" * 9]
    numbers, first = decontaminate.Terms(terms).numbers_of(texts)
    for i, text in enumerate(texts):
        assert numbers[first[i] : first[i + 1]].tolist() == [terms.get(w, 0) for w in decontaminate.words_of(text)]


@pytest.mark.parametrize("cells", [1, 1 << 20])
def test_items_covered_by_many_texts(monkeypatch, cells):
    monkeypatch.setattr(decontaminate, "_COVER_CELLS", cells)
    rng = np.random.default_rng(1)
    coverage = decontaminate.Coverage([rng.integers(1, 30, 6).tolist() for _ in range(20)], 30)
    texts = [rng.integers(0, 31, n) for n in (40, 0, 3, 200, 1, 25)]
    numbers = np.concatenate(texts)
    there = np.flatnonzero(numbers)
    text = np.repeat(np.arange(6), [len(t) for t in texts])[there]
    got = list(zip(*(x.tolist() for x in coverage.covered_of(text, numbers[there], 6))))
    assert got == [(i, k) for i, t in enumerate(texts) for k in coverage.covered(t).tolist()] and got


def test_products_of_many_runs():
    rng = np.random.default_rng(2)
    weights = np.concatenate([[0], rng.random(40)]).astype(np.float32)
    basis = rng.standard_normal((41, 5))
    texts = [np.where(rng.random(n) < 0.5, 0, rng.integers(1, 41, n)).astype(np.int32) for n in (0, 1, 16, 17, 33, 400, 401, 9_000)]
    want, got = np.zeros((41, 5)), np.zeros((41, 5))
    for numbers in texts:
        for start in range(0, len(numbers), decontaminate._ROWS // 4):
            part = numbers[start : start + decontaminate._ROWS // 4]
            units = [part[i : i + 16] for i in range(0, len(part), 16)]
            for passage in [np.concatenate(u) for u in zip(units, units[1:])] or units:
                row = np.bincount(passage, minlength=41) * weights.astype(np.float64)
                row /= max(np.linalg.norm(row), 1e-12)
                want += np.outer(row, row @ basis)
    for runs in decontaminate._runs(texts):
        decontaminate._add_grams(got, runs, weights, basis)
    assert np.allclose(got, want, rtol=1e-9, atol=1e-12)
