"""Obfuscated writing is restored however long it is."""

import random
import time

import numpy as np
import pytest
from test_classifiers import BAD, taught  # noqa: F401

from readlake.llm import toxicity as T


@pytest.mark.parametrize("written", ["idi" + "o" * 60 + "t", "m" + "0" * 60 + "r0n", "scu" + "m" * 5000, "-".join("moron" + "thing" * 20)])
def test_long_tokens(taught, written):  # noqa: F811
    assert taught[4].score(f"said the {written} with room") > 0.5


def test_long_spaced_run(taught):  # noqa: F811
    words = ("the thing and then other words were said with room for all " * 3 + "moron idiot").split()
    run = " ".join("".join(words))
    assert len(run) > 4 * T.LONGEST and len(run) > 250
    assert set(taught[4].restorer.apart(run)) & set(BAD) and set(taught[4].restorer.restore(run).split()) & set(BAD)
    assert taught[4].score(run) > 0.5 > taught[4].score(" ".join("".join(words[:-2])))


def test_flush_and_fold_keep_the_best_reading(monkeypatch):
    model = np.log(np.random.default_rng(5).dirichlet(np.ones(T.SYMBOLS), (T.SYMBOLS, T.SYMBOLS))).astype(np.float32)
    rnd = random.Random(1)
    segments = ["".join(rnd.choice("ab1!0 -") * rnd.choice((1, 1, 1, 2, 12)) for _ in range(60)) for _ in range(20)]
    flushed = [T.Restorer(model).decode(s) for s in segments]
    monkeypatch.setattr(T, "FLUSH", 1 << 30)
    monkeypatch.setattr(T.Restorer, "_fold", lambda self, m: m[0])
    assert flushed == [T.Restorer(model).decode(s) for s in segments]


def test_time_grows_with_length_only(taught):  # noqa: F811
    r = taught[4].restorer
    took = []
    for n in (2_000, 16_000):
        began = time.process_time()
        r.decode(" ".join("the m0ron thing".replace(" ", "") * (n // 13)))
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0]


def test_slices_do_not_cut_a_run(monkeypatch):
    monkeypatch.setattr(T, "SLICE", 10)
    text = "some words " + "i d i o t " * 9 + "and more"
    cuts = [text[a:b] for a, b in T._slices(text)]
    assert "".join(cuts) == text and sum("i d i o t" in c for c in cuts) == 1
