"""op4 on texts of many lines: slices give what the whole text gives, in little memory, and texts do not see their neighbours."""

import subprocess
import sys

import numpy as np
import pytest
from conftest import ROOT

from lorekeep.llm import quality as Q

WORDS = ["alpha", "beta", "BUY", "now!!!", "x", "", "  ", "12", "12", "12", "ünd"]


def text(rng, n):
    return "\n".join(" ".join(rng.choice(WORDS, rng.integers(0, 6))) for _ in range(n)).encode()


@pytest.fixture()
def chain():
    rng = np.random.default_rng(0)
    c = Q.LineChain(3 * Q.OWN + 3)
    c.w, c.t, c.curve = rng.normal(size=len(c.w)), rng.normal(size=(2, 2)), np.array([-1.0, 3.0])
    return c


def whole(chain, data):
    return chain.quality(*Q.line_features(data, np.array([0, len(data)])))[0]


@pytest.mark.parametrize("size", [50, 1000, 1 << 17])
@pytest.mark.parametrize("n", [1, 2, 3, 7, 300, 2000])
def test_slices(chain, monkeypatch, size, n):
    monkeypatch.setattr(Q, "SLICE", size)
    for end in (b"", b"\n", b"\n\n"):
        data = np.frombuffer(text(np.random.default_rng(n), n) + end, np.uint8)
        assert b"\n".join(bytes(data[a:b]) for a, b in Q.line_slices(data)) == bytes(data)
        assert chain.long_quality(data) == pytest.approx(whole(chain, data), abs=1e-9)


def test_line_longer_than_a_slice(chain, monkeypatch):
    monkeypatch.setattr(Q, "SLICE", 100)
    data = np.frombuffer(b"a b\n" + b"word " * 3000 + b"\nx y\n\n" + b"q" * 5000, np.uint8)
    assert b"\n".join(bytes(data[a:b]) for a, b in Q.line_slices(data)) == bytes(data)
    assert chain.long_quality(data) == pytest.approx(whole(chain, data), abs=1e-9)


def test_groups_and_neighbours(chain, monkeypatch):
    monkeypatch.setattr(Q, "LONG_LINES", 40)
    monkeypatch.setattr(Q, "BATCH_LINES", 100)
    rng = np.random.default_rng(4)
    texts = [text(rng, int(n)) for n in rng.integers(0, 70, 60)] + [b"", b"12", b"12 12"]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = chain.score(np.frombuffer(b"".join(texts), np.uint8), offsets)
    alone = [chain.score(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert got == pytest.approx(alone, abs=1e-12)


def test_ten_megabytes_of_newlines_under_a_gigabyte():
    code = """
import numpy as np, resource
from lorekeep.llm import quality as Q
c = Q.LineChain(3 * Q.OWN + 3)
c.w[:] = 0.1
d = np.full(10 << 20, 10, np.uint8)
assert 0 < c.score(d, np.array([0, len(d)]))[0] < 1
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=300, check=True)
    assert int(out.stdout.split()[-1]) < 1000
