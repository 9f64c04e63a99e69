from collections import Counter
from math import log
from zlib import crc32

import numpy as np
import pytest

from orrery.llm import url_filter


def difference(text, known):
    """Of a text under models counted in plain dictionaries from known (text, label)."""
    n = Counter()
    padded = lambda t: [None] * url_filter.ORDER + list(t)
    for t, label in known:
        for i in range(len(t)):
            for k in range(url_filter.ORDER + 1):
                at = i + url_filter.ORDER
                n[label, tuple(padded(t)[at - k : at])] += 1
                n[label, tuple(padded(t)[at - k : at]), t[i]] += 1
    out = [0.0, 0.0]
    for i in range(len(text)):
        for c in (0, 1):
            p = 1 / 256
            for k in range(url_filter.ORDER + 1):
                context = tuple(padded(text)[i + url_filter.ORDER - k : i + url_filter.ORDER])
                p = (n[c, context, text[i]] + url_filter.ALPHA * p) / (n[c, context] + url_filter.ALPHA)
            out[c] += log(p) / len(text)
    return out[1] - out[0]


@pytest.mark.parametrize("hot", [4, 1 << 15])
def test_differences_are_those_of_exact_counts(spark, monkeypatch, hot):
    monkeypatch.setattr(url_filter, "HOT", hot, raising=False)
    draw = np.random.default_rng(5)
    word = lambda n: "".join(map(chr, draw.integers(97, 123, n)))
    rows = [(i, f"http://a.{'net' if i % 2 else 'org'}/fr/{word(500)}") for i in range(200)]
    rows = [r for r in rows if crc32(r[1].encode()) % 5][:120] + [(900, None), (901, "é\x00?x")]
    rows += [(1000 + i, f"http://b.edu/{rows[i][1][-90:]}#é") for i in range(8)] + [(1003, "http://b.edu/")] * 2
    got = [r for r in url_filter.verdicts(spark.createDataFrame(rows, "page_id long, url string")).collect() if r["verdict"] is not None]
    assert len(got) == len(rows) and all((r["difference"] is None) == (r["page_id"] < 900) for r in got)
    known = [(u.encode(), i % 2) for i, u in rows[:120]]
    want = sorted((i, difference((u or "").encode(), known)) for i, u in rows[120:])
    assert np.allclose(np.array(sorted((r["page_id"], r["difference"]) for r in got if r["difference"] is not None)), np.array(want), atol=1e-8)


def test_held_out_urls_are_counted_in_the_end(spark):
    urls = [(f"http://a.{'net' if i % 2 else 'org'}/fr/{i}", i % 2) for i in range(200)]
    common = next(u for u in (f"http://often.net/buy/{i}" for i in range(99)) if crc32(u.encode()) % 5 == 0)  # one url of a third of the rows
    known = urls + [(common, 1)] * 100
    rows = [(i, u) for i, (u, _) in enumerate(known)] + [(1000, "http://x.edu/often/buy")]
    got = url_filter.verdicts(spark.createDataFrame(rows, "page_id long, url string")).where("page_id = 1000").first()
    want = difference(rows[-1][1].encode(), [(u.encode(), label) for u, label in known])
    assert abs(got["difference"] - want) < 1e-8 and got["verdict"] == "block"
