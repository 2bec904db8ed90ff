"""Personal data: the patterns against their plain regular expressions, the tagger against its own definitions and on made-up pieces that it has not seen."""

import hashlib
import re

import numpy as np
import pytest

from pixelweft.llm import pii, queries

DATA = "/root/testdata/sf0.001"
PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")) or kind == 3 and not 9 <= len(d) <= 15:
                continue
            if kind == 2 and (not 12 <= len(d) <= 19 or sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10):
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def said(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.fit(spark.read.parquet(f"{DATA}/documents.parquet"))


def test_patterns():
    rng = np.random.default_rng(4)
    pieces = ["a", "Z9", "@", ".", "-", "+", " ", "(", ")", "1", "42", "255", "256", "4111111111111111", "4111 1111-1111 1111", "x@y.z", "1.2.3.4", "+1 (743) 555-3824", "%", "_", "é", "😀", "\n", "00", "127.0.0.1"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces, rng.integers(0, 25)))
        assert pii.base_spans(text) == plain(text), text
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "@" * 100_000, "a@b" * 50_000, "a@" + "b" * 200_000 + ".c", "+1" + " " * 200_000, "x" * 100_000 + "@y.z"):
        pii.base_spans(text)
    assert pii.base_spans("x" * 100_000 + "@y.z") == [(0, 0, 100_004)]


def test_query(spark, tmp_path):
    """Base spans are the patterns', whatever the tagger adds; added spans touch none of them."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    docs += [(10**6, None), (10**6 + 1, ""), (10**6 + 1, ""), (None, "mail x.y@mail.example.com now"), (10**6 + 2, "word " * 40_000 + "a.b@c.de " + "tail " * 30_000)]
    spark.createDataFrame([(*d, 1, "s") for d in docs], "doc_id long, text string, n_added int, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.asDict() for r in queries.op11_pii(spark, str(tmp_path)).collect()]
    want = sorted((d is not None, d or 0, *(sum(k == n for _, k, _ in plain(t)) for n in range(4)), hashlib.sha256(said(plain(t)).encode()).hexdigest()) for d, t in docs)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, *(r[f"n_{k}"] for k in pii.KINDS), r["base_sha256"]) for r in got) == want
    for d, t in docs:
        ours = [r["spans"].split(",") for r in got if r["doc_id"] == d and r["base_sha256"] == hashlib.sha256(said(plain(t)).encode()).hexdigest()][0]
        assert {s for s in said(plain(t)).split(",") if s} <= set(ours)
        places = [tuple(map(int, s.split(":")[1:])) for s in ours if s and s not in said(plain(t)).split(",")]
        assert not any(a < e and s < b for a, b in places for s, _, e in plain(t))
    assert sum(r["n_added"] for r in got) <= 0.02 * len(docs)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find(empty, pii.fit(empty)).count() == 0


def test_gradients():
    """Of likelihood and both directions, against differences."""
    rng = np.random.default_rng(0)
    h = pii.HIDDEN
    table, u = rng.normal(0, 0.05, (4 * h, pii.CLASSES)) + np.repeat([0.5, 0.6, 0.5, 0], h)[:, None], rng.normal(0, 0.05, (4 * h, h))
    v, step, first, last = rng.normal(0, 0.3, (pii.TAGS, h)), rng.normal(0, 0.3, (pii.TAGS, pii.TAGS)), np.zeros(pii.TAGS), np.zeros(pii.TAGS)
    x, y = rng.integers(32, 120, (9, 4)).astype(np.uint8), np.zeros((9, 4), int)
    y[3, 1], y[4, 1], y[8, 2] = 1, 2, 5
    for back in (False, True):

        def loss(back=back):
            kept = pii._layer(table, u, x, back)
            hidden = kept[3][1:][::-1] if back else kept[3][1:]
            return kept, pii._crf(np.matmul(v, hidden), y, step, first, last)

        kept, (_, g_e, g_step, *_) = loss()
        d_table, d_u = pii._layer_back(table, u, x, kept, np.matmul(v.T, g_e))
        for a, g, i in ((table, d_table, (3, x[2, 1])), (table, d_table, (9, x[5, 0])), (table, d_table, (30, x[1, 2])), (u, d_u, (4, 2)), (u, d_u, (27, 6)), (step, g_step, (0, 1)), (step, g_step, (1, 2))):
            a[i] += 1e-6
            up = loss()[1][0]
            a[i] -= 2e-6
            down = loss()[1][0]
            a[i] += 1e-6
            assert np.isclose((up - down) / 2e-6, g[i], rtol=1e-3, atol=1e-6)


def test_viterbi_and_its_bound(tagger):
    """The best tags have the highest score of all; windows that are passed over have none."""
    import itertools

    rng = np.random.default_rng(1)
    e = rng.normal(0, 2, (4, pii.TAGS, 3)).astype(np.float32)
    tags = tagger.best(e)
    for w in range(3):
        score = lambda p, w=w: tagger.first[p[0]] + tagger.last[p[-1]] + sum(e[t, k, w] for t, k in enumerate(p)) + sum(tagger.step[a, b] for a, b in zip(p, p[1:], strict=False))
        assert np.isclose(score(tags[:, w]), max(score(p) for p in itertools.product(range(pii.TAGS), repeat=4)), atol=1e-3)
    texts = ["plain words, nothing else. " * 9, "call +1 (743) 555-3824 or 1.2.3.4", "a at b dot com", "@" * 60, "9" * 90]
    for _, windows, *_ in pii._windows(texts):
        e = tagger.emissions(np.ascontiguousarray(windows.T))
        assert set(np.flatnonzero((tagger.best(e) != 0).any(0))) <= set(np.flatnonzero(tagger.can_label(e)))


def test_windows_answer_for_every_character_once():
    for n in (0, 1, 31, 319, 320, 321, 592, 593, 5000):
        hit = np.zeros(n, int)
        for _, windows, _, start, answers in pii._windows(["x" * n]):
            for s, (a, b) in zip(start, answers, strict=True):
                hit[s + a : s + b] += 1
            assert (windows != pii.NOTHING).sum() >= n or len(start) < 2
        assert (hit == 1).all()
    found = list(pii._windows(["ab" * 400_000]))
    assert max(len(w) for _, w, *_ in found) <= pii.TOGETHER


def test_pieces_that_no_pattern_covers(tagger, spark):
    """Made-up pieces in unseen places: most are found, little else is; and a piece is found wherever windows part the text."""
    docs = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(400).collect()]
    clean = [(d[a : a + pii.FIT_WIDTH], []) for d in docs for a in (len(d) // 3,) if d[a : a + pii.FIT_WIDTH] and not pii.base_spans(d[max(0, a - 60) : a + 160])]
    x, y = pii.training_windows(clean, 77)
    some, tags = tagger.tagged(x)
    got = np.zeros_like(y)
    got[some] = tags
    with_label = y.any(1)
    assert ((got > 0) & (y > 0)).any(1)[with_label].mean() > 0.9
    assert (got > 0).any(1)[~with_label].mean() < 0.05
    filler = "words of no kind here "
    for at in range(240, 340, 7):
        text = (filler * 20)[:at] + " (743) 555-3824 " + filler * 20
        (base, added), = pii.all_spans([text], tagger)
        assert not base and [(k, text[a:b].strip("() ")) for a, k, b in added] == [(3, "743) 555-3824")], at


def test_masked(spark, tagger):
    x = spark.createDataFrame([(1, "é x.y@mail.example.com and 1.2.3.4!", 5), (2, None, 6), (3, "none", 7)], "doc_id long, text string, base int")
    got = {r["doc_id"]: r["text"] for r in pii.masked(pii.find(x, tagger)).collect()}
    assert got == {1: "é <email> and <ip>!", 2: None, 3: "none"}
