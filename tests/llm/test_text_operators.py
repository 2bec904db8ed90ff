"""Each operator against brute force or the library that it must agree with, with awkward rows."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweft.llm import bpe, decontam, license_scan, line_dedup, quality, queries, sharding, simhash, suffix_dedup, token_counts

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in every column, empty and blank texts, odd characters, special strings, repeated rows, one long text.
ODD = [
    (None, "a text without an id", "en", "s", 1), (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, "one", "en", "s", 3),
    (5, "same text twice over here", "en", "s", 5), (5, "same text twice over here", "en", "s", 5), (6, "Same TEXT twice over here", "fr", "s", 5),
    (7, "naïve — ＡＢ ﬁ 𝒳 ​ x  y   z \r\n ▁a▁ ▁▁b", "en", "s", 9), (8, "<|endoftext|>hi <|endoftext|> <s> </s>", "en", "s", 9), (9, "x" * 3000 + " " + "word " * 6000, "en", "s", 9),
    (10, "'s 'll don't 12345 ½²  !!\n\n\n  end ", "en", "s", 9),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def clash(odd):
    """Columns with the names that operators use inside or return."""
    for c in ("fp", "row", "removed", "n_tokens", "ids", "score", "n_hit", "mask", "item_ids", "spans", "shard", "removed_lines", "component"):
        odd = odd.withColumn(c, F.lit("mine"))
    return odd


def rng_text(r, n=60):
    return "".join(r.choice(["a", "b", " ", "  ", "\n", "é", "▁", "漢", "1", "'", "s", "<s>", "　", "\t", ".", "the ", "ing"]) for _ in range(n))


def test_token_counts(spark, odd, clash):
    import sentencepiece

    model = queries.tokenizer_file("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    r = random.Random(1)
    texts = [rng_text(r) for _ in range(400)]
    x = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r_["doc_id"]: r_["n_tokens"] for r_ in token_counts.token_counts(x, model).collect()}
    assert got == {i: len(sp.encode(t)) for i, t in enumerate(texts)}
    assert sorted(r_["n_tokens"] for r_ in token_counts.token_counts(clash, model).collect()) == sorted(len(sp.encode(t[1] or "")) for t in ODD)
    assert token_counts.token_counts(odd.limit(0), model).count() == 0
    proved = token_counts.whole_tokens(sp)
    assert len(proved) > 5000 and all(len(sp.encode(k)) == 1 for k in proved)


def test_bpe(spark, clash):
    from tokenizers import Tokenizer

    spec = queries.tokenizer_file("byte_bpe_50k.json").decode()
    t = Tokenizer.from_str(spec)
    r = random.Random(2)
    texts = [rng_text(r) + chr(r.choice([0x85, 0x180E, 0x200B, 0x1C, 0x2028, 0x0301, 0x1F600])) + rng_text(r, 10) for _ in range(400)]
    rows = [(i, x) for i, x in enumerate([*texts, *(o[1] for o in ODD)])]
    x = spark.createDataFrame(rows, "doc_id long, text string")
    for g in bpe.decode(bpe.encode(x, spec), spec).collect():
        ids = t.encode(g["text"] or "", add_special_tokens=False).ids
        assert g["ids"] == ids and g["decoded"] == t.decode(ids, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(clash, spec), spec).count() == len(ODD)
    bad = spark.createDataFrame([([128, 50256],), (None,)], "ids array<int>")
    assert {g["decoded"] for g in bpe.decode(bad, spec).collect()} == {t.decode([128, 50256], skip_special_tokens=False), ""}


def test_sharding(spark, odd, clash):
    big = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot copy").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    p = sharding.histogram_shards(big).toPandas()
    sizes = p.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 3 * p["size"].max()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in p.groupby("shard"))
    o = sharding.histogram_shards(clash, 3).toPandas()
    assert sorted(o["size"]) == sorted(len((t[1] or "").encode()) + 1 for t in ODD) and sorted(o.text_crc32) == sorted(zlib.crc32((t[1] or "").encode()) for t in ODD)
    assert sharding.histogram_shards(odd.limit(0)).count() == 0
    same = spark.range(400).select(F.lit(1).cast("long").alias("doc_id"), F.lit("all rows are one").alias("text"))
    assert sharding.histogram_shards(same).groupBy("shard").count().agg(F.max("count") - F.min("count")).first()[0] <= 4


def test_decontamination(spark, odd, clash, monkeypatch):
    items = [(1, " ".join(f"w{i}" for i in range(20))), (2, "short item"), (2, "short item"), (3, ""), (None, "no id here"), (4, None), (5, "One, TWO; three four five six seven eight nine ten eleven twelve thirteen")]
    b = spark.createDataFrame(items, "item_id long, text string")
    docs = [(0, "x " * 10 + " ".join(f"W{i}" for i in range(3, 18)) + " y"), (1, "a short item b"), (2, "one two three four five six seven eight nine ten eleven twelve THIRTEEN"), (3, " ".join(f"w{i}" for i in range(12))), (4, "no id here"), (5, "short-item " + "z " * 100)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    want = {0: (26, 15, ["1"], True), 1: (4, 2, ["2"], True), 2: (13, 13, ["5"], True), 3: (12, 0, [], False), 4: (3, 0, [], False), 5: (102, 2, ["2"], False)}
    for bits in (decontam.LEAST_BITS, 6):  # a bitmap that tells shingles apart, one that lets nearly all through
        monkeypatch.setattr(decontam, "LEAST_BITS", bits)
        monkeypatch.setattr(decontam, "MOST_BITS", max(bits, 6))
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) for r in decontam.decontaminate(d, b).collect()}
        assert got == want
    out = decontam.decontaminate(clash, b)
    assert out.count() == len(ODD) and out.where("contaminated").count() == 0
    assert decontam.decontaminate(odd.limit(0), b).count() == 0 and decontam.decontaminate(odd, b.limit(0)).where("n_hit > 0").count() == 0


def test_op9_oracle(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = queries.op9_decontamination(spark, DATA).toPandas().sort_values("doc_id", ignore_index=True)
    want = c.execute(queries.OP9_SQL).df().sort_values("doc_id", ignore_index=True)[list(got.columns)]
    assert got.equals(want)


def components_of(n, linked):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in linked:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(spark, odd, clash):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    x = spark.createDataFrame(docs, "doc_id long, text string")
    fps = [simhash.fingerprint(t) & (2**64 - 1) for _, t in docs]
    comp = components_of(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    least = collections.defaultdict(list)
    for (d, _), c in zip(docs, comp, strict=True):
        least[c].append(d)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(x).collect()}
    assert got == {d: min(least[c]) for (d, _), c in zip(docs, comp, strict=True)}
    assert simhash.near_duplicates(clash).count() == len(ODD) and simhash.near_duplicates(odd.limit(0)).count() == 0
    r = {(q["doc_id"], q["component_id"]) for q in simhash.near_duplicates(odd).collect()}
    assert {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)} <= r  # texts without words are one group
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(k["doc_id"] for k in kept.where("doc_id is not null").collect()) == [1, 4, 5, 7, 8, 9, 10] and kept.where("doc_id is null").count() == 1


@pytest.mark.parametrize("long_list", [64, 2])
def test_simhash_links(spark, monkeypatch, long_list):
    """Short and long posting lists give the same components."""
    monkeypatch.setattr(simhash, "LONG_LIST", long_list)
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(5)]
    fps = sorted({b ^ sum(1 << i for i in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(40)})
    comp = components_of(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    found = simhash.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")))
    name = {q["node"]: q["component"] for q in found.collect()}
    groups = collections.defaultdict(set)
    for f, c in zip(signed, comp, strict=True):
        groups[c].add(f)
    assert all(len({name.get(f, f) for f in g}) == 1 for g in groups.values()) and len({name.get(f, f) for f in signed}) == len(groups)


def test_line_dedup(spark, odd, clash):
    r = random.Random(6)
    words = ["".join(r.choices("abcdefgh", k=6)) for _ in range(400)]
    base = [" ".join(r.choices(words, k=n)) for n in (3, 8, 25, 40, 160, 300)]
    docs = []
    for d in range(30):
        text = []
        for s in r.sample(base, 4):
            w = s.split()
            w[r.randrange(len(w))] = r.choice(words)
            text.append(" ".join(w))
        docs.append((d, "\n".join([*text, "", "kept once", " "])))
    x = spark.createDataFrame(docs, "doc_id long, text string")
    got = {q["doc_id"]: q["removed_lines"] for q in line_dedup.mark_lines(x).where("size(removed_lines) > 0").collect()}
    assert got == removed_by_characters(docs)
    out = line_dedup.dedup_lines(clash)
    assert out.count() == len(ODD) and line_dedup.dedup_lines(odd.limit(0)).count() == 0
    left = {(q["doc_id"], q["text"]) for q in line_dedup.dedup_lines(odd).collect()}
    assert (1, None) in left and (2, "") in left and (5, "same text twice over here") in left and (3, " \n\t ") in left


def test_line_dedup_of_repeated_rows(spark):
    """Of rows that are alike one keeps its lines; blank lines and other columns stay."""
    rows = [(7, "a line\n\nanother line", "x"), (7, "a line\n\nanother line", "y"), (7, "a line\n\nanother line", "y"), (8, "another line\nmine", "z")]
    x = spark.createDataFrame(rows * 3, "doc_id long, text string, doc string").repartition(5)
    out = line_dedup.dedup_lines(x).collect()
    assert collections.Counter(r["text"] for r in out) == {"a line\n\nanother line": 1, "": 8 + 2, "mine": 1} and collections.Counter(r["doc"] for r in out) == {"x": 3, "y": 6, "z": 3}


def test_line_dedup_of_a_large_group(spark, monkeypatch):
    """Many near copies of one line share bands; those between which only pairs decide are found too."""
    monkeypatch.setattr(line_dedup, "SMALL", 6)
    r = random.Random(36)
    words = ["".join(r.choices("abcdefghijkl", k=6)) for _ in range(60)]
    docs = []
    for d in range(120):
        w = list(words)
        for _ in range(r.randrange(1, 7)):
            w[r.randrange(60)] = "".join(r.choices("abcdefghijkl", k=6))
        docs.append((d, " ".join(w)))
    x = spark.createDataFrame(docs, "doc_id long, text string")
    got = {q["doc_id"]: q["removed_lines"] for q in line_dedup.mark_lines(x).where("size(removed_lines) > 0").collect()}
    assert got == removed_by_characters(docs)



def removed_by_characters(docs, k=5, similarity=0.8):
    """Places of lines that are equal or similar, over links, to one before them, by shingles of k characters."""
    places = [(d, i, s) for d, t in docs for i, s in enumerate(t.split("\n")) if s.strip()]
    distinct = list(dict.fromkeys(s for *_, s in places))
    sets = [frozenset(s[i : i + k] for i in range(max(1, len(s) - k + 1))) for s in distinct]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    comp = dict(zip(distinct, components_of(len(sets), links), strict=True))
    seen, gone = set(), collections.defaultdict(list)
    for d, i, s in places:
        gone[d] += [i] if comp[s] in seen else []
        seen.add(comp[s])
    return {d: g for d, g in gone.items() if g}


def of_query(spark, tmp_path, docs):
    """Places that op7_line_dedup gives for documents (doc_id, text)."""
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return {q["doc_id"]: [int(i) for i in q["removed_lines"].split(",")] for q in queries.op7_line_dedup(spark, str(tmp_path)).where("n_removed > 0").collect()}


def test_line_dedup_of_short_lines(spark, tmp_path):
    """One edit in a line of 60 to 110 characters, Latin, Chinese or outside the BMP, is found."""
    r = random.Random(16)
    docs = []
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", [chr(0x4E00 + i) for i in range(900)], [chr(0x1D400 + i) for i in range(80)]):
        for _ in range(25):
            line = [r.choice(alphabet) for _ in range(r.randint(60, 110))]
            docs.append((len(docs), "".join(line)))
            line[r.randrange(len(line))] = r.choice(alphabet)
            docs.append((len(docs), "".join(line) + "\na line of its own " + "".join(r.choices(alphabet, k=40))))
    got = of_query(spark, tmp_path, docs)
    assert got == removed_by_characters(docs) and len(got) == 75



def test_line_dedup_of_repeated_patterns(spark, tmp_path):
    """Lines of few distinct shingles meet, whatever their lengths."""
    r = random.Random(26)
    docs = []
    for n in (1, 2, 4, 9, 30, 70, 120):
        for _ in range(6):
            pattern = "".join(r.choices("abcdefghijklmnop ", k=n)) + "."
            for size in (150, 250, 1500, 6000):
                docs.append((len(docs), pattern * (size // len(pattern) + 1)))
    got = of_query(spark, tmp_path, docs)
    assert got == removed_by_characters(docs) and len(got) > 100


def test_suffix_dedup(spark, odd, clash):
    r = random.Random(8)
    words = [f"w{i}" for i in range(900)]
    shared = [r.choices(words, k=n) for n in (49, 50, 51, 70, 130, 300)]
    docs = []
    for d in range(24):
        t = []
        for p in r.sample(shared, 3):
            a = r.randrange(0, max(1, len(p) - 55)) if d % 3 == 0 else 0
            t += r.choices(words, k=r.randint(0, 30)) + p[a:] + r.choices(words, k=r.randint(0, 30))
        docs.append((d, " ".join(t)))
    docs.append((24, " ".join(["again"] * 120)))
    x = spark.createDataFrame(docs, "doc_id long, text string")
    split = {d: t.lower().split() for d, t in docs}
    count = collections.Counter(tuple(w[i : i + 50]) for w in split.values() for i in range(len(w) - 49))
    for q in suffix_dedup.repeated_passages(x).collect():
        w = split[q["doc_id"]]
        want, got = [False] * len(w), [False] * len(w)
        for i in range(len(w) - 49):
            if count[tuple(w[i : i + 50])] > 1:
                want[i : i + 50] = [True] * 50
        for s in q["spans"]:
            got[s["first"] : s["end"]] = [True] * (s["end"] - s["first"])
        assert want == got and q["n_words"] == len(w) and q["n_repeated"] == sum(want)
    out = suffix_dedup.repeated_passages(clash).collect()
    assert len(out) == len(ODD) and suffix_dedup.repeated_passages(odd.limit(0)).count() == 0


def test_license_scan(spark, odd):
    import duckdb

    rows = [("a/LICENSE", "Licensed under the Apache License, Version 2.0"), ("a/b/x", "no notice here"), ("a/b/y", "a file of its own words first\nReleased under the MIT License.\nand then more of them"), ("a/b/c/LICENSE", "All rights reserved."), ("a/b/c/z", "zzz"), ("top", "nothing"), (None, "nothing"), ("a/n", None), ("a/e", "")]
    f = spark.createDataFrame(rows, "path string, text string").withColumn("row", F.lit(1)).withColumn("term", F.lit("x"))
    got = {r["path"]: (r["licence"], r["basis"], r["inherited_from"]) for r in license_scan.scan(f, "path", "text").collect()}
    assert got["a/b/x"] == ("Apache-2.0", "inherited", "a/LICENSE") and got["a/b/y"][:2] == ("MIT", "header") and got["a/b/c/z"] == ("Proprietary", "inherited", "a/b/c/LICENSE")
    assert got["top"] == (None, "none", None) and got["a/n"][1] == "inherited" and got[None] == (None, "none", None)
    assert license_scan.scan(f.limit(0), "path", "text").count() == 0 and license_scan.scan(odd, "source", "text").count() == len(ODD)
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    a = license_scan.op4_license_scan(spark, DATA).toPandas().sort_values("doc_id", ignore_index=True)
    b = c.execute(license_scan.oracle()).df().sort_values("doc_id", ignore_index=True)[list(a.columns)]
    assert a.fillna("~").astype(str).equals(b.fillna("~").astype(str))


def licence_cosine(corpus, text, notice):
    """TF-IDF cosine of a text and a notice, with document frequencies of all words over the corpus."""
    words = lambda s: [w for w in license_scan.re.split(license_scan.WORD, (s or "").lower()) if w]
    df = collections.Counter(w for t in corpus for w in set(words(t)))
    vector = lambda s: {w: n * (np.log((1 + len(corpus)) / (1 + df[w])) + 1) for w, n in collections.Counter(words(s)).items()}
    a, b = vector(text), vector(notice)
    return sum(x * b.get(w, 0) for w, x in a.items()) / np.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))


def test_license_frequencies_of_all_words(spark):
    """Common words beside a notice weigh little, though no template holds them."""
    line = "Released under the MIT License. en on be er"
    texts = [*(f"en on be er w{i} and more" for i in range(300)), f"first words of its own\n{line}\nlast words", None, ""]
    f = spark.createDataFrame([(f"d/{i}", t) for i, t in enumerate(texts)], "path string, text string")
    got = license_scan.scan(f, "path", "text").where("path = 'd/300'").first()
    want = licence_cosine(texts, line, "Released under the MIT License")
    assert want > 0.9 and (got["header"], got["basis"]) == ("MIT", "header") and np.isclose(got["header_score"], want, atol=1e-6)


def test_quality(spark, odd, clash):
    x = queries.op5_quality(spark, "/root/testdata/sf0.01").toPandas()
    y = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().merge(x, on="doc_id")
    out = y[y.held_out]
    assert (out.predicted == out.quality).mean() > 0.93 and ((out.predicted == 0) & (out.quality == 1)).sum() <= 1
    assert x.score.between(0, 1).all() and (x.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in x.doc_id]).all()
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 0), (None, 1, 1), (9, None, 0)], "doc_id long, quality int, toxic int")
    m = quality.fit(odd, labels)
    assert quality.score(clash, m).where("score between 0 and 1").count() == len(ODD)
    assert quality.score(odd, quality.fit(odd, labels.limit(0))).where("score = 0.5").count() == len(ODD)
    assert quality.score(odd.limit(0), m).count() == 0


def test_machine_is_the_sum_over_pairs():
    m = quality.Machine(np.random.default_rng(0))
    m.w[:] = np.random.default_rng(1).normal(size=len(m.w))
    i, x, starts = quality.features(["a b c a", None], quality.Buckets())
    raw = m.raw(i, x, starts)[0]
    for d in range(2):
        own = range(starts[d], starts[d + 1])
        want = m.w0 + sum(m.w[i[k]] * x[k] for k in own) + sum(float(m.v[i[k]] @ m.v[i[j]]) * x[k] * x[j] for k in own for j in own if j < k)
        assert np.isclose(raw[d], want, atol=1e-3)


def test_digests(spark):
    r = queries.op10_bpe(spark, DATA).where("doc_id = 0").first()
    text = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id = 0").first()["text"]
    assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["n_tokens"] > 0


def test_license_files_are_inherited(spark):
    """Full licence files, wrapped and with a name filled in, decide for files at and below their directory; headers come first."""
    import textwrap

    mit, bsd = (next(t for x, t in license_scan.FILE_TEMPLATES if x == name) for name in ("MIT", "BSD-3-Clause"))
    body = lambda t: "\n\n".join(textwrap.fill(p, 70) for p in t.replace("(c)", "(c) 2031 Some Person and others", 1).split(". "))
    apache = "# " + "\n# ".join(textwrap.wrap(next(t for x, t in license_scan.TEMPLATES if x == "Apache-2.0" and len(t) > 100), 60))
    rows = [
        ("p/LICENSE", body(mit)), ("p/a.py", "import os\nprint(os)"), ("p/q/b.py", "x = 1"), ("p/q/lib/LICENSE", body(bsd)), ("p/q/lib/c.py", "y = 2"), ("p/q/lib/deep/d.py", "z"),
        ("p/q/lib/own.py", apache + "\n\nimport sys\n"), ("p/spdx.c", "// SPDX-License-Identifier: GPL-2.0-only\nint main;"), ("r/e.py", "alone"), ("top.py", "at the root"), ("p/none.py", None), (None, "no place"),
    ]
    f = spark.createDataFrame(rows * 1, "path string, text string")
    got = {r["path"]: (r["licence"], r["basis"], r["inherited_from"]) for r in license_scan.scan(f, "path", "text").collect()}
    assert got["p/LICENSE"][0] == "MIT" and got["p/q/lib/LICENSE"][0] == "BSD-3-Clause"
    assert all(got[k] == ("MIT", "inherited", "p/LICENSE") for k in ("p/a.py", "p/q/b.py", "p/none.py"))
    assert all(got[k] == ("BSD-3-Clause", "inherited", "p/q/lib/LICENSE") for k in ("p/q/lib/c.py", "p/q/lib/deep/d.py"))
    assert got["p/q/lib/own.py"][:2] == ("Apache-2.0", "header") and got["p/spdx.c"][:2] == ("GPL-2.0-only", "header")
    assert got["r/e.py"][:2] == got["top.py"][:2] == got[None][:2] == (None, "none")


#: How licence files begin: fixed values. The words after them stand for the body.
HEADS = {
    "Apache-2.0": "\n                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n",
    "GPL-2.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n",
    "GPL-3.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n",
    "LGPL-2.1": "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n",
    "LGPL-3.0": "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n",
    "MPL-2.0": "Mozilla Public License Version 2.0\n==================================\n",
    "CC0-1.0": "Creative Commons Legal Code\n\nCC0 1.0 Universal\n",
}


@pytest.mark.parametrize("others", [0, 200])
def test_titles_of_license_files(spark, others):
    """Each licence file is known by its title, whatever notices its body quotes, with and without other files; a title that isn't at the head is none."""
    bodies = [(x, f"{head}\n All rights reserved.\n\n{' '.join(f'clause{i} of the licence' for i in range(400))}\n\n{license_scan._GPL.format('program', license_scan._GNU, 2)}\n") for x, head in HEADS.items()]
    rows = [(f"{x}/LICENSE", t) for x, t in bodies] + [(f"{x}/src/a/b.c", "int main;") for x in HEADS]
    rows += [("late.txt", "one\n\ntwo\n\n" + HEADS["MPL-2.0"]), ("lib.c", license_scan._GPL.format("library", license_scan._LESSER, 2.1) + "\n\nint x;"), *((f"o/{i}", f"word{i} and the of\n\nmore {i}") for i in range(others))]
    got = {r["path"]: r for r in license_scan.scan(spark.createDataFrame(rows, "path string, text string"), "path", "text").collect()}
    assert len(got) == len(rows)
    for x in HEADS:
        assert (got[f"{x}/LICENSE"]["licence"], got[f"{x}/LICENSE"]["basis"]) == (x, "file")
        assert (got[f"{x}/src/a/b.c"]["licence"], got[f"{x}/src/a/b.c"]["inherited_from"]) == (x, f"{x}/LICENSE")
    assert got["late.txt"]["file_licence"] is None and (got["lib.c"]["licence"], got["lib.c"]["basis"]) == ("LGPL-2.1", "header")


def test_license_markers_are_rare():
    """A template's frequent words mark no text where its rare ones weigh enough, even if they weigh more; without one of the markers the similarity isn't reached."""
    df = {"the": 900, "software": 2}
    for _, _, w in license_scan.vectors(license_scan.TEMPLATES, df, 1000):
        m = license_scan.markers([(0, "", w)], 0.6, df)
        assert "the" not in m and sum(x * x for t, x in w.items() if t not in m) < 0.36


def test_license_bodies_come_before_headers(spark):
    """A body that holds a line like a notice keeps its own licence; rows that repeat are all returned."""
    bsd = next(t for x, t in license_scan.FILE_TEMPLATES if x == "BSD-3-Clause").replace("All rights reserved.", "\nAll rights reserved.\n\n")
    f = spark.createDataFrame([("d/L", bsd), ("d/L", bsd), ("d/x", "All rights reserved.\n\nown words")], "path string, text string")
    got = [(r["path"], r["licence"], r["basis"]) for r in license_scan.scan(f, "path", "text").orderBy("path").collect()]
    assert got == [("d/L", "BSD-3-Clause", "file")] * 2 + [("d/x", "Proprietary", "header")]


def test_packed_words_and_numbers():
    """What is packed is what is unpacked, nothing and long words included."""
    for items in ([], [b""], [b"a", b"", b"x" * 300], [b"\0S<|endoftext|>"] * 3):
        lengths, body = bpe.unpacked(bpe.packed(items))
        assert lengths.tolist() == [len(i) for i in items] and body == b"".join(items)
    for numbers in ([], [0], [1, 2**32 - 1, 70_000]):
        assert bpe._numbers(bpe._planes(np.array(numbers, np.int64))).tolist() == numbers
