"""The registered queries over whole tables, against brute force written apart from them."""

import hashlib
import re

import duckdb
import pytest
import xxhash

from pixelweft.llm import queries

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


def rows(spark, name, data=DATA):
    return [r.asDict() for r in queries.QUERIES[name](spark, data).collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def written(spark, path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, bits):
    """The least id that each can reach."""
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


def test_op1(spark, docs):
    fps = {d: fingerprint(t) for d, t in docs}
    comp = groups(fps, 2)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows(spark, "op1_simhash")} == {(d, f"{fps[d]:016x}", comp[d]) for d, _ in docs}


def test_op1_of_odd_texts(spark, tmp_path):
    texts = [None, "", " \t\r\n", "one", "Two WORDS", "two words", "É été É", "a b c", "x\x1cy z", "a b c a b c a b c"]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows(spark, "op1_simhash", written(spark, tmp_path, texts))}
    fps = {i: fingerprint(t) for i, t in enumerate(texts)}
    comp = groups(fps, 2)
    assert got == {i: (f"{fps[i]:016x}", comp[i]) for i in fps} and got[0] == ("0" * 16, 0) and got[2][1] == 0


@pytest.mark.parametrize("name", ["op2_suffix_array", "op9_decontamination", "op4_license_scan"])
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), c.execute(queries.ORACLES[name]).df()
    columns = sorted(want.columns)
    cell = lambda v: "~" if v is None or v != v else str(round(v, 6)) if isinstance(v, float) else str(v)
    norm = lambda x: sorted(tuple(map(cell, r)) for r in x[columns].astype(object).itertuples(index=False))
    assert norm(got) == norm(want)


def test_op6(spark, docs):
    got = sorted(rows(spark, "op6_sharding"), key=lambda r: (r["shard"], r["slot"]))
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None} and len(got) == len(docs)
    by_shard = {}
    for r in got:
        by_shard.setdefault(r["shard"], []).append(r)
    assert set(by_shard) == set(range(8)) and all([r["slot"] for r in s] == list(range(len(s))) for s in by_shard.values())
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((d, len((t or "").encode()) + 1) for d, t in docs)
    sizes = [sum(r["size"] for r in s) for s in by_shard.values()]
    assert max(sizes) - min(sizes) <= 0.01 * sum(sizes) + 2 * max(r["size"] for r in got)


def test_op6_slots_follow_the_key(spark):
    """In any number of partitions, equal texts have neighbouring slots."""
    from pyspark.sql import functions as F

    from pixelweft.llm import sharding

    x = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 5000).cast("string")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sharding.histogram_shards(x, 3).toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    spans = got.groupby(["shard", "text_crc32"]).slot.agg(["min", "max", "count"])
    assert ((spans["max"] - spans["min"] + 1) == spans["count"]).mean() > 0.99  # but for texts that share a checksum


def test_op8(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=queries.tokenizer_file("piece_bpe_32k.model"))
    want = {(d, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for d, t in docs}
    assert {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows(spark, "op8_token_counts")} == want


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(queries.tokenizer_file("byte_bpe_50k.json").decode())
    t.no_truncation()
    t.no_padding()
    for d, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids
        yield d, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))


def test_op10(spark, docs):
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(spark, "op10_bpe")}
    assert got == set(library(docs))


def test_op10_of_odd_texts(spark, tmp_path):
    texts = [None, "", "<|endoftext|>", "a<|endoftext|> b", "\0S<|endoftext|>", "\0Sword", "  two  spaces ", "é漢字😀́", "x" * 100_000, "'S 's don't 12 ½"]
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(spark, "op10_bpe", written(spark, tmp_path, texts))}
    assert got == set(library(enumerate(texts)))


def test_op10_of_wide_blocks(spark, tmp_path, monkeypatch):
    """A block of more distinct words than two bytes can tell."""
    texts = [" ".join(f"w{i:x}q" for i in range(a, a + 30_000)) for a in (0, 30_000, 60_000)]
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(spark, "op10_bpe", written(spark, tmp_path, [" ".join(texts), *texts]))}
    assert got == set(library(enumerate([" ".join(texts), *texts])))


def test_op7(spark, docs):
    places = [(d, i, s) for d, t in sorted(docs) for i, s in enumerate((t or "").split("\n")) if s.strip()]
    lines = list(dict.fromkeys(s for *_, s in places))
    sets = [frozenset(s[i : i + 5] for i in range(max(1, len(s) - 4))) for s in lines]
    parent = list(range(len(lines)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    order = sorted(range(len(lines)), key=lambda i: len(sets[i]))
    for n, i in enumerate(order):
        for j in reversed(order[:n]):
            if len(sets[j]) < 0.8 * len(sets[i]):
                break
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                parent[find(i)] = find(j)
    number = {s: find(i) for i, s in enumerate(lines)}
    seen, want = set(), {d: [] for d, _ in docs}
    for d, i, s in places:
        if number[s] in seen:
            want[d].append(i)
        seen.add(number[s])
    got = rows(spark, "op7_line_dedup")
    assert {r["doc_id"]: r["removed_lines"] for r in got} == {d: ",".join(map(str, w)) for d, w in want.items()}
    assert all(r["n_removed"] == len(want[r["doc_id"]]) for r in got) and {(r["doc_id"], r["n_lines"]) for r in got} == {(d, 0 if t is None else t.count("\n") + 1) for d, t in docs}
