"""Byte-level BPE encoding and decoding through a table of distinct words.

Texts are split into words (pre-tokens) block by block; a block is about ``BLOCK`` bytes of text and keeps its
documents as positions in the list of its distinct words. That list is dealt out by the hash of the word: all blocks' shares with one hash
meet in one partition, where every distinct word is encoded once. The ids of each share go back to its block and are joined to the
documents by position. So what moves is each distinct word of a block, packed with others of its share, not each word of
the corpus; a word that every block has costs its partition no more than any other, and nothing is gathered beyond a block.

Decoding joins ids with the table of pieces. The table has a row for each id of the vocabulary and is sent to every task; ids
find their pieces in it by position.
"""

from __future__ import annotations

import collections
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelweft.llm.common import chunks, discard, durable, map_texts, scratch, small_batches
from pixelweft.storage import durable_split

#: Fixed value: the split pattern of byte-level BPE (public; also public_tokenizers.PATTERN).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text of a block, about.
BLOCK = 8 << 20
#: Words that are replaced by their ids at a time, and words whose ids a task remembers at most: beyond it, it begins anew and may encode a word again.
WORDS_AT_A_TIME, MEMORY = 1 << 19, 2_000_000
#: Stands before a special string among the words. No word of the pattern has a letter after it.
SPECIAL = "\0S"


def load(spec: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(spec)
    t.no_truncation()
    t.no_padding()
    return t


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others, in order, for
    the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def check_spec(spec: str) -> list[str]:
    """The strings of the special tokens; raises if the tokenizer isn't a plain byte-level BPE."""
    j = json.loads(spec)
    split = j["pre_tokenizer"] or {}
    if j["model"]["type"] != "BPE" or j["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or (j["decoder"] or {}).get("type") != "ByteLevel":
        raise ValueError("a byte-level BPE without a normaliser or prefix space is needed")
    if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in j["added_tokens"]):
        raise ValueError("added tokens must match as they stand")
    return [t["content"] for t in j["added_tokens"]]


class Splitter:
    """Words of texts; special strings are words of their own."""

    def __init__(self, special: list[str]):
        import regex

        special = sorted(special, key=len, reverse=True)
        self.words = regex.compile(PATTERN).findall
        self.special = {s: [SPECIAL + s] for s in special}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else None

    def __call__(self, text: str | None) -> list[str]:
        if not text:
            return []
        if not any(s in text for s in self.special):
            return self.words(text)
        return [w for x in self.cut(text) for w in self.special.get(x) or self.words(x)]


def packed(items: list[bytes]) -> bytes:
    """Byte strings in one, compressed."""
    lengths = np.fromiter(map(len, items), np.int64, len(items))
    small = bool(len(items) == 0 or lengths.max() < 256)
    raw = b"\1" * small + b"\4" * (not small) + len(items).to_bytes(4, "little") + lengths.astype(np.uint8 if small else np.uint32).tobytes() + b"".join(items)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> tuple[np.ndarray, bytes]:
    """The lengths of the byte strings, and all of them, one after the other."""
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    n = int.from_bytes(raw[1:5], "little")
    lengths = np.frombuffer(raw, np.uint8 if raw[0] == 1 else np.uint32, n, 5).astype(np.int64)
    return lengths, raw[5 + n * raw[0] :]


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 by first, second, third and fourth bytes, compressed: the high ones are mostly zero."""
    raw = numbers.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _numbers(data: bytes) -> np.ndarray:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def blocks(docs: DataFrame, special: list[str], shares: int) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc, text) as two tables, written in one pass and bucketed by block, so that the ids come to the blocks and these stay where they are.

    One row for each block (block, docs, n, codes, shares): the documents, and the number of words of each; the words of all, 0 where a word comes for the first time in the
    block, else 1 + its place in the order of first times; the share of each place. And rows (block, share, words): the words of a share in that order, packed.
    """
    doc = docs.schema["doc"].dataType
    schema = T.StructType([
        T.StructField("kind", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("docs", T.ArrayType(doc)), T.StructField("n", T.ArrayType(T.IntegerType())),
        T.StructField("codes", T.BinaryType()), T.StructField("shares", T.BinaryType()), T.StructField("share", T.IntegerType()), T.StructField("words", T.BinaryType()),
    ])
    names = schema.names

    class Open:
        """A block that is being filled."""

        def __init__(self):
            self.place = collections.defaultdict()
            self.place.default_factory = self.place.__len__  # the next number
            self.docs, self.n, self.codes, self.bytes = [], [], [], 0

        def add(self, piece, each: list[list[str]]) -> None:
            self.docs.append(piece.column("doc"))
            self.n.extend(map(len, each))
            self.codes.extend(np.fromiter(map(self.place.__getitem__, words), np.uint32, len(words)) for words in each)
            self.bytes += piece.column("text").nbytes

        def closed(self, number: int):
            codes = np.concatenate(self.codes)
            known = np.maximum.accumulate(np.concatenate([[-1], codes.astype(np.int64)]))[:-1]
            codes = np.where(codes > known, 0, codes + 1)  # a number that is higher than all before is new
            docs = pa.concat_arrays(self.docs)
            words = [w.encode("utf-8", "surrogatepass") for w in self.place]
            share = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % shares
            none = lambda kind: pa.nulls(1, kind)
            row = [pa.array([0], pa.int32()), pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs), pa.array([self.n], pa.list_(pa.int32())), pa.array([_planes(codes)], pa.binary()), pa.array([_planes(share)], pa.binary()), none(pa.int32()), none(pa.binary())]
            yield pa.RecordBatch.from_arrays(row, names)
            order = np.argsort(share, kind="stable")
            have, begins = np.unique(share[order], return_index=True)
            lists = [packed([words[i] for i in part]) for part in np.split(order, begins[1:])] if len(words) else []
            k = len(lists)
            if k:
                yield pa.RecordBatch.from_arrays([pa.array([1] * k, pa.int32()), pa.array([number] * k, pa.int64()), pa.nulls(k, row[2].type), pa.nulls(k, row[3].type), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), pa.array(have, pa.int32()), pa.array(lists, pa.binary())], names)

    def run(batches):
        split, number, block = Splitter(special), TaskContext.get().partitionId() << 32, Open()
        for batch in batches:
            for piece in chunks(batch, "text"):
                block.add(piece, [split(t) for t in piece.column("text").to_pylist()])
                if block.bytes >= BLOCK:
                    yield from block.closed(number)
                    number, block = number + 1, Open()
        if block.docs:
            yield from block.closed(number)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole, lists = durable_split(docs.select("doc", "text").mapInArrow(run, schema), "kind", [0, 1], "blocks", ("block", n))
    return whole, lists


def word_ids(lists: DataFrame, spec: str) -> DataFrame:
    """Rows (block, share, counts, ids) of ``lists`` (block, share, words): how many ids each word has, and all of these, packed.

    All lists of a share meet in one partition; a word is encoded when the first of them has it.
    """
    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        t, known = load(spec), {}
        for batch in batches:
            out = []
            for data in batch.column("words").to_pylist():
                lengths, body = unpacked(data)
                ends = np.cumsum(lengths).tolist()
                words = [body[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                new = [w for w in words if w not in known]
                if len(known) + len(new) > MEMORY:
                    known, new = {}, words
                plain = [w for w in new if not w.startswith(SPECIAL.encode())]
                for w, e in zip(plain, t.encode_batch([w.decode("utf-8", "surrogatepass") for w in plain], add_special_tokens=False), strict=True):
                    known[w] = np.asarray(e.ids, np.int32).tobytes()
                for w in new:
                    if w.startswith(SPECIAL.encode()):
                        known[w] = np.asarray([t.token_to_id(w[len(SPECIAL) :].decode())], np.int32).tobytes()
                ids = [known[w] for w in words]
                counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                out.append((_planes(counts), _planes(np.frombuffer(b"".join(ids), np.uint32))))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("share"), *(pa.array([o[k] for o in out], pa.binary()) for k in range(2))], ["block", "share", "counts", "ids"])

    return lists.select("block", "share", "words").repartition(n, "share").mapInArrow(run, "block long, share int, counts binary, ids binary")


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``values`` that are ``wanted``, one after another, and where each ends."""
    n = lengths[wanted]
    ends = np.cumsum(n)
    shift = np.repeat(starts[wanted] - (ends - n), n)
    return values[shift + np.arange(len(shift))], ends


def encode(docs: DataFrame, spec: str, text: str = "text", out: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, or all) with ``out``, an array of int: the ids of each whole text.

    ``spec`` is the tokenizer's JSON. Null and empty texts have an empty array; an empty table gives an empty result. Special strings
    inside a text become their single ids, as the library does. Texts of any length; repeated rows are encoded alike; a
    column already named ``out`` is replaced, other names don't matter.
    """
    special = check_spec(spec)
    small_batches(docs.sparkSession)
    keep = [c for c in keep or docs.columns if c != out]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("doc"), F.col(text).alias("text"))
    # more shares than partitions, so that these are alike
    shares = min(1024, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    with scratch() as hold:
        whole, lists = blocks(rows, special, shares)
        # an entry for each share of a block
        found = word_ids(lists, spec).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("share", "counts", "ids"))).alias("found"))
        found = hold(durable(found, "block_ids"))
        hold(whole)
        discard(lists)
    joined = whole.drop("share", "words").join(found.hint("merge"), "block", "left")
    schema = T.StructType([T.StructField("doc", rows.schema["doc"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                found = batch.column("found")[row].as_py() or []
                counts = np.concatenate([np.zeros(0, np.int64), *(_numbers(x["counts"]).astype(np.int64) for x in found)])
                flat = np.concatenate([np.zeros(0, np.int32), *(_numbers(x["ids"]).view(np.int32) for x in found)])
                # from the order of shares to that of places
                order = np.argsort(_numbers(batch.column("shares")[row].as_py()), kind="stable")
                lengths, starts = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
                lengths[order], starts[order] = counts, np.cumsum(counts) - counts
                codes = _numbers(batch.column("codes")[row].as_py()).astype(np.int64)
                codes = np.where(codes == 0, np.cumsum(codes == 0) - 1, codes - 1)
                docs = batch.column("docs")[row].values
                n = np.cumsum([0, *batch.column("n")[row].as_py()])
                # some documents at a time
                part = n[1:] // WORDS_AT_A_TIME
                cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(docs)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    values, ends = ragged(flat, starts, lengths, codes[n[a] : n[b]])
                    at = np.concatenate([[0], ends])[n[a : b + 1] - n[a]].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([docs.slice(a, b - a), pa.ListArray.from_arrays(pa.array(at), pa.array(values))], ["doc", "ids"])

    ids = joined.select("docs", "n", "codes", "shares", "found").mapInArrow(run, schema)
    return ids.select("doc.*", F.col("ids").alias(out))


def pieces(spec: str) -> list[bytes]:
    """The bytes of each id; ids that the vocabulary leaves out have none."""
    j = json.loads(spec)
    alphabet = byte_of_char()
    table = [b""] * (max([*j["model"]["vocab"].values(), *(t["id"] for t in j["added_tokens"])]) + 1)
    for piece, i in j["model"]["vocab"].items():
        table[i] = bytes(alphabet[c] for c in piece)
    for t in j["added_tokens"]:
        table[t["id"]] = t["content"].encode()
    return table


def decode(docs: DataFrame, spec: str, ids: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, or all) with ``out``: the text of each array of ids, special tokens included.

    Bytes that form no character become U+FFFD. A null array gives an empty text.
    """
    check_spec(spec)
    table = pieces(spec)
    lengths = np.array([len(p) for p in table], np.int64)
    # as large as the vocabulary
    shared = docs.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(table), np.uint8), np.cumsum(lengths) - lengths, lengths))

    def make():
        bytes_, starts, sizes = shared.value

        def texts(batch):
            lists = batch.column(ids)
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy()[offsets[0] : offsets[-1]]
            joined, ends = ragged(bytes_, starts, sizes, values)
            joined, cuts = joined.tobytes(), np.concatenate([[0], ends])[offsets - offsets[0]].tolist()
            return [pa.array([joined[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)], pa.string())]

        return texts

    return map_texts(docs, ids, keep or docs.columns, make, [T.StructField(out, T.StringType())])
