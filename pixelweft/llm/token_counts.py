"""Token counts with a whole-token shortcut.

The vocabulary is a piece BPE without a normaliser. No piece holds a space mark after another
character, so no merge crosses from a word into the space before the next word: a text falls into
pre-tokens, each a run of space marks and the characters after it, that can be counted alone.
Which vocabulary strings encode alone as exactly one token is proved once, from the vocabulary
itself. Pre-tokens found among these count one; only the rest are merged.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pixelweft.llm.common import map_texts

SPACE = "▁"
PRETOKEN = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Merged pre-tokens that a task remembers, and the length up to which it does.
MEMORY, LONGEST = 150_000, 48


def load(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def check_model(sp) -> None:
    """Raise if the model breaks what the split into pre-tokens rests on."""
    if sp.encode("a  b") == sp.encode("a b") or sp.decode(sp.encode("ﬁ Å")) != "ﬁ Å":
        raise ValueError("the model normalises its input; pre-tokens can't be cut from the raw text")
    for i in range(sp.get_piece_size()):
        if re.search(f"[^{SPACE}]{SPACE}", sp.id_to_piece(i)):
            raise ValueError(f"piece {i} joins two words")


def whole_tokens(sp) -> dict[str, int]:
    """Pre-tokens, without their first space mark, that encode alone as one token: exactly the
    vocabulary strings of that shape for which the model itself returns their own id."""
    proved = {}
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if PRETOKEN.fullmatch(piece) and not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            key = piece[1:].replace(SPACE, " ")
            if key and sp.encode(key) == [i]:
                proved[key] = 1
    return proved


class Counts(dict):
    """Pre-token to its number of tokens; holds the proved ones and a bounded number of others."""

    def __init__(self, sp, proved: dict[str, int]):
        super().__init__(proved)
        self.sp, self.left = sp, MEMORY
        # A lone space mark at the end of a text: "a " less "a".
        self[""] = len(sp.encode("a ")) - len(sp.encode("a"))

    def __missing__(self, key: str) -> int:
        n = len(self.sp.encode(key))
        if self.left and len(key) <= LONGEST:
            self[key] = n
            self.left -= 1
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
            parts = [m[1:].replace(SPACE, " ") for m in PRETOKEN.findall(SPACE + text.replace(" ", SPACE))]
        else:
            parts = text.split(" ")
        return sum(map(self.__getitem__, parts))


def token_counts(docs: DataFrame, model: bytes, text: str = "text", out: str = "n_tokens", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, or all) with the number of tokens of each whole text in ``out``.

    ``model`` holds the bytes of a sentencepiece model (about half a megabyte) and travels with
    the function. Null and empty texts have 0 tokens. Texts of any length are counted whole; rows
    that repeat are counted alike. No shuffle. Other columns pass through, whatever their names;
    a column already named ``out`` is replaced.
    """
    sp = load(model)
    check_model(sp)
    proved = whole_tokens(sp)  # once; as large as the vocabulary, it travels with the function

    def make():
        counts = Counts(load(model), proved)
        return lambda piece: [pa.array([counts.count(t) for t in piece.column(text).to_pylist()], pa.int64())]

    return map_texts(docs, text, keep or docs.columns, make, [T.StructField(out, T.LongType())])
