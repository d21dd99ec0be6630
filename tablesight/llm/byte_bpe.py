"""Byte-level BPE encoding and decoding (operator 5).

The vocabulary is a rank file: one line per token, base64 bytes and a rank.
Each byte is written as one printable character (the usual byte table of
byte-level BPE), the ranks become merges, and the ``tokenizers`` library runs
them.  The rank file is read once on the driver and shipped with the task: its
size does not depend on the data.

Texts are cut by the split pattern, and every distinct piece of a batch is
encoded once; a text's ids are the concatenation of its pieces' ids.  Decoding
goes from ids through the reversed byte table to bytes; a character split over
two tokens is whole again once their bytes stand side by side, and each token's
character span covers every character it holds a byte of.

Null text counts as empty: no ids, no offsets, empty bytes.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablesight.llm.common import map_texts, unused

#: Distinct pieces whose ids a task remembers, and the longest piece it keeps.
CACHE_PIECES, CACHE_CHARS = 1 << 18, 64

OUTPUTS = {
    "ids": T.ArrayType(T.IntegerType()),
    "starts": T.ArrayType(T.IntegerType()),
    "ends": T.ArrayType(T.IntegerType()),
    "decoded": T.BinaryType(),
    "n_tokens": T.LongType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where printable, else
    the next free code point from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(shown))
    return [table[b] for b in range(256)]


def merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts whose merge makes ``token``: what is left of it when only
    merges of lower rank are applied.  None if more than two parts are left."""
    parts = [token[i:i + 1] for i in range(len(token))]
    limit = ranks[token]
    while len(parts) > 2:
        best = min(range(len(parts) - 1),
                   key=lambda i: ranks.get(parts[i] + parts[i + 1], limit))
        if ranks.get(parts[best] + parts[best + 1], limit) >= limit:
            return None
        parts[best:best + 2] = [parts[best] + parts[best + 1]]
    return parts[0], parts[1]


def tokenizer_json(ranks: dict[bytes, int]) -> str:
    """The rank file as a ``tokenizers`` model over byte characters."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    shown = byte_characters()
    write = lambda token: "".join(shown[b] for b in token)
    ordered = sorted(ranks, key=ranks.__getitem__)
    pairs = [m for t in ordered if len(t) > 1 and (m := merge_of(t, ranks))]
    model = models.BPE(vocab={write(t): r for t, r in ranks.items()},
                       merges=[(write(a), write(b)) for a, b in pairs], ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return tokenizer.to_str()


class PieceEncoder:
    """Ids of texts as little-endian 32-bit bytes; one per task."""

    def __init__(self, model: str, pattern: str):
        import os

        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism

        self.split = regex.compile(pattern).findall
        self.tokenizer = Tokenizer.from_str(model)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        pieces = [self.split(t) if t else [] for t in texts]
        new = list(set().union(*pieces).difference(self.known))
        if len(self.known) + len(new) > CACHE_PIECES and self.known:
            self.known = {}
            new = list(set().union(*pieces))
        known = self.known
        for i in range(0, len(new), 8192):
            part = new[i:i + 8192]
            for piece, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                known[piece] = np.array(e.ids, "<u4").tobytes()
        out = [b"".join([known[p] for p in row]) for row in pieces]
        for piece in [p for p in new if len(p) > CACHE_CHARS]:
            del known[piece]
        return out


def token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    """Token id -> bytes, by undoing the byte characters of the vocabulary."""
    back = {c: b for b, c in enumerate(byte_characters())}
    shown = byte_characters()
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = bytes(back[c] for c in "".join(shown[b] for b in token))
    return table


def decode_ids(ids: list[int], table: list[bytes]) -> bytes:
    return b"".join([table[i] for i in ids])


def character_spans(data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code-point span [start, end) of each token from the tokens' byte lengths."""
    if not len(lengths):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    leads = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    char_of = np.cumsum(leads) - 1
    stops = np.cumsum(lengths)
    return (char_of[stops - lengths].astype(np.int32), (char_of[stops - 1] + 1).astype(np.int32))


def encode_documents(df: DataFrame, vocabulary: str, pattern: str, text_col: str = "text",
                     outputs: tuple[str, ...] = ("ids", "starts", "ends"),
                     keep: list[str] | None = None) -> DataFrame:
    """Encode whole texts and add any of the columns named in OUTPUTS.

    ``ids`` with their character spans ``starts``/``ends``; ``decoded``, the
    bytes the ids decode to; ``n_tokens``; and the SHA-256 digests of the ids
    (little-endian unsigned 32-bit) and of the decoded bytes.  Rows pass
    through, so an empty table gives an empty table and repeated rows repeat.
    """
    ranks = read_ranks(vocabulary)
    model, table = tokenizer_json(ranks), token_bytes(ranks)
    want = tuple(outputs)
    decodes = {"decoded", "decoded_sha256", "starts", "ends"} & set(want)

    def make():
        encoder = PieceEncoder(model, pattern)
        sizes = np.array([len(b) for b in table], np.int64)

        def work(texts):
            columns = {c: [] for c in want}
            for raw in encoder.encode(texts):
                ids = np.frombuffer(raw, "<u4")
                data = decode_ids(ids.tolist(), table) if decodes else b""
                if "starts" in columns or "ends" in columns:
                    starts, ends = character_spans(data, sizes[ids])
                for c in want:
                    if c == "ids":
                        value = ids.astype(np.int32)
                    elif c == "starts":
                        value = starts
                    elif c == "ends":
                        value = ends
                    elif c == "decoded":
                        value = data
                    elif c == "n_tokens":
                        value = len(ids)
                    elif c == "ids_sha256":
                        value = hashlib.sha256(raw).hexdigest()
                    else:
                        value = hashlib.sha256(data).hexdigest()
                    columns[c].append(value)
            return [columns[c] for c in want]

        return work

    fields = T.StructType([T.StructField(c, OUTPUTS[c]) for c in want])
    return map_texts(df, text_col, fields, make, df.columns if keep is None else keep)


def decode_documents(df: DataFrame, vocabulary: str, ids_col: str = "ids",
                     out: str = "text") -> DataFrame:
    """Turn an ids column back into text (null ids: null; bytes that are not
    UTF-8, as in a cut id list, become U+FFFD)."""
    import pyarrow as pa

    table = token_bytes(read_ranks(vocabulary))
    keep = [c for c in df.columns if c.lower() != out.lower()]
    held = unused([*keep, out], "__ids")
    source = df.select(*[df[c] for c in keep], df[ids_col].alias(held))
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField(out, T.StringType())])

    def run(batches):
        for batch in batches:
            texts = [None if ids is None else decode_ids(ids, table).decode("utf-8", "replace")
                     for ids in batch.column(held).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(texts, pa.string())],
                names=keep + [out])

    return source.mapInArrow(run, schema)
