"""Public tokenizers, and the encoding of a corpus by one of them.

A byte-level BPE splits text into pieces first and merges inside each piece, so a long unsplit
piece is one long merge. Such pieces are cut into leaves that are encoded in parallel and joined
pairwise in a tree, the blocks of a very long piece in tasks of their own: around each join a growing window of tokens is encoded again until its first
and its last token agree with the tokens that stand there already. A BPE's output is right if each
pair of neighbours is, so agreement at both ends makes the joined list equal to one long encoding.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.session import cut

TIKTOKEN = {"byte_bpe_50k": "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken"}
FILES = TIKTOKEN | {"piece_bpe_32k": "piece_bpe_32k.model", "word_bpe_49k": "word_bpe_49k.json"}
FOLDER = "/opt/tokenizers"
# Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces of more characters than this are encoded by tree concatenation.
UNSPLIT = 48
LEAF_BYTES = 16
#: Leaves of a piece that are joined in one task; a longer piece is joined in blocks first, and then its blocks.
BLOCK = 1024


@lru_cache(maxsize=None)
def tiktoken_encoding(name: str, folder: str = FOLDER):
    import tiktoken

    with open(os.path.join(folder, TIKTOKEN[name]), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=None)
def counter(name: str, folder: str = FOLDER) -> Callable[[list[str]], list[int]]:
    """Token counts of texts by a tokenizer, without special tokens; their strings are ordinary text."""
    if name in TIKTOKEN:
        encoding = tiktoken_encoding(name, folder)
        return lambda texts: [len(encoding.encode_to_numpy(t, disallowed_special=())) for t in texts]
    if name.endswith("_32k"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, FILES[name]))
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(os.path.join(folder, FILES[name]))
    model.encode_special_tokens = True
    return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]


def join_tokens(left: list[int], right: list[int], encode: Callable[[bytes], list[int]], decode: Callable[[list[int]], bytes]) -> list[int]:
    """The encoding of the bytes of left and right together, from their own encodings."""
    if not left or not right:
        return left + right
    wide = 2
    while True:
        a, b = max(0, len(left) - wide), min(len(right), wide)
        window = encode(decode(left[a:]) + decode(right[:b]))
        begins = a == 0 or window[0] == left[a]
        ends = b == len(right) or window[-1] == right[b - 1]
        if begins and ends:
            return left[:a] + window + right[b:]
        wide *= 2


def join_tree(leaves: list[list[int]], encode: Callable, decode: Callable) -> list[int]:
    """All leaves joined pairwise, level by level."""
    while len(leaves) > 1:
        pairs = [join_tokens(leaves[i], leaves[i + 1], encode, decode) for i in range(0, len(leaves) - 1, 2)]
        leaves = pairs + leaves[len(leaves) // 2 * 2 :]
    return leaves[0] if leaves else []


def _long(c: Column) -> Column:
    """Whether a text may have a piece of more than UNSPLIT characters: a cheap bound, as a piece is all space or, after one space, has none."""
    return (F.length(c) > UNSPLIT) & c.rlike(rf"\S{{{UNSPLIT}}}|\s{{{UNSPLIT}}}")


def encode(df: DataFrame, text: str, keys: list[str], tokenizer: str = "byte_bpe_50k", folder: str = FOLDER, out: str = "ids") -> DataFrame:
    """The columns `keys` and `out` (array<int>) for each row of df, without special tokens.

    A null or empty text gives the empty list; strings that look like special tokens are ordinary
    text; repeated rows are encoded each. Whole texts are encoded, however long.
    """
    rows = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("long", _long(F.col("t")))
    names = [f"k{i}" for i in range(len(keys))]
    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tiktoken_encoding(tokenizer, folder)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids = [encoding.encode_to_numpy(t, disallowed_special=()) for t in part.column(len(names)).to_pylist()]
                ends = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=ends[1:])
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], lists], [*names, "ids"])

    plain = rows.where(~F.col("long")).select(*names, "t").mapInArrow(direct, f"{schema}, ids array<int>")

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each piece of each long text: its place, and its bytes cut into leaves; how many blocks of leaves the piece has."""
        import regex

        split = regex.compile(PATTERN)
        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held: dict[str, list] = {"key": [], "piece": [], "leaf": [], "blocks": [], "data": []}
                for n, m in enumerate(split.finditer(t)):
                    data = m.group().encode()
                    size = LEAF_BYTES if len(m.group()) > UNSPLIT else len(data)
                    blocks = -(-len(data) // (size * BLOCK))
                    for k, at in enumerate(range(0, len(data), size)):
                        for name, x in zip(held, (key, n, k, blocks, data[at : at + size])):
                            held[name].append(x)
                kinds = (pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(held.values(), kinds)], list(held))

    def encode_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tiktoken_encoding(tokenizer, folder)
        for batch in batches:
            ids = [encoding._encode_single_piece(x) for x in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, pa.list_(pa.int32()))], ["key", "piece", "leaf", "blocks", "ids"])

    def join_block(table: pa.Table) -> pa.Table:
        """The leaves of a block as one: its number stands for theirs."""
        encoding = tiktoken_encoding(tokenizer, folder)
        byte = lambda ids: b"".join(map(encoding.decode_single_token_bytes, ids))
        leaf, ids = zip(*sorted(zip(table["leaf"].to_pylist(), table["ids"].to_pylist())))
        joined = join_tree(list(ids), encoding._encode_single_piece, byte)
        return pa.table([table["key"].slice(0, 1).combine_chunks(), table["piece"].slice(0, 1).combine_chunks(), pa.array([leaf[0] // BLOCK], pa.int32()), pa.array([joined], pa.list_(pa.int32()))], ["key", "piece", "leaf", "ids"])

    def join(table: pa.Table) -> pa.Table:
        encoding = tiktoken_encoding(tokenizer, folder)
        byte = lambda ids: b"".join(map(encoding.decode_single_token_bytes, ids))
        parts = sorted(zip(table["piece"].to_pylist(), table["leaf"].to_pylist(), table["ids"].to_pylist()))
        ids: list[int] = []
        at = 0
        while at < len(parts):
            end = at
            while end < len(parts) and parts[end][0] == parts[at][0]:
                end += 1
            ids += join_tree([p[2] for p in parts[at:end]], encoding._encode_single_piece, byte)
            at = end
        return pa.table([pa.array(table["key"].to_pylist()[:1], pa.binary()), pa.array([ids], pa.list_(pa.int32()))], ["key", "ids"])

    hard = cut(rows.where("long").withColumn("key", F.unhex(F.sha2("t", 256))))  # read twice below
    distinct = hard.select("key", "t").dropDuplicates(["key"])
    parts = distinct.mapInArrow(leaves, "key binary, piece int, leaf int, blocks int, data binary").repartition("key", F.floor(F.col("leaf") / BLOCK))
    encoded = cut(parts.mapInArrow(encode_leaves, "key binary, piece int, leaf int, blocks int, ids array<int>"))
    wide = encoded.where("blocks > 1").groupBy("key", "piece", F.floor(F.col("leaf") / BLOCK)).applyInArrow(join_block, "key binary, piece int, leaf int, ids array<int>")
    encoded = encoded.where("blocks = 1").select("key", "piece", "leaf", "ids").unionByName(wide)
    whole = encoded.groupBy("key").applyInArrow(join, "key binary, ids array<int>")
    rest = hard.select(*names, "key").join(whole, "key").select(*names, "ids")
    done = plain.unionByName(rest)
    return done.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], F.col("ids").alias(out))
