"""Packing by power-of-two decomposition.

A document's token ids (a tokenizer's ids, then an end id) are cut into pieces whose lengths are powers of two: as many of the
longest length as fit, then the binary digits of the rest, largest first. Every piece is a sequence of its own, so no sequence
crosses documents and none needs padding; sequences of one length are neighbours (a bucket) in the sequence order, as a
trainer that draws batches of one length wants them.

Cases: null text is empty text and gives one piece that holds the end id; an empty table gives no rows; rows that repeat a
doc_id are packed each for itself, a null doc_id stays null; other columns of the input are not read, whatever their names.
A very long text only gives more pieces. Ties in the order (equal length, doc_id, start) are broken by the ids' checksum, and
equal pieces of equal rows are interchangeable.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import cut, fresh, ranked, slices
from lodestrata.session import found_by_workers

END_ID = 1
MAX_LENGTH = 2048
#: Distinct words of a generation whose ids a Python worker keeps, twice that within one text.
CACHED_WORDS = 150_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The rules under which a text's ids are those of its words in turn (white space only divides, case is lowered).
WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "post_processor": None,
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
}
SUFFIX = WORD_RULES["model"]["end_of_word_suffix"]
#: Words of printable ASCII and Latin-1 letters, for which the split is the pattern below, on the lowered word.
SIMPLE = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
#: Stands for the end of a word in the byte vocabulary; no simple word has it.
WORD_END = "\0"


def byte_letters() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, other bytes for letters from U+0100 on."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in same]
    return {chr(b): b for b in same} | {chr(256 + i): b for i, b in enumerate(rest)}


def merges_follow_ids(model: dict, special: set[str]) -> bool:
    """Whether the merges make every token of more than one letter, one each, in the order of their ids: only then do ids alone tell what merges first."""
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab.get("".join(p)) for p in pairs]
    letters = {t for t in vocab if len(t.removesuffix(SUFFIX)) == 1}
    return None not in made and all(a < b for a, b in zip(made, made[1:])) and len(made) == len(vocab) - len(letters) - len(special & vocab.keys())


class WordIds:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes, through a cache of the ids of words.

    If the tokenizer's file has WORD_RULES, a text's ids are those of its words; simple words are split and go through the same merges
    as a byte vocabulary (tiktoken), all others through the tokenizer. Texts that hold one of its special strings, and all texts
    under other rules, go to the tokenizer whole. The cache has two generations: a full one becomes the old one, from which words
    that come again move to the new.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cached, self.known, self.old, self.merge = cached, {}, {}, None
        rules = json.loads(Path(path).read_text(encoding="utf-8"))
        # every rule counts: a file that differs in one of them is read whole
        own = {k: rules.get(k) for k in ("normalizer", "pre_tokenizer", "post_processor")} | {"model": {k: v for k, v in rules["model"].items() if k not in ("vocab", "merges")}}
        self.by_word = own == WORD_RULES and merges_follow_ids(rules["model"], set(self.special))
        if self.by_word:
            letters, special = byte_letters(), set(self.special)
            ranks = {}
            for token, n in rules["model"]["vocab"].items():
                if token not in special:
                    end = token.endswith(SUFFIX)
                    ranks[bytes(letters[c] for c in token.removesuffix(SUFFIX)) + WORD_END.encode() * end] = n
            self.merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def word(self, text: str) -> bytes:
        """The ids of a word that the new generation lacks."""
        if not text:
            return b""
        found = self.old.get(text)
        if found is None:
            if SIMPLE.fullmatch(text):
                merge = self.merge
                found = b"".join([array("I", merge(p + WORD_END)).tobytes() for p in SPLIT.findall(text.lower())])
            else:
                found = self.encode([text])[0]
        if len(self.known) < 2 * self.cached:
            self.known[text] = found
        return found

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            if not self.by_word or any(s in text for s in self.special):
                yield self.encode([text])[0]
                continue
            if len(self.known) > self.cached:
                self.old, self.known = self.known, {}
            kept, other = self.known.get, self.word
            yield b"".join([kept(w) or other(w) for w in text.replace("\n", " ").split(" ")])


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One for each worker process, so that the cache outlives a task."""
    return WordIds(path)


def cuts(tokens: int, longest: int = MAX_LENGTH) -> list[int]:
    """Lengths of the pieces of so many tokens."""
    out = [longest] * (tokens // longest)
    rest, bit = tokens % longest, longest >> 1
    while bit:
        if rest & bit:
            out.append(bit)
        bit >>= 1
    return out


def pieces(docs: DataFrame, tokenizer: str | None = None, longest: int = MAX_LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece; longest must be a power of two."""
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")
    path, end = tokenizer or default_tokenizer(), np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(path)
        for b in batches:
            for part in slices(b, "text"):
                row, rows = [], []
                for k, data in enumerate(ids([t or "" for t in part.column("text").to_pylist()])):
                    data += end
                    n, start = len(data) // 4, 0
                    for length in cuts(n, longest):
                        row.append(k)
                        rows.append((start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), n))
                        start += length
                made = np.asarray(rows, dtype=np.int64).reshape(-1, 4).T
                # taken in Arrow, so that an id beside a null stays exact
                columns = [part.column("doc_id").take(pa.array(row, pa.int64())), *[pa.array(m) for m in made]]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    found_by_workers(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str | None = None, longest: int = MAX_LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces with their sequence: sequence_id is the gapless rank by (length, longest first; doc_id; start), offset is 0."""
    found = cut(pieces(docs, tokenizer, longest, end_id))  # narrow rows; else the range bounds' sampling would tokenize all texts once more
    (down,) = fresh(found, "down")
    found = found.withColumn(down, -F.col("length"))
    return ranked(found, [down, "doc_id", "start", "ids_crc32"], "sequence_id").drop(down).withColumn("offset", F.lit(0).cast("long"))


def sequences(packed: DataFrame) -> DataFrame:
    """The buckets: how many sequences of each length there are, and their ids' range."""
    return packed.groupBy("length").agg(F.count("*").alias("n_sequences"), F.min("sequence_id").alias("first_id"), F.max("sequence_id").alias("last_id"))


__all__ = ["END_ID", "MAX_LENGTH", "WordIds", "cuts", "default_tokenizer", "pack", "pieces", "sequences"]
