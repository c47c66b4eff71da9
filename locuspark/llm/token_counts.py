"""Token counts and ids of whole texts, by word.

The tokenizer's normaliser and pre-tokeniser never join anything across ASCII white space, so a text's ids are those of
its white-space-separated chunks, one after the other. Counting is a map-side lookup in two tiers: a compact table of
frequent chunks, broadcast once, and each worker's own cache, which encodes what the table lacks. Nothing is shuffled.
"""

from __future__ import annotations

import json
import os
import re
import string
from collections import Counter
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuspark.llm.common import as_bytes

#: Entries of the broadcast table, documents and their bytes looked at to choose them (they decide speed only, never a
#: count), and entries of a worker's cache before its older half is let go.
TABLE, TABLE_DOCS, SAMPLE_BYTES, CACHE = 1 << 16, 4000, 16_000, 250_000
#: Longer chunks are encoded each time, so the cache's bytes are bounded too.
LONGEST_KEPT = 64
#: Bytes of text that are split into chunks at a time.
SLICE = 1 << 20

#: Letters beyond ASCII whose normal form and lower case are the same by any library.
_LATIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_PUNCTUATION = string.punctuation.encode()


#: The rules that chunks are taken apart by: a file with others is refused.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PIECES = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


def check_rules(path: str) -> None:
    """Raise a ValueError unless the file's normaliser and pre-tokeniser are those that ChunkEncoder relies on."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    one, two = rules.get("normalizer") or {}, rules.get("pre_tokenizer") or {}
    spaced = any(" " in t["content"] or t["lstrip"] or t["rstrip"] for t in rules.get("added_tokens", []))
    if one.get("normalizers") != _NORMALIZERS or _PIECES not in two.get("pretokenizers", [])[:1] or spaced:
        raise ValueError(f"{path} does not split text by the rules known here")


class ChunkEncoder:
    """What a chunk comes to, cached: its ids, packed as little-endian unsigned 32-bit integers, or how many there are.

    first: chunks with known values, never let go.
    """

    def __init__(self, path: str, lengths: bool = False, first: dict | None = None, limit: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers

        check_rules(path)
        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.tokenizer, self.plain):
            t.no_truncation()
            t.no_padding()
        self.plain.normalizer = normalizers.Sequence([])  # for parts, which are in their normal form
        vocabulary, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # the ids of tokens that end words, if the model has such
        self.ends[[i for w, i in vocabulary.items() if suffix and w.endswith(suffix)]] = True
        self.lengths, self.first, self.limit = lengths, first or {}, limit
        self.chunks, self.parts, self.old, self.old_parts = dict(self.first), {}, {}, {}
        self.none = 0 if lengths else b""

    def encode(self, text: str) -> bytes | int:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return len(ids) if self.lengths else np.asarray(ids, "<u4").tobytes()

    def _encode_parts(self, parts: list[bytes]) -> None:
        """Each part is one pre-token, so joined by spaces they are encoded in one call.

        A part's last token, and no other, is one that ends words. Where a part lacks it, its tokens are found by their words.
        """
        for i in range(0, len(parts), 2048):
            block = parts[i : i + 2048]
            text = b" ".join(block).decode()
            ids = np.asarray(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(block) or cut[-1] != len(ids):
                found = self.tokenizer.encode(text, add_special_tokens=False)
                ids, cut = np.asarray(found.ids, "<u4"), np.searchsorted(np.asarray(found.word_ids, np.int64), np.arange(1, len(block) + 1))
            if self.lengths:
                self.parts.update(zip(block, np.diff(cut, prepend=0).tolist()))
            else:
                raw, cut = ids.tobytes(), [0, *(4 * cut).tolist()]
                self.parts.update(zip(block, [raw[a:b] for a, b in zip(cut, cut[1:])]))

    def _learn(self, new: set[bytes]) -> None:
        """Chunks that are letters, then punctuation, are one or two pre-tokens; the rest is encoded as it stands."""
        chunks, old = self.chunks, self.old_parts
        if len(self.parts) > self.limit:
            self.old_parts, self.parts = self.parts, {}
            old = self.old_parts
        parts = self.parts
        letters = [c for c in new if c.isalpha()]  # of ASCII: one pre-token
        keys, split, heads, tails = [c.lower() for c in letters], [], [], []
        for c in new.difference(letters):
            core = c.rstrip(_PUNCTUATION)
            if core.isalpha() or not core:
                heads.append(core.lower())
            elif _LATIN.fullmatch(core):
                heads.append(core.decode().lower().encode())
            else:
                chunks[c] = self.encode(c.decode())
                continue
            split.append(c)
            tails.append(c[len(core) :])
        parts[b""] = self.none
        wanted = set(keys).union(heads, tails).difference(parts)
        if old:
            unknown = wanted.difference(old)
            wanted -= unknown
            parts.update(zip(wanted, map(old.__getitem__, wanted)))
            wanted = unknown
        self._encode_parts(list(wanted))
        value = parts.__getitem__
        chunks.update(zip(letters, map(value, keys)))
        chunks.update(zip(split, map(add, map(value, heads), map(value, tails))))

    def values(self, texts: list[bytes]) -> Iterator[bytes | int]:
        """The value of each text: its chunks' values together."""
        total = sum if self.lengths else b"".join
        for block in slices(texts):
            words = [t.split() for t in block]
            if len(self.chunks) > self.limit + len(self.first):  # chunks that are still in use come over from the old ones
                self.old, self.chunks = self.chunks, dict(self.first)
            known, old = self.chunks, self.old
            new = set().union(*words).difference(known)
            if old:
                unknown = new.difference(old)
                new -= unknown
                known.update(zip(new, map(old.__getitem__, new)))
                new = unknown
            large = {w: self.encode(w.decode()) for w in new if len(w) > LONGEST_KEPT}
            new.difference_update(large)
            if new:
                self._learn(new)
            for ws in words:
                yield total(map(known.__getitem__, ws)) if not large else total([large[w] if w in large else known[w] for w in ws])


def slices(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Consecutive texts of about SLICE bytes together."""
    block, n = [], 0
    for t in texts:
        block.append(t)
        n += len(t)
        if n >= SLICE:
            yield block
            block, n = [], 0
    if block:
        yield block


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """This worker's encoder to ids."""
    key = (path, "ids")
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path)
    return _ENCODERS[key]


def frequent_chunks(docs: DataFrame, size: int = TABLE, sample_docs: int = TABLE_DOCS) -> list[bytes]:
    """The chunks most frequent in up to sample_docs documents of at most SAMPLE_BYTES: what is worth a place in the table.

    Null and empty texts have none, an empty table gives none; of equally frequent chunks those seen first go in.

    Spark takes these rows from as few partitions as hold them; no other task runs.
    """
    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(8)) == 0).where(F.octet_length("text") <= SAMPLE_BYTES)
    counts: Counter[bytes] = Counter()
    for (text,) in some.limit(sample_docs).collect():
        counts.update(w for w in text.encode().split() if len(w) <= LONGEST_KEPT)
    return [w for w, _ in counts.most_common(size)]


def length_table(path: str, chunks: list[bytes]) -> tuple[bytes, bytes]:
    """The first tier, compact: keys joined by spaces, which no chunk holds, and their lengths in tokens."""
    sizes = list(ChunkEncoder(path, lengths=True).values(chunks))
    return b" ".join(chunks), np.asarray(sizes, np.uint16).tobytes()


def token_counts(docs: DataFrame, path: str, limit: int = 2048, table: int = TABLE) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs (doc_id, text; other columns take no part).

    A null or empty text has 0 bytes and 0 tokens; a null doc_id stays null; repeated rows are counted each; an empty
    table gives none. Counts are exactly the library's for the file at path, without added special tokens; a file whose rules
    differ from those known here is refused.
    """
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(length_table(path, frequent_chunks(docs, table)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes = shared.value
        tier = (path, hash(keys))
        if tier not in _ENCODERS:
            for old in [k for k in _ENCODERS if k[1] != "ids"]:  # of an earlier job
                del _ENCODERS[old]
            _ENCODERS[tier] = ChunkEncoder(path, lengths=True, first=dict(zip(keys.split(), np.frombuffer(sizes, np.uint16).tolist())))
        lengths = _ENCODERS[tier]
        for batch in batches:
            texts = as_bytes(batch.column(1))
            n = np.fromiter(lengths.values(texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
