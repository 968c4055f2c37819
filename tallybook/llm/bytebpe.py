"""Byte-level BPE from a rank file, by the tokenizers library over Arrow batches.

A rank file lists tokens as bytes with their ids; the lower id is merged first.  ``Ranks`` makes a
tokenizer of the library out of it: every byte gets a printable stand-in character, each token of several
bytes gets the one pair of tokens that it is merged from, and a piece that is itself a token is
taken whole.  In each Arrow batch

1. texts are cut into the matches of the split pattern, over code points (``bpe.Pieces.begun``); classes
   of characters come from the library's own run of the pattern, asked for 4,096 code points at a time;
2. the batch's distinct pieces go through the library once, and every document takes the ids of its pieces;
3. offsets: a token's byte length is in the id table, so the running sum of lengths gives each token's
   first byte, and the characters begun before it its first character.

Decoding reverses the byte table.  Tokens may split a character: ``decode`` joins bytes before it
reads characters, and ``token_texts`` gives a split character to the token that completes it.

No row leaves its task: there is no shuffle, whatever is frequent, and a lost executor repeats its own
batches.  A task holds one batch (``textkit.small_batches``, one document at least) with its ids.

Defined results: a null text counts as empty, an empty text has no ids; a text that looks like a control
string is ordinary text; a very long text is encoded whole; repeated rows and doc_ids are each a row
of their own; null doc_ids stay; an empty table gives no rows; ties in a merge go to the leftmost
pair; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallybook.llm import textkit
from tallybook.llm.bpe import LETTER, NUMBER, OTHER, SPACE, Pieces, byte_letters

SCHEMA = "doc_id long, n_tokens long, ids binary, starts binary, n_split long, decoded binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long"
DECODED = "doc_id long, raw binary, text string"
#: Code points whose classes are asked for together.
BLOCK_BITS = 12


def halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two tokens that ``token`` is merged from: what is left when only lower ranks may merge.
    None if more than two are left, since then no merge ever makes the token."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, ranks[token]), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= ranks[token]:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


class Ranks:
    """The library's tokenizer of a rank file, its classes of characters and its id table."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        letter = byte_letters()
        spell = lambda token: "".join(letter[b] for b in token)
        pairs = (halves(t, ranks) for t in sorted((t for t in ranks if len(t) > 1), key=ranks.__getitem__))
        merges = [(spell(a), spell(b)) for a, b in filter(None, pairs)]
        self.tokenizer = Tokenizer(models.BPE({spell(t): i for t, i in ranks.items()}, merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.split = pre_tokenizers.Split(Regex(pattern), "isolated")
        self.classes = np.zeros(0x110000, np.uint8)
        self.asked = np.zeros(0x110000 >> BLOCK_BITS, bool)
        back = {c: b for b, c in letter.items()}
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        tokens = sorted(ranks.values())
        raw = {i: bytes(back[c] for c in self.tokenizer.id_to_token(i)) for i in tokens}
        self.length[tokens] = [len(raw[i]) for i in tokens]
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(raw[i] for i in tokens), np.uint8)

    def kinds(self, codes: np.ndarray) -> np.ndarray:
        """Class of each code point: it goes on a run of its own class."""
        for block in np.flatnonzero(np.bincount(codes >> BLOCK_BITS, minlength=len(self.asked)).astype(bool) & ~self.asked):
            points = [c for c in range(block << BLOCK_BITS, block + 1 << BLOCK_BITS) if not 0xD800 <= c < 0xE000]
            self.classes[points] = SPACE
            for kind, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
                fresh = np.zeros(3 * len(points) + 1, bool)
                fresh[[a for _, (a, _) in self.split.pre_tokenize_str("".join(f"{before}{chr(c)}\n" for c in points))]] = True
                self.classes[np.array(points)[~fresh[1 : 3 * len(points) : 3]]] = kind
            self.asked[block] = True
        return self.classes[codes]

    def pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of a step of texts, one after the other, and how many each text has."""
        raw, at = textkit.bytes_of(texts)
        lead = (raw & 0xC0) != 0x80
        codes = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4").astype(np.int64)
        place = np.append(np.flatnonzero(lead), len(raw))
        heads = np.searchsorted(place, at)
        fresh = Pieces.begun(codes, heads[:-1][np.diff(heads) > 0], self.kinds(codes))
        first = np.flatnonzero(fresh)
        offsets = np.append(place[first], len(raw)).astype(np.int32)
        found = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(raw.tobytes())])
        return found, np.diff(np.searchsorted(first, heads))

    def encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each piece, joined, and how many each has."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counts, ids = np.zeros(len(pieces), np.int64), []
        for a in range(0, len(pieces), 1 << 14):
            found = [x.ids for x in self.tokenizer.encode_batch_fast(pieces[a : a + (1 << 14)].to_pylist(), add_special_tokens=False)]
            counts[a : a + len(found)] = [len(x) for x in found]
            ids.append(np.fromiter((i for x in found for i in x), np.uint32))
        return np.concatenate([np.zeros(0, np.uint32), *ids]), counts

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ``ids``, joined, and where each id's begin (with the end of all last)."""
        if len(ids) and (int(ids.max()) >= len(self.length) or not self.length[ids].all()):
            raise ValueError("an id that the rank file does not have")
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.length[ids], out=ends[1:])
        return self.data[textkit.ragged(self.start[ids], self.length[ids])], ends


def token_texts(own: Ranks, ids: np.ndarray) -> list[str]:
    """Text of each token; a character split over tokens belongs to the one that completes it."""
    raw, ends = own.decode(ids)
    lead = np.append(np.maximum.accumulate(np.where((raw & 0xC0) != 0x80, np.arange(len(raw)), 0)), len(raw))
    cuts, whole = lead[ends], raw.tobytes()
    return [whole[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_KNOWN: dict[tuple[str, str], Ranks] = {}


def known(path: str, pattern: str) -> Ranks:
    if (path, pattern) not in _KNOWN:
        _KNOWN[path, pattern] = Ranks(path, pattern)
    return _KNOWN[path, pattern]


def _rows(own: Ranks, doc_ids: pa.Array, flat: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Rows of SCHEMA from the ids of several documents."""
    raw, at = own.decode(flat)
    first = np.append(0, np.cumsum(counts))
    sizes = np.diff(at[first])
    begun = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
    inside = np.append((raw & 0xC0) == 0x80, False)[at[:-1]]
    split = np.diff(np.append(0, np.cumsum(inside))[first])
    # a token that begins inside a character starts where that character does
    starts = begun[at[:-1]] - inside - np.repeat(begun[at[first[:-1]]], counts)
    columns = [doc_ids.cast(pa.int64()), pa.array(counts), textkit.binary_rows(flat.astype("<u4"), counts), textkit.binary_rows(starts.astype("<u4"), counts), pa.array(split), textkit.binary_rows(raw, sizes)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "starts", "n_split", "decoded"])


def encode(docs: DataFrame, path: str, pattern: str, finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str = SCHEMA) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): its ids and their first characters (little-endian unsigned
    32 bit), how many tokens begin inside a character, and the bytes decoded from the ids.

    ``finish`` may turn each batch of results into another (``schema``) within the same task."""
    then = finish or (lambda batch: batch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = known(path, pattern)
        for batch in batches:
            steps = list(textkit.steps(batch, "text"))
            cut = [own.pieces(part.column(1)) for part in steps]
            every = pa.concat_arrays([pa.array([], pa.string()), *(pieces for pieces, _ in cut)]).dictionary_encode()
            table, sizes = own.encode(every.dictionary)
            upto, which, at = np.append(0, np.cumsum(sizes)), every.indices.to_numpy(), 0
            for part, (pieces, count) in zip(steps, cut, strict=True):
                mine = which[at : at + len(pieces)]
                at += len(pieces)
                flat = table[textkit.ragged(upto[mine], sizes[mine])]
                ends = np.append(0, np.cumsum(sizes[mine]))[np.append(0, np.cumsum(count))]
                yield then(_rows(own, part.column(0), flat, np.diff(ends)))

    return docs.select("doc_id", "text").mapInArrow(textkit.tidy(run), schema)


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Every row of ``coded`` (doc_id, ids): the bytes of its ids, and their text; bytes that are no
    characters become U+FFFD.  Null ids count as none; an id that the rank file lacks is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = known(path, pattern)
        for batch in batches:
            raw = [own.decode(np.frombuffer(ids or b"", "<u4"))[0].tobytes() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(raw, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())], ["doc_id", "raw", "text"])

    return coded.select("doc_id", "ids").mapInArrow(textkit.tidy(run), DECODED)


def digests(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The contract's digest columns of a batch of ``encode``."""
    hashed = [pa.array([hashlib.sha256(x or b"").hexdigest() for x in batch.column(k).to_pylist()], pa.string()) for k in (2, 5)]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *hashed, batch.column(4)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_split"])
