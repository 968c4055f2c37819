"""BPE encoding and decoding over a distinct-word table.

Texts are cut into the vocabulary's pieces ("words").  Documents are first dealt into chunks of
about ``CHUNK_BYTES`` of text, stored in buckets by chunk so that no later step shuffles a text (chunks.py):

1. each chunk gives its distinct pieces, dealt by hash into parts and packed, one row for each part;
2. the rows of a part meet, and each distinct piece of the whole corpus is encoded once, in its part;
3. the ids go back to the chunks in the same packing, where every document takes the ids of its
   pieces by position; decoding goes through an id-to-piece table.

Nothing is broadcast or sent to the driver, and the same way is taken at every size: a task holds
one chunk with its pieces, or one part, of which there are ``PARTS`` for each shuffle partition.  A piece
that is in every chunk is one item of each chunk's list.

Cutting is vectorised over code points: classes of characters come from the library itself, asked
once for the basic plane, and a text with other characters or with control strings is cut by it.

Defined results: a null text counts as empty, an empty text has no ids; control strings of
the vocabulary found in a text become their own id, as the tokenizers library does it; repeated
rows and doc_ids are each handled as a row of its own; an empty table gives no rows; ties cannot
arise; extra columns are ignored.  A text longer than a chunk is a chunk.  Pieces of one chunk are told
apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame

from tallybook.llm import textkit
from tallybook.llm.chunks import CHUNK_BYTES, chunked

#: Parts of the distinct pieces for each shuffle partition.
PARTS = 4
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"
SPACE, LETTER, NUMBER, OTHER = range(4)
#: Endings that the vocabulary's published split pattern cuts off after an apostrophe (fixed values).
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


class Splitter:
    """Cuts texts into pieces as the vocabulary does; control strings are pieces of their own.

    The published pattern: an apostrophe with one of ``ENDINGS``; else a run of letters, of numbers
    or of other characters, each with one blank before it if there is one; else a run of white space,
    whose last character stands alone where something else follows."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.exact = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.whole = Tokenizer.from_file(path)
        self.whole.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.whole.encode_special_tokens = True
        self.classes = self._classes()

    def _classes(self) -> np.ndarray:
        """Class of every character of the basic plane: it goes on a run of its own class."""
        points = [c for c in range(1 << 16) if not 0xD800 <= c < 0xE000]
        out = np.full(1 << 16, SPACE, np.uint8)
        for kind, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            fresh = np.zeros(3 * len(points) + 1, bool)
            fresh[[a for _, (a, _) in self.exact.pre_tokenize_str("".join(f"{before}{chr(c)}\n" for c in points))]] = True
            out[np.array(points)[~fresh[1 : 3 * len(points) : 3]]] = kind
        return out

    def pieces(self, text: str) -> list[str]:
        """The pieces of one text, by the library's own pattern."""
        if self.cut is not None and any(x in text for x in self.special):
            out: list[str] = []
            for part in self.cut(text):
                if part in self.special:
                    out.append(part)
                elif part:
                    out += self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.exact.pre_tokenize_str(text)]

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece by itself; a control string has its own id."""
        found = [x.ids for x in self.whole.encode_batch(pieces, add_special_tokens=False)]
        for i, p in enumerate(pieces):
            if p in self.special:
                found[i] = [self.special[p]]
        return found

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Id-to-piece table: start and length of each id's bytes, and the bytes."""
        back = {c: b for b, c in byte_letters().items()}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        lengths, data = np.zeros(size, np.int64), []
        own = {v: k for k, v in self.special.items()}
        for i in range(size):
            token = self.tokenizer.id_to_token(i) or ""
            raw = own[i].encode() if i in own else bytes(back[c] for c in token)
            lengths[i] = len(raw)
            data.append(raw)
        return np.cumsum(lengths) - lengths, lengths, np.frombuffer(b"".join(data), np.uint8)


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the others for 256, 257 and so on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_SPLITTERS: dict[str, Splitter] = {}
_TABLES: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def splitter(path: str) -> Splitter:
    if path not in _SPLITTERS:
        _SPLITTERS[path] = Splitter(path)
    return _SPLITTERS[path]


def id_pieces(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if path not in _TABLES:
        _TABLES[path] = splitter(path).tables()
    return _TABLES[path]


class Pieces:
    """The pieces of a step of texts: code points, pieces' first places (``start``, with the end of
    all last), their 64-bit hashes, and the number of pieces of each text (``count``)."""

    def __init__(self, texts: pa.Array, own: Splitter):
        rows = [t or "" for t in texts.to_pylist()]
        joined = "".join(rows)
        self.codes = codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        ends = np.cumsum(sizes)
        heads = (ends - sizes)[sizes > 0]
        fresh = self._fresh(codes, heads, own.classes)
        odd = np.zeros(len(rows), bool)
        far = np.flatnonzero(codes >= 1 << 16)
        odd[np.searchsorted(ends, far, "right")] = True
        if any(x in joined for x in own.special):
            odd |= np.fromiter((any(x in t for x in own.special) for t in rows), bool, len(rows))
        for k in np.flatnonzero(odd):
            lengths = [len(p) for p in own.pieces(rows[k])]
            fresh[ends[k] - sizes[k] : ends[k]] = False
            fresh[ends[k] - sizes[k] + np.cumsum([0, *lengths[:-1]])] = True
        first = np.flatnonzero(fresh)
        self.start = np.append(first, len(codes))
        at = np.searchsorted(first, np.append(0, ends))
        self.count = np.diff(at)
        prefix = textkit.prefix_hash(codes.astype(np.uint64) + np.uint64(1))
        self.hash = textkit.range_hash(prefix, self.start[:-1], self.start[1:])

    @staticmethod
    def _fresh(codes: np.ndarray, heads: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Whether a piece starts at each code point; ``heads`` are the first ones of texts."""
        kind = classes[np.minimum(codes, 0xFFFF)]
        kind[codes >= 1 << 16] = OTHER
        return Pieces.begun(codes, heads, kind)

    @staticmethod
    def begun(codes: np.ndarray, heads: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Whether a piece starts at each code point, whose classes are ``kind``."""
        n = len(codes)
        fresh = np.ones(n, bool)
        if not n:
            return fresh
        fresh[1:] = kind[1:] != kind[:-1]
        opens = np.zeros(n + 4, bool)
        opens[heads] = opens[n:] = True
        fresh[heads] = True
        after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~opens[1:n]) + 1
        fresh[after - 1] = True
        fresh[after[codes[after - 1] == 32]] = False
        mark = np.flatnonzero((codes == 39) & fresh)
        padded = np.append(codes, np.zeros(3, np.uint32))
        for ending in ENDINGS:
            size = len(ending)
            fits = np.ones(len(mark), bool)
            for k, c in enumerate(ending, 1):
                fits &= (padded[mark + k] == ord(c)) & ~opens[mark + k]
            here = mark[fits]
            fresh[here + 1] = False
            beyond = here + size + 1
            fresh[beyond[beyond < n]] = True
        return fresh

    def texts(self, which: np.ndarray) -> pa.Array:
        """The chosen pieces as strings."""
        wide = 1 + (self.codes >= 0x80).astype(np.int64) + (self.codes >= 0x800) + (self.codes >= 0x10000)
        at = np.zeros(len(self.codes) + 1, np.int64)
        np.cumsum(wide, out=at[1:])
        raw = np.frombuffer(self.codes.tobytes().decode("utf-32-le").encode(), np.uint8)
        begin, end = at[self.start[which]], at[self.start[which + 1]]
        return textkit.binary_rows(raw[textkit.ragged(begin, end - begin)], end - begin).cast(pa.string())


def packed(sizes: np.ndarray, data: bytes) -> bytes:
    """Items of ``sizes`` bytes each, joined in ``data``, as one compressed string."""
    return zstandard.compress(np.uint32(len(sizes)).tobytes() + sizes.astype("<u4").tobytes() + data, 3)


def unpacked(whole: bytes) -> tuple[np.ndarray, bytes]:
    whole = zstandard.decompress(whole)
    n = 4 + 4 * int.from_bytes(whole[:4], "little")
    return np.frombuffer(whole[4:n], "<u4").astype(np.int64), whole[n:]


def by_group(hashes: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of pieces by group (hash modulo ``groups``), then as they are; the groups that have any, and where each begins."""
    group = (hashes % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    names, begin = np.unique(group[order], return_index=True)
    return order, names, np.append(begin, len(hashes))


def distinct_pieces(chunks: DataFrame, vocabulary: str, groups: int) -> DataFrame:
    """part, chunk, pieces: each chunk's distinct pieces in ``groups`` parts by hash, packed in the order of hashes."""

    def run(chunk: pa.Table) -> pa.Table:
        own, hashes, texts = splitter(vocabulary), [], []
        for batch in chunk.to_batches():
            for part in textkit.steps(batch, "text"):
                pieces = Pieces(part.column(part.schema.get_field_index("text")), own)
                h, first = np.unique(pieces.hash, return_index=True)
                hashes.append(h)
                texts.append(pieces.texts(first))
        known, first = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]), return_index=True)
        order, names, begin = by_group(known, groups)
        raw, at = textkit.bytes_of(pa.concat_arrays([pa.array([], pa.string()), *texts]).take(pa.array(first[order])))
        sizes, raw = np.diff(at), raw.tobytes()
        rows = [packed(sizes[a:b], raw[at[a] : at[b]]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
        name = chunk.column("chunk")[0].as_py()
        return pa.table([pa.array(names.astype(np.int32)), pa.array(np.full(len(names), name, np.int64)), pa.array(rows, pa.binary())], ["part", "chunk", "pieces"])

    return chunks.groupBy("chunk").applyInArrow(run, "part int, chunk long, pieces binary")


def encoded_pieces(pieces: DataFrame, vocabulary: str) -> DataFrame:
    """part, chunk, ids: the ids (little-endian unsigned 32 bit) of the packed pieces, packed likewise.  A piece
    has one part, whichever chunks it is in, and is encoded there once."""

    def run(rows: pa.Table) -> pa.Table:
        lists = [unpacked(x) for x in rows.column("pieces").to_pylist()]
        sizes = np.concatenate([x for x, _ in lists])
        every = textkit.binary_rows(np.frombuffer(b"".join(x for _, x in lists), np.uint8), sizes).cast(pa.string()).dictionary_encode()
        ids = splitter(vocabulary).encode(every.dictionary.to_pylist())
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), "<u4", int(n.sum()))
        starts, which = np.cumsum(n) - n, every.indices.to_numpy()
        out, at = [], 0
        for x, _ in lists:
            mine = which[at : at + len(x)]
            at += len(x)
            out.append(packed(4 * n[mine], flat[textkit.ragged(starts[mine], n[mine])].tobytes()))
        textkit.trim()
        return pa.table([rows.column("part"), rows.column("chunk"), pa.array(out, pa.binary())], ["part", "chunk", "ids"])

    return pieces.groupBy("part").applyInArrow(run, "part int, chunk long, ids binary")


def _finish(doc_ids: pa.Array, flat: np.ndarray, counts: np.ndarray, pieces: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """Rows from the ids of several documents, decoded through the id-to-piece table."""
    start, length, data = pieces
    raw = data[textkit.ragged(start[flat], length[flat])]
    ends = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=ends[1:])
    at = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(length[flat], out=at[1:])
    cuts, whole = at[ends], raw.tobytes()
    texts = [whole[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.RecordBatch.from_arrays([doc_ids.cast(pa.int64()), pa.array(counts), textkit.binary_rows(flat.astype("<u4"), counts), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])


def encode_documents(docs: DataFrame, vocabulary: str, finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str = SCHEMA, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its ids and the text decoded from them.

    ``finish`` may turn each batch of results into another (``schema``) within the same task.
    """
    chunks = chunked(docs, chunk_bytes).select("chunk", "doc_id", "text")
    groups = PARTS * textkit.shuffle_partitions(docs.sparkSession)
    coded = encoded_pieces(distinct_pieces(chunks, vocabulary, groups), vocabulary)
    then = finish or (lambda batch: batch)

    def assemble(rows: pa.Table, coded: pa.Table) -> pa.Table:
        own, back = splitter(vocabulary), id_pieces(vocabulary)
        steps = [part for batch in rows.to_batches() for part in textkit.steps(batch, "text")]
        cut = []
        for part in steps:
            pieces = Pieces(part.column(part.schema.get_field_index("text")), own)
            cut.append((pieces.hash, pieces.count))
        known, place = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in cut)]), return_inverse=True)
        order, names, _ = by_group(known, groups)
        by_part = dict(zip(coded.column("part").to_pylist(), coded.column("ids").to_pylist(), strict=True)) if coded.num_rows else {}
        lists = [unpacked(by_part[k]) for k in names.tolist()]
        sizes = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in lists)]) // 4
        if len(sizes) != len(known):
            raise ValueError("a chunk's pieces and their ids differ in number")
        table = np.frombuffer(b"".join(x for _, x in lists), "<u4")
        upto = np.append(0, np.cumsum(sizes))
        row = np.empty(len(known), np.int64)
        row[order] = np.arange(len(known))
        done, at = [], 0
        for part, (h, count) in zip(steps, cut, strict=True):
            which = row[place[at : at + len(h)]]
            at += len(h)
            n = upto[which + 1] - upto[which]
            flat = table[textkit.ragged(upto[which], n)]
            total = np.zeros(len(n) + 1, np.int64)
            np.cumsum(n, out=total[1:])
            ends = np.append(0, np.cumsum(count))
            done.append(then(_finish(part.column(part.schema.get_field_index("doc_id")), flat, np.diff(total[ends]), back)))
        out = pa.Table.from_batches(done)
        textkit.trim()
        return out

    return chunks.groupBy("chunk").cogroup(coded.groupBy("chunk")).applyInArrow(assemble, schema)


def digests(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The contract's digest columns of a batch of encode_documents."""
    ids = [hashlib.sha256(x or b"").hexdigest() for x in batch.column(2).to_pylist()]
    texts = [hashlib.sha256(x.encode()).hexdigest() for x in batch.column(3).to_pylist()]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids), pa.array(texts)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
