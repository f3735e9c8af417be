"""Packing token sequences: first-fit decreasing over a tournament tree, in randomised groups."""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import MEMORIES, begin, bounded, end, pieces, text_of

LENGTH = 4096
END_ID = 2
#: Documents of one randomised group, on average. A group is one task's unit of memory.
GROUP_DOCS = 2048
#: Gaps of fewer tokens are padded, not filled by cutting another document.
LEAST_CUT = 16
#: Bytes of a text: gaps between chunks (3), letters and digits (1), marks (2), which are never in a token with letters or digits, any other (0).
KINDS = bytes(3 if c in b" \n" else 0 if c in b"'\x7f" or c < 32 else 1 if c >= 128 or chr(c).isalnum() else 2 for c in range(256))
GAPS = b" \n"
LOWER = bytes(range(256)).lower()
#: Chunks of text whose ids a worker remembers; then it starts anew.
REMEMBER = 500_000
#: Bytes of text that are taken apart at once, or one text if it is longer.
BYTES = 4 << 20


def slices(texts: pa.StringArray, most: int) -> Iterator[pa.StringArray]:
    """Slices of at most `most` bytes each, one text at least."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield texts.slice(at, end - at)
        at = end


@cache
def chunk_encoder(path: str, end_id: int, remember: int = REMEMBER):
    """A function from texts (a list or an Arrow column) to the bytes of their ids, end_id appended, and the ids' numpy kind.

    The tokenizer splits at white space before anything else, so a text's ids are those of its chunks
    between spaces and line feeds, one after the other. Chunks repeat, so a bounded memory of their ids
    saves most of the work. Chunks are found in the bytes of many texts at once and told apart by Arrow's dictionary, so
    Python sees each chunk once in BYTES of text. Where the vocabulary lower-cases and marks word ends, texts
    of letters below U+0100 are lower-cased and marks next to letters or digits set apart first, as the tokenizer would; new words are
    then encoded many at a time and the marks tell their ids apart. Any other new chunk is encoded alone. Tests compare with whole
    texts. Special tokens inside texts count as the tokenizer counts them: a text that has one in any case is left as it is.
    A worker keeps the function and its memory from task to task, until a task of another operator begins.
    """
    from tokenizers import Tokenizer
    from tokenizers.normalizers import Sequence

    tokenizer = Tokenizer.from_file(path)
    size = tokenizer.get_vocab_size(with_added_tokens=True)
    kind = np.uint16 if max(size, end_id + 1) <= 1 << 16 else np.uint32
    ends = np.zeros(size, bool)
    ends[[i for token, i in tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith("</w>")]] = True
    lower = [x["type"] for x in (json.loads(tokenizer.to_str())["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
    by_word = lower and bool(ends.any())
    special = [t.content.encode().translate(LOWER) for t in tokenizer.get_added_tokens_decoder().values()]
    if by_word:  # for letters below U+0100, whose normal form is their lower case
        plain = Tokenizer.from_str(tokenizer.to_str())
        plain.normalizer = Sequence([])
    known: dict[str, bytes] = {}
    last = kind(end_id).tobytes()
    width = np.dtype(kind).itemsize

    def alone(chunks: list[str]) -> None:
        for at in range(0, len(chunks), 8192):
            some = chunks[at : at + 8192]
            for chunk, e in zip(some, tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[chunk] = np.array(e.ids, kind).tobytes()

    def together(words: list[str]) -> None:
        for at in range(0, len(words), 512):
            some = words[at : at + 512]
            ids = np.array(plain.encode_batch_fast([" ".join(some).lower()], add_special_tokens=False)[0].ids)
            stops = np.flatnonzero(ends[ids]) + 1
            if len(stops) != len(some):
                alone(some)
                continue
            data, start = ids.astype(kind).tobytes(), 0
            for word, stop in zip(some, (stops * width).tolist(), strict=True):
                known[word] = data[start:stop]
                start = stop

    def learn(chunks) -> None:
        words, odd = [], []
        for chunk in chunks:
            (words if by_word and chunk.isalpha() and latin(chunk) else odd).append(chunk)
        alone(odd)
        together(words)

    def latin(text: str) -> bool:
        """Letters below U+0100 are normalised already and have plain lower-case forms."""
        if text.isascii():
            return True
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def left(raw: bytes, at: np.ndarray) -> np.ndarray:
        """Which of the texts raw[at[k]:at[k + 1]] stay as they are: those with letters from U+0100 on or a special token."""
        found = [np.flatnonzero(np.frombuffer(raw, np.uint8) >= 0xC4)]
        low = raw.translate(LOWER)
        for token in special:
            some, k = [], low.find(token)
            while k >= 0:
                some.append(k)
                k = low.find(token, k + 1)
            found.append(np.array(some, np.int64))
        out = np.zeros(len(at) - 1, bool)
        out[np.searchsorted(at, np.concatenate(found), "right") - 1] = True
        return out

    def chunks_of(raw: bytes, at: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
        """The chunks of the texts raw[at[k]:at[k + 1]] without gaps, and how many come before each text's start and the end."""
        kinds = np.frombuffer(bytearray(raw.translate(KINDS)), np.uint8)
        data = np.frombuffer(bytearray(raw.translate(LOWER if by_word else None, GAPS)), np.uint8)
        keep = kinds != 3
        if by_word:
            as_is = left(raw, at)
            two = np.flatnonzero(np.frombuffer(raw, np.uint8) >> 1 == 0xC2 >> 1)  # 0xC2 or 0xC3: letters below U+0100 have two bytes
            if len(two):
                lead, next_ = (np.frombuffer(raw, np.uint8)[two + k] for k in (0, 1))
                other = two[(lead == 0xC2) | (next_ == 0x97) | (next_ == 0xB7)]  # signs, and a few letters: never set apart
                kinds[other] = kinds[other + 1] = 0
                upper = np.zeros(len(raw), bool)
                upper[two[(lead == 0xC3) & (next_ <= 0x9E) & (next_ != 0x97)] + 1] = True
                data[upper[keep]] += 0x20
            if as_is.any():
                whole = np.repeat(as_is, np.diff(at))
                kinds[whole & keep] = 0
                data = np.where(whole[keep], np.frombuffer(raw.translate(None, GAPS), np.uint8), data)
        else:
            kinds[keep] = 0
        first = np.empty(len(raw), bool)
        first[1:] = kinds[:-1] == 3
        first[1:] |= kinds[:-1] ^ kinds[1:] == 3  # a letter or digit and a mark, or a gap
        own = at[:-1][np.diff(at) > 0]
        first[own] = True
        first &= keep
        offsets = np.append(np.flatnonzero(first[keep]), len(data)).astype(np.int32)
        chunks = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))
        return chunks, np.searchsorted(np.flatnonzero(first), at)

    def some(texts: pa.StringArray) -> list[bytes]:
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = texts.buffers()[2]
        chunks, bounds = chunks_of(data[at[0] : at[-1]].to_pybytes() if data else b"", at - at[0])
        coded = chunks.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(known) > remember:
            known.clear()
        learn([w for w in words if w not in known])
        ids = pa.array([*map(known.__getitem__, words), last], pa.binary())
        order = np.insert(coded.indices.to_numpy(), bounds[1:], len(words))  # end_id after each text's chunks
        flat = ids.take(pa.array(order))
        stops = np.frombuffer(flat.buffers()[1], np.int32)[bounds + np.arange(len(bounds))].tolist()
        flat = memoryview(flat.buffers()[2])
        return [bytes(flat[a:b]) for a, b in zip(stops, stops[1:], strict=False)]

    def encode(texts: list[str] | pa.Array) -> list[bytes]:
        texts = texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        out: list[bytes] = []
        for part in slices(texts, BYTES):
            out += some(part)
        return out

    return encode, kind


MEMORIES["packing"] = chunk_encoder


class Tournament:
    """Bins in order of opening; finds the first with enough room in logarithmic time."""

    def __init__(self, most: int, length: int):
        self.size = 1 << max(0, most - 1).bit_length()
        self.tree = [length] * (2 * self.size)  # room left: an unopened bin has all of it

    def place(self, need: int) -> int:
        tree, at = self.tree, 1
        while at < self.size:
            at *= 2
            if tree[at] < need:
                at += 1
        bin_, tree[at] = at - self.size, tree[at] - need
        while at > 1:
            at //= 2
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
        return bin_


def pack(sizes: list[int], length: int = LENGTH, least_cut: int = LEAST_CUT) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length), each filled without gaps from 0.

    Documents of `length` ids or more give full sequences; what is left of each is placed first-fit
    decreasing. Then sequences with gaps are filled: the emptiest are taken apart and their pieces cut
    to fit the gaps of the fullest, until at most one sequence has a large gap; that one is cut at
    powers of two, where sequences need no padding. Gaps under least_cut stay.
    """
    full, rest = [], []
    for doc, n in enumerate(sizes):
        whole = n - n % length
        full += [[(doc, at, length)] for at in range(0, whole, length)]
        if n > whole:
            rest.append((n - whole, doc, whole))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree = Tournament(max(1, len(rest)), length)
    bins: dict[int, list[tuple[int, int, int]]] = {}
    for n, doc, start in rest:
        bins.setdefault(tree.place(n), []).append((doc, start, n))
    room = lambda b: length - sum(p[2] for p in b)
    order = sorted((room(b), k) for k, b in bins.items())
    done = [bins[k] for r, k in order if r < least_cut]
    gaps = [bins[k] for r, k in order if r >= least_cut]
    at, end = 0, len(gaps) - 1
    rooms = [room(b) for b in gaps]
    while at < end:
        doc, start, n = gaps[end].pop()
        take = min(n, rooms[at])
        gaps[at].append((doc, start, take))
        rooms[at] -= take
        rooms[end] += take
        if take < n:
            gaps[end].append((doc, start + take, n - take))
        if not gaps[end]:
            end -= 1
        if rooms[at] < least_cut:
            at += 1
    done += [b for b in gaps[: end + 1][:at] if b]
    for b in gaps[at : end + 1]:
        left = sum(p[2] for p in b)
        while b:
            space = 1 << (left.bit_length() - 1)
            left -= space
            cut: list[tuple[int, int, int]] = []
            while space:
                doc, start, n = b.pop()
                take = min(n, space)
                cut.append((doc, start, take))
                space -= take
                if take < n:
                    b.append((doc, start + take, n - take))
            done.append(cut)
    return full + done


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, group_docs: int = GROUP_DOCS, tokens: bool = False, remember: int = REMEMBER) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): one row per piece.

    tokenizer is the path of a tokenizers file that every executor can read. Each text's ids, then
    end_id, are cut so that each id lies in one piece; null counts as empty (one piece, end_id only).
    Documents are dealt into groups by a hash of id, text length, digest and the number of a repeat, about
    group_docs to a group, and packed in each group alone, so a sequence never needs another group's data and no
    crowd of equal rows one group. Repeated rows are documents of their own; documents that tie in length go by
    digest, then id. Texts of any length count whole, cut over several sequences. A null doc_id stays null; other
    columns are ignored; an empty table gives an empty result. tokens adds the ids themselves as array<int>; remember bounds a worker's memory of chunks.
    """
    groups = max(1, round(docs.count() / group_docs))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def coding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("packing")
        encode, kind = chunk_encoder(tokenizer, end_id, remember)
        width = np.dtype(kind).itemsize
        seen: Counter = Counter()  # of this task's rows
        for whole in batches:
            for batch in pieces(whole):
                ids, own = encode(batch.column("text")), batch.column("doc_id")
                crcs, nth = [zlib.crc32(x) for x in ids], []
                for row in zip(own.to_pylist(), crcs, strict=True):
                    nth.append(seen[mark := hash(row)])
                    seen[mark] += 1
                cols = {"ids": pa.array(ids, pa.binary()), "n": pa.array([len(x) // width for x in ids], pa.int64()), "crc": pa.array(crcs, pa.int64()), "nth": pa.array(nth, pa.int64())}
                yield pa.RecordBatch.from_arrays([own, *cols.values()], names=["doc_id", *cols])
        end()

    coded = bounded(docs).select(docs["doc_id"], text_of(docs).alias("text")).mapInArrow(coding, f"doc_id {kind}, ids binary, n long, crc long, nth long")
    # Equal rows are interchangeable, so a task that runs again in another order deals the same rows to the same groups.
    coded = coded.withColumn("grp", F.pmod(F.xxhash64("doc_id", "crc", "n", "nth"), F.lit(groups))).drop("nth")

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "crc", "doc_id"], ignore_index=True)
        kind = np.uint16 if len(rows["ids"][0]) == 2 * rows["n"][0] else np.uint32
        sizes = rows["n"].tolist()
        arrays = [np.frombuffer(x, kind).astype("<u4") for x in rows["ids"]]
        base = int(rows["grp"][0]) << 32
        out = []
        for k, seq in enumerate(pack(sizes, length)):
            offset = 0
            for doc, start, n in seq:
                own = arrays[doc][start : start + n]
                out.append((doc, start, n, zlib.crc32(own.tobytes()), sizes[doc], base + k, offset, own if tokens else None))
                offset += n
        names = ["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        found = pd.DataFrame(out, columns=names)
        found.insert(0, "doc_id", rows["doc_id"].to_numpy()[found["doc"].to_numpy()])
        return found.drop(columns=["doc"] if tokens else ["doc", "ids"])

    schema = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * tokens
    # Ids travel as text, which pandas keeps exact where some are null.
    named = coded.withColumn("doc_id", F.col("doc_id").cast("string"))
    out = named.groupBy("grp").applyInPandas(packed, f"doc_id string, {schema}")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def op7(docs: DataFrame, remember: int = REMEMBER) -> DataFrame:
    """The contract's columns."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), remember=remember)
