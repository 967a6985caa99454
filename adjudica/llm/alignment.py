"""Operator 12, cross-tokenizer alignment over distinct segments.

A text, with a space before it, is cut before runs of white space that begin with a
space. ``separable`` verifies from the vocabularies that no token of either crosses
such a place: A splits words there by its pattern, and no piece of B has a space
behind another character. Where that cannot be shown, a text is one segment.

Documents are taken in blocks of ``BLOCK_CHARS`` characters. A block keeps its
documents as numbers of its distinct segments; each distinct segment of a block goes
to the others like it (one row a block, so a frequent segment has as many rows as there
are blocks), where it is tokenised and aligned once, and the alignment comes back to
the blocks. There documents are composed: counts and the digest from their segments,
and the distinct linked pairs of each document. Pair counts are summed over all
blocks, joined back to the pairs of each block, and summed along the documents.

Links lie within groups and groups within segments, as both tokenizers end at a cut.

Defined results: null and empty texts, and texts whose tokens of A or B spell
something else, have no tokens: zeros and an empty digest, and they count for no
pair; texts are aligned whole, a text longer than a block being one; repeated rows
count each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import encoders
from .common import Scratch, ship

ship(__name__)

BLOCK_CHARS = 20_000_000
#: Groups with more links are counted by their distinct ids.
WIDE_GROUP = 4096
#: Segments of documents whose pairs are made distinct at a time, and distinct segments decoded at a time.
CHUNK, DECODED = 200_000, 20_000
# Whole text but for cuts before a space run: white space, a word, then words behind other white space.
SEGMENT = re.compile(r"\s+\S+(?:[^\S ]\s*\S+)*(?:\s+\Z)?|\s+")

BLOCKS = "block long, code int, segment string, doc_ids binary, known binary, sizes binary, codes binary"
ALIGNED = "block long, code int, words binary, wide binary"
COMPOSED = (
    "block long, pair int, a int, b int, n_docs long, good binary, "
    "sums binary, digests array<string>, pairs_of binary, pairs binary, times binary"
)
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def piece_bytes(model: bytes) -> list[bytes]:
    """What each piece of a sentence-piece model spells."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_proto=model)
    out = []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.replace("▁", " ").encode())
    return out


def separable(vocabulary: bytes, model: bytes) -> bool:
    """Whether no token can cross a place between a character that is no white space and a space."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece.sentencepiece_model_pb2 import ModelProto

    if not encoders.in_merge_order(json.loads(vocabulary)):
        return False
    proto = ModelProto()
    proto.ParseFromString(model)
    norm = proto.normalizer_spec
    plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
    bpe = proto.trainer_spec.model_type == 2 and not proto.trainer_spec.treat_whitespace_as_suffix
    sp = SentencePieceProcessor(model_proto=model)
    return bool(plain and bpe) and not any(re.search("[^▁]▁", sp.id_to_piece(i)) for i in range(sp.get_piece_size()))


def segments(text: str, cut: bool) -> list[str]:
    """Segments of a text that is not empty; each begins with a space, and joined they are the text with a space before it."""
    whole = " " + text
    return SEGMENT.findall(whole) if cut else [whole]


def blocks(documents: DataFrame, cut: bool) -> DataFrame:
    """A row for each block with its documents, and one for each of its distinct segments."""

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        names = [f.split(" ")[0] for f in BLOCKS.split(", ")]

        def emit():
            n = len(known)
            row = {"block": [block], "code": [None], "segment": [None], "known": [np.array(known, np.bool_).tobytes()]}
            row |= {"doc_ids": [np.array(doc_ids, "<i8").tobytes()], "sizes": [np.array(sizes, "<i8").tobytes()]}
            row |= {"codes": [to_planes(np.concatenate(codes)) if n else b""]}
            types = (pa.int64(), pa.int32(), pa.string(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(row[k], t) for k, t in zip(names, types, strict=True)], names)
            found = list(seen)
            for at in range(0, len(found), 65_536):
                part = found[at : at + 65_536]
                columns = [pa.array([block] * len(part), pa.int64()), pa.array(range(at, at + len(part)), pa.int32()), pa.array(part, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(len(part), pa.binary())] * 4], names)

        seen, doc_ids, known, sizes, codes, held = {}, [], [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if held and held + len(text or "") > BLOCK_CHARS:
                    yield from emit()
                    block += 1
                    seen, doc_ids, known, sizes, codes, held = {}, [], [], [], [], 0
                here = [seen.setdefault(s, len(seen)) for s in segments(text, cut)] if text else []
                doc_ids.append(doc_id or 0)
                known.append(doc_id is not None)
                sizes.append(len(here))
                codes.append(np.array(here, "<u4"))
                held += len(text or "") + 16
        if known:
            yield from emit()

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, BLOCKS)


def before(counts: np.ndarray) -> np.ndarray:
    """Sum of the counts before each place."""
    return np.cumsum(counts) - counts


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ..., counts[i] numbers for each i."""
    return np.repeat(starts - before(counts), counts) + np.arange(counts.sum())


class Aligner:
    """Tokens of both vocabularies for segments, grouped where both end.

    An alignment is the numbers n_a, n_b, n_groups, ids of A, ids of B, A tokens of
    each group, B tokens of each group; empty if the tokens spell something else.
    """

    def __init__(self, vocabulary: bytes, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.encode_a = encoders.byte_bpe(vocabulary, special=False)
        self.sp = SentencePieceProcessor(model_proto=model)
        self.bytes_a, self.bytes_b = encoders.token_bytes(vocabulary), piece_bytes(model)
        self.len_a, self.len_b = (np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b))

    def align(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all alignments in one array, and how many each text has."""
        ids_a, ids_b = self.encode_a(texts), self.sp.encode([t[1:] for t in texts], num_threads=1)
        want = [t.encode() for t in texts]
        if not self._spelt(ids_a, ids_b, want):
            good = [i for i, w in enumerate(want) if self._spelt([ids_a[i]], [ids_b[i]], [w])]
            sizes = np.zeros(len(texts), np.int64)
            ids_a, ids_b, want = ([x[i] for i in good] for x in (ids_a, ids_b, want))
            numbers, sizes[good] = self._group(ids_a, ids_b, want) if good else (np.zeros(0, np.int64), 0)
            return numbers, sizes
        return self._group(ids_a, ids_b, want)

    def _spelt(self, ids_a, ids_b, want) -> bool:
        for entries, ids in ((self.bytes_a, ids_a), (self.bytes_b, ids_b)):
            spelt = [b"".join([entries[i] for i in x]) for x in ids]
            if spelt != want:
                return False
        return True

    def _group(self, ids_a, ids_b, want) -> tuple[np.ndarray, np.ndarray]:
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        a, b = (np.array([i for x in ids for i in x], np.int64) for ids in (ids_a, ids_b))
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        in_a, in_b = (np.bincount(np.searchsorted(both, ends), minlength=len(both)) for ends in (ends_a, ends_b))
        n_groups = np.diff(np.searchsorted(both, np.cumsum([len(w) for w in want]), side="right"), prepend=0)
        sizes = 3 + n_a + n_b + 2 * n_groups
        start = before(sizes)
        out = np.zeros(sizes.sum(), np.int64)
        out[start], out[start + 1], out[start + 2] = n_a, n_b, n_groups
        at = start + 3
        for counts, numbers in ((n_a, a), (n_b, b), (n_groups, in_a), (n_groups, in_b)):
            out[ragged(at, counts)] = numbers
            at = at + counts
        return out, sizes


def parts_of(numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """n_a, n_b, n_groups, and ids of A, ids of B, A tokens and B tokens of each group, of several alignments."""
    start, good = before(sizes), sizes > 0
    head = np.where(good, start, 0)
    n_a, n_b, n_groups = (np.where(good, numbers[head + i] if len(numbers) else 0, 0).astype(np.int64) for i in range(3))
    at = start + 3
    a, b = numbers[ragged(at, n_a)], numbers[ragged(at + n_a, n_b)]
    in_a, in_b = (numbers[ragged(at + n_a + n_b + k * n_groups, n_groups)] for k in (0, 1))
    return n_a, n_b, n_groups, a, b, in_a, in_b


def pack(numbers: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Alignments with a byte for each count and two for each id, and how many bytes each has. Counts are below 256, ids below 65,536."""
    n_a, n_b, n_groups, a, b, in_a, in_b = parts_of(numbers, sizes)
    length = np.where(sizes > 0, 3 + 2 * n_groups + 2 * (n_a + n_b), 0)
    start, out = before(length), np.zeros(length.sum(), np.uint8)
    good = sizes > 0
    for i, n in enumerate((n_a, n_b, n_groups)):
        out[start[good] + i] = n[good]
    out[ragged(start + 3, n_groups)], out[ragged(start + 3 + n_groups, n_groups)] = in_a, in_b
    at = start + 3 + 2 * n_groups
    for first, n, ids in ((at, n_a, a), (at + 2 * n_a, n_b, b)):
        place = 2 * ragged(np.zeros(len(n), np.int64), n) + np.repeat(first, n)
        out[place], out[place + 1] = ids & 255, ids >> 8
    return out.tobytes(), length


def unpack(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of packed alignments, and how many each has."""
    raw, length = np.frombuffer(b"".join(rows), np.uint8).astype(np.int64), np.array([len(r) for r in rows], np.int64)
    start, good = before(length), length > 0
    head = np.where(good, start, 0)
    n_a, n_b, n_groups = (np.where(good, raw[head + i] if len(raw) else 0, 0) for i in range(3))
    sizes = np.where(good, 3 + n_a + n_b + 2 * n_groups, 0)
    to, out = before(sizes), np.zeros(sizes.sum(), np.int64)
    for i, n in enumerate((n_a, n_b, n_groups)):
        out[to[good] + i] = n[good]
    ids = start + 3 + 2 * n_groups
    n = n_a + n_b
    place = 2 * ragged(np.zeros(len(n), np.int64), n) + np.repeat(ids, n)
    out[ragged(to + 3, n)] = raw[place] + 256 * raw[place + 1]
    out[ragged(to + 3 + n, 2 * n_groups)] = raw[ragged(start + 3, 2 * n_groups)]
    return out, sizes


def aligned(rows: DataFrame, vocabulary, model, narrow: bool) -> DataFrame:
    """(block, code, words or wide) for rows (block, code, segment): equal segments meet, sorted, and are aligned once.

    words: packed; wide: 32-bit numbers, for giant segments or where ids need more than 16 bits.
    """

    def run(batches):
        aligner = Aligner(vocabulary.value, model.value)
        last, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = batch.column("segment").dictionary_encode()
            texts, index = runs.dictionary.to_pylist(), runs.indices.to_numpy()
            known = held if texts[0] == last else None  # goes on from the batch before
            fresh = texts[1:] if known else texts
            words, wide = ([known[0]], [known[1]]) if known else ([], [])
            numbers, sizes = aligner.align(fresh) if fresh else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            giant = np.zeros(len(sizes), bool)
            if not narrow:
                giant[:] = True
            elif (sizes > 255).any():
                giant = sizes > 255
            numbers_in = np.repeat(giant, sizes)
            small, length = pack(numbers[~numbers_in], np.where(giant, 0, sizes))
            large = numbers[numbers_in].astype("<u4").tobytes()
            at_small = at_large = 0
            for n, size, g in zip(length.tolist(), sizes.tolist(), giant.tolist(), strict=True):
                words.append(None if g else small[at_small : at_small + n])
                wide.append(large[at_large : at_large + 4 * size] if g else None)
                at_small, at_large = at_small + n, at_large + 4 * size * g
            last, held = texts[-1], (words[-1], wide[-1])
            columns = [batch.column("block"), batch.column("code"), pa.array(words, pa.binary()).take(pa.array(index)), pa.array(wide, pa.binary()).take(pa.array(index))]
            yield pa.RecordBatch.from_arrays(columns, ["block", "code", "words", "wide"])

    return rows.repartition("segment").sortWithinPartitions("segment").mapInArrow(run, ALIGNED)


def numbers_of(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All alignment numbers of rows (words, wide), and how many each row has."""
    if rows["wide"].null_count == rows.num_rows:
        return unpack(rows["words"].to_pylist())
    each = [unpack([w])[0] if w is not None else np.frombuffer(x, "<u4").astype(np.int64) for w, x in zip(rows["words"].to_pylist(), rows["wide"].to_pylist(), strict=True)]
    return np.concatenate(each), np.array([len(e) for e in each], np.int64)


class Segments:
    """Decoded alignments of a block's segments, by code.

    sums: rows n_a, n_b, n_groups, n_links. pairs: for each segment, ``pairs_of`` of them,
    its distinct linked pairs as places in ``keys`` (A id x n_ids_b + B id), linked ``times``.
    """

    def __init__(self, alignments: pa.Table, n_ids_b: int):
        """alignments: (code, words, wide), a row for each code. They are decoded some at a time, so little is held twice."""
        self.text: list[str] = []
        order = np.argsort(alignments["code"].to_numpy())
        parts = []
        for x in range(0, max(1, len(order)), DECODED):
            numbers, sizes = numbers_of(alignments.take(order[x : x + DECODED])) if len(order) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            parts.append((sizes > 0, *self._decode(numbers, sizes, n_ids_b)))
        self.good, self.pairs_of, self.times, keys = (np.concatenate([p[k] for p in parts]) for k in (0, 2, 3, 4))
        self.sums = np.concatenate([p[1] for p in parts], axis=1)
        del parts
        self.keys = np.unique(keys)
        self.pairs = np.searchsorted(self.keys, keys).astype(np.int32)

    def _decode(self, numbers: np.ndarray, sizes: np.ndarray, n_ids_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sums, pairs of each segment, and times and keys of these pairs; the segments' texts are added to ``text``."""
        n_a, n_b, n_groups, a, b, in_a, in_b = parts_of(numbers, sizes)
        self.text += written(a, b, in_a, in_b, n_groups)
        first_a, first_b, code = before(in_a), before(in_b), np.repeat(np.arange(len(sizes)), n_groups)
        links = in_a * in_b
        by_code = np.zeros(len(sizes), np.int64)
        np.add.at(by_code, code, links)
        # Linked pairs: place by place in small groups, by distinct ids in large ones.
        few = links <= WIDE_GROUP
        n = links[few]
        local = ragged(np.zeros(len(n), np.int64), n)
        over = np.repeat(in_b[few], n)
        keys = [a[np.repeat(first_a[few], n) + local // over] * n_ids_b + b[np.repeat(first_b[few], n) + local % over]]
        codes, times = [np.repeat(code[few], n)], [np.ones(n.sum(), np.int64)]
        for g in np.flatnonzero(~few).tolist():
            ua, ca = np.unique(a[first_a[g] : first_a[g] + in_a[g]], return_counts=True)
            ub, cb = np.unique(b[first_b[g] : first_b[g] + in_b[g]], return_counts=True)
            keys.append((ua[:, None] * n_ids_b + ub[None, :]).reshape(-1))
            times.append((ca[:, None] * cb[None, :]).reshape(-1))
            codes.append(np.full(len(keys[-1]), code[g]))
        keys, codes, times = np.concatenate(keys), np.concatenate(codes), np.concatenate(times)
        order = np.lexsort((keys, codes))
        keys, codes, times = keys[order], codes[order], times[order]
        new = np.flatnonzero(np.diff(codes, prepend=-1) | np.diff(keys, prepend=-1))
        times = np.add.reduceat(times, new) if len(new) else times
        return np.stack([n_a, n_b, n_groups, by_code]), np.bincount(codes[new], minlength=len(sizes)), times.astype(np.uint32), keys[new]


def written(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, n_groups: np.ndarray) -> list[str]:
    """``a1,a2|b1;`` and so on, for each segment."""
    place_a, place_b = ragged(before(in_a) + before(in_b), in_a), ragged(before(in_a) + before(in_b) + in_a, in_b)
    ids, mark = np.zeros(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.int64)
    ids[place_a], ids[place_b] = a, b
    mark[place_a[np.cumsum(in_a) - 1]] = 1
    mark[place_b[np.cumsum(in_b) - 1]] = 2
    out = [f"{i}{',|;'[m]}" for i, m in zip(ids.tolist(), mark.tolist(), strict=True)]
    bounds = np.concatenate([[0], np.cumsum(in_a + in_b)])[np.concatenate([[0], np.cumsum(n_groups)])].tolist()
    return ["".join(out[x:y]) for x, y in zip(bounds, bounds[1:], strict=False)]


def chunks(sizes: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(first document, last, first place, last) of runs of documents with about ``CHUNK`` segments; the lasts are not included."""
    ends, out, at = np.cumsum(sizes), [], 0
    while at < len(sizes):
        low = int(ends[at] - sizes[at])
        to = max(at + 1, int(np.searchsorted(ends, low + CHUNK, side="right")))
        out.append((at, to, low, int(ends[to - 1])))
        at = to
    return out


def along(values: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each document, the sum of its segments' values."""
    out = np.zeros(len(sizes), np.int64)
    for at, to, low, high in chunks(sizes):
        run = np.concatenate([[0], np.cumsum(values[codes[low:high]], dtype=np.int64)])
        ends = np.cumsum(sizes[at:to])
        out[at:to] = run[ends] - run[ends - sizes[at:to]]
    return out


def document_pairs(found: Segments, codes: np.ndarray, sizes: np.ndarray, good: np.ndarray) -> np.ndarray:
    """How many of the good documents hold each pair."""
    held = np.zeros(len(found.keys), np.int64)
    n_codes, n_pairs, first = max(1, len(found.pairs_of)), len(found.keys), before(found.pairs_of)
    for at, to, low, high in chunks(sizes):
        doc = np.repeat(np.arange(to - at), sizes[at:to])
        keep = good[at:to][doc]
        each = np.unique(doc[keep] * n_codes + codes[low:high][keep])
        code = each % n_codes
        pairs = found.pairs[ragged(first[code], found.pairs_of[code])]
        distinct = np.unique(np.repeat(each // n_codes, found.pairs_of[code]) * n_pairs + pairs)
        held += np.bincount(distinct % n_pairs, minlength=n_pairs) if n_pairs else 0
    return held


def to_planes(codes: np.ndarray) -> bytes:
    """Codes with their low bytes first, then the next ones: the upper bytes compress to little."""
    return np.ascontiguousarray(codes.astype("<u4").view("u1").reshape(-1, 4).T).tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, "u1").reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int32)


def table_of(schema: str, columns: dict[str, list], rows: int) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.table({name: pa.array(columns[name], kinds[kind]) if name in columns else pa.nulls(rows, kinds[kind]) for name, kind in fields})


def composed(n_ids_b: int) -> Callable:
    """(alignments of a block, its documents) -> a row for the documents and one for each distinct pair."""

    def run(alignments: pa.Table, documents: pa.Table) -> pa.Table:
        row = documents.to_pylist()[0]
        sizes, codes = np.frombuffer(row["sizes"], "<i8"), from_planes(row["codes"])
        del documents
        found = Segments(alignments, n_ids_b)
        good = (along(~found.good, codes, sizes) == 0) & (sizes > 0)
        sums = np.stack([np.where(good, along(v, codes, sizes), 0) for v in found.sums])
        held = document_pairs(found, codes, sizes, good)
        digests, ends, text = [], np.cumsum(sizes).tolist(), found.text
        for end, n, ok in zip(ends, sizes.tolist(), good.tolist(), strict=True):
            digests.append(hashlib.sha256("".join([text[c] for c in codes[end - n : end].tolist()])[:-1].encode()).hexdigest() if ok else "")
        block = {"block": [row["block"]], "good": [good.tobytes()], "digests": [digests]}
        block |= {"sums": [sums.astype("<i8").tobytes()]} | {k: [getattr(found, k).astype("<u4").tobytes()] for k in ("pairs_of", "pairs")} | {"times": [found.times.astype("<u4").tobytes()]}
        use = np.flatnonzero(held)
        pairs = {"block": np.full(len(use), row["block"]), "pair": use, "a": found.keys[use] // n_ids_b, "b": found.keys[use] % n_ids_b, "n_docs": held[use]}
        return pa.concat_tables([table_of(COMPOSED, block, 1), table_of(COMPOSED, pairs, len(use))])

    return run


def counted(blocks_: pa.Table, counts: pa.Table) -> pa.Table:
    """(a block's row of documents and its row of pairs, counts of its pairs) -> the result rows."""
    one, other = blocks_.to_pylist()
    row = {k: v if v is not None else other[k] for k, v in one.items()}
    sizes, codes = np.frombuffer(row["sizes"], "<i8"), from_planes(row["codes"])
    good = np.frombuffer(row["good"], np.bool_)
    pairs_of, pairs, times = (np.frombuffer(row[k], "<u4").astype(np.int64) for k in ("pairs_of", "pairs", "times"))
    n_pairs, first = int(pairs.max(initial=-1)) + 1, before(pairs_of)
    docs, best = np.zeros(n_pairs, np.int64), np.zeros(n_pairs, np.int64)
    at = counts["pair"].to_numpy()
    docs[at], best[at] = counts["n"].to_numpy(), counts["best"].to_numpy()
    columns = {}
    for name, value in (("n_best", best), ("count_sum", docs)):
        run = np.concatenate([[0], np.cumsum(times * value[pairs])])
        columns[name] = np.where(good, along(run[first + pairs_of] - run[first], codes, sizes), 0)
    sums = np.frombuffer(row["sums"], "<i8").reshape(4, -1)
    columns |= dict(zip(("n_a", "n_b", "n_groups", "n_links"), sums, strict=True)) | {"groups_sha256": row["digests"]}
    out = table_of(RESULT, columns, len(sizes))
    known = np.frombuffer(row["known"], np.bool_)
    return out.set_column(0, "doc_id", pa.array(np.frombuffer(row["doc_ids"], "<i8"), pa.int64(), mask=~known))


def align_documents(documents: DataFrame, vocabulary: str, model: str) -> DataFrame:
    """n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "alignment")
    raw_a, raw_b = encoders.read_file(vocabulary), encoders.read_file(model)
    n_ids_a, n_ids_b = len(encoders.token_bytes(raw_a)), len(piece_bytes(raw_b))
    shipped = [spark.sparkContext.broadcast(x) for x in (raw_a, raw_b)]
    cut = scratch.save(blocks(documents, separable(raw_a, raw_b)))
    of_blocks = cut.where("code IS NULL").select("block", "doc_ids", "known", "sizes", "codes")
    back = aligned(cut.where("code IS NOT NULL").select("block", "code", "segment"), *shipped, max(n_ids_a, n_ids_b) <= 65_536)
    made = scratch.save(back.groupBy("block").cogroup(of_blocks.groupBy("block")).applyInArrow(composed(n_ids_b), COMPOSED))
    pairs = made.where("pair IS NOT NULL").select("block", "pair", "a", "b", "n_docs")
    counts = scratch.save(pairs.groupBy("a", "b").agg(F.sum("n_docs").alias("n")))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    ranked = counts.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).cast("int").alias("best"))
    known = pairs.join(ranked, ["a", "b"]).select(F.col("block").alias("of_block"), "pair", "n", "best")
    whole = of_blocks.unionByName(made.where("pair IS NULL").select("block", "good", "sums", "digests", "pairs_of", "pairs", "times"), allowMissingColumns=True)
    return whole.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(counted, RESULT)
