"""Two tokenizers' tokens of the same bytes, aligned, and how often the corpus links an id of one with an id of the other.

Both tokenizers end a token before every single space, so a text is aligned stretch by stretch, and equal stretches once. The
ends of all new stretches of a batch, as two long sorted lists, are intersected by galloping. What a block of documents
holds goes out once as stretches, once as counted pairs; the pairs' totals come back to each block, never to each document.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import text_arrays as ta
from .common import stored

#: Bytes of text of a block of documents (a longer text makes one of its own).
BLOCK = 8 << 20
#: Bytes of text that are cut and aligned at once.
PIECE = 3 << 20
#: Stretches that a worker remembers (some 350 bytes each), and characters of them; when full, it starts anew.
REMEMBERED = 200_000
#: Characters that the tokenizers get at once.
PORTION = 1 << 16
#: A space beside other white space: with it, tokens may reach over spaces.
RUNS = re.compile(r" (?:(?=\s)|(?<=\s ))")
#: The sign for a space in pieces.
SPACE = "▁"


def gallop(short: list[int], long: list[int]) -> tuple[list[int], list[int]]:
    """The places, in each of two ascending lists, of what both hold. Each number of the shorter is sought in the longer from
    the last place on, in steps that double, then by halving."""
    i_s, j_s, lo, n = [], [], 0, len(long)
    for i, x in enumerate(short):
        hi, step = lo, 1
        while hi < n and long[hi] < x:
            lo = hi + 1
            hi += step
            step *= 2
        if hi > lo:
            lo = bisect_left(long, x, lo, min(hi, n))
        if lo == n:
            break
        if long[lo] == x:
            i_s.append(i)
            j_s.append(lo)
            lo += 1
    return i_s, j_s


def common_ends(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The places of the common ends in a and in b, one past them: group k is what lies between two of them."""
    i, j = gallop(a, b) if len(a) <= len(b) else gallop(b, a)[::-1]
    return np.array(i, np.int64) + 1, np.array(j, np.int64) + 1


def overlaps(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of each token of a the range of b's tokens that share bytes with it: the ranks of its start and end among b's ends.
    Both lists end at the same byte."""
    start = np.concatenate(([0], a[:-1])) if len(a) else np.zeros(0, np.int64)
    return np.searchsorted(b, start, "right"), np.searchsorted(b, a, "left") + 1


def sums(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sum of the first n[0] of x, of the next n[1], and so on."""
    at = np.concatenate(([0], np.cumsum(x)))
    stop = np.cumsum(n)
    return at[stop] - at[stop - n]


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0] and the n[0] - 1 numbers after it, then the same of start[1], and so on."""
    stop = np.cumsum(n)
    return np.repeat(start - (stop - n), n) + np.arange(stop[-1] if len(n) else 0)


def joined(strings: pa.Array, n: np.ndarray, by: str) -> pa.Array:
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int64()), strings), pa.scalar(by, pa.large_string()))


class Aligner:
    """What is known of stretches: token counts, groups as text, and links as pairs a << 32 | b."""

    def __init__(self, a_file: bytes, b_file: bytes, remembered: int):
        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in A's entries
        rest = iter(range(256, 512))
        byte = {chr(b) if b in own else chr(next(rest)): b for b in range(256)}
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            self.a_bytes[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in pieces) and json.loads(a_file)["pre_tokenizer"]["type"] == "ByteLevel"
        self.a_size, self.b_size = (np.array([len(x) for x in own]) for own in (self.a_bytes, self.b_bytes))
        self.a_text, self.b_text = (pa.array(map(str, range(len(own))), pa.large_string()) for own in (self.a_bytes, self.b_bytes))
        self.remembered = remembered
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.chars = 0
        self.good = np.zeros(0, bool)  # both tokenizers give back the stretch
        self.n_a, self.n_b, self.n_links = (np.zeros(0, np.int64) for _ in range(3))
        self.links = np.zeros(0, np.int64)
        self.text = pa.array([], pa.large_string())

    def make_room(self) -> None:
        if len(self.place) > self.remembered or self.chars > 16 * self.remembered:
            self.forget()

    def stretches(self, text: str) -> list[str]:
        """The text cut at its spaces, or whole where that would change its tokens; a stretch's own space comes before it."""
        return text.split(" ") if self.cuts and text[0] != " " != text[-1] and not RUNS.search(text) else [text]

    def tokens(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of a space and the text; None where the tokens are other bytes."""
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text, num_threads=1)
        raw = (" " + text).encode()
        return (a, b) if b"".join([self.a_bytes[i] for i in a]) == raw == b"".join([self.b_bytes[i] for i in b]) else None

    def learn(self, stretches: list[str]) -> None:
        """Stretches without white space at their ends are tokenized together, many at once; the others each by itself."""
        order, good, sizes, a_ids, b_ids = [], [], [], [], []
        portion: list[str] = []

        def put(own: list[str]) -> None:
            found = self.tokens(" ".join(own))
            if found is None and len(own) > 1:
                for s in own:
                    put([s])
                return
            order.extend(own)
            good.extend([found is not None] * len(own))
            if found is None:
                sizes.append(0)
                return
            sizes.extend([len(s.encode()) + 1 for s in own])
            a_ids.extend(found[0])
            b_ids.extend(found[1])

        n = 0
        for s in stretches:
            if len(s) > PORTION or " " in s or s[0].isspace() or s[-1].isspace():
                put([s])
                continue
            portion.append(s)
            n += len(s) + 1
            if n > PORTION:
                put(portion)
                portion, n = [], 0
        if portion:
            put(portion)
        a_ids, b_ids = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
        a_end, b_end, end = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids]), np.cumsum(sizes)
        i, j = common_ends(a_end.tolist(), b_end.tolist())
        groups = np.diff(np.searchsorted(a_end[i - 1], end, "right"), prepend=0)
        a_part, b_part = (joined(text.take(ids), np.diff(at, prepend=0), ",") for text, ids, at in ((self.a_text, a_ids, i), (self.b_text, b_ids, j)))
        text = joined(pc.binary_join_element_wise(a_part, b_part, pa.scalar("|", pa.large_string())), groups, ";")
        self.place |= zip(order, range(len(self.good), len(self.good) + len(order)))
        self.chars += sum(map(len, order))
        self.good = np.concatenate((self.good, np.array(good, bool)))
        self.n_a = np.concatenate((self.n_a, np.diff(np.searchsorted(a_end, end, "right"), prepend=0)))
        self.n_b = np.concatenate((self.n_b, np.diff(np.searchsorted(b_end, end, "right"), prepend=0)))
        self.n_links = np.concatenate((self.n_links, groups))
        self.links = np.concatenate((self.links, a_ids[i - 1] << 32 | b_ids[j - 1]))
        self.text = pa.concat_arrays([self.text, text])

    def align(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The places of all stretches of all texts, and how many each text has: none where it has no tokens."""
        found = [self.stretches(t) if t else [] for t in texts]
        d = pa.array([s for own in found for s in own], pa.large_string()).dictionary_encode()
        different = d.dictionary.to_pylist()
        self.learn([s for s in different if s not in self.place])
        at = np.array([self.place[s] for s in different], np.int64)[d.indices.to_numpy()]
        n = np.array([len(own) for own in found], np.int64)
        whole = sums(~self.good[at], n) == 0
        return at[np.repeat(whole, n)], np.where(whole, n, 0)


@functools.lru_cache(maxsize=1)
def aligner(a_file: bytes, b_file: bytes, remembered: int = REMEMBERED) -> Aligner:
    return Aligner(a_file, b_file, remembered)


PASS1 = "block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, groups string, stretches binary, first binary, pairs binary, pair long, place int, n long"


def _first_pass(a_file, b_file, remembered: int, block_bytes: int, keep: bool):
    """Rows of three kinds: documents with their stretches; of each block the pairs of its stretches; and its pairs, counted."""
    schema = pa.schema([(c, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[t]) for c, t in (x.split() for x in PASS1.split(", "))])

    def batch_of(rows: int, **cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(rows, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block = aligner(a_file.value, b_file.value, remembered), TaskContext.get().partitionId() << 32
        for docs in _blocks(batches, block_bytes):
            own.make_room()
            at, n = (np.concatenate(x) for x in zip(*(own.align([x.as_py() or "" for x in part.column("text")]) for part in docs)))
            stop = np.cumsum(n)
            used, local = np.unique(at, return_inverse=True)
            start = (np.cumsum(own.n_links) - own.n_links)[used]
            m = own.n_links[used]
            pairs, place = np.unique(own.links[spread(start, m)], return_inverse=True)
            times = np.bincount(place, np.repeat(np.bincount(local, minlength=len(used)), m), len(pairs)).astype(np.int64)
            packed = local.astype("<u4").tobytes()
            doc: dict[str, list] = {c: [] for c in ("groups_sha256", "groups", "stretches")}
            for k, (lo, hi) in enumerate(zip((stop - n).tolist(), stop.tolist())):  # one document's groups at a time: they are several times its text
                groups = (joined(own.text.take(at[lo:hi]), n[k : k + 1], ";")[0].as_py() or "") if hi > lo else ""
                doc["groups_sha256"].append(hashlib.sha256(groups.encode()).hexdigest() if groups else "")
                doc["groups"].append(groups if keep else None)
                doc["stretches"].append(packed[4 * lo : 4 * hi])
            yield batch_of(len(n), block=np.full(len(n), block), doc_id=pa.concat_arrays([part.column("doc_id") for part in docs]), n_a=sums(own.n_a[at], n), n_b=sums(own.n_b[at], n), n_groups=sums(own.n_links[at], n), **doc)
            yield batch_of(1, block=[block], first=[m.astype("<u4").tobytes()], pairs=[place.astype("<u4").tobytes()])
            for lo in range(0, len(pairs), 1 << 16):
                some = slice(lo, lo + (1 << 16))
                k = len(pairs[some])
                yield batch_of(k, block=np.full(k, block), pair=pairs[some], place=np.arange(lo, lo + k, dtype=np.int32), n=times[some])
            block += 1

    return run


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Pieces of batches gathered until they hold limit bytes of text."""
    held, size = [], 0
    for part in ta.chunks(batches, limit=min(PIECE, limit)):
        own = part.column(part.schema.get_field_index("text")).nbytes
        if held and size + own > limit:
            yield held
            held, size = [], 0
        held.append(part)
        size += own
    if held:
        yield held


def pair_totals(counted: DataFrame) -> DataFrame:
    """pair, total and whether it is the highest of its B id, from counted pairs. The window has a row for each A id at most."""
    totals = counted.groupBy("pair").agg(F.sum("n").alias("total"))
    most = F.max("total").over(Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF)))
    return totals.withColumn("best", F.col("total") == most)


OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_overlaps long"


def _second_pass(keep: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rule = left.filter(pc.is_valid(left["first"]))
        docs = left.filter(pc.is_null(left["first"]))
        m, place = (np.frombuffer(rule[c][0].as_py(), "<u4").astype(np.int64) for c in ("first", "pairs"))
        total, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        total[right["place"].to_numpy()], best[right["place"].to_numpy()] = right["total"].to_numpy(), right["best"].to_numpy()
        of_stretch = [sums(x[place], m) for x in (total, best)]
        own = [np.frombuffer(x.as_py(), "<u4") for x in docs["stretches"]]
        n = np.array([len(x) for x in own], np.int64)
        at = np.concatenate(own) if own else np.zeros(0, np.uint32)
        count, high = (pa.array(sums(x[at], n)) for x in of_stretch)
        over = pc.subtract(pc.add(docs["n_a"], docs["n_b"]), docs["n_groups"])  # a group of a and b tokens has a + b - 1
        cols = [docs["doc_id"], docs["n_a"], docs["n_b"], docs["n_groups"], docs["n_groups"], high, count, docs["groups_sha256"], over, *([docs["groups"]] if keep else [])]
        return pa.table(cols, [x.split()[0] for x in OUT.split(", ")] + ["groups"] * keep)

    return run


def align_documents(docs: DataFrame, a_path: str, b_path: str, keep: bool = False, remembered: int = REMEMBERED, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Each document's alignment, and the corpus's pairs (a, b, total, best).

    a_path: a byte-level BPE as JSON; b_path: a piece model with byte fallback, which adds a space; a few MB each, read by
    the driver and broadcast. n_groups: stretches between common ends of tokens; n_links: pairs of tokens that end together,
    one a group; n_best and count_sum: how many of the links are of the pair most frequent for its B id (ties included), and
    the sum of their pairs' totals; n_overlaps: pairs of tokens that share bytes. keep adds the groups as text.
    Null and empty texts, and those that either tokenizer doesn't give back, have no tokens: zeros and ''. Special tokens
    inside texts are plain text. Repeated rows are rows of the result each and count each. Other columns are left out; no
    rows give no rows.
    """
    sc = docs.sparkSession.sparkContext
    files = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            files.append(sc.broadcast(f.read()))
    rows = stored(docs.select("doc_id", "text").mapInArrow(_first_pass(*files, remembered, block, keep), PASS1))
    counted = rows.filter("pair IS NOT NULL").select("block", "pair", "place", "n")
    totals = pair_totals(counted)
    back = counted.drop("n").join(totals, "pair").select(F.col("block").alias("of"), "place", "total", "best")
    own = rows.filter("pair IS NULL").drop("pair", "place", "n")
    out = own.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_second_pass(keep), OUT + ", groups string" * keep)
    return out, totals.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "total", "best")
