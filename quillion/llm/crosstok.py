"""Cross-tokenizer alignment by a dictionary of token groups.

Two tokenizers cut a text's bytes at different places; where both end a token, a group ends. Texts
are encoded once, in tasks, block by block: a block interns its distinct groups (the ids of A
and of B) and keeps of each document its groups' numbers and frequencies. Spark sums the blocks'
dictionaries to one row per distinct group, expands the links of each distinct group once,
multiplies them by the documents that hold the group, and takes off what a document counts more
than once because several of its groups link the same ids. What a group adds to a document goes
back by group to the blocks' dictionaries, and by block to the documents, so that no row travels
for each document and group.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillion.llm.common import materialize, shared_dir

A_PATH, B_PATH = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"

#: Fixed value: the pattern that byte-level tokenizers of this kind split texts by before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE = "▁"
#: Neither tokenizer merges what is left of such a place with what is right of it.
CUT = re.compile(r"(?<=\S)(?=[ \n])")

ENCODED = "kind int, doc_id long, block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, gids binary, times binary, gid int, key string, a int, b int, docs long, uses long"
COUNTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Encoders:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, special = spec["model"]["vocab"], {x["id"] for x in spec["added_tokens"]}
        merged = [vocab["".join(x.split(" ") if isinstance(x, str) else x)] for x in spec["model"]["merges"]]
        if merged != sorted(merged) or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError(f"{a_path} is no byte-level BPE whose ids are in the order of its merges")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if i not in special}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.b = lambda texts: model.encode(texts, num_threads=1)
        self.lead = model.piece_to_id(SPACE)
        #: Pieces with a space inside or a line break could cross a cut; then texts stay whole.
        self.cuttable = not any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in pieces)

    def groups(self, parts: list[str]) -> list[list[tuple[tuple, tuple]] | None]:
        """The groups of each part (which starts with a space or a line break); None where bytes differ."""
        found, a_token, b_token = [], self.a_bytes.__getitem__, self.b_bytes.__getitem__
        for part, b in zip(parts, self.b([p[1:] if p[0] == " " else p for p in parts]), strict=True):
            a, b = self.a(part), b if part[0] == " " else b[1:]  # a line break doesn't merge with the space that B puts before it
            b = b or [self.lead]  # B puts none before an empty text
            x, y = list(map(a_token, a)), list(map(b_token, b))
            if x == y:  # the same tokens
                found.append(list(zip(zip(a), zip(b), strict=True)) if b"".join(x) == part.encode() else None)
            else:
                found.append(paired(a, b, list(map(len, x)), list(map(len, y))) if b"".join(x) == part.encode() == b"".join(y) else None)
        return found


@lru_cache(maxsize=2)
def encoders(a_path: str, b_path: str) -> Encoders:
    return Encoders(a_path, b_path)


def paired(a: list[int], b: list[int], a_size: list[int], b_size: list[int]) -> list[tuple[tuple, tuple]]:
    """Runs of tokens between the offsets where both end one; both have the same bytes."""
    out, i, j, i0, j0 = [], 0, 0, 0, 0
    x, y = a_size[0], b_size[0]
    while True:
        if x < y:
            i += 1
            x += a_size[i]
        elif y < x:
            j += 1
            y += b_size[j]
        else:
            i, j = i + 1, j + 1
            out.append((tuple(a[i0:i]), tuple(b[j0:j])))
            if i == len(a):
                return out
            i0, j0 = i, j
            x, y = x + a_size[i], y + b_size[j]


class Column:
    """A numpy column that grows at its end."""

    def __init__(self):
        self.data, self.size = np.zeros(1024, np.int64), 0

    def extend(self, values) -> None:
        values = np.asarray(values, np.int64)
        while self.size + len(values) > len(self.data):
            self.data = np.concatenate((self.data, np.zeros(len(self.data), np.int64)))
        self.data[self.size : self.size + len(values)] = values
        self.size += len(values)


class Block:
    """Groups and links of the documents of one block; the parts that it has seen keep their groups."""

    WIDE = 1 << 16  # links of a group beyond which they aren't listed

    def __init__(self, encoders: Encoders):
        self.encoders = encoders
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}  # parts of texts without white space at a cut
        self.spaced: dict[str, tuple[int, ...]] = {}
        self.number: dict[tuple, int] = {}
        self.keys: list[str] = []
        self.n_a, self.n_b, self.start, self.count, self.pairs = Column(), Column(), Column(), Column(), Column()
        self.wide: set[int] = set()
        self.restart()

    def restart(self) -> None:
        """Begin the next block; groups keep their numbers."""
        self.docs, self.uses = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.extra: list[np.ndarray] = []
        self.extra_size = 0

    def full(self) -> bool:
        return len(self.known) + len(self.spaced) > 150_000 or len(self.keys) > 100_000

    def intern(self, group: tuple[tuple, tuple]) -> int:
        if (n := self.number.get(group)) is None:
            a, b = group
            n = self.number[group] = len(self.keys)
            self.keys.append(f"{','.join(map(str, a))}|{','.join(map(str, b))}")
            x, y = sorted(set(a)), sorted(set(b))
            if len(x) * len(y) > self.WIDE:
                self.wide.add(n)
                links = np.zeros(0, np.int64)
            else:
                links = [(i << 32) | j for i in x for j in y]
            self.n_a.extend([len(a)])
            self.n_b.extend([len(b)])
            self.start.extend([self.pairs.size])
            self.count.extend([len(links)])
            self.pairs.extend(links)
        return n

    def learn(self, parts: set[str], into: dict[str, tuple[int, ...]]) -> None:
        new = [p for p in parts if p not in into]
        for part, groups in zip(new, self.encoders.groups(new), strict=True):
            into[part] = (-1,) if groups is None else tuple(map(self.intern, groups))

    def read(self, texts: list[str | None]) -> Iterator[tuple]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, gids, times) of each text."""
        split: list[tuple[list[str], dict]] = []
        for text in texts:
            if not text:
                split.append(([], self.known))
            elif "\0" in text or not self.encoders.cuttable:
                split.append((CUT.split(f" {text}") if self.encoders.cuttable else [f" {text}"], self.spaced))
            else:
                split.append((f" {text}".replace(" ", "\0 ").replace("\n", "\0\n").split("\0")[1:], self.known))
        for k, (parts, into) in enumerate(split):  # white space before a cut could merge with what follows
            if into is self.known and any(not (len(p) > 1 and not p[-1].isspace()) for p in parts if p not in self.known):
                split[k] = (CUT.split(f" {texts[k]}"), self.spaced)
        for into in (self.known, self.spaced):
            self.learn(set().union(*[parts for parts, of in split if of is into]), into)
        for parts, into in split:
            yield self.count_document(list(chain.from_iterable(map(into.__getitem__, parts))))

    def count_document(self, order: list[int]) -> tuple:
        if not order or -1 in order:
            return 0, 0, 0, 0, "", b"", b""
        gids, times = np.unique(np.array(order, np.int64), return_counts=True)
        n_a, n_b = self.n_a.data[gids], self.n_b.data[gids]
        while len(self.docs) < len(self.keys):
            self.docs, self.uses = (np.concatenate((x, np.zeros(len(x), np.int64))) for x in (self.docs, self.uses))
        self.docs[gids] += 1
        self.uses[gids] += times
        for links in self.repeated(gids):
            self.extra.append(links)
            self.extra_size += len(links)
        if self.extra_size > 1_000_000:
            self.fold()
        digest = hashlib.sha256(";".join(map(self.keys.__getitem__, order)).encode()).hexdigest()
        sums = int((n_a * times).sum()), int((n_b * times).sum()), len(order), int((n_a * n_b * times).sum())
        return *sums, digest, np.diff(gids, prepend=0).astype("<i4").tobytes(), times.astype("<i4").tobytes()

    def repeated(self, gids: np.ndarray) -> Iterator[np.ndarray]:
        """Links of several of a document's distinct groups: each once less than it has groups."""
        if self.wide and not self.wide.isdisjoint(gids.tolist()):  # one A id at a time
            by_a = defaultdict(list)
            for n in gids.tolist():
                a, b = (np.unique(np.array(x.split(","), np.int64)) for x in self.keys[n].split("|"))
                for i in a.tolist():
                    by_a[i].append(b)
            for i, sides in by_a.items():
                links = np.sort(np.concatenate(sides))
                yield (i << 32) | links[1:][links[1:] == links[:-1]]
            return
        sizes = self.count.data[gids]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.start.data[gids] - ends + sizes, sizes)
        links = np.sort(self.pairs.data[at])
        yield links[1:][links[1:] == links[:-1]]

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        """The repeated links so far, each with its number; kept as they are."""
        links = np.sort(np.concatenate(self.extra)) if self.extra else np.zeros(0, np.int64)
        self.extra, self.extra_size = [links], 0
        return np.unique(links, return_counts=True)


def encode_blocks(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, block_chars: int) -> Iterator[pa.RecordBatch]:
    """Rows of ENCODED: documents (kind 0), and at each block's end its groups (1) and repeated links (2)."""
    from pyspark import TaskContext

    task = TaskContext.get()
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("block", pa.int64()), *[(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("gids", pa.binary()), ("times", pa.binary()), ("gid", pa.int32()), ("key", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int64()), ("uses", pa.int64())])
    block, number, chars = Block(encoders(a_path, b_path)), (task.partitionId() if task else 0) << 32, 0

    def rows(kind: int, size: int, columns: dict) -> pa.RecordBatch:
        columns = {"kind": np.full(size, kind, np.int32), "block": np.full(size, number, np.int64)} | columns
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    def ended() -> Iterator[pa.RecordBatch]:
        seen = np.flatnonzero(block.docs)
        for at in range(0, len(seen), 50_000):
            some = seen[at : at + 50_000]
            yield rows(1, len(some), {"gid": some, "key": [block.keys[n] for n in some.tolist()], "docs": block.docs[some], "uses": block.uses[some]})
        links, times = block.fold()
        for at in range(0, len(links), 50_000):
            some = links[at : at + 50_000]
            yield rows(2, len(some), {"a": some >> 32, "b": some & 0xFFFFFFFF, "docs": times[at : at + 50_000]})

    def counted(ids: list, texts: list) -> pa.RecordBatch:
        names = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "gids", "times")
        return rows(0, len(ids), {"doc_id": ids} | dict(zip(names, zip(*block.read(texts), strict=True), strict=True)))

    gc.disable()  # many tuples and no cycles: looking for cycles took a third of the time
    for batch in batches:
        ids, texts, held = [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            value = text.as_py()
            ids.append(doc_id)
            texts.append(value)
            held += len(value or "")
            if held > 500_000 or len(ids) >= 2_000:
                yield counted(ids, texts)
                chars += held
                ids, texts, held = [], [], 0
                if chars > block_chars or block.full():
                    yield from ended()
                    block.clear() if block.full() else block.restart()
                    number, chars = number + 1, 0
        if ids:
            yield counted(ids, texts)
            chars += held
    yield from ended()
    gc.enable()


def encoded(docs: DataFrame, a_path: str, b_path: str, text_col: str, block_chars: int) -> DataFrame:
    """The blocks' rows, written once to the shared folder: tokens are numbered as tasks come to them."""
    spark, path = docs.sparkSession, f"{shared_dir(docs.sparkSession)}/blocks-{uuid.uuid4()}"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = texts.mapInArrow(lambda batches: encode_blocks(batches, a_path, b_path, block_chars), ENCODED)
    blocks.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(ENCODED).parquet(path)


def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, docs, uses) of distinct groups as (key, docs, uses, a, b, times): a row for each pair of distinct ids of a group, in batches of bounded size."""
    names, held = ["key", "docs", "uses", "a", "b", "times"], []
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    for batch in batches:
        for key, docs, uses in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = (Counter(map(int, side.split(","))) for side in key.split("|"))
            for i, m in a.items():
                for j, n in b.items():
                    held.append((key, docs, uses, i, j, m * n))
                    if len(held) >= 20_000:
                        yield out()
                        held = []
    if held:
        yield out()


def dictionary(blocks: DataFrame) -> DataFrame:
    """(key, docs, uses, a, b, times): the links of each distinct group of all blocks, with the documents and places that have the group."""
    distinct = blocks.where("kind = 1").groupBy("key").agg(F.sum("docs").alias("docs"), F.sum("uses").alias("uses"))
    return materialize(distinct.mapInArrow(expand, "key string, docs long, uses long, a int, b int, times long"))


def link_counts(blocks: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b, n_docs, n_links) of each linked pair of ids: documents that hold it linked, and its links in all texts."""
    repeated = blocks.where("kind = 2").select("a", "b", (-F.col("docs")).alias("docs"), F.lit(0).cast("long").alias("links"))
    each = links.select("a", "b", "docs", (F.col("uses") * F.col("times")).alias("links")).unionByName(repeated)
    return each.groupBy("a", "b").agg(F.sum("docs").alias("n_docs"), F.sum("links").alias("n_links"))


def pair_table(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH, text_col: str = "text", block_chars: int = 1 << 23) -> DataFrame:
    """(a, b, n_docs, n_links): the id pairs that the corpus links, by documents and by occurrences."""
    blocks = encoded(docs, a_path, b_path, text_col, block_chars)
    return link_counts(blocks, dictionary(blocks))


def attach(docs: pa.Table, values: pa.Table) -> pa.Table:
    """A block's documents with the sums of what their groups add."""
    gid = values.column("gid").to_numpy()
    best, total = (np.zeros(int(gid.max()) + 1 if len(gid) else 0, np.int64) for _ in range(2))
    best[gid], total[gid] = values.column("best").to_numpy(), values.column("total").to_numpy()
    n_best, count_sum = [], []
    for gids, times in zip(docs.column("gids"), docs.column("times"), strict=True):
        at, n = np.cumsum(np.frombuffer(gids.as_py(), "<i4")), np.frombuffer(times.as_py(), "<i4").astype(np.int64)
        n_best.append(int((best[at] * n).sum()))
        count_sum.append(int((total[at] * n).sum()))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    return pa.table([*[docs.column(n) for n in names], pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), docs.column("groups_sha256")], names=[*names, "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH, text_col: str = "text", block_chars: int = 1 << 23) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row.

    The tokenizers' paths must be readable on every executor. Texts that are null or empty, or
    whose tokens' bytes aren't the text's (B can't tell U+2581 from a space), have no tokens:
    zeros and ''. Ties for an A id's highest count are all best. Repeated rows are documents of
    their own; rows without a doc_id too; other columns are ignored; an empty table gives no rows.
    A block has block_chars of text or so (it only bounds memory: sums don't depend on it).
    """
    blocks = encoded(docs, a_path, b_path, text_col, block_chars)
    links = dictionary(blocks)
    counts = link_counts(blocks, links).select("a", "b", "n_docs")
    highest = F.broadcast(counts.groupBy("a").agg(F.max("n_docs").alias("highest")))  # a row for each entry of A's vocabulary at most
    scored = counts.join(highest, "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("highest")).cast("long").alias("is_best"))
    values = links.join(scored, ["a", "b"]).groupBy("key").agg(F.sum(F.col("times") * F.col("is_best")).alias("best"), F.sum(F.col("times") * F.col("n_docs")).alias("total"))
    mine = blocks.where("kind = 1").select("key", F.col("block").alias("of_block"), "gid").join(values, "key").select("of_block", "gid", "best", "total")
    rows = blocks.where("kind = 0").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "gids", "times")
    return rows.groupBy("block").cogroup(mine.groupBy("of_block")).applyInArrow(attach, COUNTS)


def align_query(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
