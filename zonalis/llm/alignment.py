"""Alignment of two tokenizers over the same bytes, as an associative fold of fragments.

A text is encoded twice. Byte offsets where tokens of both sides end cut the tokens into groups; two
tokens are linked if their byte ranges overlap. A stretch of tokens is a ``Fragment``: an open prefix up to
its first such offset, the closed groups between its first and its last, and an open suffix after it.
``compose`` joins neighbours: the suffix of the left and the prefix of the right become one closed group.
It is associative, so a text may be cut anywhere.

How it runs: texts of up to ``RANGE`` bytes are encoded and closed in one narrow pass. Longer ones are cut
into byte ranges that different tasks encode: a task reads a little beyond its range, to the nearest blanks
between two visible characters, where both tokenizers surely begin anew (a byte-level pre-token ends there;
no piece has a blank after its start, which is checked), and keeps the tokens that end inside. Their
fragments are folded as a tree, ``FAN`` neighbours at a time. A stretch without such blanks stays in one
range, as it cannot be encoded in parts. Counts of id pairs are summed over documents, with a partial sum in
each task; the table of pairs is bounded by the vocabularies, and documents look theirs up in parts of at
most ``PART`` pairs, so no task holds more.

Defined cases: texts that are null, empty, or whose joined token bytes of either side differ from blank +
text have no tokens: zeros and ''. Repeated rows and repeated or null ids give one row each, and each
counts as a document. Very long texts: see above. An empty table gives no rows. Only the key and the text
are read, so extra columns, whatever their names, neither matter nor come back; a key named like a result
is an error.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from zonalis.llm.bpe import byte_letters
from zonalis.llm.common import python_ready, sliced, stored, table

#: Bytes of text that one task encodes of a long document.
RANGE = 1 << 15
#: Fragments folded at a time.
FAN = 8
#: Bytes of Arrow data that become Python objects at once.
SLICE = 1 << 20
#: Id pairs that a task looks up at once.
PART = 2_000_000
# Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


# tokenizers ------------------------------------------------------------------------------------
class ByteLevel:
    """Byte-level BPE file; its input is blank + text. Strings of special tokens are ordinary text.

    Where ids ascend with the merges, as here, the file's table goes into tiktoken, which merges by id and is several times
    faster than the file's own library; else that is used. A test compares both.
    """

    def __init__(self, path: str):
        as_byte = {c: b for b, c in byte_letters().items()}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        ranks = {bytes(as_byte[c] for c in s): i for s, i in ids.items()}
        of = {i: s for s, i in ranks.items()} | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.bytes_of = [of.get(i, b"") for i in range(max(of) + 1)]
        for t in spec["added_tokens"]:
            ranks.pop(t["content"].encode(), None)
        made = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        plain = spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["normalizer"] and len(ranks) == 256 + len(made)
        if plain and all(x < y for x, y in zip(made, made[1:])):
            import tiktoken
            self.ids = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer
            model = Tokenizer.from_file(path)
            model.encode_special_tokens = True
            model.no_padding()
            model.no_truncation()
            self.ids = lambda text: model.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.ids(" " + t) for t in texts]


class Pieces:
    """Sentence pieces; the model adds the blank before the text itself."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in names):
            raise ValueError(f"{path}: a piece has a blank after its start, so texts cannot be cut at blanks")
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                         for i, p in enumerate(names)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Pair:
    """Both tokenizers with the tables that aligning needs."""

    def __init__(self, a: str, b: str):
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.size_a, self.size_b = len(self.a.bytes_of), len(self.b.bytes_of)
        self.len_a, self.len_b = (np.array([len(x) for x in s.bytes_of], np.int64) for s in (self.a, self.b))
        #: how an id is written: of A before "," and "|", of B before "," and ";"
        self.written = [f"{i}{mark}" for n, marks in ((self.size_a, ",|"), (self.size_b, ",;")) for mark in marks for i in range(n)]

    def encode(self, texts: list[str]) -> tuple[list, list, list[bool]]:
        """Ids of both sides and whether both give back blank + text."""
        ids_a, ids_b = self.a.encode(texts), self.b.encode(texts)
        ok = []
        for t, x, y in zip(texts, ids_a, ids_b):
            raw = (" " + t).encode()
            ok.append(b"".join(map(self.a.bytes_of.__getitem__, x)) == raw and b"".join(map(self.b.bytes_of.__getitem__, y)) == raw)
        return ids_a, ids_b, ok


@lru_cache(2)
def pair(a: str, b: str) -> Pair:
    return Pair(a, b)


# fragments -------------------------------------------------------------------------------------
NONE = np.zeros(0, np.int64)


@dataclass(frozen=True)
class Tokens:
    """Tokens of both sides that lie side by side: ids and the byte each one ends at."""

    a: np.ndarray = field(default_factory=lambda: NONE)
    a_end: np.ndarray = field(default_factory=lambda: NONE)
    b: np.ndarray = field(default_factory=lambda: NONE)
    b_end: np.ndarray = field(default_factory=lambda: NONE)

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(*[np.concatenate([getattr(self, c), getattr(other, c)]) for c in ("a", "a_end", "b", "b_end")])

    def within(self, low: int, high: int) -> Tokens:
        """Those that end after low and not after high."""
        x, y = (slice(*np.searchsorted(e, (low, high), side="right")) for e in (self.a_end, self.b_end))
        return Tokens(self.a[x], self.a_end[x], self.b[y], self.b_end[y])


@dataclass(frozen=True)
class Closed:
    """Whole groups: their text, and the id pairs linked in them with the number of their links."""

    text: str = ""
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    pairs: np.ndarray = field(default_factory=lambda: NONE)
    times: np.ndarray = field(default_factory=lambda: NONE)

    def __add__(self, other: Closed) -> Closed:
        if not self.n_groups or not other.n_groups:
            return self if self.n_groups else other
        return Closed(f"{self.text};{other.text}", self.n_a + other.n_a, self.n_b + other.n_b, self.n_groups + other.n_groups,
                      *summed(np.r_[self.pairs, other.pairs], np.r_[self.times, other.times]))


@dataclass(frozen=True)
class Fragment:
    """``closed`` is None where no offset ends a token of both sides; all tokens are in ``prefix`` then."""

    prefix: Tokens
    closed: Closed | None = None
    suffix: Tokens = field(default_factory=Tokens)
    ok: bool = True


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their times."""
    if not len(keys):
        return NONE, NONE
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(times[order], first)


def closed_groups(t: Tokens, tables: Pair, start: int, ends: np.ndarray) -> list[Closed]:
    """One entry per stretch that ends at ``ends``; both sides have a token that ends there. The first begins at ``start``."""
    if not len(ends):
        return []
    x, y = t.a_end - start - 1, t.b_end - start - 1
    total = int(ends[-1] - start)
    mark_a, mark_b = np.zeros(total, np.int32), np.zeros(total, np.int32)
    mark_a[x], mark_b[y] = 1, 1
    both = mark_a & mark_b
    upto = np.cumsum(both, dtype=np.int32)
    group_a, group_b = upto[x] - both[x], upto[y] - both[y]
    n = int(upto[-1])
    in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    before_a, before_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    # tokens in the order they are written in: of each group those of A, then those of B
    at_a, at_b = np.arange(len(x)) + before_b[group_a], np.arange(len(y)) + (before_a + in_a)[group_b]
    last_a, last_b = np.r_[group_a[1:] != group_a[:-1], True], np.r_[group_b[1:] != group_b[:-1], True]
    names = np.empty(len(x) + len(y), np.int64)
    names[at_a] = t.a + last_a * tables.size_a
    names[at_b] = t.b + last_b * tables.size_b + 2 * tables.size_a
    written = list(map(tables.written.__getitem__, names.tolist()))
    # every stretch between neighbouring ends of either side is one link
    link = np.flatnonzero(mark_a | mark_b)
    of_a, of_b = np.cumsum(mark_a)[link] - mark_a[link], np.cumsum(mark_b)[link] - mark_b[link]
    key = t.a[of_a] * tables.size_b + t.b[of_b]
    part = np.searchsorted(ends - start - 1, link)
    span = tables.size_a * tables.size_b
    found, times = np.unique(part * span + key, return_counts=True)
    found_at = np.searchsorted(found, np.arange(len(ends) + 1) * span)
    key = found % span
    groups = np.r_[0, upto[ends - start - 1]]
    tokens_a, tokens_b = np.r_[before_a, len(x)][groups], np.r_[before_b, len(y)][groups]
    out = []
    for k in range(len(ends)):
        some = slice(found_at[k], found_at[k + 1])
        text = "".join(written[tokens_a[k] + tokens_b[k]:tokens_a[k + 1] + tokens_b[k + 1]])[:-1]
        out.append(Closed(text, int(tokens_a[k + 1] - tokens_a[k]), int(tokens_b[k + 1] - tokens_b[k]), int(groups[k + 1] - groups[k]),
                          key[some], times[some]))
    return out


def fragment(t: Tokens, tables: Pair, ok: bool = True) -> Fragment:
    cuts = np.intersect1d(t.a_end, t.b_end, assume_unique=True)
    if not len(cuts):
        return Fragment(t, ok=ok)
    first, last = int(cuts[0]), int(cuts[-1])
    inner = closed_groups(t.within(first, last), tables, first, np.array([last])) if last > first else [Closed()]
    return Fragment(t.within(-1, first), inner[0], t.within(last, 1 << 62), ok)


def _one(t: Tokens, tables: Pair) -> Closed:
    """The tokens as one whole group."""
    low = min(t.a_end[0], t.b_end[0]) - 1
    return closed_groups(t, tables, int(low), t.a_end[-1:])[0]


def compose(x: Fragment, y: Fragment, tables: Pair) -> Fragment:
    """The fragment of two neighbouring stretches. Associative."""
    ok = x.ok and y.ok
    if not ok:
        return Fragment(Tokens(), ok=False)                # the text has no tokens then
    if x.closed is None:
        return replace(y, prefix=x.prefix + y.prefix)
    if y.closed is None:
        return replace(x, suffix=x.suffix + y.prefix)
    return Fragment(x.prefix, x.closed + _one(x.suffix + y.prefix, tables) + y.closed, y.suffix)


def whole(f: Fragment, tables: Pair) -> Closed | None:
    """What a whole text gives; None where it has no tokens."""
    if not f.ok or f.closed is None or len(f.suffix.a) or len(f.suffix.b):
        return None
    return _one(f.prefix, tables) + f.closed


# texts -----------------------------------------------------------------------------------------
def _visible(c: str) -> bool:
    return bool(c) and ("!" <= c <= "~" or c.isalpha())


def _safe(raw: bytes, i: int) -> bool:
    """Whether both tokenizers begin a token at byte i: a blank between two visible characters."""
    return (raw[i:i + 1] == b" " and _visible(raw[max(0, i - 4):i].decode("utf-8", "ignore")[-1:])
            and _visible(raw[i + 1:i + 5].decode("utf-8", "ignore")[:1]))


def _near(raw: bytes, at: int, step: int, reach: int) -> int | None:
    """The nearest such byte from ``at``, forwards (step 1) or backwards, at most ``reach`` away."""
    k = at
    while 0 <= k < len(raw) and abs(k - at) <= reach:
        k = raw.find(b" ", k) if step > 0 else raw.rfind(b" ", 0, k + 1)
        if k < 0 or abs(k - at) > reach:
            return None
        if _safe(raw, k):
            return k
        k += step
    return None


def ranges(raw: bytes, size: int = RANGE) -> list[tuple[int, int, int, int]]:
    """(from, to, low, high): tokens that end in (low, high] are found by encoding the bytes from..to."""
    out, low, begin = [], 0, 0
    for b in range(size, len(raw), size):
        left, right = _near(raw, b, -1, size // 2), _near(raw, b, 1, size // 2)
        if left is not None and right is not None and left > 0:
            out.append((begin, right, low, b))
            low, begin = b, left
    return [*out, (begin, len(raw), low, len(raw))]


def _tokens(tables: Pair, ids_a: list, ids_b: list, start: int = 0) -> Tokens:
    a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
    return Tokens(a, start + np.cumsum(tables.len_a[a]), b, start + np.cumsum(tables.len_b[b]))


def closed_texts(texts: list[str], tables: Pair) -> list[Closed | None]:
    """Many short texts at once, laid end to end."""
    full = [t for t in texts if t]
    ids_a, ids_b, ok = tables.encode(full) if full else ([], [], [])
    good = [k for k, x in enumerate(ok) if x]
    t = _tokens(tables, [i for k in good for i in ids_a[k]], [i for k in good for i in ids_b[k]])
    ends = np.cumsum([len(full[k].encode()) + 1 for k in good], dtype=np.int64)
    found = dict(zip(good, closed_groups(t, tables, 0, ends)))
    at = iter(range(len(full)))
    return [found.get(next(at)) if x else None for x in texts]


def range_fragment(stretch: str, start: int, low: int, high: int, tables: Pair) -> Fragment:
    """Fragment of the tokens that end in (low, high] of a stretch that begins at byte ``start`` with a blank."""
    ids_a, ids_b, ok = tables.encode([stretch[1:]])
    if not ok[0]:
        return Fragment(Tokens(), ok=False)
    return fragment(_tokens(tables, ids_a[0], ids_b[0], start).within(low, high), tables)


# Spark -----------------------------------------------------------------------------------------
TOLD = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
PARTS = "_row long, node long, ok boolean, cut boolean, pre binary, suf binary, text string, n_a long, n_b long, n_groups long, pairs binary, times binary"


def _told(c: Closed | None) -> tuple:
    if c is None:
        return 0, 0, 0, 0, "", b"", b""
    return (c.n_a, c.n_b, c.n_groups, int(c.times.sum()), hashlib.sha256(c.text.encode()).hexdigest(),
            c.pairs.astype("<i8").tobytes(), c.times.astype("<i4").tobytes())


def _ints(blob: bytes | None, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(blob or b"", kind).astype(np.int64)


def _pack(t: Tokens) -> bytes:
    return np.concatenate([[len(t.a)], t.a, t.a_end, t.b, t.b_end]).astype("<i8").tobytes()


def _unpack(blob: bytes) -> Tokens:
    x = _ints(blob)
    n = int(x[0])
    m = (len(x) - 1 - 2 * n) // 2
    return Tokens(x[1:1 + n], x[1 + n:1 + 2 * n], x[1 + 2 * n:1 + 2 * n + m], x[1 + 2 * n + m:])


def _written(row: int, node: int, f: Fragment) -> tuple:
    c = f.closed or Closed()
    return (row, node, f.ok, f.closed is not None, _pack(f.prefix), _pack(f.suffix), c.text, c.n_a, c.n_b, c.n_groups,
            c.pairs.astype("<i8").tobytes(), c.times.astype("<i8").tobytes())


def _fragment_of(r: dict) -> Fragment:
    c = Closed(r["text"], r["n_a"], r["n_b"], r["n_groups"], _ints(r["pairs"]), _ints(r["times"])) if r["cut"] else None
    return Fragment(_unpack(r["pre"]), c, _unpack(r["suf"]), r["ok"])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], names=schema.names)


def documents(docs: DataFrame, a: str, b: str, text: str = "text", key: str = "doc_id", size: int = RANGE) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times), one row per row of ``docs``."""
    python_ready(docs.sparkSession)
    body = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    kind = body.schema["_key"].dataType.simpleString()
    long_text = F.coalesce(F.octet_length("_text") >= size, F.lit(False))
    schema = to_arrow_schema(StructType.fromDDL(f"_key {kind}, {TOLD}"))
    parts = to_arrow_schema(StructType.fromDDL(f"_key {kind}, {PARTS}"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = pair(a, b)
        for batch in batches:
            for some in sliced([batch], SLICE):
                told = [_told(c) for c in closed_texts(some.column(1).to_pylist(), tables)]
                yield pa.RecordBatch.from_arrays([some.column(0), *[pa.array(c, t) for c, t in zip(zip(*told), schema.types[1:])]], names=schema.names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in sliced([batch], SLICE):
                rows = []
                for k, t, row in zip(*[c.to_pylist() for c in some.columns]):
                    raw = (" " + t).encode()
                    rows += [(k, row, n, len(raw), *r, raw[r[0]:r[1]].decode()) for n, r in enumerate(ranges(raw, size))]
                yield _batch(rows, cuts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = pair(a, b)
        for batch in batches:
            for some in sliced([batch], SLICE):
                yield _batch([(r["_key"], *_written(r["_row"], r["node"], range_fragment(r["stretch"], r["start"], r["low"], r["high"], tables)))
                              for r in some.to_pylist()], parts)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held, at, key_ = pair(a, b), None, None, None
        for batch in batches:
            for some in sliced([batch], SLICE):
                done = []
                for r in some.to_pylist():
                    place, f = (r["_row"], r["node"] // FAN), _fragment_of(r)
                    if place == at:
                        held = compose(held, f, tables)
                        continue
                    if at is not None:
                        done.append((key_, *_written(*at, held)))
                    at, held, key_ = place, f, r["_key"]
                yield _batch(done, parts)
        if at is not None:
            yield _batch([(key_, *_written(*at, held))], parts)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = pair(a, b)
        for batch in batches:
            for some in sliced([batch], SLICE):
                yield _batch([(r["_key"], *_told(whole(_fragment_of(r), tables))) for r in some.to_pylist()], schema)

    told = f"_key {kind}, {TOLD}"
    done = body.where(~long_text).mapInArrow(short, told)
    cuts_ddl = f"_key {kind}, _row long, node long, n_bytes long, start long, stop long, low long, high long, stretch string"
    cuts = to_arrow_schema(StructType.fromDDL(cuts_ddl))
    pieces = body.where(long_text).withColumn("_row", F.monotonically_increasing_id()).mapInArrow(cut, cuts_ddl)
    tree = stored(pieces.repartition("_row", "node").mapInArrow(encode, f"_key {kind}, {PARTS}"), "fragments")
    most = tree.agg(F.max("node")).first()[0]
    while most:                                            # neighbours of a text side by side, FAN to one
        near = tree.repartition("_row", F.floor(F.col("node") / FAN)).sortWithinPartitions("_row", "node")
        tree, most = stored(near.mapInArrow(fold, f"_key {kind}, {PARTS}"), "fragments"), most // FAN
    return stored(done.unionByName(tree.mapInArrow(close, told)).withColumnRenamed("_key", key), "aligned")


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): in how many documents an id pair is linked, and whether no pair of its A id has more."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, size = (NONE, NONE), [], 0

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in held], ["pair", "n"])

        def merge() -> tuple[np.ndarray, np.ndarray]:
            keys, n = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (NONE, NONE)
            return summed(np.r_[held[0], keys], np.r_[held[1], n])

        for batch in batches:
            for some in sliced([batch]):
                waiting += [np.frombuffer(x, "<i8") for x in some.column(0).to_pylist() if x]
                size = sum(map(len, waiting))
                if size >= PART // 2:
                    held, waiting = merge(), []
                    if len(held[0]) >= PART // 2:          # bounded: the rest of the sum is Spark's
                        yield emit()
                        held = (NONE, NONE)
        held = merge()
        yield emit()

    summed_up = aligned.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    # at most as many rows of one A id as B has ids
    most = F.max("n").over(Window.partitionBy(F.floor(F.col("pair") / size_b)))
    return stored(summed_up.withColumn("best", F.col("n") == most), "pair-counts")


def align(docs: DataFrame, a: str, b: str, text: str = "text", key: str = "doc_id", size: int = RANGE, part: int = PART) -> DataFrame:
    """The key and ``RESULTS`` of every row: tokens, groups and links, the links whose count is the highest
    of their A id, the sum of the counts over the links, and the hash of the groups."""
    if key in RESULTS or key in ("pairs", "times"):
        raise ValueError(f"the key cannot be named {key}")
    spark = docs.sparkSession
    aligned = documents(docs, a, b, text, key, size)
    counts = pair_counts(aligned, pair(a, b).size_b)
    n = max(1, -(-counts.count() // part))
    rows = aligned.withColumn("_row", F.monotonically_increasing_id())       # of files written once
    shown = [key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    looked = [_looked_up(rows, counts.where(F.pmod(F.xxhash64("pair"), F.lit(n)) == k), shown) for k in range(n)]
    if n == 1:
        return looked[0].select(key, *RESULTS)
    every = looked[0]
    for other in looked[1:]:
        every = every.unionByName(other)
    return (every.groupBy("_row").agg(*[F.any_value(c).alias(c) for c in shown], F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
            .select(key, *RESULTS))


def _looked_up(rows: DataFrame, counts: DataFrame, shown: list[str]) -> DataFrame:
    """``rows`` with n_best and count_sum over the pairs of one part (at most about ``PART`` rows of 17 bytes)."""
    t = counts.select("pair", "n", "best").orderBy("pair").toArrow()
    shared = rows.sparkSession.sparkContext.broadcast(tuple(t.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")) if t.num_rows else None)
    schema = StructType([rows.schema[c] for c in shown] + StructType.fromDDL("_row long, n_best long, count_sum long").fields)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in sliced([batch]):
                pairs, times = ([np.frombuffer(x or b"", k) for x in some.column(c).to_pylist()] for c, k in (("pairs", "<i8"), ("times", "<i4")))
                n = list(map(len, pairs))
                best = total = np.zeros(len(n), np.int64)
                if shared.value is not None and sum(n):
                    keys, count, top = shared.value
                    p, t = np.concatenate(pairs), np.concatenate(times).astype(np.int64)
                    at = np.minimum(np.searchsorted(keys, p), len(keys) - 1)
                    there = keys[at] == p
                    ends = np.r_[0, np.cumsum(n)]
                    best, total = (np.diff(np.r_[0, np.cumsum(np.where(there, x, 0))][ends]) for x in (t * top[at], t * count[at]))
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in (*shown, "_row")], pa.array(best, pa.int64()), pa.array(total, pa.int64())],
                                                 names=schema.names)

    return rows.mapInArrow(look, schema)


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    import public_tokenizers
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
