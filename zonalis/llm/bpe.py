"""Byte-level BPE encoding and decoding.

A text is cut into pre-tokens; each distinct pre-token is encoded by a priority queue of merge
ranks over a doubly linked list of symbols. A merge leaves stale entries in the queue; they are
skipped when they come up. Decoding concatenates the byte strings of the vocabulary.

The work of a row depends on nothing but the row, so it is one narrow pass without a shuffle.
Python workers keep the vocabulary and a bounded cache of encoded pre-tokens between tasks.

Defined cases: a null text counts as empty (no ids, decoded to ""); a text that holds the string of
an added token gets that token's id there, as the tokenizer file says; very long texts are encoded
whole. Columns of the input other than the text are kept as they are.
"""

from __future__ import annotations

import gc
import hashlib
import json
from collections.abc import Callable
from functools import lru_cache
from heapq import heapify, heappop, heappush, heapreplace
from operator import add, getitem
from struct import Struct, pack

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from zonalis.llm.common import append, table

#: Encoded pieces that one Python worker keeps in each of two generations.
CACHE = 200_000
#: Ids that are decoded at once.
DECODED = 1 << 14

# The pre-token pattern of byte-level BPE (white space as Unicode defines it).
SPACE = r"\p{White_Space}"
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|{SPACE}+(?![^{SPACE}])|{SPACE}+"


def byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


# The white space characters, blank excepted.
ASCII_SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f"
OTHER_SPACES = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES, SPACES_WIDE = " " + ASCII_SPACES, " " + ASCII_SPACES + OTHER_SPACES
BESIDE = [x for c in ASCII_SPACES for x in (f" {c}", f"{c} ")] + ["  "]
BESIDE_WIDE = BESIDE + [x for c in OTHER_SPACES for x in (f" {c}", f"{c} ")]


# Marks that stand behind words; all are one class of the pattern and none begins a contraction.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# Bits of the place in an entry of the queue, in words of usual and of any length (numbers below 2^30 are
# compared fastest); lists of usual words, made once.
BITS, BITS_WIDE = 14, 40
NOTHING: dict[int, int] = {}
PLACES, BEFORE, AFTER = range(64), list(range(-1, 64)), list(range(1, 66))
PACK = [Struct(f"<{n}I").pack for n in range(33)]


def blanks(text: str) -> bool:
    """Whether some blank has white space or the end of the text beside it."""
    plain = text.isascii()
    if len(text.split()) == 1 + sum(text.count(c) for c in (SPACES if plain else SPACES_WIDE) if c in text):
        return False                                       # every stretch of white space is one character
    return text[0] == " " or text[-1] == " " or any(map(text.__contains__, BESIDE if plain else BESIDE_WIDE))


class Cache(dict):
    """Encoded pieces of text: two generations, so that what is met often stays while memory is bounded."""

    def __init__(self, compute: Callable[[str], bytes]):
        super().__init__()
        self.compute, self.old = compute, {}

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            got = self.compute(piece)
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = got
        return got


class Pieces(Cache):
    """Encoded pieces after a blank. What seldom comes again, words with marks behind them and what goes over
    the end of a line, is put together from its parts each time, so that the cache has room for words."""

    def __init__(self, compute: Callable[[str], bytes], bare: Cache):
        super().__init__(compute)
        self.bare = bare

    def __missing__(self, piece: str) -> bytes:
        word = piece.rstrip(MARKS)
        if len(word) < len(piece) and word.isalpha():
            return self[word] + self.bare[piece[len(word):]]
        if "\n" in piece:
            return self.compute(piece)
        return super().__missing__(piece)


class Encoder:
    """Vocabulary and merge ranks of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, kind = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level BPE")
        letters = byte_letters()
        as_byte = {c: b for b, c in letters.items()}
        ids = model["vocab"]
        self.first = [ids[letters[b]] for b in range(256)]
        size = max(ids.values()) + 1
        #: by left id: right id -> rank (the last for no symbol at all); by rank the id of the merged symbol
        self.ranks, self.merged = [NOTHING] * (size + 1), []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            if self.ranks[ids[left]] is NOTHING:
                self.ranks[ids[left]] = {}
            self.ranks[ids[left]][ids[right]] = rank
            self.merged.append(ids[left + right])
        #: by two bytes: entry of the queue for place 0, without a merge one that comes after all others
        self.pairs = [[self.ranks[x].get(y, len(self.merged)) << BITS for y in self.first] for x in self.first]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(as_byte[c] for c in s) for s, i in ids.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        #: the same as one array, with the length and the start of every id
        strings = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.lengths = np.array(list(map(len, strings)))
        self.starts, self.joined = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(strings), "u1")
        self.pretokens = regex.compile(PRETOKEN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        #: by the piece without the blank before it, and by pre-tokens as they are
        self.bare = Cache(self.symbols)
        self.after_blank = Pieces(lambda p: self.symbols(" " + p) if p.isalpha() else self.words(" " + p), self.bare)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: merges by rank, leftmost first among equals.

        An entry of the queue is the rank, then the place of the left symbol in the last bits. It is stale
        if ``newest`` has another one for that place. Behind the last symbol, and so before the first one
        too, stands one that merges with nothing.
        """
        ids = list(map(self.first.__getitem__, word))
        n = len(ids)
        entries = map(getitem, map(self.pairs.__getitem__, word), word[1:])
        if n < len(AFTER):
            bits, newest, before, after = BITS, list(map(add, entries, PLACES)), BEFORE[:n + 1], AFTER[:n + 1]
        else:
            bits, before, after = BITS_WIDE, list(range(-1, n)), list(range(1, n + 2))
            newest = [(x << BITS_WIDE - BITS) + i for i, x in enumerate(entries)]
        queue = newest.copy()
        heapify(queue)
        ids.append(-1)
        newest += None, None
        ranks, merges, mask = self.ranks, self.merged, (1 << bits) - 1
        end = len(merges) << bits
        while queue and (entry := queue[0]) < end:
            i = entry & mask
            if newest[i] != entry:
                heappop(queue)
                continue
            ids[i] = symbol = merges[entry >> bits]
            j = after[i]
            ids[j] = newest[j] = None
            k = after[i] = after[j]
            before[k] = i
            h = before[i]
            with_left, with_right = ranks[ids[h]].get(symbol), ranks[symbol].get(ids[k])
            if with_right is None:
                newest[i] = None
                if with_left is None:
                    newest[h] = None
                    heappop(queue)
                else:
                    newest[h] = entry = with_left << bits | h
                    heapreplace(queue, entry)
            else:
                newest[i] = entry = with_right << bits | i
                heapreplace(queue, entry)
                if with_left is None:
                    newest[h] = None
                else:
                    newest[h] = entry = with_left << bits | h
                    heappush(queue, entry)
        del ids[-1]
        return [i for i in ids if i is not None]

    def symbols(self, word: str) -> bytes:
        """Ids of one pre-token (little-endian, 32 bits each)."""
        ids = self.merge(word.encode())
        n = len(ids)
        return PACK[n](*ids) if n < len(PACK) else pack(f"<{n}I", *ids)

    def words(self, text: str) -> bytes:
        """Ids of a text cut by the pattern alone."""
        words = self.pretokens(text)
        if len(words) == 1:
            return self.symbols(text)
        return b"".join([self.after_blank[w[1:]] if w[0] == " " and len(w) > 1 and not w[1].isspace() else self.bare[w] for w in words])

    def ordinary(self, text: str) -> bytes:
        """Ids of a text without added tokens.

        A blank between two characters that are no white space starts a new pre-token whatever
        surrounds it. Such texts are cut there and the pattern runs only over pieces not met before.
        """
        if not text:
            return b""
        head, *pieces = text.split(" ")
        if blanks(text):                                   # join what has no such blank between
            whole = [head]
            for p in pieces:
                if p and whole[-1] and not p[0].isspace() and not whole[-1][-1].isspace():
                    whole.append(p)
                else:
                    whole[-1] += " " + p
            head, *pieces = whole
        return self.words(head) + b"".join(map(self.after_blank.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        if not self.cut or not any(s in text for s in self.added):
            return self.ordinary(text)
        return b"".join([np.array([self.added[p]], "<u4").tobytes() if p in self.added else self.ordinary(p)
                         for p in self.cut.split(text)])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def decode_own(self, ids: np.ndarray) -> str:
        """As ``decode``, for ids that come from this encoder (others are not looked for)."""
        out = []
        for at in range(0, len(ids), DECODED):
            part = ids[at:at + DECODED]
            n = self.lengths[part]
            places = np.repeat(self.starts[part] - np.cumsum(n) + n, n)
            places += np.arange(len(places))
            out.append(self.joined[places].tobytes())
        return b"".join(out).decode("utf-8", "replace")


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """The encoder of a file, loaded once per Python worker."""
    e = Encoder(path)
    gc.freeze()                                            # the tables stay; no collection needs to walk them
    return e


def encode(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Append the token ids of a text column as an array of integers."""
    def work(texts: list) -> list:
        e = encoder(tokenizer)
        return [[np.frombuffer(e.encode(t or ""), "<i4") for t in texts]]
    return append(docs, [text], f"`{out}` array<int>", work)


def decode(rows: DataFrame, tokenizer: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Append the text of an id column; a null list counts as empty. An id outside the vocabulary is an error."""
    def work(lists: list) -> list:
        e = encoder(tokenizer)
        return [[e.decode(x or []) for x in lists]]
    return append(rows, [ids], f"`{out}` string", work)


def round_trip(docs: DataFrame, tokenizer: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Append n_tokens, ids_sha256 and decoded_sha256 of a text column, and the ids if asked for."""
    def work(texts: list) -> list:
        e = encoder(tokenizer)
        cols: list[list] = [[], [], [], []]
        for t in texts:
            raw = e.encode(t or "")
            ids = np.frombuffer(raw, "<i4")
            cols[0].append(len(ids))
            cols[1].append(hashlib.sha256(raw).hexdigest())
            cols[2].append(hashlib.sha256(e.decode_own(ids).encode()).hexdigest())
            cols[3].append(ids)
        return cols if keep_ids else cols[:3]
    return append(docs, [text], "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids, work)


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, default_tokenizer()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
