"""Byte-level byte-pair encoding: merging by heap and linked list, token counts, encoding, decoding."""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Fixed value of the byte-level format: how a text falls into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Letters, numbers and white space of Latin-1, where the standard engine is much the faster one.
LATIN_LETTERS, LATIN_NUMBERS, LATIN_SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"

#: Fixed value: ranges (hexadecimal) that the regex package's newer Unicode calls letters or
#: numbers and the tokenizers library doesn't know as such yet.
LATER = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959
10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8
16ebb-16ed3 16ff2-16ff3 16ff4-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2
1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5
1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""


def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for letters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Vocabulary and merges of one tokenizer file (JSON with a byte-level BPE model)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level BPE without normalizer and prefix space is known")
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(s): i for s, i in model["vocab"].items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(raw(a), raw(b)): r for r, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        later = "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in LATER.split())
        latin = WORDS.replace(r"\P{White_Space}", f"[^{LATIN_SPACES}]").replace(r"[^\p{White_Space}\p{L}\p{N}]", f"[^{LATIN_SPACES}{LATIN_LETTERS}{LATIN_NUMBERS}]")
        latin = latin.replace(r"\p{L}", f"[{LATIN_LETTERS}]").replace(r"\p{N}", f"[{LATIN_NUMBERS}]").replace(r"\p{White_Space}", f"[{LATIN_SPACES}]")
        self.latin = re.compile(latin)
        self.plain, self.later = regex.compile(WORDS), regex.compile(f"[{later}]")
        exact = WORDS.replace(r"[^\p{White_Space}\p{L}\p{N}]", rf"(?:[{later}]|[^\p{{White_Space}}\p{{L}}\p{{N}}])")
        self.exact = regex.compile(exact.replace(r"\p{L}+", rf"(?:(?![{later}])\p{{L}})+").replace(r"\p{N}+", rf"(?:(?![{later}])\p{{N}})+"))
        names = sorted(self.special, key=lambda s: (-len(s), s))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def words(self, text: str) -> list[str]:
        """The words of a section; together they are the section."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return (self.exact if self.later.search(text) else self.plain).findall(text)
        return self.latin.findall(text)

    def symbols(self, word: bytes) -> tuple[list[bytes | None], int]:
        """Symbols left after merging (None where one was merged away), and the number of merges.

        The adjacent pair with the lowest rank, leftmost first, is popped from
        a heap; entries that no longer name two live neighbours are skipped.
        """
        n = len(word)
        part: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        if n < 2:
            return part, 0
        ranks, after, before = self.ranks, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := ranks.get((part[i], part[i + 1]))) is not None]
        heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            joined = a + b
            part[i], part[j] = joined, None
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((joined, part[k]))) is not None:
                    heappush(heap, (r, i, joined, part[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get((part[h], joined))) is not None:
                heappush(heap, (r, h, part[h], joined))
        return part, merges

    def count(self, word: str) -> int:
        raw = word.encode()
        return len(raw) - self.symbols(raw)[1]

    def encode_word(self, word: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        ids = self.ids
        return b"".join(ids[s].to_bytes(4, "little") for s in self.symbols(word.encode())[0] if s is not None)

    def sections(self, text: str) -> list[tuple[bool, str]]:
        """The text between special strings, and those strings (True)."""
        if self.cut is None or not self.cut.search(text):
            return [(False, text)]
        return [(bool(i % 2), s) for i, s in enumerate(self.cut.split(text)) if s]


@lru_cache(4)
def loaded(path: str) -> Bpe:
    """One copy in each worker process."""
    return Bpe(path)


class Cache(dict):
    """Word -> result, worked out when first asked for; emptied when it holds ``limit`` words, and without words of over ``longest`` characters (results don't depend on either)."""

    def __init__(self, make, limit: int, longest: int = 64):
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, word: str):
        if len(self) >= self.limit:
            self.clear()
        out = self.make(word)
        if len(word) <= self.longest:
            self[word] = out
        return out


_caches: dict[tuple, dict] = {}


def _texts(column: pa.Array) -> Iterator[str]:
    return (x or "" for x in column.to_pylist())


def _counting(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        of = _caches.setdefault(("count", path), Cache(bpe.count, limit)).__getitem__
        for batch in small_batches(batches):
            out = []
            for text in _texts(batch.column(1)):
                out.append(sum(1 if special else sum(map(of, bpe.words(s))) for special, s in bpe.sections(text)))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(out, pa.int64())], ["id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", cache_words: int = 200_000) -> DataFrame:
    """``id, n_bytes, n_tokens`` for each row: tokens are initial symbols (bytes) minus merges, summed over words.

    Null texts count as empty (0, 0); special strings in a text are one token
    each, as is the library's default; one word of any length is merged in
    n log n steps.  Workers keep up to ``cache_words`` counts of words at hand.
    Repeated rows give repeated results, other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(_counting(path, cache_words), f"id {kind}, n_bytes long, n_tokens long")


class Numbers(dict):
    """Word -> its number in the block, in order of first use."""

    size = 0

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.size += len(word)
        return n


def pack(a: np.ndarray) -> bytes:
    """Whole numbers of 32 bits, compressed: their low bytes first, then the next ones."""
    planes = np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(a).to_bytes(4, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:4], "little")
    planes = np.frombuffer(pa.decompress(b[4:], 4 * n, "zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<i4").reshape(-1)


def _splitting(path: str, texts: bool, most_words: int, most_text: int, chunk: int = 1 << 18):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, at, nth = loaded(path), TaskContext.get().partitionId(), 0
        numbers, read, ids, places, n, done = Numbers(), 0, [], [], 0, []

        def close_chunk() -> None:
            nonlocal ids, places, n
            if ids:
                done.append((pa.concat_arrays(ids), pack(np.array(list(map(len, places)), np.int32)), pack(np.concatenate(places))))
            ids, places, n = [], [], 0

        def close_block() -> Iterator[pa.RecordBatch]:
            nonlocal numbers, read, nth, done
            close_chunk()
            words = list(numbers)
            whole = xxhash.xxh64(at.to_bytes(8, "little") + nth.to_bytes(8, "little"))
            for word in words:
                whole.update(word.encode() + b"\0")
            block = pa.array(np.array([whole.intdigest()], np.uint64).view(np.int64))
            for rows, sizes, packed in done:
                listed = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
                yield pa.record_batch([block, listed, pa.array([sizes]), pa.array([packed])], ["block", "ids", "sizes", "places"])
            for i in range(0, 0 if texts else len(words), 20_000):
                yield pa.record_batch([block, pa.array([i], pa.int32()), pa.array([words[i : i + 20_000]])], ["block", "first", "words"])
            numbers, read, done, nth = Numbers(), 0, [], nth + 1

        for batch in small_batches(batches):
            for text in _texts(batch.column(1)):
                words = [w for special, s in bpe.sections(text) for w in ([s] if special else bpe.words(s))]
                if texts:
                    places.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                else:
                    deque(map(numbers.__getitem__, words), 0)
                n, read = n + len(words), read + len(text)
            if texts:
                ids.append(batch.column(0))
                if n >= chunk:
                    close_chunk()
            if len(numbers) >= most_words or numbers.size >= most_text or read >= most_text:
                yield from close_block()
        yield from close_block()

    return run


def split_words(docs: DataFrame, path: str, texts: bool, id_col: str = "doc_id", text_col: str = "text", most_words: int = 400_000, most_text: int = 1 << 24) -> DataFrame:
    """Texts as numbered words, in blocks.

    ``texts``: rows ``block, ids, sizes, places`` with some texts of the block,
    each one's number of words, and the words' numbers in order (packed).
    Otherwise: rows ``block, first, words`` with the words of the block, each
    once, the first of them with number ``first``.  A block ends with its task,
    or at ``most_words`` words or ``most_text`` characters; its name is a hash
    of its place and its words, so the two never meet unless they belong together.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"block long, ids array<{dict(docs.dtypes)[id_col]}>, sizes binary, places binary" if texts else "block long, first int, words array<string>"
    return rows.mapInArrow(_splitting(path, texts, most_words, most_text), schema)


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat))


def _encoding(path: str, many: int = 400_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, last = loaded(path), (None, b"")
        special = {s: i.to_bytes(4, "little") for s, i in bpe.special.items()}
        blocks, numbers, coded = [], [], []

        def by_block() -> Iterator[pa.RecordBatch]:
            block, number, ids = np.concatenate(blocks), np.concatenate(numbers), pa.concat_arrays(coded)
            order = np.lexsort((number, block))
            block, number, ids = block[order], number[order], ids.take(pa.array(order))
            cuts = np.flatnonzero(np.r_[True, np.diff(block) != 0, True])
            at, flat = ids.offsets.to_numpy(), ids.flatten().to_numpy()
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                row = np.diff(number[a:b], prepend=0), np.diff(at[a : b + 1]), flat[at[a] - at[0] : at[b] - at[0]]
                yield pa.record_batch([pa.array(block[a : a + 1]), *(pa.array([pack(x)]) for x in row)], ["block", "steps", "sizes", "ids"])

        for batch in batches:
            words = batch.column(2).dictionary_encode()
            found = []
            for word in words.dictionary.to_pylist():  # in order; a word goes on in the next batch at most once
                if word != last[0]:
                    last = (word, special.get(word) or bpe.encode_word(word))
                found.append(last[1])
            table = _lists(np.frombuffer(b"".join(found), "<i4"), np.array(list(map(len, found))) // 4)
            blocks.append(batch.column(0).to_numpy())
            numbers.append(batch.column(1).to_numpy())
            coded.append(table.take(words.indices))
            if sum(map(len, numbers)) >= many:
                yield from by_block()
                blocks, numbers, coded = [], [], []
        if blocks:
            yield from by_block()

    return run


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """The distinct-word table over all blocks: each distinct word is encoded once.

    All uses of a word (one a block) come together in one sort, the word is
    encoded, and its ids go back to each block: ``block, steps, sizes, ids``,
    packed: the words' numbers there (each less the one before), how many ids
    each word has, and these.
    """
    uses = words.select("block", "first", F.posexplode("words").alias("nth", "word"))
    uses = uses.select("block", (F.col("first") + F.col("nth")).alias("number"), "word").repartition("word").sortWithinPartitions("word")
    return uses.mapInArrow(_encoding(path), "block long, steps binary, sizes binary, ids binary")


@lru_cache(4)
def pieces(path: str) -> pa.BinaryArray:
    """The piece of each id, by id (unknown ids: empty)."""
    table = loaded(path).pieces
    return pa.array([table.get(i, b"") for i in range(max(table) + 1)], pa.binary())


def _texts_of(ids: np.ndarray, sizes: np.ndarray, table: pa.BinaryArray) -> list[str]:
    """Join ids with their pieces, and the pieces of each text (of so many ids) in order."""
    joined = table.take(pa.array(ids))
    at = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1]
    cuts = at[np.r_[0, np.cumsum(sizes)]].tolist()
    data = memoryview(joined.buffers()[2] or b"")
    return [str(data[a:b], "utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _joining(path: str, with_text: bool):
    names = ["id", "n_tokens", "ids", "text"][: 3 + with_text]

    def run(split: pa.Table, words: pa.Table) -> pa.Table:
        if not split.num_rows:
            raise RuntimeError("the documents changed between two readings; write them to a table first")

        def whole(name: str) -> np.ndarray:
            return np.concatenate([unpack(x.as_py()) for x in words[name]] or [np.zeros(0, np.int32)])

        number = np.concatenate([np.cumsum(unpack(x.as_py())) for x in words["steps"]] or [np.zeros(0, np.int64)])
        table, out = _lists(whole("ids"), whole("sizes")).take(pa.array(np.argsort(number))), []  # each number of the block stands there once
        known = pieces(path) if with_text else None
        for r in range(split.num_rows):
            ids, sizes, places = split["ids"][r], unpack(split["sizes"][r].as_py()), unpack(split["places"][r].as_py())
            if len(places) and not len(table):
                raise RuntimeError("the documents changed between two readings; write them to a table first")
            found = table.take(pa.array(places))
            cuts = found.offsets.to_numpy()[np.r_[0, np.cumsum(sizes)]]
            flat, many = found.flatten().to_numpy(zero_copy_only=False).astype("<i4"), np.diff(cuts)
            raw = memoryview(flat).cast("B")
            packed = [bytes(raw[4 * a : 4 * b]) for a, b in zip((cuts[:-1] - cuts[0]).tolist(), (cuts[1:] - cuts[0]).tolist(), strict=True)]
            columns = [ids.values, pa.array(many.astype(np.int64)), pa.array(packed, pa.binary())]
            if with_text:
                columns.append(pa.array(_texts_of(flat, many, known), pa.string()))
            out.append(pa.table(columns, names))
        return pa.concat_tables(out)

    return run


def _encoded(docs: DataFrame, path: str, id_col: str, text_col: str, with_text: bool, **block) -> DataFrame:
    texts = split_words(docs, path, True, id_col, text_col, **block)
    words = split_words(docs, path, False, id_col, text_col, **block)
    schema = f"id {dict(docs.dtypes)[id_col]}, n_tokens long, ids binary" + ", text string" * with_text
    return texts.groupBy("block").cogroup(encode_words(words, path).groupBy("block")).applyInArrow(_joining(path, with_text), schema)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", **block) -> DataFrame:
    """``id, n_tokens, ids`` for each row; ``ids`` is packed little-endian unsigned 32-bit integers.

    Texts are split into words, each distinct word of the whole corpus is
    encoded once, and its ids are joined back by position.  Words aren't
    shuffled for every use, but once for each block of texts that uses them, so
    neither a frequent word nor a long text makes a large group; no table of
    words is held by the driver or sent to all workers.  ``docs`` is read
    twice, and has to give the same rows in the same order, as tables do;
    otherwise this raises.  Null texts count as
    empty; special strings in a text become their own id, as is the library's
    default.  Repeated rows give repeated results, null ids are ids like any
    other, other columns aren't read; an empty table gives an empty result.
    """
    return _encoded(docs, path, id_col, text_col, False, **block)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", **block) -> DataFrame:
    """``encode`` and ``decode`` in one step: ``id, n_tokens, ids, text``; ids don't leave and enter Python again between them."""
    return _encoded(docs, path, id_col, text_col, True, **block)


def _decoding(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(path)
        for batch in small_batches(batches):
            lists = [x or b"" for x in batch.column(2).to_pylist()]
            ids = np.frombuffer(b"".join(lists), "<u4").astype(np.int64)
            ids = np.where(ids < len(table), ids, -1)
            ids = pa.array(ids, mask=ids < 0)
            texts = _texts_of(ids, np.array(list(map(len, lists)), np.int64) // 4, table)
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], ["id", "n_tokens", "ids", "text"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Add ``text`` to ``id, n_tokens, ids``: ids are joined with the table of pieces, special ones kept.

    The vocabulary bounds that table, so each worker has it, keyed by id, and
    the join needs no shuffle.  Null ids give the empty text, unknown ones no
    piece.
    """
    return encoded.select("id", "n_tokens", "ids").mapInArrow(_decoding(path), f"id {dict(encoded.dtypes)['id']}, n_tokens long, ids binary, text string")
