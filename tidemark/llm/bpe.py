"""BPE encoding and decoding with an index from each pair to all its positions.

The texts of a partition are normalised and split into words as the vocabulary file says (NFC, white
space dropped, lower case; contractions, letter runs, single digits, other runs). The words not seen
before in the partition are laid end to end in one array of symbols, an index maps each adjacent pair
to all its positions there, and the active ranks are applied in ascending order: each merge visits
just its own positions, and the lists of the pairs that arise or vanish beside them are updated.
Applying a rank everywhere at once gives what a word by word encoder gives provided no merge makes a
symbol that an earlier rank uses; loading a vocabulary checks that.

Only words are cached, at most CACHE_WORDS at a time, and at most 2 * ROUND_NEW_WORDS new ones are merged at once, so memory
doesn't grow with a partition or with the distinct words in it. Workers give back what a round took.

Defined results: a null or empty text, and one of white space alone, has no tokens and decodes to the
empty text; the strings of special tokens in a text become those tokens, as the library does. Texts of
any length are taken whole; repeated rows each give their row.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import bounded_batches, distinct, give_back, map_batches, texts

#: Words whose ids a worker keeps (about 200 bytes each); beyond it the cache starts anew.
CACHE_WORDS = 400_000
#: Texts of so many words in all are encoded together, fewer as soon as so many are new: merging takes most of the memory.
ROUND_WORDS = 4_000_000
ROUND_NEW_WORDS = 75_000
#: Pairs whose ranks are looked up together.
RANK_PAIRS = 65_536

# The contractions in the vocabulary file's split pattern, tried in front of runs of
# letters, single digits and runs of other characters.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
# Below U+0530 and in the block of general punctuation Python's and the library's character tables agree;
# texts with other characters take the library's own normaliser and splitter.
TABLE_END, SPACE, LETTER, NUMBER, OTHER, BEYOND = 0x2070, 0, 1, 2, 3, 4


def character_classes() -> np.ndarray:
    """The class of each character below TABLE_END; one more entry stands for all beyond."""
    kinds = [(regex.compile(r"\s"), SPACE), (regex.compile(r"\p{L}"), LETTER), (regex.compile(r"\p{N}"), NUMBER)]
    out = np.full(TABLE_END + 1, OTHER, dtype=np.int8)
    for c in range(TABLE_END):
        out[c] = next((k for p, k in kinds if p.match(chr(c))), OTHER)
    out[0x530:0x2000] = out[TABLE_END] = BEYOND
    return out


CLASS = character_classes()


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class Vocabulary:
    """A word-level BPE vocabulary file: ids, merge ranks and special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        ids, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        alphabet = byte_alphabet()
        self.n = max([*ids.values(), *self.special.values()]) + 1
        self.names = [""] * self.n
        for name, i in [*ids.items(), *self.special.items()]:
            self.names[i] = name
        self.inner = np.array([ids[c] for c in alphabet], dtype=np.int64)
        self.final = np.array([ids[c + end] for c in alphabet], dtype=np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        self.left, self.right = left.tolist(), right.tolist()
        keys = left * self.n + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        made_at = np.full(self.n, -1, dtype=np.int64)
        made_at[self.made] = np.arange(len(pairs))
        if len(pairs) and not (np.maximum(made_at[left], made_at[right]) < np.arange(len(pairs))).all():
            raise ValueError("a merge uses a symbol that only a later rank makes")
        self.tool = Tokenizer.from_file(path)
        self.back = {c: b for b, c in enumerate(alphabet)}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens, in order, as the library finds them."""
        plain = self.tool.normalizer.normalize_str(text)
        return [bytes(self.back[c] for c in w).decode() for w, _ in self.tool.pre_tokenizer.pre_tokenize_str(plain)]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1; looked up RANK_PAIRS at a time."""
        if not len(self.keys):
            return np.full(len(a), -1, dtype=np.int32)
        if len(a) > RANK_PAIRS:
            return np.concatenate([self.rank(a[i : i + RANK_PAIRS], b[i : i + RANK_PAIRS]) for i in range(0, len(a), RANK_PAIRS)])
        key = a.astype(np.int64) * self.n + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], -1)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_words(vocab: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words end to end, and each word's bounds (words + 1)."""
    raw = [w.encode() for w in words]
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    n = len(data)
    symbol = vocab.inner[data].astype(np.int32)
    symbol[ends - 1] = vocab.final[data[ends - 1]]
    word = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
    after = np.arange(1, n + 1, dtype=np.int32)  # the next live symbol of the same word, or n
    after[ends - 1] = n
    before = np.arange(-1, n - 1, dtype=np.int32)
    before[ends - sizes] = -1
    symbol = np.append(symbol, np.int32(-1))  # slot n, also reached as -1, is no symbol
    # the index: positions of each active rank, as lists of arrays, and a heap of the ranks
    place = np.flatnonzero(after < n).astype(np.int32)
    rank = vocab.rank(symbol[place], symbol[after[place]])
    index: dict[int, list[np.ndarray]] = {}
    _add(index, rank, place)
    heap = list(index)
    heapq.heapify(heap)
    while heap:
        r = heapq.heappop(heap)
        at = np.unique(np.concatenate(index.pop(r)))
        a, b = vocab.left[r], vocab.right[r]
        nxt = after[at]
        live = (symbol[at] == a) & (symbol[nxt] == b)  # listed earlier, changed since?
        at, nxt = at[live], nxt[live]
        if a == b and len(at) > 1:
            at, nxt = _apart(at, nxt)
        if not len(at):
            continue
        symbol[at] = vocab.made[r]
        symbol[nxt] = -1
        far = after[nxt]
        after[at] = far
        inside = far < n
        before[far[inside]] = at[inside]
        prev = before[at]
        has = prev >= 0
        lefts = prev[has]
        rights = at[inside]
        places = np.concatenate([lefts, rights])
        if len(places):
            new = vocab.rank(symbol[places], symbol[after[places]])
            for x in _add(index, new, places):
                heapq.heappush(heap, x)
    kept = symbol[:n] >= 0
    counts = np.bincount(word[kept], minlength=len(raw))
    return symbol[:n][kept].astype(np.uint32), np.concatenate([[0], np.cumsum(counts)])


def _add(index: dict[int, list[np.ndarray]], rank: np.ndarray, place: np.ndarray) -> list[int]:
    """List places under their ranks; the ranks that weren't active before."""
    ok = rank >= 0
    rank, place = rank[ok], place[ok]
    if not len(rank):
        return []
    if len(rank) > 1:
        order = np.argsort(rank, kind="stable")
        rank, place = rank[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
    else:
        first = np.array([0])
    new, stops = [], [*first[1:].tolist(), len(rank)]
    for r, i, j in zip(rank[first].tolist(), first.tolist(), stops, strict=True):
        if r in index:
            index[r].append(place[i:j])
        else:
            index[r] = [place[i:j]]
            new.append(r)
    return new


def _apart(at: np.ndarray, nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of one symbol that overlap ("aaa"), every other one from the left."""
    chained = np.concatenate([[False], nxt[:-1] == at[1:]])
    run = np.arange(len(at)) - np.maximum.accumulate(np.where(chained, -1, np.arange(len(at))))
    keep = run % 2 == 0
    return at[keep], nxt[keep]


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The worker process's encoder: its word cache serves all tasks that run there."""
    return Encoder(path)


def split_words(codes: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words among lower-case characters of known classes."""
    n = len(codes)
    ink = kind != SPACE
    start = ink.copy()
    start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    quote = np.flatnonzero(start & (codes == ord("'")))
    padded = np.append(codes, [0, 0, 0])
    for c in CONTRACTIONS:
        at = quote
        for k, letter in enumerate(c):
            at = at[padded[at + 1 + k] == ord(letter)]
        start[at + 1] = False
        after = at + 1 + len(c)
        after = after[after < n]
        start[after[kind[after] == LETTER]] = True
    end = ink.copy()
    end[:-1] &= start[1:] | ~ink[1:]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


class Encoder:
    """Encodes texts; keeps the ids of words it has met, which are compared whole: nothing is known by a hash alone.

    Numbers of words: plain ones by their characters' codes, those of texts with rare characters by the words.
    """

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        special = sorted(self.vocab.special.values())
        self.rare: dict = {i: n for n, i in enumerate(special)}
        self.flat, self.bounds = np.array(special, dtype="<u4"), np.arange(len(special) + 1)
        self.new: list[str] = []

    def learn(self) -> None:
        for i in range(0, len(self.new), 2 * ROUND_NEW_WORDS):
            ids, bounds = merge_words(self.vocab, self.new[i : i + 2 * ROUND_NEW_WORDS])
            self.bounds = np.concatenate([self.bounds, bounds[1:] + self.bounds[-1]])
            self.flat = np.concatenate([self.flat, ids])
        self.new = []

    def _take(self, words: list[str]) -> np.ndarray:
        first = len(self.bounds) - 1 + len(self.new)
        self.new += words
        return np.arange(first, first + len(words), dtype=np.int32)

    def _rare(self, text: str) -> np.ndarray:
        out, pieces = [], self.vocab.specials.split(text) if self.vocab.specials else [text]
        for p in pieces:
            if p in self.vocab.special:
                out.append(self.rare[self.vocab.special[p]])
            elif p:
                for w in self.vocab.words(p):
                    if w not in self.rare:
                        self.rare[w] = int(self._take([w])[0])
                    out.append(self.rare[w])
        return np.array(out, dtype=np.int32)

    def numbers(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words of some texts, and each text's bounds in them (texts + 1)."""
        plain, odd = [], {}
        for i, t in enumerate(batch):
            special = self.vocab.specials and self.vocab.specials.search(t)
            if special or not t.isascii() and not unicodedata.is_normalized("NFC", t):
                odd[i], t = t, ""
            elif not t.isascii():
                t = t.replace("Σ", "σ")
            plain.append(t.lower())
        text = "\n".join(plain)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum(np.fromiter(map(len, plain), dtype=np.int64, count=len(plain)) + 1)
        kind = CLASS[np.minimum(codes, TABLE_END)]
        beyond = np.flatnonzero(kind == BEYOND)
        if len(beyond):
            for i in np.unique(np.searchsorted(ends, beyond, side="right")).tolist():
                odd[i] = batch[i]
                kind[ends[i] - 1 - len(plain[i]) : ends[i] - 1] = SPACE
        s, e = split_words(codes, kind)
        which, met = distinct(codes, s, e) if len(s) else (np.empty(0, np.int64), [])
        number = np.array([self.known.get(w, -1) for w in met], dtype=np.int32)
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            new = [met[i] for i in fresh.tolist()]
            number[fresh] = self._take([w.decode("utf-32-le", "surrogatepass") for w in new])
            self.known.update(zip(new, number[fresh].tolist(), strict=True))
        words, bounds = number[which], np.concatenate([[0], np.searchsorted(s, ends)])
        if odd:
            parts = [self._rare(odd[i]) if i in odd else words[bounds[i] : bounds[i + 1]] for i in range(len(batch))]
            words, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return words, bounds

    def ids(self, words: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """The ids of each text, little-endian unsigned 32-bit integers."""
        start = self.bounds[words]
        size = self.bounds[words + 1] - start
        stop = np.cumsum(size)
        ids = self.flat[np.repeat(start - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
        cuts = np.concatenate([[0], stop])[bounds]
        return [ids[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]

    def rounds(self, batches):
        """From (keys, texts) pairs: (keys, ids of each text) pairs, in order. New words of a round are learned together."""
        waiting, n = [], 0
        if len(self.bounds) > CACHE_WORDS:
            self.forget()
        for keys, column in batches:
            words, bounds = self.numbers(column)
            waiting.append((keys, words, bounds))
            n += len(words)
            if n > ROUND_WORDS or len(self.new) > ROUND_NEW_WORDS:
                yield from self._flush(waiting)
                waiting, n = [], 0
                if len(self.bounds) > CACHE_WORDS:
                    self.forget()
        yield from self._flush(waiting)

    def _flush(self, waiting: list):
        self.learn()
        for keys, words, bounds in waiting:
            yield keys, self.ids(words, bounds)
        waiting.clear()
        give_back()

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        return [x for _, ids in self.rounds([(None, batch[i:j]) for i, j in slices(batch)]) for x in ids]

    def decode(self, ids: np.ndarray) -> str:
        """The names of the tokens joined by spaces: what the library gives for a file without a decoder."""
        return " ".join(map(self.vocab.names.__getitem__, ids.tolist()))


#: A batch is encoded in slices of about so many characters.
SLICE_CHARS = 1_000_000


def slices(batch: list[str]) -> list[tuple[int, int]]:
    out, start, size = [], 0, 0
    for i, t in enumerate(batch):
        if size and size + len(t) > SLICE_CHARS:
            out.append((start, i))
            start, size = i, 0
        size += len(t)
    return [*out, (start, len(batch))] if batch else []


def encoded(batches: Iterator[pa.RecordBatch], vocab_path: str):
    """(doc_ids, ids of each text) pairs for the (doc_id, text) batches of a partition."""
    parts = ((b.column(0).to_pylist()[i:j], column[i:j]) for b in batches for column in [b.column(1).to_pylist()] for i, j in slices(column))
    return encoder(vocab_path).rounds(parts)


def encode_rows(docs: DataFrame, vocab_path: str, make, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """make(doc_ids, ids, tool) -> columns, called for slices of texts with their ids."""

    def run(batches: Iterator[pa.RecordBatch]):
        for doc_ids, ids in encoded(batches, vocab_path):
            yield pa.RecordBatch.from_pydict(make(doc_ids, ids, encoder(vocab_path)))

    bounded_batches(docs.sparkSession)
    return texts(docs, id_col, text_col).mapInArrow(run, schema)


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<long>): the token ids of every text."""

    def make(doc_ids, ids, _):
        return {"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))}

    return encode_rows(docs, vocab_path, make, "doc_id long, ids array<long>", id_col, text_col)


def decode(encoded: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): ids back to text; null ids give the empty text."""

    def run(b: pa.RecordBatch):
        out = [encoder(vocab_path).decode(np.array(x or [], dtype="<u4")) for x in b.column(1).to_pylist()]
        return pa.RecordBatch.from_pydict({"doc_id": b.column(0), "text": pa.array(out, pa.string())})

    return map_batches(encoded.selectExpr(f"cast({id_col} as long) as doc_id", f"{ids_col} as ids"), run, "doc_id long, text string")
