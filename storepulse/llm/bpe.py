"""Byte-level BPE encoding and decoding with forced boundaries.

A pair of neighbouring bytes that occurs inside no vocabulary token can never end up inside
one token, so the text may be cut there and the fragments encoded one by one. Two uses:

* Between words. Where the vocabulary has no token with a space or line feed after another
  byte (checked when the codec is built), every single space or line feed starts a fragment.
  Fragments repeat all over a corpus, so each task remembers their ids, up to a number of bytes.
* Inside a word. Fragments not seen before are split by the tokenizer's own pattern, then at
  the remaining forced pairs, and merged by rank, all pieces of a batch side by side. Very
  long runs merge with a heap, so a text of one endless word still takes n log n steps.

Defined cases: a null text is empty and encodes to no ids; repeated rows are encoded alike;
texts of any length are encoded whole, long ones slice by slice between forced cuts; extra columns are ignored; an empty table gives an
empty result. `decode` of null is null; ids outside the vocabulary raise, and so does a
tokenizer file whose settings are not those this method stands on.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storepulse.llm.common import ENTRY, REMEMBERED, WORTH, gathered, let_go, list_array, pick, small_batches

# Fixed value: the pattern that byte-level tokenizers of this family split text with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters of a long text, and of all texts, that are cut into fragments at once.
SLICE, GROUP = 1 << 18, 1 << 22
LONG = 96


def byte_symbols() -> list[str]:
    """The character that stands for each byte in vocabulary files: itself if it can be
    printed, else the next unused one from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    out = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [out[b] for b in range(256)]


_BEFORE_WORD = re.compile(r"(?= \S)")


def plain_spacing(text: str) -> bool:
    """Whether the only space characters are single spaces and single line feeds."""
    return (
        text.replace("\n", "").isprintable()
        and "  " not in text and "\n " not in text and " \n" not in text and "\n\n" not in text
    )


# Per byte: 1 for a letter, 2 for a sign that often stands behind a word; the pattern never joins the two.
_LETTER_OR_SIGN = bytes(1 if bytes([b]).isalpha() else 2 if b in b",.;:!?" else 0 for b in range(256))


def forced_cuts(texts: list[str], signs: bool = False) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts as bytes, the places where fragments start, and the number of fragments of each.

    Cut before every space that a non-space follows and, in texts of plain spacing, around
    line feeds. The pattern puts a token boundary at each of these places whatever stands
    around it, so fragments can be encoded alone. Python counts at least the characters as
    space that the pattern does, which can only leave cuts out. With `signs`, cut also between
    a letter of ASCII and one of the signs `,.;:!?`, where the pattern ends a run of letters.
    """
    plain = np.array([plain_spacing(t) for t in texts], bool)
    parts = [[t.encode()] if p else [x.encode() for x in _BEFORE_WORD.split(t)] for t, p in zip(texts, plain)]
    raw = b"".join(x for p in parts for x in p)
    codes = np.frombuffer(raw, np.uint8)
    sizes = np.array([sum(map(len, p)) for p in parts], np.int64)
    feed = codes == 10
    cut = (codes == 32) | feed
    cut[1:] |= feed[:-1]
    starts = sizes.cumsum() - sizes
    for i in np.flatnonzero(~plain).tolist():
        own = cut[starts[i]:starts[i] + sizes[i]]
        own[:] = False
        lengths = np.fromiter(map(len, parts[i]), np.int64, len(parts[i]))
        own[lengths.cumsum()[:-1]] = True
    if signs:
        kinds = np.frombuffer(raw.translate(_LETTER_OR_SIGN), np.uint8)
        cut[1:] |= (kinds[1:] == 2) & (kinds[:-1] == 1)
    cut[starts[sizes > 0]] = True
    places = np.flatnonzero(cut)
    return raw, places, np.searchsorted(places, starts + sizes) - np.searchsorted(places, starts)


def _pairs_inside(tokens: Iterable[bytes]) -> np.ndarray:
    """Which byte pairs occur inside a token; all others are forced boundaries."""
    inside = np.zeros((256, 256), bool)
    for token in tokens:
        raw = np.frombuffer(token, np.uint8)
        inside[raw[:-1], raw[1:]] = True
    return inside


def slices(text: str) -> Iterator[str]:
    """A long text in parts that end before a space with a letter or sign after it."""
    start = 0
    while len(text) - start > SLICE:
        cut = _BEFORE_WORD.search(text, start + SLICE)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:] if start else text


class FragmentEncoder:
    """Encodes texts fragment by fragment and remembers the ids of short fragments.

    Subclasses say how to encode fragments not met before (`compute`), or keep a memory of their
    own (`_looked_up`, `forget`), and how to encode texts that may not be cut (`compute_whole`).
    With `signs`, fragments end before the signs behind a word.
    """

    remembered, group, signs = REMEMBERED, GROUP, False

    def __init__(self, cut: bool, special: Iterable[str]):
        self.cut, self.special = cut, tuple(special)
        self.forget()

    def compute(self, new: list[bytes]) -> Iterable[bytes]:
        raise NotImplementedError

    def compute_whole(self, texts: list[str]) -> list[bytes]:
        raise NotImplementedError

    def forget(self) -> None:
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        whole = [i for i, t in enumerate(texts) if not self.cut or any(x in t for x in self.special)]
        out: list[bytes] = [b""] * len(texts)
        for i, ids in zip(whole, self.compute_whole([texts[i] for i in whole])):
            out[i] = ids
        # Slices of all other texts, a bounded number of characters at a time.
        apart, group, owner, size = set(whole), [], [], 0
        for i, text in enumerate(texts):
            for part in slices(text) if i not in apart else ():
                group.append(part)
                owner.append(i)
                size += len(part)
                if size >= self.group:
                    self._into(out, owner, group)
                    group, owner, size = [], [], 0
        self._into(out, owner, group)
        return out

    def _into(self, out: list[bytes], owner: list[int], parts: list[str]) -> None:
        for i, ids in zip(owner, self._encode(parts)):
            out[i] = out[i] + ids if out[i] else ids

    def _encode(self, parts: list[str]) -> list[bytes]:
        """Each distinct fragment of the parts is looked up once; ids are then laid out in one gather."""
        raw, places, many = forced_cuts(parts, self.signs)
        if not len(places):
            return [b""] * len(parts)
        offsets = np.append(places, len(raw)).astype(np.int32)
        cut = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        which = cut.indices.to_numpy()
        data, sizes = self._looked_up(cut.dictionary)
        lengths = sizes[which]
        stops = lengths.cumsum()
        laid = data[gathered((sizes.cumsum() - sizes)[which], lengths)].tobytes()
        ends = (4 * np.append(0, stops)[many.cumsum()]).tolist()
        return [laid[a:b] for a, b in zip([0, *ends], ends)]

    def _looked_up(self, fragments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct fragments end to end, and how many each has."""
        distinct = fragments.to_pylist()
        if self.held > self.remembered:
            self.forget()
        known = self.known
        new = [f for f in distinct if f not in known]
        self._learn(new)
        ids = [known[f] for f in distinct]
        for fragment in new:
            if len(fragment) > WORTH:
                known.pop(fragment, None)
        return np.frombuffer(b"".join(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids)) // 4

    def _learn(self, new: list[bytes]) -> None:
        """Encode fragments not met before. A word is encoded without the signs behind it: the
        pattern always ends a run of letters there, so the parts' ids can be joined."""
        known, ended, todo = self.known, [], set()
        for fragment in new:
            word = fragment.rstrip(b",.;:!?")
            if len(word) < len(fragment) and word[-1:].isalpha():
                signs = fragment[len(word):]
                ended.append((fragment, word, signs))
                todo.add(word)
                todo.add(signs)
            else:
                todo.add(fragment)
        todo = list(todo.difference(known))
        known.update(zip(todo, self.compute(todo)))
        for fragment, word, signs in ended:
            known[fragment] = known[word] + known[signs]
        self.held += (ENTRY + WORTH // 2) * (len(todo) + len(ended))


# The settings under which forced cuts and the pattern hold.
_SETTINGS = {
    "normalizer": None, "post_processor": None,
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True},
    "model": {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None,
              "byte_fallback": False, "ignore_merges": False},
}
_PLAIN_TOKEN = ("single_word", "lstrip", "rstrip", "normalized")


def _check(spec: dict, path: str) -> None:
    """Raise unless the file describes plain byte-level BPE."""
    for part, wanted in _SETTINGS.items():
        found = spec.get(part)
        for name, value in (wanted or {}).items():
            if (found or {}).get(name, value) != value or not found:
                raise ValueError(f"{path}: {part}.{name} is {(found or {}).get(name)!r}, only {value!r} is supported")
        if wanted is None and found is not None:
            raise ValueError(f"{path}: {part} is set, which is not supported")
    for token in spec.get("added_tokens", ()):
        if any(token.get(name) for name in _PLAIN_TOKEN):
            raise ValueError(f"{path}: added token {token['content']!r} is not plain")


class ByteBpe(FragmentEncoder):
    """Codec built from a `tokenizers` JSON file of a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _check(spec, path)
        model, symbols = spec["model"], byte_symbols()
        back = {s: b for b, s in enumerate(symbols)}
        vocab = model["vocab"]
        self.special_ids = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.bytes_of: list[bytes] = [b""] * (max([*vocab.values(), *self.special_ids.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[ch] for ch in token)
        for token, i in self.special_ids.items():
            self.bytes_of[i] = token.encode()
        self.token_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.token_size = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.token_start = self.token_size.cumsum() - self.token_size
        self.single = np.array([vocab[symbols[b]] for b in range(256)], np.int32)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self._made = np.array([new for _, new in self.merges.values()], np.int32)
        self._table_keys, self._table_ranks = _pair_table(self.merges)
        self.inside = _pairs_inside(self.bytes_of[i] for i in vocab.values())
        # True when a space never follows, and a line feed never touches, a visible byte inside a
        # token. Tokens of nothing but space characters come from runs of those, which stay whole.
        worded = _pairs_inside(b for b in self.bytes_of if not b.decode("utf-8", "replace").isspace())
        ink = np.setdiff1d(np.arange(256), [9, 10, 11, 12, 13, 32])
        self._pattern = regex.compile(PATTERN)
        self._special = regex.compile("(" + "|".join(map(regex.escape, self.special_ids)) + ")") if self.special_ids else None
        super().__init__(not (worded[ink][:, [32, 10]].any() or worded[10, ink].any()), self.special_ids)

    # --- encoding -----------------------------------------------------------------------

    def compute_whole(self, texts: list[str]) -> list[bytes]:
        """Texts with special tokens, or of a vocabulary that forces no cuts between words."""
        out = []
        for text in texts:
            parts = self._special.split(text) if self._special else [text]
            encode = (lambda t: self([t])[0]) if self.cut else (lambda t: next(iter(self.compute([t.encode()]))))
            out.append(b"".join(np.int32(self.special_ids[p]).tobytes() if i % 2 else encode(p) for i, p in enumerate(parts)))
        return out

    def compute(self, new: list[bytes]) -> Iterable[bytes]:
        """Split by the pattern, cut at every forced pair, merge all pieces side by side."""
        words, owner = [], []
        for i, fragment in enumerate(new):
            if fragment.isalpha() or fragment[1:].isalpha() and fragment[:1] == b" ":  # ASCII letters only
                words.append(fragment)
                owner.append(i)
            else:
                found = self._pattern.findall(fragment.decode())
                words += [w.encode() for w in found]
                owner += [i] * len(found)
        codes = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        word_of = np.repeat(np.arange(len(words)), sizes)
        cut = np.ones(len(codes), bool)
        cut[1:] = ~self.inside[codes[:-1], codes[1:]] | (word_of[1:] != word_of[:-1])
        ids, piece = self._merge_pieces(self.single[codes], np.cumsum(cut) - 1)
        of_piece = np.array(owner, np.int64)[word_of[cut]]
        counts = np.bincount(of_piece[piece], minlength=len(new)) if len(piece) else np.zeros(len(new), np.int64)
        data, stops = ids.astype(np.int32).tobytes(), (4 * counts.cumsum()).tolist()
        return [data[a:b] for a, b in zip([0, *stops], stops)]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or the number of merges where there is none."""
        key = left.astype(np.int64) << 32 | right
        at = _slot(key, len(self._table_keys))
        found = np.full(len(key), len(self._made), np.int64)
        todo = np.arange(len(key))
        while len(todo):
            seen = self._table_keys[at[todo]]
            hit = seen == key[todo]
            found[todo[hit]] = self._table_ranks[at[todo[hit]]]
            todo = todo[~hit & (seen >= 0)]
            at[todo] = (at[todo] + 1) % len(self._table_keys)
        return found

    def _merge_pieces(self, ids: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge each piece by rank, leftmost first among equals: ids, and the piece of each, in order."""
        never = len(self._made)
        done_ids, done_piece = [], []
        sizes = np.bincount(piece)
        for long in np.flatnonzero(sizes > LONG).tolist():
            merged = self._merge_long(ids[slice(*np.searchsorted(piece, [long, long + 1]))].tolist())
            done_ids.append(np.array(merged, np.int32))
            done_piece.append(np.full(len(merged), long))
        if len(done_ids):
            short = sizes[piece] <= LONG
            ids, piece = ids[short], piece[short]
        ids = ids.copy()
        rank = np.full(len(ids), never, np.int64)
        inner = np.flatnonzero(piece[1:] == piece[:-1])
        rank[inner] = self._ranks(ids[inner], ids[inner + 1])
        while len(ids):
            starts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
            lengths = np.diff(np.r_[starts, len(ids)])
            best = np.minimum.reduceat(rank << 32 | np.arange(len(ids)), starts)
            live = (best >> 32) < never
            stay = np.repeat(live, lengths)
            if not live.all():
                done_ids.append(ids[~stay])
                done_piece.append(piece[~stay])
            at = (best[live] & 0xFFFFFFFF).astype(np.int64)
            ids[at] = self._made[(best[live] >> 32)]
            # The merged place takes over its right neighbour's end; only two pairs change.
            last = np.repeat(starts + lengths - 1, lengths)
            ends = at + 1 == last[at]
            after = np.minimum(at + 2, len(ids) - 1)
            rank[at] = np.where(ends, never, self._ranks(ids[at], ids[after]))
            before = at[~(at == np.repeat(starts, lengths)[at])] - 1
            rank[before] = self._ranks(ids[before], ids[before + 1])
            stay[at + 1] = False
            ids, piece, rank = ids[stay], piece[stay], rank[stay]
        if not done_ids:
            return ids, piece
        ids, piece = np.concatenate(done_ids), np.concatenate(done_piece)
        order = np.argsort(piece, kind="stable")
        return ids[order], piece[order]

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges in the same order, lowest rank first and leftmost among equals."""
        n, merges = len(ids), self.merges
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(*merges[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in merges]
        heap = [(rank, i, new, a, b) for rank, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for at in (left[i], i):
                if at >= 0 and right[at] >= 0 and (p := (ids[at], ids[right[at]])) in merges:
                    rank, made = merges[p]
                    heapq.heappush(heap, (rank, at, made, *p))
        return [x for x in ids if x >= 0]

    # --- decoding -----------------------------------------------------------------------

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of `counts` ids, from one buffer of all token bytes."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.bytes_of)):
            raise IndexError("id out of range of the vocabulary")
        sizes = self.token_size[ids]
        stops = sizes.cumsum()
        data = self.token_bytes[gathered(self.token_start[ids], sizes)].tobytes()
        ends = np.r_[0, stops][counts.cumsum()].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends], ends)]


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    """First place of a pair in the hash table of pairs."""
    mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(32)).astype(np.int64) % size


def _pair_table(merges: dict[tuple[int, int], tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Open-addressing table from pairs to ranks, four times as large as it has entries."""
    size = 4 * len(merges) + 1
    keys, ranks = np.full(size, -1, np.int64), np.zeros(size, np.int64)
    pairs = np.array(list(merges), np.int64).reshape(-1, 2)
    key = pairs[:, 0] << 32 | pairs[:, 1]
    for k, at, (rank, _) in zip(key.tolist(), _slot(key, size).tolist(), merges.values()):
        while keys[at] >= 0:
            at = (at + 1) % size
        keys[at], ranks[at] = k, rank
    return keys, ranks


@lru_cache(maxsize=1)
def codec(path: str) -> ByteBpe:
    """One codec per worker process and vocabulary."""
    return ByteBpe(path)


def _coded(bpe: ByteBpe, texts: list) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, and how many each has."""
    parts = bpe([t or "" for t in texts])
    return np.frombuffer(b"".join(parts), np.int32), np.fromiter(map(len, parts), np.int64, len(parts)) // 4


def encoder(path: str):
    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return list_array(*_coded(codec(path), texts.to_pylist()), pa.int32())

    return encode


def decoder(path: str):
    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        counts = ids.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        texts = codec(path).decode_all(ids.flatten().to_numpy(zero_copy_only=False), counts)
        return pa.array([t if there else None for t, there in zip(texts, ids.is_valid().to_pylist())], pa.string())

    return decode


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the ids of every whole text."""
    return pick(docs, key, text).select(key, encoder(path)(F.col(text)).alias("ids"))


def decode(encoded: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the decoded text; special tokens are kept as their own strings."""
    return encoded.withColumn(into, decoder(path)(F.col(ids)))


def encode_and_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded) in one pass: the ids of every whole text, and the text decoded from them.

    Two chained functions would make Spark encode twice, once for each use of the ids.
    """
    rows = pick(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in small_batches(batches):
            ids, counts = _coded(bpe, batch.column(1).to_pylist())
            decoded = pa.array(bpe.decode_all(ids, counts), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(ids, counts, pa.int32()), decoded], [key, "ids", "decoded"])
        bpe.forget()
        let_go()

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded string")


def ids_text(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), ",")
