"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

Every prefix of a piece of text has exactly one possible last token: the encoding of the prefix
ends in it. An automaton over the vocabulary lists the tokens that end at each position; the one
whose predecessor (the last token of the shorter prefix) can stand before it is stored, and
following the back-pointers from the end gives the ids. Whether two tokens can stand next to each
other depends on these two alone: merging their joint bytes must never join a symbol across the
border. Time is linear in the length of the piece, however long it is.

Texts are split into pieces by the vocabulary file's own rule before that, so most pieces are
words, and each worker remembers the ids of short ones in a table of bounded bytes. Words that it
does not know yet are gathered from a slice of texts and encoded side by side, prefix by prefix.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import map_texts

#: The splitting rule of byte-level vocabularies, with white space as Unicode lists it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: A space next to white space or at either end.
ODD_SPACE = re.compile(r"\s | \s|^ | $")

MAX_FILE_BYTES = 64 << 20  # a vocabulary file is sent to every executor
TABLE_BYTES = 48 << 20  # of remembered words and their ids in a worker
PREPARED = 1 << 20  # bytes of texts whose words are looked through before they are encoded
ENTRY_BYTES = 120  # of a table's entry besides key and ids
LONGEST_UNIT = 64  # characters of a word that is remembered
PAIR_BITS = 20  # pair tests that are remembered for words encoded side by side, 9 bytes each
CACHED_PAIRS = 100_000  # pair tests that are remembered for long pieces; some 12 MB
CACHED_MOVES = 100_000  # remembered steps of the automaton; some 10 MB
TOGETHER = 32_768  # words that are encoded side by side
NEVER = 1 << 62


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: itself if printable, else 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Automaton:
    """Which tokens end at each position of a string: one state for each prefix of a token."""

    def __init__(self, ids: dict[bytes, int]):
        self.step: list[dict[int, int]] = [{}]  # state -> byte -> state: the trie, then what was looked up
        self.ends: list[tuple[tuple[int, int], ...]] = [()]  # (length, token), longest first
        self.shorter = [0]  # state of the longest proper suffix that is a prefix of a token
        for token, i in ids.items():
            state = 0
            for byte in token:
                after = self.step[state].get(byte)
                if after is None:
                    after = self.step[state][byte] = len(self.step)
                    self.step.append({})
                    self.ends.append(())
                    self.shorter.append(0)
                state = after
            self.ends[state] = ((len(token), i),)
        self.kept = 0
        level = list(self.step[0].values())
        while level:  # by length, so that what is shorter is ready
            following = []
            for state in level:
                self.ends[state] += self.ends[self.shorter[state]]
                for byte, after in self.step[state].items():
                    self.shorter[after] = self._fall(self.shorter[state], byte)
                    following.append(after)
            level = following

    def _fall(self, state: int, byte: int) -> int:
        while True:
            after = self.step[state].get(byte)
            if after is not None:
                return after
            if not state:
                return 0
            state = self.shorter[state]

    def move(self, state: int, byte: int) -> int:
        """The next state where the trie has none; remembered for a bounded number of cases."""
        after = self._fall(state, byte)
        if self.kept < CACHED_MOVES:
            self.kept += 1
            self.step[state][byte] = after
        return after


class Lookup:
    """Numbers under 64-bit keys, for arrays of keys; -1 where there is none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(62 - max(1, len(keys)).bit_length())
        size = 1 << (64 - int(self.shift))
        self.keys, self.values = np.full(size, NEVER, np.uint64), np.full(size, -1, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            empty = left[self.keys[slot[left]] == NEVER]
            self.keys[slot[empty]] = keys[empty]
            done = self.keys[slot[left]] == keys[left]
            self.values[slot[left[done]]] = values[left[done]]
            left = left[~done]
            slot[left] = (slot[left] + 1) % size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found, left = self.values[slot], np.flatnonzero(self.keys[slot] != keys)
        found[left] = -1
        left = left[self.keys[slot[left]] != NEVER]
        while len(left):
            slot[left] = (slot[left] + 1) % len(self.keys)
            there = self.keys[slot[left]]
            same = there == keys[left]
            found[left[same]] = self.values[slot[left[same]]]
            left = left[~same & (there != NEVER)]
        return found


class SideBySide:
    """The dynamic programme for many pieces at once: all their first prefixes, all their second ones and so on."""

    def __init__(self, codec: Codec):
        machine = codec.automaton
        edges = [(state, byte, after) for state, found in enumerate(machine.step) for byte, after in found.items()]
        states, bytes_, after = np.array(edges, np.uint64).reshape(-1, 3).T
        self.step = Lookup(states << np.uint64(8) | bytes_, after.astype(np.int64))
        self.shorter = np.array(machine.shorter)
        # The tokens that end in a state as a chain: the longest, and the state where the next shorter one is found.
        self.token = np.array([e[0][1] if e else -1 for e in machine.ends])
        self.length = np.array([e[0][0] if e else 0 for e in machine.ends])
        self.then = np.array([self._state_of(machine, state) for state in range(len(machine.ends))])
        self.size = np.array(codec.length_of)
        self.rank = np.array(codec.rank)
        self.merges = Lookup(np.array([a << 24 | b for a, b in codec.merges], np.uint64), np.array(list(codec.merges.values())))
        self.edges = []
        for lines in (codec.right_edge, codec.left_edge):
            ends = np.cumsum([len(x) for x in lines])
            self.edges.append((ends - [len(x) for x in lines], np.array([t for x in lines for t in x])))
        self.known, self.verdict = np.zeros(1 << PAIR_BITS, np.uint64), np.zeros(1 << PAIR_BITS, bool)

    @staticmethod
    def _state_of(machine: Automaton, state: int) -> int:
        """The longest proper suffix of a state at which the next shorter token is the longest that ends."""
        found, longest = machine.shorter[state], machine.ends[state][:1]
        while found and machine.ends[found][:1] == longest:
            found = machine.shorter[found]
        return found

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``Codec._apart`` for arrays of pairs."""
        (first_left, lefts), (first_right, rights) = self.edges
        i, j = first_left[a], first_right[b]
        used_left, used_right = np.full(len(a), NEVER), np.full(len(a), NEVER)
        fits, left = np.ones(len(a), bool), np.arange(len(a))
        while len(left):
            x, y = lefts[i[left]], rights[j[left]]
            m = self.merges[x.astype(np.uint64) << np.uint64(24) | y.astype(np.uint64)]
            joins = (m >= 0) & (m < used_left[left]) & (m <= used_right[left])
            fits[left[joins]] = False
            rank_x, rank_y = self.rank[x], self.rank[y]
            go_left, go_right = ~joins & (rank_x > rank_y), ~joins & (rank_x <= rank_y) & (rank_y >= 0)
            used_left[left[go_left]], used_right[left[go_right]] = rank_x[go_left], rank_y[go_right]
            i[left[go_left]] += 1
            j[left[go_right]] += 1
            left = left[go_left | go_right]
        return fits

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = (a + 1).astype(np.uint64) << np.uint64(24) | b.astype(np.uint64)
        slot = (pair * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        fits, new = self.verdict[slot], np.flatnonzero(self.known[slot] != pair)
        if len(new):
            fits[new] = self.apart(a[new], b[new])
            # One pair per slot: the last that is written, with its own verdict.
            self.known[slot[new]] = pair[new]
            own = new[self.known[slot[new]] == pair[new]]
            self.verdict[slot[own]] = fits[own]
        return fits

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit numbers."""
        order = sorted(range(len(pieces)), key=lambda k: -len(pieces[k]))  # pieces that go on stay in front
        ordered = [pieces[k] for k in order]
        sizes = np.array([len(p) for p in ordered])
        most = int(sizes[0])
        body = np.frombuffer(b"".join(p.ljust(most, b"\0") for p in ordered), np.uint8).reshape(len(ordered), most)
        last = np.full((most + 1, len(ordered)), -1, np.int32)  # the last token of each prefix
        state = np.zeros(len(ordered), np.int64)
        for at in range(1, most + 1):
            live = int(np.searchsorted(-sizes, -at, "right"))
            state = self._moved(state[:live], body[:live, at - 1].astype(np.uint64))
            self._chosen(last, state.copy(), at)
        return self._ids(last, sizes, order)

    def _moved(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        out, left, now = np.zeros(len(state), np.int64), np.arange(len(state)), state
        while len(left):
            after = self.step[now.astype(np.uint64) << np.uint64(8) | byte[left]]
            found = after >= 0
            out[left[found]] = after[found]
            on = ~found & (now > 0)
            left, now = left[on], self.shorter[now[on]]
        return out

    def _chosen(self, last: np.ndarray, at_state: np.ndarray, at: int) -> None:
        left = np.arange(len(at_state))
        while len(left):
            token, length = self.token[at_state[left]], self.length[at_state[left]]
            before = last[at - length, left]
            fits = length == at
            test = ~fits & (token >= 0)
            fits[test] = self.compatible(before[test], token[test])
            last[at, left[fits]] = token[fits]
            left = left[~fits]
            at_state[left] = self.then[at_state[left]]

    def _ids(self, last: np.ndarray, sizes: np.ndarray, order: list[int]) -> list[bytes]:
        found, place, left = [], sizes.copy(), np.arange(len(sizes))
        counts = np.zeros(len(sizes), np.int64)
        while len(left):
            token = last[place[left], left]
            found.append((left, token))
            counts[left] += 1
            place[left] -= self.size[token]
            left = left[place[left] > 0]
        ends = np.cumsum(counts)
        flat = np.empty(int(ends[-1]), "<i4")
        for back, (rows, token) in enumerate(found, 1):
            flat[ends[rows] - back] = token
        joined, out = flat.tobytes(), [b""] * len(sizes)
        for k, a, b in zip(order, (4 * (ends - counts)).tolist(), (4 * ends).tolist()):
            out[k] = joined[a:b]
        return out


class Codec:
    """Encoder and decoder of one vocabulary file (contents as bytes)."""

    def __init__(self, contents: bytes):
        data = json.loads(contents)
        model, before = data["model"], data.get("pre_tokenizer") or {}
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or data.get("normalizer") or model.get("ignore_merges"):
            raise ValueError("only byte-level vocabularies that are split by their usual pattern, without a prefix space or a normalizer, are read")
        letters = _byte_letters()
        names = model["vocab"]
        spelt = {name: bytes(letters[c] for c in name) for name in names}
        self.specials = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        size = max([*names.values(), *self.specials.values()]) + 1
        self.bytes_of = [b""] * size
        for name, i in names.items():
            self.bytes_of[i] = spelt[name]
        for name, i in self.specials.items():
            self.bytes_of[i] = name.encode()
        self.special_pattern = "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))
        # Of each token: the rank of the merge that makes it (bytes: -1) and its two halves.
        self.rank = [-1] * size
        self.halves: list[tuple[int, int] | None] = [None] * size
        self.merges: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, made = names[left], names[right], names[left + right]
            self.merges.setdefault((a, b), r)
            if self.halves[made] is None:
                self.rank[made], self.halves[made] = r, (a, b)
        self.right_edge = [self._spine(i, 1) for i in range(size)]
        self.left_edge = [self._spine(i, 0) for i in range(size)]
        sound: dict[int, bool] = {}
        for i in sorted(names.values(), key=lambda i: self.rank[i]):
            h = self.halves[i]
            sound[i] = len(self.bytes_of[i]) == 1 if h is None else sound[h[0]] and sound[h[1]] and self._apart(*h, self.rank[i])
        self.automaton = Automaton({self.bytes_of[i]: i for i, good in sound.items() if good})
        self.pattern = regex.compile(PIECES)
        self.pairs: dict[int, bool] = {}
        self.length_of = list(map(len, self.bytes_of))
        self.units = Units(self)
        self.side_by_side = SideBySide(self)

    def _spine(self, token: int, side: int) -> list[int]:
        """The token, its half on that side, that half's half and so on down to a byte."""
        line = [token]
        while (h := self.halves[line[-1]]) is not None:
            line.append(h[side])
        return line

    def _apart(self, a: int, b: int, until: int = NEVER) -> bool:
        """Whether no merge of a rank below ``until`` joins a symbol of a with one of b.

        Walks back in time over the symbols next to the border. A pair that lies there is merged
        unless its left symbol was used up before, or its right one before that merge; of equal
        merges the leftmost comes first.
        """
        rank, merges = self.rank, self.merges
        lefts, rights = self.right_edge[a], self.left_edge[b]
        i = j = 0
        used_left = used_right = until
        while True:
            x, y = lefts[i], rights[j]
            m = merges.get((x, y))
            if m is not None and m < used_left and m <= used_right and m < until:
                return False
            if rank[x] > rank[y]:
                used_left, i = rank[x], i + 1
            elif rank[y] >= 0:
                used_right, j = rank[y], j + 1
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        """Whether b can follow a in an encoding. Remembered for a bounded number of pairs."""
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        known = self.pairs[a << 24 | b] = self._apart(a, b)
        return known

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one piece as little-endian 32-bit numbers."""
        raw = piece.encode()
        last = [-1] * (len(raw) + 1)  # the last token of each prefix
        pairs, compatible, ends, step, state = self.pairs, self.compatible, self.automaton.ends, self.automaton.step, 0
        for at, byte in enumerate(raw, 1):
            after = step[state].get(byte)
            state = self.automaton.move(state, byte) if after is None else after
            for length, token in ends[state]:
                before = last[at - length]
                if before < 0:  # only the empty prefix has none
                    last[at] = token
                    break
                fits = pairs.get(before << 24 | token)
                if fits or fits is None and compatible(before, token):
                    last[at] = token
                    break
        ids, end, length_of = [], len(raw), self.length_of
        while end:
            ids.append(token := last[end])
            end -= length_of[token]
        ids.reverse()
        return array("i", ids).tobytes()

    def _encode_plain(self, text: str) -> bytes:
        """Ids of a text without special tokens.

        No piece holds a space after another character, and a space between two characters that
        are not white space starts a piece. So a text whose spaces are all of that kind can be cut
        at them, and what follows each is encoded on its own; other texts are matched as a whole.
        """
        if not text:
            return b""
        if ODD_SPACE.search(text):
            pieces = self.pattern.findall(text)
            return b"".join(map(self.units.__getitem__, map(str.encode, pieces)))
        first, *units = text.split(" ")
        return self.units[first.encode()] + b"".join(map(self.units.__getitem__, units))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text. Special tokens written in it become their ids."""
        if not self.specials or not any(s in text for s in self.specials):
            return np.frombuffer(self._encode_plain(text), "<i4")
        out, at = [], 0
        for m in regex.finditer(self.special_pattern, text):
            out += [self._encode_plain(text[at : m.start()]), np.array([self.specials[m[0]]], "<i4").tobytes()]
            at = m.end()
        out.append(self._encode_plain(text[at:]))
        return np.frombuffer(b"".join(out), "<i4")

    def prepare(self, texts: list[str]) -> None:
        """Encode the short units that texts of the usual kind hold and the table lacks, side by side."""
        if self.units.size > TABLE_BYTES * 3 // 4:  # now rather than between these texts
            self.units.restart()
        wanted: dict[str, None] = {}
        for text in texts:
            if not ODD_SPACE.search(text):
                wanted.update((u, None) for u in set(text.split(" ")[1:]) if u not in self.units and len(u) <= LONGEST_UNIT)
            if len(wanted) >= TOGETHER:
                self._together(list(wanted))
                wanted = {}
        if wanted:
            self._together(list(wanted))

    def _together(self, units: list[str]) -> None:
        split = [self.pattern.findall(" " + u) for u in units]
        pieces = [p.encode() for found in split for p in found]
        ids = self.side_by_side.encode(pieces)
        at = 0
        for unit, found in zip(units, split):
            self.units.keep(unit, b"".join(ids[at : at + len(found)]))
            at += len(found)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 text of the ids; bytes that are no UTF-8 become U+FFFD."""
        joined = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return joined.decode("utf-8", "replace").encode()


class Units(dict):
    """Ids of stretches of text, encoded when first asked for: under its string what follows a space, with that space; under its UTF-8 bytes what does not.

    Short ones are remembered until the table reaches ``TABLE_BYTES``; then it starts anew.
    """

    def __init__(self, codec: Codec):
        self.codec, self.size = codec, 0

    def __missing__(self, unit: str | bytes) -> bytes:
        codec, spaced = self.codec, isinstance(unit, str)
        first, *others = codec.pattern.findall(" " + unit if spaced else unit.decode())
        if not others:
            ids = codec.encode_piece(first)
        else:
            start = self[first[1:]] if spaced and len(first) > 1 else self[first.encode()]
            ids = start + b"".join(map(self.__getitem__, map(str.encode, others)))
        if len(unit) <= LONGEST_UNIT:
            self.keep(unit, ids)
        return ids

    def keep(self, unit: str | bytes, ids: bytes) -> None:
        self.size += sys.getsizeof(unit) + sys.getsizeof(ids) + ENTRY_BYTES
        if self.size > TABLE_BYTES:
            self.restart()
        self[unit] = ids

    def restart(self) -> None:
        self.clear()
        self.size = 0


_CODECS: dict[str, Codec] = {}


def codec(contents: bytes) -> Codec:
    """One codec per process and vocabulary."""
    key = hashlib.sha256(contents).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(contents)
    return _CODECS[key]


def _vocabulary(df: DataFrame, path: str):
    """The vocabulary file, read where the driver runs and broadcast (its size is checked)."""
    if (size := os.path.getsize(path)) > MAX_FILE_BYTES:
        raise ValueError(f"{path}: {size} bytes; a vocabulary file has {MAX_FILE_BYTES} at most")
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32, copy=False)))


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) and ``ids_col`` array<int>: the token ids of the whole text.

    A null or empty text has no ids (an empty array). Every row is encoded on its own, so repeated
    rows and extra columns need no care; a column named like a result gives way to it. With
    ``decoded_col`` the ids are decoded again in the same pass.
    """
    shared = _vocabulary(docs, path)
    fields = [T.StructField(ids_col, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded_col, T.StringType())] if decoded_col else [])

    def build():
        own = codec(shared.value)

        def run(texts: list[bytes]) -> list:
            ids, first, size = [], 0, 0
            for k, text in enumerate(texts, 1):
                size += len(text)
                if size >= PREPARED or k == len(texts):
                    plain = [t.decode() for t in texts[first:k]]
                    own.prepare(plain)
                    ids += map(own.encode, plain)
                    first, size = k, 0
            back = [pa.array(list(map(own.decode, ids)), pa.binary()).cast(pa.string())] if decoded_col else []
            return [_lists(ids), *back]

        return run

    return map_texts(docs, text_col, T.StructType(fields), build, keep)


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """All columns, and ``text_col``: the text of the ids. Null ids give null, no ids give ''."""
    shared = _vocabulary(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for batch in batches:
            texts = [None if x is None else own.decode(np.array(x, "<i4")).decode() for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names=[*batch.schema.names[1:], text_col])

    kept = [c for c in df.columns if c != text_col]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(text_col, T.StringType())])
    ids = "__ids"
    while ids in kept:
        ids += "_"
    return df.select(F.col(f"`{ids_col}`").alias(ids), *[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def digest(encoded: DataFrame, keep: list[str], ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Columns ``keep``, the number of ids, and SHA-256 of the ids (decimal, joined by commas) and of the decoded text."""
    joined = F.array_join(F.col(ids_col).cast("array<string>"), ",")
    return encoded.select(
        *keep,
        F.size(ids_col).cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2(F.col(decoded_col), 256).alias("decoded_sha256"),
    )
