"""Byte-pair encoding and decoding with a tokenisation automaton.

The automaton reads tokens and accepts exactly the token sequences that the merge list makes.  It starts as one state
with an arc for each byte.  Then the merges are applied in order, one gadget each.  For the merge of ``u`` and ``v`` all
arcs labelled ``u`` are led to a copy of their target without its ``v`` arc, and every state with a ``u`` arc gets an
arc with the merged label to where ``v`` led.  All arcs of one label share a target, so a state is kept as its
parent and the one arc taken from it.

Compiling numbers the states so that all descendants of a state are a range, and writes down for every token the ranges of states
that lack its arc: a complete table of transitions, where (state, token) is looked up by binary search and leads to the token's own state.
A second table is the trie of the tokens' bytes.  Since every prefix of a word is accepted along exactly one path, each
byte position has one live state.  Encoding goes through the positions once, forward: the trie names the tokens that begin there, and
the table tells which of them have an arc from the live state; each makes the position where it ends live.  Nothing is tried
twice or taken back, and all new pieces of a block go through the tables together.

Edge cases: a null or empty text has no tokens (its digests are those of the empty string); repeated rows and null ids are kept
as they are; words of any length are encoded in time linear in it; the special token's text in a document becomes the special id, as the library does it;
columns other than the two named are not read.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import mapped, remembered
from .words import Lanes, WordTable, chunks, spans, text_buffers

#: Fixed value: the public byte-level pre-split pattern (white space by Unicode property).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

_BLANK, _ODD = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Lead bytes of the white space beyond ASCII.
_ODD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def outermost(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of ranges that are nested or apart, those in no other one, and neighbours joined; in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Compiled from a byte-level tokenizer file; ``labels`` are the bytes that each token's arc emits."""

    WORDS_KEPT = 200_000
    LONGEST_KEPT = 64
    #: Words up to so many bytes go through the tables side by side, one byte position at a time; longer ones each by itself.
    TOGETHER = 64

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte, vocab = byte_alphabet(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max(*vocab.values(), *self.special.values())
        self.labels: list[bytes] = [b""] * size
        for t, i in vocab.items():
            self.labels[i] = t.encode() if t in self.special else bytes(byte[c] for c in t)
        for t, i in self.special.items():
            self.labels[i] = t.encode()
        self.decimal = [str(i) for i in range(size)]
        special = set(self.special.values())
        self.tokens = {self.labels[i]: i for t, i in vocab.items() if i not in special}
        # state 0 is the start; a state is its parent without one arc, taken away at some step
        self.parent, self.without, self.since = [-1], [-1], [-1]
        self.target = {i: 0 for b, i in self.tokens.items() if len(b) == 1}
        self.made: dict[int, tuple[int, int]] = {}
        for step, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.gadget(step, vocab[a], vocab[b], vocab[a + b])
        self.compile(size)
        self.grow_trie()
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.chunks = WordTable()

    def gadget(self, step: int, u: int, v: int, merged: int) -> None:
        old = self.target[u]
        self.parent.append(old)
        self.without.append(v)
        self.since.append(step)
        self.target[u] = len(self.parent) - 1
        self.target[merged] = old if u == v else self.target[v]
        self.made[merged] = (step, u)

    def compile(self, size: int) -> None:
        """The table of transitions: each token's own state, and the bounds of the ranges of states that lack its arc."""
        n = len(self.parent)
        children: list[list[int]] = [[] for _ in range(n)]
        takers: dict[int, list[int]] = {}
        enter, leave = [0] * n, [0] * n
        for s in range(1, n):
            children[self.parent[s]].append(s)
            takers.setdefault(self.without[s], []).append(s)
        clock, stack = 0, [0]
        while stack:
            s = stack.pop()
            if s < 0:
                leave[~s] = clock
                continue
            enter[s] = clock
            clock += 1
            stack.append(~s)
            stack += children[s]
        own = np.zeros(size, np.int64)
        for t, s in self.target.items():
            own[t] = enter[s]
        # what a token's arc needs of its first part: that had an arc when the merge was made
        needs: dict[int, list[tuple[int, int]]] = {}
        keys: list[np.ndarray] = []
        for t in self.target:
            needs.setdefault(t, [])
        for t, (step, first) in self.made.items():
            taken = takers.get(first, ())
            before = taken[: bisect_right(taken, step, key=self.since.__getitem__)]
            needs[t] = outermost([(enter[z], leave[z]) for z in before] + needs[first])
        for t in self.target:
            lack = outermost([(enter[z], leave[z]) for z in takers.get(t, ())] + needs[t])
            if lack:
                keys.append((t << 32) + np.array(lack, np.int64).ravel())
        self.own = own
        self.lacks = np.sort(np.concatenate(keys))
        self.first_key = np.searchsorted(self.lacks, np.arange(size, dtype=np.int64) << 32)

    def has_arc(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Table look-up: a state that is within an odd number of a token's bounds lacks its arc."""
        return (np.searchsorted(self.lacks, (token.astype(np.int64) << 32) + state, "right") - self.first_key[token]) & 1 == 0

    def grow_trie(self) -> None:
        """Nodes of the tokens' bytes: sorted (node, byte) keys, their children, and the token that ends at each node."""
        number, keys, ends = {b"": 0}, [], [-1]
        for b, i in self.tokens.items():
            for n in range(1, len(b) + 1):
                if b[:n] not in number:
                    number[b[:n]] = len(ends)
                    keys.append(number[b[: n - 1]] << 8 | b[n - 1])
                    ends.append(-1)
            ends[number[b]] = i
        keys_of = np.array(keys, np.int64)
        order = np.argsort(keys_of)
        self.trie_keys, self.trie_nodes, self.trie_ends = keys_of[order], order + 1, np.array(ends, np.int64)
        self.roots = np.zeros(256, np.int64)
        self.roots[keys_of[keys_of < 256]] = np.nonzero(keys_of < 256)[0] + 1

    def tokens_at(self, data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every (position, token, length) of a token that begins at a position and ends by its ``stop``, shorter ones first."""
        at, node, length = np.arange(len(data)), self.roots[data], 1
        places, found, lengths = [], [], []
        while len(at):
            token = self.trie_ends[node]
            hit = token >= 0
            places.append(at[hit])
            found.append(token[hit])
            lengths.append(np.full(int(hit.sum()), length))
            going = at + length < stop[at]
            at, node = at[going], node[going]
            key = node << 8 | data[at + length]
            place = np.minimum(np.searchsorted(self.trie_keys, key), len(self.trie_keys) - 1)
            going = self.trie_keys[place] == key
            at, node, length = at[going], self.trie_nodes[place[going]], length + 1
        return np.concatenate(places or [at]), np.concatenate(found or [at]), np.concatenate(lengths or [at])

    def spell(self, pieces: list[bytes]) -> list[bytes]:
        """The ids (little-endian, four bytes each) of pre-split words, none of them empty."""
        out: list[bytes] = [b""] * len(pieces)
        short = [i for i, w in enumerate(pieces) if len(w) <= self.TOGETHER]
        for i, w in enumerate(pieces):
            if len(w) > self.TOGETHER:
                out[i] = self.spell_long(w)
        if not short:
            return out
        data = np.frombuffer(b"".join([pieces[i] for i in short]), np.uint8)
        sizes = np.array([len(pieces[i]) for i in short])
        n = len(sizes)
        word = np.repeat(np.arange(n), sizes)
        stop = np.cumsum(sizes)
        place, token, length = self.tokens_at(data, np.repeat(stop, sizes))
        # a word of so many bytes has one more positions: each is an entry of ``last``, the token that ends there
        begin = stop - sizes + np.arange(n)
        start = place + word[place]
        ahead = start - begin[word[place]]
        order = np.argsort(ahead, kind="stable")
        start, token, length = start[order], token[order], length[order]
        cuts = np.searchsorted(ahead[order], np.arange(int(sizes.max()) + 1))
        last = np.full(len(data) + n, -1, np.int64)
        state = np.zeros(len(data) + n, np.int64)
        span = np.zeros(len(data) + n, np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            s, t, k = start[a:b], token[a:b], length[a:b]
            ok = self.has_arc(state[s], t)
            to = s[ok] + k[ok]
            last[to], span[to] = t[ok], k[ok]
            state[to] = self.own[t[ok]]
        at, which = begin + sizes, np.arange(n)
        ids, words, turns = [], [], []
        while len(which):
            ids.append(last[at])
            words.append(which)
            turns.append(np.full(len(which), -len(turns)))
            at = at - span[at]
            going = at > begin[which]
            at, which = at[going], which[going]
        which, turn = np.concatenate(words), np.concatenate(turns)
        order = np.lexsort((turn, which))
        flat, counts = np.concatenate(ids)[order].astype("<u4").tobytes(), np.bincount(which, minlength=n)
        ends = (4 * np.cumsum(counts)).tolist()
        for i, a, b in zip(short, [0, *ends[:-1]], ends, strict=True):
            out[i] = flat[a:b]
        return out

    def spell_long(self, w: bytes) -> bytes:
        """As ``spell``, for one word, position by position."""
        place, token, length = self.tokens_at(np.frombuffer(w, np.uint8), np.full(len(w), len(w)))
        order = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[order], np.arange(len(w) + 1)).tolist()
        token, length = token[order], length[order]
        own, first = self.own[token].tolist(), self.first_key[token].tolist()
        keys, token, length = (token << 32).tolist(), token.tolist(), length.tolist()
        last, state, lacks, seen = [-1] * (len(w) + 1), [0] * (len(w) + 1), self.lacks, {}
        for i in range(len(w)):
            s = state[i]
            for j in range(cuts[i], cuts[i + 1]):
                key = keys[j] + s
                ok = seen.get(key)
                if ok is None:
                    ok = seen[key] = (int(lacks.searchsorted(key, "right")) - first[j]) & 1 == 0
                if ok:
                    last[i + length[j]], state[i + length[j]] = j, own[j]
        ids, at = [], len(w)
        while at:
            ids.append(token[last[at]])
            at -= length[last[at]]
        return np.array(ids[::-1], "<u4").tobytes()

    def encode(self, text: str) -> list[int]:
        if self.splitter is not None and any(t in text for t in self.special):
            return [i for x in self.splitter.split(text) if x for i in ([self.special[x]] if x in self.special else np.frombuffer(self.encode_plain([x])[0], "<u4").tolist())]
        return np.frombuffer(self.encode_plain([text])[0], "<u4").tolist()

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens."""
        known, split = self.known, [WORDS.findall(t) for t in texts]
        if len(known) > self.WORDS_KEPT:
            known.clear()
        new = [w for w in {w for words in split for w in words} if w not in known]
        made = dict(zip(new, self.spell([w.encode() for w in new]), strict=True))
        out = [b"".join([known[w] if w in known else made[w] for w in words]) for words in split]
        known.update((w, ids) for w, ids in made.items() if len(w) <= self.LONGEST_KEPT)
        return out

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
        """Ids of each of some texts in one byte array.

        A single blank between other characters always goes with what follows it, and a single line end is a word by itself, so texts are
        cut there; the distinct pieces of the block are looked up by hash and compared byte for byte, and only new ones go through the automaton.  Texts that may
        hold other white space than ASCII's, or a special token, are encoded by themselves.
        """
        n = len(offsets) - 1
        odd = np.concatenate(([0], np.cumsum(_ODD[data])))
        slow = odd[offsets[1:]] > odd[offsets[:-1]]
        if self.special and (b"<|" in data.tobytes() or not all(t.startswith("<|") for t in self.special)):
            slow = np.array([s or any(t.encode() in data[a:b].tobytes() for t in self.special) for s, a, b in zip(slow.tolist(), offsets[:-1], offsets[1:], strict=True)], bool)
        out: list[list[int]] = [[]] * n
        if not slow.all() and len(data):
            blank = _BLANK[data]
            alone = np.zeros(len(data), bool)
            alone[1:-1] = ~blank[:-2] & ~blank[2:]
            cuts = alone & (data == 32)
            line = alone & (data == 10)
            cuts |= line
            cuts[1:] |= line[:-1]
            starts, stops = spans(data, offsets, np.ones(len(data), bool), cuts)
            quick = ~slow[np.searchsorted(offsets, starts, "right") - 1]
            starts, stops = starts[quick], stops[quick]

            def fill(fresh: np.ndarray) -> list[bytes]:
                return self.encode_plain([data[a:b].tobytes().decode() for a, b in zip(starts[fresh].tolist(), stops[fresh].tolist(), strict=True)])

            ids, ends = self.chunks.gather(Lanes(data, starts, stops), fill)
            cut = np.concatenate(([0], ends))[np.searchsorted(starts, offsets)].tolist()
            flat = ids.tolist()
            out = [flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        for d in np.nonzero(slow)[0].tolist():
            out[d] = self.encode(data[offsets[d] : offsets[d + 1]].tobytes().decode())
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


def compiled(path: str) -> Automaton:
    return remembered(("automaton", path), lambda: Automaton(path))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the token ids (array<int>) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = compiled(path)
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for i, j in chunks(offsets):
                got = a.encode_block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i).cast(pa.int64()), pa.array(got, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").transform(mapped, run, "doc_id long, ids array<int>")


def decode_documents(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of each row's ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = compiled(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([a.decode(x or []) for x in part.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").transform(mapped, run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Digests of each text's ids and of the text that these decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = compiled(path)
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            data, offsets = text_buffers(batch.column("text"))
            for i, j in chunks(offsets):
                for ids in a.encode_block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                    out[0].append(len(ids))
                    out[1].append(hashlib.sha256(",".join(map(a.decimal.__getitem__, ids)).encode()).hexdigest())
                    out[2].append(hashlib.sha256(a.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").transform(mapped, run, SCHEMA)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    import public_tokenizers

    from .common import table

    return round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
