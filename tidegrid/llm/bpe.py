"""Byte-level BPE by a lazily determinised transducer, and streaming decoding by a UTF-8 state machine.

Encoding a prefix always has one last token: the token t at its end for which the encoding of what stands before t ends in a
token that stays apart from t.  A transducer can therefore read bytes left to right with a few threads, one for each place
where the token in progress may have begun.  A thread holds its node in the trie of tokens and the last token before its
place.  The set of threads is the deterministic state; the output of a transition is the token that ends at its byte, and the
tokens of a text are those outputs followed back from its end.  A token is certain as soon as the paths back from all threads
meet before it, which takes at most as many bytes of lookahead as the longest token has.

States and transitions are made when a text first needs them and kept in a table, which is emptied when it grows past a bound.
Many short pieces go through it in step, a byte of each at a time, so a transition that is known costs no Python.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import regex

from tidegrid.llm.common import slot

END = 1 << 40
#: Longer pieces are streamed on their own.
IN_STEP = 128
#: A thread is its node, shifted, and the token before it.
SHIFT = 21
LOW = (1 << SHIFT) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class Transitions:
    """Open addressing from (state, byte) to (next state, token that ends here), looked up for many keys at once."""

    def __init__(self):
        self.size, self.bits = 0, 16
        self._empty()

    def _empty(self) -> None:
        n = 1 << self.bits
        self.keys, self.next, self.mark = np.full(n, -1, np.int64), np.zeros(n, np.int32), np.zeros(n, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where there is none."""
        at, out, open_ = self._slots(keys), np.full(len(keys), -1, np.int64), np.arange(len(keys))
        while len(open_):
            here = self.keys[at]
            met = here == keys[open_]
            out[open_[met]] = at[met]
            go = ~met & (here >= 0)
            open_, at = open_[go], (at[go] + 1) & (len(self.keys) - 1)
        return out

    def add(self, keys: np.ndarray, following: np.ndarray, mark: np.ndarray) -> None:
        """Put in distinct keys that aren't there."""
        if 2 * (self.size + len(keys)) > len(self.keys):
            old = self.keys >= 0
            kept = self.keys[old], self.next[old], self.mark[old]
            while 2 * (self.size + len(keys)) > 1 << self.bits:
                self.bits += 1
            self._empty()
            self.size = 0
            self.add(*kept)
        self.size += len(keys)
        at = self._slots(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several for one place the last wins
            won = free & (self.keys[at] == keys)
            self.next[at[won]], self.mark[at[won]] = following[won], mark[won]
            keys, following, mark, at = keys[~won], following[~won], mark[~won], (at[~won] + 1) & (len(self.keys) - 1)


class Transducer:
    """Encodes pieces of bytes, by ranks in which every single byte is a token."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = 200_000, most_apart: int = 600_000):
        assert max(ranks.values()) < LOW - 1
        self.ranks, self.most, self.most_apart = ranks, most_states, most_apart
        self.spelled = {i: t for t, i in ranks.items()}
        self.length = np.zeros(max(self.spelled) + 1, np.int64)
        for i, t in self.spelled.items():
            self.length[i] = len(t)
        self.shared = np.arange(len(self.length)).astype(object)
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        self.token, self.depth = [-1], [0]
        self.inner: set[int] = set()
        for text, i in ranks.items():
            node = 0
            for b in text:
                self.inner.add(node)
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = self.child[node << 8 | b] = len(self.token)
                    self.token.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = nxt
            self.token[node] = i
        self.apart: dict[int, bool] = {}  # (token before + 1) << SHIFT | token
        self.grown: dict[int, tuple | None] = {}
        self.forget()

    def forget(self) -> None:
        """Empty the table of states."""
        self.states: dict[tuple[int, ...], int] = {}
        self.configs: list[tuple[int, ...]] = []  # threads as node << SHIFT | token before + 1
        self.moves = Transitions()
        self.start = self._state((0,))

    def merged(self, text: bytes) -> list[int]:
        """The defining rule: merge the adjacent pair of lowest rank, the leftmost first, until no pair is a token."""
        return [self.ranks[p] for p in list(self._steps(text))[-1]]

    def _steps(self, text: bytes) -> Iterator[list[bytes]]:
        """The parts before the first merge and after each."""
        parts = [text[i : i + 1] for i in range(len(text))]
        yield parts
        while len(parts) > 1:
            best, at = min(((self.ranks.get(a + b, END), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(END, 0))
            if best == END:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            yield parts

    def _growth(self, token: int) -> tuple | None:
        """How a token's own merges make its first and its last part, each as (parts, ranks at which they come, then END); None
        for a token that isn't its own encoding."""
        if token not in self.grown:
            first, last = [], []
            for parts in self._steps(self.spelled[token]):
                for grown, part in ((first, parts[0]), (last, parts[-1])):
                    if not grown or grown[-1] != part:
                        grown.append(part)
            own = len(parts) == 1
            self.grown[token] = tuple((g, [*(self.ranks[p] for p in g), END]) for g in (first, last)) if own else None
        return self.grown[token]

    def _stands(self, before: int, token: int) -> bool:
        """Whether a token is its own encoding and stays apart from the token before it.

        Merges come in the order of their ranks, so at any time one part stands at either side of the border; the two are
        merged if their rank comes before either grows (on the left first, where ranks are equal).
        """
        known = self.apart.get(before + 1 << SHIFT | token)
        if known is None:
            known = (right := self._growth(token)) is not None
            if known and before >= 0:
                (_, (left, left_at)), ((right, right_at), _) = self._growth(before), right
                i = j = 0
                while i < len(left) and j < len(right):
                    rank = self.ranks.get(left[i] + right[j], END)
                    if rank < left_at[i + 1] and rank <= right_at[j + 1] and rank < END:
                        known = False
                        break
                    if left_at[i + 1] <= right_at[j + 1]:
                        i += 1
                    else:
                        j += 1
            self.apart[before + 1 << SHIFT | token] = known
        return known

    def _state(self, config: tuple) -> int:
        at = self.states.get(config)
        if at is None:
            at = self.states[config] = len(self.configs)
            self.configs.append(config)
        return at

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        """Determinise one step: the next state and the token that ends at this byte."""
        threads, ended = [], -1
        child, token, inner, apart = self.child, self.token, self.inner, self.apart
        for thread in self.configs[state]:
            node = child.get(thread >> SHIFT << 8 | byte)
            if node is None:
                continue
            before = thread & LOW
            own = token[node]
            if own >= 0 and ended < 0:
                known = apart.get(before << SHIFT | own)
                if self._stands(before - 1, own) if known is None else known:
                    ended = own
            if node in inner:
                threads.append(node << SHIFT | before)
        assert ended >= 0, "every byte must be a token"
        threads.append(ended + 1)
        return self._state(tuple(threads)), ended

    def _step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = state.astype(np.int64) << 8 | byte
        at = self.moves.find(key)
        if (at < 0).any():
            new = np.unique(key[at < 0])
            made = [self._move(k >> 8, k & 255) for k in new.tolist()]
            self.moves.add(new, np.array([m[0] for m in made], np.int32), np.array([m[1] for m in made], np.int32))
            at = self.moves.find(key)
        return self.moves.next[at], self.moves.mark[at]

    def stream(self, text: Iterable[int]) -> Iterator[int]:
        """Token ids as soon as they're certain."""
        state, done, seen, ends, known = self.start, 0, 0, {}, {}
        for b in text:
            got = known.get((state, b))
            if got is None:
                if len(known) > self.most:
                    known.clear()
                got = known[state, b] = self._move(state, b)
            state, ends[seen + 1] = got
            seen += 1
            open_ = {seen - self.depth[thread >> SHIFT] for thread in self.configs[state]}
            while len(open_) > 1:  # back to where all paths meet
                last = max(open_)
                open_.remove(last)
                open_.add(last - len(self.spelled[ends[last]]))
            met = open_.pop()
            if met > done:
                yield from self._back(ends, done, met)
                for k in range(done + 1, met + 1):
                    del ends[k]
                done = met
        yield from self._back(ends, done, seen)

    def _back(self, ends: dict[int, int], lo: int, hi: int) -> list[int]:
        out = []
        while hi > lo:
            out.append(ends[hi])
            hi -= len(self.spelled[out[-1]])
        return out[::-1]

    def encode_all(self, texts: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each text; those up to IN_STEP bytes go through the table together.

        A text that is a token is that token, as in tiktoken, also where merges would never make it.
        """
        if len(self.configs) > self.most:
            self.forget()
        if len(self.apart) > self.most_apart:
            self.apart.clear()
        out: list = [None] * len(texts)
        for k, t in enumerate(texts):
            if not t:
                out[k] = ()
            elif len(t) > IN_STEP:
                out[k] = tuple(self.stream(t))
        rest = sorted((k for k, x in enumerate(out) if x is None), key=lambda k: -len(texts[k]))
        if rest:
            self._in_step(texts, rest, out)
        for k, t in enumerate(texts):
            if len(out[k]) > 1 and (whole := self.ranks.get(t)) is not None:
                out[k] = (whole,)
        return out

    def _in_step(self, texts: list[bytes], rest: list[int], out: list) -> None:
        """Fill in the ids of the texts in ``rest``, longest first."""
        data = np.frombuffer(b"".join([texts[k] for k in rest]), np.uint8)
        size = np.array([len(texts[k]) for k in rest])
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        state, mark = np.full(len(rest), self.start, np.int32), np.zeros(len(data), np.int32)
        for i in range(int(size[0])):
            n = int(np.searchsorted(-size, -i, side="left"))
            place = start[:n] + i
            state[:n], mark[place] = self._step(state[:n], data[place])
        left, who, rounds = size.copy(), np.arange(len(rest)), []
        while len(who):
            token = mark[start[who] + left[who] - 1]
            rounds.append((who, token))
            left[who] -= self.length[token]
            who = who[left[who] > 0]
        count = np.zeros(len(rest), np.int64)
        for who, _ in rounds:
            count[who] += 1
        end = np.cumsum(count)
        ids = np.zeros(end[-1], np.int64)
        for r, (who, token) in enumerate(rounds):
            ids[end[who] - 1 - r] = token
        ids = self.shared[ids].tolist()  # one object for each id, however often it stands
        for k, b, n in zip(rest, end.tolist(), count.tolist(), strict=True):
            out[k] = tuple(ids[b - n : b])

    def encode(self, piece: bytes) -> tuple[int, ...]:
        return self.encode_all([piece])[0]


class Tokenizer:
    """Splits a text by a pattern and encodes each match on its own; no special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_cached: int = 9_000_000):
        self.transducer, self.most, self.held = Transducer(ranks), most_cached, 0
        self.split = regex.compile(pattern).findall
        self.pieces: dict[str, tuple[int, ...]] = {}  # emptied when it holds more characters than the bound
        self.bytes_of = self.transducer.spelled
        self.name_of = {i: str(i) for i in self.bytes_of}

    def encode_texts(self, texts: list[str | None]) -> Iterator[list[int]]:
        """Ids of each whole text; none for null or empty.  What isn't known of them all is encoded together."""
        split = [self.split(t) if t else [] for t in texts]
        if self.held > self.most:
            self.pieces.clear()
            self.held = 0
        new = list(set().union(*split).difference(self.pieces))
        self.pieces.update(zip(new, self.transducer.encode_all([x.encode() for x in new]), strict=True))
        long = [x for x in new if len(x) > IN_STEP]
        self.held += sum(map(len, new)) - sum(map(len, long)) + 24 * len(new)
        for pieces in split:
            yield list(chain.from_iterable(map(self.pieces.__getitem__, pieces)))
        for x in long:
            del self.pieces[x]

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_texts([text]))

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as soon as its characters are whole; bytes that are no UTF-8 become U+FFFD."""
        machine = Utf8()
        for i in ids:
            if text := machine.feed(self.bytes_of[i]):
                yield text
        if text := machine.end():
            yield text

    def id_digest(self, ids: list[int]) -> str:
        return hashlib.sha256(",".join(map(self.name_of.__getitem__, ids)).encode()).hexdigest()


class Utf8:
    """An incremental UTF-8 machine.  Its state is the beginning of a character still open, at most three bytes."""

    def __init__(self):
        self.open = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that may still be completed."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 1
            if need <= back:
                return 0
            if back > 1:
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(b, (0x80, 0xBF))
                if not low <= data[1 - back] <= high:
                    return 0
            return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.open + data
        n = self._unfinished(data)
        self.open = data[len(data) - n :]
        return data[: len(data) - n].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", "replace")


def encode_documents(docs, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, round_trip: bool = True):
    """(id, n_tokens, ids array<int>, ids_sha256, decoded_sha256, round_trip) of every row, null texts as empty.

    The ids are decoded again in slices through the UTF-8 machine; ``decoded_sha256`` is of the decoded bytes and
    ``round_trip`` says whether the decoded text is the text.  Repeated rows each keep a row, a null id stays null, other
    columns are ignored, and an empty table gives no rows.  ``keep_ids=False`` leaves the ids out; ``round_trip=False`` doesn't
    compare the decoded text, of which it still gives the digest, and has null there.  Nothing is shuffled.
    """
    from pyspark.sql import functions as F

    schema = "doc_id long, n_tokens long, " + "ids array<int>, " * keep_ids + "ids_sha256 string, decoded_sha256 string, round_trip boolean"

    def run(batches):
        import pyarrow as pa

        t = slot(("bpe", path, pattern), lambda: Tokenizer(load_ranks(path), pattern))
        for batch in batches:
            at = 0
            for part in blocks(batch.column(1)):  # what leaves at once is bounded by a block, not by a batch
                rows, texts = [], [x or "" for x in part.to_pylist()]
                for text, ids in zip(texts, t.encode_texts(texts), strict=True):
                    machine, digest, same, done = Utf8(), hashlib.sha256(), True, 0
                    for k in range(0, len(ids), 4096):
                        data = t.decode_bytes(ids[k : k + 4096])
                        digest.update(data)
                        if round_trip:
                            got = machine.feed(data)
                            same &= text.startswith(got, done)
                            done += len(got)
                    same &= not round_trip or text[done:] == machine.end()
                    rows.append((len(ids), array("i", ids) if keep_ids else None, t.id_digest(ids), digest.hexdigest(), same if round_trip else None))
                n, ids, a, b, same = zip(*rows, strict=True)
                cols = [batch.column(0)[at : at + len(part)], pa.array(n, pa.int64()), *([_lists(ids)] if keep_ids else []), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(same, pa.bool_())]
                at += len(part)
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", *(["ids"] if keep_ids else []), "ids_sha256", "decoded_sha256", "round_trip"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _lists(ids: Iterable[array]):
    import pyarrow as pa

    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.frombuffer(x, np.int32) for x in ids if len(x)] or [np.zeros(0, np.int32)])))


def blocks(column):
    """Slices of whole texts of about a MB."""
    from tidegrid.llm.textscan import pieces, texts_of

    for lo, hi in pieces(texts_of(column)[1]):
        yield column[lo:hi]
