"""Byte-level BPE: a lazily determinised transducer encodes, an incremental UTF-8 machine decodes.

Encoding. A text is cut into matches of the tokenizer's pattern, and each match is fed, byte by
byte, to a finite-state transducer compiled from the ranks. A state stands for the bytes read
since the last emitted boundary. A boundary between two tokens is final once every way on agrees
on it: a later token that covers the present position must start at a place from which the bytes
so far are a proper prefix of a vocabulary entry, so only those starts (at most as many as the
longest entry has bytes: the bounded lookahead) and their own tokenisations need to be compared.
Their common leading tokens are emitted. States and moves are made when first met and kept in a
table of bounded size, which is emptied when full; nothing depends on what it holds.

Decoding. Ids become bytes; ``StreamingDecoder`` turns any split of the id stream into text
without ever cutting a code point, by a table-driven UTF-8 machine. ``decoded_sha256`` digests what it
yields, portion after portion of PORTION ids, for each text.

Edge cases: a null text is an empty one; empty texts have no ids; a code point that UTF-8 can't
carry (a lone surrogate) becomes U+FFFD, as in the usual libraries; texts of any length are read
whole, in one pass and with memory in proportion to the text; null and repeated ids are rows like
others; an empty table gives an empty result; other columns of the table are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm.common import lean, ship_package

#: White space as Unicode defines it (Python's own classes add U+001C to U+001F).
WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Ids that the decoder is fed at once.
PORTION = 4096
#: The bits of a move that name the state.
LOW = (1 << 40) - 1
#: Most moves of the transducer; the tables of pairs and of runs are parts of that.
MEMO = 600_000


class Memo:
    """A table of bounded size: when its newer half is full it becomes the older one, and what is asked for again moves back."""

    def __init__(self, most: int):
        self.half, self.new, self.old = max(1, most // 2), {}, {}

    def aged(self, key):
        """What the older half knows, or None."""
        value = self.old.get(key)
        if value is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.new) >= self.half:
            self.old, self.new = self.new, {}
        self.new[key] = value


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from the lines ``base64 rank`` of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Transducer:
    """Encoder of single pattern matches."""

    def __init__(self, ranks: dict[bytes, int], memo: int = MEMO):
        self.ranks = ranks
        self.memo = memo
        self.longest = max(map(len, ranks), default=1)
        #: Proper prefixes of entries: what a token under way may look like.
        self.prefixes = {t[:i] for t in ranks for i in range(1, len(t))}
        self.pairs = Memo(memo // 4)
        self._reset()

    def _reset(self) -> None:
        #: Moves: 256 * state + byte -> next state times 256, and above bit 40 the number of what is emitted.
        self.moves: dict[int, int] = {}
        self.emitted: list[tuple[int, ...]] = [()]
        self.emits: dict[tuple[int, ...], int] = {(): 0}
        self.ends: dict[int, tuple[int, ...]] = {}
        #: Of each state: the bytes read since the last boundary; for each of their prefixes the length of its last token.
        self.pending: list[tuple[bytes, tuple[int, ...]]] = [(b"", ())]
        self.number: dict[bytes, int] = {b"": 0}

    def merge(self, word: bytes) -> list[bytes]:
        """The plain definition: merge the adjacent pair of lowest rank, leftmost first, until none is left."""
        parts = [word[i : i + 1] for i in range(len(word))]
        rank = self.ranks.get
        none = 1 << 62
        pairs = [rank(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
        while pairs and (best := min(pairs)) != none:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], none)
        return parts

    def _stands(self, left: bytes, right: bytes) -> bool:
        """Whether right can follow left: the merges of both together give just them."""
        known = self.pairs.new.get((left, right))
        if known is None:
            known = self.pairs.aged((left, right))
        if known is None:
            known = self.merge(left + right) == ([left, right] if left else [right])
            self.pairs.put((left, right), known)
        return known

    def _step(self, state: int, byte: int) -> int:
        read, last = self.pending[state >> 8]
        read += bytes((byte,))
        n, ranks = len(read), self.ranks
        starts = range(max(0, n - self.longest), n)
        for start in starts:  # the one token that can end here: the tokens before it and it stand together
            token = read[start:]
            if token in ranks and self._stands(read[start - last[start - 1] : start] if start else b"", token):
                last += (n - start,)
                break
        cut = n
        for start in starts:  # the last boundary that all ways on share
            if read[start:] in self.prefixes:
                at = start
                while at != cut:
                    if at > cut:
                        at -= last[at - 1]
                    else:
                        cut -= last[cut - 1]
                if not cut:
                    break
        out, at = [], cut
        while at:
            out.append(ranks[read[at - last[at - 1] : at]])
            at -= last[at - 1]
        rest = read[cut:]
        to = self.number.get(rest)
        if to is None:
            to = self.number[rest] = len(self.pending) << 8
            self.pending.append((rest, last[cut:]))
        ids = tuple(reversed(out))
        number = self.emits.get(ids)
        if number is None:
            number = self.emits[ids] = len(self.emitted)
            self.emitted.append(ids)
        self.moves[state | byte] = move = to | number << 40
        return move

    def encode(self, word: bytes) -> list[int]:
        """Ids of one match."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        if len(self.moves) > self.memo:
            self._reset()
        state, at, out, get = 0, 0, [], self.moves.get
        for byte in word:
            state = get(state | byte)
            if state is None:
                state = self._step(at, byte)
            if state > LOW:
                out += self.emitted[state >> 40]
                state &= LOW
            at = state
        end = self.ends.get(state)
        if end is None:
            end = self.ends[state] = tuple(self.ranks[p] for p in self.merge(self.pending[state >> 8][0]))
        out += end
        return out


def utf8(text: str) -> bytes:
    try:
        return text.encode()
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode()


class Encoder:
    """Encoder of whole texts. Runs of non-space are memoised, for most words come again."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = MEMO):
        import regex

        self.machine = Transducer(ranks, memo)
        self.match = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{WS}\p{{L}}\p{{N}}]").replace(r"\s", f"[{WS}]").replace(r"\S", f"[^{WS}]"))
        #: Where the pattern always has a boundary: before a run of non-space and the one space that leads it.
        self.chunk = re.compile(rf" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
        self.known = Memo(2 * memo // 3)
        #: Ids are kept packed, in as few bytes as the largest needs.
        self.code = "H" if max(ranks.values(), default=0) < 1 << 16 else "I"

    def _chunk(self, chunk: str) -> bytes:
        aged = self.known.aged(chunk)
        if aged is not None:
            return aged
        out: list[int] = []
        for word in self.match.findall(chunk):
            out += self.machine.encode(utf8(word))
        ids = array(self.code, out).tobytes()
        if len(chunk) <= 64:
            self.known.put(chunk, ids)
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[bytes] = []
        get, make, add = self.known.new.get, self._chunk, out.append
        for chunk in self.chunk.findall(text):
            ids = get(chunk)
            add(ids if ids is not None else make(chunk))
        return array(self.code, b"".join(out)).tolist()


def _machine() -> tuple[list[list[int]], int]:
    """Moves of the UTF-8 machine: state 0 between code points, 1 to 7 inside one, 8 for an error."""
    bad = 8
    table = [[bad] * 256 for _ in range(9)]
    ranges = {0: [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)]}
    ranges |= {1: [(0x80, 0xBF, 0)], 2: [(0x80, 0xBF, 1)], 3: [(0x80, 0xBF, 2)], 4: [(0xA0, 0xBF, 1)], 5: [(0x80, 0x9F, 1)], 6: [(0x90, 0xBF, 2)], 7: [(0x80, 0x8F, 2)]}
    for state, spans in ranges.items():
        for lo, hi, to in spans:
            table[state][lo : hi + 1] = [to] * (hi - lo + 1)
    return table, bad


UTF8, BAD = _machine()


#: Runs of ASCII and of other bytes.
RUNS = re.compile(rb"[\x00-\x7f]+|[\x80-\xff]+")
REPLACEMENT = "\ufffd".encode()


class StreamingDecoder:
    """feed() takes ids in any portions and returns the text that is complete so far; finish() the rest.

    Bytes that can't be part of UTF-8 become U+FFFD, one for each maximal broken piece.
    """

    def __init__(self, tokens: dict[int, bytes] | list[bytes]):
        self.tokens = tokens
        self.state = 0
        self.open = bytearray()

    def feed(self, ids: Iterable[int]) -> str:
        return self.feed_bytes(b"".join(map(self.tokens.__getitem__, ids)))

    def feed_bytes(self, data: bytes) -> str:
        if not self.open and data.isascii():
            return data.decode("ascii")
        done = bytearray()
        for run in RUNS.findall(data):
            if not self.open and run[0] < 0x80:  # between code points ASCII is complete as it is
                done += run
                continue
            for at, byte in enumerate(run):
                to = UTF8[self.state][byte]
                if to == BAD:
                    if self.open:  # what was open is broken; the byte may begin anew
                        done += REPLACEMENT
                        self.open.clear()
                        to = UTF8[0][byte]
                    if to == BAD:
                        done += REPLACEMENT
                        self.state = 0
                        continue
                self.open.append(byte)
                self.state = to
                if to == 0:
                    done += self.open
                    self.open.clear()
                    if byte < 0x80:
                        done += run[at + 1 :]
                        break
        return done.decode()

    def finish(self) -> str:
        broken, self.state = bool(self.open), 0
        self.open.clear()
        return "�" if broken else ""


#: The encoder of this worker process: its memo serves all tasks that run here.
_OWN: dict[tuple, Encoder] = {}


def own_encoder(data: bytes, pattern: str, memo: int = MEMO) -> Encoder:
    key = (hashlib.sha256(data).digest(), pattern, memo)
    if key not in _OWN:
        _OWN.clear()
        _OWN[key] = Encoder(load_ranks(data), pattern, memo)
    return _OWN[key]


def encode_documents(df: DataFrame, ranks_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, memo: int = MEMO) -> DataFrame:
    """One row for each row of df: the id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids.

    ranks_file is the content of a rank file; it goes to each executor once, and 64 MB bound it. ``memo`` bounds a
    worker's tables: 600,000 take about 190 MB after 60,000 texts, 150,000 about 70 and half as much time again.
    A map over Arrow batches without a shuffle: a lost task repeats its own batches only.
    """
    if len(ranks_file) > 64 << 20:
        raise ValueError("a rank file of more than 64 MB is not broadcast")
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(ranks_file)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = own_encoder(shared.value, pattern, memo)
        ranks = encoder.machine.ranks
        token = [b""] * (max(ranks.values(), default=0) + 1)
        for t, i in ranks.items():
            token[i] = t
        shown = [str(i) for i in range(len(token))]
        sha = hashlib.sha256

        def decoded(ids: list[int]) -> str:
            decoder, digest = StreamingDecoder(token), sha()
            for start in range(0, len(ids), PORTION):
                digest.update(decoder.feed(ids[start : start + PORTION]).encode())
            digest.update(decoder.finish().encode())
            return digest.hexdigest()

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                n, a, b, kept = [], [], [], []
                for text in batch.column(1).to_pylist():
                    ids = encoder.encode(text or "")
                    n.append(len(ids))
                    a.append(sha(" ".join([shown[i] for i in ids]).encode()).hexdigest())
                    b.append(decoded(ids))
                    if with_ids:
                        kept.append(ids)
                cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols, names = [*cols, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return df.select(id_col, text_col).mapInArrow(lean(run), schema)
