"""BPE encoding and decoding (operator 1): a bounded-lookahead streaming transducer.

Method. A text goes through one :class:`Transducer`, a block of characters a time. It cuts pre-tokens and merges their bytes as they
come, and emits a token once it is stable. Two things make one stable:

* the end of its pre-token, which is known a few characters later (LOOK) and over which no merge reaches;
* within a pre-token of any length, distance: from the merge list alone we compute how many bytes past the end of a merge's own bytes
  can still decide whether that merge happens (:func:`sufficient_lookahead`). A token that ends at least that many bytes before the
  end of what has been read can never change any more. To the right of an emitted boundary the encoding is that of the rest alone, so it goes on from there.

So what a transducer holds is bounded by a block and the lookahead, never by the text or a pre-token. A worker remembers the ids of short
pre-tokens that have been settled; that saves merging them again and changes nothing else. Decoding maps ids to bytes and runs an incremental UTF-8 state
machine over them.

Defined cases: null text counts as empty; empty text gives no ids and the digest of nothing; ill-formed byte sequences
decode to U+FFFD per maximal invalid part; rows are independent, so repeats and ties need no rule; an empty table gives
an empty result; columns of the input other than the id and the text are not read. A vocabulary file with options that this encoder does
not know (dropout, ignored merges, added tokens that strip or need word ends) is refused.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import itertools
import json
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters and numbers that Unicode 16.0 added, which the tokenizers library knows (first, last, class).
UNICODE_16 = [
    (0x1C89, 0x1C8A, "L"), (0xA7CB, 0xA7CD, "L"), (0xA7DA, 0xA7DC, "L"), (0x105C0, 0x105F3, "L"), (0x10D40, 0x10D49, "N"),
    (0x10D4A, 0x10D65, "L"), (0x10D6F, 0x10D85, "L"), (0x10EC2, 0x10EC4, "L"), (0x11380, 0x11389, "L"), (0x1138B, 0x1138B, "L"),
    (0x1138E, 0x1138E, "L"), (0x11390, 0x113B5, "L"), (0x113B7, 0x113B7, "L"), (0x113D1, 0x113D1, "L"), (0x113D3, 0x113D3, "L"),
    (0x116D0, 0x116E3, "N"), (0x11BC0, 0x11BE0, "L"), (0x11BF0, 0x11BF9, "N"), (0x13460, 0x143FA, "L"), (0x16100, 0x1611D, "L"),
    (0x16130, 0x16139, "N"), (0x16D40, 0x16D6C, "L"), (0x16D70, 0x16D79, "N"), (0x18CFF, 0x18CFF, "L"), (0x1CCF0, 0x1CCF9, "N"),
    (0x1E5D0, 0x1E5ED, "L"), (0x1E5F0, 0x1E5F0, "L"), (0x1E5F1, 0x1E5FA, "N"),
]
# Fixed value: the published pattern of this pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# From here on tables of Unicode versions differ; stand-ins of each class for characters they disagree on.
FIRST_DISPUTED, STAND_IN = "՘", {"L": "a", "N": "1", "O": "!", "S": " "}

#: A worker keeps the ids of two generations of so many pre-tokens of so many characters at most.
CACHE_WORDS, CACHE_CHARS, NEVER = 250_000, 48, 1 << 60
#: Characters that a transducer takes at once, and those after a pre-token's end that it must have seen to know the end.
BLOCK_CHARS, LOOK = 1 << 16, 4
#: What a pre-token whose end is not in sight goes on with: letters, numbers, blanks, others.
GOING_ON = {k: regex.compile(x) for k, x in {"L": r"\p{L}*", "N": r"\p{N}*", "S": r"\s*", "O": r"[^\s\p{L}\p{N}]*"}.items()}


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if visible, else 256 + n."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after the end of any merge's bytes that suffice to know whether that merge happens there.

    By induction over the merges in order of priority. A merge can be prevented only by an earlier one whose bytes
    reach past its end: one that starts inside its bytes (a prefix of the earlier one is a suffix of this one), or one
    that covers them all. Whether that earlier one happens is known its own lookahead after its own end. So the figure
    of a merge is the largest (reach past the end + figure of the earlier merge), and the answer is the largest figure.
    """
    starts: dict[bytes, int] = {}   # prefix -> largest length + figure among earlier merges that have it
    covers: dict[bytes, int] = {}   # inner substring -> largest rest after it + figure among earlier merges
    tokens = {a + b for a, b in merges}
    most = 0
    for a, b in merges:
        s = a + b
        n, figure = len(s), covers.get(s, 0)
        for i in range(n):
            figure = max(figure, starts.get(s[i:], 0) - (n - i))
        most = max(most, figure)
        for j in range(1, n):
            starts[s[:j]] = max(starts.get(s[:j], 0), n + figure)
        for i in range(1, n - 1):
            for j in range(i + 1, n):
                if (part := s[i:j]) in tokens:
                    covers[part] = max(covers.get(part, 0), n - j + figure)
    return most


def _uint32(ids: Iterable[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Codec:
    """Tables of one byte-level BPE vocabulary file, and the transducers over them."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model, pre = data["model"], data["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or data["normalizer"]:
            raise ValueError("only byte-level BPE files without normalizer and prefix space are supported")
        if any(model.get(x) for x in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
            raise ValueError("a model option that changes merges is set")
        if any(t.get(x) for t in data["added_tokens"] for x in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that strip blanks or need word ends are not supported")
        alphabet = byte_alphabet()
        raw = lambda t: bytes(alphabet[c] for c in t)
        vocab = {raw(t): i for t, i in model["vocab"].items()}
        merges = [tuple(map(raw, m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        self.single = [vocab[bytes([b])] for b in range(256)]
        self.rank = {(vocab[a], vocab[b]): rank for rank, (a, b) in reversed(list(enumerate(merges)))}
        self.made = [vocab[a + b] for a, b in merges]
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for t, i in vocab.items():
            self.bytes_of[i] = t
        for t, i in self.added.items():
            self.bytes_of[i] = raw(t) if all(c in alphabet for c in t) else t.encode()
        self.length = list(map(len, self.bytes_of))
        self.lookahead = sufficient_lookahead(merges)
        #: A pre-token is read in blocks of this many bytes; what stays unsettled is never longer than lookahead + one token.
        self.block = 2 * (self.lookahead + max(map(len, vocab)))
        self.split = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.longest_special = max(map(len, self.added), default=0)
        self.cache = _Words(self)

    # encoding -------------------------------------------------------------------------------------------------------

    def merge(self, piece: bytes) -> list[int]:
        """Merges over one bounded piece, lowest rank first, then leftmost."""
        ids = [self.single[b] for b in piece]
        if len(ids) > 40:
            return self._merge_long(ids)
        rank, made = self.rank.get, self.made
        ranks = list(map(rank, zip(ids, ids[1:]), itertools.repeat(NEVER)))
        while ranks and (low := min(ranks)) != NEVER:
            i = ranks.index(low)
            ids[i:i + 2] = made[low],
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), NEVER)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        rank, made, n = self.rank.get, self.made, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            low, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = made[low], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))
            if (p := before[i]) >= 0 and (r := rank((ids[p], ids[i]))) is not None:
                heapq.heappush(heap, (r, p, ids[p], ids[i]))
        return [x for x in ids if x >= 0]

    def pieces(self, text: str, seen: str) -> list[str]:
        """The pre-tokens of ``text``, cut where ``seen`` says."""
        return self.split.findall(text) if seen is text else [text[m.start():m.end()] for m in self.split.finditer(seen)]

    def encode(self, text: str, step: int = BLOCK_CHARS) -> Iterator[bytes]:
        """Parts of the id sequence of a text, in order, as little-endian unsigned 32-bit integers."""
        machine = Transducer(self)
        for i in range(0, len(text), step):
            yield from machine.feed(text[i:i + step] if len(text) > step else text, i + step >= len(text))

    # decoding -------------------------------------------------------------------------------------------------------

    def decode(self, parts: Iterable[bytes], step: int = 1 << 15) -> Iterator[str]:
        """Text of an id sequence given in parts: bytes of the ids through an incremental UTF-8 state machine."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        look = self.bytes_of.__getitem__
        for part in parts:
            for i in range(0, len(part), 4 * step):
                ids = array("I", part[i:i + 4 * step])
                if sys.byteorder == "big":
                    ids.byteswap()
                yield machine.decode(b"".join(map(look, ids)))
        yield machine.decode(b"", True)


class Transducer:
    """Ids of one text that arrives in blocks, each as soon as no later character can change it."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.buffer = ""                        # characters that are not cut yet
        self.open: regex.Pattern | None = None  # how the pre-token goes on whose end has not been seen
        self.held = b""                         # its bytes that are not settled

    def feed(self, block: str, last: bool = False) -> Iterator[bytes]:
        c, text, at = self.codec, self.buffer + block, 0
        stop = len(text)
        if c.special:
            while (m := c.special.search(text, at)) and (last or m.start() + c.longest_special <= len(text)):
                yield from self._cut(text[at:m.start()], True)
                yield _uint32([c.added[m.group()]])
                at = m.end()
            if not last:  # what may be the beginning of an added token waits
                stop = max(at, len(text) - c.longest_special + 1)
        rest = yield from self._cut(text[at:stop], last)
        self.buffer = rest + text[stop:]

    def _cut(self, text: str, final: bool) -> Iterator[bytes]:
        """Emits what is settled of ``text`` and returns the characters that are not cut. ``final``: nothing comes after."""
        c, at = self.codec, 0
        seen = _as_seen(text)
        if self.open:
            at = self.open.match(seen).end()
            ended = at < len(seen) or final
            if self.open is GOING_ON["S"] and not (final and at == len(seen)):
                at = max(0, at - 1)  # the last blank may belong to the next pre-token
            yield from self._merge(text[:at], ended)
            if not ended:
                return text[at:]
            self.open = None
            text, seen = text[at:], text[at:] if seen is text else seen[at:]
            if not seen.isascii():
                seen = _as_seen(text)
        pieces, rest = c.pieces(text, seen), ""
        if not final:
            end, piece = len(text), ""
            while pieces and end > len(text) - LOOK:
                piece = pieces.pop()
                end -= len(piece)
            rest = text[end:]
        if pieces:
            yield b"".join(map(c.cache.__getitem__, pieces))
        if len(rest) > c.block // 2:  # a pre-token whose end is not in sight
            kind = _class(_as_seen(piece)[-1])
            lead = int(kind != "S" and rest[0] == " ")
            self.open = GOING_ON[kind]
            yield from self._merge(rest[:lead], False)
            rest = yield from self._cut(rest[lead:], False)
        return rest

    def _merge(self, more: str, end: bool) -> Iterator[bytes]:
        """Bytes of the open pre-token: merged a window a time, of which what lies beyond the lookahead is settled."""
        c, at = self.codec, 0
        data = self.held + more.encode("utf-8", "surrogatepass")
        while len(data) - at > c.block:
            settled, stop, out = c.block - c.lookahead, 0, []
            for i in c.merge(data[at:at + c.block]):
                if stop + c.length[i] > settled:
                    break
                stop += c.length[i]
                out.append(i)
            at += stop
            yield _uint32(out)
        self.held = data[at:]
        if end and self.held:
            yield _uint32(c.merge(self.held))
            self.held = b""


class _Words(dict):
    """Pre-token -> ids, of short pre-tokens; the generation before the present one is kept beside it."""

    def __init__(self, codec: Codec):
        self.codec, self.older = codec, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece) or _uint32(self.codec.merge(piece.encode("utf-8", "surrogatepass")))
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[piece] = out
        return out


@functools.lru_cache(1 << 16)
def _stand_in(c: str) -> str | None:
    """A character of the class that Unicode 16.0 gives ``c``, if the regex module has it in another class."""
    kind = unicodedata.category(c)[0]
    kind = next((k for a, b, k in UNICODE_16 if a <= ord(c) <= b), kind if kind in "LN" else "S" if c.isspace() else "O")
    return None if kind == _class(c) else STAND_IN[kind]


def _as_seen(text: str) -> str:
    """The text with stand-ins for the characters that the library's Unicode version (16.0) classes in another way."""
    odd = {} if text.isascii() else {ord(c): s for c in set(text) if c >= FIRST_DISPUTED and (s := _stand_in(c))}
    return text.translate(odd) if odd else text


def _class(c: str) -> str:
    return next(k for k in "LNSO" if GOING_ON[k].match(c).end())


@functools.lru_cache(2)
def codec(spec: str) -> Codec:
    return Codec(spec)


def encode_decode(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", with_output: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns ``id, n_tokens, ids_sha256, decoded_sha256`` and, ``with_output``, ``ids array<int>`` and ``decoded``.
    ``spec`` is the content of the vocabulary file; it is shipped once, in a broadcast of a few MB that does not grow
    with the data. A map-only plan: no shuffle. The digest form keeps one text and its ids at a time.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(spec)
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    extra = ", ids array<int>, decoded string" if with_output else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shipped.value)
        for batch in batches:
            n, ids_hex, text_hex, all_ids, all_text = [], [], [], [], []
            for value in batch.column(1):
                h, d, sizes, ids, kept = hashlib.sha256(), hashlib.sha256(), [], [], []

                def told(parts: Iterator[bytes]) -> Iterator[bytes]:
                    for p in parts:
                        h.update(p)
                        sizes.append(len(p) // 4)
                        if with_output:
                            ids.append(p)
                        yield p

                for t in c.decode(told(c.encode(value.as_py() or ""))):
                    d.update(t.encode())
                    if with_output:
                        kept.append(t)
                n.append(sum(sizes))
                ids_hex.append(h.hexdigest())
                text_hex.append(d.hexdigest())
                if with_output:
                    all_ids.append(array("I", b"".join(ids)).tolist())
                    all_text.append("".join(kept))
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_output:
                cols += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_text, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return rows.mapInArrow(run, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
