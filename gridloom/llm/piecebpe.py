"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is normalised (spaces become the meta symbol, one is put in front), cut into segments at the places no piece
of the vocabulary crosses (a meta symbol after another character), and every segment is merged by an agenda of
adjacent symbol pairs: the pair whose joined piece scores highest goes first, of equal scores the leftmost,
until no pair joins to a piece. The agenda is a heap (of a short word a list), so a segment of n characters takes n log n steps, and
long segments (text without spaces) are cut further between characters that no piece has side by side. Symbols left without
a piece become byte pieces. Each new segment is checked against the library in the same batch; a difference raises.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import columns

META = "▁"
#: Marks in front of which a text may be cut; CUT can't occur in a text.
MARKS = ".,\n"
CUT = "\ud800"
SEGMENT = re.compile(f"{META}*[^{META}]+|{META}+")
MEMO = 400_000
BLOCK = 2 << 20
#: Segments over LONG characters are looked through for more places to cut.
LONG = 256
#: Segments of up to SHORT characters have a list for an agenda, longer ones a heap.
SHORT, NEVER = 24, 1 << 62
#: Low bits of an agenda entry: the place of the pair's left symbol. No string is as long.
PLACE_BITS = 40
PLACE = (1 << PLACE_BITS) - 1


class Agenda:
    """The merge table of one model: which two symbols join to which piece, and how early."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        piece = {lib.id_to_piece(i): i for i in plain}
        if any(META in p.lstrip(META) for p in piece):
            raise ValueError("a piece crosses a meta symbol: this vocabulary has no safe boundaries")
        self.bigrams = {p[i : i + 2] for p in piece for i in range(len(p) - 1)}
        if "\n" in "".join(piece):
            raise ValueError("a piece holds a line end")
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.n = n
        symbol = dict(piece)  # single characters that pieces hold but that are none themselves
        for c in sorted({c for p in piece for c in p} - piece.keys()):
            symbol[c] = n + len(symbol)
        # a character in no piece has the symbol ``other``, which joins with nothing
        self.other = n + len(symbol)
        self.top = self.other + 1
        self.char = defaultdict(lambda: self.other, {c: i for c, i in symbol.items() if len(c) == 1})
        score = {p: lib.get_score(i) for p, i in piece.items()}
        # equal scores share a rank, so that the leftmost wins
        rank_of = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True), 1)}
        #: what two symbols join to, as rank << PLACE_BITS and the joined symbol
        self.joins = {
            symbol[p[:k]] * self.top + symbol[p[k:]]: (rank_of[score[p]] << PLACE_BITS, i)
            for p, i in piece.items()
            for k in range(1, len(p))
            if p[:k] in symbol and p[k:] in symbol
        }
        self.rank = {k: r >> PLACE_BITS for k, (r, _) in self.joins.items()}

    def merge_short(self, segment: str) -> list[int]:
        """Symbols of a segment of few characters after all merges. Its agenda is a list with the rank of each two neighbours, from
        which the least is taken (the leftmost of equal ones)."""
        find, top, never = self.rank.get, self.top, NEVER
        char = self.char
        symbol = [char[c] for c in segment]
        agenda = [find(a * top + b, never) for a, b in zip(symbol, symbol[1:])]
        while agenda and (best := min(agenda)) != never:
            at = agenda.index(best)
            symbol[at] = new = self.joins[symbol[at] * top + symbol[at + 1]][1]
            del symbol[at + 1], agenda[at]
            if at < len(agenda):
                agenda[at] = find(new * top + symbol[at + 1], never)
            if at:
                agenda[at - 1] = find(symbol[at - 1] * top + new, never)
        return symbol

    def merge(self, segment: str) -> tuple[list[int], list[int]]:
        """Symbols of one segment after all merges, and their places. The agenda is a heap of entries (rank and place in one
        number); an entry that comes up is dropped if the pair at its place now has another one. A segment of n characters
        makes at most 3 n entries."""
        find, top, n = self.joins.get, self.top, len(segment)
        symbol = [self.char[c] for c in segment]
        found = [find(a * top + b) for a, b in zip(symbol, symbol[1:])]
        entry = [f[0] | at if f else 0 for at, f in enumerate(found)]
        entry.append(0)
        agenda = [e for e in entry if e]
        if not agenda:
            return symbol, list(range(n))
        joined = [f[1] if f else 0 for f in found]
        heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            e = heappop(agenda)
            at = e & PLACE
            if entry[at] != e:
                continue
            symbol[at] = new = joined[at]
            right = after[at]
            symbol[right] = -1
            entry[right] = 0
            after[at] = right = after[right]
            if right < n:
                before[right] = at
                f = find(new * top + symbol[right])
            else:
                f = None
            if f:
                entry[at], joined[at] = f[0] | at, f[1]
                heappush(agenda, entry[at])
            else:
                entry[at] = 0
            left = before[at]
            if left >= 0:
                f = find(symbol[left] * top + new)
                if f:
                    entry[left], joined[left] = f[0] | left, f[1]
                    heappush(agenda, entry[left])
                else:
                    entry[left] = 0
        places = [at for at in range(n) if symbol[at] >= 0]
        return [symbol[at] for at in places], places

    def cut(self, segment: str) -> list[str]:
        """A long segment in parts, cut between characters that are neighbours in no piece, so that no merge crosses a cut."""
        bigrams, parts, start = self.bigrams, [], 0
        for at in range(LONG, len(segment)):
            if at - start >= LONG and segment[at - 1 : at + 1] not in bigrams:
                parts.append(segment[start:at])
                start = at
        return [*parts, segment[start:]]

    def encode(self, segment: str) -> bytes:
        """Little-endian ids of a segment (meta symbols in place of spaces). Characters without a piece become their UTF-8 bytes."""
        if len(segment) <= SHORT and max(ids := self.merge_short(segment)) < self.n:
            return _packed(ids)
        ids = []
        for part in self.cut(segment) if len(segment) > LONG else [segment]:
            symbols, places = self.merge(part)
            if max(symbols) < self.n:
                ids += symbols
                continue
            for s, at in zip(symbols, places):
                ids += [s] if s < self.n else [self.bytes[b] for b in part[at].encode("utf-8", "surrogatepass")]
        return _packed(ids)


def _packed(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class Codec:
    """Encodes and decodes whole texts for one model file; remembers up to 2 * MEMO segments."""

    def __init__(self, path: str):
        self.agenda = Agenda(path)
        self.lib = self.agenda.lib
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # no piece holds these pairs of characters, so a text without them may be cut before these marks as well
        unsafe = [b for b in self.agenda.bigrams if b[1] in MARKS]
        self.unsafe = re.compile("|".join(map(re.escape, sorted(unsafe))) or "(?!)")

    def segments(self, text: str) -> list[str]:
        """The segments of a text, each space a meta symbol in front of what follows."""
        flat = META + text.replace(" ", META)
        if META + META in flat:
            return SEGMENT.findall(flat)
        if not self.unsafe.search(flat):
            for c in MARKS:
                flat = flat.replace(c, CUT + c)
        return (flat[0] + flat[1:].replace(META, CUT + META)).split(CUT)

    def learn(self, segments: set[str]) -> None:
        """Merge the segments that are new, and check each against the library."""
        if len(self.known) > MEMO:
            self.older, self.known = self.known, {}
        new = segments - self.known.keys()
        again = new & self.older.keys()
        self.known.update((s, self.older[s]) for s in again)
        new = [s for s in new - again if s]
        self.known[""] = b""
        for at in range(0, len(new), 4_000):
            block = new[at : at + 4_000]
            mine = [self.agenda.encode(s) for s in block]
            # the library puts a meta symbol in front of what it is given
            plain = [k for k, s in enumerate(block) if s[0] == META and s != META]
            theirs = self.lib.encode([block[k][1:].replace(META, " ") for k in plain], num_threads=1)
            same = [len(x) * 4 for x in theirs] == [len(mine[k]) for k in plain]
            flat = np.fromiter((i for x in theirs for i in x), "<u4")
            if not same or flat.tobytes() != b"".join(mine[k] for k in plain):
                raise RuntimeError("the agenda and the library differ on one of " + repr([block[k] for k in plain])[:2000])
            for k in set(range(len(block))) - set(plain):
                if not self.same_inside(block[k], mine[k]):
                    raise RuntimeError(f"the agenda and the library differ on {block[k]!r}")
            self.known.update(zip(block, mine))

    def same_inside(self, segment: str, ids: bytes) -> bool:
        """For segments that don't begin with a meta symbol, or are one: the library sees them after a line end, which
        joins with nothing."""
        theirs = self.lib.encode("\n" + segment.replace(META, " "))
        lead = len(self.lib.encode("\n"))
        return np.array(theirs[lead:], "<u4").tobytes() == ids

    def encode_all(self, texts: list[str], bos: bool, eos: bool) -> Iterator[bytes]:
        """Little-endian uint32 ids of each text."""
        first = np.array([self.lib.bos_id()] * bos, "<u4").tobytes()
        last = np.array([self.lib.eos_id()] * eos, "<u4").tobytes()
        at = 0
        while at < len(texts):
            block, held = [], 0
            while at < len(texts) and (not block or held + len(texts[at]) <= BLOCK):
                block.append(self.segments(texts[at]) if texts[at] else [])
                held += len(texts[at])
                at += 1
            self.learn(set().union(*block))
            for segments in block:
                yield first + b"".join(map(self.known.__getitem__, segments)) + last

    def decode(self, ids: bytes) -> str:
        return self.lib.decode(np.frombuffer(ids, "<u4").tolist())


def encode_decode(
    docs: DataFrame, path: str, bos: bool = True, eos: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (array of int), decoded.

    path: a sentencepiece model of merge type with byte fallback and no text rules but the dummy prefix, at
    the same place on every machine. Null text counts as empty and has the begin and end ids only; its decoded text
    is empty. Repeated rows are encoded each; empty table: no rows.
    """
    return _run(docs, path, bos, eos, id_col, text_col, False)


def encode_digests(
    docs: DataFrame, path: str, bos: bool = True, eos: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """encode_decode with SHA-256 digests for the ids (little-endian unsigned 32-bit) and the decoded text (UTF-8):
    doc_id, n_tokens, ids_sha256, decoded_sha256. Same rules for null, empty and repeated rows."""
    return _run(docs, path, bos, eos, id_col, text_col, True)


def _run(docs: DataFrame, path: str, bos: bool, eos: bool, id_col: str, text_col: str, digests: bool) -> DataFrame:
    base = columns(docs, id_col, text_col).toDF("doc_id", "text").withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        codec = None
        for b in batches:
            codec = codec or Codec(path)
            for lo in range(0, b.num_rows, 1000):
                block = b.slice(lo, 1000)
                n, one, two = [], [], []
                for ids in codec.encode_all(block.column(1).to_pylist(), bos, eos):
                    n.append(len(ids) // 4)
                    text = codec.decode(ids)
                    one.append(sha256(ids).hexdigest() if digests else np.frombuffer(ids, "<i4"))
                    two.append(sha256(text.encode()).hexdigest() if digests else text)
                names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
                kinds = pa.string() if digests else pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [block.column(0), pa.array(n, pa.int64()), pa.array(one, kinds), pa.array(two, pa.string())], names
                )

    more = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return base.mapInArrow(run, f"doc_id {kind}, n_tokens long, {more}")
