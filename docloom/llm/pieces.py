"""Sampled segmentation into a SentencePiece vocabulary by forward filtering and backward sampling; lossless decoding.

Spaces become U+2581 and one is put in front, as the model's own normalizer does.  Each piece of the vocabulary that
matches at a place is an arc of the lattice; a character that no piece covers, and a literal U+2581, is one arc of its
byte pieces.  The forward pass sums the probabilities of all segmentations of each prefix; the backward pass draws the
arc into each place in proportion to what it carries.  No piece has a space inside, so the lattice factors at the
first space of each run of spaces into units (spaces and the word after them); forward passes run for all different
units of one length at once, the backward pass for all units of some documents.  A unit's forward pass is held for
later documents of the task, and given back at its end, up to a bound on the bytes held.  Units of ``LONG`` characters or more are taken one by one
in blocks: the forward pass keeps only what each block needs to be run again, and the backward pass runs blocks again
from the last to the first, so memory depends on the block.  Long texts are taken in segments that end between units.
Pieces are looked up by a 64-bit hash; every row is decoded again, and one that is not its text is segmented by a plain
loop over the vocabulary.

The model file is of BPE kind, whose scores are merge ranks and not probabilities.  A piece of rank r gets probability
in proportion to 1 / (r + 2), and all are raised to ``alpha`` (smaller: more variety).

A draw depends on the seed, the row key and the place in the text alone, so reruns and retries agree.

Defined cases: null and empty texts have no pieces and decode to the empty text; repeated rows get equal pieces.
"""

from __future__ import annotations

import math
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import in_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA, SEED = 0.5, 8
SPACE, LITERAL = "▁", "\udc81"
#: Characters of text that are segmented at once, cells of a forward pass, and bytes of forward passes that are held.
CHUNK, BLOCK, HELD = 1 << 20, 1 << 17, 52 << 20
#: Characters from which a unit is taken alone, and characters of its blocks.
LONG, STRIDE = 512, 1 << 15
#: A running sum below LOW is lifted by LIFT; sums that stand further back count as lifted as often as they lack.
LOW, LIFT = 1e-90, 1e90
#: Bits of a slot of the piece table.
SLOT = 18


def vocabulary(path: str = MODEL) -> dict:
    """{"pieces": [(text, rank) or None by id], "bytes": id by byte, "digest": of both} of a model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, codes, rank = [], [0] * 256, 0
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i)
        plain = not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        if model.is_byte(i):
            codes[int(text[3:5], 16)] = i
        pieces.append((text, rank) if plain else None)
        rank += plain
    return {"pieces": pieces, "bytes": codes, "digest": xxhash.xxh128_hexdigest(repr((pieces, codes)))}


class Lattice:
    def __init__(self, vocab: dict, alpha: float = ALPHA):
        total = math.log(sum(1 / (p[1] + 2) for p in vocab["pieces"] if p))
        self.arcs_of = {p[0]: (i, alpha * (-math.log(p[1] + 2) - total)) for i, p in enumerate(vocab["pieces"]) if p}
        self.longest = max(map(len, self.arcs_of))
        self.bytes = vocab["bytes"]
        self.byte_ids = np.array(self.bytes, np.int32)
        self.rare = alpha * (-math.log(len(vocab["pieces"]) + 2) - total)
        self.texts = [b""] * len(vocab["pieces"])
        for i, p in enumerate(vocab["pieces"]):
            if p:
                self.texts[i] = p[0].replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes):
            self.texts[i] = bytes([b])
        self._index()
        self._forget()

    def _index(self):
        """Pieces, and beginnings of pieces as -2, by a hash of their code points: a table, and three for taken slots.

        A free slot has key 0 and piece -1, so a string that hashes to 0 is no piece there, which is right.
        """
        self.slots = [(shift, np.zeros(1 << SLOT, np.uint64), np.full(1 << SLOT, -1, np.int32)) for shift in (46, 28, 10, 2)]
        self.weights = np.zeros(len(self.texts))
        by_length: dict = {}
        for text, (i, w) in self.arcs_of.items():
            self.weights[i] = math.exp(w)
            by_length.setdefault(len(text), []).append((text, i))
        for text in {t[:k] for t in self.arcs_of for k in range(1, len(t))} - self.arcs_of.keys():
            by_length.setdefault(len(text), []).append((text, -2))
        for n, own in by_length.items():
            points = np.frombuffer("".join(t for t, _ in own).encode("utf-32-le"), np.uint32).reshape(-1, n).astype(np.uint64)
            h = np.zeros(len(own), np.uint64)
            for k in range(n):
                h = _step(h, points[:, k])
            left = np.arange(len(own))
            for shift, keys, ids in self.slots:
                at = ((h[left] >> np.uint64(shift)) & np.uint64((1 << SLOT) - 1)).astype(np.intp)
                free = np.flatnonzero(ids[at] == -1)
                free = free[np.unique(at[free], return_index=True)[1]]
                keys[at[free]], ids[at[free]] = h[left[free]], np.array([i for _, i in own], np.int32)[left[free]]
                left = np.delete(left, free)
            if len(left) or not h.all():
                raise ValueError("two pieces share all slots, or a piece hashes to 0")

    def _found(self, h):
        """The piece of each hash, -2 for a beginning of pieces, else -1."""
        out, ask = np.full(len(h), -1, np.int32), None
        for shift, keys, ids in self.slots:
            at = ((h >> np.uint64(shift)) & np.uint64((1 << SLOT) - 1)).astype(np.intp)
            held = keys[at]
            same = np.flatnonzero(held == h)
            out[same if ask is None else ask[same]] = ids[at[same]]
            other = np.flatnonzero((held != h) & (held != 0))
            if not len(other):
                break
            h, ask = h[other], other if ask is None else ask[other]
        return out

    def _raw(self, c: int) -> tuple:
        """Byte pieces of a code point that no piece covers."""
        return tuple(self.bytes[b] for b in (SPACE if chr(c) == LITERAL else chr(c)).encode("utf-8", "surrogatepass"))

    def _matched(self, points, width: int):
        """Piece (or -1) and share (or 0) of every place of the last character and span - 1, for columns of code points."""
        n, m = points.shape
        pieces, shares = np.full((n, width, m), -1, np.int32), np.zeros((n, width, m))
        for i in range(n):
            h, rows = _step(np.uint64(0), points[i]), np.arange(m)
            for span in range(min(width, n - i)):
                if span:
                    h = _step(h, points[i + span, rows])
                found = self._found(h)
                hit = np.flatnonzero(found >= 0)
                pieces[i + span, span, rows[hit]] = found[hit]
                shares[i + span, span, rows[hit]] = self.weights[found[hit]]
                go = np.flatnonzero(found != -1)  # longer pieces begin so
                h, rows = h[go], rows[go]
                if not len(rows):
                    break
        rare = np.nonzero(shares[:, 0] == 0)
        codes = points[rare].astype(np.int64)
        pieces[rare[0], 0, rare[1]], shares[rare[0], 0, rare[1]] = -1 - codes, np.exp(self.rare * _raw_length(codes))
        return pieces, shares

    def forward(self, units: list[str]):
        """Arcs of units of one length: how many end at each place, and running share, span and piece or -1 - code point of each."""
        n, m = len(units[0]), len(units)
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, n).T.astype(np.uint64, order="C")
        width = min(n, self.longest)
        pieces, shares = self._matched(points, width)
        some = np.ascontiguousarray((shares != 0).transpose(2, 0, 1))
        ahead = np.ones((n + 1, m))
        for j in range(n):
            back = min(width, j + 1)
            own = shares[j, :back]
            own *= ahead[j::-1][:back]
            np.cumsum(own, axis=0, out=own)
            ahead[j + 1] = own[-1]
            own /= ahead[j + 1]
            if j % 8 == 7:  # only quotients of neighbours count; this keeps them far from underflow
                ahead[max(0, j + 2 - width) : j + 2] /= ahead[j + 1].copy()
        counts, at = some.sum(axis=2).ravel(), np.flatnonzero(some)
        shares = shares.transpose(2, 0, 1).ravel()[at]
        shares = shares.astype(np.float32)  # that a draw falls between a share and its rounding has odds of 1e-7
        shares[np.cumsum(counts) - 1] = 1.0  # above any draw
        return counts, shares, (at % width + 1).astype(np.int8), pieces.transpose(2, 0, 1).ravel()[at]

    def _arcs(self, points, begin: int, end: int):
        """Arcs that end at the places begin to end - 1 of one unit: how many at each, and span, weight and piece of all."""
        lead = min(begin, self.longest - 1)
        part = points[begin - lead : end].astype(np.uint64)
        last, spans, found = [], [], []
        at = np.arange(len(part))
        h = _step(np.uint64(0), part)
        for span in range(1, self.longest + 1):
            piece = self._found(h)
            hit = np.flatnonzero((piece >= 0) & (at + span > lead))
            last.append(at[hit] + span - 1 - lead)
            spans.append(np.full(len(hit), span, np.int8))
            found.append(piece[hit])
            go = np.flatnonzero((piece != -1) & (at + span < len(part)))
            at, h = at[go], h[go]
            if not len(at):
                break
            h = _step(h, part[at + span])
        single = np.zeros(end - begin, bool)
        single[last[0]] = True
        rare = np.flatnonzero(~single)
        codes = part[lead:][rare].astype(np.int64)
        last, spans, found = np.concatenate([*last, rare]), np.concatenate([*spans, np.ones(len(rare), np.int8)]), np.concatenate([*found, (-1 - codes).astype(np.int32)])
        weights = self.weights[np.maximum(found, 0)]
        weights[len(weights) - len(rare) :] = np.exp(self.rare * _raw_length(codes))
        order = np.lexsort((spans, last))
        return np.bincount(last, minlength=end - begin), spans[order], weights[order], found[order]

    def _sums(self, block, sums: list, lifts: list):
        """Append the running sum, and how often sums were lifted so far, after each place of a block to those before it."""
        counts, spans, weights, _ = block
        k, spans, weights, width = 0, spans.tolist(), weights.tolist(), self.longest
        for count in counts.tolist():
            lift, total, n = lifts[-1], 0.0, len(sums)
            if lifts[max(0, n - width)] == lift:
                for k in range(k, k + count):
                    total += sums[n - spans[k]] * weights[k]
            else:
                for k in range(k, k + count):
                    back = n - spans[k]
                    total += sums[back] * LIFT ** (lift - lifts[back]) * weights[k]
            k += 1
            if total < LOW:
                total, lift = total * LIFT, lift + 1
            sums.append(total)
            lifts.append(lift)

    def alone(self, unit: str, key: int):
        """Pieces (or -1 - code point) of one long unit; ``key`` plus the place of a character gives its draw."""
        points, width = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32), self.longest
        n, sums, lifts, kept = len(points), [1.0], [0], []
        for begin in range(0, n, STRIDE):
            kept.append((sums[-width:], lifts[-width:]))
            sums, lifts = map(list, kept[-1])
            self._sums(self._arcs(points, begin, min(begin + STRIDE, n)), sums, lifts)
        out, place = [], n  # from the last piece to the first
        for begin in range((n - 1) // STRIDE * STRIDE, -1, -STRIDE):
            sums, lifts = map(list, kept[begin // STRIDE])
            lead, end = len(sums) - 1 - begin, min(begin + STRIDE, n)  # sums[place + lead] belongs to place
            block = self._arcs(points, begin, end)
            self._sums(block, sums, lifts)
            counts, spans, weights, pieces = block
            ends = np.cumsum(counts)
            firsts, ends = (ends - counts).tolist(), ends.tolist()
            drawn = _draw(np.uint64(key), np.arange(begin + 1, end + 1)).tolist()
            spans, weights, pieces = spans.tolist(), weights.tolist(), pieces.tolist()
            while place > begin:
                arcs, own = range(firsts[place - 1 - begin], ends[place - 1 - begin]), lifts[place + lead - 1]
                parts = [sums[place - spans[a] + lead] * LIFT ** (own - lifts[place - spans[a] + lead]) * weights[a] for a in arcs]
                left = drawn[place - 1 - begin] * sum(parts)
                for a, share in zip(arcs, parts):
                    left -= share
                    if left < 0:
                        break
                out.append(pieces[a])
                place -= spans[a]
        return np.array(out[::-1], np.int32)

    def _forget(self):
        """Hold no unit: number by unit, its length and first node; first arc by node; share, span and piece by arc."""
        self.known, self.lengths, self.first = {}, np.empty(0, np.int64), np.empty(0, np.int64)
        self.arc_of, self.shares, self.spans, self.pieces = (np.empty(0, t) for t in (np.int64, np.float32, np.int8, np.int32))
        self.nodes = self.arcs = 0

    def hold(self, units: list[str]):
        """Forward passes of different units, in the order of their lengths, beside the ones that are held."""
        units = sorted(units, key=len)
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        self.known.update(zip(units, range(len(self.known), len(self.known) + len(units))))
        self.lengths = np.append(self.lengths, lengths)
        self.first = np.append(self.first, self.nodes + np.cumsum(lengths) - lengths)
        begin = 0
        for end in (np.flatnonzero(np.append(np.diff(lengths) != 0, True)) + 1).tolist() if units else ():
            n = int(lengths[begin])
            size = max(1, BLOCK // (n * min(n, self.longest)))
            for at in range(begin, end, size):
                counts, shares, spans, pieces = self.forward(units[at : min(at + size, end)])
                ends, total = np.cumsum(counts), len(shares)
                if self.nodes + len(counts) > len(self.arc_of):
                    self.arc_of.resize(5 * (self.nodes + len(counts)) // 4, refcheck=False)
                if self.arcs + total > len(self.shares):
                    for held in (self.shares, self.spans, self.pieces):
                        held.resize(5 * (self.arcs + total) // 4, refcheck=False)
                self.arc_of[self.nodes : self.nodes + len(counts)] = self.arcs + ends - counts
                for held, new in ((self.shares, shares), (self.spans, spans), (self.pieces, pieces)):
                    held[self.arcs : self.arcs + total] = new
                self.nodes, self.arcs = self.nodes + len(counts), self.arcs + total
            begin = end

    def held_bytes(self) -> int:
        """What the held passes take, about: 120 bytes for a unit, 8 for a place, 9 for an arc."""
        return 120 * len(self.known) + 8 * self.nodes + 9 * self.arcs

    def encode(self, texts: list[str], keys: list[int]):
        """(ids of all texts in one array, ends of each text in it); long texts in segments."""
        segments, owners, offsets = [], [], []
        for k, text in enumerate(texts):
            for offset, part in _segments(text):
                segments.append(part)
                owners.append(k)
                offsets.append((keys[k] + offset) & 0xFFFFFFFFFFFFFFFF)
        parts, counts, begin = [], np.zeros(len(texts) + 1, np.int64), 0
        while begin < len(segments):
            end, size = begin + 1, len(segments[begin])
            while end < len(segments) and size + len(segments[end]) <= CHUNK:
                size += len(segments[end])
                end += 1
            ids, ends = self._segmented(segments[begin:end], offsets[begin:end])
            parts.append(ids)
            np.add.at(counts, np.array(owners[begin:end]) + 1, np.diff(ends, prepend=0))
            begin = end
        return (np.concatenate(parts) if parts else np.empty(0, np.int32)), np.cumsum(counts)[1:]

    def _spread(self, ids):
        """Ids with a piece or more for each code point that none covers, and how many each became."""
        n, rare = np.ones(len(ids), np.int64), np.flatnonzero(ids < 0)
        codes = -1 - ids[rare].astype(np.int64)
        n[rare] = _raw_length(codes)
        sums = np.cumsum(n)
        spread = np.repeat(ids, n).astype(np.int32)
        codes[codes == ord(LITERAL)] = ord(SPACE)
        left = n[rare]
        for k in range(4):  # bytes from the last to the first
            go = left > k
            at, c = sums[rare[go]] - 1 - k, codes[go] >> (6 * k)
            first = left[go] == k + 1
            lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[left[go]]
            spread[at] = self.byte_ids[np.where(first, lead | c, 0x80 | (c & 0x3F))]
        return spread, sums

    def _segmented(self, segments: list[str], keys: list[int]):
        """(ids of all segments, ends of each); a segment is one long unit or has none."""
        if len(segments) == 1 and len(segments[0]) >= LONG and not _inner(segments[0]):
            ids = self._spread(self.alone(segments[0], keys[0]))[0]
            return ids, np.array([len(ids)])
        units, sizes, counts = [], [], []
        for marked in segments:
            own = UNITS.findall(marked)
            units += own
            counts.append(len(own))
            sizes.append(len(marked))
        number = np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))
        ask = np.flatnonzero(number < 0).tolist()
        new = dict.fromkeys(map(units.__getitem__, ask))
        if self.nodes and self.held_bytes() > HELD:
            self._forget()
            ask, new = range(len(units)), dict.fromkeys(units)
        self.hold(list(new))
        number[ask] = [self.known[units[k]] for k in ask]
        lengths = self.lengths[number]
        ends = np.cumsum(sizes) if sizes else np.empty(0, np.int64)
        out = np.full(int(ends[-1]) + 1 if len(ends) else 1, -1, np.int32)
        base = np.cumsum(lengths) - lengths
        key = np.repeat(np.array(keys, np.uint64) - (ends - np.array(sizes)).astype(np.uint64) if len(keys) else np.empty(0, np.uint64), counts)
        start, left = self.first[number] - 1, lengths
        while len(left):
            place = base + left
            arc, drawn = self.arc_of[start + left], _draw(key, place)
            ask = np.flatnonzero(self.shares[arc] <= drawn)
            while len(ask):
                arc[ask] += 1
                ask = ask[self.shares[arc[ask]] <= drawn[ask]]
            out[place] = arc
            left = left - self.spans[arc]
            if not (go := left > 0).all():
                start, left, base, key = start[go], left[go], base[go], key[go]
        places = np.flatnonzero(out >= 0)
        spread, sums = self._spread(self.pieces[out[places]])
        return spread, np.append(0, sums)[np.searchsorted(places, ends, side="right")]

    def plain(self, text: str) -> list[int]:
        """Some segmentation by a plain loop, longest pieces first: for a row at which a hash failed."""
        marked, out, i = SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE) if text else "", [], 0
        while i < len(marked):
            n = next((n for n in range(min(self.longest, len(marked) - i), 0, -1) if marked[i : i + n] in self.arcs_of), 0)
            out += [self.arcs_of[marked[i : i + n]][0]] if n else self._raw(ord(marked[i]))
            i += n or 1
        return out

    def same(self, ids, text: str) -> bool:
        """Do the ids decode to the text?  Compared in blocks, so that a long text's pieces are not all held at once."""
        data, at = text.encode("utf-8", "surrogatepass"), -1  # the first space is not of the text
        for k in range(0, len(ids), 1 << 16):
            part = b"".join(map(self.texts.__getitem__, ids[k : k + (1 << 16)].tolist()))
            if data[max(at, 0) : at + len(part)] != (part[1:] if at < 0 else part):
                return False
            at += len(part)
        return max(at, 0) == len(data)

    def decode(self, ids) -> bytes:
        """The UTF-8 text of a sequence of ids."""
        return b"".join(map(self.texts.__getitem__, ids))[1:]


def _raw_length(codes):
    """Bytes of each code point in UTF-8; the mark of a literal U+2581 has as many as that."""
    return 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)


#: Spaces and the word after them; a unit begins where a space follows another character.
UNITS, BORDER = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+"), re.compile(f"(?<=[^{SPACE}]){SPACE}")


def _inner(marked: str) -> bool:
    """Does a unit begin inside?"""
    return BORDER.search(marked) is not None


def _segments(text: str):
    """(offset, segment) of a text with marked spaces: up to about CHUNK characters of short units, or one long unit."""
    marked = SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE) if text else ""
    begin = at = 0  # of the segment, and of the unit that is looked at
    while at < len(marked):
        if len(marked) - at < LONG:
            break
        # the last border within reach; without one the unit is long
        border = marked.rfind(SPACE, at + 1, at + LONG)
        while border > at and marked[border - 1] == SPACE:
            border -= 1
        if border <= at:
            found = BORDER.search(marked, at + 1)
            border = found.start() if found else len(marked)
            if border - at >= LONG:
                if at > begin:
                    yield begin, marked[begin:at]
                yield at, marked[at:border]
                begin = border
        at = border
        if at - begin >= CHUNK:
            yield begin, marked[begin:at]
            begin = at
    if begin < len(marked):
        yield begin, marked[begin:]


def _step(h, points):
    """The hash of a string and one more code point."""
    h = (h ^ (points + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _draw(key, place):
    """Numbers in [0, 1) from the row key and the place in the row (both counted over the chunk, so the offset cancels)."""
    x = key + place.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def row_key(value, seed: int = SEED) -> int:
    return xxhash.xxh64_intdigest(repr(value), seed)


def _chunks(batch):
    """Slices of a batch of up to about CHUNK characters, single texts whole."""
    begin, size = 0, 0
    for i, n in enumerate(pc.utf8_length(batch.column(1)).to_pylist()):
        n = n or 0
        if size and size + n > CHUNK:
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


#: The last lattice of this Python process, which other tasks of the same model find, without forward passes.
_LAST: dict = {}


def _lattice(vocab, alpha: float = ALPHA) -> Lattice:
    value = vocab.value
    if _LAST.get("of") != (value["digest"], alpha):
        _LAST.clear()
        _LAST.update(of=(value["digest"], alpha), lattice=Lattice(value, alpha))
    return _LAST["lattice"]


def _encoded(vocab, alpha: float, seed: int):
    def run(batches):
        lattice = _lattice(vocab, alpha)
        yield from parts(lattice, batches)
        lattice._forget()

    def parts(lattice: Lattice, batches):
        for batch in batches:
            for part in _chunks(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids, ends = lattice.encode(texts, [row_key(k, seed) for k in part.column(0).to_pylist()])
                begins = np.append(0, ends)
                same = [lattice.same(ids[a:b], t) for a, b, t in zip(begins, ends, texts)]
                if not all(same):
                    rows = [ids[a:b] if ok else np.array(lattice.plain(t), np.int32) for a, b, ok, t in zip(begins, ends, same, texts)]
                    begins, ids = np.append(0, np.cumsum([len(r) for r in rows])), np.concatenate(rows)
                    same = [lattice.same(r, t) for r, t in zip(rows, texts)]
                lists = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(same)], ["doc_id", "ids", "lossless"])

    return run


def _decoded(vocab):
    def run(batches):
        lattice = _lattice(vocab)
        for batch in batches:
            texts = [lattice.decode(x.as_py() or []).decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def encode(docs: DataFrame, model: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """doc_id, ids and lossless (the decoded ids are the text) of each row of ``docs`` (doc_id, text).

    The vocabulary has a fixed size, whatever the input, and is broadcast.
    """
    vocab = docs.sparkSession.sparkContext.broadcast(vocabulary(model))
    rows = docs.select("doc_id", "text")
    return in_batches(rows, _encoded(vocab, alpha, seed), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, lossless boolean")


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of rows of (doc_id, ids)."""
    vocab = rows.sparkSession.sparkContext.broadcast(vocabulary(model))
    rows = rows.select("doc_id", "ids")
    return in_batches(rows, _decoded(vocab), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
