"""Progressive JPEG in numpy: a decoder for spectral selection and successive approximation, and a writer that stores bytes as coefficients.

The decoder reads Huffman-coded progressive files (SOF2) of one or three components with any sampling factors: DC and AC scans, first and refining, with
end-of-band runs, restart intervals and any tables. Scans gather in coefficient arrays; these are dequantised, inverse-transformed in integers (so equal
files give equal pixels on any machine), chroma is upsampled, and the result is a full-resolution RGB array. Scans of fixed width (a table of one symbol)
are read whole, without a loop over symbols.

The writer keeps a payload exactly: byte b becomes a coefficient of category 8, whose eight magnitude bits are b itself, so no coefficient is zero. The DC
goes out in one interleaved scan and a refining one, the AC of each component in two bands and a refining scan.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

ZIGZAG = np.array([i * 8 + j for s in range(15) for i, j in sorted(((i, s - i) for i in range(8) if 0 <= s - i < 8), key=lambda p: p[s % 2])])
BANDS = ((1, 5), (6, 63))
_k = np.arange(8)
COSINES = np.round(4096 * np.where(_k[None, :] == 0, np.sqrt(0.125), 0.5) * np.cos((2 * _k[:, None] + 1) * _k[None, :] * np.pi / 16)).astype(np.int32)


@lru_cache(256)
def huffman(counts: bytes, symbols: bytes) -> "Table":
    """(length, code) -> symbol."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return Table(out)


class Table(dict):
    """Codes by length; short has (length, symbol) for each byte, where no code is longer than eight bits."""

    def __init__(self, codes: dict[tuple[int, int], int]) -> None:
        super().__init__(codes)
        self.short = None
        if max((n for n, _ in codes), default=9) <= 8:
            self.short = [(0, 0)] * 256
            for (n, code), s in codes.items():
                self.short[code << (8 - n) : (code + 1) << (8 - n)] = [(n, s)] * (1 << (8 - n))


class Bits:
    """A reader of one scan's bits; past the end it gives zeros."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data + bytes(8), 0

    def take(self, n: int) -> int:
        if not n:
            return 0
        byte, shift = self.at >> 3, self.at & 7
        self.at += n
        return (int.from_bytes(self.data[byte : byte + 4], "big") >> (32 - shift - n)) & ((1 << n) - 1)

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such code in this scan's Huffman table")

    def value(self, size: int) -> int:
        v = self.take(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


class Component:
    def __init__(self, ident: int, h: int, v: int, q: int) -> None:
        self.ident, self.h, self.v, self.q = ident, h, v, q


class Decoder:
    def __init__(self, data: bytes) -> None:
        self.data, self.tables, self.quant, self.comment, self.restart = data, {}, {}, b"", 0
        self.parts: list[Component] = []
        self.read()

    def read(self) -> None:
        d, at = self.data, 2
        if d[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        while at < len(d):
            marker, at = d[at + 1], at + 2
            if marker == 0xD9:
                return
            size = int.from_bytes(d[at : at + 2], "big")
            body, at = d[at + 2 : at + size], at + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.tables[body[0]] = huffman(bytes(body[1:17]), bytes(body[17 : 17 + n]))
                    body = body[17 + n :]
            elif marker == 0xC2:
                self.frame(body)
            elif marker in (0xC0, 0xC1, 0xC3):
                raise ValueError("only progressive files are read")
            elif marker == 0xDD:
                self.restart = int.from_bytes(body, "big")
            elif marker == 0xFE:
                self.comment = body
            elif marker == 0xDA:
                at = self.scan(body, at)

    def frame(self, body: bytes) -> None:
        self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        self.parts = [Component(*(b := body[6 + 3 * i : 9 + 3 * i])[:1], b[1] >> 4, b[1] & 15, b[2]) for i in range(body[5])]
        self.hmax, self.vmax = max(p.h for p in self.parts), max(p.v for p in self.parts)
        self.columns, self.rows = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        for p in self.parts:
            p.coef = np.zeros((self.rows * p.v, self.columns * p.h, 64), np.int16)
            p.own = -(-(-(-self.height * p.v // self.vmax)) // 8), -(-(-(-self.width * p.h // self.hmax)) // 8)

    def entropy(self, at: int) -> tuple[list[bytes], int]:
        """The scan's data by restart intervals, without stuffing, and where it ends."""
        d, out, start = self.data, [], at
        while True:
            at = d.index(b"\xff", at)
            if d[at + 1] == 0:
                at += 2
            elif 0xD0 <= d[at + 1] <= 0xD7:
                out.append(d[start:at].replace(b"\xff\x00", b"\xff"))
                at = start = at + 2
            else:
                return [*out, d[start:at].replace(b"\xff\x00", b"\xff")], at

    def scan(self, head: bytes, at: int) -> int:
        n = head[0]
        chosen = [(next(p for p in self.parts if p.ident == head[1 + 2 * i]), head[2 + 2 * i]) for i in range(n)]
        ss, se, ah, al = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
        data, at = self.entropy(at)
        for part, blocks in zip(data, self.intervals(chosen)):
            if ss == 0:
                (self.dc_refine if ah else self.dc_first)(part, blocks, al)
            else:
                p, tables = chosen[0]
                (self.ac_refine if ah else self.ac_first)(part, p, blocks[0][1], self.tables[0x10 | tables & 15], ss, se, al)
        return at

    def intervals(self, chosen: list) -> list:
        """For each restart interval the blocks in the order coded: [(component and tables, block numbers)], for interleaved scans a third array of the order."""
        if len(chosen) == 1:
            p, t = chosen[0]
            rows, columns = p.own
            blocks = (np.arange(rows)[:, None] * p.coef.shape[1] + np.arange(columns)[None, :]).ravel()
            step = self.restart or len(blocks)
            return [[((p, t), blocks[i : i + step])] for i in range(0, len(blocks), step)]
        mcus = np.arange(self.rows * self.columns)
        y, x = mcus // self.columns, mcus % self.columns
        step, out = self.restart or len(mcus), []
        for i in range(0, len(mcus), step):
            yy, xx = y[i : i + step], x[i : i + step]
            out.append([((p, t), (yy * p.v + v) * p.coef.shape[1] + xx * p.h + h) for p, t in chosen for v in range(p.v) for h in range(p.h)])
        return out

    def dc_first(self, data: bytes, blocks: list, al: int) -> None:
        bits, last = Bits(data), {id(p): 0 for (p, _), _ in blocks}
        take = bits.data
        looks = [(p, self.tables[t >> 4].short, self.tables[t >> 4], where.tolist(), id(p)) for (p, t), where in blocks]
        got = {id(p): ([], []) for p, *_ in looks}
        at = 0
        for m in range(len(blocks[0][1])):
            for _, short, table, where, key in looks:
                if short is not None:
                    v = int.from_bytes(take[at >> 3 : (at >> 3) + 5], "big") >> (8 - (at & 7))
                    n, s = short[(v >> 24) & 255]
                    v = (v >> (32 - n - s)) & ((1 << s) - 1)
                    at += n + s
                else:
                    bits.at = at
                    s = bits.symbol(table)
                    v = bits.take(s)
                    at = bits.at
                if s and not v >> (s - 1):
                    v += 1 - (1 << s)
                last[key] += v
                got[key][0].append(where[m])
                got[key][1].append(last[key])
        for p in {id(p): p for p, *_ in looks}.values():
            where, values = got[id(p)]
            p.coef.reshape(-1, 64)[where, 0] = np.array(values, np.int16) << al

    def dc_refine(self, data: bytes, blocks: list, al: int) -> None:
        k, m = len(blocks), len(blocks[0][1])
        bits = np.unpackbits(np.frombuffer(data, np.uint8))[: k * m].reshape(m, k)
        for i, ((p, _), where) in enumerate(blocks):
            p.coef.reshape(-1, 64)[where, 0] |= bits[:, i].astype(np.int16) << al

    def ac_first(self, data: bytes, p: Component, where: np.ndarray, table: dict, ss: int, se: int, al: int) -> None:
        flat, n = p.coef.reshape(-1, 64), se - ss + 1
        if len(table) == 1:
            ((length, _), symbol) = next(iter(table.items()))
            size = symbol & 15
            if symbol >> 4 == 0 and size and len(data) * 8 >= len(where) * n * (length + size):  # every coefficient has the same width
                if length + size == 8:
                    v = np.frombuffer(data, np.uint8, len(where) * n).astype(np.int32) & ((1 << size) - 1)
                else:
                    bits = np.unpackbits(np.frombuffer(data, np.uint8))[: len(where) * n * (length + size)].reshape(-1, length + size)[:, length:]
                    v = bits.astype(np.int32) @ (1 << np.arange(size - 1, -1, -1))
                v = np.where(v >> (size - 1), v, v - (1 << size) + 1) * (1 << al)
                flat[where, ss : se + 1] = v.reshape(-1, n)
                return
        bits, run = Bits(data), 0
        for b in where.tolist():
            if run:
                run -= 1
                continue
            k = ss
            while k <= se:
                s = bits.symbol(table)
                r, size = s >> 4, s & 15
                if size:
                    k += r
                    flat[b, k] = bits.value(size) * (1 << al)
                elif r == 15:
                    k += 15
                else:
                    run = (1 << r) - 1 + bits.take(r)
                    break
                k += 1

    def ac_refine(self, data: bytes, p: Component, where: np.ndarray, table: dict, ss: int, se: int, al: int) -> None:
        flat, n, one = p.coef.reshape(-1, 64), se - ss + 1, 1 << al
        if list(table.values()) == [0] and (band := flat[where, ss : se + 1]).all():  # each block is one end of band and a bit for every coefficient
            length = next(iter(table))[0]
            if (length + n) % 8 == 0 and length <= 8:
                bits = np.unpackbits(np.frombuffer(data, np.uint8, len(where) * (length + n) // 8)).reshape(-1, length + n)[:, length:]
            else:
                bits = np.unpackbits(np.frombuffer(data, np.uint8))[: len(where) * (length + n)].reshape(-1, length + n)[:, length:]
            flat[where, ss : se + 1] = band + np.where(band > 0, one, -one).astype(np.int16) * bits.astype(np.int16)
            return
        bits, run = Bits(data), 0

        def correct(b: int, k: int) -> None:
            if bits.take(1) and not abs(int(flat[b, k])) & one:
                flat[b, k] += one if flat[b, k] > 0 else -one

        for b in where.tolist():
            k = ss
            while k <= se and not run:
                s = bits.symbol(table)
                r, size = s >> 4, s & 15
                if not size and r < 15:
                    run = (1 << r) + bits.take(r)
                    break
                new = (one if bits.take(1) else -one) if size else 0
                while k <= se:
                    if flat[b, k]:
                        correct(b, k)
                    elif r == 0:
                        flat[b, k] = new
                        k += 1
                        break
                    else:
                        r -= 1
                    k += 1
            if run:
                for k in range(k, se + 1):
                    if flat[b, k]:
                        correct(b, k)
                run -= 1

    def rgb(self) -> np.ndarray:
        """Height x width x 3, of bytes."""
        return rgb_of([self])[0]


def planes_of(decoders: list[Decoder]) -> list[list[np.ndarray]]:
    """The components' samples, the blocks of all files transformed together."""
    parts = [(p, d.quant[p.q]) for d in decoders for p in d.parts]
    sizes = np.cumsum([0, *(p.coef.shape[0] * p.coef.shape[1] for p, _ in parts)])
    out = np.empty((int(sizes[-1]), 8, 8), np.uint8)
    for i in range(0, len(out), 1 << 15):
        c = np.empty((min(1 << 15, len(out) - i), 64), np.int32)
        for k in range(int(np.searchsorted(sizes, i, "right")) - 1, len(parts)):
            lo, hi = max(i, int(sizes[k])), min(i + len(c), int(sizes[k + 1]))
            if lo >= i + len(c):
                break
            p, q = parts[k]
            c[lo - i : hi - i] = p.coef.reshape(-1, 64)[lo - sizes[k] : hi - sizes[k]] * q
        c[:, ZIGZAG] = c.copy()
        out[i : i + len(c)] = inverse(c.reshape(-1, 8, 8))
    found, k = [], 0
    for d in decoders:
        found.append([])
        for p in d.parts:
            rows, columns, _ = p.coef.shape
            found[-1].append(out[sizes[k] : sizes[k + 1]].reshape(rows, columns, 8, 8).swapaxes(1, 2).reshape(rows * 8, columns * 8))
            k += 1
    return found


def rgb_of(decoders: list[Decoder]) -> list[np.ndarray]:
    """Full-resolution RGB arrays, chroma upsampled by repetition."""
    flat: list[list[np.ndarray]] = [[], [], []]
    for d, planes in zip(decoders, planes_of(decoders)):
        planes = planes if len(planes) == 3 else [planes[0], *[np.full((1, 1), 128, np.uint8)] * 2]
        for k, (x, p) in enumerate(zip(planes, [*d.parts, *d.parts[:1] * 2])):
            if x.shape[0] < d.height:
                x = np.broadcast_to(x, (d.height, d.width)) if x.size == 1 else x.repeat(d.vmax // p.v, 0)
            if x.shape[1] < d.width:
                x = x.repeat(d.hmax // p.h, 1)
            flat[k].append(x[: d.height, : d.width].ravel())
    y, cb, cr = (np.concatenate(x) for x in flat)
    out = np.empty((len(y), 3), np.uint8)
    for i in range(0, len(y), 1 << 18):
        yy, b, r = ((y[i : i + (1 << 18)].astype(np.int32) << 16) + 32768), cb[i : i + (1 << 18)].astype(np.int32) - 128, cr[i : i + (1 << 18)].astype(np.int32) - 128
        for k, v in enumerate((yy + 91881 * r, yy - 22554 * b - 46802 * r, yy + 116130 * b)):
            v >>= 16
            out[i : i + len(v), k] = np.clip(v, 0, 255, out=v)
    ends = np.cumsum([d.height * d.width for d in decoders])
    return [out[e - d.height * d.width : e].reshape(d.height, d.width, 3) for d, e in zip(decoders, ends)]


def _pass(c: np.ndarray) -> np.ndarray:
    """One-dimensional inverse transform along the last axis, by even and odd halves; scaled by 4,096."""
    even = [sum(int(COSINES[x, u]) * c[..., u] for u in (0, 2, 4, 6)) for x in range(4)]
    odd = [sum(int(COSINES[x, u]) * c[..., u] for u in (1, 3, 5, 7)) for x in range(4)]
    return np.stack([even[x] + odd[x] for x in range(4)] + [even[x] - odd[x] for x in range(3, -1, -1)], -1)


def inverse(c: np.ndarray) -> np.ndarray:
    """8 x 8 blocks of dequantised coefficients -> samples."""
    first = (_pass(c) + 256) >> 9  # three bits more than samples
    second = (_pass(np.ascontiguousarray(first.swapaxes(1, 2))) + (1 << 14)) >> 15
    return np.clip(second.swapaxes(1, 2) + 128, 0, 255).astype(np.uint8)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _packed(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Bit fields one after the other, filled up with ones."""
    ends = np.cumsum(widths)
    total = int(ends[-1])
    place = np.arange(total) - np.repeat(ends - widths, widths)
    bits = (np.repeat(values, widths) >> (np.repeat(widths, widths) - 1 - place)) & 1
    return np.packbits(np.concatenate([bits.astype(np.uint8), np.ones(-total % 8, np.uint8)])).tobytes()


_one_symbol = lambda s: bytes([1] + [0] * 15 + [s])
_HEAD = (
    _segment(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00") + _segment(0xDB, b"\x00" + b"\x01" * 64),
    _segment(0xC4, b"\x00" + bytes([0, 0, 0, 10] + [0] * 12) + bytes(range(10)) + b"\x10" + _one_symbol(0x07) + b"\x11" + _one_symbol(0x00)),
)


_byte = np.arange(256)
HIGH = np.where(_byte > 127, _byte >> 1, 127 - ((255 - _byte) >> 1)).astype(np.uint8)
LOW = np.where(_byte > 127, _byte & 1, (255 - _byte) & 1).astype(np.uint8)


def write(payload: bytes) -> bytes:
    """A progressive 4:2:0 file whose coefficients are the payload's bytes (a multiple of 64), block by block: luma, then both chroma planes."""
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    mcus = max(1, -(-len(blocks) // 6))
    columns = int(np.ceil(np.sqrt(mcus)))
    rows = -(-mcus // columns)
    full = np.full((6 * rows * columns, 64), 255, np.uint8)
    full[: len(blocks)] = blocks
    m = rows * columns
    out = [b"\xff\xd8", _HEAD[0], _segment(0xFE, len(payload).to_bytes(8, "big")), _segment(0xC2, b"\x08" + (16 * rows).to_bytes(2, "big") + (16 * columns).to_bytes(2, "big") + b"\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00"), _HEAD[1]]
    luma = full[: 4 * m, 0].reshape(rows, 2, columns, 2).swapaxes(1, 2).reshape(m, 4)
    dc = np.concatenate([luma, full[4 * m : 5 * m, :1], full[5 * m :, :1]], 1).astype(np.int32)  # in the order coded
    dc = np.where(dc > 127, dc, dc - 255)
    scan = lambda ids, tables, ss, se, a: _segment(0xDA, bytes([len(ids)]) + b"".join(bytes([i, tables]) for i in ids) + bytes([ss, se, a]))
    high = dc >> 1
    diff = np.empty_like(high)
    diff[:, :4] = np.diff(high[:, :4].ravel(), prepend=0).reshape(m, 4)
    diff[:, 4:] = np.diff(high[:, 4:], axis=0, prepend=0)
    diff = diff.ravel()
    size = np.where(diff == 0, 0, np.floor(np.log2(np.maximum(np.abs(diff), 1))).astype(np.int64) + 1)
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    out += [scan((1, 2, 3), 0x00, 0, 0, 0x01), _packed((size << size) | extra, size + 4).replace(b"\xff", b"\xff\x00")]
    high, low = HIGH[full], LOW[full]
    low[:, 0] = 0  # here the end-of-band code
    low = np.packbits(low, axis=1)
    ends = ((0, 4 * m), (4 * m, 5 * m), (5 * m, 6 * m))
    for i, (lo, hi) in enumerate(ends, 1):
        for ss, se in BANDS:
            out += [scan((i,), 0x00, ss, se, 0x01), high[lo:hi, ss : se + 1].tobytes()]
    bits = np.packbits(np.concatenate([(dc & 1).ravel().astype(np.uint8), np.ones(-dc.size % 8, np.uint8)])).tobytes()
    out += [scan((1, 2, 3), 0x00, 0, 0, 0x10), bits.replace(b"\xff", b"\xff\x00")]
    for i, (lo, hi) in enumerate(ends, 1):
        out += [scan((i,), 0x01, 1, 63, 0x10), low[lo:hi].tobytes().replace(b"\xff", b"\xff\x00")]
    return b"".join([*out, b"\xff\xd9"])


def payload_of(d: Decoder) -> bytes:
    """The bytes that write() stored."""
    flat = np.concatenate([p.coef.reshape(-1, 64) for p in d.parts])
    return np.where(flat > 0, flat, flat + 255).astype(np.uint8).tobytes()[: int.from_bytes(d.comment, "big")]
