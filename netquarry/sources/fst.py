"""Binary waveform dumps: header, hierarchy and value-change blocks decoded to toggle counts.

A file is a row of blocks: one byte of type and eight bytes of length, which counts itself. Blocks of value changes are decoded one by
one, each by its own task, and their counts added up; the frame at the start of a block gives the levels it begins with.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.core import materialise

HEADER, VCDATA, HIER, ALIAS, HIER_LZ4, HIER_LZ4DUO, ALIAS2 = 0, 1, 4, 5, 6, 7, 8
# Codes of the other states of a scalar, variable types of real and text signals.
STATES = "xzhuwl-?"
REAL_TYPES, TEXT_TYPE = {3, 4, 20, 29}, 21
LEVEL = {"0": 0, "l": 0, "1": 1, "h": 1}


def uvarint(b: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        x = b[at]
        at += 1
        out |= (x & 127) << shift
        if not x & 128:
            return out, at
        shift += 7


def svarint(b: bytes, at: int) -> tuple[int, int]:
    """Signed: the sign bit is the second highest of the last byte."""
    out = shift = 0
    while True:
        x = b[at]
        at += 1
        out |= (x & 127) << shift
        shift += 7
        if not x & 128:
            return (out - (1 << shift) if x & 64 else out), at


def lz4_block(b: bytes, size: int) -> bytes:
    """A raw LZ4 block: literals and matches in turn."""
    out, at = bytearray(), 0
    while at < len(b):
        token = b[at]
        at += 1
        n = token >> 4
        if n == 15:
            while True:
                n += b[at]
                at += 1
                if b[at - 1] != 255:
                    break
        out += b[at : at + n]
        at += n
        if at >= len(b):
            break
        back = b[at] | b[at + 1] << 8
        at += 2
        n = (token & 15) + 4
        if n == 19:
            while True:
                n += b[at]
                at += 1
                if b[at - 1] != 255:
                    break
        if not 0 < back <= len(out):
            raise ValueError("a match before the start")
        while n > 0:
            part = out[len(out) - back : len(out) - back + n] if n < back else out[len(out) - back :]
            out += part
            n -= len(part)
    if len(out) != size:
        raise ValueError(f"{len(out)} bytes instead of {size}")
    return bytes(out)


def blocks(data: bytes) -> Iterator[tuple[int, bytes]]:
    """The blocks of a file up to its end, or to a block that was still being written when the dump was broken off."""
    at = 0
    while at + 9 <= len(data):
        kind, n = data[at], struct.unpack(">Q", data[at + 1 : at + 9])[0]
        if kind == UNFINISHED or n == 0:
            return
        if n < 8 or at + 1 + n > len(data):
            raise ValueError("a block is cut off")
        yield kind, data[at + 9 : at + 1 + n]
        at += 1 + n


UNFINISHED = 255


def read_header(b: bytes) -> dict:
    start, end = struct.unpack(">QQ", b[:16])
    exponent = struct.unpack("b", b[64:65])[0]
    return {"start": start, "end": end, "tick_s": 10.0**exponent}


def read_hierarchy(kind: int, b: bytes) -> list[tuple[str, int, int, int]]:
    """(path, handle, width, type) of each variable; aliases repeat a handle."""
    size = struct.unpack(">Q", b[:8])[0]
    if kind == HIER:
        raw = zlib.decompress(b[8:], 31 if b[8:10] == b"\x1f\x8b" else 15)
    elif kind == HIER_LZ4:
        raw = lz4_block(b[8:], size)
    else:
        once, at = uvarint(b, 8)
        raw = lz4_block(lz4_block(b[at:], once), size)
    out, scope, at, handle = [], [], 0, 0

    def text() -> str:
        nonlocal at
        end = raw.index(b"\0", at)
        s = raw[at:end].decode("utf-8", "replace")
        at = end + 1
        return s

    while at < len(raw):
        tag = raw[at]
        at += 1
        if tag == 254:
            at += 1
            scope.append(text())
            text()
        elif tag == 255:
            if scope:
                scope.pop()
        elif tag == 252:
            at += 2
            text()
            _, at = uvarint(raw, at)
        elif tag == 253:
            continue
        else:
            at += 1
            name = text()
            width, at = uvarint(raw, at)
            alias, at = uvarint(raw, at)
            if not alias:
                handle += 1
            words = name.split()
            base = words[0] if words else name
            if len(words) > 1 and width == 1 and ":" not in words[1]:
                base += words[1]
            out.append((".".join([*(s for s in scope if s), base]), alias or handle, width, tag))
    return out


def _inflate(b: bytes, packed: int, size: int) -> bytes:
    return b[:size] if packed == size else zlib.decompress(b[:packed])


def read_changes(kind: int, b: bytes, widths: dict[int, tuple[int, int]], window: tuple[int, int | None] | None = None) -> dict[tuple[int, int], int]:
    """Toggles by (handle, bit) of one block; widths: handle -> (width, type). Bit -1 stands for a real signal."""
    begin, end, _ = struct.unpack(">QQQ", b[:24])
    at = 24
    size, at = uvarint(b, at)
    packed, at = uvarint(b, at)
    n_frame, at = uvarint(b, at)
    frame = _inflate(b[at : at + packed], packed, size)
    at += packed
    n_handles, at = uvarint(b, at)
    pack = chr(b[at])
    at += 1
    body = at  # chain offsets count from the byte before the first chain
    t_raw, t_packed, n_times = struct.unpack(">QQQ", b[-24:])
    times_raw = _inflate(b[-24 - t_packed : -24], t_packed, t_raw)
    times, now, k = [], 0, 0
    for _ in range(n_times):
        d, k = uvarint(times_raw, k)
        now += d
        times.append(now)
    index_end = len(b) - 24 - t_packed - 8
    index_len = struct.unpack(">Q", b[index_end : index_end + 8])[0]
    index = b[index_end - index_len : index_end]
    where: dict[int, int] = {}
    same: dict[int, int] = {}
    k, h, offset, last = 0, 1, 0, 0
    while k < len(index) and h <= n_handles:
        if kind == ALIAS2:
            if index[k] & 1:
                v, k = svarint(index, k)
                v >>= 1
                if v > 0:
                    offset += v
                    where[h] = offset
                elif v < 0:
                    last = -v
                    same[h] = last
                elif last:
                    same[h] = last
                h += 1
            else:
                v, k = uvarint(index, k)
                h += v >> 1
        else:
            v, k = uvarint(index, k)
            if v & 1:
                offset += v >> 1
                where[h] = offset
                h += 1
            elif v == 0 and kind == ALIAS:
                v, k = uvarint(index, k)
                same[h] = v
                h += 1
            else:
                h += v >> 1
    stops = sorted([*where.values(), index_end - index_len - body + 1])
    # the frame holds the characters of every handle in order
    starts, k = {}, 0
    for x in sorted(widths):
        if x > n_frame:
            break
        w, typ = widths[x]
        starts[x] = (k, 8 if typ in REAL_TYPES else w)
        k += starts[x][1]
    out: dict[tuple[int, int], int] = {}

    def inside(t: int) -> bool:
        return window is None or (t >= window[0] and (window[1] is None or t < window[1]))

    for x, (w, typ) in widths.items():
        src = x
        for _ in range(len(same) + 1):
            if src not in same:
                break
            src = same[src]
        else:
            raise ValueError("aliases in a loop")
        if src not in where or typ == TEXT_TYPE:
            continue
        a = body + where[src] - 1
        z = body + stops[stops.index(where[src]) + 1] - 1
        n, p = uvarint(b, a)
        chain = b[p:z]
        if n:
            chain = zlib.decompress(chain) if pack == "Z" else lz4_block(chain, n) if pack == "4" else _fastlz(chain, n)
        k, step = 0, 0
        if w == 1 and typ not in REAL_TYPES:
            f = starts.get(x)
            level = LEVEL.get(chr(frame[f[0]]).lower()) if f and f[0] < len(frame) else None
            while k < len(chain):
                v, k = uvarint(chain, k)
                if v & 1:
                    c = STATES[(v >> 1) & 7]
                    step += v >> 4
                else:
                    c = "01"[(v >> 1) & 1]
                    step += v >> 2
                new = LEVEL.get(c)
                if new is not None:
                    if level is not None and new != level and inside(times[step]):
                        out[x, 0] = out.get((x, 0), 0) + 1
                    level = new
            continue
        if typ in REAL_TYPES:
            f = starts.get(x)
            before = frame[f[0] : f[0] + 8] if f else b""
            before = before if len(before) == 8 and before[6:] != b"\xf8\x7f" else None  # an unset value is not compared with
            while k < len(chain):
                v, k = uvarint(chain, k)
                step += v >> 1
                size = 8 if v & 1 else 1
                new = chain[k : k + size].ljust(8, b"\0")
                k += size
                if before is not None and new != before and inside(times[step]):
                    out[x, -1] = out.get((x, -1), 0) + 1
                before = new
            continue
        f = starts.get(x)
        have = [LEVEL.get(chr(c).lower()) for c in frame[f[0] : f[0] + w]] if f else [None] * w
        have += [None] * (w - len(have))
        while k < len(chain):
            v, k = uvarint(chain, k)
            step += v >> 1
            if v & 1:
                new = [LEVEL.get(chr(c).lower()) for c in chain[k : k + w]]
                k += w
            else:
                n_bytes = (w + 7) // 8
                bits = int.from_bytes(chain[k : k + n_bytes], "big") >> (8 * n_bytes - w)
                k += n_bytes
                new = [(bits >> (w - 1 - j)) & 1 for j in range(w)]
            for j, c in enumerate(new):
                if c is None:
                    continue
                if have[j] is not None and have[j] != c and inside(times[step]):
                    out[x, w - 1 - j] = out.get((x, w - 1 - j), 0) + 1
                have[j] = c
    return out


def _fastlz(b: bytes, size: int) -> bytes:
    """Decompresses FastLZ of either level, which the top bits of the first byte tell."""
    second, out, at = b[0] >> 5 == 1, bytearray(), 1
    if b[0] >> 5 > 1:
        raise ValueError("an unknown level of compression")
    ctrl = b[0] & 31
    while True:
        if ctrl < 32:
            out += b[at : at + ctrl + 1]
            at += ctrl + 1
        else:
            n, far = (ctrl >> 5) - 1, (ctrl & 31) << 8
            while n >= 6:
                n += b[at]
                at += 1
                if not second or b[at - 1] != 255:
                    break
            near = b[at]
            at += 1
            back = far + near + 1
            if second and near == 255 and far == 31 << 8:
                back = (b[at] << 8) + b[at + 1] + 8191 + 1
                at += 2
            if back > len(out):
                raise ValueError("a match before the start")
            for _ in range(n + 3):
                out.append(out[-back])
        if at >= len(b):
            break
        ctrl = b[at]
        at += 1
    if len(out) != size:
        raise ValueError(f"{len(out)} bytes instead of {size}")
    return bytes(out)


COPIES = 16  # of a file's hierarchy: tasks among which its blocks are spread
BLOCK_SCHEMA = pa.schema([("src_id", pa.int64()), ("place", pa.int32()), ("kind", pa.int32()), ("head", pa.binary()), ("body", pa.binary())])
NAME_SCHEMA = pa.schema([("src_id", pa.int64()), ("path", pa.string()), ("handle", pa.int64()), ("bit", pa.int64()), ("seconds", pa.float64())])
COUNT_SCHEMA = pa.schema([("src_id", pa.int64()), ("handle", pa.int64()), ("bit", pa.int64()), ("n_toggles", pa.int64())])


def scan(files: DataFrame, window: tuple[int, int | None] | None = None) -> DataFrame:
    """files (src_id, content) -> src_id, path, bit, n_toggles and rate, by name: aliases are credited each.

    The blocks of a file are found first and decoded as rows of their own; its hierarchy goes once to each of COPIES places among which
    they are spread. Blocks give the bits that toggle, by handle; names are joined at the end. A file that was broken off gives what its
    finished blocks hold."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for src, data in zip(b.column("src_id").to_pylist(), b.column("content").to_pylist(), strict=True):
                got = list(blocks(data))
                head = next((x for k, x in got if k == HEADER), None)
                hier = next(((k, x) for k, x in got if k in (HIER, HIER_LZ4, HIER_LZ4DUO)), None)
                if head is None or hier is None:
                    raise ValueError(f"source {src}: no header or hierarchy")
                changes = [(k, x) for k, x in got if k in (VCDATA, ALIAS, ALIAS2)]
                for place in range(max(1, min(COPIES, len(changes)))):
                    yield pa.RecordBatch.from_pylist([{"src_id": src, "place": place, "kind": -hier[0], "head": head, "body": hier[1]}], schema=BLOCK_SCHEMA)
                for n, (k, x) in enumerate(changes):
                    yield pa.RecordBatch.from_pylist([{"src_id": src, "place": n % COPIES, "kind": k, "head": None, "body": x}], schema=BLOCK_SCHEMA)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, widths = None, {}
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["head"] is not None:
                    if r["src_id"] != src:
                        src, widths = r["src_id"], {h: (w, t) for _, h, w, t in reversed(read_hierarchy(-r["kind"], r["body"]))}
                    continue
                rows += [{"src_id": src, "handle": h, "bit": bit, "n_toggles": n} for (h, bit), n in read_changes(r["kind"], r["body"], widths, window).items() if n]
            yield pa.RecordBatch.from_pylist(rows, schema=COUNT_SCHEMA)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                head = read_header(r["head"])
                lo = max(head["start"], window[0]) if window else head["start"]
                hi = min(head["end"], window[1]) if window and window[1] is not None else head["end"]
                for path, h, w, t in read_hierarchy(-r["kind"], r["body"]):
                    rows += [{"src_id": r["src_id"], "path": path, "handle": h, "bit": bit, "seconds": max(0.0, float(hi - lo)) * head["tick_s"]} for bit in ([-1] if t in REAL_TYPES else [] if t == TEXT_TYPE else range(w))]
            yield pa.RecordBatch.from_pylist(rows, schema=NAME_SCHEMA)

    parts = materialise(files.select("src_id", "content").mapInArrow(cut, "src_id long, place int, kind int, head binary, body binary"), "fst_blocks")
    names = parts.filter("head is not null and place = 0").mapInArrow(named, "src_id long, path string, handle long, bit long, seconds double")
    spread = parts.repartition("src_id", "place").sortWithinPartitions("src_id", "place", F.col("head").isNull())
    n = spread.mapInArrow(decode, "src_id long, handle long, bit long, n_toggles long").groupBy("src_id", "handle", "bit").agg(F.sum("n_toggles").alias("n"))
    out = names.join(n, ["src_id", "handle", "bit"], "left").groupBy("src_id", "path", "bit").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n_toggles"), F.max("seconds").alias("seconds"))
    return out.withColumn("rate", F.coalesce(F.try_divide(F.col("n_toggles").cast("double"), F.nullif("seconds", F.lit(0.0))), F.lit(0.0)))
