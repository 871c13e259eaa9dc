"""Binary alignments (BAM): BGZF blocks of records, read in parts of a file.

The driver reads the header, and about a block or two around each border between parts, to find where the first
record after it begins. Each task then decodes its own part, and fails if its last record does not end where
the next part begins, so a border is never wrong silently. Files are opened by pyarrow's file systems
(local, hdfs, s3 and others by the scheme of the path), so nothing goes through the driver.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Compressed bytes of a part.
PART = 64 << 20
#: Records in a row that must make sense for a place to be the beginning of one.
CHAIN = 8


def _tools() -> tuple[Callable, Callable]:
    """(open_file, blocks); nested, so that tasks carry them along and need no package of ours."""
    import struct
    import zlib

    def open_file(path: str):
        import pyarrow.fs as fs

        if "://" not in path and not path.startswith("file:"):
            system, name = fs.LocalFileSystem(), path
        else:
            system, name = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
        return system.open_input_file(name)

    def blocks(f, at: int, size: int):
        """(offset of a BGZF block, its inflated bytes) from the block at `at` on."""
        while at < size:
            f.seek(at)
            head = f.read(18)
            if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04" or head[12:14] != b"BC":
                raise ValueError(f"no BGZF block at {at}")
            length = struct.unpack_from("<H", head, 16)[0] + 1
            body = f.read(length - 18)
            if len(body) < length - 18:
                raise ValueError(f"the block at {at} is cut short")
            data = zlib.decompress(body[: length - 18 - 8], -15)
            crc, n = struct.unpack_from("<II", body, length - 18 - 8)
            if n != len(data) or crc != zlib.crc32(data):
                raise ValueError(f"bad checksum in the block at {at}")
            yield at, data
            at += length

    return open_file, blocks


def _next_block(f, at: int, size: int) -> int | None:
    """The first place from `at` on where a BGZF block begins that another, or the end, follows."""
    while at < size:
        f.seek(at)
        chunk = f.read(min(1 << 17, size - at))
        k = chunk.find(b"\x1f\x8b\x08\x04")
        while 0 <= k <= len(chunk) - 18:
            if chunk[k + 12 : k + 14] == b"BC":
                end = at + k + struct.unpack_from("<H", chunk, k + 16)[0] + 1
                f.seek(end)
                if end == size or end < size and f.read(4) == b"\x1f\x8b\x08\x04":
                    return at + k
            k = chunk.find(b"\x1f\x8b\x08\x04", k + 1)
        if len(chunk) < 18:
            return None
        at += len(chunk) - 17
    return None


def _record(data: bytes, at: int, refs: list[tuple[str, int]]) -> int | None:
    """Where the record that seems to begin at `at` ends; None if there is none, -1 if more bytes are needed."""
    if at + 36 > len(data):
        return -1
    size, ref, pos, name, _, _, cigar, _, seq, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", data, at)
    fixed = 32 + name + 4 * cigar + (max(seq, 0) + 1) // 2 + max(seq, 0)
    good = size >= fixed and name > 0 and seq >= 0 and -1 <= ref < len(refs) and -1 <= mate < len(refs) and pos >= -1 and mate_pos >= -1
    if not good or ref >= 0 and pos > refs[ref][1] or size > 1 << 28:
        return None
    if at + 36 + name > len(data):
        return -1
    qname = data[at + 36 : at + 36 + name]
    if qname[-1] != 0 or not all(33 <= c <= 126 for c in qname[:-1]):
        return None
    return at + 4 + size


def _first_record(f, at: int, size: int, refs: list[tuple[str, int]]) -> tuple[int, int] | None:
    """(block, offset in it) of the first record that begins in the block at `at` or a later one."""
    _, blocks = _tools()
    data, starts, stream = b"", [], blocks(f, at, size)
    for block, more in stream:
        starts.append((len(data), block))
        data += more
        for u in range(len(data)):
            end, n = u, 0
            while n < CHAIN and end is not None and 0 <= end < len(data):
                end, n = _record(data, end, refs), n + 1
            if end is None:
                continue
            if end == -1 or end > len(data):
                if n < CHAIN:
                    break  # more bytes tell
            elif end == len(data) and n < CHAIN and block + 1 < size:
                break
            first, own = max((s, b) for s, b in starts if s <= u)
            return own, u - first
        else:
            if len(starts) > 1 << 12:
                raise ValueError(f"no record after {at}")
    # the end of the file is near: the longest chain that reaches it exactly
    for u in range(len(data)):
        end = u
        while end not in (None, -1) and end < len(data):
            end = _record(data, end, refs)
        if end == len(data) and u < len(data):
            first, own = max((s, b) for s, b in starts if s <= u)
            return own, u - first
    return None


def _header(f, size: int) -> tuple[list[tuple[str, int]], tuple[int, int]]:
    """(references with lengths, (block, offset) of the first record)."""
    _, blocks = _tools()
    data, starts = b"", []
    for block, more in blocks(f, 0, size):
        starts.append((len(data), block))
        data += more
        try:
            if data[:4] != b"BAM\x01":
                raise ValueError("no BAM file")
            at = 8 + struct.unpack_from("<i", data, 4)[0]
            n, at, refs = struct.unpack_from("<i", data, at)[0], at + 4, []
            for _ in range(n):
                length = struct.unpack_from("<i", data, at)[0]
                name = data[at + 4 : at + 4 + length - 1].decode("ascii")
                refs.append((name, struct.unpack_from("<i", data, at + 4 + length)[0]))
                at += 8 + length
        except struct.error:
            continue
        if at <= len(data):
            first, own = max((s, b) for s, b in starts if s <= at)
            return refs, (own, at - first)
    raise ValueError("the header is cut short")


def bam_fields(spark: SparkSession, path: str, part: int = PART) -> DataFrame:
    """f: the eleven fields and the tags of each record, as the lines of a SAM file have them (sequence and qualities as *).

    ValueError if there is no such file, or it is none of this format.
    """
    open_file, _ = _tools()
    try:
        with open_file(path) as f:
            size = f.size()
            refs, first = _header(f, size)
            begins = [first]
            for at in range(part, size, part):
                block = _next_block(f, max(at, begins[-1][0] + 1), size)
                found = None if block is None else _first_record(f, block, size, refs)
                if found is not None and found > begins[-1]:
                    begins.append(found)
    except (OSError, zlib.error, struct.error) as e:
        raise ValueError(f"no binary alignments can be read from {path!r}: {e}") from e
    parts = [(path, *a, *b) for a, b in zip(begins, [*begins[1:], (size, 0)], strict=True)]
    df = spark.createDataFrame(parts, "path string, block long, at long, end_block long, end_at long")
    return df.repartition(len(parts), "block").mapInArrow(_decoder([r[0] for r in refs]), "f array<string>")


def _decoder(names: list[str]):
    open_file, blocks = _tools()

    def run(batches):
        import struct

        import pyarrow as pa

        kinds = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}

        def fields(r: bytes) -> list[str]:
            ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, mate, mate_pos, t_len = struct.unpack_from("<iiBBHHHiiii", r, 0)
            at = 32 + l_name
            steps = struct.unpack_from(f"<{n_cigar}I", r, at)
            cigar = "".join(f"{x >> 4}{'MIDNSHP=X'[x & 15]}" for x in steps) or "*"
            at += 4 * n_cigar + (l_seq + 1) // 2 + l_seq
            tags = []
            while at + 3 <= len(r):
                tag, kind = r[at : at + 2].decode("ascii"), chr(r[at + 2])
                at += 3
                if kind == "A":
                    tags.append(f"{tag}:A:{chr(r[at])}")
                    at += 1
                elif kind in kinds:
                    v = struct.unpack_from(kinds[kind], r, at)[0]
                    tags.append(f"{tag}:f:{v:g}" if kind == "f" else f"{tag}:i:{v}")
                    at += struct.calcsize(kinds[kind])
                elif kind in "ZH":
                    end = r.index(0, at)
                    tags.append(f"{tag}:{kind}:{r[at:end].decode('utf-8', 'replace')}")
                    at = end + 1
                elif kind == "B":
                    sub, n = chr(r[at]), struct.unpack_from("<i", r, at + 1)[0]
                    if tag == "CG" and sub == "I" and n_cigar == 2 and steps[0] & 15 == 4 and steps[0] >> 4 == l_seq and steps[1] & 15 == 3:
                        steps = struct.unpack_from(f"<{n}I", r, at + 5)  # a CIGAR too long for its field
                        cigar = "".join(f"{x >> 4}{'MIDNSHP=X'[x & 15]}" for x in steps)
                    at += 5 + n * struct.calcsize(kinds[sub])
                else:
                    raise ValueError(f"unknown kind of tag {kind!r}")
            name = lambda k: names[k] if k >= 0 else "*"
            where = "=" if mate == ref and ref >= 0 else name(mate)
            return [r[32 : 31 + l_name].decode("ascii") or "*", str(flag), name(ref), str(pos + 1), str(mapq), cigar, where, str(mate_pos + 1), str(t_len), "*", "*", *tags]

        def read(path, block, at, end_block, end_at):
            with open_file(path) as f:
                data, base, out, size = b"", None, [], f.size()
                stream = blocks(f, block, size)
                place = {}  # offset in data of the block that the part ends in
                while True:
                    # a record is whole, or more is read; the part ends where the next one's first record begins
                    while len(data) - at >= 4:
                        if end_block in place and at >= place[end_block] + end_at:
                            break
                        n = struct.unpack_from("<i", data, at)[0]
                        if len(data) - at - 4 < n:
                            break
                        out.append(fields(data[at + 4 : at + 4 + n]))
                        at += 4 + n
                        if len(out) == 4096:
                            yield out
                            out = []
                    if end_block in place and at >= place[end_block] + end_at:
                        if at != place[end_block] + end_at:
                            raise ValueError(f"a record of {path!r} crosses into the next part at {end_block}")
                        break
                    got = next(stream, None)
                    if got is None:
                        if at != len(data):
                            raise ValueError(f"the last record of {path!r} is cut short")
                        break
                    if base is not None:
                        data, place, at = data[at:], {k: v - at for k, v in place.items()}, 0
                    base = got[0]
                    place[got[0]] = len(data)
                    place = {k: v for k, v in place.items() if k == end_block or k == got[0]}
                    data += got[1]
                if out:
                    yield out

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("path", "block", "at", "end_block", "end_at")), strict=True):
                for rows in read(*row):
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], ["f"])

    return run


def read_bam(spark: SparkSession, path: str, part: int = PART) -> DataFrame:
    """Aligned reads as text.read_sam gives them."""
    from .text import reads_of

    return reads_of(bam_fields(spark, path, part).select(F.col("f")))
